"""Near-duplicate texts by ProbMinHash, banding and verification.

A text is a multiset of hashed shingles of five words; their counts are weights. Every element sends a Poisson process
of arrivals with its weight as rate, each arrival falls on one register, and a register keeps the element that arrives
first. An element whose next arrival comes after the last register was taken is done, so most elements need one or two
draws. The share of equal registers estimates the probability Jaccard similarity of two texts.

Bands of registers give buckets. Within a bucket every text is first verified against one member alone, the one that
meets the most others in its buckets, by registers first, which is linear however large the bucket, and the links united. Where the other
members of a bucket then lie in several components, those outside of its largest component are compared with all members
by a longer sketch, a byte for each of its registers and no texts. Only members that agree enough with another to be its
near-duplicate come with their texts then, and are verified in blocks that return a spanning forest of their links. A pair
is compared in the first bucket that both share, so once. Texts of one component need no further pair, so of the pairs
that meet in a bucket no link between different groups is lost, and no group is expanded into all pairs.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugework.llm.common import carried, discard, field, restored, ship, slices, stored
from gaugework.llm.graph import connected_components
from gaugework.llm.memo import own

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 26, 5
REGISTERS = BANDS * ROWS
#: Registers of the longer sketch. Pairs that agree less than four standard deviations below the threshold, on all of them
#: or on the first COARSE, aren't verified.
FINE, COARSE = 512, 128
#: Members of a bucket, and bytes of their texts, in a block of comparisons.
BLOCK, BLOCK_BYTES = 2048, 8 << 20
FILTER_BITS = 1 << 25
MEMO = 100_000
WORD = re.compile(r"\w+")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = _Hashes()


def shingles(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed shingles of the whole text, rising, and their counts; a text of fewer than five words is one shingle."""
    words = WORD.findall((text or "").lower())
    if not words:
        return np.zeros(0, dtype=np.uint64), np.zeros(0)
    h = np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    n = max(1, len(h) - SHINGLE + 1)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(min(SHINGLE, len(h))):
        out = mix(out * _ODD + h[k : k + n] + np.uint64(k + 1))
    found, counts = np.unique(out, return_counts=True)
    return found, counts.astype(float)


def margin(threshold: float, registers: int) -> float:
    """Four standard deviations of the share of equal registers."""
    return 4 * (threshold * (1 - threshold) / registers) ** 0.5


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], registers: int = REGISTERS) -> np.ndarray:
    """ProbMinHash registers of each set, as the elements that hold them; an empty set has registers 0."""
    n = len(sets)
    e = np.concatenate([s[0] for s in sets]) if n else np.zeros(0, dtype=np.uint64)
    rate = np.concatenate([s[1] for s in sets]) if n else np.zeros(0)
    owner = np.repeat(np.arange(n), [len(s[0]) for s in sets]) if n else np.zeros(0, dtype=int)
    first = np.full(n * registers, np.inf)
    holder = np.zeros(n * registers, dtype=np.uint64)
    time = np.zeros(len(e))
    last = np.full(n, np.inf)
    active, k = np.arange(len(e)), 0
    while len(active):
        k += 1
        x = mix(e[active] + np.uint64(k * int(_ODD) & 0xFFFFFFFFFFFFFFFF))
        time[active] -= np.log(((x >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / rate[active]
        early = time[active] < last[owner[active]]
        active, x = active[early], x[early]
        cell = owner[active] * registers + ((mix(x + _ODD) >> np.uint64(32)) % np.uint64(registers)).astype(int)
        at = time[active]
        np.minimum.at(first, cell, at)
        won = first[cell] == at
        holder[cell[won]] = e[active][won]
        touched = np.unique(owner[active])
        last[touched] = first.reshape(n, registers)[touched].max(axis=1)
    return holder.reshape(n, registers)


def band_keys(held: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of registers."""
    bands = held.reshape(len(held), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _ODD, (len(held), BANDS))
    for k in range(ROWS):
        key = mix(key * _ODD + bands[:, :, k])
    return key.view(np.int64) if key.flags["C_CONTIGUOUS"] else np.ascontiguousarray(key).view(np.int64)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The exact probability Jaccard similarity of two weighted sets; 0 if either is empty."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    x, y = a[1][i], b[1][j]
    if (x == 1).all() and (y == 1).all() and a[1].max() == b[1].max() == 1:
        return len(both) / (len(a[0]) + len(b[0]) - len(both))
    ratio = x / y
    only_a = a[1].sum() - x.sum()  # infinite ratio: always the first weight
    only_b = b[1].sum() - y.sum()
    order = np.argsort(ratio, kind="stable")
    r, xs, ys = ratio[order], x[order], y[order]
    upper = xs[::-1].cumsum()[::-1]
    lower = np.concatenate([[0.0], ys.cumsum()])
    at = np.searchsorted(r, r, side="left")
    return float((1.0 / ((upper[at] + only_a) / xs + (lower[at] + only_b) / ys)).sum())


@lru_cache(maxsize=64)
def _recent(text: str) -> tuple[np.ndarray, np.ndarray]:
    return shingles(text)


def sketch(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, digest, keys, low) of every document: band keys and the lowest byte of each register.

    Empty texts have no digest, texts without words no keys.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own("minhash", _hashes, _recent.cache_clear)
        for whole in batches:
            for batch in slices(whole, 1):
                texts = batch.column(1).to_pylist()
                sets = [shingles(t) for t in texts]
                held = signatures(sets)
                keys = band_keys(held)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array([hashlib.md5(t.encode(), usedforsecurity=False).digest() if t else None for t in texts], type=pa.binary()),
                        pa.array([k if len(s[0]) else None for k, s in zip(keys, sets, strict=True)], type=pa.list_(pa.int64())),
                        pa.array([h.tobytes() if len(s[0]) else None for h, s in zip(held.astype(np.uint8), sets, strict=True)], type=pa.binary()),
                    ],
                    names=["id", "digest", "keys", "low"],
                )

    return docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "id bigint, digest binary, keys array<bigint>, low binary")


def fine_sketch(texts: DataFrame) -> DataFrame:
    """(node, keys, held, size): band keys, the lowest byte of each of FINE registers, and bytes of the texts (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own("minhash", _hashes, _recent.cache_clear)
        for whole in batches:
            for batch in slices(whole, 1):
                texts = batch.column(1).to_pylist()
                sets = [shingles(t) for t in texts]
                held = signatures(sets, FINE).astype(np.uint8)
                columns = [[k.tobytes() for k in band_keys(signatures(sets))], [h.tobytes() for h in held]]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, type=pa.binary()) for c in columns), pa.array([len(t.encode()) for t in texts], type=pa.int64())], names=["node", "keys", "held", "size"])

    return texts.mapInArrow(run, "node bigint, keys binary, held binary, size bigint")


def narrowed(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The ``rows`` whose id may be one of ``ids``, so that a join moves few rows that it doesn't need.

    The filter is a bit set of fixed size as a table of words, FILTER_BITS / 32 at most, which is sent to every task;
    false positives are joined away later.
    """
    place = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    words = ids.select(place.alias("p")).groupBy(F.expr("p div 32").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 32 as int))")).alias("bits"))
    placed = rows.withColumn("p", place).withColumn("w", F.expr("p div 32"))
    found = placed.join(F.broadcast(words), (F.col("w") == F.col("word")) & (F.expr("shiftright(bits, cast(p % 32 as int)) & 1") == 1), "left_semi")
    return found.drop("p", "w")


def texts_of(wanted: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, text) of the nodes ``wanted`` (node); ``nodes`` has their key and digest, ``texts`` is (id, text)."""
    named = wanted.withColumnRenamed("node", "n").join(nodes, F.col("n") == F.col("node")).select("node", "least", "digest")
    rows = narrowed(texts, named.select(F.col("least").alias("id"))).withColumn("of", F.unhex(F.md5(F.encode("text", "UTF-8"))))
    return rows.join(named, (F.col("id") == F.col("least")) & (F.col("of") == F.col("digest"))).select("node", "text")


def likely(pairs: DataFrame, drawn: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose registers agree no less than four standard deviations below ``threshold``; ``drawn`` has node and low."""
    least = threshold - margin(threshold, REGISTERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            x, y = (np.frombuffer(b"".join(rows.column(i).to_pylist()), dtype=np.uint8).reshape(-1, REGISTERS) for i in (2, 3))
            keep = pa.array((x == y).mean(axis=1) >= least, type=pa.bool_())
            yield pa.RecordBatch.from_arrays([rows.column(0).filter(keep), rows.column(1).filter(keep)], names=["a", "b"])

    left, right = drawn.select("node", "low").toDF("na", "la"), drawn.select("node", "low").toDF("nb", "lb")
    both = pairs.join(left, F.col("a") == F.col("na")).select("a", "b", "la").join(right, F.col("b") == F.col("nb"))
    return both.select("a", "b", "la", "lb").mapInArrow(run, "a bigint, b bigint")


def verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose whole texts have a similarity of ``threshold`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own("minhash", _hashes, _recent.cache_clear)
        for whole in batches:
            for rows in slices(whole, 2, 3):
                a, b = rows.column(2).to_pylist(), rows.column(3).to_pylist()
                keep = pa.array([probability_jaccard(shingles(x), _recent(y)) >= threshold for x, y in zip(a, b, strict=True)], type=pa.bool_())
                yield pa.RecordBatch.from_arrays([rows.column(0).filter(keep), rows.column(1).filter(keep)], names=["a", "b"])
        _recent.cache_clear()

    left = texts_of(pairs.select(F.col("a").alias("node")).distinct(), nodes, texts).toDF("ta", "text_a")
    right = texts_of(pairs.select(F.col("b").alias("node")).distinct(), nodes, texts).toDF("tb", "text_b")
    both = pairs.select("a", "b").join(left, F.col("a") == F.col("ta")).select("a", "b", "text_a").join(right, F.col("b") == F.col("tb"))
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint").distinct()


class Members:
    """The rows of a block: members of one bucket (key) and the probes that they are compared with."""

    def __init__(self, pdf: pd.DataFrame, threshold: float):
        self.held = np.frombuffer(b"".join(pdf["held"]), dtype=np.uint8).reshape(len(pdf), -1)
        self.keys = np.frombuffer(b"".join(pdf["keys"]), dtype=np.int64).reshape(len(pdf), -1)
        self.node, self.component, self.probe = pdf["node"].to_numpy(), pdf["component"].to_numpy(), pdf["probe"].to_numpy(dtype=bool)
        self.key, self.twice = pdf["key"].iloc[0], self.component != pdf["major"].iloc[0]
        self.mine = np.flatnonzero(~self.probe)
        self.coarse, self.fine = threshold - margin(threshold, COARSE), threshold - margin(threshold, FINE)
        self.root = np.unique(self.component, return_inverse=True)[1]  # the set of each row's component

    def near(self, p: int) -> np.ndarray:
        """The members of other sets that may be near-duplicates of probe ``p`` and share no earlier bucket with it, the likeliest first.

        A pair of probes meets in two blocks; it counts where the greater node is the probe.
        """
        far = self.mine[(self.root[self.mine] != self.root[p]) & ~(self.twice[self.mine] & (self.node[self.mine] >= self.node[p]))]
        far = far[(self.held[far, :COARSE] == self.held[p, :COARSE]).mean(axis=1) >= self.coarse]
        alike = (self.held[far] == self.held[p]).mean(axis=1)
        order = np.argsort(-alike, kind="stable")
        far = far[order[alike[order] >= self.fine]]
        return far[self.keys[p][(self.keys[far] == self.keys[p]).argmax(axis=1)] == self.key]

    def unite(self, a: int, b: int) -> None:
        self.root[self.root == self.root[a]] = self.root[b]


def in_blocks(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Members and probes of buckets dealt to blocks; ``rows`` has key, node, component, keys, held, blocks, major.

    Members lie in blocks; those outside of the largest component are probes too, dealt to blocks of their own, and every
    block of probes meets every block of members.
    """
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    grid = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    members = rows.withColumn("block", block).withColumn("other", grid).withColumn("probe", F.lit(False))
    probes = rows.filter("component <> major").withColumn("other", block).withColumn("block", grid).withColumn("probe", F.lit(True))
    return members.select("block", "other", "probe", *columns).unionByName(probes.select("block", "other", "probe", *columns))


SKETCHED = ["key", "node", "component", "major", "keys", "held"]


def uncertain(rows: DataFrame, threshold: float) -> DataFrame:
    """(key, node) of the members of buckets that the longer sketch finds alike enough to another component's member."""

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        m = Members(pdf, threshold)
        found = np.zeros(len(pdf), dtype=bool)
        for p in np.flatnonzero(m.probe):
            near = m.near(p)
            found[near] = True
            found[p] = len(near) > 0
        return pd.DataFrame({"key": pdf["key"][found], "node": pdf["node"][found]})

    return in_blocks(rows, SKETCHED).groupBy("key", "block", "other").applyInPandas(compare, "key bigint, node bigint").distinct()


def links_within(rows: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between different components of a bucket, verified on whole texts: a spanning forest for each block."""

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        own("minhash", _hashes, _recent.cache_clear)
        m, texts, out = Members(pdf, threshold), pdf["text"].tolist(), []
        sets: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def of(k: int) -> tuple[np.ndarray, np.ndarray]:
            if k not in sets:
                sets[k] = shingles(texts[k])
            return sets[k]

        for p in np.flatnonzero(m.probe):
            for k in m.near(p):
                if m.root[p] != m.root[k] and probability_jaccard(of(p), of(k)) >= threshold:
                    out.append((m.node[p], m.node[k]))
                    m.unite(p, k)
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return in_blocks(rows, [*SKETCHED, "text"]).groupBy("key", "block", "other").applyInPandas(compare, "a bigint, b bigint")


def further_links(members: DataFrame, links: DataFrame, nodes: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between different components of one bucket, of which ``members`` (key, node) leaves out the pivot."""
    components = connected_components(links).toDF("member", "component")
    apart = stored(members.join(components, F.col("node") == F.col("member"), "left").select("key", "node", F.coalesce("component", "node").alias("component")))
    counts = apart.groupBy("key", "component").agg(F.count("*").alias("n"))
    mixed = counts.groupBy("key").agg(F.sum("n").alias("total"), F.max(F.struct("n", "component")).alias("largest"), F.count("*").alias("parts")).filter("parts > 1")
    mixed = stored(mixed.select(F.col("key").alias("k"), F.col("largest.component").alias("major"), F.ceil(F.col("total") / BLOCK).cast("int").alias("blocks")))
    placed = apart.join(mixed, F.col("key") == F.col("k")).drop("k")
    drawn = stored(fine_sketch(texts_of(placed.select("node").distinct(), nodes, texts)).withColumnRenamed("node", "d"))
    rows = placed.join(drawn, F.col("node") == F.col("d")).drop("d")
    hot = stored(uncertain(rows, threshold).toDF("hk", "hn"))
    rows = rows.join(hot, (F.col("key") == F.col("hk")) & (F.col("node") == F.col("hn")), "left_semi")
    weight = rows.groupBy("key").agg(F.greatest(F.ceil(F.sum("size") / BLOCK_BYTES), F.ceil(F.count("*") / BLOCK)).cast("int").alias("blocks")).withColumnRenamed("key", "w")
    held = texts_of(hot.select(F.col("hn").alias("node")).distinct(), nodes, texts).withColumnRenamed("node", "t")
    rows = rows.drop("blocks").join(weight, F.col("key") == F.col("w")).join(held, F.col("node") == F.col("t"))
    found = stored(links_within(rows, threshold))
    discard(apart, mixed, drawn, hot)
    return found


def marked(docs: DataFrame, key: str, text: str, threshold: float) -> DataFrame:
    """Per document: id, digest (null for an empty text), class_id, kept."""
    ship(docs.sparkSession)
    sketches = stored(sketch(docs, key, text).withColumn("row", F.monotonically_increasing_id()))
    # A node is a text; it is named by the row that has it with the smallest key.
    named = sketches.filter("id is not null and digest is not null").groupBy("digest").agg(F.min(F.struct("id", "row")).alias("first"))
    nodes = stored(named.select("digest", F.col("first.id").alias("least"), F.col("first.row").alias("node")))
    drawn = stored(sketches.filter("keys is not null").join(nodes.select("node"), F.col("row") == F.col("node"), "left_semi").select(F.col("row").alias("node"), "keys", "low"))
    banded = drawn.select("node", F.explode("keys").alias("key"))
    sizes = stored(banded.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").withColumnRenamed("key", "k"))
    often = narrowed(banded.withColumnRenamed("key", "id"), sizes.select(F.col("k").alias("id")))  # most keys are of one text
    shared = stored(often.join(sizes, F.col("id") == F.col("k")).select(F.col("id").alias("key"), "node", "n"))
    met = shared.groupBy("node").agg(F.sum("n").alias("met")).withColumnRenamed("node", "i")
    pivots = stored(shared.join(met, F.col("node") == F.col("i")).groupBy("key").agg(F.max_by("node", F.struct("met", -F.col("node"))).alias("pivot")).withColumnRenamed("key", "k"))
    # Of a bucket of two the pivot's pair is the only one; the pivot's pairs need no other check than their verification.
    members = stored(shared.join(pivots, F.col("key") == F.col("k")).filter("node <> pivot").select("key", "node", "pivot", "n"))
    discard(sizes, shared, pivots)
    texts = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    pairs = stored(likely(members.select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct(), drawn, threshold))
    links = stored(verified(pairs, nodes, texts, threshold))
    more = further_links(members.filter("n > 2").select("key", "node"), links, nodes, texts, threshold)
    discard(members, pairs, drawn)
    components = connected_components(links.unionByName(more)).toDF("member", "component")
    grouped = stored(nodes.join(components, F.col("node") == F.col("member")).select("node", "least", "digest", "component"))
    firsts = stored(grouped.groupBy("component").agg(F.min(F.struct("least", "digest")).alias("first")).withColumnRenamed("component", "c"))
    grouped = grouped.join(firsts, F.col("component") == F.col("c")).select(F.col("node").alias("g"), "first")
    classes = nodes.join(grouped, F.col("node") == F.col("g"), "left").select(F.col("digest").alias("of"), F.coalesce("first", F.struct("least", "digest")).alias("first"))
    found = sketches.select("id", "digest").join(stored(classes), F.col("digest") == F.col("of"), "left")
    kept = (F.col("id") == F.col("first.least")) & (F.col("digest") == F.col("first.digest"))
    return found.select("id", "digest", F.when(F.col("id").isNotNull(), F.coalesce("first.least", "id")).alias("class_id"), F.when(F.col("id").isNull() | F.col("digest").isNull(), True).otherwise(kept).alias("kept"))


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per document: key, class_id (the smallest key of its group of near-duplicates), kept (it is the group's first).

    A group is a component of links of probability Jaccard similarity ``threshold`` or more over shingles of five words.
    Equal texts are one. Null and empty texts are near nothing, are their own class and kept; texts without words are near
    their equals alone. Of different texts under one key each has the class of its own group; where one group holds several
    of them, the first by digest is kept. Rows that repeat a key and a text have the same result. A null key has a null
    class and is kept. An empty table gives no rows. Further columns are left out before anything is added.
    """
    return marked(docs, key, text, threshold).select(F.col("id").alias(key), "class_id", "kept")


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One document of each group, the one with the smallest key, with all its columns.

    Rows are decided one by one: of rows that repeat a key, only those go whose text is near another that stays. Of rows
    that repeat a key and a text one stays, the first by all columns' hash. Rows with a null key or a null or empty text stay.
    Further columns may have any name. An empty table gives no rows.
    """
    found = stored(marked(docs, key, text, threshold).filter("id is not null and digest is not null"))
    gone = found.filter("not kept").select("id", "digest").distinct()
    again = found.filter("kept").groupBy("id", "digest").agg(F.count("*").alias("n")).filter("n > 1").select("id", "digest")
    digest = F.unhex(F.md5(F.encode(field(text).cast("string"), "UTF-8")))
    rows = carried(docs).select("row", field(key).cast("bigint").alias("key"), digest.alias("of"))
    left = rows.join(gone, (F.col("key") == F.col("id")) & (F.col("of") == F.col("digest")), "left_anti")
    if not again.isEmpty():
        same = (F.col("key") == F.col("id")) & (F.col("of") == F.col("digest"))
        hashed = F.xxhash64(*(field(c) for c in docs.columns))
        first = left.join(again, same, "left_semi").withColumn("place", F.row_number().over(Window.partitionBy("key", "of").orderBy(hashed))).filter("place = 1").drop("place")
        left = left.join(again, same, "left_anti").unionByName(first)
    return restored(left, docs.columns)
