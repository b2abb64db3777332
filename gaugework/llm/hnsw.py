"""Embedding near-duplicates with hierarchical navigable small-world graphs, one per shard.

Only vectors of one label are compared, so shards lie within labels. Equal vectors are one node with a weight. Every
distinct vector goes as a query to every shard of its label; the queries of a label are dealt to blocks as large as
shards, so a shard's graph travels once for as many queries as it has vectors, and a label that holds a third of all
vectors is spread over its shards times its blocks. The beam of a query widens while its worst result still lies near the
threshold, and a block of queries runs again with twice the beam while an audit against brute force over a sample of the
block finds less than the wanted recall. An audit that meets too few links to measure anything takes a larger sample, and
a block whose audit fails with the widest beam is computed by brute force. Links are verified by cosine in double
precision. A task returns, for each query, how many vectors it links with and a spanning forest of the links, never all
pairs; components unite them.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.functions.shipping import ship
from gaugework.llm.common import cut
from gaugework.llm.graph import connected_components

THRESHOLD = 0.93
#: Distinct vectors in a shard, and in a block of queries (on average; vectors are dealt by hash).
SHARD = 8192
M, EF_BUILD, EF_SEARCH = 12, 48, 48
#: Queries of a block that an audit takes at first, links that it must meet to measure anything, and the recall it wants.
AUDITED, AUDITED_LINKS, WANTED_RECALL = 48, 32, 0.999
#: Queries whose products with a shard brute force holds at a time.
PRODUCTS = 512
#: How far below the threshold the worst result must lie before a beam stops widening.
MARGIN = 0.02


@dataclass
class Graph:
    """Unit vectors and the neighbours of each node by level, lists padded with -1."""

    vectors: np.ndarray
    levels: list[dict[int, list[int]]]
    entry: int

    def descend(self, q: np.ndarray) -> int:
        at = self.entry
        best = float(self.vectors[at] @ q)
        for level in range(len(self.levels) - 1, 0, -1):
            moved = True
            while moved:
                moved = False
                near = self.levels[level].get(at, ())
                if near:
                    found = self.vectors[near] @ q
                    i = int(found.argmax())
                    if found[i] > best:
                        at, best, moved = near[i], float(found[i]), True
        return at

    def beam(self, q: np.ndarray, start: list[int], ef: int, level: int = 0, until: float = 2.0) -> list[tuple[float, int]]:
        """The best ``ef`` nodes found from ``start``, best first; all nodes above ``until`` count beside the beam."""
        links, vectors = self.levels[level], self.vectors
        seen = np.zeros(len(vectors), dtype=bool)
        seen[start] = True
        first = [(float(s), i) for s, i in zip(vectors[start] @ q, start, strict=True)]
        todo = [(-s, i) for s, i in first]
        heapq.heapify(todo)
        kept = sorted(first)[-ef:]
        heapq.heapify(kept)
        sure = [x for x in first if x[0] >= until]
        while todo:
            s, i = heapq.heappop(todo)
            if len(kept) >= ef and -s < kept[0][0] and -s < until:
                break
            near = links.get(i, ())
            if not near:
                continue
            near = np.asarray(near)
            near = near[~seen[near]]
            if not len(near):
                continue
            seen[near] = True
            for score, j in zip((vectors[near] @ q).tolist(), near.tolist(), strict=True):
                if score >= until:
                    sure.append((score, j))
                if len(kept) < ef:
                    heapq.heappush(kept, (score, j))
                elif score > kept[0][0]:
                    heapq.heapreplace(kept, (score, j))
                elif score < until:
                    continue
                heapq.heappush(todo, (-score, j))
        return sorted({*kept, *sure}, reverse=True)


def choose(vectors: np.ndarray, candidates: list[tuple[float, int]], m: int) -> list[int]:
    """Up to ``m`` neighbours, best first, none nearer to one already chosen than to the node; the best rest fill up."""
    ids = [i for _, i in candidates]
    if len(ids) <= m:
        return ids
    sims = vectors[ids] @ vectors[ids].T
    taken: list[int] = []
    for k, (score, _) in enumerate(candidates):
        if len(taken) == m:
            break
        if not taken or score >= sims[k, taken].max():
            taken.append(k)
    chosen = set(taken)
    taken += [k for k in range(len(ids)) if k not in chosen][: m - len(taken)]
    return [ids[k] for k in taken]


def build(vectors: np.ndarray, m: int = M, ef: int = EF_BUILD, seed: int = 4) -> Graph:
    """Insert the vectors one by one; levels are drawn from a seeded generator, so a task that runs again builds the same."""
    rng = np.random.default_rng(seed)
    top = np.minimum(8, (-np.log(rng.random(len(vectors)) + 1e-300) / math.log(m)).astype(int))
    g = Graph(vectors, [{0: []}], 0)
    for level in range(1, int(top[0]) + 1):
        g.levels.append({0: []})
    for i in range(1, len(vectors)):
        q = vectors[i]
        at, best = g.entry, float(vectors[g.entry] @ q)
        for level in range(len(g.levels) - 1, int(top[i]), -1):
            moved = True
            while moved:
                near = g.levels[level].get(at, ())
                moved = False
                if near:
                    found = vectors[near] @ q
                    j = int(found.argmax())
                    if found[j] > best:
                        at, best, moved = near[j], float(found[j]), True
        start = [at]
        for level in range(min(int(top[i]), len(g.levels) - 1), -1, -1):
            found = g.beam(q, start, ef, level)
            most = 2 * m if level == 0 else m
            links = g.levels[level]
            links[i] = near = choose(vectors, found, m)
            for j in near:
                links[j].append(i)
                if len(links[j]) > most + 8:  # trimmed now and then, not at every insertion
                    own = links[j]
                    sims = vectors[own] @ vectors[j]
                    order = np.argsort(-sims, kind="stable")
                    links[j] = choose(vectors, [(float(sims[k]), own[k]) for k in order], most)
            start = [j for _, j in found]
        for _ in range(len(g.levels), int(top[i]) + 1):
            g.levels.append({i: []})
            g.entry = i
    return g


def pack_graph(g: Graph) -> bytes:
    import pickle

    flat = []
    for links in g.levels:
        nodes = np.fromiter(links.keys(), dtype=np.int32, count=len(links))
        sizes = np.fromiter((len(v) for v in links.values()), dtype=np.int32, count=len(links))
        flat.append((nodes, sizes, np.fromiter((j for v in links.values() for j in v), dtype=np.int32, count=int(sizes.sum()))))
    return pickle.dumps((flat, g.entry), protocol=5)


def unpack_graph(vectors: np.ndarray, packed: bytes) -> Graph:
    import pickle

    flat, entry = pickle.loads(packed)  # noqa: S301  written by pack_graph in the same job
    levels = []
    for nodes, sizes, joined in flat:
        ends = np.cumsum(sizes)
        levels.append({int(n): joined[e - s : e].tolist() for n, s, e in zip(nodes, sizes, ends, strict=True)})
    return Graph(vectors, levels, entry)


def search(g: Graph, q: np.ndarray, ef: int, threshold: float) -> list[int]:
    """Nodes of cosine ``threshold`` or more; the beam widens while its worst result lies near the threshold."""
    start = [g.descend(q)]
    until = threshold - MARGIN
    while True:
        found = g.beam(q, start, ef, until=until)
        if found[-1][0] < until or len(found) >= len(g.vectors) or len(found) < ef:
            return [i for s, i in found if s >= threshold]
        ef *= 2
        start = [i for _, i in found[:8]]


def by_force(g: Graph, queries: np.ndarray, threshold: float) -> list[np.ndarray]:
    """The links of queries from all products, a few queries at a time."""
    found: list[np.ndarray] = []
    for at in range(0, len(queries), PRODUCTS):
        found += [np.flatnonzero(row >= threshold) for row in queries[at : at + PRODUCTS] @ g.vectors.T]
    return found


def block_links(g: Graph, queries: np.ndarray, threshold: float, seed: int = 0) -> list[list[int]]:
    """The links of a block of queries; the beam doubles until the audit passes, and past the widest beam brute force answers."""
    order, audited, truth = np.random.default_rng(seed).permutation(len(queries)), 0, []
    while audited < len(queries) and (not audited or sum(map(len, truth)) < AUDITED_LINKS):
        more = order[audited : max(AUDITED, 2 * audited)]
        truth += by_force(g, queries[more], threshold)
        audited += len(more)
    wanted = sum(map(len, truth))
    ef = EF_SEARCH
    while True:
        audit = sum(len(np.intersect1d(search(g, queries[k], ef, threshold), t)) for k, t in zip(order[:audited], truth, strict=True) if len(t))
        if audit >= WANTED_RECALL * wanted:
            return [search(g, q, ef, threshold) for q in queries]
        if ef >= len(g.vectors):
            return [x.tolist() for x in by_force(g, queries, threshold)]
        ef *= 2


def unit(rows) -> np.ndarray:
    x = np.stack([np.asarray(r, dtype=np.float64) for r in rows])
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def nodes_of(df: DataFrame, key: str, vector: str, label: str, shard: int) -> tuple[DataFrame, DataFrame]:
    """(rows, nodes): rows (id, label, node) and distinct usable vectors (node, least, copies, v, label, dim, shards, shard, block)."""
    rows = df.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"), F.col(label).alias("label")).distinct()
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    usable = F.col("label").isNotNull() & F.col("v").isNotNull() & (norm > 0) & (norm < float("inf")) & ~F.isnan(norm)
    rows = cut(rows.withColumn("node", F.when(usable, F.sha2(F.concat_ws(",", F.col("label").cast("string"), F.to_json("v")), 256))))
    nodes = rows.filter("node is not null").groupBy("node").agg(F.count("*").alias("copies"), F.min("id").alias("least"), F.first("v").alias("v"), F.first("label").alias("label"))
    nodes = nodes.withColumn("dim", F.size("v"))
    shards = nodes.groupBy("label", "dim").agg(F.count("*").alias("n")).select("label", "dim", F.greatest(F.lit(1), F.ceil(F.col("n") / shard)).cast("int").alias("shards"))
    place = lambda seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col("shards")).cast("int")
    return rows, cut(nodes.join(shards, ["label", "dim"]).withColumn("shard", place(0)).withColumn("block", place(1)))


CELL = ["label", "dim", "shard", "block"]


def cells(nodes: DataFrame) -> int:
    """Pairs of a shard and a block of queries."""
    return int(nodes.groupBy("label", "dim").agg(F.max("shards").alias("s")).agg(F.sum(F.col("s") * F.col("s"))).first()[0] or 0)


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD, shard: int = SHARD) -> DataFrame:
    """Per vector: n_links, component_id, kept.

    Vectors of different labels, and those that are null, zero or hold null or non-finite components, link with nothing;
    so do vectors of a null label. Vectors of different lengths are compared within their length. Equal vectors link
    with each other. A row that is repeated as a whole counts as one vector. An empty table gives no rows.
    """
    ship(df.sparkSession)
    rows, nodes = nodes_of(df, key, vector, label, shard)

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("least")
        vectors = unit(pdf["v"])
        return pd.DataFrame({
            "label": [pdf["label"].iloc[0]], "dim": [pdf["dim"].iloc[0]], "shard": [pdf["shard"].iloc[0]], "shards": [pdf["shards"].iloc[0]], "ids": [pdf["least"].to_numpy()], "copies": [pdf["copies"].to_numpy()],
            "vectors": [vectors.tobytes()], "graph": [pack_graph(build(vectors))],
        })

    kind = rows.schema["label"].dataType.simpleString()
    graphs = cut(nodes.select("label", "dim", "shard", "shards", "least", "copies", "v").groupBy("label", "dim", "shard").applyInPandas(make, f"label {kind}, dim int, shard int, shards int, ids array<bigint>, copies array<bigint>, vectors binary, graph binary"))
    every = F.explode(F.sequence(F.lit(0), F.col("shards") - 1))
    # As many tasks as there are cells, up to a bound: a cell is seconds of work whatever its bytes.
    tasks = max(1, min(20_000, cells(nodes)))
    index = graphs.withColumn("block", every).select(*CELL, "ids", "copies", "vectors", "graph").repartition(tasks, *CELL)
    queries = nodes.select("label", "dim", every.alias("shard"), "block", "least", "v").repartition(tasks, *CELL)

    def link(index: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(index) or not len(asked):
            return pd.DataFrame({"id": [], "n": [], "other": []}).astype({"id": "int64", "n": "int64", "other": "Int64"})
        r, asked = index.iloc[0], asked.sort_values("least")
        ids, copies, qids = np.asarray(r["ids"]), np.asarray(r["copies"]), asked["least"].to_numpy()
        g = unpack_graph(np.frombuffer(r["vectors"]).reshape(len(ids), -1), r["graph"])
        found = block_links(g, unit(asked["v"]), threshold)
        root: dict[int, int] = {}

        def top(i: int) -> int:
            while root.setdefault(i, i) != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        counts = []
        for q, hits in zip(qids, found, strict=True):
            near = ids[hits]
            counts.append(int(copies[hits][near != q].sum()))
            a = top(int(q))
            for j in near.tolist():
                b = top(j)
                if a != b:
                    a, b = min(a, b), max(a, b)
                    root[b] = a
        forest = [(i, b) for i in list(root) if (b := top(i)) != i]
        return pd.DataFrame({"id": [*qids, *(i for i, _ in forest)], "n": [*counts, *[0] * len(forest)], "other": [*[None] * len(qids), *(b for _, b in forest)]}).astype({"id": "int64", "n": "int64", "other": "Int64"})

    found = cut(index.groupBy(*CELL).cogroup(queries.groupBy(*CELL)).applyInPandas(link, "id bigint, n bigint, other bigint"))
    components = connected_components(found.filter("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    per_node = nodes.select("node", "least", "copies").join(counts.withColumnRenamed("id", "counted"), F.col("least") == F.col("counted"), "left")
    per_node = per_node.join(components.toDF("member", "component"), F.col("least") == F.col("member"), "left")
    per_node = per_node.select(F.col("node").alias("n_node"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "least").alias("component_id"))
    out = rows.select("id", "node").join(per_node, F.col("node") == F.col("n_node"), "left")
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "id").alias("component_id")).withColumn("kept", F.col(key) == F.col("component_id"))


def recall(df: DataFrame, result: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD, every: int = 50, shard: int = SHARD) -> DataFrame:
    """(queries, links, found, recall) of a result of near_duplicates: the vectors whose id is divisible by ``every`` against all, by brute force."""
    ship(df.sparkSession)
    rows, nodes = nodes_of(df, key, vector, label, shard)
    asked = rows.filter(F.col("node").isNotNull() & (F.col("id") % every == 0)).select("id", "node")
    spread = F.explode(F.sequence(F.lit(0), F.col("shards") - 1))
    queries = asked.join(nodes.select("node", "label", "dim", "v", "shards"), "node").select("label", "dim", spread.alias("shard"), "id", "v")

    def count(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(asked):
            return pd.DataFrame({"id": [], "n": []}).astype("int64")
        g, copies = Graph(unit(own["v"]), [], 0), own["copies"].to_numpy()
        return pd.DataFrame({"id": asked["id"], "n": [int(copies[hits].sum()) for hits in by_force(g, unit(asked["v"]), threshold)]}).astype("int64")

    cell = ["label", "dim", "shard"]
    truth = nodes.select(*cell, "copies", "v").groupBy(*cell).cogroup(queries.groupBy(*cell)).applyInPandas(count, "id bigint, n bigint").groupBy("id").agg((F.sum("n") - 1).alias("n"))
    both = truth.join(result.select(F.col(key).alias("k"), "n_links"), F.col("id") == F.col("k"))
    return both.agg(F.count("*").alias("queries"), F.sum("n").alias("links"), F.sum("n_links").alias("found")).withColumn("recall", F.col("found") / F.col("links"))
