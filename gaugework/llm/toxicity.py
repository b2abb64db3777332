"""Toxicity by compression distance: which of two zstandard dictionaries shortens a window of text more.

The ordinary dictionary holds the most frequent words of ordinary training texts and those that look like toxic ones; the
toxic one goes on with the beginnings of words that are typical of toxic training texts. The windows are the words of the text: each is set
between two fixed strings that both dictionaries hold, so that a block is always worth compressing and the difference of
the two lengths depends on the word alone; letters take two bytes, which doubles a match against the fixed cost of a
sequence. The bytes that the toxic dictionary saves on the windows of a text give features (the best window, how many
save, how densely), and the threshold is calibrated on labelled documents that the dictionaries have not seen, through a
logistic curve.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.functions.shipping import ship
from gaugework.llm import minhash
from gaugework.llm.common import held_out, map_rows
from gaugework.llm.memo import own

#: Bounds of the training sample: labelled documents by class, and the longest text taken into it.
SAMPLE_TOXIC, SAMPLE_ORDINARY, SAMPLE_CHARS = 1500, 3000, 40_000
ORDINARY_CHARS, TOXIC_CHARS = 12_000, 2_000
#: Toxic texts that must hold a string, however many there are.
LEAST_TEXTS = 3
#: Strings less typical than this share of the most typical one stay out of the toxic dictionary.
LEAST_SHARE = 0.1
#: Nor do strings whose log-odds of occurring in a toxic text against an ordinary one are lower.
LEAST_ODDS = 2.0
PREFIX = 6
#: Bytes saved from which a window counts as a hit.
HIT = 2
MEMO = 200_000
WORD = re.compile(r"[^\W\d_]{2,64}")
LETTERS = "utf-16-le"
BEFORE = "".join(chr(65 + i) + chr(48 + i % 10) for i in range(24)).encode()
AFTER = bytes(range(112, 96, -1)) + b"0123"


@lru_cache(maxsize=4)
def windows(ordinary: str, toxic: str) -> list:
    """Pairs of compressors, ordinary and toxic, kept by a process for all its tasks.

    The pairs differ in the order of the ordinary words and in their strategy. Where matches overlap, a search may take
    others under one dictionary than under the other by chance; what a toxic string saves, it saves under every pair.
    """
    turned = " " + " ".join(reversed(ordinary.split())) + " "
    made = []
    for words, strategy in ((ordinary, zstandard.STRATEGY_GREEDY), (turned, zstandard.STRATEGY_LAZY2)):
        pair = []
        for content in (words, words + toxic):
            p = zstandard.ZstdCompressionParameters(
                window_log=17, hash_log=16, chain_log=16, search_log=6, min_match=6, strategy=strategy, write_content_size=0, write_checksum=0, write_dict_id=0
            )
            held = zstandard.ZstdCompressionDict(content.encode(LETTERS) + AFTER + BEFORE, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(compression_params=p)
            pair.append(zstandard.ZstdCompressor(dict_data=held, compression_params=p).compress)
        made.append(tuple(pair))
    return made


@dataclass
class Model:
    """Contents of the dictionaries, and the weights of the logistic curve over the features of a text."""

    ordinary: str
    toxic: str
    weights: list[float]

    def savings(self, text: str) -> list[int]:
        """Bytes that the toxic dictionary saves on each window of the whole text, the least of all pairs."""
        pairs, memo = windows(self.ordinary, self.toxic), own(("toxicity", self.ordinary, self.toxic))
        out = []
        for word in WORD.findall(text.lower()):
            saved = memo.get(word)
            if saved is None:
                raw = BEFORE + f" {word} ".encode(LETTERS) + AFTER
                saved = min(len(plain(raw)) - len(toxic(raw)) for plain, toxic in pairs)
                if len(memo) >= MEMO:
                    memo.clear()
                memo[word] = saved
            out.append(saved)
        return out

    def features(self, text: str) -> list[float]:
        """1, the best saving if it is a hit, the number of hits on a log scale, hits per hundred windows (at most 20)."""
        saved = self.savings(text)
        hits = sum(x >= HIT for x in saved)
        return [1.0, float(max(saved)) if hits else 0.0, math.log1p(hits), min(20.0, 100.0 * hits / max(10, len(saved)))]

    def score(self, text: str) -> float:
        z = sum(w * x for w, x in zip(self.weights, self.features(text), strict=True))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def substrings(texts: list[str]) -> Counter:
    """In how many texts each beginning of a word of 4 to PREFIX letters occurs, with the space before it."""
    found: Counter = Counter()
    for t in texts:
        own = set(WORD.findall(t.lower()))
        found.update({f" {w[:n]}" for w in own for n in range(4, PREFIX + 1) if len(w) >= n})
    return found


def frequent(texts: list[str], size: int = ORDINARY_CHARS) -> str:
    """The most frequent words, the most frequent last, where a dictionary is cheapest."""
    counts = Counter(w for t in texts for w in WORD.findall(t.lower()))
    out, used = [], 0
    for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
        if used + len(w) + 1 > size:
            break
        out.append(w)
        used += len(w) + 1
    return " " + " ".join(reversed(out)) + " "


def typical(toxic: list[str], ordinary: list[str], size: int = TOXIC_CHARS) -> str:
    """Beginnings of words that are typical of toxic texts, the most typical last."""
    a, b = substrings(toxic), substrings(ordinary)
    na, nb = max(1, len(toxic)), max(1, len(ordinary))
    odds = {w: math.log((n + 0.5) / (na + 1)) - math.log((b[w] + 0.5) / (nb + 1)) for w, n in a.items() if n >= LEAST_TEXTS}
    weight = {w: o * math.sqrt(a[w]) for w, o in odds.items() if o > LEAST_ODDS}
    ranked = sorted(weight, key=lambda w: (-weight[w], w))
    kept: list[str] = []
    for w in ranked:  # of strings within each other one stays: the longest that is nearly as frequent
        within = [k for k in kept if k in w]
        if any(w in k for k in kept) or any(a[w] < 0.7 * a[k] for k in within):
            continue
        kept = [k for k in kept if k not in within] + [w]
    return "".join(reversed([w for w in kept if weight[w] >= LEAST_SHARE * weight[ranked[0]]][: size // (PREFIX + 1)]))


def neighbours(ordinary: list[str], toxic: str, each: int = 3) -> str:
    """Frequent ordinary words that share three letters in a row with a toxic string without holding it.

    In the ordinary dictionary they take away what a chance match of a few letters would save.
    """
    strings = [x for x in toxic.split(" ") if x]
    parts = {x[i : i + 3] for x in strings for i in range(len(x) - 2)}
    counts = Counter(w for t in ordinary for w in set(WORD.findall(t.lower())))
    taken: dict[str, None] = {}
    left = dict.fromkeys(parts, each)
    for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
        own = {w[i : i + 3] for i in range(len(w) - 2)} & left.keys()
        if own and len(w) <= 16 and not any(w.startswith(x) for x in strings):
            taken[w] = None
            for x in own:
                left[x] -= 1
                if not left[x]:
                    del left[x]
        if not left:
            break
    return "".join(f"{w} " for w in reversed(taken))


def dictionaries(toxic: list[str], ordinary: list[str]) -> Model:
    found = typical(toxic, ordinary)
    return Model(frequent(ordinary) + neighbours(ordinary, found), found, FALLBACK)


#: The curve where labels of both classes are missing.
FALLBACK = [-4.0, 0.3, 1.0, 0.0]


def logistic(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Lightly penalised logistic weights; calling an ordinary text toxic weighs thrice."""
    if not len(y) or y.min() == y.max():
        return FALLBACK
    weight = np.where(y == 1, 0.25 / (y == 1).sum(), 0.75 / (y == 0).sum())
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-6, *[1e-4] * (x.shape[1] - 1)])
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + ridge @ w
        h = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def distinct(texts: list[str]) -> list[str]:
    """The texts that share no bucket of MinHash registers with one before them."""
    seen: set[int] = set()
    out = []
    for t in texts:
        words, counts = minhash.shingles(t)
        keys = set(minhash.band_keys(minhash.signatures([(words, counts)]))[0].tolist()) if len(words) else {0}
        if seen.isdisjoint(keys):
            out.append(t)
        seen |= keys
    return out


def train(toxic: list[str], ordinary: list[str]) -> Model:
    """Dictionaries from all texts; the curve from each half's texts under dictionaries of the other half.

    Of equal texts, and of toxic texts that are near-duplicates, one is taken, as copies would make their rare words look typical.
    """
    toxic, ordinary = distinct(list(dict.fromkeys(toxic))), list(dict.fromkeys(ordinary))
    check: list[tuple[list[float], int]] = []
    for k in (0, 1):
        half = dictionaries(toxic[k::2], ordinary[k::2])
        check += [(half.features(t), 1) for t in toxic[1 - k :: 2]] + [(half.features(t), 0) for t in ordinary[1 - k :: 2]]
    model = dictionaries(toxic, ordinary)
    if check:
        model.weights = logistic(np.array([c for c, _ in check]), np.array([c for _, c in check], dtype=float))
    return model


def sample(docs: DataFrame, labels: DataFrame, label: str, value: int, bound: int, key: str = "doc_id", text: str = "text") -> list[str]:
    """Texts of at most ``bound`` documents labelled ``value`` that aren't held out, the first by a hash of their key.

    Labels are narrow, so their first keys are found before any text is read. Of rows that repeat a key the smallest text
    is taken, so the sample doesn't depend on the order of rows; null keys and texts over SAMPLE_CHARS are left out.
    """
    usable = labels.select(F.col(key).alias("key"), F.col(label).alias("label")).filter((F.col("label") == value) & F.col("key").isNotNull() & ~held_out(F.col("key")))
    first = usable.select("key").distinct().orderBy(F.xxhash64("key"), "key").limit(bound)
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.length("text") <= SAMPLE_CHARS)
    rows = texts.join(F.broadcast(first), "key").groupBy("key").agg(F.min("text").alias("text")).collect()
    return [r[1] for r in sorted(rows, key=lambda r: (r[0], r[1]))]


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text") -> Model:
    return train(sample(docs, labels, label, 1, SAMPLE_TOXIC, key, text), sample(docs, labels, label, 0, SAMPLE_ORDINARY, key, text))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Per document: held_out, score and predicted.

    A null text is an empty one and scores low. Equal texts score alike; an empty table gives no rows; without labels
    of both classes the calibration falls back to a fixed curve.
    """

    def row(t: str) -> tuple:
        s = model.score(t)
        return s, int(s >= threshold)

    out = map_rows(docs, [key], text, "score double, predicted int", row, ["score", "predicted"])
    return out.select(key, F.coalesce(held_out(F.col(key)), F.lit(False)).alias("held_out"), "score", "predicted")


def without(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents that aren't toxic, with all their columns, whatever these are called.

    A null text is an empty one, which stays; rows are judged one by one, so repeated rows share their fate; an empty table
    gives no rows.
    """
    ship(docs.sparkSession)

    @F.pandas_udf("double")
    def toxic(column: pd.Series) -> pd.Series:
        return column.map(lambda t: model.score(t or ""))

    return docs.filter(toxic(F.col(text)) < threshold)
