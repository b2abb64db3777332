"""Quality classification by a sparse rule ensemble that runs as Spark column expressions.

Text statistics are Spark columns. On a bounded sample of labelled documents small trees are grown on bootstrap draws;
every path from a root to a node is a rule, a conjunction of comparisons of statistics. A lasso logistic regression over
the distinct rules keeps a few of them, and these are compiled back into one column expression, so scoring is a scan
without Python.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.llm.common import carried, field, held_out, restored

#: Bounds of the training sample: labelled documents of each class.
SAMPLE_LOW, SAMPLE_HIGH = 3000, 5000
TREES, DEPTH, LEAST_LEAF = 40, 3, 8
PENALTY = 1e-3
SYMBOLS = "%&$#*@^~=<>{}[]\\_`"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÉÈÊÀÇÑÓÍÁÚ"

Condition = tuple[int, bool, float]  # statistic, whether it lies above the bound, bound
Rule = tuple[Condition, ...]


def with_statistics(rows: DataFrame, text: Column, name: str = "stats") -> DataFrame:
    """``rows`` and a struct of the statistics of the whole text. A null text is an empty one, all of whose statistics are 0.

    ``rows`` has no columns n, words or ``name``; tables of others come as carried rows. Length and words are computed
    once, in a projection. The struct comes out of a generator over an array of one: a filter on the score isn't pushed
    below a generator, where every rule would compute its statistics anew.
    """
    t = F.coalesce(text.cast("string"), F.lit(""))
    base = rows.select("*", F.length(t).cast("double").alias("n"), F.split(F.trim(F.translate(t, "\n\t", "  ")), " +").alias("words"))
    n, size = F.col("n"), F.size("words").cast("double")
    least = F.greatest(n, F.lit(1.0))
    some = F.when(n > 0, 1.0).otherwise(0.0)
    without = lambda letters: (n - F.length(F.translate(t, letters, ""))) / least
    stats = {
        "chars": n,
        "words": size * some,
        "distinct_words": F.size(F.array_distinct("words")) / size * some,
        "word_length": n / size,
        "capitals": without(CAPITALS),
        "symbols": without(SYMBOLS),
        "shouts": (n - F.length(F.replace(t, F.lit("!")))) / least,
        "bars": (n - F.length(F.replace(t, F.lit("|")))) / least,
        "digits": without("0123456789"),
        "stops": without(".,;:?"),
        "lines": (n - F.length(F.replace(t, F.lit("\n")))) / least,
    }
    return base.select("*", F.explode(F.array(F.struct(*(stats[k].alias(k) for k in NAMES)))).alias(name)).drop("n", "words")


NAMES = ["chars", "words", "distinct_words", "word_length", "capitals", "symbols", "shouts", "bars", "digits", "stops", "lines"]


@dataclass
class Model:
    rules: list[tuple[Rule, float]]
    intercept: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.intercept + sum((w * holds(r, x) for r, w in self.rules), np.zeros(len(x)))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def column(self, names: list[str]) -> Column:
        """The score as an expression over the columns that hold the statistics."""
        z = F.lit(float(self.intercept))
        for rule, weight in self.rules:
            held = F.lit(True)
            for k, above, bound in rule:
                held = held & (F.col(names[k]) > bound if above else F.col(names[k]) <= bound)
            z = z + F.when(held, float(weight)).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for k, above, bound in rule:
        out &= x[:, k] > bound if above else x[:, k] <= bound
    return out


def best_split(x: np.ndarray, y: np.ndarray, columns: np.ndarray) -> tuple[int, float] | None:
    """The statistic and bound that lower the Gini impurity most."""
    n, total, found, most = len(y), y.sum(), None, 1e-9
    for k in columns:
        order = np.argsort(x[:, k], kind="stable")
        v, ones = x[order, k], np.cumsum(y[order])
        at = np.nonzero(v[1:] > v[:-1])[0]
        at = at[(at + 1 >= LEAST_LEAF) & (n - at - 1 >= LEAST_LEAF)]
        if not len(at):
            continue
        left, a = at + 1.0, ones[at]
        gain = a * a / left + (left - a) ** 2 / left + (total - a) ** 2 / (n - left) + (n - left - total + a) ** 2 / (n - left) - (total**2 + (n - total) ** 2) / n
        i = int(np.argmax(gain))
        if gain[i] > most:
            most, found = gain[i], (int(k), float((v[at[i]] + v[at[i] + 1]) / 2))
    return found


def paths(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, path: Rule = ()) -> list[Rule]:
    """Every path of a tree grown on the sample, as a rule."""
    out = [path] if path else []
    if depth and len(y) >= 2 * LEAST_LEAF and 0 < y.sum() < len(y):
        split = best_split(x, y, rng.choice(x.shape[1], size=max(2, (2 * x.shape[1]) // 3), replace=False))
        if split:
            k, bound = split
            above = x[:, k] > bound
            out += paths(x[~above], y[~above], rng, depth - 1, (*path, (k, False, bound)))
            out += paths(x[above], y[above], rng, depth - 1, (*path, (k, True, bound)))
    return out


def lasso(a: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, rounds: int = 1500) -> tuple[np.ndarray, float]:
    """Logistic regression with an L1 penalty by accelerated proximal gradient steps; the intercept is free."""
    w, b = np.zeros(a.shape[1]), math.log((weight @ y + 1e-3) / (weight @ (1 - y) + 1e-3))
    v, c, t = w.copy(), b, 1.0
    step = 4.0 / (1.0 + float(np.linalg.norm(a * np.sqrt(weight)[:, None], 2)) ** 2)
    for _ in range(rounds):
        r = weight * (1 / (1 + np.exp(-np.clip(a @ v + c, -30, 30))) - y)
        new = v - step * (a.T @ r)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        free = c - step * r.sum()
        t, old = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        v, c = new + (old - 1) / t * (new - w), free + (old - 1) / t * (free - b)
        done = np.abs(new - w).max(initial=0.0) < 1e-6
        w, b = new, free
        if done:
            break
    return w, float(b)


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, seed: int = 6) -> Model:
    """Fit the ensemble; without both classes the score is the same for all: the share of class 1, or 1/2 without rows."""
    if not len(y) or y.min() == y.max():
        return Model([], 0.0 if not len(y) else 3.0 if y[0] else -3.0)
    weight = np.full(len(y), 1.0) if weight is None else weight
    weight = weight / weight.sum()
    rng = np.random.default_rng(seed)
    found: dict[Rule, None] = {}
    for _ in range(TREES):
        draw = rng.integers(0, len(y), len(y))
        for rule in paths(x[draw], y[draw].astype(float), rng, DEPTH):
            found.setdefault(tuple(sorted(rule)))
    kept: dict[bytes, Rule] = {}
    for rule in sorted(found, key=lambda r: (len(r), r)):
        held = holds(rule, x)
        if 0 < held.sum() < len(held):
            kept.setdefault(held.tobytes(), rule)
    rules = list(kept.values())
    if not rules:
        return Model([], math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    a = np.stack([holds(r, x) for r in rules], axis=1).astype(float)
    w, b = lasso(a, y.astype(float), weight, PENALTY)
    return Model([(r, float(v)) for r, v in zip(rules, w, strict=True) if abs(v) > 1e-4], b)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text") -> Model:
    """Train on at most SAMPLE_LOW and SAMPLE_HIGH labelled documents that aren't held out, the first by a hash of their key.

    Each class weighs as it does among all labels. Of rows that repeat a key the one with the smallest statistics is
    taken, so that the sample doesn't depend on the order of rows. Null keys and labels, and labels other than 0 and 1,
    are left out.
    """
    usable = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & F.col("key").isNotNull()).filter(~held_out(F.col("key")))
    counts = {r["label"]: r["count"] for r in usable.groupBy("label").count().collect()}
    first = None
    for value, bound in ((0, SAMPLE_LOW), (1, SAMPLE_HIGH)):
        part = usable.filter(F.col("label") == value).distinct().orderBy(F.xxhash64("key"), "key").limit(bound)
        first = part if first is None else first.unionByName(part)
    sampled = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(first), "key")
    stats = with_statistics(sampled, F.col("text")).groupBy("key", "label").agg(F.min("stats").alias("stats"))
    rows = stats.select("label", *(F.col("stats").getField(n) for n in NAMES)).collect()
    data = np.array(sorted(tuple(r) for r in rows), dtype=float).reshape(len(rows), 1 + len(NAMES))
    y = data[:, 0].astype(int)
    seen = np.bincount(y, minlength=2)
    weight = np.array([counts.get(v, 0) / max(1, seen[v]) for v in y], dtype=float)
    return train(data[:, 1:], y, weight if len(y) else None)


def with_score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The carried rows of ``docs`` and their score."""
    return with_statistics(carried(docs), field(text)).select("row", model.column([f"stats.{n}" for n in NAMES]).alias("score"))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """Per document: held_out, score, predicted.

    A null or empty text has statistics 0 and the score of these. Equal texts score alike, repeated rows stay; an empty
    table gives no rows. Columns other than key and text are dropped before, so their names can't clash.
    """
    scored = with_score(docs.select(key, text), model, text).select(field(key).alias(key), "score")
    return scored.select(key, F.coalesce(held_out(F.col(key)), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def good(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """The documents that the classifier doesn't reject, with all their columns, whatever these are called.

    A null or empty text has the score of statistics 0; rows are judged one by one, so repeated rows share their fate; an
    empty table gives no rows.
    """
    return restored(with_score(docs, model, text).filter(F.col("score") >= threshold), docs.columns)
