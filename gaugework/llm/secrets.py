"""Secret scans: fixed patterns, and character Markov models that tell random strings from ordinary identifiers.

Two order-1 character models are trained on labelled samples: random strings (key-like strings of several alphabets,
drawn from a seeded generator) and ordinary identifiers (names composed in the usual styles of programming words and of
words that the corpus itself holds, drawn by a hash). A candidate token is a secret if its mean log-likelihood ratio
passes a threshold set on the samples; tokens without a digit, which ordinary text is full of, have a threshold of their
own that none of the ordinary sample passes. The pattern spans stand whatever the models say.
"""

from __future__ import annotations

import hashlib
import json
import math
import random
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.functions.shipping import ship
from gaugework.llm.common import map_rows
from gaugework.llm.memo import own

# The base patterns.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run of [0-9a-f]+ is as long as it can be, so shorter ones fail as a whole
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Bounds of the sample of documents, and of their distinct words, that train the model of ordinary identifiers.
SAMPLE_DOCUMENTS, SAMPLE_WORDS = 400, 20_000
SAMPLES = 6000

WORDS = """get set user name account config value index count total list item file path read write open close server
client request response handler service manager factory builder controller model view data base table column row key
token session cache store load save update delete create find search filter sort order page size limit offset time date
version build test debug error message event queue worker thread process node edge graph tree map array string number
integer float double boolean object class method function module package import export public private static final
abstract interface implementation default option parameter argument result status code type kind state""".split()


@dataclass
class Markov:
    """Log-likelihood ratio of random over ordinary for each pair of characters, and the thresholds of its mean for tokens with and without digits."""

    ratios: dict[str, float]
    threshold: float
    plain: float = 1.0

    def score(self, token: str) -> float:
        """Mean log-likelihood ratio; below two characters there is nothing to compare."""
        if len(token) < 2:
            return -math.inf
        get = self.ratios.get
        return sum(get(token[i : i + 2], 0.0) for i in range(len(token) - 1)) / (len(token) - 1)

    def is_random(self, token: str) -> bool:
        if not any(c.isalpha() for c in token):
            return False  # numbers, rules and dates
        return self.score(token) > (self.threshold if any(c.isdigit() for c in token) else self.plain)


def random_strings(rng: random.Random, n: int) -> list[str]:
    alphabets = ["0123456789abcdef", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", ALPHABET[:62], ALPHABET[:64]]
    return ["".join(rng.choices(alphabets[k % len(alphabets)], k=rng.randint(20, 64))) for k in range(n)]


def identifiers(rng: random.Random, n: int, words: list[str]) -> list[str]:
    """Ordinary names of 2 to 6 words: snake, kebab, camel and path styles, some with a number."""
    out = []
    for k in range(n):
        parts = rng.choices(words, k=rng.randint(2, 6))
        joined = ("_".join(parts), "-".join(parts), parts[0] + "".join(w.capitalize() for w in parts[1:]), "/".join(parts), "_".join(parts).upper(), "".join(parts))[k % 6]
        out.append(joined + (str(rng.randint(0, 2030)) if k % 3 == 0 else ""))
    return out


def train(positive: list[str], negative: list[str], keep: float = 0.995) -> Markov:
    """Fit both models with add-half smoothing.

    The threshold lets at most 1 - ``keep`` of the ordinary sample pass; that of tokens without digits none, with a margin.
    """

    def logs(sample: list[str]) -> dict[str, float]:
        pairs: dict[str, float] = {}
        totals: dict[str, float] = {}
        for token in sample:
            for a, b in zip(token, token[1:], strict=False):
                pairs[a + b] = pairs.get(a + b, 0) + 1
                totals[a] = totals.get(a, 0) + 1
        return {a + b: math.log((pairs.get(a + b, 0) + 0.5) / (totals.get(a, 0) + 0.5 * len(ALPHABET))) for a in ALPHABET for b in ALPHABET}

    random_logs, ordinary = logs(positive), logs(negative)
    model = Markov({k: random_logs[k] - ordinary[k] for k in random_logs}, 0.0)
    scores = sorted(model.score(t) for t in negative if len(t) > 1)
    model.threshold = max(0.35, scores[min(len(scores) - 1, int(keep * len(scores)))] if scores else 0.0)
    letters = [model.score(t) for t in negative if len(t) >= 12 and not any(c.isdigit() for c in t)]
    model.plain = max(model.threshold, max(letters, default=0.0) + 0.1)
    return model


def corpus_words(docs: DataFrame, key: str, text: str, documents: int = SAMPLE_DOCUMENTS, words: int = SAMPLE_WORDS) -> list[str]:
    """Distinct words of letters of at most ``documents`` documents, both the first by a hash, of the key and of the word."""
    ids = [r[0] for r in docs.select(key).filter(F.col(key).isNotNull()).distinct().orderBy(F.xxhash64(key), key).limit(documents).collect()]
    found = docs.filter(F.col(key).isin(ids)).select(F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit("(\\b[A-Za-z]{2,40}\\b)")))).alias("word"))
    return sorted(r[0] for r in found.distinct().orderBy(F.xxhash64("word"), "word").limit(words).collect())


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Markov:
    rng = random.Random(20)
    words = WORDS + corpus_words(docs, key, text)
    return train(random_strings(rng, SAMPLES), identifiers(rng, SAMPLES, words) + identifiers(rng, SAMPLES // 2, WORDS))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Pattern spans by start, then kind as listed; offsets are code points, the end is exclusive."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(s, e, KINDS[k]) for s, k, e in sorted(found)]


def random_spans(text: str, model: Markov, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Tokens that the models call random and that don't lie within a pattern span. Both lists rise, so one pass compares them."""
    out, at, covered = [], 0, -1
    for m in CANDIDATE.finditer(text):
        while at < len(base) and base[at][0] <= m.start():
            covered = max(covered, base[at][1])
            at += 1
        if m.end() > covered and model.is_random(m.group()):
            out.append((m.start(), m.end(), "random"))
    return out


def spans(text: str, model: Markov) -> list[tuple[int, int, str]]:
    base = base_spans(text)
    return sorted(base + random_spans(text, model, base), key=lambda x: (x[0], KINDS.index(x[2])))


def redact(text: str, model: Markov) -> str:
    """The text with the union of all spans replaced; of a pattern with a name, the name stays."""
    holes: list[tuple[int, int, str]] = []
    for s, e, kind in spans(text, model):
        if kind == "assign":
            s = ASSIGN.match(text, s).start(2)
        holes.append((s, e, kind))
    out, at = [], 0
    for s, e, kind in sorted(holes):
        if e <= at:
            continue
        if s >= at:
            out += [text[at:s], f"[{kind} removed]"]
        at = e
    return "".join([*out, text[at:]])


def join(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{s}:{e}" for s, e, kind in found)


NAMES = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"]
SCHEMA = "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_random bigint"


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", model: Markov | None = None) -> DataFrame:
    """Secrets of every document: counts by kind, a digest of the pattern spans, all spans, and the count of model spans.

    A null or empty text has none, with the digest of an empty string; repeated rows give repeated results; an empty
    table gives no rows and trains on the programming words alone.
    """
    fitted = model or fit(docs, key, text)

    def row(t: str) -> tuple:
        base = base_spans(t)
        more = random_spans(t, fitted, base)
        kinds = [k for _, _, k in base]
        whole = sorted(base + more, key=lambda x: (x[0], KINDS.index(x[2])))
        return kinds.count("assign"), kinds.count("access"), kinds.count("hex"), hashlib.sha256(join(base).encode()).hexdigest(), join(whole), len(more)

    return map_rows(docs, [key], text, SCHEMA, row, NAMES)


def redacted(docs: DataFrame, key: str = "doc_id", text: str = "text", model: Markov | None = None) -> DataFrame:
    """``docs`` with the secrets in ``text`` replaced; null stays null, all other columns stay as they are."""
    ship(docs.sparkSession)
    fitted = model or fit(docs, key, text)

    @F.pandas_udf("string")
    def clean(column: pd.Series) -> pd.Series:
        own("secrets")
        return column.map(lambda t: None if t is None else redact(t, fitted))

    return docs.withColumn(text, clean(F.col(text)))


def dump(model: Markov) -> str:
    return json.dumps({"threshold": model.threshold, "plain": model.plain, "ratios": model.ratios})
