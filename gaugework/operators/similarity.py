"""Set-similarity self-join: all pairs of sets whose Jaccard similarity reaches a threshold, exactly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.errors import ValidationError
from gaugework.functions.checkpoint import cut
from gaugework.operators import evidence as E

# Fixed value: the text of a finding.
RESEMBLES = "%s:%d-%d resembles %s:%d-%d with %.3f similarity"


def admitted(functions: DataFrame, least_lines: int, least_nodes: int) -> DataFrame:
    """Functions with a body of enough lines and syntax nodes; filtered before fingerprints are made."""
    return functions.filter(F.col("has_body") & (F.col("end_line") - F.col("start_line") + 1 >= least_lines) & (F.col("nodes") >= least_nodes))


def pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """(left, right, shared, score) for all pairs left < right of ``sets`` (ord, fingerprint) with score >= threshold.

    Prefix filter: with the elements of a set in order of their frequency, two similar sets share one of the rarest few
    of each, so only these are joined; what they give are the candidates, whose exact overlap is counted on whole sets.
    A threshold of 0 would pair everything and is refused.
    """
    if not 0 < threshold <= 1:
        raise ValidationError("the similarity must lie above 0 and not above 1")
    s = cut(sets.select("ord", "fingerprint").filter("ord is not null and fingerprint is not null").distinct())
    frequency = s.groupBy("fingerprint").agg(F.count("*").alias("n")).withColumnRenamed("fingerprint", "f")
    ranked = s.join(frequency, F.col("fingerprint") == F.col("f")).drop("f")
    whole = ranked.groupBy("ord").agg(F.sort_array(F.collect_list(F.struct("n", "fingerprint"))).alias("ranked")).withColumn("size", F.size("ranked"))
    keep = F.col("size") - F.ceil(F.col("size") * threshold - 1e-9) + 1
    whole = cut(whole.select("ord", "size", F.col("ranked.fingerprint").alias("items"), F.slice("ranked.fingerprint", F.lit(1), keep.cast("int")).alias("prefix")))
    rare = whole.select("ord", "size", F.explode("prefix").alias("item"))
    a, b = rare.toDF("left", "ls", "li"), rare.toDF("right", "rs", "ri")
    lengths = (F.col("ls") >= F.col("rs") * threshold - 1e-9) & (F.col("rs") >= F.col("ls") * threshold - 1e-9)
    candidates = a.join(b, (F.col("li") == F.col("ri")) & (F.col("left") < F.col("right")) & lengths).select("left", "right").distinct()
    first, second = whole.select("ord", "items").toDF("lo", "litems"), whole.select("ord", "items").toDF("ro", "ritems")
    shared = F.size(F.array_intersect("litems", "ritems"))
    both = candidates.join(first, F.col("left") == F.col("lo")).join(second, F.col("right") == F.col("ro"))
    scored = both.select("left", "right", shared.cast("bigint").alias("shared"), (F.size("litems") + F.size("ritems")).alias("both"))
    scored = scored.withColumn("score", F.col("shared") / (F.col("both") - F.col("shared"))).drop("both")
    return scored.filter(F.col("score") >= threshold)


def located(found: DataFrame, places: DataFrame) -> DataFrame:
    """Pairs with file and lines of both ends; sort by score descending, then by both places."""
    l = places.select(F.col("ord").alias("lo"), *(F.col(c).alias(f"left_{c}") for c in ("file", "start_line", "end_line")))  # noqa: E741
    r = places.select(F.col("ord").alias("ro"), *(F.col(c).alias(f"right_{c}") for c in ("file", "start_line", "end_line")))
    return found.join(l, F.col("left") == F.col("lo")).join(r, F.col("right") == F.col("ro")).drop("lo", "ro")


def order() -> list:
    return [F.col("score").desc(), "left_file", "left_start_line", "right_file", "right_start_line"]


def over_budget(found: DataFrame, budget: int) -> DataFrame:
    """The pairs beyond a budget that forgives the least similar ones, with their rank from 1."""
    placed = cut(E.place(found, order()).withColumn("rank", F.col("place") + 1).drop("place"))
    n = placed.agg(F.count("*").alias("all"))
    return placed.crossJoin(F.broadcast(n)).filter(F.col("rank") <= F.col("all") - budget).drop("all")  # n is one row


def duplication_findings(found: DataFrame, budget: int, threshold: float) -> DataFrame:
    rows = over_budget(found, budget)
    ident = F.concat_ws(":", F.lit("duplication"), "left_file", F.col("left_start_line").cast("string"), "right_file", F.col("right_start_line").cast("string"))
    message = F.format_string(RESEMBLES, "left_file", "left_start_line", "left_end_line", "right_file", "right_start_line", "right_end_line", "score")
    return E.finding(rows, ident, "structural-duplication", F.col("left_file"), "error", message, F.col("score"), F.lit(threshold))


def duplication_metrics(found: DataFrame) -> DataFrame:
    ident = F.concat_ws(":", F.lit("duplication:similarity"), "left_file", F.col("left_start_line").cast("string"), "right_file", F.col("right_start_line").cast("string"))
    n = found.agg(F.count("*").alias("n"))
    return E.metric(n, F.lit("duplication:candidates"), F.lit(""), "duplication.candidates", F.col("n"), "count").unionByName(E.metric(found, ident, F.col("left_file"), "duplication.similarity", F.col("score")))
