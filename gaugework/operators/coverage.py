"""Coverage blocks against functions and lines, and change risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.functions import metrics as M
from gaugework.operators import evidence as E
from gaugework.operators import policy as P

DEFAULT_CRAP_LIMIT = 8.0

# The texts of findings.
UNMEASURED = "the coverage profile describes no statement of %s.%s, so it has no CRAP score"
RISKY = '%s.%s has a CRAP score of %.2f, outside the %s limit %.2f from policy "%s"'
UNCOVERED = 'statement coverage %.2f%% is below the %.2f%% limit from policy "%s"'
RUN_FAILED = "the test run failed, so the coverage profile is incomplete"


def per_file(blocks: DataFrame) -> DataFrame:
    """(file, statements, covered, percent); a file without statements has 0."""
    t = blocks.groupBy("file").agg(F.sum("num_stmt").alias("statements"), F.coalesce(F.sum(F.when(F.col("count") > 0, F.col("num_stmt"))), F.lit(0)).alias("covered"))
    return t.withColumn("percent", M.percentage(F.col("covered"), F.col("statements")))


def overall(files: DataFrame) -> DataFrame:
    """The ratio of the sums, not a mean of the files."""
    t = files.agg(F.coalesce(F.sum("statements"), F.lit(0)).alias("statements"), F.coalesce(F.sum("covered"), F.lit(0)).alias("covered"))
    return t.withColumn("percent", M.percentage(F.col("covered"), F.col("statements")))


def measured_files(blocks: DataFrame) -> DataFrame:
    return blocks.select("file").distinct()


def function_coverage(functions: DataFrame, blocks: DataFrame) -> DataFrame:
    """Functions with the coverage of the blocks that overlap their lines, ends included.

    A function of a file that the profile names is measured even without a statement, and then has 0; one of another
    file isn't measured. The join is by file, and the overlap is a condition on the pairs of one file.
    """
    b = blocks.select(F.col("file").alias("b_file"), F.col("start_line").alias("b_start"), F.col("end_line").alias("b_end"), "num_stmt", "count")
    overlap = (F.col("file") == F.col("b_file")) & (F.col("b_end") >= F.col("start_line")) & (F.col("b_start") <= F.col("end_line"))
    keys = functions.columns
    t = functions.join(b, overlap, "left").groupBy(*keys).agg(F.coalesce(F.sum("num_stmt"), F.lit(0)).alias("statements"), F.coalesce(F.sum(F.when(F.col("count") > 0, F.col("num_stmt"))), F.lit(0)).alias("covered"))
    known = measured_files(blocks).select(F.col("file").alias("m_file"))
    t = t.join(known, F.col("file") == F.col("m_file"), "left").withColumn("measured", F.col("m_file").isNotNull()).drop("m_file")
    return t.withColumn("percent", F.when(F.col("measured"), M.percentage(F.col("covered"), F.col("statements"))))


def covered_lines(points: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows of ``points`` (file, line) that lie in a block that ran."""
    b = blocks.filter("count > 0").select(F.col("file").alias("b_file"), F.col("start_line").alias("b_start"), F.col("end_line").alias("b_end"))
    return points.join(b, (F.col("file") == F.col("b_file")) & F.col("line").between(F.col("b_start"), F.col("b_end")), "left_semi")


def risk(functions: DataFrame, blocks: DataFrame) -> DataFrame:
    """Functions with their change-risk score, null where coverage isn't measured, and their place by file, name, line."""
    t = function_coverage(functions, blocks).withColumn("score", F.when(F.col("measured"), M.crap_score(F.col("complexity"), F.col("percent"))))
    placed = E.place(t, ["file", "name", "start_line", "end_line", "complexity", "package"])
    return placed.withColumn("identity", F.concat_ws(":", "file", "name", F.col("place").cast("string")))


def risk_findings(risks: DataFrame, policies: list[P.PathPolicy], default: float = DEFAULT_CRAP_LIMIT) -> DataFrame:
    """Functions over the limit of their policy, or over the default, and functions that aren't measured."""
    unmeasured = risks.filter(~F.col("measured"))
    out = E.finding(unmeasured, F.concat(F.lit("crap:unmeasured:"), "identity"), "indeterminate-crap-score", F.col("file"), "warning", F.format_string(UNMEASURED, "package", "name"))
    rows = P.resolve(risks.filter("measured").select("identity", F.col("file").alias("path"), F.lit("crap.score").alias("name"), F.col("name").alias("fn"), "package", F.col("score").alias("value")), policies)
    fallback = F.struct(F.lit("default").alias("policy"), F.lit("maximum").alias("comparison"), F.lit(default).alias("value"), F.lit("error").alias("severity"))
    over = P.violations(rows.withColumn("threshold", F.when(F.size("candidates") == 0, fallback).otherwise(F.col("threshold"))))
    t = F.col("threshold")
    message = F.format_string(RISKY, "package", "fn", "value", t["comparison"], t["value"], t["policy"])
    return out.unionByName(E.finding(over, F.concat_ws(":", F.lit("crap"), t["policy"], "identity"), "maximum-crap-score", F.col("path"), t["severity"], message, F.col("value"), t["value"]))


def risk_metrics(risks: DataFrame) -> DataFrame:
    ident = lambda kind: F.concat(F.lit(f"crap:{kind}:"), "identity")
    out = E.metric(risks, ident("complexity"), F.col("file"), "complexity.cyclomatic", F.col("complexity"))
    known = risks.filter("measured")
    return out.unionByName(E.metric(known, ident("coverage"), F.col("file"), "coverage.percent", F.col("percent"), "percent")).unionByName(E.metric(known, ident("score"), F.col("file"), "crap.score", F.col("score")))


def coverage_findings(files: DataFrame, policies: list[P.PathPolicy], run_failed: bool = False) -> DataFrame:
    """Files under the limit of their policy, and the failure of the test run if it failed."""
    rows = P.violations(P.resolve(files.select(F.col("file").alias("path"), F.lit("coverage.percent").alias("name"), F.col("percent").alias("value")), policies))
    t = F.col("threshold")
    message = F.format_string(UNCOVERED, "value", t["value"], t["policy"])
    out = E.finding(rows, F.concat_ws(":", F.lit("coverage"), t["policy"], "path"), "minimum-path-coverage", F.col("path"), t["severity"], message, F.col("value"), t["value"])
    if run_failed:
        one = files.sparkSession.range(1)
        out = out.unionByName(E.finding(one, F.lit("coverage:go-test-run"), "go-test-run", F.lit(""), "error", F.lit(RUN_FAILED)))
    return out


def coverage_metrics(files: DataFrame) -> DataFrame:
    out = E.metric(files, F.concat(F.lit("coverage:"), "file"), F.col("file"), "coverage.percent", F.col("percent"), "percent")
    return out.unionByName(E.metric(overall(files), F.lit("coverage:overall"), F.lit(""), "coverage.percent", F.col("percent"), "percent"))


def complexity(nodes: DataFrame, keys: list[str], kind: Column) -> DataFrame:
    """Cyclomatic complexity from syntax nodes: one, and one for each branch, loop, case and short-circuit operator."""
    return nodes.groupBy(*keys).agg((F.lit(1) + F.count_if(kind.isin("if", "for", "range", "case", "comm", "&&", "||"))).alias("complexity"))
