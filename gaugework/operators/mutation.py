"""Mutation sites: what can be changed, where it lies, what is covered, and what tests let live."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugework.operators import coverage as C
from gaugework.operators import evidence as E

# Token, what it becomes, category.
MUTANTS = [
    ("+", "-", "arithmetic"), ("-", "+", "arithmetic"), ("*", "/", "arithmetic"),
    (">", ">=", "comparison"), (">=", ">", "comparison"), ("<", "<=", "comparison"), ("<=", "<", "comparison"),
    ("==", "!=", "equality"), ("!=", "==", "equality"),
    ("&&", "||", "logical"), ("||", "&&", "logical"),
    ("0", "1", "constant"), ("1", "0", "constant"),
    ("true", "false", "boolean"), ("false", "true", "boolean"),
]


def mutants(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MUTANTS, "original string, mutant string, category string")


def sites(tokens: DataFrame) -> DataFrame:
    """Tokens (file, line, column, original) that can change, with mutant, category and index by place in their file."""
    m = F.broadcast(mutants(tokens.sparkSession)).toDF("m_original", "mutant", "category")  # 15 rows
    found = tokens.join(m, F.col("original") == F.col("m_original")).drop("m_original")
    return found.withColumn("index", (F.row_number().over(Window.partitionBy("file").orderBy("line", "column")) - 1).cast("bigint"))


def with_function(found: DataFrame, functions: DataFrame) -> DataFrame:
    """Sites with the first function, in order of declaration, that holds their line; empty for none."""
    f = functions.select(F.col("file").alias("f_file"), "start_line", "end_line", F.col("name").alias("f_name"))
    holds = (F.col("file") == F.col("f_file")) & F.col("line").between(F.col("start_line"), F.col("end_line"))
    keys = found.columns
    per = found.join(f, holds, "left").groupBy(*keys).agg(F.min_by("f_name", F.struct("start_line", "end_line", "f_name")).alias("function"))
    return per.withColumn("function", F.coalesce("function", F.lit("")))


def with_coverage(found: DataFrame, blocks: DataFrame) -> DataFrame:
    """Sites with ``covered``: their line ran, or they lie outside of every function."""
    points = found.select("file", "line").distinct()
    ran = C.covered_lines(points, blocks).select(F.col("file").alias("r_file"), F.col("line").alias("r_line"))
    out = found.join(ran, (F.col("file") == F.col("r_file")) & (F.col("line") == F.col("r_line")), "left")
    return out.withColumn("covered", (F.col("function") == "") | F.col("r_file").isNotNull()).drop("r_file", "r_line")


def totals(found: DataFrame, executed: bool = False) -> DataFrame:
    """Per file: total, covered, uncovered; after a run (column ``killed``) also killed, survived and the killed share.

    A mutant that ran out of time counts as killed. Without a tested mutant the share is null.
    """
    n = lambda c: F.count_if(c)
    base = [F.count("*").alias("total"), n(F.col("covered")).alias("covered"), n(~F.col("covered")).alias("uncovered")]
    if not executed:
        return found.groupBy("file").agg(*base)
    t = found.groupBy("file").agg(*base, n(F.col("covered") & F.col("killed")).alias("killed"), n(F.col("covered") & ~F.col("killed")).alias("survived"))
    tested = F.col("killed") + F.col("survived")
    return t.withColumn("killed_percent", F.when(tested > 0, F.col("killed") * 100.0 / F.when(tested > 0, tested)))


def described(found: DataFrame) -> DataFrame:
    return found.withColumn("description", F.concat_ws(" -> ", "original", "mutant"))


def applied(text: Column, start: Column, original: Column, mutant: Column) -> Column:
    """``text`` with ``original`` at the 0-based character ``start`` replaced; null if it doesn't stand there."""
    n = F.length(original)
    return F.when(F.substring(text, start + 1, n) == original, F.concat(F.substring(text, F.lit(1), start), mutant, F.substring(text, start + n + 1, F.length(text))))


def survivor_findings(found: DataFrame) -> DataFrame:
    alive = described(found.filter(F.col("covered") & ~F.col("killed")))
    ident = F.concat_ws(":", F.lit("mutation:survivor"), "file", F.col("line").cast("string"), F.col("index").cast("string"))
    return E.finding(alive, ident, "surviving-mutation", F.col("file"), "notice", F.format_string("%s line %d changes %s and the tests still pass", "function", "line", "description"))


def threshold_findings(per_file: DataFrame, most_uncovered: int | None = None, most_survived: int | None = None) -> DataFrame:
    out = None
    for kind, column, limit, text in (("uncovered", "uncovered", most_uncovered, "%d mutation sites are uncovered; the configured limit is %d"), ("survived", "survived", most_survived, "%d mutations survived; the configured limit is %d")):
        if limit is None:
            continue
        rule = {"uncovered": "maximum-uncovered-mutations", "survived": "maximum-surviving-mutations"}[kind]
        rows = per_file.filter(F.col(column) > limit)
        found = E.finding(rows, F.concat_ws(":", F.lit(f"mutation:{kind}"), "file"), rule, F.col("file"), "error", F.format_string(text, column, F.lit(limit)), F.col(column), F.lit(limit))
        out = found if out is None else out.unionByName(found)
    return out
