"""Coverage profiles in the text form ``file:line.column,line.column statements count``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINE = r"^(.+):(\d+)\.(\d+),(\d+)\.(\d+) (\d+) (\d+)$"


def blocks(lines: DataFrame, module: str, column: str = "value") -> DataFrame:
    """(file, start_line, end_line, num_stmt, count) of the profile's own files, paths below the module.

    The mode line and lines of another form are left out, and so are blocks of files outside of the module.
    """
    got = lambda k: F.regexp_extract(F.replace(column, F.lit("\\"), F.lit("/")), LINE, k)
    rows = lines.filter(F.col(column).rlike(LINE)).select(got(1).alias("entry"), *(got(k).cast("bigint").alias(n) for k, n in ((2, "start_line"), (4, "end_line"), (6, "num_stmt"), (7, "count"))))
    prefix = module.rstrip("/") + "/"
    own = rows.filter(F.col("entry").startswith(prefix)).withColumn("file", F.substring("entry", F.lit(len(prefix) + 1), F.length("entry")))
    return own.filter(~F.col("file").rlike(r"(^|/)\.\.(/|$)") & ~F.col("file").startswith("/")).select("file", "start_line", "end_line", "num_stmt", "count")


def read(spark: SparkSession, path: str, module: str) -> DataFrame:
    return blocks(spark.read.text(path), module)
