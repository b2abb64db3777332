"""Lines of code: aggregates at repository, module, package and file level, function statistics, overviews."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.functions import metrics as M
from gaugework.operators.query import Selection, select_rows, source_kind

COUNTERS = {
    "files:total": ("files.total", "count"), "files:test": ("files.test", "count"), "files:generated": ("files.generated", "count"), "lines:total": ("lines.total", "lines"), "lines:code": ("lines.code", "lines"),
    "lines:comment": ("lines.comment", "lines"), "lines:blank": ("lines.blank", "lines"), "lines:test": ("lines.test", "lines"), "lines:generated": ("lines.generated", "lines"), "functions:total": ("functions.total", "count"),
    "functions:test": ("functions.test", "count"), "functions:generated": ("functions.generated", "count"), "lines:generated:percent": ("lines.generated.percent", "percent"),
}
STATISTICS = {"function-lines:average": ("function-lines.average", "lines"), "function-lines:p95": ("function-lines.p95", "lines"), "function-lines:maximum": ("function-lines.maximum", "lines")}
SCOPES = ("repository", "module", "package", "file")


def column(key: str) -> str:
    return key.replace(":", "_").replace("-", "_")


def _levels() -> list[tuple[str, list[str]]]:
    return [("repository", []), ("module", ["module_dir", "module_path"]), ("package", ["package_dir"]), ("file", ["path"])]


def aggregates(files: DataFrame, functions: DataFrame) -> DataFrame:
    """(scope, identity, path, 13 counters, 3 statistics) of each repository, module, package and file.

    Functions are counted per file first, so files and functions meet once, file by file. The percentile is exact: it
    keeps a count for each distinct number of lines, which are few, and merges these counts before the shuffle.
    """
    per_file = functions.groupBy(F.col("path").alias("f_path")).agg(F.count("*").alias("n_functions"))
    base = files.join(per_file, F.col("path") == F.col("f_path"), "left").drop("f_path").na.fill(0, ["n_functions"])
    own = functions.select(F.col("path").alias("f_path"), F.col("code").alias("f_code"))
    lines = files.select("path", "module_dir", "module_path", "package_dir").join(own, F.col("path") == F.col("f_path"))
    out = []
    for scope, keys in _levels():
        counted = base.groupBy(*keys).agg(*counters())
        stats = lines.groupBy(*keys).agg(F.avg("f_code").alias("function_lines_average"), F.expr("percentile_disc(0.95) within group (order by f_code)").cast("bigint").alias("function_lines_p95"), F.max("f_code").alias("function_lines_maximum"))
        renamed = stats.select(*(F.col(k).alias(f"s_{k}") for k in keys), "function_lines_average", "function_lines_p95", "function_lines_maximum")
        joined = counted.join(renamed, reduce(lambda a, b: a & b, (F.col(k) == F.col(f"s_{k}") for k in keys)), "left") if keys else counted.crossJoin(renamed)
        identity = {"repository": F.lit("repository"), "module": F.concat_ws("@", "module_dir", "module_path") if keys else None, "package": F.col(keys[0]) if keys else None, "file": F.col(keys[0]) if keys else None}[scope]
        path = {"repository": F.lit(""), "module": F.when(F.col("module_dir") == ".", "go.mod").otherwise(F.concat("module_dir", F.lit("/go.mod"))) if scope == "module" else None, "package": identity, "file": identity}[scope]
        out.append(joined.select(F.lit(scope).alias("scope"), identity.alias("identity"), path.alias("path"), *(column(k) for k in COUNTERS), F.coalesce("function_lines_average", F.lit(0.0)).alias("function_lines_average"), F.coalesce("function_lines_p95", F.lit(0)).cast("bigint").alias("function_lines_p95"), F.coalesce("function_lines_maximum", F.lit(0)).cast("bigint").alias("function_lines_maximum")))
    return reduce(DataFrame.unionByName, out)


def counters() -> list[Column]:
    test, gen = F.col("test"), F.col("generated")
    add = lambda c, cond=None: F.coalesce(F.sum(c if cond is None else F.when(cond, c)), F.lit(0))
    return [
        F.count("*").alias("files_total"), F.count_if(test).alias("files_test"), F.count_if(gen).alias("files_generated"), add(F.col("total")).alias("lines_total"), add(F.col("code")).alias("lines_code"),
        add(F.col("comment")).alias("lines_comment"), add(F.col("blank")).alias("lines_blank"), add(F.col("total"), test).alias("lines_test"), add(F.col("total"), gen).alias("lines_generated"),
        add(F.col("n_functions")).alias("functions_total"), add(F.col("n_functions"), test).alias("functions_test"), add(F.col("n_functions"), gen).alias("functions_generated"),
        M.percentage(add(F.col("total"), gen), add(F.col("total"))).alias("lines_generated_percent"),
        F.count_if(test & gen).alias("overlap_files"), add(F.col("total"), test & gen).alias("overlap_lines"), add(F.col("n_functions"), test & gen).alias("overlap_functions"),
    ]


def metric_rows(totals: DataFrame) -> DataFrame:
    """The aggregates in long form: id, path, name, value, unit. Files have no function statistics."""
    pairs = {**COUNTERS, **STATISTICS}
    row = F.array(*(F.struct(F.lit(k).alias("key"), F.lit(n).alias("name"), F.col(column(k)).cast("double").alias("value"), F.lit(u).alias("unit")) for k, (n, u) in pairs.items()))
    long = totals.select("scope", "identity", "path", F.explode(row).alias("m")).filter((F.col("scope") != "file") | ~F.col("m.key").startswith("function-lines"))
    return long.select(F.concat(F.lit("loc:"), "scope", F.lit(":"), "identity", F.lit(":"), "m.key").alias("id"), "path", F.concat(F.lit("loc."), "scope", F.lit("."), "m.name").alias("name"), "m.value", "m.unit")


def function_metric_rows(functions: DataFrame) -> DataFrame:
    """Six long rows per function."""
    kinds = [("lines:total", "lines.total", "total", "lines"), ("lines:code", "lines.code", "code", "lines"), ("lines:comment", "lines.comment", "comment", "lines"), ("lines:blank", "lines.blank", "blank", "lines"), ("start-line", "start-line", "start_line", "count"), ("end-line", "end-line", "end_line", "count")]
    row = F.array(*(F.struct(F.lit(k).alias("key"), F.lit(f"loc.function.{n}").alias("name"), F.col(c).cast("double").alias("value"), F.lit(u).alias("unit")) for k, n, c, u in kinds))
    return functions.select("path", "start_line", F.col("name").alias("fn"), F.explode(row).alias("m")).select(F.concat(F.lit("loc:function:"), "path", F.lit(":"), F.col("start_line").cast("string"), F.lit(":"), "fn", F.lit(":"), "m.key").alias("id"), "path", "m.name", "m.value", "m.unit")


def overview(files: DataFrame, functions: DataFrame, keys: list[str]) -> DataFrame:
    """Files, lines and functions by kind, with what is written by hand: neither test nor generated."""
    per_file = functions.groupBy(F.col("path").alias("f_path")).agg(F.count("*").alias("n_functions"))
    base = files.join(per_file, F.col("path") == F.col("f_path"), "left").drop("f_path").na.fill(0, ["n_functions"])
    t = base.groupBy(*keys).agg(*counters())
    for kind in ("files", "lines", "functions"):
        t = t.withColumn(f"{kind}_handwritten", F.col(f"{kind}_total") - F.col(f"{kind}_test") - F.col(f"{kind}_generated") + F.col(f"overlap_{kind}"))
    for kind in ("handwritten", "test", "generated"):
        t = t.withColumn(f"lines_{kind}_percent", M.percentage(F.col(f"lines_{kind}"), F.col("lines_total")))
    return t.drop("overlap_files", "overlap_lines", "overlap_functions")


def pivoted(metrics: DataFrame, names: list[str]) -> DataFrame:
    """Long metrics as one row per path; the names are known, so no pass finds them."""
    return metrics.filter(F.col("name").isin(*names)).groupBy("path").pivot("name", names).agg(F.first("value"))


AGGREGATE_SORTS = {
    "path": None, "files": "files_total", "lines": "lines_total", "code": "lines_code", "comment": "lines_comment", "blank": "lines_blank", "handwritten": "lines_handwritten", "test": "lines_test", "generated": "lines_generated",
    "generated-percent": "lines_generated_percent", "functions": "functions_total", "handwritten-files": "files_handwritten",
}
FILE_SORTS = {"path": None, "lines": "total", "code": "code", "comment": "comment", "blank": "blank", "functions": "n_functions"}
FUNCTION_SORTS = {"path": None, "lines": "total", "code": "code", "comment": "comment", "blank": "blank"}


def packages(files: DataFrame, functions: DataFrame, sort: str = "lines", limit: int = 0) -> Selection:
    key = AGGREGATE_SORTS[sort]
    return select_rows(overview(files, functions, ["package_dir"]), None, ([F.col(key).desc()] if key else []) + ["package_dir"], limit)


def file_list(files: DataFrame, functions: DataFrame, package: str = "", kind: str = "all", sort: str = "lines", limit: int = 0) -> Selection:
    per_file = functions.groupBy(F.col("path").alias("f_path")).agg(F.count("*").alias("n_functions"))
    rows = files.join(per_file, F.col("path") == F.col("f_path"), "left").drop("f_path").na.fill(0, ["n_functions"])
    wanted = source_kind(kind)
    wanted = wanted & (F.regexp_replace("path", "/[^/]*$", "") == package) if package else wanted
    key = FILE_SORTS[sort]
    return select_rows(rows, wanted, ([F.col(key).desc()] if key else []) + ["path"], limit)


def function_list(files: DataFrame, functions: DataFrame, package: str = "", file: str = "", kind: str = "all", sort: str = "code", limit: int = 0) -> Selection:
    owner = files.select(F.col("path").alias("o_path"), "test", "generated")
    rows = functions.join(owner, F.col("path") == F.col("o_path")).drop("o_path")
    wanted = source_kind(kind)
    wanted = wanted & (F.regexp_replace("path", "/[^/]*$", "") == package) if package else wanted
    wanted = wanted & (F.col("path") == file) if file else wanted
    key = FUNCTION_SORTS[sort]
    return select_rows(rows, wanted, ([F.col(key).desc()] if key else []) + ["path", "start_line", "name"], limit)


def range_lines(ranges: DataFrame, classes: DataFrame) -> DataFrame:
    """Per range (path, start_line, end_line): lines by class (path, line, class), each line of one class."""
    c = classes.select(F.col("path").alias("c_path"), F.col("line").alias("c_line"), F.col("class").alias("c_class"))
    joined = ranges.join(c, (F.col("path") == F.col("c_path")) & F.col("c_line").between(F.col("start_line"), F.col("end_line")), "left")
    n = lambda k: F.count_if(F.col("c_class") == k).alias(k)
    return joined.groupBy("path", "name", "start_line", "end_line").agg(F.count("c_line").alias("total"), n("code"), n("comment"), n("blank"))
