"""Source trees: which files belong to a scan, their modules and packages. Contents are read only where they are needed."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.errors import NotFoundError, ValidationError
from gaugework.functions.globs import ignored

# Folders that a scan of production files, and one for similar functions, leaves out.
SKIPPED = ["node_modules", "target", "testdata", "vendor"]
SKIPPED_BY_SIMILARITY = [".git", "target", "vendor"]


def tree(spark: SparkSession, root: str, pattern: str = "*.go") -> DataFrame:
    """(path, length, modificationTime, content) under a root; Spark reads only the columns that a query uses."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).withColumn("path", relative(F.col("path"), root))


def relative(path: Column, root: str) -> Column:
    """The path below the root, whatever scheme Spark put before it."""
    return F.regexp_replace(path, r"^.*?\Q" + root.rstrip("/") + r"\E/", "")


def scopes(selected: list[str]) -> list[str]:
    """Clean relative scopes, sorted, each once; "." is the whole repository."""
    out = set()
    for s in selected or ["."]:
        if not s or s != s.strip() or s.startswith("/") or "\\" in s:
            raise ValidationError(f"scope {s!r} must be a relative path", scope=s)
        clean = posixpath.normpath(s)
        if clean == ".." or clean.startswith("../"):
            raise ValidationError(f"scope {s!r} leaves the repository", scope=s)
        out.add(clean)
    return ["."] if "." in out else sorted(out)


def within(path: Column, wanted: list[str]) -> Column:
    test = F.lit(False)
    for s in wanted:
        test = test | (F.lit(True) if s == "." else (path == s) | path.startswith(s + "/"))
    return test


def existing(files: DataFrame, wanted: list[str]) -> list[str]:
    for s in wanted:
        if s != "." and files.filter(within(F.col("path"), [s])).limit(1).isEmpty():
            raise NotFoundError(f"there is no source in {s!r}", scope=s)
    return wanted


def architecture_files(files: DataFrame, roots: list[str], ignore: list[str] = ()) -> DataFrame:
    """Go files under the roots that no ignore pattern matches, each once."""
    p = F.col("path")
    return files.filter(p.endswith(".go") & within(p, scopes(list(roots))) & ~ignored(p, list(ignore))).dropDuplicates(["path"])


def production_files(files: DataFrame, selected: list[str] = ()) -> DataFrame:
    """Go files without tests, outside of folders that begin with a dot or are skipped."""
    p = F.col("path")
    return files.filter(p.endswith(".go") & ~p.endswith("_test.go") & within(p, scopes(list(selected))) & ~p.rlike(r"(^|/)\.[^/]+/") & ~p.rlike(rf"(^|/)({'|'.join(SKIPPED)})/"))


def all_files(files: DataFrame, selected: list[str] = ()) -> DataFrame:
    """As production_files with tests."""
    p = F.col("path")
    return files.filter(p.endswith(".go") & within(p, scopes(list(selected))) & ~p.rlike(r"(^|/)\.[^/]+/") & ~p.rlike(rf"(^|/)({'|'.join(SKIPPED)})/")).dropDuplicates(["path"])


def similarity_files(files: DataFrame, selected: list[str] = ()) -> DataFrame:
    p = F.col("path")
    skip = "|".join(s.replace(".", r"\.") for s in SKIPPED_BY_SIMILARITY)
    return files.filter(p.endswith(".go") & within(p, scopes(list(selected))) & ~p.rlike(rf"(^|/)({skip})/")).dropDuplicates(["path"])


def folder(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(".")


def module_path(content: Column) -> Column:
    """The module named by a go.mod text, bare or quoted; null if it names none."""
    found = F.regexp_extract(content, r'(?m)^\s*module\s+"?([^\s"/][^\s"]*)"?', 1)
    return F.when(found != "", found)


def located(files: DataFrame, modules: DataFrame) -> DataFrame:
    """Files with the nearest module above them: (module_dir, module_path) of ``modules`` by longest prefix.

    The folders above a file are listed and met with the modules by equality; folders are taken once, not once per file.
    """
    dirs = files.select(folder(F.col("path")).alias("dir")).distinct()
    parts = F.split("dir", "/")
    up = F.when(F.col("dir") == ".", F.array(F.lit("."))).otherwise(F.concat(F.array(F.lit(".")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))))
    m = modules.select(F.col("module_dir").alias("m_dir"), F.col("module_path").alias("m_path"))
    near = dirs.select("dir", F.posexplode(up).alias("depth", "above")).join(m, F.col("above") == F.col("m_dir")).groupBy("dir").agg(F.max_by(F.struct(F.col("m_dir").alias("module_dir"), F.col("m_path").alias("module_path")), "depth").alias("m"))
    near = near.select(F.col("dir").alias("n_dir"), "m.module_dir", "m.module_path")
    return files.withColumn("package_dir", folder(F.col("path"))).join(near, F.col("package_dir") == F.col("n_dir"), "left").drop("n_dir")


def without_module(placed: DataFrame) -> DataFrame:
    """Files that no module holds; an analysis that needs modules fails if there are any."""
    return placed.filter("module_dir is null")


def package_queries(files: DataFrame) -> DataFrame:
    """The first file of each folder, which stands for its package."""
    return files.groupBy(folder(F.col("path")).alias("dir")).agg(F.min("path").alias("path"))


def package_patterns(paths: list[str]) -> list[str]:
    """Requested paths as package patterns, sorted, each once: a folder and all below it; a file stands for its folder."""
    out = set()
    for s in scopes(paths):
        target = posixpath.dirname(s) or "." if s.endswith(".go") else s
        out.add("./..." if target == "." else f"./{target}" + ("" if s.endswith(".go") else "/..."))
    return ["./..."] if "./..." in out else sorted(out)
