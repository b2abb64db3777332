"""Every registered query of the engine and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from gaugework.errors import NotFoundError  # noqa: F401  tests name it
from gaugework.operators import components as C
from gaugework.operators import functions as Fn
from gaugework.operators import rules as R
from gaugework.plans import facts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
VIEWS: dict[str, str] = {}


def stamp(spark: SparkSession, sf_dir: str) -> tuple:
    """Names, sizes and times of a folder's files, as the store that holds them gives them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in found))


class Context:
    """Facts of one data folder, and the graphs built from them, which are computed once for a Spark application.

    A folder whose files have changed since gets a new context.
    """

    _held: dict[tuple, Context] = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> Context:
        key = (spark.sparkContext.applicationId, sf_dir, stamp(spark, sf_dir))
        if key not in cls._held:
            cls.clear()
            cls._held[key] = cls(spark, sf_dir)
        return cls._held[key]

    @classmethod
    def clear(cls) -> None:
        """Forget all graphs, so that the next query computes its own."""
        cls._held.clear()

    def fact(self, name: str) -> DataFrame:
        return facts.fact(self.spark, self.sf_dir, name)

    @cached_property
    def graph(self) -> C.ComponentGraph:
        return C.build(self.fact("source_files"), self.fact("source_imports"), self.fact("descriptors"))

    @cached_property
    def functions(self) -> Fn.FunctionGraph:
        return Fn.build(self.fact("function_declarations"), self.fact("function_references"), self.fact("descriptors"))

    @cached_property
    def findings(self) -> DataFrame:
        return R.cached(R.evaluate(self.graph, self.fact("diagnostics")))


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function of a Context under ``name``, with the statement that gives the same rows."""

    def add(make: Callable[[Context], DataFrame]) -> Callable[[Context], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: make(Context.of(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = facts.oracle(sql, VIEWS)
        return make

    return add


from gaugework.plans import graph_queries, measure_queries, source_queries  # noqa: E402, F401  they register themselves
