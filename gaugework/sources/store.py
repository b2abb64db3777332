"""Stored results: tables of an analysis as Parquet under the key of its configuration, and JSON sinks."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.errors import NotFoundError, ValidationError
from gaugework.schemas import GRAPH_VERSION

MODES = ("auto", "require", "refresh", "off")


def cache_key(scope: dict) -> str:
    """The key of results: a hash of everything that shapes them."""
    return hashlib.sha256(json.dumps(scope, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


@dataclass
class Store:
    """A folder that all executors share; results lie below the schema version and their key."""

    folder: str

    def path(self, key: str, table: str) -> str:
        return f"{self.folder.rstrip('/')}/v{GRAPH_VERSION}/{key}/{table}"

    def save(self, key: str, tables: dict[str, DataFrame]) -> None:
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(self.path(key, name))

    def load(self, spark: SparkSession, key: str, names: list[str]) -> dict[str, DataFrame] | None:
        from pyspark.errors import AnalysisException

        try:
            return {n: spark.read.parquet(self.path(key, n)) for n in names}
        except AnalysisException:
            return None

    def get(self, spark: SparkSession, key: str, names: list[str], compute: Callable[[], dict[str, DataFrame]], mode: str = "auto") -> dict[str, DataFrame]:
        """Stored tables if there are any, else computed and stored; ``require`` never computes, ``refresh`` always does."""
        if mode not in MODES:
            raise ValidationError(f"unknown cache mode {mode!r}")
        found = self.load(spark, key, names) if mode in ("auto", "require") else None
        if found is None and mode == "require":
            raise NotFoundError("there are no stored results", key=key)
        if found is None:
            found = compute()
            if mode != "off":
                self.save(key, found)
                found = self.load(spark, key, names)
        return found


def as_json(df: DataFrame, name: str = "document") -> DataFrame:
    """Each row as a JSON document with its fields in order; null fields stay."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias(name))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def wire_count(value: Column) -> Column:
    """A count as the wire has it: unsigned 32 bits, so negative ones are 0 and larger ones the largest."""
    return F.least(F.greatest(value.cast("bigint"), F.lit(0)), F.lit(2**32 - 1))
