"""Continuous refresh: a digest of the sources tells changes, and a new revision of the results is published.

A file stream triggers the check; whatever arrives, the whole analysis is computed anew from the tables as they are, and
its revision is published only if it differs from the last one. The revision and the digest live beside the results, so a
stream that starts again goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from gaugework.errors import ValidationError

# Fixed values of the feed, in milliseconds.
INTERVAL, LEAST_INTERVAL, HEARTBEAT = 750, 100, 20_000
READY, CHANGED = "ready", "changed"


def row_digests(df: DataFrame) -> DataFrame:
    """One SHA-256 per row over all its columns as JSON, columns by name."""
    return df.select(F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256).alias("digest"))


def revision(tables: dict[str, DataFrame]) -> DataFrame:
    """The revision as one row. Digests of rows are summed in pieces, so the order of rows doesn't matter and nothing is gathered."""
    parts = None
    for name in sorted(tables):
        d = row_digests(tables[name])
        piece = lambda k: F.coalesce(F.sum(F.conv(F.substring("digest", 1 + 12 * k, 12), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string")
        one = d.agg(F.concat_ws(":", F.lit(name), F.count("*").cast("string"), *(piece(k) for k in range(5))).alias("part"))
        parts = one if parts is None else parts.unionByName(one)
    return parts.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("part")), "\n"), 256).alias("revision"))


def snapshot(files: DataFrame) -> DataFrame:
    """The digest of a file listing (path, length, modificationTime)."""
    return revision({"files": files.select("path", "length", F.col("modificationTime").cast("string").alias("modified"))})


def listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Paths, sizes and times of all files under a folder; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder).select("path", "length", "modificationTime")


@dataclass
class Feed:
    """Recomputes ``analyse`` when a stream has something new, and publishes each new revision to ``events``."""

    analyse: Callable[[], dict[str, DataFrame]]
    events: str  # a folder of Parquet rows (batch, kind, revision)

    def last(self, spark: SparkSession) -> str | None:
        from pyspark.errors import AnalysisException

        try:
            row = spark.read.schema("batch long, kind string, revision string").parquet(self.events).orderBy(F.col("batch").desc()).first()
        except AnalysisException:
            return None
        return row.revision if row else None

    def refresh(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = self.last(spark)
        now = revision(self.analyse()).first().revision
        if now != before:
            kind = READY if before is None else CHANGED
            spark.createDataFrame([(number, kind, now)], "batch long, kind string, revision string").coalesce(1).write.mode("append").parquet(self.events)

    def start(self, spark: SparkSession, schema: StructType, folder: str, checkpoint: str, interval: int = INTERVAL, once: bool = False) -> StreamingQuery:
        """Watch a folder of Parquet files; ``once`` handles what is there and stops."""
        if interval < LEAST_INTERVAL:
            raise ValidationError(f"the interval must be {LEAST_INTERVAL} ms or more")
        writer = spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(self.refresh).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{interval} milliseconds")).start()
