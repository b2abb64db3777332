"""Shared helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.functions.checkpoint import cut, discard, ensure_checkpoint_dir, stored
from gaugework.functions.shipping import ship


__all__ = ["carried", "cut", "discard", "ensure_checkpoint_dir", "field", "held_out", "map_rows", "restored", "ship", "slices", "stored", "table"]

#: Rows, and bytes of text, that a Python worker turns into objects at a time; a longer text goes alone.
SLICE_ROWS, SLICE_BYTES = 256, 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents whose labels are never learned from."""
    return F.crc32(doc_id.cast("string")) % 5 == 0


def carried(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as one struct column ``row``, so that no column of theirs clashes with one that is added."""
    return docs.select(F.struct(*(docs[f"`{c.replace('`', '``')}`"] for c in docs.columns)).alias("row"))


def field(name: str) -> Column:
    """A column of a carried row."""
    return F.col("row").getField(name)


def restored(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of carried rows."""
    return rows.select(*(field(c).alias(c) for c in columns))


def slices(batch: pa.RecordBatch, *texts: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of few rows and few bytes in the columns ``texts``."""
    size = sum(pc.fill_null(pc.binary_length(batch.column(i)), 0).to_numpy(zero_copy_only=False).astype("int64") for i in texts)
    start = held = 0
    for i, n in enumerate(size.tolist()):
        if i > start and (i - start >= SLICE_ROWS or held + n > SLICE_BYTES):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def map_rows(df: DataFrame, keys: list[str], text: str, schema: str, row: Callable[[str], tuple], names: list[str]) -> DataFrame:
    """Apply ``row`` to the text of every row in Arrow batches; the result holds ``keys`` and ``names``.

    A null text is an empty one. Only the named columns are read, so further columns, whatever they are called,
    neither travel to Python nor clash with the result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, len(keys)):
                out = [row(t or "") for t in batch.column(len(keys)).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i) for i in range(len(keys))), *(pa.array([r[i] for r in out], type=types[i]) for i in range(len(names)))],
                    names=[*keys, *names],
                )

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ship(df.sparkSession)
    types = [f.type for f in to_arrow_schema(StructType.fromDDL(schema))]
    kept = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*keys, F.col(text).cast("string").alias("__text")).mapInArrow(run, f"{kept}, {schema}")
