"""Small helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notewise.session import checkpointed


def picked(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under fixed names; columns of the input that clash with helper names are out of the way."""
    return df.select(*[df[f"`{name}`"].alias(alias) for alias, name in columns.items()])


def text_of(name: str) -> Column:
    """A text column; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: the context's checkpoint folder (set from ``spark.checkpoint.dir``)."""
    if spark.sparkContext.getCheckpointDir() is None:
        checkpointed(spark.range(1))
    return spark.sparkContext.getCheckpointDir()


def slices(batches: Iterator[pa.RecordBatch], column: str, chars: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each has about ``chars`` bytes of text, or one longer text; bounds a worker's memory."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
        first, held = 0, 0
        for k, size in enumerate(sizes):
            if held and held + size > chars:
                yield batch.slice(first, k - first)
                first, held = k, 0
            held += size
        if first < batch.num_rows:
            yield batch.slice(first)
