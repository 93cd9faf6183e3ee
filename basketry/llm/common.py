"""Small helpers that the text operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from ..session import scratch_path

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back.

    The lineage ends at that table, and the shuffle files that led to it are removed as soon as it
    is complete, so a chain of steps needs the disk of its largest step and not of all together.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, "text")
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def row_and(row: DataType, fields: str) -> StructType:
    """A schema of a passed-through ``row`` and further fields."""
    return StructType([StructField("row", row), *StructType.fromDDL(fields)])


def map_batches(
    df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str | StructType
) -> DataFrame:
    """``df`` through ``fn``, one Arrow batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from fn(batch)

    return df.mapInArrow(run, schema)


def by_weight(texts: pa.Array, limit: int = 500_000) -> Iterator[tuple[int, int]]:
    """Cut rows into runs (from, to) of about ``limit`` characters, one row at least."""
    total, first = 0, 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        if total and total + (n or 0) > limit:
            yield first, i
            total, first = 0, i
        total += n or 0
    if first < len(texts):
        yield first, len(texts)


NO_ID = -(2**63)


def order_id(key: str) -> Column:
    """The integer id with NULL as a number below every other."""
    return F.coalesce(F.col(key).cast("long"), F.lit(NO_ID))


def given_id(col: Column | str) -> Column:
    return F.nullif(F.col(col) if isinstance(col, str) else col, F.lit(NO_ID))


def sha256_text(col: Column) -> Column:
    """Lowercase hex SHA-256 of the UTF-8 bytes."""
    return F.sha2(F.encode(col, "UTF-8"), 256)
