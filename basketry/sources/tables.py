"""Sources and sinks: parquet, all-text CSV, named views, and concatenation of extracts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.ordered import positions


def read_orders(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Parquet scan; later filters and selections are pushed into it by Catalyst.

    With a ``schema`` the files have to hold its columns with these types, and a wrong one is an
    error here instead of somewhere later.
    """
    df = spark.read.parquet(path)
    if schema is None:
        return df
    wanted = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    found = {f.name: f.dataType for f in df.schema}
    wrong = [
        f"{f.name} is {found[f.name].simpleString() if f.name in found else 'missing'}, not {f.dataType.simpleString()}"
        for f in wanted
        if found.get(f.name) != f.dataType
    ]
    if wrong:
        raise ValueError(f"{path}: " + "; ".join(wrong))
    return df.select(*wanted.names)


def write_frame(
    df: DataFrame, path: str, mode: str = "errorifexists", partition_by: Sequence[str] = ()
) -> str:
    """Parquet sink. By default an existing target is an error."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def read_text_table(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, **options: str
) -> DataFrame:
    """CSV with a header in which every column stays text (no inference pass).

    ``columns`` that the header does not have are an error.
    """
    df = spark.read.options(header=True, inferSchema=False, **options).csv(path)
    if columns is None:
        return df
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{path}: no column {', '.join(missing)}")
    return df.select(*columns)


def register(df: DataFrame, name: str) -> DataFrame:
    """Publish ``df`` to SQL under ``name`` and return it."""
    df.createOrReplaceTempView(name)
    return df


def query_view(df: DataFrame, name: str, text: str, **args) -> DataFrame:
    """Register ``df`` as ``name`` and run SQL text over it; ``:key`` in the text takes ``args[key]``."""
    register(df, name)
    return df.sparkSession.sql(text, args=args)


def concat_frames(
    *dfs: DataFrame, row_id: str | None = None, order: Sequence[Column] = ()
) -> DataFrame:
    """Stack frames by column name; a column missing from one frame is NULL there.

    With ``row_id`` the result is numbered 0, 1, 2, ... along ``order``.
    """
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)
    if row_id is None:
        return stacked
    if not order:
        raise ValueError("numbering rows needs an order")
    numbered = positions(stacked, (), order, out=row_id)
    return numbered.withColumn(row_id, F.col(row_id) - 1)
