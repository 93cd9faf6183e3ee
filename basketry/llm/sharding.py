"""Shards by rendezvous hashing of a stable record key over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import positions

OVERHEAD_BYTES = 16


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (position in ``weights``) with the smallest ``-ln(u) / weight``.

    ``u`` is a hash of (key, shard) in the open unit interval, so a shard wins with a probability
    in proportion to its weight, and a further shard only takes keys over, it moves none between
    the others. A shard of weight 0 or less gets nothing. NULL is a key like any other.
    """
    shards = [(i, float(w)) for i, w in enumerate(weights) if w > 0]
    if not shards:
        raise ValueError("no shard has a positive weight")
    table = F.array(*[F.struct(F.lit(i).alias("shard"), F.lit(w).alias("weight")) for i, w in shards])

    def score(s: Column) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(key, s["shard"]), 11)
        u = (bits.cast("double") + F.lit(0.5)) / F.lit(float(2**53))
        return F.struct((-F.log(u) / s["weight"]).alias("score"), s["shard"].alias("shard"))

    return F.array_min(F.transform(table, score))["shard"]


def shard_rows(
    df: DataFrame,
    n_shards: int = 40,
    weights: Sequence[float] | None = None,
    grown_weight: float = 1.0,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row.

    ``grown_shard`` is the shard after one more of weight ``grown_weight`` is added. ``slot``
    numbers the rows of a shard from 0 by key, text checksum and size; equal rows take any order.
    Repeated keys share a shard. NULL or empty text has size 16 and checksum 0; a NULL key is
    placed like any other and sorts first. Other columns are not read. Only numbers are shuffled.
    """
    weights = list(weights) if weights is not None else [1.0] * n_shards
    body = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    rows = df.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body) + OVERHEAD_BYTES).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(F.col(key), weights).alias("shard"),
        rendezvous(F.col(key), [*weights, grown_weight]).alias("grown_shard"),
    )
    order = [F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    return positions(rows, ["shard"], order, out="slot").select(
        "doc_id",
        "size",
        "text_crc32",
        "law",
        "shard",
        (F.col("slot") - 1).alias("slot"),
        "grown_shard",
    )
