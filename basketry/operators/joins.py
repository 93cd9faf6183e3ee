"""Equi joins around (user, item) frames.

Physical join choice is left to Spark: the adaptive engine broadcasts a side only after measuring
it, and splits skewed partitions of the other one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import zero_fill


def join_keys(df: DataFrame, keys: DataFrame, on: str | Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join on named keys."""
    return df.join(keys, on, how)


def attach_ids(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """Left join to a key dimension made by ``dense_ids``."""
    return df.join(ids, on, "left")


def attach_attributes(df: DataFrame, attrs: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Left join to descriptive columns. Several attribute rows per key multiply the rows."""
    return df.join(attrs, on, "left")


def exclude_seen(
    preds: DataFrame,
    train: DataFrame,
    user: str = "user",
    item: str = "item",
    weight: str | None = None,
) -> DataFrame:
    """Drop predictions of items the user already has. With ``weight``, only weight > 0 counts as seen.

    The seen pairs grow with the input, yet a stored table of them looks small by its compressed
    bytes: the hint keeps them from being sent to every task. An outer join, as an anti-join would be
    moved below an aggregation of ``preds`` and shuffle all that is still to be added up.
    """
    seen = train if weight is None else train.filter(F.col(weight) > 0)
    marked = seen.select(user, item, F.lit(True).alias("__is_seen")).hint("merge")
    met = preds.join(marked, [user, item], "left")
    return met.filter(F.col("__is_seen").isNull()).select(*preds.columns)


def missing_keys(a: DataFrame, b: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Distinct keys of ``a`` that ``b`` does not have."""
    on = [on] if isinstance(on, str) else list(on)
    return a.select(*on).join(b.select(*on), on, "left_anti").distinct()


def lookup_cells(
    pairs: DataFrame, facts: DataFrame, user: str, item: str, measures: Sequence[str]
) -> DataFrame:
    """Cells of the zero-filled user x item grid for the given pairs, without building the grid."""
    cells = facts.groupBy(user, item).agg(*[F.sum(m).alias(m) for m in measures])
    return zero_fill(pairs.join(cells, [user, item], "left"), measures)


def dense_grid(
    facts: DataFrame,
    user: str,
    item: str,
    measures: Sequence[str],
    items: Sequence,
) -> DataFrame:
    """Every user of ``facts`` with every one of ``items``, measures summed, absent pairs 0.

    The axis is a hash table of the given list, broadcast because the caller holds it: one lookup
    gives a row its place. Facts are summed per user and place, a user's filled places are sorted,
    and each fills the gap before it. Work per row and per cell does not depend on the axis; there
    is one shuffle by user. NULL users and NULL items are on neither axis. For an open axis use
    ``lookup_cells`` or the sparse frame.
    """
    kind = facts.schema[item].dataType
    axis = list(dict.fromkeys(i for i in items if i is not None))
    names = F.array(*[F.lit(i).cast(kind) for i in axis]).cast(f"array<{kind.simpleString()}>")
    places = F.broadcast(facts.sparkSession.range(1).select(F.posexplode(names).alias("__place", "__axis")))
    known = facts.filter(F.col(user).isNotNull())
    placed = known.join(places, F.col(item) == F.col("__axis"), "left")
    cells = placed.groupBy(user, "__place").agg(*[F.sum(m).alias(m) for m in measures])
    entry = F.struct("__place", F.struct(*measures).alias("sums"))
    per_user = cells.groupBy(user).agg(
        F.sort_array(F.collect_list(F.when(F.col("__place").isNotNull(), entry))).alias("filled")
    )
    # Every filled place closes a run of empty ones before it; the end of the axis closes the last.
    none = F.lit(None).cast(cells.select(F.struct(*measures).alias("sums")).schema["sums"].dataType)
    ends = F.concat("filled", F.array(F.struct(F.lit(len(axis)).alias("__place"), none.alias("sums"))))
    runs = F.transform(
        ends,
        lambda e, i: F.struct(
            F.when(i == 0, F.lit(0)).otherwise(F.get("filled", i - 1)["__place"] + 1).alias("first"),
            e["__place"].alias("last"),
            e["sums"].alias("sums"),
        ),
    )
    run = per_user.select(user, F.explode(runs).alias("run"))
    last = F.least(F.col("run.last"), F.lit(len(axis) - 1))
    rows = run.filter(F.col("run.first") <= last).select(user, "run", F.explode(F.sequence("run.first", last)).alias("place"))
    own = F.col("place") == F.col("run.last")
    value = lambda m: F.coalesce(F.when(own, F.col(f"run.sums.{m}")), F.lit(0).cast(cells.schema[m].dataType))
    return rows.select(user, F.get(names, F.col("place")).alias(item), *[value(m).alias(m) for m in measures])


def merge_with_indicator(
    a: DataFrame,
    b: DataFrame,
    on: str | Sequence[str],
    how: str = "left",
    suffixes: tuple[str, str] = ("_x", "_y"),
) -> DataFrame:
    """Left or outer join with ``_merge`` telling where a row comes from.

    Values: ``both``, ``left_only``, ``right_only``. Other columns of the same name get a suffix.
    NULL keys never match.
    """
    if how not in ("left", "outer"):
        raise ValueError("how is 'left' or 'outer'")
    on = [on] if isinstance(on, str) else list(on)
    shared = (set(a.columns) & set(b.columns)) - set(on)

    def side(df: DataFrame, suffix: str, marker: str) -> DataFrame:
        renamed = [F.col(c).alias(c + suffix if c in shared else c) for c in df.columns]
        return df.select(*renamed, F.lit(True).alias(marker))

    joined = side(a, suffixes[0], "__in_a").join(
        side(b, suffixes[1], "__in_b"), on, "left" if how == "left" else "full_outer"
    )
    origin = (
        F.when(F.col("__in_a").isNull(), F.lit("right_only"))
        .when(F.col("__in_b").isNull(), F.lit("left_only"))
        .otherwise(F.lit("both"))
    )
    return joined.withColumn("_merge", origin).drop("__in_a", "__in_b")


def merge_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("_merge").agg(F.count(F.lit(1)).alias("count"))


def audit_pairs(
    preds: DataFrame,
    actual: DataFrame,
    users: DataFrame,
    user: str = "user",
    item: str = "item",
    predicate: str | None = None,
) -> DataFrame:
    """Predictions next to purchases for chosen users, one row per pair of either side."""
    chosen = users.select(user)
    merged = merge_with_indicator(
        preds.join(chosen, user, "left_semi"),
        actual.join(chosen, user, "left_semi"),
        [user, item],
        "outer",
    )
    return merged.where(predicate) if predicate else merged
