"""Order-dependent operators that do not need a whole group in one task.

A window partitioned by customer sorts all rows of that customer in one task, which fails once a
single customer holds a large share of the data. Every function here therefore looks for frequent
groups first, with a sketch. Ordinary groups use the plain window. Hot groups, and frames without any group, are
range-partitioned on (group, order): each range counts its own rows, a small table of per-range
totals supplies the offset of each range, and both add up to the same numbers.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import freeze

# A group above this many rows is ranked over several tasks.
HOT_ROWS = 2_000_000
# Hot keys up to this number are shipped with the plan; more of them are joined as a table.
MAX_LITERAL_KEYS = 10_000
# Keys that a sketch of frequent keys keeps track of.
SKETCH_KEYS = 65_536
# Rows of ordinary groups that one task sorts.
TASK_ROWS = 1_000_000

_RANGE = "__range"


def same_key(columns: Sequence[str], other_prefix: str) -> Column:
    """NULL-safe equality of ``c`` and ``prefix + c`` for every key column."""
    pairs = [F.col(c).eqNullSafe(F.col(other_prefix + c)) for c in columns]
    return reduce(lambda a, b: a & b, pairs)


def tasks_for(df: DataFrame, n: float, each: int) -> int:
    """Partitions of about ``each`` of ``n`` rows, and no fewer than keep the cluster busy.

    Adaptive execution merges partitions by their compressed bytes, of which narrow rows have few; a
    partition count given explicitly bounds the rows of a task at any size.
    """
    busy = min(df.sparkSession.sparkContext.defaultParallelism, n / 10_000)
    return max(1, math.ceil(busy), math.ceil(n / each))


def _frequent(df: DataFrame, key: Column, limit: int) -> tuple[DataFrame | list[int], int]:
    """Hashes of all keys with more than ``limit`` rows, and perhaps of some with fewer; and all rows.

    A mergeable sketch of frequent items reads the key columns once, without a shuffle of keys. It
    tracks ``SKETCH_KEYS`` of them, and misses none with more than 8 / ``SKETCH_KEYS`` of all rows.
    Where ``limit`` lies below that, rows are counted per key instead.
    """
    top = F.expr(f"approx_top_k(k, {SKETCH_KEYS}, {SKETCH_KEYS})")
    keys = df.select(key.alias("k"))
    found = keys.agg(top.alias("top"), F.count(F.lit(1)).alias("n")).first()
    if found["n"] <= limit:
        return [], found["n"]
    if limit >= found["n"] * 8 / SKETCH_KEYS:
        return [t["item"] for t in found["top"] if t["count"] > limit], found["n"]
    counts = keys.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit).select("k")
    few = counts.limit(MAX_LITERAL_KEYS + 1).collect()
    return [r["k"] for r in few] if len(few) <= MAX_LITERAL_KEYS else freeze(counts), found["n"]


def split_hot(
    df: DataFrame, group: Sequence[str], limit: int
) -> tuple[DataFrame, DataFrame | None]:
    """Rows of groups with at most ``limit`` rows, and rows of larger groups (None if no such group)."""
    return split_counted(df, group, limit)[:2]


def split_counted(
    df: DataFrame, group: Sequence[str], limit: int
) -> tuple[DataFrame, DataFrame | None, int]:
    """``split_hot``, and the number of all rows.

    Nothing is written: ``df`` is planned once more for a sketch of its key columns, to which Spark
    prunes it, and a row's side follows from its key alone. A group of fewer rows may be taken as
    large; both ways give the same results. Store an input whose key columns alone are costly.
    """
    key = F.xxhash64(*group)
    hot, n = _frequent(df, key, limit)
    if isinstance(hot, list):
        if not hot:
            return df, None, n
        if len(hot) <= MAX_LITERAL_KEYS:
            return df.filter(~key.isin(hot)), df.filter(key.isin(hot)), n
        # At most SKETCH_KEYS numbers.
        hot = F.broadcast(df.sparkSession.createDataFrame([(k,) for k in hot], "k long"))
    match = key == F.col("__hot_key")
    hot = hot.select(F.col("k").alias("__hot_key"))
    return df.join(hot, match, "left_anti"), df.join(hot, match, "left_semi"), n


def _running_over_window(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], measures: Mapping[str, Column]
) -> DataFrame:
    whole = Window.partitionBy(*group)
    before = whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    added = {}
    for name, measure in measures.items():
        added[f"{name}_before"] = F.coalesce(F.sum(measure).over(before), F.lit(0))
        added[f"{name}_total"] = F.sum(measure).over(whole)
    return df.select("*", *[c.alias(n) for n, c in added.items()])


def _running_over_ranges(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], measures: Mapping[str, Column]
) -> DataFrame:
    # The range of a row depends on sampled bounds, so the layout is frozen before it is used twice.
    ranged = freeze(
        df.repartitionByRange(*[F.col(c) for c in group], *order).withColumn(
            _RANGE, F.spark_partition_id()
        )
    )
    per_range = ranged.groupBy(_RANGE, *group).agg(
        *[F.sum(m).alias(f"__sum_{n}") for n, m in measures.items()]
    )
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select(
        F.col(_RANGE).alias("__at_" + _RANGE),
        *[F.col(c).alias("__at_" + c) for c in group],
        *[
            F.coalesce(F.sum(f"__sum_{n}").over(earlier), F.lit(0)).alias(f"__offset_{n}")
            for n in measures
        ],
        *[F.sum(f"__sum_{n}").over(whole).alias(f"{n}_total") for n in measures],
    )
    if not group:
        offsets = F.broadcast(offsets)  # one row per range
    local = Window.partitionBy(_RANGE, *group).orderBy(*order)
    local = local.rowsBetween(Window.unboundedPreceding, -1)
    counted = ranged.select(
        "*",
        *[
            F.coalesce(F.sum(m).over(local), F.lit(0)).alias(f"__local_{n}")
            for n, m in measures.items()
        ],
    )
    joined = counted.join(offsets, same_key([_RANGE, *group], "__at_"))
    return joined.select(
        *df.columns,
        *[
            c
            for n in measures
            for c in (
                (F.col(f"__local_{n}") + F.col(f"__offset_{n}")).alias(f"{n}_before"),
                F.col(f"{n}_total"),
            )
        ],
    )


def running_totals(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    measures: Mapping[str, Column],
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add ``<name>_before`` (sum over earlier rows of the group) and ``<name>_total`` per measure.

    ``order`` should be unique inside a group; rows equal in it are numbered in any order.
    """
    group = list(group)
    if not group:
        return _running_over_ranges(df, group, order, measures)
    ordinary, hot, n = split_counted(df, group, hot_rows)
    ordinary = ordinary.repartition(tasks_for(df, n, TASK_ROWS), *group)
    result = _running_over_window(ordinary, group, order, measures)
    if hot is not None:
        result = result.unionByName(_running_over_ranges(hot, group, order, measures))
    return result


def positions(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    out: str = "position",
    total: str | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Number the rows of each group from 1 along ``order``; ``total`` adds the group size."""
    counted = running_totals(df, group, order, {"__n": F.lit(1).cast("long")}, hot_rows)
    columns = [*df.columns, (F.col("__n_before") + 1).alias(out)]
    if total is not None:
        columns.append(F.col("__n_total").alias(total))
    return counted.select(*columns)


def dense_ids(df: DataFrame, col: str, out: str, dtype: str = "int") -> DataFrame:
    """One row per distinct value of ``col`` with a 0-based id in value order."""
    numbered = positions(df.select(col).distinct(), (), [F.col(col).asc()], out=out)
    return numbered.select(col, (F.col(out) - 1).cast(dtype).alias(out))


def _tie_ranks(df: DataFrame, group: Sequence[str], score: str, hot_rows: int) -> DataFrame:
    """Add ``__before`` (rows with a higher score), ``__ties`` and ``__n`` inside the group."""
    group = list(group)
    ordinary, hot, n = split_counted(df, group, hot_rows)
    ordinary = ordinary.repartition(tasks_for(df, n, TASK_ROWS), *group)
    whole = Window.partitionBy(*group)
    result = ordinary.select(
        "*",
        (F.rank().over(whole.orderBy(F.col(score).desc())) - 1).cast("long").alias("__before"),
        F.count(F.lit(1)).over(Window.partitionBy(*group, score)).alias("__ties"),
        F.count(F.lit(1)).over(whole).alias("__n"),
    )
    if hot is None:
        return result
    hot = freeze(hot)
    keys = [*group, score]
    levels = hot.groupBy(*keys).agg(F.count(F.lit(1)).alias("__ties"))
    levels = _running_over_ranges(levels, group, [F.col(score).desc()], {"__w": F.col("__ties")})
    levels = levels.select(
        *[F.col(c).alias("__lvl_" + c) for c in keys],
        F.col("__w_before").alias("__before"),
        "__ties",
        F.col("__w_total").alias("__n"),
    )
    ranked = hot.join(levels, same_key(keys, "__lvl_"))
    return result.unionByName(ranked.select(*df.columns, "__before", "__ties", "__n"))


def _percent(before: Column, n: Column) -> Column:
    return F.when(n > 1, before / (n - 1)).otherwise(F.lit(0.0))


def percent_rank_items(
    preds: DataFrame,
    user: str = "user",
    score: str = "prediction",
    out: str = "percent_rank",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """(rank - 1) / (n - 1) of each row in its user's list, best score first; 0 for a single row."""
    ranked = _tie_ranks(preds, [user], score, hot_rows)
    return ranked.select(*preds.columns, _percent(F.col("__before"), F.col("__n")).alias(out))


def avg_rank_pct(
    df: DataFrame,
    col: str = "prediction",
    user: str = "user",
    out: str = "rank_pct",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Descending rank divided by list length, tied rows sharing their average rank."""
    ranked = _tie_ranks(df, [user], col, hot_rows)
    average = F.col("__before") + (F.col("__ties") + 1) / F.lit(2.0)
    return ranked.select(*df.columns, (average / F.col("__n")).alias(out))


def top_k(
    preds: DataFrame,
    k: int = 20,
    user: str = "user",
    item: str = "item",
    score: str = "prediction",
    rank: str | None = None,
) -> DataFrame:
    """The ``k`` best rows per user, equal scores ordered by item.

    ``rank <= k`` right above the window lets Spark keep at most k rows per user and map task
    before the shuffle, so a user with many predictions does not matter here.
    """
    w = Window.partitionBy(user).orderBy(F.col(score).desc(), F.col(item).asc())
    kept = preds.withColumn("__rank", F.row_number().over(w)).filter(F.col("__rank") <= k)
    if rank is None:
        return kept.drop("__rank")
    return kept.withColumnRenamed("__rank", rank)


def value_levels(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``column, value, n``: the distinct values of every column with their number of rows."""
    cells = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in cols])
    )
    return (
        df.select(cells.alias("cell"))
        .select("cell.*")
        .filter(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Interpolated quantiles per column (``column``, ``q_0``, ``q_1``, ...)."""
    return level_quantiles(value_levels(df, cols), probs)


def level_quantiles(levels: DataFrame, probs: Sequence[float]) -> DataFrame:
    """The same from counted values, ranked over value ranges, so no task holds a whole column."""
    ranked = _running_over_ranges(levels, ["column"], [F.col("value").asc()], {"n": F.col("n")})

    def value_at(index: Column) -> Column:
        here = (F.col("n_before") <= index) & (index < F.col("n_before") + F.col("n"))
        return F.max(F.when(here, F.col("value")))

    aggregates, outputs = [], []
    for i, p in enumerate(probs):
        target = F.lit(float(p)) * (F.col("n_total") - 1)
        aggregates += [
            value_at(F.floor(target)).alias(f"__lo{i}"),
            value_at(F.ceil(target)).alias(f"__hi{i}"),
            F.max(target - F.floor(target)).alias(f"__part{i}"),
        ]
        low, high, part = F.col(f"__lo{i}"), F.col(f"__hi{i}"), F.col(f"__part{i}")
        outputs.append((low + (high - low) * part).alias(f"q_{i}"))
    return ranked.groupBy("column").agg(*aggregates).select("column", *outputs)
