"""Counts, profiles and reports over whole frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import format_report, zero_fill
from .selection import describe_columns


def interaction_counts(df: DataFrame, user: str, item: str) -> DataFrame:
    """Rows, distinct pairs, users and items in one job: pairs are collapsed before counting keys."""
    pairs = df.groupBy(user, item).agg(F.count(F.lit(1)).alias("__rows"))
    present = F.col(user).isNotNull() & F.col(item).isNotNull()
    return pairs.agg(
        F.coalesce(F.sum("__rows"), F.lit(0)).alias("num_rows"),
        F.count_if(present).alias("num_pairs"),
        F.count_distinct(user).alias("num_users"),
        F.count_distinct(item).alias("num_items"),
    )


def sparsity(
    df: DataFrame, user: str, item: str, count: str = "pairs", formatted: bool = False
) -> DataFrame:
    """Share of empty user x item cells, in percent. ``count='rows'`` counts repeated pairs again."""
    counts = interaction_counts(df, user, item)
    numerator = F.col("num_pairs" if count == "pairs" else "num_rows")
    cells = F.col("num_users") * F.col("num_items")
    report = counts.select(
        "num_users",
        "num_items",
        numerator.alias("numerator"),
        cells.alias("denominator"),
        ((1 - numerator / F.nullif(cells, F.lit(0).cast("long"))) * 100).alias("empty_percent"),
    )
    if not formatted:
        return report
    return format_report(
        report, ["num_users", "num_items", "numerator", "denominator"], ["empty_percent"]
    )


def distinct_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols).distinct()


def top_customers(df: DataFrame, user: str, item: str) -> DataFrame:
    """Users by number of purchase rows, via counts per (user, item); most active first."""
    per_pair = df.groupBy(user, item).agg(F.count(F.lit(1)).alias("__rows"))
    per_user = per_pair.groupBy(user).agg(
        F.sum("__rows").alias("purchases"), F.count(F.lit(1)).alias("products")
    )
    return per_user.orderBy(F.col("purchases").desc(), F.col(user))


def value_counts(df: DataFrame, cols: str | Sequence[str], ordered: bool = True) -> DataFrame:
    """Rows per distinct value, most frequent first."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    counts = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.col("count").desc(), *cols) if ordered else counts


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """count, mean, std, min, quartiles and max, one row per numeric column.

    The columns are read two or three times, see ``describe_columns``; store an input whose plan is
    costly. A column without values has count 0 and NULLs.
    """
    found = describe_columns(df, cols, [0.25, 0.5, 0.75])
    rows = [(r["column"], r["count"], r["mean"], r["std"], r["min"], *r["quantiles"], r["max"]) for r in found]
    measures = ", ".join(f"{c} double" for c in ("mean", "std", "min", "p25", "p50", "p75", "max"))
    return df.sparkSession.createDataFrame(rows, f"column string, count long, {measures}")


def basket_long(lines: DataFrame, order: str = "BE_ORDER_ID", sku: str = "SKU", qty: str = "PROD_QTY") -> DataFrame:
    """Order x SKU quantities in sparse form: one row per non-empty cell."""
    keyed = lines.filter(F.col(order).isNotNull() & F.col(sku).isNotNull())
    return keyed.groupBy(order, sku).agg(F.sum(qty).alias(qty))


def basket_matrix(
    lines: DataFrame,
    skus: Sequence,
    order: str = "BE_ORDER_ID",
    sku: str = "SKU",
    qty: str = "PROD_QTY",
) -> DataFrame:
    """Order x SKU matrix with one column for each of ``skus``, empty cells 0.

    Orders without any of them have a row of zeros; NULL orders have none. For an open axis use
    ``basket_long``.
    """
    matrix = lines.filter(F.col(order).isNotNull()).groupBy(order).pivot(sku, list(skus)).agg(F.sum(qty))
    return zero_fill(matrix, matrix.columns[1:])


def heaviest_users(
    train: DataFrame, n: int, user: str = "user", item: str = "item", weight: str = "weight"
) -> DataFrame:
    """Distinct users of the ``n`` heaviest (user, item) rows."""
    order = [F.col(weight).desc(), F.col(user), F.col(item)]
    return train.orderBy(*order).limit(n).select(user).distinct()


def hit_percentile_range(
    df: DataFrame, rating: str = "rating", rank: str = "percent_rank", formatted: bool = False
) -> DataFrame:
    """Where purchased items stand in the ranked list: smallest and largest rank, in percent."""
    hit = df.filter(F.col(rating) * F.col(rank) > 0)
    span = hit.agg((F.min(rank) * 100).alias("min_percent"), (F.max(rank) * 100).alias("max_percent"))
    return format_report(span, percents=["min_percent", "max_percent"]) if formatted else span


def fd_violations(df: DataFrame, key: str, dep: str) -> DataFrame:
    """Keys with more than one value of a column that should depend on them."""
    counted = df.groupBy(key).agg(F.count_distinct(dep).alias("distinct_values"))
    return counted.filter(F.col("distinct_values") > 1)


def duplicate_keys(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    counts = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("count"))
    return counts.filter(F.col("count") > 1)


def null_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """NULL count per column, all columns in one pass."""
    cols = list(cols or df.columns)
    entries: list[Column] = [
        F.struct(
            F.lit(c).alias("column"),
            F.count_if(F.col(c).isNull()).alias("nulls"),
            F.count(F.lit(1)).alias("rows"),
        )
        for c in cols
    ]
    return df.agg(F.array(*entries).alias("s")).select(F.inline("s"))
