"""Column-level preparation: no shuffle, everything inside whole-stage codegen."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The half-life of a purchase in days, and the two date layouts of order extracts.
HALF_LIFE_DAYS = 180
TIMESTAMP_LAYOUT = "yyyy-MM-dd HH:mm:ss"
DAY_FIRST_LAYOUT = "dd/MM/yyyy"


def split_group(
    df: DataFrame,
    col: str = "PROD_GRP",
    sep: str = ":",
    raw: str = "PGG_PROD_GRP",
    head: str = "PGG",
    tail: str = "PROD_GRP",
) -> DataFrame:
    """Keep the composite text as ``raw`` and split it; a missing second part is NULL."""
    parts = F.split(F.col(raw), "\\Q" + sep + "\\E")
    return (
        df.withColumn(raw, F.col(col))
        .withColumn(head, F.get(parts, F.lit(0)))
        .withColumn(tail, F.get(parts, F.lit(1)))
    )


def resolve_parent(
    df: DataFrame,
    parent_id: str = "PROD_TITLE_PARENT_PROD_ID",
    parent_title: str = "PROD_TITLE_PARENT_TITLE",
    own_id: str = "PROD_ID",
    own_title: str = "PROD_TITLE",
) -> DataFrame:
    """Products without a parent id stand for themselves; the id decides about the title as well."""
    orphan = F.col(parent_id).isNull()
    resolved = {
        parent_id: F.when(orphan, F.col(own_id)).otherwise(F.col(parent_id)),
        parent_title: F.when(orphan, F.col(own_title)).otherwise(F.col(parent_title)),
    }
    return df.withColumns(resolved)


def zero_fill(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """NULL becomes 0 in numeric columns; other columns are left alone."""
    return df.fillna(0, subset=list(cols)) if cols is not None else df.fillna(0)


def decay_weight(
    df: DataFrame,
    qty: str = "PROD_QTY",
    ts: str = "ORDER_DT",
    half_life: float = HALF_LIFE_DAYS,
    t_ref: Column | None = None,
    out: str = "Timedecay",
) -> DataFrame:
    """``qty * 0.5 ** (days before t_ref / half_life)``.

    Without ``t_ref`` the newest timestamp of ``df`` is used, as a scalar subquery of the same plan.
    """
    if t_ref is None:
        t_ref = df.select(F.max(ts)).scalar()
    age = F.datediff(t_ref, F.col(ts)) / F.lit(float(half_life))
    return df.withColumn(out, F.col(qty) * F.pow(F.lit(0.5), age))


def format_report(
    df: DataFrame, counts: Sequence[str] = (), percents: Sequence[str] = ()
) -> DataFrame:
    """Counts with thousands separators, percentages with two decimals and a percent sign."""
    texts = {c: F.format_number(F.col(c), 0) for c in counts}
    texts |= {
        c: F.concat(F.format_number(F.col(c).cast("double"), 2), F.lit("%"))
        for c in percents
    }
    return df.withColumns(texts) if texts else df


def parse_date_columns(
    df: DataFrame,
    pattern: str = "_DT$",
    formats: Mapping[str, str] | None = None,
    default_format: str = DAY_FIRST_LAYOUT,
) -> DataFrame:
    """Parse every text column whose name matches ``pattern``; unreadable text becomes NULL."""
    if formats is None:
        formats = {"INVOICE_DT": TIMESTAMP_LAYOUT, "ORDER_DT": TIMESTAMP_LAYOUT}
    parsed = {}
    for name, dtype in df.dtypes:
        if dtype == "string" and re.search(pattern, name):
            layout = F.lit(formats.get(name, default_format))
            parsed[name] = F.try_to_timestamp(F.col(name), layout).cast("timestamp_ntz")
    return df.withColumns(parsed) if parsed else df


def cast_columns(df: DataFrame, from_types: Sequence[str], to: str = "string") -> DataFrame:
    """Cast all columns of the given types."""
    wanted = {name: F.col(name).cast(to) for name, dtype in df.dtypes if dtype in from_types}
    return df.withColumns(wanted) if wanted else df


def columns_like(df: DataFrame, pattern: str) -> DataFrame:
    """Only the columns whose name matches the regular expression."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if re.search(pattern, c)])
