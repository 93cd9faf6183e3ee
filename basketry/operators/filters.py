"""Row filters. Apply them to raw columns, ahead of derived ones, so that they reach the scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def filter_orders(
    df: DataFrame,
    site: str,
    country: str | None = None,
    exclude_brands: Sequence[str] = (),
    min_revenue: float = 0,
    site_col: str = "SITE",
    brand_col: str = "BRAND",
    country_col: str = "SHIP_TO_COUNTRY",
    revenue_col: str = "PROD_REV_USD",
) -> DataFrame:
    """One market: site, country, brands left out, revenue above a bound.

    NULL in a column that is filtered on drops the row. Without ``country`` all countries stay.
    """
    kept = (F.col(site_col) == site) & (F.col(revenue_col) > min_revenue)
    if country is not None:
        kept &= F.col(country_col) == country
    if exclude_brands:
        kept &= ~F.col(brand_col).isin(list(exclude_brands))
    return df.filter(kept)


def filter_category(df: DataFrame, pattern: str, col: str = "PGG_PROD_GRP") -> DataFrame:
    """Case-sensitive LIKE on the product group."""
    return df.filter(F.col(col).like(pattern))


def null_rows(df: DataFrame, col: str) -> DataFrame:
    return df.filter(F.col(col).isNull())


def restrict_to_keys(df: DataFrame, keys: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows whose key occurs in ``keys``; columns and multiplicity of ``df`` are unchanged."""
    return df.join(keys, on, "left_semi")
