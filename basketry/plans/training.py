"""From order lines to the training frame: one lazy plan from the scan to the preferences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import decay_weight, resolve_parent, split_group
from ..operators.filters import filter_category, filter_orders
from ..operators.splits import chrono_split
from ..session import freeze, scratch_path, shuffles_removed, stage_scope
from ..sources import read_orders, write_frame

USER, ITEM = "CUST_ID", "PROD_TITLE_PARENT_PROD_ID"


def market_lines(
    orders: DataFrame, site: str, country: str | None = None, exclude_brands: Sequence[str] = ()
) -> DataFrame:
    """Order lines of a market with resolved parent products; filters sit right on the scan."""
    return resolve_parent(split_group(filter_orders(orders, site, country, exclude_brands)))


def preferences(
    lines: DataFrame,
    min_total: float | None = 2,
    user: str = USER,
    item: str = ITEM,
    qty: str = "PROD_QTY",
    ts: str = "ORDER_DT",
    decayed: str = "Timedecay",
) -> DataFrame:
    """One row per (user, item): total quantity, last order and decayed weight.

    Pairs with a total of ``min_total`` or less are dropped; None keeps all.
    """
    totals = lines.groupBy(user, item).agg(
        F.sum(qty).alias("PROD_QTY_SUM"),
        F.max(ts).alias("PARENT_PROD_LAST_ORDER_DT"),
        F.sum(decayed).alias("Timedecay_SUM"),
    )
    return totals if min_total is None else totals.filter(F.col("PROD_QTY_SUM") > min_total)


def decayed_preferences(
    lines: DataFrame, pattern: str, min_total: float | None = 2, t_ref: Column | None = None
) -> DataFrame:
    """Preferences of a product category; the decay refers to the newest of all given lines."""
    return preferences(filter_category(decay_weight(lines, t_ref=t_ref), pattern), min_total)


def stored_split(
    lines: DataFrame, name: str = "split-lines", keep: Sequence[str] | None = None, **split_options
) -> DataFrame:
    """``chrono_split`` written once, one folder per part, and read back.

    Training, validation and the reference date of the decay all read the split; a written table
    keeps the ordering work from being repeated for each, and a filter on ``split`` reads one folder.
    ``keep`` names the columns that are written; the others only decide the order. The split reads
    its input twice, so ``lines`` are stored until it is written and their joins run once.
    """
    spark = lines.sparkSession
    path = scratch_path(spark, name)
    with stage_scope(spark, own_thread=True):
        parts = chrono_split(freeze(lines), **split_options)
        with shuffles_removed(spark):
            write_frame(parts if keep is None else parts.select(*keep, "split"), path, partition_by=["split"])
    return read_orders(spark, path)


def held_out_pairs(
    lines: DataFrame, user: str = USER, item: str = ITEM, qty: str = "PROD_QTY", out: str = "rating"
) -> DataFrame:
    """Validation or test rows as one row per (user, item)."""
    return lines.groupBy(user, item).agg(F.sum(qty).alias(out))
