"""Retail scenarios on top of scores and lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import top_k
from ..session import freeze
from .model import TOP_K, fit_als, recommend_unseen


def personalize(train: DataFrame, k: int = TOP_K, **params) -> DataFrame:
    """Fit, recommend for every user, leave out what the user already has, keep the k best."""
    return recommend_unseen(fit_als(train, **params), train, k)


def popularity(inter: DataFrame, user: str = "user", item: str = "item") -> DataFrame:
    """Items with the number of users that have them."""
    return inter.select(user, item).distinct().groupBy(item).agg(
        F.count(F.lit(1)).cast("double").alias("prediction")
    )


def with_fallback(
    recs: DataFrame,
    users: DataFrame,
    popular: DataFrame,
    k: int = TOP_K,
    user: str = "user",
    item: str = "item",
    score: str = "prediction",
) -> DataFrame:
    """Give every user without recommendations the k most popular items.

    The k items travel as one array value, so the cold users are never joined to the item table. The
    lists are read twice, for their rows and for their users, so they are stored first.
    """
    recs = freeze(recs.select(user, item, score))
    best = popular.orderBy(F.col(score).desc(), F.col(item)).limit(k)
    shelf = best.agg(F.collect_list(F.struct(item, score))).scalar()
    cold = users.select(user).distinct().join(recs.select(user), user, "left_anti")
    filled = cold.select(user, F.explode(shelf).alias("__pick")).select(
        user, f"__pick.{item}", f"__pick.{score}"
    )
    personal = recs.withColumn("source", F.lit("model"))
    return personal.unionByName(filled.withColumn("source", F.lit("popular")))


def rerank(
    recs: DataFrame,
    boosts: DataFrame,
    k: int = TOP_K,
    user: str = "user",
    item: str = "item",
    score: str = "prediction",
    factor: str = "factor",
) -> DataFrame:
    """Multiply scores by an item's business factor (1 where none is given), then take the k best."""
    boosted = recs.join(boosts.select(item, factor), item, "left")
    adjusted = F.col(score) * F.coalesce(F.col(factor), F.lit(1.0))
    return top_k(boosted.select(user, item, adjusted.alias(score)), k, user, item, score, rank="rank")


def ctr(
    events: DataFrame,
    by: Sequence[str] = (),
    kind: str = "event_type",
    shown: str = "view",
    clicked: str = "click",
) -> DataFrame:
    """Clicks per view, overall or per group; NULL without views."""
    counts = events.groupBy(*by).agg(
        F.count_if(F.col(kind) == shown).alias("views"),
        F.count_if(F.col(kind) == clicked).alias("clicks"),
    )
    rate = F.col("clicks") / F.nullif(F.col("views"), F.lit(0).cast("long"))
    return counts.withColumn("ctr", rate)


def revenue_per_order(
    lines: DataFrame, order: str = "BE_ORDER_ID", revenue: str = "PROD_REV_USD"
) -> DataFrame:
    """Orders, revenue and revenue per order."""
    per_order = lines.groupBy(order).agg(F.sum(revenue).alias("__revenue"))
    return per_order.agg(
        F.count(order).alias("orders"),
        F.sum("__revenue").alias("revenue"),
        (F.sum("__revenue") / F.nullif(F.count(order), F.lit(0).cast("long"))).alias("revenue_per_order"),
    )


def ab_test(
    events: DataFrame,
    bucket: str,
    a=0,
    b=1,
    kind: str = "event_type",
    trials: Sequence[str] = ("view", "click"),
    success: str = "click",
) -> DataFrame:
    """Success rates of two variants, their difference and its z score (pooled two-proportion test).

    Every event of the ``trials`` kinds is one trial; those of kind ``success`` succeed. The rate is
    therefore clicks over views and clicks together, a share, while ``ctr`` is clicks per view.
    """

    def count_of(variant, condition):
        return F.count_if((F.col(bucket) == variant) & condition)

    tried, won = F.col(kind).isin(list(trials)), F.col(kind) == success
    counts = events.agg(
        count_of(a, tried).alias("trials_a"),
        count_of(a, won).alias("successes_a"),
        count_of(b, tried).alias("trials_b"),
        count_of(b, won).alias("successes_b"),
    )
    zero = F.lit(0).cast("long")
    n_a, n_b = (F.nullif(F.col(c), zero) for c in ("trials_a", "trials_b"))
    rates = counts.withColumns(
        {
            "rate_a": F.col("successes_a") / n_a,
            "rate_b": F.col("successes_b") / n_b,
            "__pooled": (F.col("successes_a") + F.col("successes_b")) / (n_a + n_b),
        }
    )
    pooled = F.col("__pooled")
    spread = F.nullif(F.sqrt(pooled * (1 - pooled) * (1 / n_a + 1 / n_b)), F.lit(0.0))
    difference = F.col("rate_b") - F.col("rate_a")
    return rates.select(
        *counts.columns,
        "rate_a",
        "rate_b",
        difference.alias("difference"),
        (difference / spread).alias("z_score"),
    )
