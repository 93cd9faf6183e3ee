"""Properties of recommendation lists beyond accuracy: coverage, novelty, diversity, serendipity.

``similarity`` is the output of ``item_similarity`` over the training pairs. It is the costly part
and is passed in, so that the caller computes and stores it once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...session import freeze
from ..pairs import item_similarity, pairs_within


def _similarity_of(pairs: DataFrame, similarity: DataFrame) -> DataFrame:
    looked_up = pairs.join(
        similarity.select("item_a", "item_b", "similarity"), ["item_a", "item_b"], "left"
    )
    same = F.col("item_a") == F.col("item_b")
    value = F.when(same, F.lit(1.0)).otherwise(F.coalesce(F.col("similarity"), F.lit(0.0)))
    return looked_up.withColumn("similarity", value)


def user_diversity(
    reco: DataFrame, similarity: DataFrame, user: str = "user", item: str = "item"
) -> DataFrame:
    """1 - mean similarity of the item pairs in each user's list (lists of two or more items)."""
    pairs = pairs_within(reco, user, item)
    return _similarity_of(pairs, similarity).groupBy(user).agg(
        (1 - F.avg("similarity")).alias("diversity")
    )


def user_serendipity(
    train: DataFrame,
    reco: DataFrame,
    similarity: DataFrame,
    user: str = "user",
    item: str = "item",
    relevance: str | None = None,
) -> DataFrame:
    """Mean over a user's list of relevance * (1 - mean similarity to the user's history)."""
    weight: Column = F.lit(1.0) if relevance is None else F.col(relevance).cast("double")
    listed = reco.groupBy(user, item).agg(F.max(weight).alias("__relevance"))
    history = train.select(user, F.col(item).alias("__past")).distinct()
    met = listed.join(history, user).select(
        user,
        item,
        "__relevance",
        F.least(item, "__past").alias("item_a"),
        F.greatest(item, "__past").alias("item_b"),
    )
    per_item = _similarity_of(met, similarity).groupBy(user, item).agg(
        (F.max("__relevance") * (1 - F.avg("similarity"))).alias("__value")
    )
    return per_item.groupBy(user).agg(F.avg("__value").alias("serendipity"))


def coverage(train: DataFrame, reco: DataFrame, item: str = "item") -> DataFrame:
    """One row: catalog_coverage and distributional_coverage (entropy in bits)."""
    n_train = train.select(F.count_distinct(item)).scalar()
    total = reco.select(F.count(F.lit(1))).scalar()
    share = F.col("n") / F.nullif(total, F.lit(0).cast("long"))
    per_item = reco.groupBy(item).agg(F.count(F.lit(1)).alias("n"))
    return per_item.agg(
        F.count(F.lit(1)).alias("__items"), (-F.sum(share * F.log2(share))).alias("distributional_coverage")
    ).select(
        (F.col("__items") / F.nullif(n_train, F.lit(0).cast("long"))).alias("catalog_coverage"),
        "distributional_coverage",
    )


def novelty(train: DataFrame, reco: DataFrame, item: str = "item") -> DataFrame:
    """One row: mean information, in bits, of the recommended items' share of the training rows.

    Recommended rows of an item without a training row have no such share; ``untrained`` counts
    them. Both frames are counted per item before they meet.
    """
    rows = F.nullif(train.select(F.count(F.lit(1))).scalar(), F.lit(0).cast("long"))
    seen = train.groupBy(item).agg(F.count(F.lit(1)).alias("seen"))
    listed = reco.groupBy(item).agg(F.count(F.lit(1)).alias("listed"))
    bits = -F.log2(F.col("seen") / rows)
    known = F.when(F.col("seen").isNotNull(), F.col("listed"))
    return listed.join(seen, item, "left").agg(
        (F.sum(known * bits) / F.sum(known)).alias("novelty"),
        F.coalesce(F.sum(F.when(F.col("seen").isNull(), F.col("listed"))), F.lit(0)).alias("untrained"),
    )


def diversity_metrics(
    train: DataFrame,
    reco: DataFrame,
    similarity: DataFrame | None = None,
    user: str = "user",
    item: str = "item",
    relevance: str | None = None,
) -> DataFrame:
    """One row with all five values."""
    if similarity is None:
        similarity = freeze(item_similarity(train, user, item))  # two metrics read it
    mean_diversity = user_diversity(reco, similarity, user, item).agg(F.avg("diversity")).scalar()
    surprise = user_serendipity(train, reco, similarity, user, item, relevance)
    return coverage(train, reco, item).select(
        "catalog_coverage",
        "distributional_coverage",
        novelty(train, reco, item).select("novelty").scalar().alias("novelty"),
        mean_diversity.alias("diversity"),
        surprise.agg(F.avg("serendipity")).scalar().alias("serendipity"),
    )
