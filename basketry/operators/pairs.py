"""Items that share a basket or a customer, and what follows from their counts.

The number of pairs is quadratic in the size of a basket or history. An ordinary group is one list,
whose items are paired inside a task. The members of a large group are spread over blocks that are joined
on (group, block, block): each task then meets at most two blocks of the group, and every
pair still appears exactly once. Tasks are cut by the number of rows and pairs, which bounds their memory.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import freeze
from .neighbours import similar_by_vector
from .ordered import positions, split_counted, split_hot, tasks_for, top_k

# Members of one block of a large group: at most this number squared pairs per join key.
BLOCK_MEMBERS = 1_000
# Rows whose groups one task gathers, and pairs that one task counts.
TASK_MEMBERS = 500_000
TASK_PAIRS = 1_000_000
# Scored pairs of one task, before they are added up; similarities that are sent to every task.
TASK_MET = 4_000_000
SENT_SIMILARITIES = 500_000
# Items of a user above which the user's scores are added up over several tasks.
HOT_HISTORY = 100_000


def _ordered(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b), F.greatest(a, b)


def _split_rows(df: DataFrame, group: str, item: str, block_members: int):
    """(rows of ordinary groups without repeats, dealt to tasks by group, rows of large groups or None)."""
    rows = df.select(group, item).filter(F.col(group).isNotNull() & F.col(item).isNotNull())
    ordinary, large, n = split_counted(rows, [group], block_members)
    dealt = ordinary.repartition(tasks_for(df, n, TASK_MEMBERS), group)
    return dealt.dropDuplicates([group, item]), large


def _baskets(members: DataFrame, group: str, item: str) -> DataFrame:
    """One row per group with its items in ascending order; ``block_members`` bounds the list."""
    return members.groupBy(group).agg(F.sort_array(F.collect_list(item)).alias("__items"))


def _pairs_of_baskets(baskets: DataFrame, *keep: str) -> DataFrame:
    """Every item of a list next to every later one."""
    size = F.size("__items")
    first = baskets.select(*keep, "__items", F.posexplode("__items").alias("__pos", "item_a"))
    later = F.slice("__items", F.col("__pos") + 2, size - 1 - F.col("__pos"))
    first = first.filter(F.col("__pos") < size - 1)
    return first.select(*keep, "item_a", F.explode(later).alias("item_b"))


def pairs_of_large(large: DataFrame, group: str, item: str, block_members: int = BLOCK_MEMBERS) -> DataFrame:
    """The pairs of large groups, in blocks."""
    members = freeze(large.distinct())
    sizes = members.groupBy(group).agg(F.count(F.lit(1)).alias("__members"))
    blocks = F.ceil(F.col("__members") / F.lit(float(block_members)))
    members = members.join(sizes, group).select(
        group,
        item,
        blocks.alias("__blocks"),
        F.pmod(F.xxhash64(item), blocks).alias("__own"),
    )
    first = members.select(
        group,
        F.col(item).alias("__left"),
        F.col("__own").alias("__i"),
        F.explode(F.sequence(F.col("__own"), F.col("__blocks") - 1)).alias("__j"),
    )
    second = members.select(
        group,
        F.col(item).alias("__right"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("__own"))).alias("__i"),
        F.col("__own").alias("__j"),
    )
    met = first.join(second, [group, "__i", "__j"]).filter(
        (F.col("__i") < F.col("__j")) | (F.col("__left") < F.col("__right"))
    )
    low, high = _ordered(F.col("__left"), F.col("__right"))
    return met.select(group, low.alias("item_a"), high.alias("item_b"))


def pairs_within(
    df: DataFrame, group: str, item: str, block_members: int = BLOCK_MEMBERS
) -> DataFrame:
    """Distinct unordered item pairs per group: (group, item_a, item_b) with item_a < item_b."""
    members, large = _split_rows(df, group, item, block_members)
    pairs = _pairs_of_baskets(_baskets(members, group, item), group)
    if large is None:
        return pairs
    return pairs.unionByName(pairs_of_large(large, group, item, block_members))


def basket_pairs(lines: DataFrame, order: str = "BE_ORDER_ID", item: str = "SKU") -> DataFrame:
    """Item pairs bought in the same order."""
    return pairs_within(lines, order, item)


def pair_counts(df: DataFrame, group: str, item: str, block_members: int = BLOCK_MEMBERS) -> DataFrame:
    """Number of groups in which both items of a pair occur.

    The lists are stored first, so the pairs to come are known and dealt to tasks of ``TASK_PAIRS``.
    Each counts the pairs of its own groups, and the counts of a pair are then added up.
    """
    members, large = _split_rows(df, group, item, block_members)
    baskets = freeze(_baskets(members, group, item).filter(F.size("__items") > 1))
    size = F.size("__items").cast("long")
    tasks = tasks_for(df, baskets.agg(F.sum(size * (size - 1) / 2)).first()[0] or 0, TASK_PAIRS)
    # Several groups of baskets in one task even out their sizes.
    part = F.pmod(F.xxhash64(group), F.lit(tasks * 4)).alias("__part")
    dealt = baskets.select(part, "__items").repartition(tasks, "__part")
    counts = _pairs_of_baskets(dealt, "__part").groupBy("__part", "item_a", "item_b").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select("item_a", "item_b", "n")
    if large is not None:
        heavy = pairs_of_large(large, group, item, block_members).groupBy("item_a", "item_b")
        counts = counts.unionByName(heavy.agg(F.count(F.lit(1)).alias("n")))
    # Nothing is left to combine before this shuffle.
    counts = counts.repartition(tasks, "item_a", "item_b")
    return counts.groupBy("item_a", "item_b").agg(F.sum("n").alias("together"))


def item_similarity(
    inter: DataFrame,
    user: str = "user",
    item: str = "item",
    measure: str = "cosine",
    min_together: int = 1,
) -> DataFrame:
    """Similarity of item pairs that share at least ``min_together`` users (item_a < item_b).

    cosine: c_ij / sqrt(c_i * c_j); jaccard: c_ij / (c_i + c_j - c_ij); count: c_ij. Items with
    fewer users than the minimum cannot reach it and leave before the self-join.
    """
    paired = inter
    if min_together > 1:
        users = inter.select(user, item).distinct().groupBy(item).agg(F.count(user).alias("c"))
        paired = inter.join(users.filter(F.col("c") >= min_together).select(item), item, "left_semi")
    together = pair_counts(paired, user, item).filter(F.col("together") >= min_together)
    if measure == "count":
        return together.withColumn("similarity", F.col("together").cast("double"))
    single = (
        inter.select(user, item)
        .filter(F.col(user).isNotNull() & F.col(item).isNotNull())
        .distinct()
        .groupBy(item)
        .agg(F.count(F.lit(1)).alias("c"))
    )
    counted = together.join(
        single.select(F.col(item).alias("item_a"), F.col("c").alias("c_a")), "item_a"
    ).join(single.select(F.col(item).alias("item_b"), F.col("c").alias("c_b")), "item_b")
    both, c_a, c_b = F.col("together"), F.col("c_a"), F.col("c_b")
    formulas = {
        "cosine": both / F.sqrt(c_a.cast("double") * c_b),
        "jaccard": both / (c_a + c_b - both),
    }
    return counted.select("item_a", "item_b", "together", formulas[measure].alias("similarity"))


def both_directions(pairs: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Each unordered pair as (item, other) and (other, item)."""
    directed = F.explode(
        F.array(
            F.struct(F.col("item_a").alias("item"), F.col("item_b").alias("other")),
            F.struct(F.col("item_b").alias("item"), F.col("item_a").alias("other")),
        )
    )
    return pairs.select(directed.alias("d"), *keep).select("d.item", "d.other", *keep)


def score_by_similarity(
    history: DataFrame,
    similarity: DataFrame,
    user: str = "user",
    item: str = "item",
    decimals: int = 6,
) -> DataFrame:
    """Score = sum of similarities to the user's items, rounded so that ties are reproducible.

    Covers cold users as soon as they have one purchase; the seen items are scored as well.
    """
    neighbours = both_directions(similarity, ["similarity"]).withColumnsRenamed(
        {"item": item, "other": "__candidate"}
    )
    # What will be met: rows of an item times its neighbours.
    degrees = neighbours.groupBy(item).agg(F.count(F.lit(1)).alias("__degree"))
    held = history.groupBy(item).agg(F.count(F.lit(1)).alias("__held")).join(degrees, item)
    sums = held.agg(F.sum(F.col("__held") * F.col("__degree"))).first()
    links = degrees.agg(F.sum("__degree")).first()[0] or 0
    tasks = tasks_for(history, sums[0] or 0, TASK_MET)
    few = links <= 2 * SENT_SIMILARITIES
    if few:
        neighbours = F.broadcast(neighbours)
    ordinary, hot = split_hot(history.select(user, item), [user], HOT_HISTORY)

    def added(met: DataFrame) -> DataFrame:
        return met.groupBy(user, "__candidate").agg(F.round(F.sum("similarity"), decimals).alias("prediction"))

    if few:  # users stay in the task that gathers their items
        met = ordinary.repartition(tasks, user).distinct().join(neighbours, item)
    else:
        met = ordinary.distinct().join(neighbours, item).repartition(tasks, user)
    scored = added(met)
    if hot is not None:
        scored = scored.unionByName(added(hot.distinct().join(neighbours, item)))
    return scored.withColumnRenamed("__candidate", item)


def bought_together(
    lines: DataFrame,
    order: str = "BE_ORDER_ID",
    item: str = "SKU",
    min_count: int = 2,
    n: int | None = None,
) -> DataFrame:
    """Products bought with a product: support, confidence and lift, best confidence first.

    Items in fewer than ``min_count`` orders cannot reach a qualifying pair and leave before the
    self-join, which changes no result.
    """
    lines = lines.select(order, item).filter(F.col(order).isNotNull() & F.col(item).isNotNull())
    tasks = tasks_for(lines, lines.count(), TASK_MEMBERS)
    lines = freeze(lines.repartition(tasks, order, item).distinct())
    n_orders = F.lit(lines.select(order).repartition(tasks, order).distinct().count()).cast("long")
    single = freeze(
        lines.repartition(tasks, item)
        .groupBy(item)
        .agg(F.count(F.lit(1)).alias("orders"))
        .filter(F.col("orders") >= min_count)
    )
    frequent = lines.repartition(tasks, item).join(single.select(item), item, "left_semi")
    pairs = pair_counts(frequent, order, item).filter(F.col("together") >= min_count)
    rules = (
        both_directions(pairs, ["together"])
        .join(single.select(F.col(item).alias("item"), F.col("orders").alias("item_orders")), "item")
        .join(single.select(F.col(item).alias("other"), F.col("orders").alias("other_orders")), "other")
    )
    together = F.col("together").cast("double")
    rules = rules.select(
        "item",
        "other",
        "together",
        (together / n_orders).alias("support"),
        (together / F.col("item_orders")).alias("confidence"),
        (together * n_orders / (F.col("item_orders").cast("double") * F.col("other_orders"))).alias("lift"),
    )
    if n is None:
        return rules
    return top_k(rules, n, user="item", item="other", score="confidence")


def similar_by_attributes(
    items: DataFrame,
    item: str,
    block: Sequence[str],
    numeric: str | Sequence[str],
    n: int = 5,
    section: int = 10_000,
) -> DataFrame:
    """The ``n`` items of equal ``block`` attributes closest in ``numeric`` (price, size, ...).

    Items without a value in a numeric attribute are left out.

    Several numeric attributes give the Euclidean distance over them, rounded to six decimals; scale
    them before the call. Equal distances are ordered by item. Large blocks are searched by cells,
    as in ``similar_by_vector``.

    A single attribute needs no pairs: along its sorted list the n closest items lie among the n
    before and the n after, so each item only looks at 2n neighbours. Blocks are cut into sections
    of consecutive positions, with n rows of the adjoining sections added, which keeps tasks small
    whatever the block size. Equal distances are ordered by steps along the list, which is sorted by
    value and item, then by position.
    """
    block = list(block)
    if not isinstance(numeric, str):
        point = F.array(*[F.col(c).cast("double") for c in numeric])
        known = items.dropna(subset=list(numeric)).select(
            F.col(item).alias("item"), point.alias("vector"), F.struct(*block).alias("label")
        )
        near = similar_by_vector(known, n, measure="euclidean")
        return near.select(
            F.col("item").alias(item),
            F.col("other").alias("alternative"),
            (-F.col("similarity")).alias("distance"),
            "rank",
        )
    kept = items.select(item, *block, numeric).filter(F.col(numeric).isNotNull())
    placed = positions(kept, block, [F.col(numeric).asc(), F.col(item).asc()], out="__pos")
    own = F.floor((F.col("__pos") - 1) / F.lit(section))
    low = F.floor(F.greatest(F.col("__pos") - 1 - n, F.lit(0)) / F.lit(section))
    high = F.floor((F.col("__pos") - 1 + n) / F.lit(section))
    shared = placed.withColumn("__own", own).withColumn(
        "__section", F.explode(F.sequence(low, high))
    )
    w = Window.partitionBy(*block, "__section").orderBy("__pos").rowsBetween(-n, n)
    around = shared.withColumn(
        "__near", F.collect_list(F.struct(F.col(item).alias("alternative"), F.col(numeric).alias("value"), F.col("__pos").alias("pos"))).over(w)
    ).filter(F.col("__section") == F.col("__own"))
    value, pos = F.col(numeric), F.col("__pos")
    measured = F.transform(
        F.filter("__near", lambda x: x["pos"] != pos),
        lambda x: F.struct(
            F.abs(x["value"] - value).alias("distance"),
            F.abs(x["pos"] - pos).alias("steps"),
            x["pos"].alias("pos"),
            x["alternative"].alias("alternative"),
        ),
    )
    best = F.slice(F.array_sort(measured), 1, n)
    listed = around.select(item, F.posexplode(best).alias("__rank", "__best"))
    return listed.select(
        item,
        F.col("__best.alternative").alias("alternative"),
        F.col("__best.distance").alias("distance"),
        (F.col("__rank") + 1).alias("rank"),
    )
