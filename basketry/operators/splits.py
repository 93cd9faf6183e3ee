"""Train / validation / test splits and folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import freeze
from .ordered import HOT_ROWS, positions

# Fixed values of the integer fold formula: coefficients and modulus.
FOLD_USER_FACTOR = 1_000_003
FOLD_ITEM_FACTOR = 7_919
FOLD_SEED_FACTOR = 104_729
FOLD_MODULUS = 1_000_000_007


def chrono_split(
    df: DataFrame,
    user: str = "CUST_ID",
    ts: str = "ORDER_DT",
    ratios: Sequence[float] = (0.6, 0.2, 0.2),
    tiebreak: Sequence[str] = (),
    names: Sequence[str] = ("train", "valid", "test"),
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Label each row with its part: the oldest rows of every user first.

    The parts are cut one after the other, each from what is left, rounding half to even.
    ``tiebreak`` columns make the order of simultaneous rows reproducible; without any, all other
    columns that can be ordered do.
    """
    if len(ratios) != len(names):
        raise ValueError("one name per ratio")
    if not tiebreak:
        unordered = ("map", "variant")
        tiebreak = [c for c, t in df.dtypes if c not in (user, ts) and not any(w in t for w in unordered)]
    order = [F.col(c).asc() for c in (ts, *tiebreak)]
    numbered = positions(df, [user], order, out="__rn", total="__n", hot_rows=hot_rows)
    rest, taken = F.col("__n"), F.lit(0).cast("long")
    label: Column | None = None
    for i, name in enumerate(names[:-1]):
        share = float(ratios[i]) / float(sum(ratios[i:]))
        size = F.bround(F.lit(share) * rest).cast("long")
        taken, rest = taken + size, rest - size
        inside = F.col("__rn") <= taken
        label = F.when(inside, name) if label is None else label.when(inside, name)
    last = F.lit(names[-1])
    label = last if label is None else label.otherwise(last)
    return numbered.withColumn("split", label).drop("__rn", "__n")


def split_report(parts: DataFrame, col: str = "split") -> DataFrame:
    """Rows per part and the total they add up to."""
    counts = parts.groupBy(col).agg(F.count(F.lit(1)).alias("rows"))
    return counts.withColumn("total", parts.select(F.count(F.lit(1))).scalar())


def kfold(
    df: DataFrame, k: int = 5, keys: Sequence[str] = ("user", "item"), seed: int = 1, out: str = "fold"
) -> DataFrame:
    """Fold number of each row, a pure function of its keys: the same on any layout or retry.

    Two integer keys use the arithmetic formula, in which NULL counts as 0, other keys Spark's
    64-bit hash. Every row gets a fold.
    """
    types = dict(df.dtypes)
    integral = {"tinyint", "smallint", "int", "bigint"}
    if len(keys) == 2 and all(types[c] in integral for c in keys):
        u, i = (F.coalesce(F.pmod(F.col(c).cast("long"), F.lit(FOLD_MODULUS)), F.lit(0)) for c in keys)
        mixed = u * FOLD_USER_FACTOR + i * FOLD_ITEM_FACTOR + F.lit(seed * FOLD_SEED_FACTOR)
        fold = F.pmod(F.pmod(mixed, F.lit(FOLD_MODULUS)), F.lit(k))
    else:
        fold = F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(k))
    return df.withColumn(out, fold.cast("int"))


def fold_pair(df: DataFrame, fold: int, col: str = "fold") -> tuple[DataFrame, DataFrame]:
    """(training rows, held-out rows) of one fold."""
    return df.filter(F.col(col) != fold).drop(col), df.filter(F.col(col) == fold).drop(col)


def random_split(df: DataFrame, weights: Sequence[float], seed: int = 1) -> DataFrame:
    """Weighted random parts, numbered in ``part``; every row is in exactly one of them.

    One pass draws a number per row and stores the labelled rows. The draw depends on the physical
    layout of ``df``.
    """
    total, edge = float(sum(weights)), 0.0
    label = F.lit(len(weights) - 1)
    edges = []
    for w in weights[:-1]:
        edge += w / total
        edges.append(edge)
    for i in reversed(range(len(edges))):
        label = F.when(F.col("__draw") < edges[i], i).otherwise(label)
    return freeze(df.withColumn("__draw", F.rand(seed)).withColumn("part", label).drop("__draw"))
