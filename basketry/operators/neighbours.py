"""Nearest neighbours by vector inside blocks, exact, in bounded matrix products.

A block of at most one tile is one product. A larger block is cut into cells around pivots, each with
the least and largest distance of its members from the pivot. By the triangle inequality these bound
how close a cell can come to a vector, and a vector only travels to cells that can still change its
list of the k best. Vectors that occur many times are searched for once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import freeze
from .ordered import same_key, top_k

# Pivots, and so cells, of a block at most; a cell larger than a tile is cut by hash.
MAX_CELLS = 256
# Vectors that ask one tile in one task.
ASKERS = 8_192
# Room for the rounding of distances.
SLACK = 1e-6


def _scores(q: np.ndarray, c: np.ndarray, decimals: int, measure: str) -> np.ndarray:
    """Rounded scores, larger is closer; cosine vectors have length 1."""
    if measure == "cosine":
        return np.round(q @ c.T, decimals)
    # Attribute by attribute: differences stay exact where a product would cancel.
    square = np.zeros((len(q), len(c)))
    for d in range(q.shape[1]):
        square += (q[:, None, d] - c[None, :, d]) ** 2
    return np.round(-np.sqrt(square), decimals)


def _directed(vectors: pd.Series, measure: str) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype("float64")
    return x / np.linalg.norm(x, axis=1, keepdims=True) if measure == "cosine" else x


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k best scores per row; columns are in id order, which breaks ties."""
    return np.argsort(-scores, axis=1, kind="stable")[:, :k]


def _whole_block(k: int, decimals: int, measure: str):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("item")
        ids, x = rows["item"].to_numpy(), _directed(rows["vector"], measure)
        out = []
        for i in range(0, len(ids), 1_024):
            scores = _scores(x[i : i + 1_024], x, decimals, measure)
            scores[ids[i : i + 1_024, None] == ids[None, :]] = -np.inf
            best = _best(scores, k)
            found = np.take_along_axis(scores, best, axis=1).ravel()
            part = pd.DataFrame({"item": np.repeat(ids[i : i + 1_024], best.shape[1]), "other": ids[best].ravel(), "similarity": found})
            out.append(part[np.isfinite(found)])
        return pd.concat(out)

    return run


def _nearest_pivot(measure: str):
    def run(rows: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop(columns="hand")
        if rows.empty:
            return rows.assign(cell=[], off=[])
        x, p = _directed(rows["vector"], measure), _directed(pivots["vector"], measure)
        cells = pivots["cell"].to_numpy()
        off = _distances(x, p)
        near = off.argmin(axis=1)
        return rows.assign(vector=list(x), cell=cells[near], off=off[np.arange(len(x)), near])

    return run


def _distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    square = (x * x).sum(axis=1)[:, None] + (p * p).sum(axis=1)[None, :] - 2 * (x @ p.T)
    return np.sqrt(np.maximum(square, 0))


def _own_tile(k: int, decimals: int, measure: str):
    """The k best inside a tile, and the cells that may hold better ones."""

    def run(rows: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("item")
        asks = rows["asks"].to_numpy(bool)
        asking = rows[asks]
        if asking.empty:
            none = pd.Series([], dtype=object)
            kept = asking[["block", "item", "vector", "cell", "sub"]]
            return kept.assign(floor=np.empty(0), targets=none, others=none, similarities=none)
        ids, x = rows["item"].to_numpy(), np.stack(rows["vector"].to_numpy())
        q = x[asks]
        scores = _scores(q, x, decimals, measure)
        best = _best(scores, k)
        found = np.take_along_axis(scores, best, axis=1)
        floor = found[:, -1] if best.shape[1] == k else np.full(len(q), -np.inf)
        pivots = np.stack(cells["vector"].to_numpy())
        low, high, subs = (cells[c].to_numpy() for c in ("low", "high", "subs"))
        off = _distances(q, pivots)
        least = np.maximum(np.maximum(off - high, low - off) - SLACK, 0)
        most = 1 - least**2 / 2 if measure == "cosine" else -least
        reached = most >= floor[:, None] - 10.0**-decimals
        reached[:, (cells["cell"] == rows["cell"].iloc[0]).to_numpy() & (subs == 1)] = False
        codes = cells["cell"].to_numpy().astype("int64") << 32 | subs
        return pd.DataFrame(
            {
                "block": asking["block"].to_numpy(),
                "item": asking["item"].to_numpy(),
                "vector": list(q),
                "cell": asking["cell"].to_numpy(),
                "sub": asking["sub"].to_numpy(),
                "floor": floor,
                "targets": [codes[r] for r in reached],
                "others": list(ids[best]),
                "similarities": list(found),
            }
        )

    return run


def _asked_tile(k: int, decimals: int, measure: str):
    def run(asking: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if asking.empty or rows.empty:
            ids = asking["item"].iloc[:0]
            return pd.DataFrame({"item": ids, "other": ids, "similarity": np.empty(0)})
        rows = rows.sort_values("item")
        ids, x = rows["item"].to_numpy(), np.stack(rows["vector"].to_numpy())
        out = []
        for i in range(0, len(asking), 1_024):
            part = asking.iloc[i : i + 1_024]
            scores = _scores(np.stack(part["vector"].to_numpy()), x, decimals, measure)
            best = _best(scores, k)
            found = np.take_along_axis(scores, best, axis=1)
            r, c = np.nonzero(found >= part["floor"].to_numpy()[:, None])
            out.append(pd.DataFrame({"item": part["item"].to_numpy()[r], "other": ids[best[r, c]], "similarity": found[r, c]}))
        return pd.concat(out)

    return run


def similar_by_vector(
    vectors: DataFrame,
    k: int = 5,
    item: str = "item",
    vector: str = "vector",
    block: str = "label",
    tile: int = 2_048,
    decimals: int = 6,
    measure: str = "cosine",
) -> DataFrame:
    """The ``k`` most similar items of the same block, exact; ids of any type.

    ``cosine``, or ``euclidean``: the distance with a minus sign. Similarities are rounded, equal ones
    ordered by id. Pairs are never written out as rows; blocks of more than ``tile`` items are
    searched by cells, and what travels grows with the cells that can still matter.
    For the cosine, zero vectors have no direction and are left out.
    """
    if measure not in ("cosine", "euclidean"):
        raise ValueError("measure is 'cosine' or 'euclidean'")
    rows = vectors.select(
        F.col(item).alias("item"), F.col(vector).alias("vector"), F.col(block).alias("block")
    ).filter(F.col("vector").isNotNull())
    if measure == "cosine":
        rows = rows.filter(F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x) > 0)
    kind = rows.schema["item"].dataType.simpleString()
    sizes = rows.groupBy(F.col("block").alias("__k_block")).agg(F.count(F.lit(1)).alias("rows"))
    large = sizes.filter(F.col("rows") > tile)
    is_large = same_key(["block"], "__k_")
    some = bool(large.take(1))
    if some:
        large = freeze(large)
    small = rows.join(large, is_large, "left_anti") if some else rows
    found = small.groupBy("block").applyInPandas(
        _whole_block(k, decimals, measure), f"item {kind}, other {kind}, similarity double"
    )
    if some:
        far = _by_cells(rows.join(large, is_large).drop("__k_block"), k, tile, decimals, measure)
        found = found.unionByName(far)
    return top_k(found, k, user="item", item="other", score="similarity", rank="rank")


def _equal(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join with NULL equal to NULL; the right side's key columns go."""
    renamed = right.withColumnsRenamed({c: "__k_" + c for c in on})
    return left.join(renamed, same_key(on, "__k_")).drop(*["__k_" + c for c in on])


def _by_cells(rows: DataFrame, k: int, tile: int, decimals: int, measure: str) -> DataFrame:
    """``item, other, similarity`` for blocks of many rows; ``rows`` is the size of the block."""
    item = rows.schema["item"].dataType.simpleString()
    block = rows.schema["block"].dataType.simpleString()
    # Among equal vectors only the k + 1 smallest ids can be on any list, and all ask alike.
    same = Window.partitionBy("block", "h1", "h2").orderBy("item")
    hashed = rows.withColumns({"h1": F.xxhash64("vector"), "h2": F.xxhash64(F.lit(1), "vector")})
    first = hashed.withColumn("place", F.row_number().over(same)).filter(F.col("place") <= k + 1)
    first = freeze(first.withColumn("asks", F.col("place") == 1).drop("place"))

    wanted = F.least(F.lit(MAX_CELLS), 4 * F.ceil(F.col("rows") / tile))
    drawn = Window.partitionBy("block").orderBy(F.xxhash64("h1", "h2"), "item")
    pivots = first.filter("asks").withColumn("cell", F.row_number().over(drawn)).filter(F.col("cell") <= MAX_CELLS)
    pivots = freeze(pivots.filter(F.col("cell") <= wanted).select("block", "rows", "cell", "vector"))

    hands = F.ceil(F.col("rows") / ASKERS)
    dealt = first.withColumn("hand", F.pmod(F.xxhash64("h1", "item"), hands)).drop("rows")
    held = pivots.select("block", "cell", "vector", F.explode(F.sequence(F.lit(0).cast("long"), hands - 1)).alias("hand"))
    placed = dealt.groupBy("block", "hand").cogroup(held.groupBy("block", "hand")).applyInPandas(
        _nearest_pivot(measure),
        f"item {item}, asks boolean, vector array<double>, block {block}, cell int, off double, h1 long, h2 long",
    )
    placed = freeze(placed)
    cells = placed.groupBy("block", "cell").agg(
        F.ceil(F.count(F.lit(1)) / tile).alias("subs"), F.min("off").alias("low"), F.max("off").alias("high")
    )
    centre = F.col("vector").cast("array<double>")
    if measure == "cosine":
        length = F.sqrt(F.aggregate(centre, F.lit(0.0), lambda acc, x: acc + x * x))
        centre = F.transform(centre, lambda x: x / length)
    cells = freeze(_equal(cells, pivots.select("block", "cell", centre.alias("vector")), ["block", "cell"]))
    sub = F.pmod(F.xxhash64("item", "h1"), F.col("subs"))
    tiles = _equal(placed.drop("off"), cells.select("block", "cell", "subs"), ["block", "cell"]).withColumn("sub", sub)
    tiles = freeze(tiles.drop("subs"))

    keys = ["block", "cell", "sub"]
    every = cells.select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("subs") - 1)).alias("sub"), F.col("cell").alias("own"))
    others = _equal(every, cells, ["block"]).select(
        "block", F.col("own").alias("home"), "sub", "cell", "vector", "low", "high", "subs"
    )
    known = (
        tiles.withColumn("home", F.col("cell"))
        .groupBy("block", "home", "sub")
        .cogroup(others.groupBy("block", "home", "sub"))
        .applyInPandas(
            _own_tile(k + 1, decimals, measure),
            f"block {block}, item {item}, vector array<double>, cell int, sub long, floor double, "
            f"targets array<long>, others array<{item}>, similarities array<double>",
        )
    )
    known = freeze(known)
    pair = F.explode(F.arrays_zip("others", "similarities")).alias("p")
    own = known.select("item", pair).select("item", F.col("p.others").alias("other"), F.col("p.similarities").alias("similarity"))

    target = known.select("block", "item", "vector", "floor", F.col("cell").alias("home"), F.col("sub").alias("home_sub"), F.explode("targets").alias("target"))
    target = target.withColumn("cell", F.shiftright("target", 32).cast("int"))
    asked = target.groupBy("block", "cell").agg(F.ceil(F.count(F.lit(1)) / ASKERS).alias("hands"))
    asked = freeze(asked)
    subs = F.explode(F.sequence(F.lit(0).cast("long"), F.col("target").bitwiseAND(0xFFFFFFFF) - 1))
    sent = _equal(target.withColumn("sub", subs), asked, ["block", "cell"])
    sent = sent.filter((F.col("cell") != F.col("home")) | (F.col("sub") != F.col("home_sub")))
    sent = sent.select(*keys, F.pmod(F.xxhash64("item"), "hands").alias("hand"), "item", "vector", "floor")
    shelves = _equal(tiles, asked, ["block", "cell"]).select(
        *keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("hands") - 1)).alias("hand"), "item", "vector"
    )
    met = sent.groupBy(*keys, "hand").cogroup(shelves.groupBy(*keys, "hand")).applyInPandas(
        _asked_tile(k + 1, decimals, measure), f"item {item}, other {item}, similarity double"
    )
    lists = top_k(own.unionByName(met), k + 1, user="item", item="other", score="similarity")
    # Every row takes the list of the first row of its vector, without itself.
    asks = first.filter("asks").select("block", "h1", "h2", F.col("item").alias("first_item"))
    members = _equal(hashed.select("item", "block", "h1", "h2"), asks, ["block", "h1", "h2"])
    lists = lists.withColumnRenamed("item", "first_item")
    return members.join(lists, "first_item").filter(F.col("other") != F.col("item")).select("item", "other", "similarity")

