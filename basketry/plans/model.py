"""Implicit-feedback matrix factorisation with Spark ML: fit, score, recommend, tune, select."""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from itertools import product

from pyspark import inheritable_thread_target
from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import exclude_seen
from ..operators.metrics import ranking_metrics, roem
from ..operators.ordered import dense_ids, running_totals
from ..operators.splits import fold_pair
from ..session import checkpoint_root, freeze, stage_scope
from .tiles import BLOCK_USERS, TILE_ITEMS, best_unseen, count_better, item_tiles, user_vectors

# The default hyper-parameters and list length.
DEFAULTS = {"rank": 10, "max_iter": 10, "reg": 0.05, "alpha": 50.0}
TOP_K = 20

METRICS = ["ndcg_at_k", "map", "map_at_k", "precision_at_k", "recall_at_k", "roem"]
RESULT_SCHEMA = (
    "model string, fold int, rank int, max_iter int, reg double, alpha double, users long, "
    + ", ".join(f"{m} double" for m in METRICS)
    + ", train_time double, valid_time double"
)


def encode_pairs(
    prefs: DataFrame, user: str, item: str, rating: str
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs with int ``user`` and ``item`` and double ``rating``, user key table, item key table).

    The preferences are read three times, so they are stored first.
    """
    prefs = freeze(prefs.select(user, item, rating))
    users = dense_ids(prefs, user, "__user")
    items = dense_ids(prefs, item, "__item")
    pairs = prefs.join(users, user).join(items, item).select(
        F.col("__user").alias("user"),
        F.col("__item").alias("item"),
        F.col(rating).cast("double").alias("rating"),
    )
    return pairs, users.withColumnRenamed("__user", "user"), items.withColumnRenamed("__item", "item")


def fit_als(
    train: DataFrame,
    rank: int = DEFAULTS["rank"],
    max_iter: int = DEFAULTS["max_iter"],
    reg: float = DEFAULTS["reg"],
    alpha: float = DEFAULTS["alpha"],
    seed: int = 1,
    blocks: int | None = None,
) -> ALSModel:
    """Fit on (user int, item int, rating).

    The block count follows the cluster's parallelism up to 1,000: every iteration exchanges data
    between all pairs of blocks.
    """
    spark = train.sparkSession
    checkpoint_root(spark)  # the iterations cut their lineage there
    if blocks is None:
        blocks = min(max(10, spark.sparkContext.defaultParallelism), 1_000)
    als = ALS(
        userCol="user",
        itemCol="item",
        ratingCol="rating",
        rank=rank,
        maxIter=max_iter,
        regParam=reg,
        alpha=alpha,
        seed=seed,
        implicitPrefs=True,
        nonnegative=True,
        coldStartStrategy="drop",
        numUserBlocks=blocks,
        numItemBlocks=blocks,
    )
    return als.fit(train.select("user", "item", "rating"))


def score_pairs(model: ALSModel, pairs: DataFrame) -> DataFrame:
    """Predictions for given pairs; pairs with an unknown user or item are dropped."""
    return model.transform(pairs)


def recommend(model: ALSModel, users: DataFrame, n: int) -> DataFrame:
    """Top-n list per given user: (user, recommendations array<struct<item, rating>>)."""
    return model.recommendForUserSubset(users.select("user").distinct(), n)


def recommend_all(model: ALSModel, n: int, tile: int = TILE_ITEMS) -> DataFrame:
    """Top-n list per user of the model: (user, recommendations array<struct<item, rating>>).

    Users meet tiles of items, longest vectors first, until no further tile can change their lists.
    """
    nothing = model.userFactors.sparkSession.createDataFrame([], "user int, item int")
    return as_lists(best_unseen(user_vectors(model), item_tiles(model, tile), nothing, n))


def flatten_recs(
    recs: DataFrame, user: str = "user", item: str = "item", lists: str = "recommendations"
) -> DataFrame:
    """One row per list entry: (user, item, prediction)."""
    return recs.select(user, F.explode(lists).alias("__rec")).select(
        user, F.col(f"__rec.{item}").alias(item), F.col("__rec.rating").alias("prediction")
    )


def flatten_recs_sql(
    recs: DataFrame, view: str, user: str = "user", item: str = "item", lists: str = "recommendations"
) -> DataFrame:
    """The same with SQL over a registered view."""
    recs.createOrReplaceTempView(view)
    return recs.sparkSession.sql(
        f"SELECT {user}, entry.{item} AS {item}, entry.rating AS prediction "
        f"FROM {view} LATERAL VIEW explode({lists}) lists AS entry"
    )


def as_lists(topk: DataFrame, user: str = "user", item: str = "item", score: str = "prediction") -> DataFrame:
    """Top-k rows back to one list per user, best first; k bounds the list."""
    entry = F.struct((-F.col(score)).alias("__key"), F.col(item).alias(item), F.col(score).alias("rating"))
    grouped = topk.groupBy(user).agg(F.array_sort(F.collect_list(entry)).alias("__list"))
    plain = F.transform("__list", lambda e: F.struct(e[item].alias(item), e["rating"].alias("rating")))
    return grouped.select(user, plain.alias("recommendations"))


def recommend_unseen(
    model: ALSModel, seen: DataFrame, k: int = TOP_K, users: DataFrame | None = None, tile: int = TILE_ITEMS
) -> DataFrame:
    """Exactly the k best unseen items per user: ``user, item, prediction``.

    Seen items are masked while tiles of items are scored, longest vectors first, and a user is done
    as soon as no further tile can change the list. Lists never grow with what a user has.
    """
    owned = seen.select("user", "item").distinct()
    if users is not None:
        users = users.select("user").distinct()
        owned = owned.join(users, "user", "left_semi")
    return best_unseen(user_vectors(model, users), item_tiles(model, tile), owned, k)


def param_grid(spec: Mapping[str, Sequence]) -> list[dict]:
    """All combinations of the listed values, first name varying slowest."""
    return [dict(zip(spec, values)) for values in product(*spec.values())]


def evaluate_model(
    model: ALSModel, train: DataFrame, held: DataFrame, k: int = TOP_K, candidates: str = "unseen"
) -> dict:
    """Ranking metrics and rank-ordering error of a fitted model on held-out pairs.

    ``unseen`` ranks all items the user does not have in ``train``; held-out pairs that repeat a
    training pair can never be listed and are left out of the truth. The rank-ordering error is
    taken over the same full lists. ``observed`` ranks only the held-out pairs themselves, where
    every listed item is a hit.
    """
    if candidates not in ("unseen", "observed"):
        raise ValueError("candidates is 'unseen' or 'observed'")
    if candidates == "observed":
        scored = freeze(score_pairs(model, held))
        row = ranking_metrics(held, scored, k).first().asDict()
        row["roem"] = roem(scored).first()["roem"]
        return row
    truth = freeze(exclude_seen(held, train))
    ranked = recommend_unseen(model, train, k, users=truth.select("user"))
    row = ranking_metrics(truth, ranked, k, unique=True).first().asDict()
    placed = unseen_percentiles(model, train, truth)
    total = F.nullif(F.sum("rating"), F.lit(0.0))
    row["roem"] = placed.agg((F.sum(F.col("rating") * F.col("percent_rank")) / total).alias("r")).first()["r"]
    return row


def unseen_percentiles(
    model: ALSModel, seen: DataFrame, held: DataFrame, tile: int = TILE_ITEMS, users_per_block: int = BLOCK_USERS
) -> DataFrame:
    """``user, item, rating, percent_rank``: place of each held pair among all unseen items of its user.

    0 is the best place. ``held`` has no seen pairs; pairs with an unknown user or item are dropped.
    Better items are counted between the held scores of a user, tile by tile; tiles whose items all
    lie below them are skipped.
    """
    users = freeze(user_vectors(model, held.select("user").distinct()))
    tiles = item_tiles(model, tile)
    dot = F.aggregate(F.zip_with("uf", "vf", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)

    def scored(pairs: DataFrame) -> DataFrame:
        known = pairs.join(users.drop("norm"), "user").join(tiles.items.drop("tile"), "item")
        return known.withColumn("score", dot).drop("uf", "vf")

    wanted = scored(held.select("user", "item", F.col("rating").cast("double").alias("rating")))
    wanted = freeze(wanted.withColumn("__seen", F.lit(0).cast("long")))
    own = scored(seen.select("user", "item").distinct().join(wanted.select("user").distinct(), "user", "left_semi"))
    own = own.select("item", "user", F.lit(0.0).alias("rating"), "score", F.lit(1).cast("long").alias("__seen"))
    both = freeze(wanted.unionByName(own))
    order = [F.col("score").desc(), F.col("__seen").asc(), F.col("item").asc()]
    placed = running_totals(both, ["user"], order, {"seen": F.col("__seen")}).filter(F.col("__seen") == 0)
    counted = count_better(users, tiles, wanted.select("user", "score"), users_per_block)
    better = F.coalesce("better", F.lit(0)) - F.col("seen_before")
    others = F.lit(tiles.n_items) - F.col("seen_total") - 1
    rank = F.when(others > 0, better / others).otherwise(F.lit(0.0))
    return placed.join(counted, ["user", "score"], "left").select("user", "item", "rating", rank.alias("percent_rank"))


def _run(name: str, params: dict, fold: int, train: DataFrame, held: DataFrame, k: int, candidates: str, seed: int):
    params = {**DEFAULTS, **params}
    spark = train.sparkSession
    # What a model stores goes with it, so the disk holds one model of a fold at a time.
    with stage_scope(spark, own_thread=True):
        started = time.perf_counter()
        model = fit_als(train, seed=seed, **params)
        fitted = time.perf_counter()
        row = evaluate_model(model, train, held, k, candidates)
        done = time.perf_counter()
    del model
    spark._jvm.System.gc()  # Spark removes the shuffle files of what is no longer referred to
    return {
        "model": name,
        "fold": fold,
        "rank": int(params["rank"]),
        "max_iter": int(params["max_iter"]),
        "reg": float(params["reg"]),
        "alpha": float(params["alpha"]),
        **{m: row[m] for m in ["users", *METRICS]},
        "train_time": fitted - started,
        "valid_time": done - fitted,
    }


def cross_validate(
    pairs: DataFrame,
    grid: Sequence[dict],
    k: int = TOP_K,
    fold: str = "fold",
    n_folds: int = 5,
    candidates: str = "unseen",
    parallelism: int = 4,
    seed: int = 1,
) -> DataFrame:
    """Every model on every fold: one row per (model, fold) with metrics and times.

    The models of one fold share its stored training rows; ``parallelism`` folds run side by side.
    """
    spark = pairs.sparkSession

    def run_fold(f: int) -> list[dict]:
        train, held = (part.persist() for part in fold_pair(pairs, f, fold))
        try:
            return [
                _run(f"ALS {i}", params, f, train, held, k, candidates, seed)
                for i, params in enumerate(grid, start=1)
            ]
        finally:
            train.unpersist()
            held.unpersist()

    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        jobs = [pool.submit(inheritable_thread_target(spark)(run_fold), f) for f in range(n_folds)]
        rows = [row for job in jobs for row in job.result()]
    return spark.createDataFrame(rows, RESULT_SCHEMA)


def average_folds(results: DataFrame) -> DataFrame:
    """Mean of the fold metrics per model, and its total cross-validation time."""
    return results.groupBy("model", "rank", "max_iter", "reg", "alpha").agg(
        *[F.avg(m).alias(m) for m in METRICS],
        F.sum(F.col("train_time") + F.col("valid_time")).alias("cv_time"),
    )


def holdout(
    train: DataFrame,
    valid: DataFrame,
    grid: Sequence[dict],
    k: int = TOP_K,
    candidates: str = "unseen",
    seed: int = 1,
) -> DataFrame:
    """Each model fitted on all training rows and evaluated on the validation rows."""
    train, valid = train.persist(), valid.persist()
    try:
        rows = [_run(f"ALS {i}", p, -1, train, valid, k, candidates, seed) for i, p in enumerate(grid, start=1)]
    finally:
        train.unpersist()
        valid.unpersist()
    return train.sparkSession.createDataFrame(rows, RESULT_SCHEMA).drop("fold")


def select_best(
    table: DataFrame, metric: str = "ndcg_at_k", minimize: bool = False, name: str = "model"
) -> DataFrame:
    """The row with the best metric, the first name winning ties; rows without a value never win."""
    best = F.col(metric).asc() if minimize else F.col(metric).desc()
    return table.filter(F.col(metric).isNotNull()).orderBy(best, name).limit(1)


def best_model(
    train: DataFrame, results: DataFrame, metric: str = "ndcg_at_k", minimize: bool = False, seed: int = 1
) -> ALSModel:
    """The best row's hyper-parameters fitted on ``train``."""
    best = select_best(results, metric, minimize).first()
    if best is None:
        raise ValueError(f"no model has a value of {metric}")
    return fit_als(train, seed=seed, **{p: best[p] for p in DEFAULTS})


def model_report(
    results: DataFrame, best_only: bool = False, metric: str = "ndcg_at_k", minimize: bool = False
) -> DataFrame:
    """Hyper-parameters of every model, or of the best one, with its chosen metric."""
    if best_only:
        results = select_best(results, metric, minimize)
    return results.select("model", "rank", "max_iter", "reg", "alpha", metric)
