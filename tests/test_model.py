"""Model pipeline: encoding, recommendation without seen items, tuning, selection, scenarios."""

import random

import pytest
from pyspark.sql import functions as F

from basketry.operators.splits import fold_pair, kfold
from basketry.plans.model import (
    as_lists,
    average_folds,
    best_model,
    unseen_percentiles,
    cross_validate,
    encode_pairs,
    evaluate_model,
    fit_als,
    flatten_recs,
    flatten_recs_sql,
    holdout,
    model_report,
    param_grid,
    recommend,
    recommend_all,
    recommend_unseen,
    score_pairs,
    select_best,
)
from basketry.plans import tiles as tiles_module
from basketry.plans.tiles import best_unseen, count_better, item_tiles, user_vectors
from basketry.plans.scenarios import (
    ab_test,
    ctr,
    personalize,
    popularity,
    rerank,
    revenue_per_order,
    with_fallback,
)

SMALL = {"rank": 3, "max_iter": 2, "seed": 1}


@pytest.fixture(scope="module")
def pairs(spark):
    rng = random.Random(8)
    data = {(u, i) for u in range(20) for i in rng.sample(range(60), 4)}
    data |= {(0, i) for i in range(55)}  # a user who has nearly everything
    rows = [(u, i, float(1 + (u * i) % 5)) for u, i in sorted(data)]
    return spark.createDataFrame(rows, "user int, item int, rating double").cache()


@pytest.fixture(scope="module")
def model(pairs):
    return fit_als(pairs, **SMALL)


def test_param_grid_size():
    spec = {"rank": [10, 20], "max_iter": [10, 25], "reg": [0.05, 0.1], "alpha": [1, 30, 40, 50]}
    grid = param_grid(spec)
    assert len(grid) == 32 == len({tuple(g.items()) for g in grid})
    assert grid[0] == {"rank": 10, "max_iter": 10, "reg": 0.05, "alpha": 1}


def test_encoding_is_dense(spark):
    prefs = spark.createDataFrame([("b", 3_000_000_000, 1), ("a", 5, 2)], "u string, i long, w int")
    pairs, users, items = encode_pairs(prefs, "u", "i", "w")
    assert pairs.dtypes == [("user", "int"), ("item", "int"), ("rating", "double")]
    assert sorted(map(tuple, pairs.collect())) == [(0, 0, 2.0), (1, 1, 1.0)]
    assert sorted(map(tuple, users.collect())) == [("a", 0), ("b", 1)]
    assert sorted(map(tuple, items.collect())) == [(5, 0), (3_000_000_000, 1)]


def test_layout_changes_predictions_only_slightly(pairs, model):
    again = fit_als(pairs.orderBy("user", "item").repartition(3), **SMALL)
    a = {(r.user, r.item): r.prediction for r in score_pairs(model, pairs).collect()}
    b = {(r.user, r.item): r.prediction for r in score_pairs(again, pairs).collect()}
    assert a.keys() == b.keys() and max(abs(a[x] - b[x]) for x in a) < 1e-2


def test_cold_pairs_are_dropped(spark, model):
    held = spark.createDataFrame([(0, 1, 1.0), (999, 1, 1.0), (0, 999, 1.0)], "user int, item int, rating double")
    assert score_pairs(model, held).count() == 1


def test_unseen_lists_are_the_best_unseen_items(spark, pairs, model):
    """Against all predictions of all pairs, for users with few and with many seen items."""
    users, items = pairs.select("user").distinct(), pairs.select("item").distinct()
    seen = {(r.user, r.item) for r in pairs.collect()}
    every = score_pairs(model, users.crossJoin(items)).collect()
    scored = {}
    for r in every:
        if (r.user, r.item) not in seen:
            scored.setdefault(r.user, []).append(r.prediction)
    got = {}
    for r in recommend_unseen(model, pairs, 8).collect():
        assert (r.user, r.item) not in seen
        got.setdefault(r.user, []).append(r.prediction)
    for user, values in scored.items():
        want = sorted(values, reverse=True)[:8]
        assert sorted(got[user], reverse=True) == pytest.approx(want, abs=1e-5)
    assert len(got[0]) == len(scored[0]) < 8


def test_unseen_for_chosen_users_only(spark, pairs, model):
    chosen = spark.createDataFrame([(3,), (3,), (12345,)], "user int")
    got = recommend_unseen(model, pairs, 5, chosen).collect()
    assert {r.user for r in got} == {3} and len(got) == 5


def test_lists_and_rows_convert_both_ways(model, pairs):
    recs = recommend_all(model, 4)
    flat = sorted(map(tuple, flatten_recs(recs).collect()))
    assert flat == sorted(map(tuple, flatten_recs_sql(recs, "recs_for_test").collect()))
    back = as_lists(flatten_recs(recs))
    assert sorted(map(tuple, flatten_recs(back).collect())) == flat
    for r in back.collect():
        ratings = [e.rating for e in r.recommendations]
        assert ratings == sorted(ratings, reverse=True) and len(ratings) == 4
    assert recommend(model, pairs.filter("user < 3"), 2).count() == 3


def test_observed_candidates_only_measure_length(pairs, model):
    row = evaluate_model(model, pairs, pairs.filter("user > 0"), k=20, candidates="observed")
    assert row["ndcg_at_k"] == pytest.approx(1.0) and row["recall_at_k"] == pytest.approx(1.0)
    with pytest.raises(ValueError):
        evaluate_model(model, pairs, pairs, candidates="other")


def test_cross_validation_covers_models_and_folds(pairs):
    grid = param_grid({"rank": [2, 3], "max_iter": [1]})
    results = cross_validate(kfold(pairs, 2), grid, k=5, n_folds=2).cache()
    assert {(r.model, r.fold) for r in results.collect()} == {(f"ALS {m}", f) for m in (1, 2) for f in (0, 1)}
    mean = average_folds(results)
    assert mean.count() == 2
    for r in mean.collect():
        assert 0 <= r.ndcg_at_k <= 1 and 0 <= r.roem <= 1 and r.cv_time > 0
    best = select_best(mean, "ndcg_at_k", minimize=False).collect()
    assert len(best) == 1 and best[0].ndcg_at_k == max(r.ndcg_at_k for r in mean.collect())


def test_holdout_and_report(pairs):
    held = kfold(pairs, 4)
    results = holdout(held.filter("fold > 0").drop("fold"), held.filter("fold = 0").drop("fold"), [{"rank": 2, "max_iter": 1}], k=5)
    row = results.first()
    assert (row["rank"], row["max_iter"], row["reg"], row["alpha"]) == (2, 1, 0.05, 50.0)
    assert row.train_time > 0 and row.valid_time > 0
    assert model_report(results, best_only=True).columns == ["model", "rank", "max_iter", "reg", "alpha", "ndcg_at_k"]


def test_select_best_skips_missing_values(spark):
    table = spark.createDataFrame([("b", 0.3), ("a", 0.3), ("c", None)], "model string, roem double")
    assert select_best(table, "roem", minimize=True).first().model == "a"


def test_personalize(pairs):
    got = personalize(pairs, 3, **SMALL)
    assert got.join(pairs, ["user", "item"], "left_semi").count() == 0
    assert {r["count"] for r in got.groupBy("user").count().collect()} == {3}


def test_fallback_fills_cold_users(spark):
    recs = spark.createDataFrame([(1, 7, 0.5)], "user int, item int, prediction double")
    users = spark.createDataFrame([(1,), (2,), (2,)], "user int")
    history = spark.createDataFrame([(5, 9), (6, 9), (5, 8), (5, 4)], "user int, item int")
    got = with_fallback(recs, users, popularity(history), k=2)
    assert sorted(map(tuple, got.collect())) == [(1, 7, 0.5, "model"), (2, 4, 1.0, "popular"), (2, 9, 2.0, "popular")]


def test_fallback_evaluates_the_lists_once(spark):
    """Their rows and their users are both read; what made them runs once."""
    evaluated = spark.sparkContext.accumulator(0)

    def counted(user):
        evaluated.add(1)
        return user

    recs = spark.createDataFrame([(1, 5, 0.5), (1, 6, 0.25), (2, 5, 1.0)], "user int, item int, prediction double")
    recs = recs.withColumn("user", F.udf(counted, "int")("user"))
    users = spark.createDataFrame([(1,), (2,), (3,)], "user int")
    popular = spark.createDataFrame([(7, 9.0), (8, 3.0)], "item int, prediction double")
    got = {tuple(r) for r in with_fallback(recs, users, popular, k=1).collect()}
    assert got == {(1, 5, 0.5, "model"), (1, 6, 0.25, "model"), (2, 5, 1.0, "model"), (3, 7, 9.0, "popular")}
    assert evaluated.value == 3


def test_rerank_applies_factors_before_the_cut(spark):
    recs = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.8), (1, 3, 0.1)], "user int, item int, prediction double")
    boosts = spark.createDataFrame([(3, 20.0), (1, 0.5)], "item int, factor double")
    got = sorted(map(tuple, rerank(recs, boosts, 2).select("rank", "item", "prediction").collect()))
    assert got == [(1, 3, 2.0), (2, 2, 0.8)]


def test_business_metrics(spark):
    events = spark.createDataFrame(
        [(0, "view")] * 8 + [(0, "click")] * 2 + [(1, "view")] * 5 + [(1, "click")] * 5 + [(1, "error"), (2, "error")],
        "bucket int, event_type string",
    )
    assert {r.bucket: r.ctr for r in ctr(events, ["bucket"]).collect()} == {0: 0.25, 1: 1.0, 2: None}
    got = ab_test(events, "bucket").first()
    assert (got.rate_a, got.rate_b) == (0.2, 0.5)
    pooled = 7 / 20
    assert got.z_score == pytest.approx(0.3 / (pooled * (1 - pooled) * (1 / 10 + 1 / 10)) ** 0.5)
    assert ab_test(events.filter("bucket = 0"), "bucket").first().z_score is None
    lines = spark.createDataFrame([(1, 2.0), (1, 3.0), (2, 5.0)], "BE_ORDER_ID int, PROD_REV_USD double")
    assert tuple(revenue_per_order(lines).first()) == (2, 10.0, 5.0)


def test_columns_of_recommendations(model):
    entry = recommend_all(model, 2).schema["recommendations"].dataType.elementType
    assert [f.name for f in entry] == ["item", "rating"]


def test_percentiles_over_all_unseen_items(spark, pairs, model):
    """Against all predictions, with one and with several tiles and blocks of users."""
    users, items = pairs.select("user").distinct(), pairs.select("item").distinct()
    folded = kfold(pairs, 4)
    train, held = fold_pair(folded, 1)
    scores = {(r.user, r.item): r.prediction for r in score_pairs(model, users.crossJoin(items)).collect()}
    seen = {(r.user, r.item) for r in train.collect()}
    held = held.join(train, ["user", "item"], "left_anti")
    want = {}
    for r in held.collect():
        others = [s for (u, i), s in scores.items() if u == r.user and i != r.item and (u, i) not in seen]
        if (r.user, r.item) in scores:
            better = sum(s > scores[r.user, r.item] + 1e-6 for s in others)
            want[r.user, r.item] = better / len(others) if others else 0.0
    for tile, block in ((4096, 4096), (5, 3)):
        got = unseen_percentiles(model, train, held, tile, block).collect()
        assert {(r.user, r.item): r.percent_rank for r in got} == pytest.approx(want)


def test_truth_leaves_out_repeat_purchases(pairs, model):
    """Held-out pairs that repeat training pairs cannot be listed, so they do not lower the metrics."""
    train, held = fold_pair(kfold(pairs, 4), 1)
    plain = evaluate_model(model, train, held, k=5)
    repeated = evaluate_model(model, train, held.unionByName(train.limit(20)), k=5)
    assert plain == pytest.approx(repeated)
    assert 0 <= plain["roem"] <= 1


def test_best_model_is_fitted_again(spark, pairs):
    results = spark.createDataFrame(
        [("a", 2, 1, 0.1, 1.0, 0.2), ("b", 3, 1, 0.1, 1.0, 0.4)],
        "model string, rank int, max_iter int, reg double, alpha double, ndcg_at_k double",
    )
    assert best_model(pairs, results).rank == 3
    with pytest.raises(ValueError):
        best_model(pairs, results.limit(0))


@pytest.mark.parametrize("tile,block,k", [(8192, 8192, 8), (7, 4, 8), (1, 2, 3), (60, 1, 100)])
def test_tiles_give_the_same_lists(spark, pairs, model, tile, block, k):
    """Item for item against all predictions, ties by item, with few and many tiles."""
    seen = pairs.select("user", "item").distinct()
    every = {(r.user, r.item): r.prediction for r in score_pairs(model, pairs.select("user").distinct().crossJoin(pairs.select("item").distinct())).collect()}
    owned = {tuple(r) for r in seen.collect()}
    want = set()
    for user in {u for u, _ in every}:
        free = sorted((-round(s, 5), i) for (u, i), s in every.items() if u == user and (u, i) not in owned)
        want |= {(user, i) for _, i in free[:k]}
    got = best_unseen(user_vectors(model), item_tiles(model, tile), seen, k, block).collect()
    assert len(got) == len(want) and {(r.user, r.item) for r in got} == want


def test_users_leave_once_no_tile_can_change_their_list(spark):
    """One long item vector and many short ones: only users who own the long one go on."""

    class Factors:
        userFactors = spark.createDataFrame([(u, [1.0, 0.0]) for u in range(40)], "id int, features array<float>")
        itemFactors = spark.createDataFrame([(0, [9.0, 0.0])] + [(i, [1.0 / i, 0.1]) for i in range(1, 200)], "id int, features array<float>")

    tiles = item_tiles(Factors, 10)
    assert tiles.longest == sorted(tiles.longest, reverse=True) and len(tiles.longest) == 20
    seen = spark.createDataFrame([(u, 0) for u in range(5)], "user int, item int")
    got = best_unseen(user_vectors(Factors), tiles, seen, 1).collect()
    assert {(r.user, r.item) for r in got} == {(u, int(u < 5)) for u in range(40)}


@pytest.mark.parametrize("lists", [4096, 3])
def test_better_items_are_counted_between_held_scores(spark, pairs, model, lists, monkeypatch):
    monkeypatch.setattr(tiles_module, "HELD_SCORES", lists)
    held = spark.createDataFrame([(u, s) for u in range(6) for s in (-1.0, 0.0, 0.2, 0.2, 0.5, 0.9, 7.0)], "user int, score double")
    users, tiles = user_vectors(model), item_tiles(model, 7)
    vectors = {r.user: r.uf for r in users.collect()}
    shelf = [r.vf for r in tiles.items.collect()]
    got = {(r.user, r.score): r.better for r in count_better(users, tiles, held, 2).collect()}
    for u, s in {tuple(r) for r in held.collect()}:
        assert got.get((u, s), 0) == sum(sum(x * y for x, y in zip(vectors[u], v)) > s + 1e-9 * (1 + abs(s)) for v in shelf)
    assert max(s for _, s in got) < 7.0  # above every bound, so it met no tile
