"""Metrics by hand, on edge cases, and against Spark's own evaluators."""

import math
import random

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator, RankingEvaluator, RegressionEvaluator
from pyspark.sql import functions as F

from basketry.operators.metrics import (
    binary_metrics,
    diversity_metrics,
    evaluate,
    mean_average_precision,
    ranking_metrics,
    rating_metrics,
    roem,
    roem_detail,
    user_diversity,
    user_serendipity,
)
from basketry.operators.metrics.beyond import coverage, novelty
from basketry.operators.pairs import item_similarity
from basketry.operators.stats import hit_percentile_range

TRUTH, PREDS = "user int, item int", "user int, item int, prediction double"


def test_labels_count_as_a_set(spark):
    truth = spark.createDataFrame([(1, 1), (1, 1), (1, 3)], TRUTH)
    preds = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.8), (1, 1, 0.1)], PREDS)
    got = ranking_metrics(truth, preds, 5).first()
    assert (got.users, got.precision_at_k, got.recall_at_k, got["map"], got.map_at_k) == (1, 0.2, 0.5, 0.5, 0.5)
    assert got.ndcg_at_k == pytest.approx(0.6131, abs=1e-4)
    assert evaluate(truth, preds, "recall_at_k", 5).first()[0] == 0.5


def test_only_users_in_both_frames_count(spark):
    truth = spark.createDataFrame([(1, 1), (2, 1), (3, 7)], TRUTH)
    preds = spark.createDataFrame([(1, 1, 0.9), (3, 1, 0.8), (4, 1, 0.7)], PREDS)
    got = ranking_metrics(truth, preds, 1).first()
    assert (got.users, got.precision_at_k, got.recall_at_k) == (2, 0.5, 0.5)


def test_no_common_user_gives_zero(spark):
    got = ranking_metrics(spark.createDataFrame([(1, 1)], TRUTH), spark.createDataFrame([(2, 1, 0.9)], PREDS), 3)
    assert tuple(got.first()) == (0, 0.0, 0.0, 0.0, 0.0, 0.0)


@pytest.fixture(scope="module")
def lists(spark):
    rng = random.Random(1)
    truth = {(u, rng.randrange(30)) for u in range(12) for _ in range(rng.randrange(1, 9))}
    scores = {(u, i): round(rng.random(), 6) for u in range(12) for i in rng.sample(range(30), 15)}
    preds = [(u, i, s) for (u, i), s in scores.items()]
    return spark.createDataFrame(sorted(truth), TRUTH), spark.createDataFrame(preds, PREDS)


def test_ranking_metrics_match_spark(lists):
    truth, preds = lists
    entry = F.struct((-F.col("prediction")).alias("key"), F.col("item").cast("double").alias("item"))
    ranked = preds.groupBy("user").agg(
        F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["item"]).alias("prediction")
    )
    labels = truth.groupBy("user").agg(F.collect_set(F.col("item").cast("double")).alias("label"))
    frame = ranked.join(labels, "user").cache()

    def spark_value(metric, k=6):
        return RankingEvaluator(k=k, metricName=metric).evaluate(frame)

    ours = ranking_metrics(truth, preds, 6).first()
    assert ours.precision_at_k == pytest.approx(spark_value("precisionAtK"))
    assert ours.recall_at_k == pytest.approx(spark_value("recallAtK"))
    assert ours.ndcg_at_k == pytest.approx(spark_value("ndcgAtK"))
    assert ours.map_at_k == pytest.approx(spark_value("meanAveragePrecisionAtK"))
    for limit in (0, 1000):
        full = mean_average_precision(truth, preds, hot_rows=limit).first()
        assert full["map"] == pytest.approx(spark_value("meanAveragePrecision"))
    for r in (ours.precision_at_k, ours.recall_at_k, ours.ndcg_at_k, ours["map"], ours.map_at_k):
        assert 0 <= r <= 1


def test_rating_metrics_match_spark(spark):
    rng = random.Random(4)
    data = [(u, u % 7, float(rng.randrange(10)), rng.random() * 10) for u in range(60)]
    df = spark.createDataFrame(data, "user int, item int, rating double, prediction double")
    got = rating_metrics(df.drop("prediction"), df.drop("rating")).first()
    for name, metric in {"rmse": "rmse", "mae": "mae", "r2": "r2"}.items():
        want = RegressionEvaluator(metricName=metric, labelCol="rating", predictionCol="prediction").evaluate(df)
        assert got[name] == pytest.approx(want)
    errors = [r - p for _, _, r, p in data]
    ratings = [r for _, _, r, _ in data]
    var = lambda xs: sum((x - sum(xs) / len(xs)) ** 2 for x in xs) / len(xs)
    assert got.explained_variance == pytest.approx(1 - var(errors) / var(ratings))


def test_rating_metrics_of_constant_ratings(spark):
    df = spark.createDataFrame([(1, 1, 2.0, 1.0), (1, 2, 2.0, 3.0)], "user int, item int, rating double, prediction double")
    got = rating_metrics(df.drop("prediction"), df.drop("rating")).first()
    assert (got.rmse, got.mae, got.r2, got.explained_variance) == (1.0, 1.0, None, None)


def test_auc_matches_spark_with_ties(spark):
    rng = random.Random(9)
    data = [(rng.randrange(2), rng.randrange(10) / 10) for _ in range(200)]
    df = spark.createDataFrame(data, "label int, score double").repartition(5)
    want = BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="score", numBins=0).evaluate(
        df.withColumn("label", F.col("label").cast("double"))
    )
    assert binary_metrics(df).first().auc == pytest.approx(want)


def test_log_loss_is_clipped(spark):
    df = spark.createDataFrame([(1, 0.0), (0, 0.5), (None, 0.4)], "label int, score double")
    got = binary_metrics(df).first()
    assert got.n == 2
    assert got.log_loss == pytest.approx((-math.log(1e-15) - math.log(0.5)) / 2)


def test_auc_needs_both_classes(spark):
    assert binary_metrics(spark.createDataFrame([(1, 0.3)], "label int, score double")).first().auc is None


@pytest.mark.parametrize("limit", [0, 1000])
def test_roem_by_hand(spark, limit):
    data = [(1, 10, 0.9, 2.0), (1, 11, 0.5, 0.0), (1, 12, 0.5, 1.0), (1, 13, 0.1, 1.0), (2, 10, 0.2, 3.0)]
    df = spark.createDataFrame(data, "user int, item int, prediction double, rating double")
    # user 1: ranks 0, 1/3, 1/3, 1; user 2: 0
    assert roem(df, hot_rows=limit).first().roem == pytest.approx((1 / 3 + 1.0) / 7.0)


def test_roem_without_ratings_is_null(spark):
    df = spark.createDataFrame([(1, 1, 0.5, 0.0)], "user int, item int, prediction double, rating double")
    assert roem(df).first().roem is None


def test_roem_detail_fills_unbought_with_zero(spark):
    recs = spark.createDataFrame([(1, 10, 0.9), (1, 11, 0.5)], PREDS)
    facts = spark.createDataFrame([(1, 11, 2), (1, 11, 3), (2, 10, 9)], "user int, item int, rating int")
    attrs = spark.createDataFrame([(11, "Brand")], "item int, brand string")
    got = {r.item: r for r in roem_detail(recs, facts, attrs).collect()}
    assert (got[10].rating, got[11].rating) == (0, 5)
    assert (got[11].percent_rank, got[11].np_rank, got[11].brand, got[10].brand) == (1.0, 0.5, "Brand", None)


def test_hit_percentile_range(spark):
    df = spark.createDataFrame([(0.1, 0), (0.2, 1), (0.9, 2)], "percent_rank double, rating int")
    assert tuple(hit_percentile_range(df, formatted=True).first()) == ("20.00%", "90.00%")


def test_beyond_accuracy_by_hand(spark):
    train = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 3), (3, 2)], TRUTH)
    reco = spark.createDataFrame([(1, 3), (2, 2), (3, 1), (3, 3)], TRUTH)
    got = diversity_metrics(train, reco).first()
    cos13, cos12 = 1 / math.sqrt(2), 1 / 2
    assert got.catalog_coverage == pytest.approx(1.0)
    shares = [0.25, 0.25, 0.5]
    assert got.distributional_coverage == pytest.approx(-sum(p * math.log2(p) for p in shares))
    bits = {1: -math.log2(2 / 5), 2: -math.log2(2 / 5), 3: -math.log2(1 / 5)}
    assert got.novelty == pytest.approx((bits[3] + bits[2] + bits[1] + bits[3]) / 4)
    assert got.diversity == pytest.approx(1 - cos13)  # only user 3 has two items
    user1, user2 = 1 - (cos13 + 0) / 2, 1 - (cos12 + 0) / 2
    user3 = ((1 - cos12) + (1 - 0)) / 2
    assert got.serendipity == pytest.approx((user1 + user2 + user3) / 3)


def test_untrained_items_are_counted_and_empty_frames_give_null(spark):
    train = spark.createDataFrame([(1, 1), (1, 2)], TRUTH)
    reco = spark.createDataFrame([(1, 1), (2, 9), (3, 9)], TRUTH)
    assert tuple(novelty(train, reco).first()) == (1.0, 2)
    none = train.limit(0)
    assert coverage(none, reco).first().catalog_coverage is None
    assert coverage(train, none).first().catalog_coverage == 0
    assert tuple(novelty(none, reco).first()) == (None, 3)


def test_serendipity_of_an_owned_item_is_zero(spark):
    train = spark.createDataFrame([(1, 1)], TRUTH)
    similarity = item_similarity(train)
    got = user_serendipity(train, train, similarity).first()
    assert got.serendipity == 0.0
    assert user_diversity(train, similarity).count() == 0
