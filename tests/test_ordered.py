"""Order-dependent operators: by hand, and the same result when every group counts as hot."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from basketry.operators import ordered
from basketry.operators.ordered import (
    avg_rank_pct,
    dense_ids,
    exact_quantiles,
    percent_rank_items,
    positions,
    running_totals,
    split_hot,
    top_k,
)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def skewed(spark):
    """One user holds a third of all rows; another key is NULL; scores tie often."""
    rng = random.Random(7)
    users = ["hot"] * 100 + [None] * 20 + [f"u{rng.randrange(40)}" for _ in range(180)]
    data = [(u, i, float(rng.randrange(12)), rng.randrange(5)) for i, u in enumerate(users)]
    return spark.createDataFrame(data, "user string, item long, prediction double, rating long").repartition(5)


def test_split_hot_separates_large_groups(skewed):
    ordinary, hot = split_hot(skewed, ["user"], 50)
    assert {r.user for r in hot.collect()} == {"hot"}
    assert ordinary.count() + hot.count() == 300
    assert ordinary.filter("user IS NULL").count() == 20
    assert split_hot(skewed, ["user"], 100)[1] is None


def test_null_group_can_be_hot(skewed):
    _, hot = split_hot(skewed, ["user"], 15)
    assert hot.filter("user IS NULL").count() == 20


@pytest.mark.parametrize("sketch,literals", [(64, 10_000), (64, 0), (8_192, 10_000), (8_192, 0)])
@pytest.mark.parametrize("limit", [2_500, 40])
def test_frequent_keys_are_found_among_many(spark, monkeypatch, sketch, literals, limit):
    """Twenty thousand keys, more than a small sketch tracks; one key has a third of all rows."""
    monkeypatch.setattr(ordered, "SKETCH_KEYS", sketch)
    monkeypatch.setattr(ordered, "MAX_LITERAL_KEYS", literals)
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 300 == 1, F.lit(None)).otherwise(F.col("id").cast("string"))
    df = spark.range(0, 30_000, 1, 7).select(key.alias("user"), "id")
    ordinary, hot = split_hot(df, ["user"], limit)
    large = {r.user for r in hot.select("user").distinct().collect()}
    assert large >= ({"hot"} if limit == 2_500 else {"hot", None})
    assert hot.count() + ordinary.count() == 30_000
    assert ordinary.select("user").intersect(hot.select("user")).count() == 0
    assert ordinary.groupBy("user").count().filter(F.col("count") > limit).count() == 0


def test_finding_frequent_keys_writes_nothing(skewed, monkeypatch):
    monkeypatch.setattr(ordered, "freeze", None)
    assert split_hot(skewed, ["user"], 1000)[1] is None
    assert split_hot(skewed, ["user"], 50)[1].count() == 100


@pytest.mark.parametrize("limit", [0, 15, 50, 1000])
def test_positions_do_not_depend_on_the_path(skewed, limit):
    got = positions(
        skewed, ["user"], [F.col("prediction").desc(), F.col("item").asc()], total="n", hot_rows=limit
    ).toPandas()
    frame = skewed.toPandas().sort_values(["prediction", "item"], ascending=[False, True])
    frame["position"] = frame.groupby("user", dropna=False).cumcount() + 1
    frame["n"] = frame.groupby("user", dropna=False)["item"].transform("count")
    merged = got.merge(frame[["item", "position", "n"]], on="item")
    assert len(merged) == 300
    assert (merged["position_x"] == merged["position_y"]).all()
    assert (merged["n_x"] == merged["n_y"]).all()


@pytest.mark.parametrize("limit", [0, 50, 1000])
def test_rank_percentiles_match_pandas(skewed, limit):
    frame = skewed.toPandas()
    grouped = frame.groupby("user", dropna=False)["prediction"]
    frame["avg"] = grouped.rank(ascending=False, pct=True, method="average")
    frame["min"] = grouped.rank(ascending=False, method="min")
    n = grouped.transform("count")
    frame["pr"] = (frame["min"] - 1) / (n - 1).clip(lower=1)
    avg = avg_rank_pct(skewed, hot_rows=limit).toPandas().merge(frame[["item", "avg"]], on="item")
    assert ((avg["rank_pct"] - avg["avg"]).abs() < 1e-12).all() and len(avg) == 300
    pr = percent_rank_items(skewed, hot_rows=limit).toPandas().merge(frame[["item", "pr"]], on="item")
    assert ((pr["percent_rank"] - pr["pr"]).abs() < 1e-12).all() and len(pr) == 300


def test_percent_rank_of_a_single_row_is_zero(spark):
    one = spark.createDataFrame([(1, 5, 0.3)], "user int, item int, prediction double")
    assert percent_rank_items(one).first()["percent_rank"] == 0.0
    assert percent_rank_items(one, hot_rows=0).first()["percent_rank"] == 0.0


def test_running_totals_without_group(spark):
    df = spark.createDataFrame([(i, i % 4) for i in range(50)], "k int, w int").repartition(6)
    got = running_totals(df, (), [F.col("k").asc()], {"w": F.col("w")}).orderBy("k").collect()
    before = 0
    for r in got:
        assert (r.w_before, r.w_total) == (before, sum(i % 4 for i in range(50)))
        before += r.w


@pytest.mark.parametrize("layout", [1, 3, 9])
def test_dense_ids_ignore_layout(spark, layout):
    names = spark.createDataFrame([(f"c{i % 31:02d}",) for i in range(200)], "name string").repartition(layout)
    assert rows(dense_ids(names, "name", "id")) == [(f"c{i:02d}", i) for i in range(31)]


def test_top_k_breaks_ties_by_item(spark):
    df = spark.createDataFrame([(1, 9, 0.5), (1, 3, 0.5), (1, 4, 0.9), (2, 1, 0.1)], "user int, item int, prediction double")
    assert rows(top_k(df, 2).select("user", "item")) == [(1, 3), (1, 4), (2, 1)]


def test_exact_quantiles_match_pandas(spark):
    rng = random.Random(3)
    frame = pd.DataFrame({"a": [rng.randrange(9) for _ in range(101)], "b": [rng.random() for _ in range(101)]})
    frame.loc[5, "b"] = None
    df = spark.createDataFrame(frame).withColumn("b", F.nanvl("b", F.lit(None)))
    got = {r["column"]: r for r in exact_quantiles(df, ["a", "b"], [0.25, 0.5, 1.0]).collect()}
    for c in ("a", "b"):
        want = frame[c].quantile([0.25, 0.5, 1.0]).tolist()
        assert [got[c][f"q_{i}"] for i in range(3)] == pytest.approx(want)
