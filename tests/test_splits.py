"""Splits and folds: completeness, chronology, independence of the layout."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from basketry.operators.splits import chrono_split, fold_pair, kfold, random_split, split_report
from basketry.plans.training import stored_split
from basketry.session import stage_scope


@pytest.fixture(scope="module")
def lines(spark):
    rng = random.Random(6)
    start = datetime(2021, 1, 1)
    data = []
    for u in range(25):
        for _ in range(rng.randrange(1, 14)):
            data.append((f"c{u}", start + timedelta(days=rng.randrange(20)), len(data)))
    return spark.createDataFrame(data, "CUST_ID string, ORDER_DT timestamp, line int")


def parts(df):
    return {(r.line): r.split for r in df.collect()}


@pytest.mark.parametrize("limit", [0, 5, 1000])
def test_sizes_follow_half_even_rounding(lines, limit):
    got = chrono_split(lines, tiebreak=["line"], hot_rows=limit)
    sizes = got.groupBy("CUST_ID").pivot("split", ["train", "valid", "test"]).count().fillna(0).collect()
    for r in sizes:
        n = r.train + r.valid + r.test
        train = round(0.6 * n)
        assert (r.train, r.valid) == (train, round(0.5 * (n - train)))


def test_order_of_time_holds(lines):
    got = chrono_split(lines, tiebreak=["line"])
    spans = got.groupBy("CUST_ID", "split").agg(F.min("ORDER_DT").alias("lo"), F.max("ORDER_DT").alias("hi"))
    by_user = {}
    for r in spans.collect():
        by_user.setdefault(r.CUST_ID, {})[r.split] = (r.lo, r.hi)
    for found in by_user.values():
        ordered = [found[p] for p in ("train", "valid", "test") if p in found]
        assert all(a[1] <= b[0] for a, b in zip(ordered, ordered[1:]))


def test_layout_and_path_change_nothing(lines):
    want = parts(chrono_split(lines, tiebreak=["line"]))
    for n in (1, 7):
        assert parts(chrono_split(lines.repartition(n), tiebreak=["line"])) == want
    assert parts(chrono_split(lines.repartition(5), tiebreak=["line"], hot_rows=3)) == want


def test_report_adds_up(lines):
    report = split_report(chrono_split(lines, tiebreak=["line"])).collect()
    assert sum(r["rows"] for r in report) == report[0]["total"] == lines.count()


def test_folds_are_disjoint_and_complete(spark):
    pairs = spark.createDataFrame([(u, i) for u in range(30) for i in range(20)], "user int, item int")
    folded = kfold(pairs, 5)
    assert {r.fold for r in folded.select("fold").distinct().collect()} == set(range(5))
    seen = []
    for f in range(5):
        train, held = fold_pair(folded, f)
        assert train.count() + held.count() == 600
        assert train.intersect(held).count() == 0
        seen += [tuple(r) for r in held.collect()]
    assert len(seen) == len(set(seen)) == 600
    again = {tuple(r) for r in kfold(pairs.repartition(9), 5).collect()}
    assert again == {tuple(r) for r in folded.collect()}


def test_text_and_huge_keys(spark):
    text = kfold(spark.createDataFrame([(f"u{i}", i) for i in range(50)], "user string, item int"), 3)
    assert {r.fold for r in text.collect()} == {0, 1, 2}
    huge = spark.createDataFrame([(2**62, -(2**62))], "user long, item long")
    assert 0 <= kfold(huge, 5).first().fold < 5


def test_rows_with_null_keys_get_a_fold(spark):
    pairs = spark.createDataFrame([(1, None), (None, 2), (None, None), (3, 4)], "user int, item int")
    folded = kfold(pairs, 3)
    train, held = fold_pair(folded, folded.first().fold)
    assert folded.filter("fold IS NULL").count() == 0 and train.count() + held.count() == 4


def test_random_split_keeps_all_rows(lines):
    assert random_split(lines, [0.6, 0.2, 0.2]).count() == lines.count()


def test_ties_without_a_given_order_do_not_depend_on_the_layout(spark):
    when = datetime(2021, 1, 1)
    df = spark.createDataFrame([("c", when, i) for i in range(40)], "CUST_ID string, ORDER_DT timestamp, line int")
    want = parts(chrono_split(df))
    assert want == parts(chrono_split(df.orderBy(F.col("line").desc()).repartition(7), hot_rows=3))
    assert [want[i] for i in (0, 23, 24, 39)] == ["train", "train", "valid", "test"]


def test_stored_split_evaluates_its_input_once(spark, lines):
    """The sketch of frequent customers and the split both read the stored lines, not their joins again."""
    evaluated = spark.sparkContext.accumulator(0)

    def counted(user):
        evaluated.add(1)
        return user

    costly = lines.withColumn("CUST_ID", F.udf(counted, "string")("CUST_ID"))
    with stage_scope(spark):
        got = stored_split(costly, keep=["CUST_ID", "line"], tiebreak=["line"], hot_rows=5)
        assert evaluated.value == lines.count()
        assert got.columns == ["CUST_ID", "line", "split"]
        assert parts(got) == parts(chrono_split(lines, tiebreak=["line"]))
        assert stored_split(lines, tiebreak=["line"]).columns == [*lines.columns, "split"]
