"""Tasks are cut by rows and pairs, and every way of adding scores up gives the same rows."""

import itertools
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from basketry.operators import ordered, pairs
from basketry.operators.joins import exclude_seen
from basketry.operators.ordered import avg_rank_pct
from basketry.operators.pairs import both_directions, item_similarity, pair_counts, pairs_within, score_by_similarity
from basketry.session import freeze


@pytest.fixture(scope="module")
def lines(spark):
    rng = random.Random(5)
    rows = [(g, rng.randrange(40)) for g in range(60) for _ in range(rng.randint(1, 9))]
    return spark.createDataFrame(rows + rows[:20] + [(None, 1), (2, None)], "user int, item int").cache()


def test_rows_of_a_task_are_bounded(lines, monkeypatch):
    monkeypatch.setattr(pairs, "TASK_MEMBERS", 20)
    monkeypatch.setattr(ordered, "TASK_ROWS", 20)
    n = lines.count()
    assert pairs_within(lines, "user", "item").rdd.getNumPartitions() >= n // 20
    scored = lines.withColumn("prediction", lines.item * 1.0)
    assert avg_rank_pct(scored).rdd.getNumPartitions() >= n // 20


@pytest.mark.parametrize("each, block", [(10, 1000), (2_000_000, 4), (10, 4)])
def test_counts_from_dealt_lists(lines, monkeypatch, each, block):
    monkeypatch.setattr(pairs, "TASK_PAIRS", each)
    groups = defaultdict(set)
    for g, i in lines.dropna().collect():
        groups[g].add(i)
    want = Counter(p for items in groups.values() for p in itertools.combinations(sorted(items), 2))
    got = pair_counts(lines, "user", "item", block_members=block)
    assert {(r.item_a, r.item_b): r.together for r in got.collect()} == want
    if each == 10 and block == 1000:
        assert got.rdd.getNumPartitions() >= sum(want.values()) // 10


@pytest.mark.parametrize("sent, hot", [(500_000, 100_000), (10, 100_000), (500_000, 5), (10, 5)])
def test_scores_added_up_in_any_way(lines, monkeypatch, sent, hot):
    monkeypatch.setattr(pairs, "SENT_SIMILARITIES", sent)
    monkeypatch.setattr(pairs, "HOT_HISTORY", hot)
    monkeypatch.setattr(pairs, "TASK_MET", 100)
    known = lines.dropna()
    similarity = item_similarity(known)
    near = defaultdict(list)
    for r in both_directions(similarity, ["similarity"]).collect():
        near[r["item"]].append((r["other"], r["similarity"]))
    want = Counter()
    for u, i in {tuple(r) for r in known.collect()}:
        for other, s in near[i]:
            want[u, other] += s
    got = {(r.user, r.item): r.prediction for r in score_by_similarity(known, similarity).collect()}
    assert got == pytest.approx(dict(want), abs=2e-6)


def test_seen_pairs_are_not_sent_to_every_task(spark):
    """A stored table looks small, and an anti-join would sink below the sums of the scores."""
    train = freeze(spark.createDataFrame([(1, 1), (1, 1), (2, None), (None, 3), (2, 4)], "user int, item int"))
    parts = [(1, 1, 0.5), (1, 2, 0.25), (1, 2, 0.25), (2, 4, 1.0), (2, None, 2.0), (None, 3, 3.0), (None, None, 4.0)]
    parts = spark.createDataFrame(parts, "user int, item int, part double")
    scores = parts.groupBy("user", "item").agg(F.sum("part").alias("prediction"))
    left = exclude_seen(scores, train)
    want = {(1, 2, 0.5), (2, None, 2.0), (None, 3, 3.0), (None, None, 4.0)}
    assert left.columns == ["user", "item", "prediction"] and set(map(tuple, left.collect())) == want
    assert exclude_seen(parts, train).count() == 5
    plan = left._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" not in plan and plan.index("SortMergeJoin") < plan.index("HashAggregate")
