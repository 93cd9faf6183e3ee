"""Pairs, similarity and neighbours against brute force, with ordinary and with cut groups."""

import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from basketry.operators import neighbours
from basketry.operators.pairs import (
    basket_pairs,
    bought_together,
    item_similarity,
    pair_counts,
    pairs_within,
    score_by_similarity,
    similar_by_attributes,
    similar_by_vector,
)


@pytest.fixture(scope="module")
def baskets():
    rng = random.Random(11)
    lines = [("big", i) for i in range(40)] + [("big", 3)]
    lines += [(f"o{o}", rng.randrange(25)) for o in range(20) for _ in range(4)]
    return lines + [(None, 1), (None, 2), ("o1", None)]


def brute_pairs(lines):
    groups = defaultdict(set)
    for g, i in lines:
        if g is not None and i is not None:
            groups[g].add(i)
    return {(g, a, b) for g, items in groups.items() for a, b in itertools.combinations(sorted(items), 2)}


@pytest.mark.parametrize("block", [1, 3, 7, 1000])
def test_every_pair_appears_once(spark, baskets, block):
    df = spark.createDataFrame(baskets, "g string, i int")
    got = [tuple(r) for r in pairs_within(df, "g", "i", block_members=block).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute_pairs(baskets)


def test_basket_pairs_use_distinct_items(spark):
    df = spark.createDataFrame([(1, 5), (1, 5), (1, 2), (2, 7)], "BE_ORDER_ID int, SKU int")
    assert [tuple(r) for r in basket_pairs(df).collect()] == [(1, 2, 5)]


def test_similarity_measures(spark, baskets):
    counts = Counter((a, b) for _, a, b in brute_pairs(baskets))
    single = Counter(i for g, i in {(g, i) for g, i in baskets if g is not None and i is not None})
    df = spark.createDataFrame(baskets, "user string, item int")
    assert {(r.item_a, r.item_b): r.together for r in pair_counts(df, "user", "item").collect()} == counts
    for measure, formula in {
        "cosine": lambda c, a, b: c / math.sqrt(a * b),
        "jaccard": lambda c, a, b: c / (a + b - c),
        "count": lambda c, a, b: float(c),
    }.items():
        for r in item_similarity(df, measure=measure).collect():
            want = formula(counts[(r.item_a, r.item_b)], single[r.item_a], single[r.item_b])
            assert r.similarity == pytest.approx(want)


def test_score_is_the_sum_over_the_history(spark):
    history = spark.createDataFrame([(1, 10), (1, 11)], "user int, item int")
    similarity = spark.createDataFrame(
        [(10, 12, 0.5), (11, 12, 0.25), (10, 11, 0.125), (12, 13, 1.0)], "item_a int, item_b int, similarity double"
    )
    got = {(r.user, r.item): r.prediction for r in score_by_similarity(history, similarity).collect()}
    assert got == {(1, 12): 0.75, (1, 10): 0.125, (1, 11): 0.125}


def test_bought_together_by_hand(spark):
    lines = [(1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "a"), (3, "c"), (4, "d")]
    df = spark.createDataFrame(lines, "BE_ORDER_ID int, SKU string")
    got = {(r.item, r.other): r for r in bought_together(df, min_count=2).collect()}
    assert set(got) == {("a", "b"), ("b", "a")}
    assert got[("a", "b")].support == pytest.approx(0.5)
    assert got[("a", "b")].confidence == pytest.approx(2 / 3)
    assert got[("b", "a")].confidence == pytest.approx(1.0)
    assert got[("a", "b")].lift == pytest.approx(2 * 4 / (3 * 2))


@pytest.mark.parametrize("min_count", [1, 2, 3])
def test_pruning_rare_items_changes_nothing(spark, baskets, min_count):
    counts = Counter((a, b) for _, a, b in brute_pairs(baskets))
    want = {p for p, c in counts.items() if c >= min_count}
    df = spark.createDataFrame(baskets, "BE_ORDER_ID string, SKU int")
    got = {(r.item, r.other) for r in bought_together(df, min_count=min_count).collect()}
    assert got == want | {(b, a) for a, b in want}


@pytest.mark.parametrize("section", [2, 5, 10_000])
def test_nearest_by_attribute_matches_all_pairs(spark, section):
    rng = random.Random(5)
    items = [(i, "t" if i % 3 else "s", float(rng.randrange(30))) for i in range(60)] + [(99, "alone", 1.0)]
    df = spark.createDataFrame(items, "id int, kind string, price double").repartition(4)
    got = similar_by_attributes(df, "id", ["kind"], "price", n=3, section=section).collect()
    found = defaultdict(list)
    for r in sorted(got, key=lambda r: r["rank"]):
        found[r.id].append((r.alternative, r.distance))
    for kind in ("s", "t"):
        placed = sorted((p, i) for i, k, p in items if k == kind)
        for pos, (p, i) in enumerate(placed):
            others = [(abs(q - p), abs(o - pos), o, j) for o, (q, j) in enumerate(placed) if j != i]
            assert found[i] == [(j, d) for d, _, _, j in sorted(others)[:3]]
    assert 99 not in found


@pytest.mark.parametrize("tile", [3, 10, 2048])
def test_nearest_by_vector_matches_all_pairs(spark, tile):
    rng = np.random.default_rng(2)
    vectors = [(i, [float(x) for x in rng.normal(size=4)], i % 2) for i in range(24)]
    vectors.append((50, [0.0, 0.0, 0.0, 0.0], 0))
    df = spark.createDataFrame(vectors, "item long, vector array<float>, label int")
    got = defaultdict(list)
    for r in sorted(similar_by_vector(df, k=4, tile=tile).collect(), key=lambda r: r["rank"]):
        got[r.item].append((r.other, r.similarity))
    assert set(got) == set(range(24))
    for i, v, label in vectors[:24]:
        a = np.array(v, dtype="float32").astype("float64")
        scored = []
        for j, w, other in vectors[:24]:
            b = np.array(w, dtype="float32").astype("float64")
            if j != i and other == label:
                scored.append((-round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 6), j))
        assert [j for j, _ in got[i]] == [j for _, j in sorted(scored)[:4]]


def test_least_support_only_removes_rare_pairs(spark):
    df = spark.createDataFrame([(u, i) for u in range(12) for i in range(5) if (u * 7 + i * 3) % 4], "user int, item int")
    every = [r for r in item_similarity(df).collect() if r.together >= 6]
    assert sorted(map(tuple, item_similarity(df, min_together=6).collect())) == sorted(map(tuple, every))


def test_several_attributes_and_text_ids(spark):
    parts = [(f"p{i}", "a" if i % 2 else "b", (i * 37 % 11) / 10, (i * 53 % 17) / 10) for i in range(30)] + [("q", "a", None, 1.0)]
    df = spark.createDataFrame(parts, "id string, kind string, size double, price double")
    got = {}
    for r in similar_by_attributes(df, "id", ["kind"], ["size", "price"], n=4).collect():
        got.setdefault(r.id, {})[r["rank"]] = (r.distance, r.alternative)
    for name, kind, size, price in parts[:-1]:
        want = sorted(
            (round(math.hypot(size - s, price - p), 6), other)
            for other, k, s, p in parts[:-1]
            if k == kind and other != name
        )[:4]
        assert [got[name][i][1] for i in sorted(got[name])] == [w[1] for w in want]
    assert "q" not in got


def nearest(points, k, measure, decimals=6):
    """(item, rank) -> (other, similarity) over all pairs of a block."""
    out = {}
    for i, x, block in points:
        scored = []
        for j, y, other in points:
            if i != j and block == other:
                a, b = (np.array(v, dtype="float64") for v in (x, y))
                near = a @ b / np.linalg.norm(a) / np.linalg.norm(b) if measure == "cosine" else -np.linalg.norm(a - b)
                scored.append((-round(float(near), decimals), j))
        for place, (s, j) in enumerate(sorted(scored)[:k], start=1):
            out[i, place] = (j, -s)
    return out


@pytest.mark.parametrize("measure", ["cosine", "euclidean"])
@pytest.mark.parametrize("tile,cells", [(16, 256), (50, 3), (5, 6)])
def test_cells_give_the_same_neighbours(spark, monkeypatch, measure, tile, cells):
    """Clusters, a grid full of ties, a vector shared by a third of all items, blocks of all sizes."""
    monkeypatch.setattr(neighbours, "MAX_CELLS", cells)
    monkeypatch.setattr(neighbours, "ASKERS", 20)
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(6, 3)) * 5
    points = [(f"c{i:03}", [float(x) for x in centres[i % 6] + rng.normal(size=3) * 0.1], "a") for i in range(90)]
    points += [(f"g{i:03}", [float(1 + i % 4), float(1 + i // 4 % 4), 1.0], None) for i in range(48)]
    points += [(f"h{i:03}", [1.0, 2.0, 3.0], "a" if i % 2 else "b") for i in range(70)]
    points += [("s1", [1.0, 0.5, 0.0], "small"), ("s2", [0.0, 0.5, 1.0], "small"), ("one", [1.0, 1.0, 1.0], "alone")]
    df = spark.createDataFrame(points, "id string, v array<double>, kind string").repartition(5)
    got = similar_by_vector(df, 4, "id", "v", "kind", tile=tile, measure=measure).collect()
    want = nearest(points, 4, measure)
    assert len(got) == len(want)
    for r in got:
        other, similarity = want[r.item, r["rank"]]
        assert (r.other, r.similarity) == (other, pytest.approx(similarity, abs=1e-9))


def test_far_cells_are_not_asked(spark, monkeypatch):
    """Clusters far apart: what a vector cannot find there is never sent."""
    seen = []
    plain = neighbours.freeze
    monkeypatch.setattr(neighbours, "freeze", lambda df: seen.append(plain(df)) or seen[-1])
    rng = np.random.default_rng(3)
    points = [(i, [float(x) for x in np.eye(8)[i % 8] * 100 + rng.normal(size=8) * 0.01], 0) for i in range(400)]
    df = spark.createDataFrame(points, "item int, vector array<double>, label int")
    similar_by_vector(df, 3, tile=50, measure="euclidean").collect()
    known = next(f for f in seen if "targets" in f.columns)
    asked = sum(len(r.targets) for r in known.select("targets").collect())
    cells = next(f for f in seen if "subs" in f.columns).count()
    assert asked < 0.5 * len(points) * cells


def test_euclidean_neighbours_of_the_origin(spark):
    df = spark.createDataFrame([(i, [0.0, float(i)], 1) for i in range(4)] + [(9, None, 1)], "item int, vector array<double>, label int")
    got = {r.item: r.other for r in similar_by_vector(df, 1, measure="euclidean").collect()}
    assert got == {0: 1, 1: 0, 2: 1, 3: 2}
    with pytest.raises(ValueError):
        similar_by_vector(df, 1, measure="other")
    assert similar_by_vector(df.limit(0), 1).collect() == []
