"""Lists of all users by tiles, counts above many held scores, and tables that go with their model."""

import random
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

from basketry.operators.splits import kfold
from basketry.plans import tiles
from basketry.plans.model import cross_validate, fit_als, holdout, recommend_all
from basketry.session import checkpoint_root


@pytest.fixture(scope="module")
def pairs(spark):
    rng = random.Random(8)
    rows = [(u, i, float(1 + (u * i) % 5)) for u in range(30) for i in rng.sample(range(70), 6)]
    return spark.createDataFrame(rows, "user int, item int, rating double").cache()


@pytest.mark.parametrize("tile", [9, 8_192])
def test_lists_of_all_users_by_tiles(pairs, tile):
    model = fit_als(pairs, rank=3, max_iter=2)
    got, want = recommend_all(model, 5, tile=tile), model.recommendForAllUsers(5)
    assert [t for _, t in got.dtypes] == [t for _, t in want.dtypes]
    scores = lambda df: {r["user"]: np.round([e["rating"] for e in r["recommendations"]], 4).tolist() for r in df.collect()}
    assert scores(got) == scores(want)


@pytest.mark.parametrize("limit", [0, 3, 100])
def test_counts_above_held_scores(monkeypatch, limit):
    monkeypatch.setattr(tiles, "SORTED_SCORES", limit)
    rng = np.random.default_rng(4)
    items = pd.DataFrame({"vf": list(rng.random((50, 3)))})
    rows = pd.DataFrame({"user": range(8), "uf": list(rng.random((8, 3))), "held": [np.sort(rng.random(n)) for n in (1, 9, 2, 5, 1, 3, 4, 7)]})
    found = tiles._count_better(rows, items)
    scores = np.stack(rows["uf"]) @ np.stack(items["vf"]).T
    want = [(u, int((scores[u] > h).sum())) for u, held in enumerate(rows["held"]) for h in held]
    assert list(zip(found["user"], found["better"])) == want


def test_tables_go_with_their_model(spark, pairs):
    root = Path(checkpoint_root(spark).removeprefix("file:"))
    before = set(root.glob("stage-*"))
    grid = [{"rank": 2, "max_iter": 1}]
    assert holdout(pairs, pairs.filter("user % 3 = 0").withColumn("item", pairs.item + 1), grid, k=3).count() == 1
    assert cross_validate(kfold(pairs), grid, k=3, n_folds=2).count() == 2
    assert set(root.glob("stage-*")) == before


def test_shelves_of_many_tiles_give_the_same(monkeypatch):
    """Long runs of short tiles: lists, owned items and counts as of one plain product."""
    monkeypatch.setattr(tiles, "TILE_ITEMS", 16)
    monkeypatch.setattr(tiles, "PRODUCT_ROWS", 4)
    rng = np.random.default_rng(9)
    for low in (0.0, -0.4):
        uf, vf = rng.random((23, 5)) + low, (rng.random((150, 5)) + low) * rng.random((150, 1))
        vf[40:60] = vf[3]
        ids = rng.permutation(150)
        scores = uf @ vf.T
        held = [np.unique(scores[u, rng.integers(0, 150, 1 + 2 * u)]) for u in range(23)]
        rows = pd.DataFrame({"user": range(23), "uf": list(uf), "held": held})
        items = pd.DataFrame({"item": ids, "vf": list(vf)})
        found = tiles._count_better(rows, items)
        want = [int((scores[u] > h + 1e-9 * (1 + abs(h))).sum()) for u in range(23) for h in held[u]]
        assert found["better"].tolist() == want
        owned = [(u, int(i)) for u in range(0, 23, 2) for i in rng.choice(ids, 30, replace=False)]
        asked = pd.DataFrame({"user": range(23), "uf": list(uf), "floor": -np.inf, "item": np.nan})
        masks = pd.DataFrame(owned, columns=["user", "item"]).assign(uf=None, floor=0.0)
        best = tiles._best_of_shelf(7)(pd.concat([asked, masks], ignore_index=True), items)
        single, taken = scores.astype("float32"), set(owned)
        for u in range(23):
            ranked = sorted((-single[u, p], i) for p, i in enumerate(ids.tolist()) if (u, i) not in taken)[:7]
            mine = best[best["user"] == u]
            assert np.allclose(mine["prediction"], [-s for s, _ in ranked], rtol=1e-6)
            assert mine["item"].tolist() == [i for _, i in ranked]


def test_users_travel_once_for_many_tiles(spark, pairs, monkeypatch):
    sent, plain = [], tiles._cogrouped
    monkeypatch.setattr(tiles, "_cogrouped", lambda rows, shelves, n: sent.append(rows.count()) or plain(rows, shelves, n))
    model = fit_als(pairs, rank=3, max_iter=2)
    got = tiles.count_better(tiles.user_vectors(model), tiles.item_tiles(model, 7), pairs.select("user", tiles.F.lit(0.0).alias("score")))
    assert got.count() == 30 and sent == [30]
