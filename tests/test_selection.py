"""Exact quantiles by narrowing histograms, against pandas."""

import random

import numpy as np
import pandas as pd
import pytest

from basketry.operators import selection
from basketry.operators.joins import dense_grid
from basketry.operators.selection import describe_columns

PROBS = [0.0, 0.25, 0.5, 0.75, 0.999, 1.0]


def frame(n):
    rng = np.random.default_rng(1)
    data = {
        "uniform": rng.random(n),
        "skewed": rng.lognormal(0, 4, n),
        "few": rng.integers(0, 3, n).astype(float),
        "heavy": np.where(rng.random(n) < 0.4, 7.0, rng.normal(7, 1, n)),
        "same": np.full(n, 2.5),
        "ids": np.arange(n, dtype=float) * 1e9,
    }
    out = pd.DataFrame(data)
    out.loc[out.index % 11 == 5, "uniform"] = None
    return out


@pytest.mark.parametrize("limit,bars,accuracy", [(50_000, 2_000, 20_000), (300, 50, 500), (60, 20, 400), (2_500, 2_000, 20_000)])
@pytest.mark.parametrize("n", [1, 2, 7, 5_000])
def test_quantiles_match_pandas(spark, monkeypatch, limit, bars, accuracy, n):
    monkeypatch.setattr(selection, "LAST_VALUES", limit)
    monkeypatch.setattr(selection, "BARS", bars)
    monkeypatch.setattr(selection, "ACCURACY", accuracy)
    monkeypatch.setattr(selection, "NARROWING", 2 / bars + 8 / accuracy)
    data = frame(n)
    df = spark.createDataFrame(data.astype(object).where(data.notna(), None), ", ".join(f"{c} double" for c in data)).repartition(5)
    for found in describe_columns(df, list(data), PROBS):
        column = data[found["column"]].dropna()
        assert found["count"] == len(column)
        assert found["quantiles"] == pytest.approx(column.quantile(PROBS).tolist(), rel=1e-12)
        assert found["mean"] == pytest.approx(column.mean())
        assert found["std"] == (pytest.approx(column.std()) if len(column) > 1 else None)


def test_a_column_without_values(spark):
    df = spark.createDataFrame([(None, 1), (None, 2)], "a double, b int")
    a, b = describe_columns(df, ["a", "b"], [0.5])
    assert (a["count"], a["quantiles"], a["min"]) == (0, [None], None) and b["quantiles"] == [1.5]
    assert describe_columns(df.limit(0), ["b"], [0.5])[0]["quantiles"] == [None]


def test_grid_over_a_long_axis(spark):
    """Thousands of places, users with none, few and all of them, measures that sum to NULL."""
    rng = random.Random(2)
    axis = rng.sample(range(20_000), 3_000)
    rows = [(1, i, 2) for i in axis] + [(2, axis[0], 5), (2, axis[0], 1), (2, axis[-1], None), (3, -7, 9), (None, axis[1], 1), (4, None, 1)]
    rows += [(5, i, 1) for i in rng.sample(range(20_000), 500)]
    df = spark.createDataFrame(rows, "u int, i long, q int").repartition(4)
    got = dense_grid(df, "u", "i", ["q"], axis).toPandas()
    want = pd.DataFrame([r for r in rows if r[0] is not None], columns=["u", "i", "q"]).fillna({"q": 0})
    sums = want.groupby(["u", "i"])["q"].sum()
    index = pd.MultiIndex.from_product([[1, 2, 3, 4, 5], axis], names=["u", "i"])
    assert len(got) == len(index)
    assert got.set_index(["u", "i"])["q"].reindex(index).tolist() == sums.reindex(index).fillna(0).tolist()
