"""Exact order statistics of many columns in two or three passes that return one row each."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bars of a histogram, relative rank error of its edges, and values that the last pass may return.
BARS = 2_000
ACCURACY = 20_000
LAST_VALUES = 50_000
# Share of the values that lie between the edges chosen around a rank.
NARROWING = 2 / BARS + 8 / ACCURACY


@dataclass
class _Bracket:
    """Two neighbouring ranks of a column lie in [low, high]; ``inside`` bounds what is between."""

    column: str
    ranks: tuple[int, int]
    low: float
    high: float
    inside: int

    def between(self) -> Column:
        x = F.col(self.column)
        return F.when((x > F.lit(self.low)) & (x < F.lit(self.high)), x)

    def asked(self, last: bool) -> list[Column]:
        """Rows below, on the low edge, between, on the high edge, and what lies between."""
        x, low, high = F.col(self.column), F.lit(self.low), F.lit(self.high)
        inner = F.collect_list(self.between()) if last else _histogram(self.between())
        return [F.count_if(x < low), F.count_if(x == low), F.count(self.between()), F.count_if((x == high) & (x > low)), inner]

    def cut(self, edges: Sequence[float], before: int, inside: int) -> None:
        """Narrow to the edges around the ranks; ranks that lie on an old edge keep it."""
        margin = 3 / ACCURACY
        first, last = ((r - before) / inside for r in self.ranks)
        if first >= 0:
            self.low = edges[max(0, math.floor((first - margin) * BARS))]
        if last < 1:
            self.high = edges[min(BARS, math.ceil((last + margin) * BARS))]
        self.inside = math.ceil(inside * NARROWING)


def _histogram(x: Column) -> Column:
    """Edges of bars of equal numbers of values, from mergeable summaries."""
    # One parsed literal; two thousand columns would take the driver longer than the pass.
    shares = F.expr(f"array({', '.join(f'{i / BARS!r}D' for i in range(BARS + 1))})")
    return F.percentile_approx(x, shares, ACCURACY)


def _interpolated(low: float, high: float, target: float) -> float:
    part = target - math.floor(target)
    return low + (high - low) * part if part else low


def describe_columns(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> list[dict]:
    """Per numeric column ``count, mean, std, min, max`` and ``quantiles``, interpolated and exact.

    The first pass takes the moments and a histogram of bars of equal numbers of values. Around each
    quantile its edges leave a bracket, which the error of the histogram cannot move off it. The
    last pass counts what lies below a bracket and returns the values inside; while those may be
    more than ``LAST_VALUES``, a pass between draws a new histogram inside the bracket. A value that
    fills a bracket is an edge of it and only counted. Columns become no rows: every pass reads the
    named columns, and only partial counts and summaries are shuffled.
    """
    frame = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    moments = [F.count, F.avg, F.stddev_samp, F.min, F.max, _histogram]
    row = tuple(frame.agg(*[f(c) for c in map(F.col, frame.columns) for f in moments]).first())
    out, brackets = [], {}
    for i, name in enumerate(frame.columns):
        n, mean, std, least, most, edges = row[6 * i : 6 * i + 6]
        out.append({"column": cols[i], "count": n, "mean": mean, "std": std, "min": least, "max": most, "quantiles": [None] * len(probs)})
        for j, p in enumerate(probs if n else ()):
            bracket = _Bracket(name, (math.floor(p * (n - 1)), math.ceil(p * (n - 1))), least, most, n)
            if n > LAST_VALUES:
                bracket.cut(edges, 0, n)
            brackets[i, j] = bracket
    while brackets:
        last = all(b.inside <= LAST_VALUES for b in brackets.values())
        row = tuple(frame.agg(*[a for b in brackets.values() for a in b.asked(last)]).first())
        for at, ((i, j), b) in enumerate(list(brackets.items())):
            below, on_low, inside, on_high, inner = row[5 * at : 5 * at + 5]
            before, until = below + on_low, below + on_low + inside
            if b.ranks[0] < below or b.ranks[1] >= until + on_high:  # beyond the error that is stated
                b.low, b.high, b.inside = out[i]["min"], out[i]["max"], out[i]["count"]
            elif last or not any(before <= r < until for r in b.ranks):
                values = np.sort(np.array(inner if last else [], "float64"))
                low, high = (
                    b.low if r < before else float(values[r - before]) if r < until else b.high for r in b.ranks
                )
                out[i]["quantiles"][j] = _interpolated(low, high, probs[j] * (out[i]["count"] - 1))
                del brackets[i, j]
            else:
                b.cut(inner, before, inside)
    return out
