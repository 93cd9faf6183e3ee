"""Rating metrics over the pairs present in both frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rating_metrics(
    truth: DataFrame,
    preds: DataFrame,
    on: tuple[str, ...] = ("user", "item"),
    rating: str = "rating",
    prediction: str = "prediction",
) -> DataFrame:
    """One row: n, rmse, mae, r2, explained_variance. Ratios are NULL when the ratings do not vary."""
    joined = truth.select(*on, rating).join(preds.select(*on, prediction), list(on))
    r, error = F.col(rating), F.col(rating) - F.col(prediction)
    spread = F.nullif(F.var_pop(r), F.lit(0.0))
    return joined.agg(
        F.count(F.lit(1)).alias("n"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"),
        (1 - F.avg(error * error) / spread).alias("r2"),
        (1 - F.var_pop(error) / spread).alias("explained_variance"),
    )
