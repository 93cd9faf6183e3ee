"""Metrics of a score against a 0/1 label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ordered import running_totals

# Fixed value: probabilities are kept this far away from 0 and 1.
CLIP = 1e-15


def binary_metrics(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """One row: n, auc, log_loss.

    AUC is the share of (positive, negative) pairs in the right order, ties counting one half.
    Rows are first counted per score; ranges of scores then carry running counts of negatives.
    """
    rows = df.select(F.col(label).cast("int").alias("y"), F.col(score).cast("double").alias("p"))
    rows = rows.filter(F.col("y").isNotNull() & F.col("p").isNotNull())
    p = F.least(F.greatest(F.col("p"), F.lit(CLIP)), F.lit(1 - CLIP))
    loss = -(F.col("y") * F.ln(p) + (1 - F.col("y")) * F.ln(1 - p))
    levels = rows.groupBy("p").agg(
        F.count_if(F.col("y") == 1).alias("pos"),
        F.count_if(F.col("y") == 0).alias("neg"),
        F.sum(loss).alias("loss"),
    )
    running = running_totals(levels, (), [F.col("p").asc()], {"below": F.col("neg")})
    wins = F.sum(F.col("pos") * (F.col("below_before") + F.col("neg") / F.lit(2.0)))
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    n = F.sum(F.col("pos") + F.col("neg"))
    return running.agg(
        n.alias("n"),
        (wins / F.nullif(pairs, F.lit(0.0))).alias("auc"),
        (F.sum("loss") / n).alias("log_loss"),
    )
