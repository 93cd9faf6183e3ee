"""Rating and binary metrics on given columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketry.operators.metrics import binary_metrics, rating_metrics

from .inputs import order_lines, r6, table
from .registry import part, query

part(
    "line_errors",
    """
SELECT PROD_QTY AS r, PROD_QTY - avg(PROD_QTY) OVER (PARTITION BY PROD_ID) AS e FROM order_lines
""",
)
RATING_SQL = {
    "rmse": "sqrt(avg(e * e))",
    "mae": "avg(abs(e))",
    "r2": "1 - avg(e * e) / var_pop(r)",
    "explained_variance": "1 - var_pop(e) / var_pop(r)",
}


def product_mean(spark, sf_dir):
    """Quantities of all order lines against the mean quantity of their product."""
    lines = order_lines(spark, sf_dir).select(
        F.col("BE_ORDER_ID").alias("user"), F.col("PROD_ID").alias("item"), F.col("PROD_QTY").alias("rating")
    )
    means = lines.groupBy("item").agg(F.avg("rating").alias("prediction"))
    return rating_metrics(lines, means, on=("item",))


@query("o076_rating_metrics", "SELECT count(*) AS n, " + ", ".join(f"round({s}, 6) AS {n}" for n, s in RATING_SQL.items()) + " FROM line_errors")
def q076_all(spark, sf_dir):
    return product_mean(spark, sf_dir).withColumns({n: r6(n) for n in RATING_SQL})


def rating_query(key: str, name: str) -> None:
    @query(key, f"SELECT round({RATING_SQL[name]}, 6) AS {name} FROM line_errors")
    def run(spark, sf_dir):
        return product_mean(spark, sf_dir).select(r6(name).alias(name))


rating_query("o076_rmse", "rmse")
rating_query("o077_mae", "mae")
rating_query("o078_r2", "r2")
rating_query("o079_explained_variance", "explained_variance")

part(
    "scored_labels",
    """
SELECT l.quality AS label, d.n_chars / (d.n_chars + CAST(1000 AS DOUBLE)) AS score
FROM labels l JOIN documents d ON d.doc_id = l.doc_id
""",
)


def label_metrics(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    joined = table(spark, sf_dir, "labels").join(docs, "doc_id")
    scored = joined.select(
        F.col("quality").alias("label"), (F.col("n_chars") / (F.col("n_chars") + F.lit(1000.0))).alias("score")
    )
    return binary_metrics(scored)


@query(
    "o080_auc",
    """
SELECT count(*) AS n,
       round((sum(CASE WHEN label = 1 THEN r END) - sum(label) * (sum(label) + 1) / CAST(2 AS DOUBLE))
             / (CAST(sum(label) AS DOUBLE) * sum(1 - label)), 6) AS auc
FROM (SELECT label, rank() OVER (ORDER BY score)
                    + (count(*) OVER (PARTITION BY score) - 1) / CAST(2 AS DOUBLE) AS r FROM scored_labels)
""",
)
def q080(spark, sf_dir):
    return label_metrics(spark, sf_dir).select("n", r6("auc").alias("auc"))


@query(
    "o081_log_loss",
    """
SELECT count(*) AS n, round(-avg(CASE WHEN label = 1 THEN ln(p) ELSE ln(1 - p) END), 6) AS log_loss
FROM (SELECT label, least(greatest(score, 1e-15), 1 - 1e-15) AS p FROM scored_labels)
""",
)
def q081(spark, sf_dir):
    return label_metrics(spark, sf_dir).select("n", r6("log_loss").alias("log_loss"))
