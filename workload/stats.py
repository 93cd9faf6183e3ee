"""Counts, profiles, pivots and data-quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketry.operators.ordered import positions
from basketry.operators.stats import (
    basket_long,
    basket_matrix,
    describe,
    distinct_values,
    duplicate_keys,
    fd_violations,
    interaction_counts,
    null_profile,
    sparsity,
    top_customers,
    value_counts,
)

from .inputs import TIEBREAK, order_lines, r6, resolved, table
from .registry import query


@query(
    "o037_interaction_counts",
    """
SELECT count(*) AS num_rows, count(DISTINCT (CUST_ID, PROD_TITLE_PARENT_PROD_ID)) AS num_pairs,
       count(DISTINCT CUST_ID) AS num_users, count(DISTINCT PROD_TITLE_PARENT_PROD_ID) AS num_items
FROM resolved
""",
)
def q037(spark, sf_dir):
    return interaction_counts(resolved(spark, sf_dir), "CUST_ID", "PROD_TITLE_PARENT_PROD_ID")


SPARSITY_SQL = """
SELECT num_users, num_items, n AS numerator, num_users * num_items AS denominator,
       round((1 - n / CAST(num_users * num_items AS DOUBLE)) * 100, 6) AS empty_percent
FROM (SELECT count(DISTINCT CUST_ID) AS num_users, count(DISTINCT PROD_TITLE_PARENT_PROD_ID) AS num_items,
             {count} AS n FROM resolved)
"""


@query("o038_sparsity", SPARSITY_SQL.format(count="count(DISTINCT (CUST_ID, PROD_TITLE_PARENT_PROD_ID))"))
def q038(spark, sf_dir):
    report = sparsity(resolved(spark, sf_dir), "CUST_ID", "PROD_TITLE_PARENT_PROD_ID")
    return report.withColumn("empty_percent", r6("empty_percent"))


@query("o038_sparsity_rows", SPARSITY_SQL.format(count="count(*)"))
def q038_rows(spark, sf_dir):
    report = sparsity(resolved(spark, sf_dir), "CUST_ID", "PROD_TITLE_PARENT_PROD_ID", "rows")
    return report.withColumn("empty_percent", r6("empty_percent"))


@query("o039_global_max", "SELECT max(ORDER_DT) AS t_ref FROM order_lines")
def q039(spark, sf_dir):
    return order_lines(spark, sf_dir).agg(F.max("ORDER_DT").alias("t_ref"))


@query(
    "o040_global_sum",
    """
SELECT sum(PROD_QTY) AS qty, round(sum(PROD_QTY * PROD_REV_USD), 0) AS qty_revenue FROM order_lines
""",
)
def q040(spark, sf_dir):
    return order_lines(spark, sf_dir).agg(
        F.sum("PROD_QTY").alias("qty"), F.round(F.sum(F.col("PROD_QTY") * F.col("PROD_REV_USD")), 0).alias("qty_revenue")
    )


@query(
    "o041_distinct_values",
    """
SELECT DISTINCT PROD_TITLE_PARENT_PROD_ID, BRAND, PROD_CAT, PROD_TITLE_PARENT_TITLE FROM resolved
""",
)
def q041(spark, sf_dir):
    return distinct_values(
        resolved(spark, sf_dir), ["PROD_TITLE_PARENT_PROD_ID", "BRAND", "PROD_CAT", "PROD_TITLE_PARENT_TITLE"]
    )


@query(
    "o042_top_customers",
    """
SELECT CUST_ID, count(*) AS purchases, count(DISTINCT PROD_TITLE_PARENT_PROD_ID) AS products
FROM resolved WHERE PROD_QTY > 0 GROUP BY CUST_ID
""",
)
def q042(spark, sf_dir):
    bought = resolved(spark, sf_dir).filter(F.col("PROD_QTY") > 0)
    return top_customers(bought, "CUST_ID", "PROD_TITLE_PARENT_PROD_ID")


@query("o043_value_counts", 'SELECT BE_ORDER_ID, SKU, count(*) AS "count" FROM order_lines GROUP BY ALL')
def q043(spark, sf_dir):
    return value_counts(order_lines(spark, sf_dir), ["BE_ORDER_ID", "SKU"])


@query(
    "o044_describe",
    " UNION ALL ".join(
        f"""
SELECT '{c}' AS "column", count({c}) AS "count", round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
       round(min({c}), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50,
       round(quantile_cont({c}, 0.75), 6) AS p75, round(max({c}), 6) AS max
FROM order_lines"""
        for c in ("PROD_QTY", "PROD_REV_USD")
    ),
)
def q044(spark, sf_dir):
    summary = describe(order_lines(spark, sf_dir), ["PROD_QTY", "PROD_REV_USD"])
    measures = ["mean", "std", "min", "p25", "p50", "p75", "max"]
    return summary.withColumns({c: r6(c) for c in measures})


TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")


@query(
    "o048_basket_matrix",
    "SELECT BE_ORDER_ID, "
    + ", ".join(f"coalesce(sum(CASE WHEN PROD_CAT = '{t}' THEN PROD_QTY END), 0) AS {t}" for t in TYPES)
    + " FROM order_lines GROUP BY BE_ORDER_ID",
)
def q048(spark, sf_dir):
    return basket_matrix(order_lines(spark, sf_dir), TYPES, sku="PROD_CAT")


@query("o048_basket_long", "SELECT BE_ORDER_ID, SKU, sum(PROD_QTY) AS PROD_QTY FROM order_lines GROUP BY ALL")
def q048_long(spark, sf_dir):
    return basket_long(order_lines(spark, sf_dir))


@query("o050_group_count", 'SELECT SHIP_TO_COUNTRY, count(*) AS "count" FROM order_lines GROUP BY ALL')
def q050(spark, sf_dir):
    return value_counts(order_lines(spark, sf_dir), "SHIP_TO_COUNTRY", ordered=False)


@query("o054_row_number", "SELECT CUST_ID, BE_ORDER_ID, LINE_NO, PROD_ID, rn, n FROM numbered")
def q054(spark, sf_dir):
    order = [F.col(c).asc() for c in ("ORDER_DT", *TIEBREAK)]
    numbered = positions(order_lines(spark, sf_dir), ["CUST_ID"], order, out="rn", total="n")
    return numbered.select("CUST_ID", "BE_ORDER_ID", "LINE_NO", "PROD_ID", "rn", "n")


@query(
    "o098_fd_violations",
    """
SELECT PROD_TITLE_PARENT_PROD_ID, count(DISTINCT PGG_PROD_GRP) AS distinct_values
FROM resolved GROUP BY ALL HAVING count(DISTINCT PGG_PROD_GRP) > 1
""",
)
def q098(spark, sf_dir):
    return fd_violations(resolved(spark, sf_dir), "PROD_TITLE_PARENT_PROD_ID", "PGG_PROD_GRP")


@query(
    "o099_duplicate_keys",
    """
SELECT l_orderkey, l_linenumber, count(*) AS "count" FROM lineitem GROUP BY ALL HAVING count(*) > 1
""",
)
def q099(spark, sf_dir):
    return duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "o100_null_profile",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) FILTER ({c} IS NULL) AS nulls, count(*) AS rows FROM order_lines"""
        for c in ("CUST_ID", "PROD_TITLE_PARENT_PROD_ID", "PROD_TITLE_PARENT_TITLE", "PROD_QTY")
    ),
)
def q100(spark, sf_dir):
    return null_profile(
        order_lines(spark, sf_dir), ["CUST_ID", "PROD_TITLE_PARENT_PROD_ID", "PROD_TITLE_PARENT_TITLE", "PROD_QTY"]
    )
