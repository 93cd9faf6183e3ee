"""Keys, joins, merges and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketry.operators.joins import (
    attach_attributes,
    attach_ids,
    audit_pairs,
    dense_grid,
    exclude_seen,
    join_keys,
    lookup_cells,
    merge_counts,
    merge_with_indicator,
    missing_keys,
)
from basketry.operators.filters import restrict_to_keys
from basketry.operators.ordered import dense_ids
from basketry.operators.pairs import basket_pairs
from basketry.operators.splits import fold_pair, kfold, random_split, split_report
from basketry.operators.stats import heaviest_users

from .inputs import interactions, order_lines, split_lines, table, train_valid
from .registry import query


@query(
    "o007_dense_ids",
    """
SELECT SHIP_TO_COUNTRY || '/' || PROD_TITLE AS name,
       CAST(row_number() OVER (ORDER BY SHIP_TO_COUNTRY || '/' || PROD_TITLE) - 1 AS INTEGER) AS id
FROM (SELECT DISTINCT SHIP_TO_COUNTRY, PROD_TITLE FROM order_lines)
""",
)
def q007(spark, sf_dir):
    names = order_lines(spark, sf_dir).select(
        F.concat("SHIP_TO_COUNTRY", F.lit("/"), "PROD_TITLE").alias("name")
    )
    return dense_ids(names, "name", "id")


@query(
    "o025_join_keys",
    """
SELECT v."user", v.item, v.weight FROM valid_pairs v
JOIN (SELECT DISTINCT item FROM train_pairs) t ON v.item = t.item
""",
)
def q025(spark, sf_dir):
    train, valid = train_valid(spark, sf_dir)
    known = train.select("item").distinct()
    return join_keys(valid, known, "item").select("user", "item", "weight")


@query(
    "o026_attach_ids",
    """
SELECT l.BE_ORDER_ID, l.LINE_NO, l.PROD_ID, l.CUST_ID, k.CUST_ID_Int
FROM order_lines l
LEFT JOIN (SELECT CUST_ID, CAST(row_number() OVER (ORDER BY CUST_ID) - 1 AS INTEGER) AS CUST_ID_Int
           FROM (SELECT DISTINCT CUST_ID FROM order_lines)) k ON l.CUST_ID = k.CUST_ID
""",
)
def q026(spark, sf_dir):
    lines = order_lines(spark, sf_dir).select("BE_ORDER_ID", "LINE_NO", "PROD_ID", "CUST_ID")
    return attach_ids(lines, dense_ids(lines, "CUST_ID", "CUST_ID_Int"), "CUST_ID")


@query(
    "o026_attach_attributes",
    """
SELECT i."user", i.item, i.weight, p.p_brand, p.p_type FROM interactions i
LEFT JOIN part p ON p.p_partkey = i.item
""",
)
def q026_attributes(spark, sf_dir):
    attrs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), "p_brand", "p_type")
    return attach_attributes(interactions(spark, sf_dir), attrs, "item").select(
        "user", "item", "weight", "p_brand", "p_type"
    )


@query(
    "o027_lookup_cells",
    """
SELECT v."user", v.item, coalesce(t.weight, 0) AS weight FROM valid_pairs v
LEFT JOIN train_pairs t ON v."user" = t."user" AND v.item = t.item
""",
)
def q027(spark, sf_dir):
    train, valid = train_valid(spark, sf_dir)
    return lookup_cells(valid.select("user", "item"), train, "user", "item", ["weight"])


@query(
    "o028_exclude_seen",
    """
SELECT v."user", v.item, v.weight FROM valid_pairs v
WHERE NOT EXISTS (SELECT 1 FROM train_pairs t WHERE t."user" = v."user" AND t.item = v.item AND t.weight > 0)
""",
)
def q028(spark, sf_dir):
    train, valid = train_valid(spark, sf_dir)
    return exclude_seen(valid, train, weight="weight").select("user", "item", "weight")


@query(
    "o029_missing_keys",
    """
SELECT "user", item FROM valid_pairs EXCEPT SELECT "user", item FROM train_pairs
""",
)
def q029(spark, sf_dir):
    train, valid = train_valid(spark, sf_dir)
    return missing_keys(valid, train, ["user", "item"])


@query(
    "o030_dense_grid",
    """
SELECT u.CUST_ID, b.BRAND, coalesce(f.qty, 0) AS PROD_QTY, coalesce(f.rev, 0) AS PROD_REV_USD
FROM (SELECT DISTINCT CUST_ID FROM order_lines) u
CROSS JOIN (SELECT 'Brand#' || i AS BRAND FROM range(1, 26) r(i)) b
LEFT JOIN (SELECT CUST_ID, BRAND, sum(PROD_QTY) AS qty, round(sum(PROD_REV_USD), 4) AS rev
           FROM order_lines GROUP BY ALL) f ON f.CUST_ID = u.CUST_ID AND f.BRAND = b.BRAND
""",
)
def q030(spark, sf_dir):
    brands = [f"Brand#{i}" for i in range(1, 26)]
    grid = dense_grid(order_lines(spark, sf_dir), "CUST_ID", "BRAND", ["PROD_QTY", "PROD_REV_USD"], brands)
    return grid.withColumn("PROD_REV_USD", F.round("PROD_REV_USD", 4))


@query(
    "o031_left_semi",
    """
SELECT t."user", t.item, t.weight FROM train_pairs t WHERE t.item IN (SELECT item FROM valid_pairs)
""",
)
def q031(spark, sf_dir):
    train, valid = train_valid(spark, sf_dir)
    return restrict_to_keys(train, valid, "item").select("user", "item", "weight")


MERGE_SQL = """
SELECT coalesce(t."user", v."user") AS "user", coalesce(t.item, v.item) AS item,
       t.weight AS weight_x, v.weight AS weight_y,
       CASE WHEN t."user" IS NULL THEN 'right_only' WHEN v."user" IS NULL THEN 'left_only' ELSE 'both' END AS _merge
FROM {left} t {how} JOIN valid_pairs v ON t."user" = v."user" AND t.item = v.item
"""


@query("o032_merge_left", f"SELECT * FROM ({MERGE_SQL.format(left='train_pairs', how='LEFT')}) WHERE _merge = 'both'")
def q032(spark, sf_dir):
    train, valid = train_valid(spark, sf_dir)
    merged = merge_with_indicator(train, valid, ["user", "item"], "left")
    return merged.filter(F.col("_merge") == "both")


@query("o033_merge_outer", MERGE_SQL.format(left="train_pairs", how="FULL"))
def q033(spark, sf_dir):
    train, valid = train_valid(spark, sf_dir)
    return merge_with_indicator(train, valid, ["user", "item"], "outer")


@query(
    "o034_merge_counts",
    f"SELECT _merge, count(*) AS count FROM ({MERGE_SQL.format(left='train_pairs', how='FULL')}) GROUP BY _merge",
)
def q034(spark, sf_dir):
    return merge_counts(q033(spark, sf_dir))


@query(
    "o035_basket_pairs",
    """
WITH b AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)
SELECT x.l_orderkey, x.l_partkey AS item_a, y.l_partkey AS item_b
FROM b x JOIN b y ON x.l_orderkey = y.l_orderkey AND x.l_partkey < y.l_partkey
""",
)
def q035(spark, sf_dir):
    return basket_pairs(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")


AUDIT_SQL = f"""
SELECT m."user", m.item, m.weight_x, m.weight_y, m._merge
FROM ({MERGE_SQL.format(left="train_pairs", how="FULL")}) m
WHERE m."user" IN (SELECT "user" FROM (SELECT * FROM train_pairs ORDER BY weight DESC, "user", item LIMIT 500))
"""


def audit(spark, sf_dir, predicate=None):
    train, valid = train_valid(spark, sf_dir)
    return audit_pairs(train, valid, heaviest_users(train, 500), predicate=predicate)


@query("o036_audit_pairs", AUDIT_SQL)
def q036(spark, sf_dir):
    return audit(spark, sf_dir)


@query("o022_predicates", AUDIT_SQL + " AND m._merge = 'left_only' AND m.weight_x > 10")
def q022(spark, sf_dir):
    return audit(spark, sf_dir, "_merge = 'left_only' AND weight_x > 10")


@query(
    "o055_heaviest_users",
    """
SELECT DISTINCT "user" FROM (SELECT * FROM train_pairs ORDER BY weight DESC, "user", item LIMIT 500)
""",
)
def q055(spark, sf_dir):
    train, _ = train_valid(spark, sf_dir)
    return heaviest_users(train, 500)


FOLD = '(("user" * 1000003 + item * 7919 + 104729) % 1000000007) % 5'


@query(
    "o056_fold_union",
    f"""
SELECT "user", item, weight FROM interactions WHERE {FOLD} <> 0
""",
)
def q056(spark, sf_dir):
    return fold_pair(kfold(interactions(spark, sf_dir)), 0)[0]


@query(
    "o057_chrono_split",
    """
SELECT CUST_ID, BE_ORDER_ID, LINE_NO, PROD_ID, PROD_QTY, ORDER_DT, split FROM split_lines
""",
)
def q057(spark, sf_dir):
    return split_lines(spark, sf_dir).select(
        "CUST_ID", "BE_ORDER_ID", "LINE_NO", "PROD_ID", "PROD_QTY", "ORDER_DT", "split"
    )


@query(
    "o058_kfold",
    f"""
SELECT "user", item, weight, CAST({FOLD} AS INTEGER) AS fold FROM interactions
""",
)
def q058(spark, sf_dir):
    return kfold(interactions(spark, sf_dir))


@query(
    "o059_random_split",
    """
SELECT count(*) AS rows, count(*) AS distinct_rows, 3 AS parts, CAST(0 AS BIGINT) AS in_several_parts FROM interactions
""",
)
def q059(spark, sf_dir):
    """What holds for every draw: no row is lost, none is in two parts."""
    parts = random_split(interactions(spark, sf_dir), [0.6, 0.2, 0.2])
    per_row = parts.groupBy("user", "item").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("part").alias("p"), F.max("part").alias("last")
    )
    return per_row.agg(
        F.sum("n").alias("rows"),
        F.count(F.lit(1)).alias("distinct_rows"),
        F.count_distinct("last").cast("int").alias("parts"),
        F.count_if(F.col("p") > 1).alias("in_several_parts"),
    )


@query(
    "o060_split_report",
    """
SELECT split, count(*) AS rows, (SELECT count(*) FROM lineitem) AS total FROM split_lines GROUP BY split
""",
)
def q060(spark, sf_dir):
    return split_report(split_lines(spark, sf_dir))
