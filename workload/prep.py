"""Sources, sinks, projections and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketry.functions import (
    cast_columns,
    columns_like,
    decay_weight,
    format_report,
    parse_date_columns,
    resolve_parent,
    split_group,
    zero_fill,
)
from basketry.operators.filters import filter_category, filter_orders, null_rows, restrict_to_keys
from basketry.plans.model import encode_pairs
from basketry.plans.training import ITEM, USER, decayed_preferences, market_lines, preferences, stored_split
from basketry.session import scratch_path
from basketry.sources import concat_frames, query_view, read_orders, read_text_table, register, write_frame

from .inputs import TIEBREAK, order_lines, r6, resolved, split_lines, stored_lines, table
from .registry import part, query

SITE, COUNTRY, BRANDS = "BUILDING", "NATION_7", ("Brand#1", "Brand#2")
CATEGORY = "%ECONOMY%"


@query(
    "o001_read_orders",
    """
SELECT l_orderkey, l_partkey, l_quantity, l_shipdate FROM lineitem WHERE l_quantity > 10
""",
)
def q001(spark, sf_dir):
    lines = read_orders(spark, f"{sf_dir}/lineitem.parquet").filter(F.col("l_quantity") > 10)
    return lines.select("l_orderkey", "l_partkey", "l_quantity", "l_shipdate")


@query(
    "o002_write_frame",
    """
SELECT CUST_ID, BE_ORDER_ID, PROD_ID, PROD_QTY, split FROM split_lines
""",
)
def q002(spark, sf_dir):
    lines = split_lines(spark, sf_dir).select("CUST_ID", "BE_ORDER_ID", "PROD_ID", "PROD_QTY", "split")
    path = write_frame(lines, scratch_path(spark, "written-lines"), partition_by=["split"])
    return read_orders(spark, path)


@query(
    "o003_concat_frames",
    """
SELECT o_orderkey, o_custkey, o_orderdate,
       CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN o_orderpriority END AS o_orderpriority,
       CASE WHEN o_orderdate >= TIMESTAMP '1998-01-01' THEN o_totalprice END AS o_totalprice,
       row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS row_id
FROM orders
""",
)
def q003(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    first = orders.filter(F.col("o_orderdate") < cut)
    second = orders.filter(F.col("o_orderdate") >= cut)
    shared = ["o_orderkey", "o_custkey", "o_orderdate"]
    return concat_frames(
        first.select(*shared, "o_orderpriority"),
        second.select(*shared, "o_totalprice"),
        row_id="row_id",
        order=[F.col("o_orderdate").asc(), F.col("o_orderkey").asc()],
    )


@query(
    "o004_read_text_table",
    """
SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey,
       CAST(c_acctbal AS VARCHAR) AS c_acctbal, c_mktsegment
FROM customer
""",
)
def q004(spark, sf_dir):
    path = scratch_path(spark, "customer-csv")
    table(spark, sf_dir, "customer").write.csv(path, header=True)
    return read_text_table(spark, path)


@query(
    "o005_register",
    """
SELECT SITE, count(*) AS lines, round(sum(PROD_REV_USD), 4) AS revenue FROM order_lines GROUP BY SITE
""",
)
def q005(spark, sf_dir):
    register(order_lines(spark, sf_dir), "shop_lines")
    return spark.sql(
        "SELECT SITE, count(*) AS lines, round(sum(PROD_REV_USD), 4) AS revenue FROM shop_lines GROUP BY SITE"
    )


@query(
    "o006_split_group",
    """
SELECT BE_ORDER_ID, LINE_NO, PROD_ID, PROD_GRP AS PGG_PROD_GRP,
       split_part(PROD_GRP, ':', 1) AS PGG, split_part(PROD_GRP, ':', 2) AS PROD_GRP
FROM order_lines
""",
)
def q006(spark, sf_dir):
    lines = order_lines(spark, sf_dir).select("BE_ORDER_ID", "LINE_NO", "PROD_ID", "PROD_GRP")
    return split_group(lines)


@query(
    "o008_resolve_parent",
    """
SELECT BE_ORDER_ID, LINE_NO, PROD_ID, PROD_TITLE, PROD_TITLE_PARENT_PROD_ID, PROD_TITLE_PARENT_TITLE
FROM resolved
""",
)
def q008(spark, sf_dir):
    lines = order_lines(spark, sf_dir).select(
        "BE_ORDER_ID", "LINE_NO", "PROD_ID", "PROD_TITLE", "PROD_TITLE_PARENT_PROD_ID", "PROD_TITLE_PARENT_TITLE"
    )
    return resolve_parent(lines)


@query(
    "o009_select_columns",
    """
SELECT CUST_ID, PROD_TITLE_PARENT_PROD_ID, PROD_QTY AS Timedecay_SUM
FROM resolved WHERE PGG_PROD_GRP LIKE '%ECONOMY%'
""",
)
def q009(spark, sf_dir):
    kept = filter_category(resolved(spark, sf_dir), CATEGORY)
    return kept.withColumnRenamed("PROD_QTY", "Timedecay_SUM").select(
        "CUST_ID", "PROD_TITLE_PARENT_PROD_ID", "Timedecay_SUM"
    )


@query(
    "o010_zero_fill",
    """
SELECT BE_ORDER_ID, LINE_NO, PROD_ID, coalesce(PROD_TITLE_PARENT_PROD_ID, 0) AS PROD_TITLE_PARENT_PROD_ID,
       PROD_TITLE_PARENT_TITLE
FROM order_lines
""",
)
def q010(spark, sf_dir):
    return zero_fill(
        order_lines(spark, sf_dir).select(
            "BE_ORDER_ID", "LINE_NO", "PROD_ID", "PROD_TITLE_PARENT_PROD_ID", "PROD_TITLE_PARENT_TITLE"
        )
    )


DECAY_SQL = (
    "PROD_QTY * pow(CAST(0.5 AS DOUBLE), date_diff('day', ORDER_DT, "
    "(SELECT max(ORDER_DT) FROM {source})) / CAST(180 AS DOUBLE))"
)


@query(
    "o011_decay_weight",
    f"""
SELECT CUST_ID, BE_ORDER_ID, LINE_NO, PROD_ID, PROD_QTY,
       round({DECAY_SQL.format(source="split_lines WHERE split = 'train'")}, 6) AS Timedecay
FROM split_lines WHERE split = 'train'
""",
)
def q011(spark, sf_dir):
    train = stored_lines(spark, sf_dir).filter(F.col("split") == "train")
    weighted = decay_weight(train)
    return weighted.select(
        "CUST_ID", "BE_ORDER_ID", "LINE_NO", "PROD_ID", "PROD_QTY", r6("Timedecay").alias("Timedecay")
    )


@query(
    "o014_format_report",
    """
SELECT SITE, format('{:,}', count(*)) AS lines,
       printf('%.2f', 100.0 * sum(PROD_QTY) / (SELECT sum(PROD_QTY) FROM order_lines)) || '%' AS share
FROM order_lines GROUP BY SITE
""",
)
def q014(spark, sf_dir):
    lines = order_lines(spark, sf_dir)
    total = lines.select(F.sum("PROD_QTY")).scalar()
    report = lines.groupBy("SITE").agg(
        F.count(F.lit(1)).alias("lines"), (F.sum("PROD_QTY") * 100.0 / F.first(total)).alias("share")
    )
    return format_report(report, counts=["lines"], percents=["share"])


def text_dates(spark, sf_dir):
    """Orders with their dates as text in the two layouts of the extracts, some unreadable."""
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    day = F.date_format(F.date_add("o_orderdate", 3), "dd/MM/yyyy")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_orderstatus",
        stamp.alias("ORDER_DT"),
        F.when(F.col("o_orderstatus") == "P", F.lit("pending")).otherwise(stamp).alias("INVOICE_DT"),
        day.alias("SHIP_DT"),
        stamp.alias("Update_Date"),
    )


@query(
    "o015_parse_date_columns",
    """
SELECT o_orderkey, o_orderdate AS ORDER_DT,
       CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate END AS INVOICE_DT,
       date_trunc('day', o_orderdate) + INTERVAL 3 DAY AS SHIP_DT
FROM orders
""",
)
def q015(spark, sf_dir):
    raw = text_dates(spark, sf_dir).select("o_orderkey", "ORDER_DT", "INVOICE_DT", "SHIP_DT")
    return parse_date_columns(raw)


@query(
    "o016_parse_date_names",
    """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS ORDER_DT, o_orderdate AS Update_Date
FROM orders
""",
)
def q016(spark, sf_dir):
    raw = text_dates(spark, sf_dir).select("o_orderkey", "ORDER_DT", "Update_Date")
    return parse_date_columns(raw, "(?i)date", {}, "yyyy-MM-dd HH:mm:ss")


@query(
    "o017_cast_columns",
    """
SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_linenumber AS VARCHAR) AS l_linenumber,
       CAST(l_partkey AS VARCHAR) AS l_partkey, l_quantity, l_returnflag
FROM lineitem
""",
)
def q017(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    lines = lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag")
    return cast_columns(lines, ["bigint", "int"])


@query(
    "o018_columns_like",
    """
SELECT o_orderdate, o_orderkey, o_orderpriority, o_orderstatus FROM orders
""",
)
def q018(spark, sf_dir):
    return columns_like(table(spark, sf_dir, "orders"), "^o_order")


@query(
    "o019_filter_orders",
    """
SELECT CUST_ID, BE_ORDER_ID, LINE_NO, PROD_ID, BRAND, round(PROD_REV_USD, 4) AS PROD_REV_USD
FROM order_lines
WHERE SITE = 'BUILDING' AND BRAND NOT IN ('Brand#1', 'Brand#2') AND SHIP_TO_COUNTRY = 'NATION_7'
  AND PROD_REV_USD > 0
""",
)
def q019(spark, sf_dir):
    kept = filter_orders(order_lines(spark, sf_dir), SITE, COUNTRY, BRANDS)
    return kept.select(
        "CUST_ID", "BE_ORDER_ID", "LINE_NO", "PROD_ID", "BRAND", F.round("PROD_REV_USD", 4).alias("PROD_REV_USD")
    )


@query(
    "o020_filter_category",
    """
SELECT CUST_ID, BE_ORDER_ID, LINE_NO, PROD_ID, PGG_PROD_GRP FROM resolved WHERE PGG_PROD_GRP LIKE '%ECONOMY%'
""",
)
def q020(spark, sf_dir):
    kept = filter_category(resolved(spark, sf_dir), CATEGORY)
    return kept.select("CUST_ID", "BE_ORDER_ID", "LINE_NO", "PROD_ID", "PGG_PROD_GRP")


@query(
    "o021_null_rows",
    """
SELECT BE_ORDER_ID, LINE_NO, PROD_ID FROM order_lines WHERE PROD_TITLE_PARENT_PROD_ID IS NULL
""",
)
def q021(spark, sf_dir):
    missing = null_rows(order_lines(spark, sf_dir), "PROD_TITLE_PARENT_PROD_ID")
    return missing.select("BE_ORDER_ID", "LINE_NO", "PROD_ID")


@query(
    "o023_restrict_to_keys",
    """
SELECT BE_ORDER_ID, LINE_NO, CUST_ID, PROD_ID FROM order_lines
WHERE CUST_ID IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)
""",
)
def q023(spark, sf_dir):
    rich = table(spark, sf_dir, "customer").filter(F.col("c_acctbal") > 5000)
    lines = order_lines(spark, sf_dir).select("BE_ORDER_ID", "LINE_NO", "CUST_ID", "PROD_ID")
    return restrict_to_keys(lines, rich.select(F.col("c_custkey").alias("CUST_ID")), "CUST_ID")


PREFERENCES_SQL = f"""
SELECT CUST_ID, PROD_TITLE_PARENT_PROD_ID, sum(PROD_QTY) AS PROD_QTY_SUM,
       max(ORDER_DT) AS PARENT_PROD_LAST_ORDER_DT,
       round(sum({DECAY_SQL.format(source="{source}")}), 6) AS Timedecay_SUM
FROM {{source}} WHERE PGG_PROD_GRP LIKE '%ECONOMY%'
GROUP BY CUST_ID, PROD_TITLE_PARENT_PROD_ID HAVING sum(PROD_QTY) > 2
"""


def rounded_preferences(prefs):
    return prefs.withColumn("Timedecay_SUM", r6("Timedecay_SUM"))


@query(
    "o024_min_total",
    """
SELECT CUST_ID, PROD_ID, sum(PROD_QTY) AS PROD_QTY_SUM, max(ORDER_DT) AS PARENT_PROD_LAST_ORDER_DT
FROM order_lines GROUP BY ALL HAVING sum(PROD_QTY) > 40
""",
)
def q024(spark, sf_dir):
    lines = order_lines(spark, sf_dir).withColumn("Timedecay", F.lit(0.0))
    return preferences(lines, 40, item="PROD_ID").drop("Timedecay_SUM")


@query("o045_preferences", PREFERENCES_SQL.format(source="resolved"))
def q045(spark, sf_dir):
    return rounded_preferences(decayed_preferences(resolved(spark, sf_dir), CATEGORY))


MONTHLY_SALES = """
SELECT BRAND, year(ORDER_DT) AS sold_year, month(ORDER_DT) AS sold_month,
       count(DISTINCT CUST_ID) AS buyers, round(sum(PROD_REV_USD), 2) AS revenue
FROM sales WHERE SHIP_TO_COUNTRY = {country}
GROUP BY BRAND, year(ORDER_DT), month(ORDER_DT)
"""


@query("o047_query_view", MONTHLY_SALES.format(country=f"'{COUNTRY}'").replace("FROM sales", "FROM order_lines"))
def q047(spark, sf_dir):
    """Buyers and revenue of each brand and month in one country."""
    lines = order_lines(spark, sf_dir)
    return query_view(lines, "sales", MONTHLY_SALES.format(country=":country"), country=COUNTRY)


def market_preferences(spark, sf_dir):
    """Decayed preferences of one category in one market."""
    lines = market_lines(order_lines(spark, sf_dir), SITE, exclude_brands=BRANDS)
    return rounded_preferences(decayed_preferences(lines, CATEGORY))


def flagship(spark, sf_dir):
    """The training set: market, split, decay up to the newest training line, category, least total, ids."""
    lines = market_lines(order_lines(spark, sf_dir), SITE, exclude_brands=BRANDS)
    wanted = ["CUST_ID", "ORDER_DT", ITEM, "PGG_PROD_GRP", *TIEBREAK]
    train = stored_split(lines.select(*wanted), tiebreak=TIEBREAK).filter(F.col("split") == "train")
    prefs = decayed_preferences(train, CATEGORY)
    pairs, users, items = encode_pairs(prefs, USER, ITEM, "Timedecay_SUM")
    named = pairs.join(users, "user").join(items, "item")
    return named.select("user", "item", USER, ITEM, r6("rating").alias("rating"))


part(
    "market",
    """
SELECT * FROM resolved
WHERE SITE = 'BUILDING' AND BRAND NOT IN ('Brand#1', 'Brand#2') AND PROD_REV_USD > 0
""",
)


@query("o045_market_preferences", PREFERENCES_SQL.format(source="market"))
def q045_market(spark, sf_dir):
    return market_preferences(spark, sf_dir)


_ORDER = "ORDER BY ORDER_DT, BE_ORDER_ID, LINE_NO, PROD_ID, PROD_QTY, LIST_PRICE"
part(
    "market_numbered",
    f"""
SELECT *, row_number() OVER (PARTITION BY CUST_ID {_ORDER}) AS rn, count(*) OVER (PARTITION BY CUST_ID) AS n FROM market
""",
)
part("market_train", "SELECT * FROM market_numbered WHERE rn <= round_even(CAST(0.6 AS DOUBLE) * n, 0)")
part("market_prefs", PREFERENCES_SQL.format(source="market_train"))


@query(
    "o045_train_preferences",
    """
SELECT CAST(dense_rank() OVER (ORDER BY CUST_ID) - 1 AS INTEGER) AS "user",
       CAST(dense_rank() OVER (ORDER BY PROD_TITLE_PARENT_PROD_ID) - 1 AS INTEGER) AS item,
       CUST_ID, PROD_TITLE_PARENT_PROD_ID, Timedecay_SUM AS rating
FROM market_prefs
""",
)
def q045_train(spark, sf_dir):
    return flagship(spark, sf_dir)
