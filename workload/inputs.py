"""The given tables seen as retail data, in Spark and in SQL.

``order_lines``: lineitem with its order, product, customer and country, under retail column names.
``ev_*``: the events table as user-item interactions, with a deterministic scorer on top.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.functions import resolve_parent, split_group
from basketry.operators.joins import exclude_seen
from basketry.operators.ordered import top_k
from basketry.operators.pairs import item_similarity, score_by_similarity
from basketry.operators.splits import chrono_split
from basketry.plans.training import held_out_pairs, stored_split
from basketry.session import freeze
from basketry.sources import read_orders

from .registry import part

TIEBREAK = ("BE_ORDER_ID", "LINE_NO", "PROD_ID", "PROD_QTY", "LIST_PRICE")
K = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_orders(spark, f"{sf_dir}/{name}.parquet")


def r6(col: Column | str) -> Column:
    return F.round(F.col(col) if isinstance(col, str) else col, 6)


part(
    "order_lines",
    """
SELECT o.o_custkey AS CUST_ID, l.l_orderkey AS BE_ORDER_ID, o.o_orderdate AS ORDER_DT,
       l.l_partkey AS PROD_ID, l.l_partkey AS SKU, p.p_name AS PROD_TITLE,
       CASE WHEN l.l_partkey % 3 = 0 THEN NULL ELSE l.l_partkey - l.l_partkey % 3 END AS PROD_TITLE_PARENT_PROD_ID,
       CASE WHEN l.l_partkey % 3 = 0 THEN NULL
            ELSE 'Family ' || CAST(l.l_partkey - l.l_partkey % 3 AS VARCHAR) END AS PROD_TITLE_PARENT_TITLE,
       p.p_brand || ':' || p.p_type || ' ' || split_part(p.p_name, ' ', 2) AS PROD_GRP,
       p.p_brand AS BRAND, p.p_type AS PROD_CAT, c.c_mktsegment AS SITE, n.n_name AS SHIP_TO_COUNTRY,
       l.l_quantity AS PROD_QTY, l.l_extendedprice * (1 - l.l_discount) AS PROD_REV_USD,
       l.l_linenumber AS LINE_NO, l.l_extendedprice AS LIST_PRICE
FROM lineitem l
JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN part p ON l.l_partkey = p.p_partkey
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
""",
)


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, order = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    product, customer = table(spark, sf_dir, "part"), table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    # Dimensions meet first: the line table is only shuffled by order and by product.
    buyer = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    purchase = order.join(buyer, F.col("o_custkey") == F.col("c_custkey"))
    joined = line.join(purchase, F.col("l_orderkey") == F.col("o_orderkey")).join(
        product, F.col("l_partkey") == F.col("p_partkey")
    )
    own = F.col("l_partkey")
    family = F.when(own % 3 != 0, own - own % 3)
    noun = F.split_part("p_name", F.lit(" "), F.lit(2))
    return joined.select(
        F.col("o_custkey").alias("CUST_ID"),
        F.col("l_orderkey").alias("BE_ORDER_ID"),
        F.col("o_orderdate").alias("ORDER_DT"),
        own.alias("PROD_ID"),
        own.alias("SKU"),
        F.col("p_name").alias("PROD_TITLE"),
        family.alias("PROD_TITLE_PARENT_PROD_ID"),
        F.concat(F.lit("Family "), family.cast("string")).alias("PROD_TITLE_PARENT_TITLE"),
        F.concat("p_brand", F.lit(":"), "p_type", F.lit(" "), noun).alias("PROD_GRP"),
        F.col("p_brand").alias("BRAND"),
        F.col("p_type").alias("PROD_CAT"),
        F.col("c_mktsegment").alias("SITE"),
        F.col("n_name").alias("SHIP_TO_COUNTRY"),
        F.col("l_quantity").alias("PROD_QTY"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("PROD_REV_USD"),
        F.col("l_linenumber").alias("LINE_NO"),
        F.col("l_extendedprice").alias("LIST_PRICE"),
    )


part(
    "resolved",
    """
SELECT * EXCLUDE (PROD_GRP, PROD_TITLE_PARENT_PROD_ID, PROD_TITLE_PARENT_TITLE),
       PROD_GRP AS PGG_PROD_GRP, split_part(PROD_GRP, ':', 1) AS PGG, split_part(PROD_GRP, ':', 2) AS PROD_GRP,
       coalesce(PROD_TITLE_PARENT_PROD_ID, PROD_ID) AS PROD_TITLE_PARENT_PROD_ID,
       CASE WHEN PROD_TITLE_PARENT_PROD_ID IS NULL THEN PROD_TITLE ELSE PROD_TITLE_PARENT_TITLE END
           AS PROD_TITLE_PARENT_TITLE
FROM order_lines
""",
)


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve_parent(split_group(order_lines(spark, sf_dir)))


part(
    "interactions",
    """
SELECT CUST_ID AS "user", PROD_TITLE_PARENT_PROD_ID AS item, sum(PROD_QTY) AS weight
FROM resolved GROUP BY ALL
""",
)


def as_pairs(lines: DataFrame) -> DataFrame:
    return held_out_pairs(lines, out="weight").withColumnsRenamed(
        {"CUST_ID": "user", "PROD_TITLE_PARENT_PROD_ID": "item"}
    )


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_pairs(resolved(spark, sf_dir))


part(
    "numbered",
    """
SELECT *, row_number() OVER (PARTITION BY CUST_ID
           ORDER BY ORDER_DT, BE_ORDER_ID, LINE_NO, PROD_ID, PROD_QTY, LIST_PRICE) AS rn,
       count(*) OVER (PARTITION BY CUST_ID) AS n
FROM resolved
""",
)
part(
    "split_sizes",
    """
SELECT *, round_even(CAST(0.6 AS DOUBLE) * n, 0) AS n_train,
       round_even(CAST(0.5 AS DOUBLE) * (n - round_even(CAST(0.6 AS DOUBLE) * n, 0)), 0) AS n_valid
FROM numbered
""",
)
part(
    "split_lines",
    """
SELECT * EXCLUDE (rn, n, n_train, n_valid),
       CASE WHEN rn <= n_train THEN 'train' WHEN rn <= n_train + n_valid THEN 'valid' ELSE 'test' END AS split
FROM split_sizes
""",
)


def split_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chrono_split(resolved(spark, sf_dir), tiebreak=TIEBREAK)


for _name in ("train", "valid"):
    part(
        f"{_name}_pairs",
        f"""
SELECT CUST_ID AS "user", PROD_TITLE_PARENT_PROD_ID AS item, sum(PROD_QTY) AS weight
FROM split_lines WHERE split = '{_name}' GROUP BY ALL
""",
    )


PAIR_COLUMNS = ("CUST_ID", "ORDER_DT", "PROD_TITLE_PARENT_PROD_ID", "PROD_QTY")


def stored_lines(spark: SparkSession, sf_dir: str, keep: Sequence[str] | None = None) -> DataFrame:
    lines = resolved(spark, sf_dir)
    wanted = ["CUST_ID", "ORDER_DT", "PROD_TITLE_PARENT_PROD_ID", *TIEBREAK]
    return stored_split(lines.select(*wanted), keep=keep, tiebreak=TIEBREAK)


def part_pairs(lines: DataFrame, name: str) -> DataFrame:
    return as_pairs(lines.filter(F.col("split") == name))


def train_valid(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = stored_lines(spark, sf_dir, PAIR_COLUMNS)
    return part_pairs(lines, "train"), part_pairs(lines, "valid")


part(
    "ev",
    """
SELECT event_id, ts, user_id AS "user", event_type, value,
       CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS item
FROM events
""",
)


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id",
        "ts",
        F.col("user_id").alias("user"),
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("long").alias("item"),
    )


part(
    "ev_split",
    """
SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY ts, event_id)
          <= round_even(CAST(0.6 AS DOUBLE) * count(*) OVER (PARTITION BY "user"), 0) AS early
FROM ev
""",
)
part("ev_train", """SELECT DISTINCT "user", item FROM ev_split WHERE early""")
part(
    "ev_later",
    """
SELECT "user", item, count(*) AS rating FROM ev_split WHERE NOT early GROUP BY ALL
""",
)
part(
    "ev_truth",
    """
SELECT l."user", l.item, l.rating FROM ev_later l
WHERE NOT EXISTS (SELECT 1 FROM ev_train t WHERE t."user" = l."user" AND t.item = l.item)
""",
)
part("ev_item_count", """SELECT item, count(*) AS c FROM ev_train GROUP BY item""")
part(
    "ev_sim",
    """
SELECT p.item_a, p.item_b, p.together,
       p.together / sqrt(CAST(a.c AS DOUBLE) * b.c) AS similarity
FROM (SELECT x.item AS item_a, y.item AS item_b, count(*) AS together
      FROM ev_train x JOIN ev_train y ON x."user" = y."user" AND x.item < y.item GROUP BY ALL) p
JOIN ev_item_count a ON a.item = p.item_a
JOIN ev_item_count b ON b.item = p.item_b
""",
)
part(
    "ev_scores",
    """
SELECT t."user", s.other AS item, round(sum(s.similarity), 6) AS prediction
FROM ev_train t
JOIN (SELECT item_a AS item, item_b AS other, similarity FROM ev_sim
      UNION ALL SELECT item_b, item_a, similarity FROM ev_sim) s ON s.item = t.item
GROUP BY ALL
""",
)
part(
    "ev_preds",
    """
SELECT s."user", s.item, s.prediction FROM ev_scores s
WHERE NOT EXISTS (SELECT 1 FROM ev_train t WHERE t."user" = s."user" AND t.item = s.item)
""",
)
part(
    "ev_top",
    f"""
SELECT "user", item, prediction, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY prediction DESC, item) AS rank FROM ev_preds)
WHERE rank <= {K}
""",
)
part(
    "ev_rated",
    """
SELECT p."user", p.item, p.prediction, coalesce(l.rating, 0) AS rating
FROM ev_preds p LEFT JOIN ev_later l ON l."user" = p."user" AND l.item = p.item
""",
)


class EventInputs:
    """The event-based frames. Those that several steps read are stored once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        halves = chrono_split(
            ev(spark, sf_dir), "user", "ts", (0.6, 0.4), ["event_id"], names=("early", "later")
        )
        early = F.col("split") == "early"
        self.train = freeze(halves.filter(early).select("user", "item").distinct())
        later = halves.filter(~early).groupBy("user", "item")
        self.later = later.agg(F.count(F.lit(1)).alias("rating"))
        self.truth = exclude_seen(self.later, self.train)
        self.similarity = freeze(item_similarity(self.train))

    def scores(self) -> DataFrame:
        return score_by_similarity(self.train, self.similarity)

    def preds(self) -> DataFrame:
        return exclude_seen(self.scores(), self.train)

    def top(self, rank: str | None = None) -> DataFrame:
        return top_k(self.preds(), K, rank=rank)

    def rated(self) -> DataFrame:
        """Stored: what ranks them reads them more than once."""
        return freeze(self.preds().join(self.later, ["user", "item"], "left").fillna(0, ["rating"]))
