"""Retail scenarios and business metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketry.operators.pairs import bought_together, similar_by_attributes, similar_by_vector
from basketry.plans.scenarios import ab_test, ctr, popularity, rerank, revenue_per_order, with_fallback

from .inputs import K, EventInputs, ev, order_lines, r6, table
from .registry import part, query

part("baskets", "SELECT DISTINCT l_orderkey, l_partkey FROM lineitem")
part("basket_items", "SELECT l_partkey, count(*) AS c FROM baskets GROUP BY ALL")
part(
    "rules",
    """
SELECT x.l_partkey AS item, y.l_partkey AS other, count(*) AS together
FROM baskets x JOIN baskets y ON x.l_orderkey = y.l_orderkey AND x.l_partkey <> y.l_partkey
GROUP BY ALL HAVING count(*) >= 2
""",
)


@query(
    "o092_bought_together",
    """
SELECT item, other, together, round(support, 9) AS support, round(confidence, 6) AS confidence, round(lift, 6) AS lift
FROM (SELECT r.*, r.together / CAST(t.n AS DOUBLE) AS support, r.together / CAST(a.c AS DOUBLE) AS confidence,
             r.together * CAST(t.n AS DOUBLE) / (CAST(a.c AS DOUBLE) * b.c) AS lift,
             row_number() OVER (PARTITION BY r.item ORDER BY r.together DESC, r.other) AS rn
      FROM rules r JOIN basket_items a ON a.l_partkey = r.item JOIN basket_items b ON b.l_partkey = r.other,
           (SELECT count(DISTINCT l_orderkey) AS n FROM lineitem) t)
WHERE rn <= 5
""",
)
def q092(spark, sf_dir):
    rules = bought_together(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey", min_count=2, n=5)
    return rules.withColumns(
        {"support": F.round("support", 9), "confidence": r6("confidence"), "lift": r6("lift")}
    )


@query(
    "o093_similar_by_attributes",
    """
WITH placed AS (
    SELECT p_partkey, p_type, p_retailprice,
           row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice, p_partkey) AS pos FROM part)
SELECT p_partkey, alternative, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank
FROM (SELECT a.p_partkey, b.p_partkey AS alternative, abs(b.p_retailprice - a.p_retailprice) AS distance,
             row_number() OVER (PARTITION BY a.p_partkey
                 ORDER BY abs(b.p_retailprice - a.p_retailprice), abs(b.pos - a.pos), b.pos) AS rank
      FROM placed a JOIN placed b ON a.p_type = b.p_type AND a.p_partkey <> b.p_partkey)
WHERE rank <= 5
""",
)
def q093(spark, sf_dir):
    similar = similar_by_attributes(table(spark, sf_dir, "part"), "p_partkey", ["p_type"], "p_retailprice", 5)
    return similar.withColumn("distance", r6("distance"))


@query(
    "o093_similar_by_size_and_price",
    """
SELECT p_partkey, alternative, distance, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY distance, alternative) AS rank
      FROM (SELECT a.p_partkey, b.p_partkey AS alternative,
                   round(sqrt(power(a.p_size / 50.0::DOUBLE - b.p_size / 50.0::DOUBLE, 2)
                              + power(a.p_retailprice / 2000.0::DOUBLE - b.p_retailprice / 2000.0::DOUBLE, 2)), 6) AS distance
            FROM part a JOIN part b ON a.p_type = b.p_type AND a.p_partkey <> b.p_partkey))
WHERE rank <= 5
""",
)
def q093_several(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(
        "p_partkey", "p_type", (F.col("p_size") / 50.0).alias("size"), (F.col("p_retailprice") / 2000.0).alias("price")
    )
    return similar_by_attributes(parts, "p_partkey", ["p_type"], ["size", "price"], 5)


@query(
    "o094_similar_by_vector",
    """
SELECT item, other, similarity, CAST(rank AS INTEGER) AS rank
FROM (SELECT item, other, similarity, row_number() OVER (PARTITION BY item ORDER BY similarity DESC, other) AS rank
      FROM (SELECT a.vec_id AS item, b.vec_id AS other,
                   round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity
            FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id))
WHERE rank <= 5
""",
)
def q094(spark, sf_dir):
    return similar_by_vector(table(spark, sf_dir, "embeddings"), 5, "vec_id", "embedding", "label")


@query(
    "o095_with_fallback",
    f"""
SELECT "user", item, prediction, 'model' AS source FROM ev_top
UNION ALL
SELECT c.c_custkey, p.item, p.prediction, 'popular'
FROM customer c, (SELECT item, CAST(c AS DOUBLE) AS prediction FROM ev_item_count ORDER BY c DESC, item LIMIT {K}) p
WHERE c.c_custkey NOT IN (SELECT "user" FROM ev_top)
""",
)
def q095(spark, sf_dir):
    inputs = EventInputs(spark, sf_dir)
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user"))
    return with_fallback(inputs.top(), customers, popularity(inputs.train), K)


@query(
    "o096_rerank",
    f"""
SELECT "user", item, round(boosted, 8) AS prediction, CAST(rank AS INTEGER) AS rank
FROM (SELECT "user", item, boosted, row_number() OVER (PARTITION BY "user" ORDER BY boosted DESC, item) AS rank
      FROM (SELECT e."user", e.item, e.prediction * coalesce(b.factor, 1) AS boosted
            FROM ev_preds e
            LEFT JOIN (SELECT p_partkey, CASE WHEN p_size <= 10 THEN CAST(1.25 AS DOUBLE) ELSE CAST(0.75 AS DOUBLE) END AS factor
                       FROM part WHERE p_size <= 10 OR p_size >= 40) b ON b.p_partkey = e.item))
WHERE rank <= {K}
""",
)
def q096(spark, sf_dir):
    sized = table(spark, sf_dir, "part").filter((F.col("p_size") <= 10) | (F.col("p_size") >= 40))
    factor = F.when(F.col("p_size") <= 10, F.lit(1.25)).otherwise(F.lit(0.75))
    boosts = sized.select(F.col("p_partkey").alias("item"), factor.alias("factor"))
    ranked = rerank(EventInputs(spark, sf_dir).preds(), boosts, K)
    return ranked.withColumn("prediction", F.round("prediction", 8))


@query(
    "o097_ctr",
    """
SELECT item, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'click') AS clicks,
       round(count(*) FILTER (event_type = 'click')
             / CAST(nullif(count(*) FILTER (event_type = 'view'), 0) AS DOUBLE), 6) AS ctr
FROM ev GROUP BY item
""",
)
def q097_ctr(spark, sf_dir):
    return ctr(ev(spark, sf_dir), by=["item"]).withColumn("ctr", r6("ctr"))


@query(
    "o097_revenue_per_order",
    """
SELECT count(DISTINCT BE_ORDER_ID) AS orders, round(sum(PROD_REV_USD), 4) AS revenue,
       round(sum(PROD_REV_USD) / count(DISTINCT BE_ORDER_ID), 4) AS revenue_per_order
FROM order_lines
""",
)
def q097_revenue(spark, sf_dir):
    report = revenue_per_order(order_lines(spark, sf_dir))
    return report.withColumns(
        {"revenue": F.round("revenue", 4), "revenue_per_order": F.round("revenue_per_order", 4)}
    )


@query(
    "o097_ab_test",
    """
SELECT na AS trials_a, sa AS successes_a, nb AS trials_b, sb AS successes_b,
       round(ra, 6) AS rate_a, round(rb, 6) AS rate_b, round(rb - ra, 6) AS difference,
       round((rb - ra) / sqrt(p * (1 - p) * (1 / CAST(na AS DOUBLE) + 1 / CAST(nb AS DOUBLE))), 6) AS z_score
FROM (SELECT *, sa / CAST(na AS DOUBLE) AS ra, sb / CAST(nb AS DOUBLE) AS rb, (sa + sb) / CAST(na + nb AS DOUBLE) AS p
      FROM (SELECT count(*) FILTER (bucket = 0) AS na, count(*) FILTER (bucket = 0 AND event_type = 'click') AS sa,
                   count(*) FILTER (bucket = 1) AS nb, count(*) FILTER (bucket = 1 AND event_type = 'click') AS sb
            FROM (SELECT "user" % 2 AS bucket, event_type FROM ev WHERE event_type IN ('view', 'click'))))
""",
)
def q097_ab(spark, sf_dir):
    events = ev(spark, sf_dir).withColumn("bucket", F.col("user") % 2)
    rates = ["rate_a", "rate_b", "difference", "z_score"]
    return ab_test(events, "bucket").withColumns({c: r6(c) for c in rates})
