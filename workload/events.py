"""Rankings and metrics over the deterministic event-based scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketry.operators.joins import audit_pairs
from basketry.operators.metrics import (
    diversity_metrics,
    evaluate,
    mean_average_precision,
    ranking_metrics,
    roem,
    roem_detail,
    user_diversity,
    user_ranking_metrics,
    user_serendipity,
)
from basketry.operators.metrics.beyond import coverage, novelty
from basketry.operators.ordered import avg_rank_pct, percent_rank_items
from basketry.operators.pairs import item_similarity
from basketry.operators.setjoin import most_similar, similar_items
from basketry.operators.stats import heaviest_users, hit_percentile_range
from basketry.plans.model import as_lists, flatten_recs, flatten_recs_sql, select_best
from basketry.plans.scenarios import popularity
from basketry.session import freeze

from .inputs import K, EventInputs, ev, order_lines, r6, table
from .registry import part, query


@query("o051_top_k", 'SELECT "user", item, prediction, CAST(rank AS INTEGER) AS rank FROM ev_top')
def q051(spark, sf_dir):
    return EventInputs(spark, sf_dir).top(rank="rank")


@query(
    "o052_percent_rank_items",
    """
SELECT "user", item, prediction,
       round(percent_rank() OVER (PARTITION BY "user" ORDER BY prediction DESC), 6) AS percent_rank
FROM ev_preds
""",
)
def q052(spark, sf_dir):
    ranked = percent_rank_items(freeze(EventInputs(spark, sf_dir).preds()))
    return ranked.withColumn("percent_rank", r6("percent_rank"))


part(
    "ev_rank_pct",
    """
SELECT "user", item, prediction, rating,
       (rank() OVER (PARTITION BY "user" ORDER BY prediction DESC)
        + (count(*) OVER (PARTITION BY "user", prediction) - 1) / CAST(2 AS DOUBLE))
       / count(*) OVER (PARTITION BY "user") AS rank_pct
FROM ev_rated
""",
)


@query("o053_avg_rank_pct", 'SELECT "user", item, prediction, rating, round(rank_pct, 6) AS rank_pct FROM ev_rank_pct')
def q053(spark, sf_dir):
    return avg_rank_pct(EventInputs(spark, sf_dir).rated()).withColumn("rank_pct", r6("rank_pct"))


@query("o012_struct_fields", 'SELECT "user", item AS best_item, prediction AS best_rating FROM ev_top WHERE rank = 1')
def q012(spark, sf_dir):
    lists = as_lists(EventInputs(spark, sf_dir).top())
    best = F.get("recommendations", F.lit(0))
    return lists.select("user", best["item"].alias("best_item"), best["rating"].alias("best_rating"))


@query(
    "o013_derived_product",
    'SELECT "user", item, prediction * rank_pct AS score_rank, rating * rank_pct AS item_rank FROM ev_rank_pct',
)
def q013(spark, sf_dir):
    ranked = avg_rank_pct(EventInputs(spark, sf_dir).rated())
    return ranked.select(
        "user",
        "item",
        (F.col("prediction") * F.col("rank_pct")).alias("score_rank"),
        (F.col("rating") * F.col("rank_pct")).alias("item_rank"),
    )


@query(
    "o046_hit_percentile_range",
    """
SELECT printf('%.2f', min(rank_pct) * 100) || '%' AS min_percent, printf('%.2f', max(rank_pct) * 100) || '%' AS max_percent
FROM ev_rank_pct WHERE rating * rank_pct > 0
""",
)
def q046(spark, sf_dir):
    ranked = avg_rank_pct(EventInputs(spark, sf_dir).rated())
    return hit_percentile_range(ranked, rank="rank_pct", formatted=True)


@query("o065_flatten_recs", 'SELECT "user", item, prediction FROM ev_top')
def q065(spark, sf_dir):
    return flatten_recs(as_lists(EventInputs(spark, sf_dir).top()))


@query("o066_flatten_recs_sql", 'SELECT "user", item, prediction FROM ev_top')
def q066(spark, sf_dir):
    return flatten_recs_sql(as_lists(EventInputs(spark, sf_dir).top()), "event_lists")


part(
    "ev_hits",
    """
SELECT t."user", t.rank, CASE WHEN h.item IS NULL THEN 0 ELSE 1 END AS hit,
       sum(CASE WHEN h.item IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY t."user" ORDER BY t.rank) AS so_far
FROM ev_top t LEFT JOIN ev_truth h ON h."user" = t."user" AND h.item = t.item
""",
)
part(
    "ev_user_metrics",
    f"""
SELECT h."user", sum(hit) / CAST({K} AS DOUBLE) AS precision_at_k, sum(hit) / CAST(any_value(s.n) AS DOUBLE) AS recall_at_k,
       sum(hit / log2(rank + 1))
         / any_value((SELECT sum(1 / log2(p.g + 1)) FROM generate_series(1, {K}) p(g) WHERE p.g <= s.n)) AS ndcg_at_k,
       sum(hit * so_far / CAST(rank AS DOUBLE)) / any_value(s.n) AS map,
       sum(hit * so_far / CAST(rank AS DOUBLE)) / least(any_value(s.n), {K}) AS map_at_k
FROM ev_hits h JOIN (SELECT "user", count(*) AS n FROM ev_truth GROUP BY ALL) s ON s."user" = h."user"
GROUP BY h."user"
""",
)
METRIC_NAMES = ["precision_at_k", "recall_at_k", "ndcg_at_k", "map", "map_at_k"]


def mean_query(key: str, *names: str) -> None:
    """One metric of the same evaluation under its own key."""
    wanted = ", ".join(f"round(avg({n}), 6) AS {n}" for n in names)

    @query(key, f"SELECT count(*) AS users, {wanted} FROM ev_user_metrics")
    def run(spark, sf_dir):
        inputs = EventInputs(spark, sf_dir)
        metrics = ranking_metrics(inputs.truth, inputs.preds(), K, unique=True)
        return metrics.select("users", *[r6(n).alias(n) for n in names])


mean_query("o072_precision_at_k", "precision_at_k")
mean_query("o073_recall_at_k", "recall_at_k")
mean_query("o074_ndcg_at_k", "ndcg_at_k")
mean_query("o075_map", "map", "map_at_k")
mean_query("o072_ranking_metrics", *METRIC_NAMES)


@query("o082_evaluate", "SELECT round(avg(ndcg_at_k), 6) AS ndcg_at_k FROM ev_user_metrics")
def q082(spark, sf_dir):
    inputs = EventInputs(spark, sf_dir)
    return evaluate(inputs.truth, inputs.preds(), "ndcg_at_k", K, unique=True).withColumn("ndcg_at_k", r6("ndcg_at_k"))


@query(
    "o072_user_ranking_metrics",
    'SELECT "user", ' + ", ".join(f"round({n}, 6) AS {n}" for n in METRIC_NAMES) + " FROM ev_user_metrics",
)
def q072_users(spark, sf_dir):
    inputs = EventInputs(spark, sf_dir)
    per_user = user_ranking_metrics(inputs.truth, inputs.preds(), K, unique=True)
    return per_user.withColumns({n: r6(n) for n in METRIC_NAMES})


@query(
    "o075_mean_average_precision",
    """
SELECT count(*) AS users, round(avg(coalesce(a.total, 0) / s.n), 6) AS map
FROM (SELECT "user", count(*) AS n FROM ev_truth WHERE "user" IN (SELECT "user" FROM ev_preds) GROUP BY "user") s
LEFT JOIN (SELECT "user", sum(nth / CAST(rank AS DOUBLE)) AS total
           FROM (SELECT r."user", r.rank, row_number() OVER (PARTITION BY r."user" ORDER BY r.rank) AS nth
                 FROM (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY prediction DESC, item) AS rank
                       FROM ev_preds) r
                 JOIN ev_truth t ON t."user" = r."user" AND t.item = r.item)
           GROUP BY "user") a ON a."user" = s."user"
""",
)
def q075_full(spark, sf_dir):
    inputs = EventInputs(spark, sf_dir)
    return mean_average_precision(inputs.truth, freeze(inputs.preds()), unique=True).withColumn("map", r6("map"))


ROEM_SQL = """
SELECT round(sum(rating * pr) / sum(rating), 6) AS roem
FROM (SELECT rating, percent_rank() OVER (PARTITION BY "user" ORDER BY prediction DESC) AS pr FROM {source})
"""


@query("o083_roem", ROEM_SQL.format(source="ev_rated"))
def q083(spark, sf_dir):
    return roem(EventInputs(spark, sf_dir).rated()).withColumn("roem", r6("roem"))


@query(
    "o084_roem_detail",
    """
SELECT d."user", d.item, d.prediction, d.rating, round(d.pr, 6) AS percent_rank,
       round(d.prediction * d.pr, 6) AS np_rank, p.p_brand, p.p_type
FROM (SELECT t.*, coalesce(l.rating, 0) AS rating,
             percent_rank() OVER (PARTITION BY t."user" ORDER BY t.prediction DESC) AS pr
      FROM ev_top t LEFT JOIN ev_later l ON l."user" = t."user" AND l.item = t.item) d
LEFT JOIN part p ON p.p_partkey = d.item
""",
)
def q084(spark, sf_dir):
    inputs = EventInputs(spark, sf_dir)
    attrs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), "p_brand", "p_type")
    detail = roem_detail(freeze(inputs.top()), inputs.later, attrs)
    return detail.withColumns({"percent_rank": r6("percent_rank"), "np_rank": r6("np_rank")})


part(
    "ev_popular_rated",
    """
SELECT u."user", c.item, CAST(c.c AS DOUBLE) AS prediction, r.rating
FROM ev_rated r JOIN ev_item_count c ON c.item = r.item
JOIN (SELECT DISTINCT "user" FROM ev_train) u ON u."user" = r."user"
""",
)


@query(
    "o036_audit_predictions",
    """
SELECT coalesce(p."user", t."user") AS "user", coalesce(p.item, t.item) AS item, p.prediction, t.rating,
       CASE WHEN p."user" IS NULL THEN 'right_only' WHEN t."user" IS NULL THEN 'left_only' ELSE 'both' END AS _merge
FROM ev_top p FULL JOIN ev_truth t ON t."user" = p."user" AND t.item = p.item
WHERE coalesce(p."user", t."user") IN (
    SELECT "user" FROM (SELECT * FROM ev_later ORDER BY rating DESC, "user", item LIMIT 500))
""",
)
def q036_predictions(spark, sf_dir):
    """Predicted lists next to what was bought later, for the users of the 500 heaviest rows."""
    inputs = EventInputs(spark, sf_dir)
    users = heaviest_users(inputs.later, 500, weight="rating")
    return audit_pairs(inputs.top(), inputs.truth, users)


@query(
    "o069_select_best",
    f"""
SELECT model, roem FROM (
    SELECT 'similarity' AS model, roem FROM ({ROEM_SQL.format(source="ev_rated")})
    UNION ALL SELECT 'popularity', roem FROM ({ROEM_SQL.format(source="ev_popular_rated")}))
ORDER BY roem, model LIMIT 1
""",
)
def q069(spark, sf_dir):
    inputs = EventInputs(spark, sf_dir)
    rated = inputs.rated()
    by_popularity = rated.drop("prediction").join(popularity(inputs.train), "item")
    table_ = roem(rated).withColumn("model", F.lit("similarity"))
    table_ = table_.unionByName(roem(by_popularity).withColumn("model", F.lit("popularity")))
    return select_best(table_.select("model", r6("roem").alias("roem")), "roem", minimize=True)


COVERAGE_SQL = {
    "catalog_coverage": "(SELECT count(DISTINCT item) FROM ev_top) / CAST((SELECT count(DISTINCT item) FROM ev_train) AS DOUBLE)",
    "distributional_coverage": """
(SELECT -sum(p * log2(p)) FROM (
    SELECT count(*) / CAST((SELECT count(*) FROM ev_top) AS DOUBLE) AS p FROM ev_top GROUP BY item))""",
    "novelty": """
(SELECT avg(-log2(c.c / CAST((SELECT count(*) FROM ev_train) AS DOUBLE)))
 FROM ev_top t JOIN ev_item_count c ON c.item = t.item)""",
    "diversity": "(SELECT avg(diversity) FROM ev_diversity)",
    "serendipity": "(SELECT avg(serendipity) FROM ev_serendipity)",
}
part(
    "ev_diversity",
    """
SELECT a."user", 1 - avg(coalesce(s.similarity, 0)) AS diversity
FROM ev_top a JOIN ev_top b ON a."user" = b."user" AND a.item < b.item
LEFT JOIN ev_sim s ON s.item_a = a.item AND s.item_b = b.item
GROUP BY a."user"
""",
)
part(
    "ev_serendipity",
    """
SELECT "user", avg(surprise) AS serendipity
FROM (SELECT t."user", t.item, 1 - avg(coalesce(s.similarity, 0)) AS surprise
      FROM ev_top t JOIN ev_train h ON h."user" = t."user"
      LEFT JOIN ev_sim s ON s.item_a = least(t.item, h.item) AND s.item_b = greatest(t.item, h.item)
      GROUP BY t."user", t.item)
GROUP BY "user"
""",
)


@query("o085_catalog_coverage", f"SELECT round({COVERAGE_SQL['catalog_coverage']}, 6) AS catalog_coverage")
def q085(spark, sf_dir):
    inputs = EventInputs(spark, sf_dir)
    return coverage(inputs.train, freeze(inputs.top())).select(r6("catalog_coverage").alias("catalog_coverage"))


@query(
    "o086_distributional_coverage",
    f"SELECT round({COVERAGE_SQL['distributional_coverage']}, 6) AS distributional_coverage",
)
def q086(spark, sf_dir):
    inputs = EventInputs(spark, sf_dir)
    return coverage(inputs.train, freeze(inputs.top())).select(
        r6("distributional_coverage").alias("distributional_coverage")
    )


@query(
    "o087_novelty",
    f"""SELECT round({COVERAGE_SQL['novelty']}, 6) AS novelty,
    (SELECT count(*) FROM ev_top WHERE item NOT IN (SELECT item FROM ev_train)) AS untrained""",
)
def q087(spark, sf_dir):
    inputs = EventInputs(spark, sf_dir)
    return novelty(inputs.train, freeze(inputs.top())).withColumn("novelty", r6("novelty"))


@query("o088_diversity", 'SELECT "user", round(diversity, 6) AS diversity FROM ev_diversity')
def q088(spark, sf_dir):
    inputs = EventInputs(spark, sf_dir)
    return user_diversity(freeze(inputs.top()), inputs.similarity).withColumn("diversity", r6("diversity"))


@query("o089_serendipity", 'SELECT "user", round(serendipity, 6) AS serendipity FROM ev_serendipity')
def q089(spark, sf_dir):
    inputs = EventInputs(spark, sf_dir)
    per_user = user_serendipity(inputs.train, freeze(inputs.top()), inputs.similarity)
    return per_user.withColumn("serendipity", r6("serendipity"))


@query(
    "o085_diversity_metrics",
    "SELECT " + ", ".join(f"round({sql}, 6) AS {name}" for name, sql in COVERAGE_SQL.items()),
)
def q085_all(spark, sf_dir):
    inputs = EventInputs(spark, sf_dir)
    metrics = diversity_metrics(inputs.train, freeze(inputs.top()), inputs.similarity)
    return metrics.withColumns({c: r6(c) for c in COVERAGE_SQL})


part('all_pairs', 'SELECT DISTINCT "user", item FROM ev')
part("all_item_count", "SELECT item, count(*) AS c FROM all_pairs GROUP BY item")


@query(
    "o091_item_similarity",
    """
SELECT p.item_a, p.item_b, p.together, round(p.together / sqrt(CAST(a.c AS DOUBLE) * b.c), 6) AS similarity
FROM (SELECT x.item AS item_a, y.item AS item_b, count(*) AS together
      FROM all_pairs x JOIN all_pairs y ON x."user" = y."user" AND x.item < y.item GROUP BY ALL) p
JOIN all_item_count a ON a.item = p.item_a
JOIN all_item_count b ON b.item = p.item_b
""",
)
def q091(spark, sf_dir):
    return item_similarity(ev(spark, sf_dir)).withColumn("similarity", r6("similarity"))


# Customers as sets of products, of very different sizes.
part("line_pairs", "SELECT DISTINCT CUST_ID AS customer, PROD_ID AS product FROM order_lines")
part("line_sizes", "SELECT product, count(*) AS c FROM line_pairs GROUP BY product")
part(
    "line_sim",
    """
SELECT p.item_a, p.item_b, p.together, p.together / sqrt(CAST(a.c AS DOUBLE) * b.c) AS similarity,
       p.together / CAST(a.c + b.c - p.together AS DOUBLE) AS overlap
FROM (SELECT x.product AS item_a, y.product AS item_b, count(*) AS together
      FROM line_pairs x JOIN line_pairs y ON x.customer = y.customer AND x.product < y.product GROUP BY ALL) p
JOIN line_sizes a ON a.product = p.item_a
JOIN line_sizes b ON b.product = p.item_b
""",
)


@query(
    "o091_similar_items",
    "SELECT item_a, item_b, together, round(overlap, 6) AS similarity FROM line_sim WHERE overlap >= CAST(0.06 AS DOUBLE)",
)
def q091_threshold(spark, sf_dir):
    """Products bought by the same customers, above a threshold, without the full table."""
    found = similar_items(order_lines(spark, sf_dir), 0.06, "CUST_ID", "PROD_ID", "jaccard")
    return found.withColumn("similarity", r6("similarity"))


@query(
    "o091_most_similar",
    """
SELECT item, other, together, round(similarity, 6) AS similarity, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY similarity DESC, other) AS rank
      FROM (SELECT item_a AS item, item_b AS other, together, similarity FROM line_sim
            UNION ALL SELECT item_b, item_a, together, similarity FROM line_sim))
WHERE rank <= 5
""",
)
def q091_best(spark, sf_dir):
    """The five most similar products of every product."""
    found = most_similar(order_lines(spark, sf_dir), 5, "CUST_ID", "PROD_ID", levels=(0.3, 0.15))
    return found.withColumn("similarity", r6("similarity"))
