"""URL verdicts from listed rules and, where none fits, from trust that walks along the links of hosts.

Everything is DataFrame expressions, joins and aggregates; only host tables are iterated.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

# The rules of the contract as (host, path, verdict).
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
DAMPING = 0.85
STEPS = 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# The host of an absolute or scheme-relative link.
HREF = r"""(?i)\bhref[\x20\x09-\x0D]*=[\x20\x09-\x0D]*["']?[\x20\x09-\x0D]*(?:https?:)?//([^/?#"'<>\x20\x09-\x0D]+)"""


def url_host(url: Column) -> Column:
    """Text after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; '' without one."""
    return F.translate(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest rule of the host or a parent domain whose path begins the url's path, else NULL.

    A struct ``rule, verdict``; rules of one length are told apart by the longer host.
    """
    ordered = sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), len(r[0])), reverse=True)
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule_host, rule_path, verdict in reversed(ordered):
        inside = (host == rule_host) | F.endswith(host, F.lit("." + rule_host))
        value = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(inside & F.startswith(path, F.lit(rule_path)), value).otherwise(found)
    return found


def host_edges(pages: DataFrame, html: str = "html") -> DataFrame:
    """``src, dst, n``: on how many pages host ``src`` links to another host ``dst``.

    A page counts once per host it links to; links to the page's own host carry nothing over.
    """
    linked = F.array_distinct(F.transform(F.regexp_extract_all(html, F.lit(HREF), 1), lambda h: F.translate(h, UPPER, LOWER)))
    pairs = pages.filter(F.col("host") != "").select(F.col("host").alias("src"), F.explode(linked).alias("dst"))
    return pairs.filter(F.col("src") != F.col("dst")).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagate(
    seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, steps: int = STEPS
) -> DataFrame:
    """``host, trust, distrust`` of every host in ``seeds`` or ``edges``.

    ``seeds`` has ``host, trusted, blocked`` masses, ``edges`` ``src, dst, n``. Trust is a personalised
    PageRank: walks start at trusted mass and follow links, in proportion to ``n``. Distrust walks
    the links backwards from blocked mass, so a host that links to blocked ones is distrusted. A walk
    goes on with probability ``damping``, for ``steps`` links at most, and ends at a host without a
    further link. Every step joins the edges to one row per host and adds what arrives, with partial
    sums before the shuffle; its result is stored, so a lost executor repeats one step.
    """
    share = {"trusted": ("src", "dst"), "blocked": ("dst", "src")}
    moves = []
    for kind, (giver, taker) in share.items():
        total = edges.groupBy(giver).agg(F.sum("n").alias("total"))
        part = F.lit(damping) * F.col("n") / F.col("total")
        zero = F.lit(0.0)
        moves.append(
            edges.join(total, giver).select(
                F.col(giver).alias("giver"),
                F.col(taker).alias("host"),
                (part if kind == "trusted" else zero).alias("of_trust"),
                (part if kind == "blocked" else zero).alias("of_distrust"),
            )
        )
    moves = stored(reduce(DataFrame.unionByName, moves))
    ends = moves.select("host").distinct()
    start = (
        seeds.filter(F.col("host") != "")
        .join(ends, "host", "full_outer")
        .select(
            "host",
            *[(F.lit(1 - damping) * F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(c) for c in share],
        )
    )
    state = stored(start.select("*", F.col("trusted").alias("trust"), F.col("blocked").alias("distrust")))
    for _ in range(steps if moves.take(1) else 0):
        arrived = (
            moves.join(state.select(F.col("host").alias("giver"), "trust", "distrust"), "giver")
            .groupBy("host")
            .agg(
                F.sum(F.col("of_trust") * F.col("trust")).alias("in_trust"),
                F.sum(F.col("of_distrust") * F.col("distrust")).alias("in_distrust"),
            )
        )
        zero = F.lit(0.0)
        state = stored(
            state.join(arrived, "host", "left").select(
                "host",
                "trusted",
                "blocked",
                (F.col("trusted") + F.coalesce("in_trust", zero)).alias("trust"),
                (F.col("blocked") + F.coalesce("in_distrust", zero)).alias("distrust"),
            )
        )
    return state.select("host", "trust", "distrust")


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    threshold: float = 1.0,
    damping: float = DAMPING,
    steps: int = STEPS,
    url: str = "url",
    html: str = "html",
) -> DataFrame:
    """``row, host, path, rule, verdict, trust, distrust`` of every page; ``row`` is the given row.

    Pages that a rule decides are the seeds: a host is trusted by as many pages as rules allow on it
    and distrusted by as many as they block. Other pages are blocked if their host's distrust is
    above ``threshold`` times its trust; hosts that nothing reaches have 0 of both and are allowed.

    A url that is NULL, empty or without ``://`` has an empty host, which no rule fits and no link
    joins: it is allowed. NULL html has no links. Repeated pages count as often as they appear. One
    row per host meets the pages in a join that adaptive execution splits where a host is hot.
    """
    row = F.struct(*[F.col(c) for c in pages.columns]).alias("row")
    at = F.col(f"row.{url}")
    parts = pages.select(row).select("row", url_host(at).alias("host"), url_path(at).alias("path"))
    parts = parts.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    counted = parts.select("host", F.col("fit.verdict").alias("verdict"), F.col(f"row.{html}").alias("html"))
    seeds = counted.groupBy("host").agg(
        F.count_if(F.col("verdict") == "allow").alias("trusted"),
        F.count_if(F.col("verdict") == "block").alias("blocked"),
    )
    scores = propagate(seeds, stored(host_edges(counted)), damping, steps)
    zero = F.lit(0.0)
    trust, distrust = F.coalesce("trust", zero), F.coalesce("distrust", zero)
    # Sums of doubles may differ in the last digits with the order of the rows.
    above = distrust - F.lit(threshold) * trust > F.lit(1e-9) * (trust + distrust)
    return parts.join(scores, "host", "left").select(
        "row",
        "host",
        "path",
        F.col("fit.rule").alias("rule"),
        F.coalesce("fit.verdict", F.when(above, "block").otherwise("allow")).alias("verdict"),
        trust.alias("trust"),
        distrust.alias("distrust"),
    )


SQL = rf"""
WITH RECURSIVE u AS (
  SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), p AS (
  SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u
), rules(rule_host, rule_path, verdict) AS (
  VALUES {", ".join(str(r) for r in RULES)}
), fits AS (
  SELECT page_id, rule_host || rule_path AS rule, verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC) AS place
  FROM p JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
), judged AS (
  SELECT p.*, f.rule, f.verdict FROM p LEFT JOIN fits f ON f.page_id = p.page_id AND f.place = 1
), links AS (
  SELECT DISTINCT page_id, host AS src, translate(unnest(regexp_extract_all(html, '{HREF.replace("'", "''")}', 1)), '{UPPER}', '{LOWER}') AS dst
  FROM judged WHERE host <> ''
), edges AS (
  SELECT src, dst, count(*) AS n FROM links WHERE src <> dst GROUP BY src, dst
), moves AS (
  SELECT src AS giver, dst AS host, {DAMPING}::DOUBLE * n / sum(n) OVER (PARTITION BY src) AS of_trust, 0::DOUBLE AS of_distrust FROM edges
  UNION ALL
  SELECT dst, src, 0::DOUBLE, {DAMPING}::DOUBLE * n / sum(n) OVER (PARTITION BY dst) FROM edges
), seeds AS (
  SELECT host, {1 - DAMPING}::DOUBLE * sum(trusted) AS trusted, {1 - DAMPING}::DOUBLE * sum(blocked) AS blocked FROM (
    SELECT host, (verdict IS NOT DISTINCT FROM 'allow')::INT AS trusted, (verdict IS NOT DISTINCT FROM 'block')::INT AS blocked
    FROM judged WHERE host <> ''
    UNION ALL SELECT host, 0, 0 FROM moves)
  GROUP BY host
), walk AS (
  SELECT 0 AS step, host, trusted::DOUBLE AS trust, blocked::DOUBLE AS distrust FROM seeds
  UNION ALL
  SELECT a.step, s.host, s.trusted + a.trust, s.blocked + a.distrust
  FROM (SELECT step, host, sum(trust) AS trust, sum(distrust) AS distrust FROM (
          SELECT w.step + 1 AS step, m.host, m.of_trust * w.trust AS trust, m.of_distrust * w.distrust AS distrust
          FROM walk w JOIN moves m ON m.giver = w.host WHERE w.step < {STEPS}
          UNION ALL SELECT step + 1, host, 0::DOUBLE, 0::DOUBLE FROM walk WHERE step < {STEPS})
        GROUP BY step, host) a JOIN seeds s ON s.host = a.host
), scores AS (
  SELECT host, trust, distrust FROM walk WHERE step = {STEPS}
)
SELECT page_id, j.host, path, rule,
       CASE WHEN verdict IS NOT NULL THEN verdict
            WHEN coalesce(distrust, 0) - coalesce(trust, 0) > 1e-9 * (coalesce(trust, 0) + coalesce(distrust, 0)) THEN 'block'
            ELSE 'allow' END AS verdict
FROM judged j LEFT JOIN scores s ON s.host = j.host
"""
