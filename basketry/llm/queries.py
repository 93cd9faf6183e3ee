"""One query per text operator, over whole tables, and their SQL twins where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .alignment import Aligner, align_tokenizers, byte_level, pieces
from .bpe import encode_texts
from .common import given_id, read_table, sha256_text
from .contamination import contaminated, measure_contamination
from .lines import drop_repeated_lines
from .links import SQL as URL_SQL
from .links import judge_urls
from .near import group_near_duplicates
from .pii import KINDS, find_personal_data
from .quality import judge_quality
from .secrets import count_kind, find_secrets, span_text
from .sharding import shard_rows
from .substrings import drop_repeated_spans
from .variants import count_words, group_spellings
from .warc import read_pages, write_archives

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query(
    "op1_line_dedup",
    r"""
WITH cut AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM cut
), owned AS (
  SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10 GROUP BY key
), judged AS (
  SELECT k.doc_id, k.pos, k.line, coalesce(o.owner < k.doc_id, false) AS dropped
  FROM keyed k LEFT JOIN owned o ON k.key = o.key
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (dropped) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
""",
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = drop_repeated_lines(read_table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", sha256_text(F.col("text")).alias("kept_sha256"))


@query("op2_minhash_near_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = group_near_duplicates(read_table(spark, sf_dir, "documents"))
    return groups.select(
        given_id("doc").alias("doc_id"),
        "n_shingles",
        given_id("component_id").alias("component_id"),
        (F.col("doc") == F.col("component_id")).alias("kept"),
    )


@query("op3_secret_scan")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(read_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *[count_kind("base", k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(span_text(F.col("base")), 256).alias("base_sha256"),
        span_text(F.concat("base", "added")).alias("spans"),
    )


@query("op4_substring_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = drop_repeated_spans(read_table(spark, sf_dir, "documents"))
    return cleaned.select("row.doc_id", "n_words", "n_removed", sha256_text(F.col("kept")).alias("kept_sha256"))


@query("op5_personal_data")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(read_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *[count_kind("base", k).alias(f"n_{k}") for k in KINDS],
        F.sha2(span_text(F.col("base")), 256).alias("base_sha256"),
        span_text(F.concat("base", "added")).alias("spans"),
    )


@query("op6_bpe")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    coded = encode_texts(read_table(spark, sf_dir, "documents"), path)
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        sha256_text(F.col("decoded")).alias("decoded_sha256"),
    )


@query("op7_rendezvous")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(read_table(spark, sf_dir, "documents"), n_shards=40)


@query("op8_decontamination")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = measure_contamination(
        read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    )
    return found.select(
        "row.doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        sha256_text(F.array_join("items", ",")).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


@query("op9_quality_rules")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(read_table(spark, sf_dir, "documents")).drop("text_key")


@query(
    "op10_warc",
    r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last_id
  FROM pages
), h AS (
  SELECT *, sha1(html) AS hex FROM p
), bits AS (
  SELECT page_id, last_id, html,
         list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + list_sum(list_transform(range(0, 5), lambda b:
             ((strpos('0123456789abcdef', hex[1 + (i * 5 + b) // 4]) - 1) >> (3 - (i * 5 + b) % 4)) % 2
             * (16 >> b)))::INT, 1)) AS letters
  FROM h
)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
       array_to_string(letters, '') AS payload_digest,
       CASE WHEN page_id = last_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = last_id THEN NULL ELSE last_id END AS refers_to
FROM bits
""",
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "archives")
    write_archives(read_table(spark, sf_dir, "pages"), path)
    return read_pages(spark, path).drop("payload")


@query("op11_url_filters", URL_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_urls(read_table(spark, sf_dir, "pages"))
    return judged.select("row.page_id", "host", "path", "rule", "verdict")


@query("op12_spelling_variants")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = count_words(read_table(spark, sf_dir, "documents"), min_chars=6, min_count=5, typo_every=199)
    return group_spellings(words, ratio=5)


@lru_cache(maxsize=1)
def public_aligner() -> Aligner:
    """The two vocabularies, found on the machine of the task."""
    a = byte_level(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return Aligner(a, pieces(public_tokenizers.path("piece_bpe_32k.model")))


@query("op13_tokenizer_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(read_table(spark, sf_dir, "documents"), public_aligner)
