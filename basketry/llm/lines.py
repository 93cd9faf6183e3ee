"""Line dedup against levelled sorted runs of line hashes.

Documents come in batches of ascending id. A batch's distinct line keys are merge-anti-joined with
the runs that earlier batches left: a key found there is a repeat everywhere in the batch, a new
key belongs to its smallest document and goes into a new run. When a level holds ``FANOUT`` runs,
they are merged into one run of the next level, so a key is rewritten once per level and a batch
meets a logarithmic number of runs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import order_id, stored

FANOUT = 3
BATCHES = 4
MIN_CHARS = 10
_BLANK = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without ASCII white space at both ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(_BLANK)), _UPPER, _LOWER)


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class Runs:
    """Sorted runs (h1, h2) in levels; every run is a table sorted by hash inside hash partitions."""

    def __init__(self, fanout: int = FANOUT):
        self.fanout = fanout
        self.levels: list[list[DataFrame]] = []

    def all(self) -> DataFrame | None:
        runs = [r for level in self.levels for r in level]
        return reduce(DataFrame.unionByName, runs) if runs else None

    def add(self, keys: DataFrame, level: int = 0) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(keys)
        if len(self.levels[level]) >= self.fanout:
            merged = reduce(DataFrame.unionByName, self.levels[level])
            self.levels[level] = []
            self.add(stored(sorted_run(merged)), level + 1)


def sorted_run(keys: DataFrame) -> DataFrame:
    return keys.repartition("h1", "h2").sortWithinPartitions("h1", "h2")


def repeated_lines(
    docs: DataFrame, batches: int = BATCHES, fanout: int = FANOUT, min_chars: int = MIN_CHARS
) -> DataFrame:
    """``doc, text_key, dropped``: positions of the lines that belong to a smaller document.

    ``docs`` has ``doc`` (not NULL), ``text_key`` and ``text``. Every step handles one batch; what
    stays between batches are the runs and the positions found so far, both as tables.
    """
    bounds = docs.agg(
        F.percentile_approx("doc", [i / batches for i in range(1, batches)], 10_000)
    ).first()[0] or []
    edges = [None, *sorted(set(bounds)), None]
    runs, found = Runs(fanout), []
    for low, high in zip(edges, edges[1:]):
        batch = docs
        if low is not None:
            batch = batch.filter(F.col("doc") > low)
        if high is not None:
            batch = batch.filter(F.col("doc") <= high)
        cut = batch.select("doc", "text_key", F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
        cut = cut.select("doc", "text_key", "pos", line_key(F.col("line")).alias("key"))
        # Two differently seeded hashes stand for the key, 128 bits in all.
        lines = stored(
            cut.filter(F.char_length("key") >= min_chars).select(
                "doc",
                "text_key",
                "pos",
                F.xxhash64("key").alias("h1"),
                F.xxhash64(F.lit(1), F.col("key")).alias("h2"),
            )
        )
        keys = lines.groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
        known = runs.all()
        if known is None:
            new = keys.withColumn("old", F.lit(False))
        else:
            known = known.withColumn("old", F.lit(True))
            new = keys.join(known, ["h1", "h2"], "left").withColumn("old", F.col("old").isNotNull())
        new = stored(new)
        runs.add(stored(sorted_run(new.filter(~F.col("old")).select("h1", "h2"))))
        shared = new.filter(F.col("old") | (F.col("first") != F.col("last")))
        # One row per shared key meets narrow rows; adaptive execution splits a very common line.
        hits = lines.join(shared.select("h1", "h2", "first", "old"), ["h1", "h2"])
        hits = hits.filter(F.col("old") | (F.col("doc") != F.col("first")))
        found.append(stored(hits.select("doc", "text_key", "pos")))
    hits = reduce(DataFrame.unionByName, found)
    # A row has no more positions than its own text has lines; repeated rows repeat them.
    return hits.groupBy("doc", "text_key").agg(F.collect_set("pos").alias("dropped"))


def drop_repeated_lines(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    batches: int = BATCHES,
    fanout: int = FANOUT,
    min_chars: int = MIN_CHARS,
) -> DataFrame:
    """``docs`` with all columns, repeated lines taken out of ``text``, and ``n_lines, n_dropped``.

    A line whose key has ``min_chars`` characters and occurs in several documents stays only in the
    document with the smallest integer id. Shorter lines always stay. NULL or empty text is one
    empty line and comes back as the empty text. A NULL id counts as smaller than any other; rows
    repeated under one id count as one document, and each of them is cleaned. Columns named
    ``n_lines`` or ``n_dropped`` are replaced; others are passed through.
    """
    doc = order_id(key)
    text_key = F.xxhash64(text)
    rows = docs.select(doc.alias("doc"), text_key.alias("text_key"), F.col(text).alias("text"))
    dropped = repeated_lines(rows, batches, fanout, min_chars)
    dropped = dropped.select(*[F.col(c).alias(f"__{c}") for c in dropped.columns])
    joined = docs.join(dropped, (doc == F.col("__doc")) & (text_key == F.col("__text_key")), "left")
    lines = split_lines(F.col(text))
    joined = joined.withColumn("__lines", lines).drop("n_lines", "n_dropped")
    n = F.size("__lines")
    left = F.array_except(F.sequence(F.lit(0), n - 1), "__dropped")
    cleaned = F.array_join(F.transform(left, lambda i: F.get("__lines", i)), "\n")
    whole = F.coalesce(F.col(text), F.lit(""))
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return joined.select(
        *[
            F.when(F.col("__dropped").isNull(), whole).otherwise(cleaned).alias(c) if c == text else F.col(c)
            for c in columns
        ],
        n.cast("long").alias("n_lines"),
        F.coalesce(F.size("__dropped"), F.lit(0)).cast("long").alias("n_dropped"),
    )
