"""Substring dedup: spans of words that already occur in an earlier document.

Documents are searched in shards, each with an FM-index of its own. Searching every
document in every shard would be quadratic, so the shards are cut by content: every window of
``SPAN`` words goes where its minimizer (its least 7-gram hash) goes, together with the windows
beside it that have the same one. Such a run of windows is a fragment, and equal windows always
meet in one shard. A fragment travels only if its minimizer occurs in several documents, and equal
fragments travel once, with their smallest document. Windows of minimizers with very many fragments
are not indexed: equal ones are combined to their smallest document, so no task depends on a single
minimizer or window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import remove_path, scratch_path
from .common import map_batches, order_id, row_and, stored
from .fm import earlier_windows
from .words import VISIBLE, Words, mix, words_of

SPAN = 13
GRAM = 7
# Words indexed by one shard, on average; a minimizer above a tenth of it is decided by window.
SHARD_WORDS = 150_000


def fragments(words: Words, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of windows and minimizer of every fragment."""
    n = len(words.hash) - span + 1
    none = np.empty(0, np.int64)
    if n <= 0:
        return none, none, none.astype(np.uint64)
    row = words.row
    total = np.full(len(words.hash), np.iinfo(np.uint64).max, np.uint64)
    at, grams = words.grams(gram)
    total[at] = grams
    view = np.lib.stride_tricks.sliding_window_view(total, span - gram + 1)[:n]
    start = np.flatnonzero(row[:n] == row[span - 1 :])
    place = start + view[start].argmin(axis=1)
    fresh = np.ones(len(start), bool)
    fresh[1:] = (place[1:] != place[:-1]) | (row[start[1:]] != row[start[:-1]])
    first = np.flatnonzero(fresh)
    return start[first], np.diff(np.append(first, len(start))), total[place[first]]


def _batch(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def shared_minimizers(docs: DataFrame, span: int, gram: int) -> DataFrame:
    """``minimizer`` of the fragments that lie in several documents."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for w in words_of(batch.column("text"), VISIBLE, False):
            at, _, least = fragments(w, span, gram)
            doc = batch.column("doc").take(pa.array(w.row[at] + w.at))
            yield _batch({"minimizer": pa.array(least.view(np.int64)), "doc": doc})

    found = map_batches(docs.select("doc", "text"), run, "minimizer long, doc long")
    ends = found.groupBy("minimizer").agg(F.min("doc").alias("low"), F.max("doc").alias("high"))
    return ends.filter(F.col("low") < F.col("high")).select("minimizer")


def minimizers(docs: DataFrame, span: int, gram: int) -> DataFrame:
    """``doc, text_key, minimizer, pos, windows`` of every fragment."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for w in words_of(batch.column("text"), VISIBLE, False):
            at, windows, least = fragments(w, span, gram)
            row = w.row[at]
            rows = pa.array(row + w.at)
            yield _batch(
                {
                    "doc": batch.column("doc").take(rows),
                    "text_key": batch.column("text_key").take(rows),
                    "minimizer": pa.array(least.view(np.int64)),
                    "pos": pa.array((at - w.first[row]).astype(np.int32)),
                    "windows": pa.array(windows.astype(np.int32)),
                }
            )

    return map_batches(docs, run, "doc long, text_key long, minimizer long, pos int, windows int")


def cut_fragments(docs: DataFrame, wanted: DataFrame, span: int, with_words: bool) -> DataFrame:
    """``doc, text_key, pos, size, minimizer, f1, f2`` of the fragments in ``wanted``, or their words.

    ``with_words`` returns ``minimizer, f1, f2, doc`` and the packed ``words`` instead.
    """
    per_row = wanted.groupBy("doc", "text_key").agg(
        F.collect_list(F.struct("pos", "windows", "minimizer")).alias("cuts")
    )
    joined = docs.join(per_row, ["doc", "text_key"]).select("doc", "text_key", "text", "cuts")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        cuts = batch.column("cuts")
        for w in words_of(batch.column("text"), VISIBLE, False):
            lists = cuts.slice(w.at, w.rows)
            flat = lists.flatten()
            n = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(w.rows), n)
            pos = flat.field("pos").to_numpy()
            size = flat.field("windows").to_numpy() + span - 1
            begin = w.first[row] + pos
            h = w.hash
            # Two independent sums over (word, place) name the fragment, 128 bits in all.
            places = np.arange(1, int(size.max(initial=0)) + 1, dtype=np.uint64)
            ends = np.cumsum(size)
            inside = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - size, size)
            values = h[np.repeat(begin, size) + inside]
            names = []
            for seed in (np.uint64(0x1234567), np.uint64(0x89ABCDEF01)):
                mixed = mix(values + mix(places + seed)[inside])
                names.append(np.add.reduceat(mixed, ends - size) if len(ends) else mixed)
            rows = pa.array(row + w.at)
            columns = {
                "doc": batch.column("doc").take(rows),
                "minimizer": flat.field("minimizer"),
                "f1": pa.array(names[0].view(np.int64)),
                "f2": pa.array(names[1].view(np.int64)),
            }
            if with_words:
                packed = [h[a : a + m].tobytes() for a, m in zip(begin.tolist(), size.tolist())]
                columns["words"] = pa.array(packed, pa.binary())
            else:
                columns["text_key"] = batch.column("text_key").take(rows)
                columns["pos"] = flat.field("pos")
                columns["size"] = pa.array(size.astype(np.int32))
            yield _batch(columns)

    more = "words binary" if with_words else "text_key long, pos int, size int"
    return map_batches(joined, run, "doc long, minimizer long, f1 long, f2 long, " + more)


def earlier_hot_windows(hot: DataFrame, span: int) -> DataFrame:
    """``f1, f2, offset`` of the windows in ``hot`` that occur there with a smaller owner.

    A passage between many different neighbours gives a distinct fragment for each of them, with the
    same windows inside. Windows are named by 128 bits and combined before the shuffle, so the least
    owner of one costs a row per task; the rows of a hot window meet it again in a plain join.
    """
    last = (F.length("words") / 8).cast("int") - span
    words = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.struct(i.alias("offset"), F.substr("words", 8 * i + 1, F.lit(8 * span)).alias("words")),
    )
    single = hot.select("f1", "f2", "owner", F.explode(words).alias("x"))
    name = [F.xxhash64("x.words").alias("w1"), F.xxhash64(F.lit(1), "x.words").alias("w2")]
    windows = stored(single.select("f1", "f2", "owner", "x.offset", *name))
    ends = windows.groupBy("w1", "w2").agg(F.min("owner").alias("low"), F.max("owner").alias("high"))
    # Stored, as adaptive execution splits a join only if shuffles are its direct inputs.
    least = stored(ends.filter(F.col("low") < F.col("high")).select("w1", "w2", "low"))
    met = windows.join(least, ["w1", "w2"]).filter(F.col("low") < F.col("owner"))
    return met.select("f1", "f2", "offset")


def search_shards(distinct: DataFrame, span: int, shard_words: int) -> DataFrame:
    """``f1, f2, earlier``: offsets of the windows of a fragment that occur with a smaller owner.

    ``distinct`` has ``f1, f2, owner, minimizer, words``. Equal windows have one minimizer, so the
    fragments of a minimizer are either all indexed or all decided window by window.
    """
    size = (F.length("words") / 8).cast("int")
    per = distinct.groupBy("minimizer").agg(F.sum(size).alias("size"))
    large = F.col("size") > shard_words // 10
    total, hot = per.agg(F.sum(F.when(~large, F.col("size"))), F.count(F.when(large, 1))).first()
    shards = max(1, -(-(total or 0) // shard_words))
    rest = distinct
    if hot:
        many = stored(per.filter(large).select("minimizer"))
        rest = distinct.join(many, "minimizer", "left_anti")
    dealt = rest.select(
        F.pmod(F.xxhash64("minimizer"), F.lit(shards)).cast("int").alias("shard"), "f1", "f2", "owner", "words"
    )

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        packed = table["words"].to_pylist()
        lengths = np.array([len(p) // 8 for p in packed])
        words = np.frombuffer(b"".join(packed), np.uint64)
        piece, offset = earlier_windows(words, lengths, table["owner"].to_numpy(), span)
        found = table.select(["f1", "f2"]).take(pa.array(piece))
        return found.append_column("offset", pa.array(offset.astype(np.int32)))

    found = dealt.groupBy("shard").applyInArrow(run, "f1 long, f2 long, offset int")
    if hot:
        found = found.unionByName(earlier_hot_windows(distinct.join(many, "minimizer", "left_semi"), span))
    return found.groupBy("f1", "f2").agg(F.collect_list("offset").alias("earlier"))


def repeated_spans(
    docs: DataFrame, span: int = SPAN, gram: int = GRAM, shard_words: int = SHARD_WORDS
) -> DataFrame:
    """``doc, text_key, spans``: runs of words that also occur in a smaller document.

    ``docs`` has ``doc`` (not NULL), ``text_key`` and ``text``.
    """
    found = minimizers(docs, span, gram)
    several = stored(shared_minimizers(docs, span, gram))
    spark, place = docs.sparkSession, scratch_path(docs.sparkSession, "shared")
    cut = stored(cut_fragments(docs, stored(found.join(several, "minimizer"), place), span, False))
    remove_path(spark, place)
    # The first occurrence of every fragment in its smallest document stands for all of them.
    first = F.min(F.struct("doc", "text_key", "pos", "size", "minimizer")).alias("x")
    owned = stored(cut.groupBy("f1", "f2").agg(first).select("f1", "f2", "x.*"))
    windows = (F.col("size") - (span - 1)).alias("windows")
    firsts = owned.select("doc", "text_key", "pos", windows, "minimizer")
    place = scratch_path(spark, "fragments")
    distinct = stored(cut_fragments(docs, firsts, span, True).withColumnRenamed("doc", "owner"), place)
    earlier = stored(search_shards(distinct, span, shard_words))
    remove_path(spark, place)
    known = owned.select("f1", "f2", F.col("doc").alias("owner")).join(earlier, ["f1", "f2"], "left")
    # Stored for the same reason as above: a fragment may have a third of all rows.
    known = stored(known)
    cut = cut.drop("minimizer")
    met = cut.join(known, ["f1", "f2"])
    whole = F.array(F.struct(F.col("pos").alias("start"), (F.col("pos") + F.col("size")).alias("end")))
    some = F.transform(
        "earlier",
        lambda i: F.struct((F.col("pos") + i).alias("start"), (F.col("pos") + i + span).alias("end")),
    )
    spans = F.when(F.col("doc") > F.col("owner"), whole).otherwise(some)
    met = met.select("doc", "text_key", F.explode(spans).alias("span"))
    return met.groupBy("doc", "text_key").agg(F.collect_set("span").alias("spans"))


def drop_repeated_spans(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    span: int = SPAN,
    gram: int = GRAM,
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """``row`` (all columns of ``docs``), ``n_words, n_removed, kept`` for every row.

    A word is removed if a window of ``span`` words over it also occurs in a document with a smaller
    integer id, judged on the texts as given. ``kept`` joins the other words by single spaces. NULL,
    empty and blank texts have no words. A NULL id is smaller than any other; rows repeated under
    one id are one document, so they remove nothing from each other.
    """
    doc, text_key = order_id(key), F.xxhash64(text)
    narrow = docs.select(doc.alias("doc"), text_key.alias("text_key"), F.col(text).alias("text"))
    spans = stored(repeated_spans(narrow, span, gram, shard_words))
    whole = docs.select(
        F.struct(*docs.columns).alias("row"), F.col(text).alias("text"), doc.alias("doc"), text_key.alias("text_key")
    )
    joined = whole.join(spans, ["doc", "text_key"], "left").select("row", "text", "spans")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows, found = batch.column("row"), batch.column("spans")
        for w in words_of(batch.column("text"), VISIBLE, False, hashed=False):
            lists = found.slice(w.at, w.rows)
            spans = lists.flatten()
            n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            first = np.repeat(w.first[:-1], n)
            edge = np.zeros(len(w.start) + 1, np.int64)
            np.add.at(edge, first + spans.field("start").to_numpy(), 1)
            np.add.at(edge, first + spans.field("end").to_numpy(), -1)
            stay = np.cumsum(edge)[:-1] == 0
            until = np.concatenate([[0], np.cumsum(~stay)])[w.first]
            yield _batch(
                {
                    "row": rows.slice(w.at, w.rows),
                    "n_words": pa.array(np.diff(w.first).astype(np.int64)),
                    "n_removed": pa.array(np.diff(until).astype(np.int64)),
                    "kept": w.joined(stay),
                }
            )

    more = "n_words long, n_removed long, kept string"
    return map_batches(joined, run, row_and(joined.schema["row"].dataType, more))
