"""Benchmark decontamination by winnowing.

Of every ``WINDOW`` consecutive k-grams the one with the smallest hash is kept as a fingerprint. A
shared span of ``GRAM + WINDOW - 1`` words holds one full window on both sides, so it always shares
a fingerprint at the same place. Fingerprints of documents and items are joined, and every hit is
extended along its diagonal by comparing words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, order_id, row_and, stored
from .words import ALNUM, Words, words_of

SPAN = 13
GRAM = 6
WINDOW = SPAN - GRAM + 1
# Up to this many item fingerprints (8 bytes each) are sent to all tasks; more are joined by shuffle.
SENT_FINGERPRINTS = 1_000_000


def winnow(words: Words, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of the fingerprints of all rows with at least ``window`` k-grams."""
    at, grams = words.grams(gram)
    if len(at) < window:
        return at[:0], grams[:0]
    row = words.row[at]
    least = np.lib.stride_tricks.sliding_window_view(grams, window).argmin(axis=1)
    whole = np.flatnonzero(row[: len(least)] == row[window - 1 :])
    picked = np.unique(whole + least[whole])
    return at[picked], grams[picked]


def _short(words: Words, lengths: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for n in lengths:
        yield words.grams(n)


def _batch(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def item_words(items: DataFrame) -> DataFrame:
    """``item, words (64-bit hashes, packed)`` of every distinct item row that has words."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = batch.column("item")
        for w in words_of(batch.column("text"), ALNUM, True):
            packed = [w.hash[a:b].tobytes() for a, b in zip(w.first, w.first[1:])]
            yield _batch({"item": ids.slice(w.at, w.rows), "words": pa.array(packed, pa.binary())})

    return map_batches(items, run, "item string, words binary").filter(F.length("words") > 0).distinct()


def item_fingerprints(items: DataFrame, span: int, gram: int) -> DataFrame:
    """``fp, n, item_pos, item, words``: winnowed k-grams, or the whole of an item below ``span`` words.

    ``n`` is the number of words that ``fp`` covers.
    """

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, packed = batch.column("item"), batch.column("words")
        for r in range(batch.num_rows):
            h = np.frombuffer(packed[r].as_py(), np.uint64)
            w = Words(0, np.array([0, len(h)]), h, h, h, h)
            n = gram if len(h) >= span else len(h)
            at, fp = winnow(w, gram, span - gram + 1) if len(h) >= span else w.grams(n)
            yield _batch(
                {
                    "fp": pa.array(fp.view(np.int64)),
                    "n": pa.array(np.full(len(at), n, np.int32)),
                    "item_pos": pa.array(at.astype(np.int32)),
                    "item": pa.array([ids[r].as_py()] * len(at), pa.string()),
                    "words": pa.array([packed[r].as_py()] * len(at), pa.binary()),
                }
            )

    return map_batches(items, run, "fp long, n int, item_pos int, item string, words binary")


def document_fingerprints(
    docs: DataFrame, lengths: list[int], wanted, span: int, gram: int
) -> DataFrame:
    """``doc, text_key, fp, n, pos``; only fingerprints in the broadcast ``wanted`` if there is one."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for w in words_of(batch.column("text"), ALNUM, True):
            found = [(gram, *winnow(w, gram, span - gram + 1))]
            found += [(n, *w.grams(n)) for n in lengths]
            for n, at, fp in found:
                if wanted is not None:
                    known = wanted.value
                    place = np.minimum(np.searchsorted(known, fp), len(known) - 1)
                    hit = np.flatnonzero(known[place] == fp) if len(known) else place[:0]
                    at, fp = at[hit], fp[hit]
                row = w.row[at]
                rows = pa.array(row + w.at)
                yield _batch(
                    {
                        "doc": batch.column("doc").take(rows),
                        "text_key": batch.column("text_key").take(rows),
                        "fp": pa.array(fp.view(np.int64)),
                        "n": pa.array(np.full(len(at), n, np.int32)),
                        "pos": pa.array((at - w.first[row]).astype(np.int32)),
                    }
                )

    return map_batches(docs, run, "doc long, text_key long, fp long, n int, pos int")


def extend(doc: np.ndarray, item: np.ndarray, shift: int, span: int) -> list[tuple[int, int]]:
    """Runs of equal words of ``doc[i + shift]`` and ``item[i]``, ``span`` words or the whole item long."""
    low, high = max(0, -shift), min(len(item), len(doc) - shift)
    if high <= low:
        return []
    same = np.zeros(high - low + 2, np.int8)
    same[1:-1] = doc[low + shift : high + shift] == item[low:high]
    edge = np.diff(same)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    least = min(span, len(item))
    return [(int(a) + low + shift, int(b) + low + shift) for a, b in zip(starts, ends) if b - a >= least]


def find_hits(docs: DataFrame, items: DataFrame, span: int, gram: int, sent: int) -> DataFrame:
    """``doc, text_key, hits``: per document the items and diagonals that share a fingerprint."""
    prints = stored(item_fingerprints(item_words(items), span, gram))
    # Lengths of items below ``span`` words: fewer than ``span`` numbers.
    short = prints.filter(F.length("words") == 8 * F.col("n")).filter(F.col("n") < span)
    lengths = [r[0] for r in short.select("n").distinct().collect()]
    distinct = prints.select("fp").distinct()
    wanted = None
    if distinct.limit(sent + 1).count() <= sent:
        values = np.array([r[0] for r in distinct.collect()], np.int64).view(np.uint64)
        wanted = docs.sparkSession.sparkContext.broadcast(np.sort(values))
    found = document_fingerprints(docs, sorted(lengths), wanted, span, gram)
    diagonals = (
        found.join(prints, ["fp", "n"])
        .select("doc", "text_key", "item", "words", (F.col("pos") - F.col("item_pos")).alias("shift"))
        .distinct()
    )
    return diagonals.groupBy("doc", "text_key").agg(
        F.collect_list(F.struct("item", "words", "shift")).alias("hits")
    )


def measure_contamination(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    span: int = SPAN,
    gram: int = GRAM,
    sent: int = SENT_FINGERPRINTS,
) -> DataFrame:
    """``row`` (all columns of ``docs``), ``n_words, n_hit, items, spans`` for every document row.

    ``items`` lists the ids, as strings, of the items of which ``span`` consecutive words (or all
    words of a shorter item) occur, each once and sorted; items without an id mark words but are not
    listed. ``spans`` are the merged runs of hit words, end exclusive. Words are runs of ASCII
    letters and digits and of non-ASCII characters, A-Z in lower case. NULL and empty texts have no
    words, on both sides. Keys may be NULL or repeated.
    """
    doc: Column = order_id(key)
    text_key = F.xxhash64(text)
    narrow = docs.select(doc.alias("doc"), text_key.alias("text_key"), F.col(text).alias("text"))
    sought = items.select(F.col(item_key).cast("string").alias("item"), F.col(item_text).alias("text"))
    hits = stored(find_hits(narrow, sought, span, gram, sent))
    whole = docs.select(
        F.struct(*docs.columns).alias("row"), F.col(text).alias("text"), doc.alias("doc"), text_key.alias("text_key")
    )
    joined = whole.join(hits, ["doc", "text_key"], "left").select("row", "text", "hits")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows, found = batch.column("row"), batch.column("hits")
        for w in words_of(batch.column("text"), ALNUM, True):
            n_hit, names, spans = [], [], []
            for r in range(w.rows):
                h = w.hash[w.first[r] : w.first[r + 1]]
                mark = np.zeros(len(h) + 2, np.int8)
                items_here = set()
                for hit in found[w.at + r].as_py() or ():
                    runs = extend(h, np.frombuffer(hit["words"], np.uint64), hit["shift"], span)
                    for a, b in runs:
                        mark[a + 1 : b + 1] = 1
                    if runs and hit["item"] is not None:
                        items_here.add(hit["item"])
                edge = np.diff(mark)
                starts, ends = np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()
                n_hit.append(int(mark.sum()))
                names.append(sorted(items_here))
                spans.append([{"start": a, "end": b} for a, b in zip(starts, ends)])
            place = pa.struct([("start", pa.int32()), ("end", pa.int32())])
            yield _batch(
                {
                    "row": rows.slice(w.at, w.rows),
                    "n_words": pa.array(np.diff(w.first).astype(np.int64)),
                    "n_hit": pa.array(n_hit, pa.int64()),
                    "items": pa.array(names, pa.list_(pa.string())),
                    "spans": pa.array(spans, pa.list_(place)),
                }
            )

    more = "n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>"
    return map_batches(joined, run, row_and(joined.schema["row"].dataType, more))


def contaminated(share: int = 20) -> Column:
    """True if words are hit and they are at least one in ``share``."""
    return (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))


def keep_clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    return measure_contamination(docs, items, key, text).filter(~contaminated()).select("row.*")
