"""Two tokenizers aligned over the bytes of whole texts, with corpus-wide counts of linked token pairs."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_symbols
from .common import by_weight, stored

# Characters of text that are counted as one part, and that are aligned at once.
PART = 2_000_000
SLICE = 250_000
# A pair of ids is one integer: the first id, then this many bits of the second.
BITS = 20
MASK = (1 << BITS) - 1
DOC, PAIRS, VECTOR = 0, 1, 2


@dataclass
class Tokens:
    """A tokenizer: ids of texts, where a space precedes each, and the bytes of every id."""

    encode: Callable[[list[str]], list[list[int]]]
    bytes: list[bytes]

    def __post_init__(self):
        if len(self.bytes) > MASK:
            raise ValueError(f"more than {MASK} ids")
        self.size = np.array([len(b) for b in self.bytes], np.int64)


def byte_level(path: str, pattern: str) -> Tokens:
    """A byte-level BPE file of the tokenizers library, whose words ``pattern`` cuts.

    Strings of special tokens are plain text. The ids have to rise with the ranks of the merges, so
    that an id is its own rank.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    made = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
    if made != sorted(made):
        raise ValueError("ids do not rise with the ranks of the merges")
    byte = {symbol: b for b, symbol in enumerate(byte_symbols())}
    entries = [b""] * (max(vocab.values()) + 1)
    for entry, i in vocab.items():
        entries[i] = bytes(byte[c] for c in entry)
    ranks = {b: i for i, b in enumerate(entries) if b}
    coder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return Tokens(lambda texts: [coder.encode_ordinary(" " + t) for t in texts], entries)


def pieces(path: str) -> Tokens:
    """A sentencepiece model that puts a space before every text itself."""
    import sentencepiece

    coder = sentencepiece.SentencePieceProcessor(model_file=path)
    entries = []
    for i in range(coder.get_piece_size()):
        piece = coder.id_to_piece(i)
        entries.append(bytes([int(piece[3:5], 16)]) if coder.is_byte(i) else piece.replace("▁", " ").encode())
    return Tokens(lambda texts: coder.encode(texts, num_threads=1), entries)


def same_bytes(a: Tokens, b: Tokens) -> np.ndarray:
    """For every id of ``a`` the largest id of ``b`` with the same bytes, or -1."""
    of = {x: i for i, x in enumerate(b.bytes)}
    return np.array([of.get(x, -1) if x else -1 for x in a.bytes], np.int64)


class Aligner:
    """Groups, links and pair counts of the texts of one part."""

    def __init__(self, a: Tokens, b: Tokens):
        self.a, self.b = a, b
        self.same = same_bytes(a, b)
        # How an id is written inside its group, and at the end of its side of the group.
        self.shown = [x for i in range(len(a.bytes)) for x in (b"%d," % i, b"%d|" % i)]
        self.first_b = len(self.shown)
        self.shown += [x for i in range(len(b.bytes)) for x in (b"%d," % i, b"%d;" % i)]

    def coded(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """Ids of both sides and the first of every text; texts that either side changes have none."""
        sides: list[list[int]] = [[], []]
        firsts: list[list[int]] = [[0], [0]]
        byte_ends = []
        total = 0
        given = self.a.encode(texts), self.b.encode(texts)
        for text, *ids in zip(texts, *given):
            raw = (" " + text).encode()
            if text and all(b"".join([t.bytes[i] for i in x]) == raw for t, x in zip((self.a, self.b), ids)):
                total += len(raw)
                for side, x in zip(sides, ids):
                    side += x
            byte_ends.append(total)
            for first, side in zip(firsts, sides):
                first.append(len(side))
        return *(np.array(x, np.int64) for x in (*sides, *firsts)), np.array(byte_ends, np.int64)

    def align(self, texts: list[str]) -> dict[str, np.ndarray | list]:
        """Counts and digest per text; distinct (text, pair) with their number of links.

        The bytes of all texts lie in one row. Where a token of either side ends, a segment ends;
        it lies in one token of each side, and every overlapping pair has exactly one segment.
        """
        a, b, a_first, b_first, byte_ends = self.coded(texts)
        n = len(texts)
        mark = np.zeros((byte_ends[-1] if n else 0) + 1, np.uint8)
        a_ends, b_ends = np.cumsum(self.a.size[a]), np.cumsum(self.b.size[b])
        mark[a_ends] |= 1
        mark[b_ends] |= 2
        at = np.flatnonzero(mark)
        ends = mark[at]
        in_a, in_b, both = (ends & 1).astype(bool), (ends >> 1).astype(bool), ends == 3
        of_a, of_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        text_of = np.searchsorted(byte_ends, at)
        group = np.cumsum(both) - both
        n_links, n_groups = np.bincount(text_of, minlength=n), np.bincount(text_of[both], minlength=n)

        a_group, b_group = group[in_a], group[in_b]
        groups = int(both.sum())
        a_until = np.cumsum(np.bincount(a_group, minlength=groups))
        b_sizes = np.bincount(b_group, minlength=groups)
        b_before = np.cumsum(b_sizes) - b_sizes
        row = np.empty(len(a) + len(b), np.int64)
        row[np.arange(len(a)) + b_before[a_group]] = a * 2 + both[in_a]
        row[np.arange(len(b)) + a_until[b_group]] = self.first_b + b * 2 + both[in_b]
        first, shown, digests = (a_first + b_first).tolist(), self.shown, []
        for i in range(n):
            written = b"".join([shown[x] for x in row[first[i] : first[i + 1]].tolist()])[:-1]
            digests.append(hashlib.sha256(written).hexdigest() if written else "")

        linked, times = np.unique(text_of << (2 * BITS) | a[of_a] << BITS | b[of_b], return_counts=True)
        return {
            "counts": [np.diff(a_first), np.diff(b_first), n_groups, n_links],
            "digests": digests,
            "text": linked >> (2 * BITS),
            "pair": linked & ((1 << 2 * BITS) - 1),
            "times": times,
        }


def _added(counted: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of several counts, and their numbers added up."""
    values, row = np.unique(np.concatenate([v for v, _ in counted]), return_inverse=True)
    return values, _per_row(np.concatenate([n for _, n in counted]), row, len(values))


def _lists(values: np.ndarray, rows: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    """One list per row from values in row order."""
    offsets = np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


FIELDS = [
    ("kind", pa.int32()),
    ("part", pa.int64()),
    ("n_a", pa.int64()),
    ("n_b", pa.int64()),
    ("n_groups", pa.int64()),
    ("n_links", pa.int64()),
    ("groups_sha256", pa.string()),
    ("ids", pa.list_(pa.int32())),
    ("id_times", pa.list_(pa.int32())),
    ("pairs", pa.list_(pa.int64())),
    ("pair_times", pa.list_(pa.int64())),
]
COUNTS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def _aligned(docs: DataFrame, load: Callable[[], Aligner]) -> DataFrame:
    """The first pass: a row per text, per part the irregular pairs, per task the identity vector."""
    lists = "ids array<int>, id_times array<int>, pairs array<long>, pair_times array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = load()
        names = ["doc_id", *[f[0] for f in FIELDS]]
        vector = np.zeros(len(aligner.same), np.int64)
        part = TaskContext.get().partitionId() << 32
        key = None

        def extra(kind: int, part: int, pairs: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            given = {"kind": [kind], "part": [part], "pairs": [pairs], "pair_times": [n]}
            columns = [pa.array(given.get(name, [None]), t) for name, t in FIELDS]
            return pa.RecordBatch.from_arrays([pa.nulls(1, key), *columns], names)

        for batch in batches:
            key = batch.schema.field(0).type
            for part_first, part_to in by_weight(batch.column(1), PART):
                rows = batch.slice(part_first, part_to - part_first)
                irregular = []
                for first, to in by_weight(rows.column(1), SLICE):
                    size = to - first
                    found = aligner.align([t or "" for t in rows.column(1).slice(first, size).to_pylist()])
                    text, pair, times = found["text"], found["pair"], found["times"]
                    same = aligner.same[pair >> BITS] == pair & MASK
                    vector += np.bincount(pair[same] >> BITS, minlength=len(vector))
                    columns = [
                        pa.array(np.full(size, DOC, np.int32)),
                        pa.array(np.full(size, part)),
                        *[pa.array(c.astype(np.int64)) for c in found["counts"]],
                        pa.array(found["digests"], pa.string()),
                    ]
                    for chosen, values, kind in ((same, pair >> BITS, pa.int32()), (~same, pair, pa.int64())):
                        columns += [_lists(v[chosen], text[chosen], size, kind) for v in (values, times)]
                    yield pa.RecordBatch.from_arrays([rows.column(0).slice(first, size), *columns], names)
                    irregular.append(np.unique(pair[~same], return_counts=True))
                yield extra(PAIRS, part, *_added(irregular))
                part += 1
        if vector.any():
            met = np.flatnonzero(vector)
            yield extra(VECTOR, part, met, vector[met])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, kind int, part long, {COUNTS}, {lists}")


def align_tokenizers(
    docs: DataFrame, load: Callable[[], Aligner], key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum`` per row of ``docs``.

    ``load`` gives the tokenizers in a task; it should remember them. Offsets where tokens of both
    sides end cut a text into groups. A link is a pair of token occurrences that overlap; the count
    of its pair of ids is the number of rows that hold it. ``n_best`` counts the links whose count
    is the highest of their first id, ``count_sum`` adds the counts up.

    One pass over the texts writes groups and links. Pairs of ids of the same bytes, found in an
    array over the first vocabulary, are counted in one vector of that length per task and never
    shuffled as pairs; only the others, distinct per part of about ``PART`` characters, are added up
    by a shuffle and come back to their part. The summed vectors, and the highest counts, have one
    number per id of the first vocabulary, which bounds what is sent to the tasks. Texts are aligned
    ``SLICE`` characters at a time, and what was found in them meets the counts one part at a time,
    so no task holds the lists of a whole Arrow batch of texts.

    NULL and empty texts, and texts that one of the tokenizers does not give back byte by byte,
    have no tokens: all numbers are 0 and the digest is ''. A key may be NULL or repeated; every
    row counts. Other columns are not read.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    found = stored(_aligned(rows, load))
    entry = F.explode(F.arrays_zip("pairs", "pair_times")).alias("e")
    of_kind = lambda k: found.filter(F.col("kind") == k).select("part", entry).select("part", "e.*")
    irregular = of_kind(PAIRS)
    counts = stored(irregular.groupBy("pairs").agg(F.sum("pair_times").alias("n")))
    identity = of_kind(VECTOR).groupBy(F.col("pairs").alias("id")).agg(F.sum("pair_times").alias("same_n"))
    others = counts.groupBy(F.shiftright("pairs", BITS).alias("id")).agg(F.max("n").alias("other_n"))
    per_id = identity.join(others, "id", "full_outer").select(
        "id", F.coalesce("same_n", F.lit(0)).alias("same_n"), F.greatest("same_n", "other_n").alias("best")
    )
    per_id = per_id.toArrow()  # one row per id of the first vocabulary at most
    width = 1 + max(per_id["id"].to_pylist(), default=0)
    same_n, best = np.zeros(width, np.int64), np.zeros(width, np.int64)
    for vector, name in ((same_n, "same_n"), (best, "best")):
        vector[per_id["id"].to_numpy()] = per_id[name].to_numpy()

    plain = [c.split()[0] for c in f"doc_id, {COUNTS}".split(", ")]
    head = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {COUNTS}"
    texts = found.filter(F.col("kind") == DOC).drop("kind")
    known = irregular.select(F.col("part").alias("known_part"), "pairs").join(counts, "pairs")

    def complete(texts: pa.Table, known: pa.Table) -> pa.Table:
        texts = texts.combine_chunks()
        order = np.argsort(known["pairs"].to_numpy())
        keys, counted = known["pairs"].to_numpy()[order], known["n"].to_numpy()[order]
        n_best, count_sum = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for values, numbers in (("ids", "id_times"), ("pairs", "pair_times")) if len(texts) else ():
            ids, times, row = _flat(texts[values].chunk(0), texts[numbers].chunk(0))
            if values == "ids":
                n = same_n[ids]
            else:
                n = counted[np.searchsorted(keys, ids)] if len(keys) else np.zeros(len(ids), np.int64)
                ids = ids >> BITS
            n_best += _per_row(times * (n == best[ids]), row, len(texts))
            count_sum += _per_row(times * n, row, len(texts))
        sums = [pa.array(n_best), pa.array(count_sum)]
        return pa.table([*[texts[c] for c in plain], *sums], [*plain, "n_best", "count_sum"])

    return texts.groupBy("part").cogroup(known.groupBy("known_part")).applyInArrow(complete, f"{head}, n_best long, count_sum long")


def _flat(values: pa.Array, times: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values and their numbers of all lists in a row, and the row that each is of."""
    sizes = np.diff(values.offsets.to_numpy())
    return values.flatten().to_numpy(), times.flatten().to_numpy(), np.repeat(np.arange(len(sizes)), sizes)


def _per_row(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    sums = np.zeros(n, np.int64)
    np.add.at(sums, row, values)
    return sums
