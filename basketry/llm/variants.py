"""Spelling variants: words one letter apart, found by PartEnum signatures of their letter multisets."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, stored

RUN = "[A-Za-zÀ-ÿ]"
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
# Distinct words that a task counts before it hands them on.
FLUSH = 300_000
# Letters of a half fall into so many parts, of which two, or one, may differ.
PARTS_TWO, PARTS_ONE = 4, 2


def _doc_words(doc: int | None, text: str, run: re.Pattern, min_chars: int, typo_every: int) -> Iterator[tuple[bytes, int]]:
    """Lower-cased runs of one text with their counts, of those that stay long enough.

    The hash depends on the document and the run only, so equal runs of a document change alike.
    """
    seed = zlib.crc32(b":", zlib.crc32(b"" if doc is None else b"%d" % doc))
    for found, n in Counter(run.findall(text)).items():
        word = found.encode().translate(LOWER)
        if typo_every:
            h = zlib.crc32(word, seed)
            if h % typo_every == 0:
                at = h % len(found)
                word = word.decode()
                word = (word[:at] + word[at + 1 :]).encode()
                if len(found) <= min_chars:
                    continue
        yield word, n


def count_words(
    docs: DataFrame,
    min_chars: int = 6,
    min_count: int = 5,
    typo_every: int = 0,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``word, n``: letter runs of whole texts, A-Z lower-cased, and how often they occur.

    Words below ``min_chars`` code points or ``min_count`` occurrences are left out. With
    ``typo_every`` m, a run loses one letter where m divides the CRC-32 of ``<id>:<run>``, letter
    crc % length. Tasks add up their own words and hand them on whenever ``FLUSH`` distinct ones
    are reached, so a frequent word is a few rows and memory stays bounded. NULL text has no words;
    a NULL id is written as nothing; repeated rows count as often as they appear.
    """
    pattern = f"{RUN}{{{min_chars},}}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, total = re.compile(pattern), Counter()

        def rows() -> pa.RecordBatch:
            words = pa.array([w.decode() for w in total], pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(list(total.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                body = body.as_py()
                if body:
                    for word, n in _doc_words(doc, body, runs, min_chars, typo_every):
                        total[word] += n
                if len(total) >= FLUSH:
                    yield rows()
                    total.clear()
        yield rows()

    parts = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("body")).mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _part(letter: str, nth: int, parts: int) -> int:
    """Part of the dimension 'has at least ``nth`` of ``letter``'."""
    return (ord(letter) * 31 + nth * 17) * 2_654_435_761 % 2**32 // 65_536 % parts


def _enumerate(half: str, parts: int, differing: int) -> Iterator[str]:
    """All but ``differing`` of the parts of a half's letter multiset, in every choice."""
    cut: list[list[str]] = [[] for _ in range(parts)]
    seen: Counter = Counter()
    for letter in sorted(half):
        seen[letter] += 1
        cut[_part(letter, seen[letter], parts)].append(letter)
    texts = ["".join(p) for p in cut]
    for left_out in combinations(range(parts), differing):
        kept = ",".join("*" if i in left_out else t for i, t in enumerate(texts))
        yield kept


def signatures(word: str) -> Iterator[str]:
    """Keys of which any two words one letter apart share at least one.

    A word is the binary vector of its two halves' letter multisets, one dimension per half, letter
    and number of occurrences. One edit lies in one half, so the other half agrees and the edited
    one is at Hamming distance 2 (a letter replaced) or 1 (one more or less). A key names the
    agreeing half and all parts of the other but two, or one, in every choice of parts. Words of
    lengths L and L + 1 are halved at L // 2 letters from the front and L - L // 2 from the end.
    """
    n = len(word)
    for kind, short, parts, differing in (
        ("=", n, PARTS_TWO, 2),
        ("<", n, PARTS_ONE, 1),
        ("<", n - 1, PARTS_ONE, 1),
    ):
        front, back = short // 2, short - short // 2
        for side, same, other in (("a", word[:front], word[front:]), ("z", word[n - back :], word[: n - back])):
            for kept in _enumerate(other, parts, differing):
                yield f"{kind}{short}{side}{same}:{kept}"


def near_words(words: DataFrame) -> DataFrame:
    """``word, n, other, other_n``: every pair one inserted, deleted or replaced code point apart, both ways.

    ``words`` has distinct ``word`` and ``n``. Words meet in a join on their signatures, where
    the edit distance is checked before a row leaves, so neither a group's pairs nor a hot group
    are gathered anywhere and adaptive execution can split it. Spark does not see how many signatures
    a word has and would send those of a small vocabulary to the driver, so the join is by sort and
    merge. A pair that meets several times is kept once.
    """

    def post(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        words, counts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        out = [(s, w, n) for w, n in zip(words, counts) for s in set(signatures(w))]
        columns = zip(*out) if out else ([], [], [])
        types = (pa.string(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["signature", "word", "n"])

    posted = map_batches(words.select("word", "n"), post, "signature string, word string, n long")
    a = posted.select("signature", F.col("word").alias("a"), F.col("n").alias("a_n"))
    b = posted.select("signature", F.col("word").alias("b"), F.col("n").alias("b_n"))
    close = (F.col("a") < F.col("b")) & (F.levenshtein("a", "b", 1) == 1)
    pairs = a.join(b.hint("merge"), "signature").filter(close).select("a", "a_n", "b", "b_n").distinct()
    one = F.struct(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("other"), F.col("b_n").alias("other_n"))
    two = F.struct(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("other"), F.col("a_n").alias("other_n"))
    return pairs.select(F.explode(F.array(one, two)).alias("p")).select("p.*")


def follow(forms: DataFrame) -> DataFrame:
    """``word, root``: the end of the chain of ``form`` from every word that has one.

    ``forms`` has distinct ``word`` and its ``form`` and no cycles. Every round doubles the way that
    each word has gone, and its table is stored.
    """
    at = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        went = stored(
            at.join(further.hint("merge"), "root", "left").select(
                "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
            )
        )
        at = went.select("word", "root")
        if not went.filter("moved").take(1):
            return at


def group_spellings(words: DataFrame, ratio: int = 5) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of every distinct ``word`` with its count ``n``.

    The form is the near word with the largest count, then the smallest in code-point order, if that
    count is at least ``ratio`` (above 1) times the word's own; else NULL. The root is the last word
    along the forms, the word itself without one. Counts grow along a chain, so it has no cycle.
    An empty table gives an empty one; words of one letter, or none, are compared like any other.
    """
    words = stored(words.select("word", "n"))
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("other")))
    near = near_words(words).groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    better = -F.col("best.less") >= F.lit(ratio) * F.col("n")
    near = stored(
        near.select(
            "word",
            "n_near",
            F.when(better, F.col("best.other")).alias("form"),
            F.when(better, -F.col("best.less")).alias("form_n"),
        )
    )
    roots = follow(near.filter(F.col("form").isNotNull()))
    near, roots = near.hint("merge"), roots.hint("merge")
    return words.join(near, "word", "left").join(roots, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        "form",
        "form_n",
        F.coalesce("root", "word").alias("root"),
    )
