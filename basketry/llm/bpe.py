"""Byte-level BPE with word ends, merged through an index from each pair to all its places.

The vocabulary file is a parameter; nothing is trained. Merges stay inside words in this scheme, so
a task encodes all new words of some texts together and looks up those it has met.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_weight, map_batches

# Words after which the memory of a task becomes its older memory.
REMEMBERED = 300_000
# White space as the vocabulary's patterns mean it.
SPACES = r"\x09-\x0d\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_symbols() -> list[str]:
    """One printable character per byte: Latin-1 where printable, code points from 256 elsewhere."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


# The letters and digits that Unicode 16.0 added, as ranges, and lower case up to 17.0.
# The vocabulary's own library knows them; the Python tables used here end before or go further.
ADDED_IN_16 = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D40, 0x10D85),
    (0x10EC2, 0x10EC4), (0x11380, 0x113D5), (0x116D0, 0x116E3), (0x11BC0, 0x11BF9),
    (0x13460, 0x143FA), (0x16100, 0x16139), (0x16D40, 0x16D79), (0x1CCF0, 0x1CCF9),
    (0x1E5D0, 0x1E5FA),
]
LOWER_ADDED = {
    0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3,
    0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B,
    **{c: c + 0x20 for c in range(0x10D50, 0x10D66)},
    **{c: c + 0x1B for c in range(0x16EA0, 0x16EB9)},
}


def _ranges(pattern: str, end: int) -> str:
    """The characters of ``pattern`` below ``end`` and up to Unicode 16.0, as ranges for ``re``."""
    added = {c for low, high in ADDED_IN_16 for c in range(low, high + 1)}
    wanted = regex.findall(pattern, "".join(map(chr, range(end))))
    points = [c for c in map(ord, wanted) if unicodedata.category(chr(c)) != "Cn" or c in added]
    runs: list[list[int]] = []
    for c in points:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"\\U{low:08x}-\\U{high:08x}" for low, high in runs)


@functools.lru_cache(maxsize=4)
def word_pattern(pattern: str, end: int) -> re.Pattern:
    """The vocabulary's word pattern, its classes of letters, digits and spaces spelled out.

    ``re`` looks characters below 0x10000 up in a table and walks through the ranges of others, so
    a pattern for texts without the latter is much faster.
    """
    letters, digits = _ranges(r"\p{L}", end), _ranges(r"\p{N}", end)
    pattern = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{SPACES}{letters}{digits}]")
    return re.compile(pattern.replace(r"\p{L}", letters).replace(r"\p{N}", digits))


class WordBpe:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.made = [vocab[a + b] for a, b in model["merges"]]
        symbols = byte_symbols()
        self.inner = [vocab[s] for s in symbols]
        self.final = [vocab[s + suffix] for s in symbols]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.packed = {i: i.to_bytes(4, "little") for i in self.token}
        pre = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words, self.plain_words = word_pattern(pre, 0x110000), word_pattern(pre, 0x10000)
        rare = "".join(map(chr, (c for c in LOWER_ADDED if c < 0x10000)))
        self.rare = re.compile(f"[\U00010000-\U0010ffff{rare}]")
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.known: dict[str | int, tuple[bytes, str]] = {}
        self.older: dict[str | int, tuple[bytes, str]] = {}

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of every word.

        All words lie in one row of symbols. ``places`` maps a rank to the places of its pair;
        ranks are taken in ascending order, and places inside a rank from left to right. A merge
        updates the lists of the pairs on both sides; if one of them gets a lower rank than the
        current one, that rank goes first and the rest of the list waits. Symbols merged away
        stay in the row as -2.
        """
        ids: list[int] = []
        inner, final = self.inner, self.final
        for w in words:
            ids += [inner[b] for b in w[:-1]]
            ids += (final[w[-1]], -1)  # -1 ends the word and pairs with nothing
        n = len(ids)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        find = self.merges.get
        places: dict[int, list[int]] = {}
        for i, pair in enumerate(zip(ids, ids[1:])):
            found = find(pair)
            if found is not None:
                if found[0] in places:
                    places[found[0]].append(i)
                else:
                    places[found[0]] = [i]
        active = list(places)
        heapq.heapify(active)
        while active:
            rank = heapq.heappop(active)
            waiting, new = sorted(places.pop(rank)), self.made[rank]
            for at, i in enumerate(waiting):
                j = after[i]
                if ids[i] < 0 or ids[j] < 0:
                    continue
                found = find((ids[i], ids[j]))
                if found is None or found[1] != new:
                    continue  # an earlier merge took one of the two
                ids[i], ids[j] = new, -2
                after[i] = k = after[j]
                before[k] = i
                lowest = rank
                for left in (before[i], i):
                    if left >= 0:
                        found = find((ids[left], ids[after[left]]))
                        if found is not None:
                            if found[0] in places:
                                places[found[0]].append(left)
                            else:
                                places[found[0]] = [left]
                                heapq.heappush(active, found[0])
                            if found[0] < lowest:
                                lowest = found[0]
                if lowest < rank:
                    places[rank] = waiting[at + 1 :]
                    heapq.heappush(active, rank)
                    break
        out: list[list[int]] = []
        current: list[int] = []
        for i in ids:
            if i >= 0:
                current.append(i)
            elif i == -1:
                out.append(current)
                current = []
        return out

    def split(self, text: str) -> list[str | int]:
        """Words, and ids of special tokens, in order."""
        if "<|" in text and len(parts := self.specials.split(text)) > 1:
            out: list[str | int] = []
            for part in parts:
                out += [self.special[part]] if part in self.special else self.split(part)
            return out
        if text.isascii():
            return self.plain_words.findall(text.lower())
        # Lower case per character, so a final sigma is no special case.
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        if self.rare.search(text):
            return self.words.findall(text.translate(LOWER_ADDED).lower())
        return self.plain_words.findall(text.lower())

    def learn(self, words: set[str | int]) -> None:
        """Make sure that all ``words`` are remembered; new ones are encoded in one go.

        A full memory becomes the older one, from which words in use move back.
        """
        if len(self.known) > REMEMBERED:
            self.older, self.known = self.known, {}
        known, older, token, packed = self.known, self.older, self.token, self.packed
        new = []
        for word in words.difference(known):
            if word in older:
                known[word] = older[word]
            elif isinstance(word, int):
                known[word] = (packed[word], token[word])
            else:
                new.append(word)
        for word, ids in zip(new, self.merge([w.encode("utf-8") for w in new])):
            known[word] = (b"".join([packed[i] for i in ids]), " ".join([token[i] for i in ids]))

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        """Ids as little-endian 32-bit integers, and the text that decoding them gives."""
        split = [self.split(text) for text in texts]
        words_here = set().union(*split)
        self.learn(words_here)
        known = self.known
        for words in split:
            coded = [known[w] for w in words]
            yield b"".join([c[0] for c in coded]), " ".join([c[1] for c in coded])


@functools.lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def encode_texts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids (binary, little-endian uint32), decoded`` for every row.

    NULL and empty texts have no tokens. A key may be NULL or repeated. Rows are independent of
    each other; a task holds one Arrow batch and the remembered pieces.
    """

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, texts = batch.column("doc_id"), batch.column("text")
        for first, to in by_weight(texts):
            part = [t or "" for t in texts.slice(first, to - first).to_pylist()]
            coded = list(load(path).encode(part))
            columns = [
                ids.slice(first, to - first),
                pa.array([len(c[0]) // 4 for c in coded], pa.int64()),
                pa.array([c[0] for c in coded], pa.binary()),
                pa.array([c[1] for c in coded], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids", "decoded"])

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_batches(rows, run, f"doc_id {kind}, n_tokens long, ids binary, decoded string")
