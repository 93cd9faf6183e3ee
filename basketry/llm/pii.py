"""Personal data: fixed patterns, and a skip-chain conditional random field for what they miss.

The field labels the tokens that hold a digit or ``@``; no kind of data here consists of other
tokens, so all others are outside it. Neighbours in the text are linked by a chain, and equal or
similar tokens (the same letters and digits) that lie apart by skip edges from one occurrence to
the next. Loopy belief propagation passes messages along both, so what one occurrence makes clear
carries over to the others in the document. Weights are fitted to the labels that the patterns give.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_weight, map_batches

KINDS = ("email", "ip", "card", "phone")
# Runs are taken whole and checked for what has to follow, which keeps long texts linear.
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]++(?:@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)?")
_IP = re.compile(r"[0-9]++(?:\.[0-9]+\.[0-9]+\.[0-9]+)?")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_DIGIT = re.compile("[0-9]")

# Bounds of the sample that the weights are fitted to: documents in expectation, and tokens.
SAMPLE_DOCUMENTS = 6_000
SAMPLE_TOKENS = 20_000
FEATURES = 4_096
ROUNDS = 10
# An added span needs this posterior on every token, and so many digits (or an ``@``).
SURE = 0.95
LEAST_DIGITS = {"email": 0, "ip": 4, "card": 12, "phone": 9}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the patterns' spans, by start and kind."""
    out = []
    if "@" in text:
        out += [(m.start(), 0, m.end()) for m in _EMAIL.finditer(text) if "@" in m[0]]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if "." in m[0] and all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = re.sub("[^0-9]", "", m[0]) if m.end() - m.start() <= 40 else ""
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


@dataclass
class Field:
    """Active tokens of some texts as one graph: places, features, labels and edges."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    features: list[list[int]]
    label: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def _shape(token: str) -> str:
    return re.sub(r"a+", "a", re.sub(r"[^\W\d_]", "a", re.sub("[0-9]", "9", token)))


def _features(text: str, a: int, b: int) -> list[int]:
    token = text[a:b]
    before, after = text[max(0, a - 24) : a].split(), text[b : b + 24].split()
    digits = re.sub("[^0-9]", "", token)
    names = [
        "shape=" + _shape(token),
        "core=" + _shape(token.strip(".,;:!?()[]{}\"'")),
        f"digits={min(len(digits), 20)}",
        f"luhn={12 <= len(digits) <= 19 and luhn(digits)}",
        f"at={'@' in token}",
        f"dots={min(token.count('.'), 5)}",
        "first=" + _shape(token[:1]),
        "last=" + _shape(token[-1:]),
        "before=" + _shape(before[-1] if before else ""),
        "after=" + _shape(after[0] if after else ""),
        "bias",
    ]
    return [zlib.crc32(n.encode()) % FEATURES for n in names]


def field_of(texts: list[str], spans: list[list[tuple[int, int, int]]]) -> Field:
    text, start, end, features, label, chain, skip = [], [], [], [], [], [], []
    for t, (body, known) in enumerate(zip(texts, spans)):
        if not known and not _DIGIT.search(body) and "@" not in body:
            continue
        last_end, seen, at = -2, {}, 0
        for m in _TOKEN.finditer(body):
            if not (_DIGIT.search(m[0]) or "@" in m[0]):
                continue
            i = len(text)
            a, b = m.span()
            while at < len(known) and known[at][2] <= a:
                at += 1
            inside = [k for s, k, e in known[at : at + 4] if s < b and a < e]
            text.append(t)
            start.append(a)
            end.append(b)
            label.append(inside[0] + 1 if inside else 0)
            features.append(_features(body, a, b))
            if last_end == a - 1:
                chain.append((i - 1, i))
            last_end = b
            key = re.sub(r"[^0-9a-z]", "", m[0].lower())
            if len(key) >= 4:
                if key in seen and chain[-1:] != [(seen[key], i)]:
                    skip.append((seen[key], i))
                seen[key] = i
    pairs = [np.array(x, np.int64).reshape(-1, 2) for x in (chain, skip)]
    return Field(*(np.array(x, np.int64) for x in (text, start, end)), features, np.array(label, np.int64), *pairs)


@dataclass
class Weights:
    unary: np.ndarray  # FEATURES x labels
    chain: np.ndarray  # labels x labels
    skip: np.ndarray


LABELS = len(KINDS) + 1


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def posterior(field: Field, w: Weights, rounds: int = ROUNDS) -> np.ndarray:
    """Label probabilities of every token by loopy belief propagation in the log domain."""
    n = len(field.text)
    score = np.array([w.unary[f].sum(axis=0) for f in field.features]).reshape(n, LABELS)
    ends = np.concatenate([field.chain, field.skip])
    source = np.concatenate([ends[:, 0], ends[:, 1]])
    target = np.concatenate([ends[:, 1], ends[:, 0]])
    pair = np.concatenate([np.repeat(w.chain[None], len(field.chain), 0), np.repeat(w.skip[None], len(field.skip), 0)])
    pair = np.concatenate([pair, pair.transpose(0, 2, 1)])
    message = np.zeros((len(source), LABELS))
    half = len(ends)
    belief = score
    for _ in range(rounds if half else 0):
        back = np.concatenate([message[half:], message[:half]])
        fresh = _log_sum((belief[source] - back)[:, :, None] + pair, 1)
        fresh -= _log_sum(fresh, 1)[:, None]
        message = 0.5 * message + 0.5 * fresh
        belief = score.copy()
        np.add.at(belief, target, message)
    return np.exp(belief - _log_sum(belief, 1)[:, None]) if n else score


def fit(rows: list, steps: int = 150, rate: float = 0.5, decay: float = 1e-4) -> Weights:
    """Pseudo-likelihood: every token's label given its features and the labels it is linked to."""
    w = Weights(np.zeros((FEATURES, LABELS)), np.zeros((LABELS, LABELS)), np.zeros((LABELS, LABELS)))
    if not rows:
        w.unary[:, 0] = 1.0
        return w
    width = max(len(r["features"]) for r in rows)
    x = np.array([(list(r["features"]) + [0] * width)[:width] for r in rows])
    y = np.array([r["label"] for r in rows])
    links = {"chain": ([], [], []), "skip": ([], [], [])}
    for i, r in enumerate(rows):
        for name, (at, other, side) in links.items():
            for o in r[name]:  # labels of linked tokens; negative: the linked token comes after
                at.append(i)
                other.append(abs(o) - 1)
                side.append(o < 0)
    arrays = {k: tuple(np.array(v, np.int64) for v in vs) for k, vs in links.items()}
    memory = [np.full(p.shape, 1e-8) for p in (w.unary, w.chain, w.skip)]
    for _ in range(steps):
        score = w.unary[x].sum(axis=1)
        for name, pair in (("chain", w.chain), ("skip", w.skip)):
            at, other, side = arrays[name]
            np.add.at(score, at, np.where(side[:, None] == 1, pair[:, other].T, pair[other]))
        p = np.exp(score - _log_sum(score, 1)[:, None])
        p[np.arange(len(y)), y] -= 1
        p /= len(y)
        slopes = [np.zeros_like(w.unary), np.zeros_like(w.chain), np.zeros_like(w.skip)]
        np.add.at(slopes[0], x.ravel(), np.repeat(p, width, axis=0))
        for g, name in zip(slopes[1:], ("chain", "skip")):
            at, other, side = arrays[name]
            after = side == 1
            np.add.at(g, other[~after], p[at[~after]])
            np.add.at(g.T, other[after], p[at[after]])
        for value, g, m in zip((w.unary, w.chain, w.skip), slopes, memory):
            g += decay * value
            m += g * g
            value -= rate * g / np.sqrt(m)
    return w


def training_rows(docs: DataFrame, documents: int, tokens: int) -> list:
    """At most ``tokens`` labelled tokens from about ``documents`` documents, the first by text hash.

    The same rows on any layout: the hash, not the partition, decides what is kept where there are
    more. Every text has a chance, however many there are.
    """
    total = docs.count()
    docs = docs.withColumn("hash", F.xxhash64("text"))
    until = max(-(2**63), 2**64 * documents // max(1, total) - 2**63)
    chosen = docs.filter(F.col("hash") < F.lit(until)) if until < 2**63 else docs

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for a, b in by_weight(batch.column("text")):
            texts = [t or "" for t in batch.column("text").slice(a, b - a).to_pylist()]
            field = field_of(texts, [base_spans(t) for t in texts])
            near: dict[str, list[list[int]]] = {}
            for name, edges in (("chain", field.chain), ("skip", field.skip)):
                near[name] = [[] for _ in field.features]
                for i, j in edges.tolist():
                    near[name][j].append(int(field.label[i]) + 1)
                    near[name][i].append(-int(field.label[j]) - 1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("hash").take(pa.array(field.text + a)),
                    pa.array(field.start.astype(np.int64)),
                    pa.array(field.features, pa.list_(pa.int32())),
                    pa.array(field.label.astype(np.int32)),
                    pa.array(near["chain"], pa.list_(pa.int32())),
                    pa.array(near["skip"], pa.list_(pa.int32())),
                ],
                ["hash", "start", "features", "label", "chain", "skip"],
            )

    fields = "features array<int>, label int, chain array<int>, skip array<int>"
    rows = map_batches(chosen, run, f"hash long, start long, {fields}")
    return rows.orderBy("hash", "start").limit(tokens).select("features", "label", "chain", "skip").collect()


def added_spans(
    texts: list[str], known: list[list[tuple[int, int, int]]], w: Weights
) -> list[list[tuple[int, int, int]]]:
    """Runs of linked tokens that the field gives one kind, outside the patterns' spans."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    field = field_of(texts, known)
    if not len(field.text):
        return out
    p = posterior(field, w)
    best = p.argmax(axis=1)
    sure = (best > 0) & (p[np.arange(len(best)), best] >= SURE) & (field.label == 0)
    linked = {j: i for i, j in field.chain.tolist()}
    begun: dict[int, int] = {}
    for j in np.flatnonzero(sure).tolist():
        i = linked.get(j)
        begun[j] = begun[i] if i in begun and best[i] == best[j] else j
    for j, i in begun.items():
        if j + 1 in begun and begun[j + 1] == i:
            continue
        t, kind = int(field.text[j]), int(best[j]) - 1
        a, b = int(field.start[i]), int(field.end[j])
        body = texts[t][a:b]
        inner = body.strip(".,;:!?()[]{}<>\"'")
        a += body.find(inner) if inner else 0
        enough = sum(map(str.isdigit, inner)) >= LEAST_DIGITS[KINDS[kind]]
        if inner and enough and (kind != 0 or "@" in inner):
            if all(e <= a or a + len(inner) <= s for s, _, e in known[t]):
                out[t].append((a, kind, a + len(inner)))
    return out


def find_personal_data(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    sample_documents: int = SAMPLE_DOCUMENTS,
    sample_tokens: int = SAMPLE_TOKENS,
) -> DataFrame:
    """``doc_id, base, added`` for every row of ``docs``; arrays of ``(start, kind_order, kind, end)``.

    Places count code points, ends are exclusive. ``base`` are the patterns' spans, ``added`` those
    of the field, which touch none of them. NULL and empty texts have none. Keys may be NULL or
    repeated. The field is fitted to a bounded sample and applied to all texts.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    weights = rows.sparkSession.sparkContext.broadcast(
        fit(training_rows(rows.select("text"), sample_documents, sample_tokens))
    )

    def spans(found: list[tuple[int, int, int]]) -> list[dict]:
        return [{"start": a, "kind_order": k + 1, "kind": KINDS[k], "end": b} for a, k, b in sorted(found)]

    kind = pa.list_(
        pa.struct([("start", pa.int32()), ("kind_order", pa.int32()), ("kind", pa.string()), ("end", pa.int32())])
    )

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for a, b in by_weight(batch.column("text")):
            texts = [t or "" for t in batch.column("text").slice(a, b - a).to_pylist()]
            base = [base_spans(t) for t in texts]
            added = added_spans(texts, base, weights.value)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(a, b - a),
                    pa.array([spans(x) for x in base], kind),
                    pa.array([spans(x) for x in added], kind),
                ],
                ["doc_id", "base", "added"],
            )

    span = "array<struct<start:int,kind_order:int,kind:string,end:int>>"
    of_key = rows.schema["doc_id"].dataType.simpleString()
    return map_batches(rows, run, f"doc_id {of_key}, base {span}, added {span}")
