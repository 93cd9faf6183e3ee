"""Near-duplicate groups by an inverted join over MinHash signature coordinates.

Documents are sets of word shingles. Equal sets become one representative, and every representative
is posted under each of its ``COORDINATES`` coordinate-value pairs. Two sets of similarity 0.75
collide in at least ``MATCHES`` of the 64 pairs but for a chance of about two in a million.

Prefix: a pair with ``MATCHES`` collisions also collides in the ``COORDINATES - MATCHES + 1`` rarest
coordinates of either side, so only those are posted in lists. Skip: lists are first compared with
their most central member only; what that links is one group, and lists that hold a single group
are skipped from then on. In the other lists only members of different groups are counted against
each other. Every link is confirmed on the full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, order_id, stored
from .words import VISIBLE, mix, words_of

SHINGLE = 5
COORDINATES = 64
MATCHES = 32
# 100 * intersection >= SIMILAR * union
SIMILAR = 75
# Members of one list that meet in one task.
BLOCK = 256

_RNG = np.random.Generator(np.random.PCG64(7))
_FACTORS = _RNG.integers(0, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _RNG.integers(0, 2**63, COORDINATES, dtype=np.uint64)


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text; a shorter text is one shingle."""
    for w in words_of(texts, VISIBLE, True):
        at, grams = w.grams(size)
        cut = np.searchsorted(w.row[at], np.arange(w.rows + 1))
        for r in range(w.rows):
            n = int(w.first[r + 1] - w.first[r])
            if n == 0:
                yield grams[:0]
            elif n < size:
                seed = np.array([n], np.uint64)
                for h in w.hash[w.first[r] : w.first[r + 1]]:
                    seed = mix(seed + h)
                yield seed
            else:
                yield np.unique(grams[cut[r] : cut[r + 1]])


def signature(shingles: np.ndarray) -> np.ndarray:
    """Least hash per coordinate, mixed with the coordinate so that one number names the pair."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 512):
        part = shingles[i : i + 512, None] * _FACTORS + _OFFSETS
        np.minimum(least, part.min(axis=0), out=least)
    return mix(least + np.arange(COORDINATES, dtype=np.uint64))


def linked(common: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int):
    return 100 * common >= SIMILAR * (a + b - common)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc, text_key, n_shingles, set1, set2, signature``: set1 and set2 name the shingle set."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n, s1, s2, signatures = [], [], [], []
        for s in shingle_sets(batch.column("text")):
            n.append(len(s))
            s1.append(int(mix(s).sum(dtype=np.uint64).view(np.int64)))
            s2.append(int(mix(s ^ _OFFSETS[0]).sum(dtype=np.uint64).view(np.int64)))
            signatures.append(signature(s).view(np.int64) if len(s) else None)
        columns = [
            batch.column("doc"),
            batch.column("text_key"),
            pa.array(n, pa.int64()),
            pa.array(s1, pa.int64()),
            pa.array(s2, pa.int64()),
            pa.array(signatures, pa.list_(pa.int64())),
        ]
        names = ["doc", "text_key", "n_shingles", "set1", "set2", "signature"]
        yield pa.RecordBatch.from_arrays(columns, names)

    return map_batches(
        docs, run, "doc long, text_key long, n_shingles long, set1 long, set2 long, signature array<long>"
    )


def posting_lists(reps: DataFrame) -> DataFrame:
    """``pair, doc, weight``: the prefix postings of all documents that can have a partner.

    ``weight`` is the same for all postings of a document: how common its coordinates are, which
    makes the most central member of a list the one with the largest weight.
    """
    postings = reps.select(F.explode("signature").alias("pair"), "doc")
    common = postings.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    shared = postings.join(common, "pair").groupBy("doc").agg(
        F.sort_array(F.collect_list(F.struct("n", "pair"))).alias("rarest")
    )
    weight = F.aggregate("rarest", F.lit(0.0), lambda s, x: s + F.log(x["n"]))
    # Coordinates without a partner are the rarest of all and take their part of the prefix.
    prefix = F.slice("rarest", F.lit(1), F.size("rarest") - (MATCHES - 1))
    able = shared.filter(F.size("rarest") >= MATCHES).select("doc", weight.alias("weight"), prefix.alias("prefix"))
    return able.select(F.explode("prefix.pair").alias("pair"), "doc", "weight")


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose signatures collide often enough and whose full sets are similar."""
    left = texts.select(F.col("doc").alias("a"), F.col("text").alias("ta"), F.col("signature").alias("sa"))
    right = texts.select(F.col("doc").alias("b"), F.col("text").alias("tb"), F.col("signature").alias("sb"))
    near = pairs.join(left.drop("ta"), "a").join(right.drop("tb"), "b")
    collisions = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda x: x))
    near = stored(near.filter(collisions >= MATCHES).select("a", "b"))
    rows = near.join(left.drop("sa"), "a").join(right.drop("sb"), "b").select("a", "b", "ta", "tb")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keep = []
        for i in range(0, batch.num_rows, 64):
            part = batch.slice(i, 64)
            sets = zip(shingle_sets(part.column("ta")), shingle_sets(part.column("tb")))
            for x, y in sets:
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(bool(linked(common, len(x), len(y))))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return map_batches(rows, run, "a long, b long")


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``doc, label`` for every end of a link: the smallest id that can be reached.

    Every round, a node takes the smallest label among its own, its neighbours' and its label's
    label. Rounds end when no label changes; long paths shrink by the last step.
    """
    both = links.union(links.select("b", "a")).toDF("doc", "other").distinct()
    both = stored(both)
    labels = stored(
        both.groupBy("doc").agg(F.min("other").alias("m")).select("doc", F.least("doc", "m").alias("label"))
    )
    for _ in range(most_rounds):
        seen = both.join(labels.select(F.col("doc").alias("other"), "label"), "other")
        best = seen.groupBy("doc").agg(F.min("label").alias("near"))
        step = labels.join(best, "doc", "left").select(
            "doc", F.col("label").alias("was"), F.least("label", F.coalesce("near", "label")).alias("label")
        )
        of = step.select(F.col("doc").alias("label"), F.col("label").alias("further"))
        step = stored(
            step.join(of, "label", "left").select(
                "doc", "was", F.least("label", F.coalesce("further", "label")).alias("label")
            )
        )
        labels = step.select("doc", "label")
        if not step.filter(F.col("was") != F.col("label")).head(1):
            return labels
    raise RuntimeError("groups did not settle")


def _forest(doc: np.ndarray, label: np.ndarray, minor: np.ndarray, texts: pa.Array) -> list[tuple[int, int]]:
    """Links that join the labels of one block as confirmed pairs do, at most one per label joined.

    Only pairs with a ``minor`` member on one side and another label on the other are looked at.
    """
    sets = list(shingle_sets(texts))
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    fresh = np.r_[True, values[1:] != values[:-1]]
    group = np.cumsum(fresh) - 1
    several = np.bincount(group) > 1
    keep = several[group]
    owner, group = owner[keep], group[keep]
    names = np.cumsum(several) - 1
    column = names[group]
    common = np.zeros((len(sets), len(sets)), np.int64)
    width = 8192
    cuts = np.searchsorted(column, np.arange(0, (int(column[-1]) + 1 if len(column) else 0) + width, width))
    for k in range(len(cuts) - 1):
        a, b = cuts[k], cuts[k + 1]
        if b > a:
            block = np.zeros((len(sets), width), np.float32)
            block[owner[a:b], column[a:b] - k * width] = 1
            common += (block @ block.T).astype(np.int64)
    good = linked(common, sizes[:, None], sizes[None, :])
    good &= (label[:, None] != label[None, :]) & (minor[:, None] | minor[None, :])
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(np.triu(good))):
        x, y = find(int(label[i])), find(int(label[j]))
        if x != y:
            parent[x] = y
            out.append((int(doc[i]), int(doc[j])))
    return out


def cross_links(lists: DataFrame, labels: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between members of different groups inside the lists that hold several groups.

    A list's largest group is its major one; the others are minor. Minor members are dealt into
    blocks that meet every block of the list, so no task holds more than two blocks.
    """
    named = lists.join(labels, "doc", "left").select(
        "pair", "doc", F.coalesce("label", "doc").alias("label")
    )
    per_label = named.groupBy("pair", "label").agg(F.count(F.lit(1)).alias("n"))
    open_lists = (
        per_label.groupBy("pair")
        .agg(
            F.count(F.lit(1)).alias("labels"),
            F.sum("n").alias("members"),
            F.max(F.struct("n", "label")).alias("major"),
        )
        .filter(F.col("labels") > 1)
        .select("pair", "members", (F.col("members") - F.col("major.n")).alias("others"), F.col("major.label").alias("major"))
    )
    rows = named.join(open_lists, "pair").withColumns(
        {
            "minor": F.col("label") != F.col("major"),
            "all_blocks": F.ceil(F.col("members") / BLOCK).cast("int"),
            "minor_blocks": F.ceil(F.col("others") / BLOCK).cast("int"),
        }
    )
    own_all = F.pmod(F.xxhash64("doc"), F.col("all_blocks")).cast("int")
    own_minor = F.pmod(F.xxhash64("doc"), F.col("minor_blocks")).cast("int")

    def upto(n: str):
        return F.sequence(F.lit(0), F.col(n) - 1)

    cells = F.transform(upto("minor_blocks"), lambda m: F.struct(m.alias("m"), own_all.alias("a")))
    also = F.transform(upto("all_blocks"), lambda a: F.struct(own_minor.alias("m"), a.alias("a")))
    cells = F.when(F.col("minor"), F.array_union(cells, also)).otherwise(cells)
    dealt = rows.select("pair", "doc", "label", "minor", F.explode(cells).alias("cell"))
    dealt = dealt.join(texts.select("doc", "text"), "doc").select(
        "pair", F.col("cell.m").alias("m"), F.col("cell.a").alias("a"), "doc", "label", "minor", "text"
    )

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        found = _forest(
            table["doc"].to_numpy(), table["label"].to_numpy(), table["minor"].to_numpy(), pa.concat_arrays(table["text"].chunks)
        )
        return pa.table(
            {"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())}
        )

    return dealt.groupBy("pair", "m", "a").applyInArrow(run, "a long, b long")


def group_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc, text_key, n_shingles, component_id`` for every row of ``docs``.

    Words are runs of characters other than ASCII white space, A-Z in lower case. A text with fewer
    than five words is one shingle; NULL, empty and blank texts have none and are linked with
    nothing. ``component_id`` is the smallest integer id that confirmed links reach. ``doc`` is the
    id, NULL as -2**63; rows repeated under one id are one member per distinct text, all with the id
    as their own. ``text_key`` is a hash of the text.
    """
    doc, text_key = order_id(key), F.xxhash64(text)
    rows = docs.select(doc.alias("doc"), text_key.alias("text_key"), F.col(text).alias("text"))
    prints = stored(fingerprints(rows))
    filled = prints.filter(F.col("n_shingles") > 0)
    sets = ["n_shingles", "set1", "set2"]
    # Equal sets are one class; its smallest id stands for it.
    classes = filled.groupBy(*sets).agg(F.min("doc").alias("rep"), F.min_by(F.struct("text_key", "signature"), "doc").alias("own"))
    classes = stored(classes.select(*sets, "rep", "own.text_key", "own.signature", F.xxhash64(*sets).alias("node")))
    reps = classes.select(F.col("node").alias("doc"), "signature")
    lists = posting_lists(reps)
    lists = stored(lists.join(lists.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "pair"))
    active = classes.join(lists.select(F.col("doc").alias("node")).distinct(), "node", "left_semi")
    texts = rows.join(
        active.select(F.col("rep").alias("doc"), "text_key", "node", "signature"), ["doc", "text_key"]
    ).groupBy("node").agg(F.first("text").alias("text"), F.first("signature").alias("signature"))
    texts = stored(texts.withColumnRenamed("node", "doc"))
    center = lists.groupBy("pair").agg(F.max(F.struct("weight", "doc")).alias("c"))
    star = lists.join(center.select("pair", F.col("c.doc").alias("b")), "pair")
    star = star.filter(F.col("doc") != F.col("b"))
    star = star.select(F.least("doc", "b").alias("a"), F.greatest("doc", "b").alias("b")).distinct()
    first = stored(confirmed(star, texts))
    more = stored(cross_links(lists, components(first), texts))
    return _spread(prints, classes, first.union(more))


def _spread(prints: DataFrame, classes: DataFrame, links: DataFrame) -> DataFrame:
    sets = ["n_shingles", "set1", "set2"]
    node = F.xxhash64(*sets)
    rows = prints.select("doc", "text_key", "n_shingles", "set1", "set2", F.when(F.col("n_shingles") > 0, node).alias("node"))
    labels = components(links).withColumnRenamed("doc", "node")
    of_class = classes.select("node", "rep").join(labels, "node", "left").select(
        "node", "rep", F.coalesce("label", "node").alias("group")
    )
    least = of_class.groupBy("group").agg(F.min("rep").alias("component_id"))
    named = of_class.join(least, "group").select("node", "component_id")
    joined = rows.join(named, "node", "left")
    return joined.select(
        "doc", "text_key", "n_shingles", F.coalesce("component_id", "doc").alias("component_id")
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their group, with all their columns."""
    groups = group_near_duplicates(docs, key, text).filter(F.col("doc") == F.col("component_id"))
    kept = groups.select(F.col("doc").alias("__doc"), F.col("text_key").alias("__text_key")).distinct()
    doc = order_id(key)
    return docs.join(
        kept, (doc == F.col("__doc")) & (F.xxhash64(text) == F.col("__text_key")), "left_semi"
    )
