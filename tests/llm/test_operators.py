"""Every text operator against its plain version, on odd rows and on empty tables."""

import math
import random
import struct

import brute
import public_tokenizers
import pytest
import xxhash
from basketry.llm import bpe, contamination, fm, lines, near, pii, quality, secrets, sharding, substrings, warc
from basketry.llm.common import given_id, sha256_text
from conftest import frame
from pyspark.sql import functions as F

ODD = [(None, "null id line one\nsame long line here"), (5, "same long line here"), (5, "same long line here"), (5, None), (9, "")]


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def spans_of(found, kinds):
    return found.select(
        "doc_id",
        *[secrets.count_kind("base", k) for k in kinds],
        F.sha2(secrets.span_text(F.col("base")), 256),
    )


def near_rows(df):
    return near.group_near_duplicates(df).select(
        given_id("doc"), "n_shingles", given_id("component_id"), F.col("doc") == F.col("component_id")
    )


def hit_rows(df, items, **how):
    return contamination.measure_contamination(df, items, **how).select(
        "row.doc_id", "n_words", "n_hit", F.size("items"), sha256_text(F.array_join("items", ",")), contamination.contaminated()
    )


@pytest.mark.parametrize("batches,fanout", [(1, 2), (4, 3), (7, 2)])
def test_lines(docs, corpus, batches, fanout):
    out = lines.drop_repeated_lines(docs, batches=batches, fanout=fanout)
    got = rows(out.select("doc_id", "n_lines", "n_dropped", sha256_text(F.col("text"))))
    assert got == sorted(brute.lines(corpus), key=repr)
    assert set(docs.columns) <= set(out.columns)


def test_lines_of_odd_rows(spark):
    got = rows(lines.drop_repeated_lines(frame(spark, ODD)).select("doc_id", "text", "n_dropped"))
    expected = [(None, ODD[0][1], 0), (5, "", 1), (5, "", 1), (5, "", 0), (9, "", 0)]
    assert got == sorted(expected, key=repr)


def test_runs_are_compacted(spark):
    runs = lines.Runs(fanout=2)
    for i in range(4):
        runs.add(spark.createDataFrame([(i, i)], "h1 long, h2 long"))
    assert [len(level) for level in runs.levels] == [0, 0, 1]
    assert rows(runs.all()) == [(i, i) for i in range(4)]


def test_near(docs, corpus):
    assert rows(near_rows(docs)) == sorted(brute.near(corpus), key=repr)


def test_near_group_that_fills_several_blocks(spark, monkeypatch):
    """A long list of near copies, some of them linked only with some others."""
    import random

    monkeypatch.setattr(near, "BLOCK", 8)
    r = random.Random(5)
    base = [f"w{r.randrange(500)}" for _ in range(150)]
    texts = []
    for i in range(90):
        w = list(base)
        for _ in range(r.randint(0, 14)):
            w[r.randrange(len(w))] = f"x{r.randrange(10_000)}"
        texts.append((i, " ".join(w)))
    expected = brute.near(texts)
    assert len({e[2] for e in expected}) > 3
    assert rows(near_rows(frame(spark, texts))) == sorted(expected, key=repr)


def test_near_odd_rows(spark):
    got = near.group_near_duplicates(frame(spark, ODD)).count()
    assert got == len(ODD)
    kept = near.keep_one(frame(spark, ODD))
    assert sorted(kept.columns) == sorted(frame(spark, ODD).columns)


def test_chain_of_links_is_one_group(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {r.label for r in near.components(links).collect()} == {0, 100}


def test_secrets(docs, corpus):
    got = spans_of(secrets.find_secrets(docs), ("assign", "access", "hex"))
    assert rows(got) == sorted(brute.secrets(corpus), key=repr)


def test_random_strings_are_found_and_words_are_not(spark):
    import random
    import string

    r = random.Random(1)
    alphabet = string.ascii_letters + string.digits + "+/"
    secret = "".join(r.choice(alphabet) for _ in range(64))
    stems = ["ing", "tion", "the", "ment", "able", "her", "and", "stra"]
    texts = [(i, "".join(r.choice(stems) for _ in range(7)) + " so " + "Ab" * 20 * (i < 3)) for i in range(600)]
    texts.append((1000, f"é {secret} end"))
    found = [r for r in secrets.find_secrets(frame(spark, texts)).collect() if r.added]
    assert [(r.doc_id, r.added[0].start, r.added[0].end, r.added[0].token) for r in found] == [(1000, 2, 66, secret)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_planted_secrets_among_identifiers_and_capitals(spark, seed):
    """25 strings per encoding and length, next to words, paths, hyphenated words and random capitals."""
    import random
    import string

    r = random.Random(seed)
    stems = ["ing", "tion", "the", "ment", "able", "her", "and", "stra", "vo", "quel", "ich", "eau"]
    word = lambda n: "".join(r.choice(stems) for _ in range(n))
    texts = [f"{word(2)} {word(r.randint(5, 20)).capitalize()} {word(3)}" for _ in range(900)]
    ordinary = [r.choice("/-_").join(word(r.randint(1, 3)) for _ in range(r.randint(4, 7))) for _ in range(600)]
    capitals = ["".join(r.choice(string.ascii_uppercase) for _ in range(r.randint(16, 64))) for _ in range(100)]
    alphabets = {"base64": string.ascii_letters + string.digits + "+/", "base32": string.ascii_uppercase + "234567", "hex": "0123456789ABCDEF"}
    planted = {name: ["".join(r.choice(a) for _ in range(n)) for n in (16, 24, 32, 48, 64) for _ in range(25)] for name, a in alphabets.items()}
    strings = ordinary + capitals + [s for p in planted.values() for s in p]
    docs = list(enumerate(texts + [f"é {s} so" for s in strings]))
    found = [a.token for row in secrets.find_secrets(frame(spark, docs)).collect() for a in row.added]
    for p in planted.values():
        assert sum(s in set(found) for s in p) >= 0.9 * len(p)
    secret = {s for p in planted.values() for s in p} | set(capitals)
    assert sum(f not in secret for f in found) <= 0.05 * len(found)


@pytest.mark.parametrize("shard_words", [60, 100_000])
def test_substrings(docs, corpus, shard_words):
    out = substrings.drop_repeated_spans(docs, shard_words=shard_words)
    got = out.select("row.doc_id", "n_words", "n_removed", sha256_text(F.col("kept")))
    assert rows(got) == sorted(brute.substrings(corpus), key=repr)


def test_windows_of_a_hot_passage_are_combined_before_they_are_dealt(spark, monkeypatch):
    """One window in many distinct fragments of one minimizer must not fill one shard."""
    import numpy as np
    from pyspark.sql.classic.dataframe import DataFrame

    n, inner = 400, np.arange(1, 14, dtype=np.uint64)
    pieces = [np.concatenate([[1000 + i], inner, [5000 + i // 2]]).astype(np.uint64) for i in range(n)]
    pieces += [np.arange(100, 113, dtype=np.uint64), np.arange(100, 114, dtype=np.uint64)]
    table = [(i, -i, 7 * i % n, 77 if i < n else 78, p.tobytes()) for i, p in enumerate(pieces)]
    least, expected = {}, {}
    windows = [(i, k, p[k : k + 13].tobytes()) for i, p in enumerate(pieces) for k in range(len(p) - 12)]
    for i, _, w in windows:
        least[w] = min(least.get(w, n), table[i][2])
    for i, k, w in windows:
        if least[w] < table[i][2]:
            expected.setdefault(i, []).append(k)
    dealt, group = [], DataFrame.groupBy

    def spy(self, *by):
        dealt.extend([self] if by == ("shard",) else [])
        return group(self, *by)

    monkeypatch.setattr(DataFrame, "groupBy", spy)
    distinct = spark.createDataFrame(table, "f1 long, f2 long, owner long, minimizer long, words binary")
    got = substrings.search_shards(distinct, 13, 1000).collect()
    assert {r.f1: sorted(r.earlier) for r in got} == expected
    largest = [group(d, "shard").agg(F.sum(F.length("words") / 8).alias("n")).agg(F.max("n")).first()[0] for d in dealt]
    assert max(largest) < 100


def test_substrings_of_a_passage_between_many_neighbours(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    texts = [(i * 37 % 101, f"{'' if i % 9 == 0 else f'a{i} b{i % 5} '}{passage} c{i % 7} d{i} e f") for i in range(101)]
    out = substrings.drop_repeated_spans(frame(spark, texts), shard_words=600)
    got = out.select("row.doc_id", "n_words", "n_removed", sha256_text(F.col("kept")))
    assert rows(got) == sorted(brute.substrings(texts), key=repr)


def test_fm_index_counts_like_a_scan():
    import numpy as np

    r = np.random.default_rng(2)
    lengths = r.integers(3, 30, 40)
    pieces = r.integers(0, 5, int(lengths.sum())).astype(np.uint64)
    index = fm.FmIndex(pieces, lengths)
    cut = np.split(pieces, np.cumsum(lengths)[:-1])
    places = [(p, e) for p, n in enumerate(lengths) for e in range(6, n + 1)]
    begin = np.concatenate([[0], np.cumsum(lengths + 1)])
    at = np.array([begin[p] + e for p, e in places])
    matched, low, high = index.search(at, 6)
    for (p, e), m, a, b in zip(places, matched, low, high):
        found = [sum(list(q[i : i + k]) == list(cut[p][e - k : e]) for q in cut for i in range(len(q))) for k in range(1, 7)]
        assert m == sum(n > 1 for n in found)
        assert b - a == found[min(m, 5)]


def test_personal_data(docs, corpus):
    out = pii.find_personal_data(docs)
    assert rows(spans_of(out, pii.KINDS)) == sorted(brute.personal(corpus), key=repr)
    for r in out.collect():
        assert all(a.end <= b.start or b.end <= a.start for a in r.added for b in r.base)


def test_features_read_whole_tokens():
    """A number at the end of a long token counts."""
    features = lambda tail: pii._features(t := "x-" * 50 + tail, 0, len(t))
    card, other = features("4539148803436467"), features("4539148803436468")
    assert [i for i in range(len(card)) if card[i] != other[i]] == [3]
    assert features("ab1")[0] != features("1ab1")[0] and features("ab1")[2] != features("ab12")[2]


def test_field_carries_labels_to_repeated_tokens():
    import numpy as np

    texts = ["no: 5550001234 then more text and 5550001234 again"]
    field = pii.field_of(texts, [[]])
    assert field.skip.tolist() == [[0, 1]]
    w = pii.Weights(np.zeros((pii.FEATURES, 5)), np.zeros((5, 5)), 3.0 * np.eye(5))
    assert field.features[0][8] != field.features[1][8]
    w.unary[field.features[0][8], 4] = 4.0  # only the first occurrence has a telling neighbour
    p = pii.posterior(field, w)
    assert p[1].argmax() == 4 and p[1][4] > 0.5


def test_belief_propagation_is_exact_on_a_chain():
    import itertools

    import numpy as np

    r = np.random.default_rng(0)
    field = pii.field_of(["a1 b2 c3"], [[]])
    w = pii.Weights(r.normal(size=(pii.FEATURES, 5)) * 0.3, r.normal(size=(5, 5)), np.zeros((5, 5)))
    unary = np.array([w.unary[f].sum(0) for f in field.features])
    exact = np.zeros((3, 5))
    for y in itertools.product(range(5), repeat=3):
        p = math.exp(sum(unary[i, y[i]] for i in range(3)) + w.chain[y[0], y[1]] + w.chain[y[1], y[2]])
        for i in range(3):
            exact[i, y[i]] += p
    exact /= exact.sum(1, keepdims=True)
    assert np.allclose(pii.posterior(field, w, rounds=60), exact, atol=1e-6)


def test_bpe_equals_the_library(docs, corpus):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    extra = [(10_000, "<|endoftext|>a <|startoftext|> aaaaaaaaaaaa 'LL ÀΣσς é ½३\x1c x"), (None, "null id")]
    texts = dict(corpus) | dict(extra)
    out = bpe.encode_texts(docs.select("doc_id", "text").union(docs.sparkSession.createDataFrame(extra, "doc_id long, text string")), path)
    found = out.collect()
    assert len(found) == len(texts)
    for r in found:
        expected = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert list(struct.unpack(f"<{r.n_tokens}I", r.ids)) == expected
        assert r.decoded == library.decode(expected, skip_special_tokens=False)


def test_bpe_memory_is_bounded(monkeypatch, corpus):
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [t or "" for _, t in corpus]
    whole = list(bpe.WordBpe(path).encode(texts))
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    small = bpe.WordBpe(path)
    assert [x for t in texts for x in small.encode([t])] == whole


def unsigned_hash(key, shard):
    return xxhash.xxh64(struct.pack("<i", shard), seed=xxhash.xxh64(struct.pack("<q", key), seed=42).intdigest()).intdigest()


def test_sharding(docs, corpus):
    weights = [1.0, 2.0, 0.0, 0.5]

    def shard(key, ws):
        score = lambda i: -math.log(((unsigned_hash(key, i) >> 11) + 0.5) / 2**53) / ws[i]
        return min((i for i, w in enumerate(ws) if w > 0), key=score)

    out = sharding.shard_rows(docs, weights=weights).collect()
    assert {r.doc_id: (r.shard, r.grown_shard) for r in out} == {
        d: (shard(d, weights), shard(d, [*weights, 1.0])) for d, _ in corpus
    }
    for s in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    assert all(r.grown_shard in (r.shard, 4) for r in out)
    assert {r.doc_id: r.size for r in out} == {d: len((t or "").encode()) + 16 for d, t in corpus}


def test_shares_follow_weights(spark):
    keys = spark.range(20_000).select(sharding.rendezvous(F.col("id"), [1.0, 3.0]).alias("s"))
    assert abs(keys.filter("s = 1").count() / 20_000 - 0.75) < 0.02


@pytest.mark.parametrize("sent", [0, 1_000_000])
def test_contamination(spark, docs, corpus, sent):
    texts = [t for _, t in corpus if t and len(t.split()) > 30]
    items = [(i, " ".join(t.split()[5 : 5 + 13 + i])) for i, t in enumerate(texts[:12])]
    items += [(50, "ONE, two"), (51, ""), (52, None), (53, "la"), (54, "a b c d e"), (55, items[0][1]), (None, items[1][1])]
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit(1))
    assert rows(hit_rows(docs, table, sent=sent)) == sorted(brute.contamination(corpus, items), key=repr)
    clean = contamination.keep_clean(docs, table)
    assert clean.columns == docs.columns


def test_winnowing_finds_every_shared_span():
    import numpy as np
    import pyarrow as pa
    from basketry.llm.words import ALNUM, words_of

    r = np.random.default_rng(4)
    for _ in range(50):
        shared = [f"s{x}" for x in r.integers(0, 1000, 13)]
        found = []
        for _ in range(2):
            text = [f"u{x}" for x in r.integers(0, 10**9, r.integers(0, 20))] + shared + [f"v{x}" for x in r.integers(0, 10**9, 9)]
            w = next(words_of(pa.array([" ".join(text)]), ALNUM, True))
            found.append(set(contamination.winnow(w)[1].tolist()))
        assert found[0] & found[1]


def test_quality_counts(docs, corpus):
    out = quality.judge_quality(docs)
    got = rows(out.select("doc_id", *quality.COUNTS, "base_failed"))
    assert got == sorted(brute.quality(corpus), key=repr)
    assert out.filter("base_failed AND kept").count() == 0


def test_quality_cutoffs_follow_the_source(spark):
    """A source of long words keeps them; the same text in another source is an outlier."""
    text = lambda n, i: " ".join(f"{'x' * n}{(i * 7 + j * 13) % 997}" for j in range(60))
    rows_ = [(i, text(4, i), "en", "a") for i in range(300)] + [(1000 + i, text(40, i), "en", "b") for i in range(300)]
    rows_ += [(5000, text(40, 5), "en", "a"), (5001, text(40, 5), None, "a")]
    out = quality.judge_quality(spark.createDataFrame(rows_, "doc_id long, text string, lang string, source string"))
    kept = {r.doc_id for r in out.filter("kept").collect()}
    assert set(range(300)) | set(range(1000, 1300)) <= kept and 5000 not in kept


def test_quality_quantiles_tighten_the_cutoffs(spark):
    """Words far longer than in the rest of a source are outliers, whatever is usual elsewhere."""
    text = lambda n, i: " ".join(f"{'x' * (n + (j < i % 20))}{(i * 7 + j * 13) % 997}" for j in range(60))
    rows_ = [(i, text(4, i), "en", "a") for i in range(300)] + [(5000, text(8, 5), "en", "a")]
    out = quality.judge_quality(spark.createDataFrame(rows_, "doc_id long, text string, lang string, source string"))
    assert {r.doc_id for r in out.filter("kept").collect()} == set(range(300))


def test_quality_sketch_quantiles(spark):
    import numpy as np

    r = np.random.default_rng(1)
    values = r.gamma(2.0, 3.0, 4000) + 1
    frame_ = spark.createDataFrame(
        [("en", "a", 1000, int(v * 1000), 0, 0, 0, 10, 0) for v in values],
        "lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_marks long",
    )
    limit = quality.cutoffs(quality.sketches(frame_)).first()
    q1, q3 = np.quantile(values, [0.25, 0.75])
    assert limit.high_word_length == pytest.approx(q3 + quality.REACH * (q3 - q1), rel=0.15)
    assert limit.high_mark_share is None and limit.high_repeat_share is None


@pytest.mark.parametrize("prior", [20.0, 200.0])
def test_quality_verdict(spark, prior):
    """Kept rows equal the plain version; text full of marks goes, the rest of the passing rows stays."""
    r = random.Random(8)
    vocabulary = ["".join(r.choice("abcdefghijklmnoprstu") for _ in range(r.randint(2, 9))) for _ in range(500)]
    rows_ = []
    for i in range(500):
        w = [r.choice(vocabulary) + r.choice(["", "", "", ",", "."]) for _ in range(r.randint(40, 150))]
        lang, source = r.choice(["en", "de", None]), r.choice(["a", "a", "a", "b", "c", ""])
        if i % 25 == 0:
            w = [x + r.choice(["###", "$$$", "%%%", ""]) for x in w]
        if i % 30 == 1:
            w += w[: r.randint(5, 40)]
        text = "".join(x + ("\n" if j % 13 == 12 else " ") for j, x in enumerate(w))
        rows_.append((i, text + ("\n" + text[:200]) * (i % 40 == 2), lang, source))
    rows_ += [(900, None, "en", "a"), (901, "", "en", "a"), (902, "w " * 60, "en", "a"), (903, rows_[3][1], "xx", "y")]
    expected = brute.quality_kept(rows_, prior)
    frame_ = spark.createDataFrame(rows_, "doc_id long, text string, lang string, source string").repartition(5)
    assert {x.doc_id for x in quality.judge_quality(frame_, prior=prior).filter("kept").collect()} == expected
    good = quality.keep_good(frame_.withColumn("row", F.lit(1)).withColumn("n_words", F.lit("x")), prior=prior)
    assert good.columns == [*frame_.columns, "row", "n_words"]
    assert {x.doc_id for x in good.collect()} == expected
    passing = {x[0] for x in brute.quality([y[:2] for y in rows_]) if not x[-1]}
    junk = {i for i in passing if i < 500 and i % 25 == 0}
    assert len(junk) > 10 and not junk & expected and len(passing - junk - expected) <= 2


def test_quality_labels(spark):
    """On the given labels no good document goes, and nearly all bad ones that pass the base rule do."""
    sf = "/root/testdata/sf0.01"
    judged = quality.judge_quality(spark.read.parquet(f"{sf}/documents.parquet")).filter("NOT base_failed")
    judged = judged.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    n = {(x.quality, x.kept): x["count"] for x in judged.groupBy("quality", "kept").count().collect()}
    assert n.get((1, False), 0) == 0 and n.get((0, True), 0) <= 0.05 * n[0, False]


@pytest.mark.parametrize("segment", [50, 1_000_000])
def test_warc(spark, tmp_path, corpus, segment):
    pages = spark.createDataFrame([(d, f"http://e.org/{d}" if d % 3 else None, t, "x") for d, t in corpus], "page_id long, url string, html string, row string")
    path = str(tmp_path / "archives")
    warc.write_archives(pages, path, segment=segment)
    out = warc.read_pages(spark, path)
    assert rows(out.drop("payload")) == sorted(brute.warc(corpus), key=repr)
    texts = dict(corpus)
    records = warc.read_records(spark, path)
    named = {r.refers_to for r in records.filter("refers_to IS NOT NULL").collect()}
    assert named and named <= {r.record_id for r in records.filter("kind = 'response'").collect()}
    for r in out.filter("payload IS NOT NULL").collect():
        assert bytes(r.payload) == (texts[r.page_id] or "").encode()


def test_warc_odd_rows(spark, tmp_path):
    odd = [(None, "u", "x"), (1, None, "x"), (1, None, "x"), (2, "u", None), (3, "u", "")]
    pages = spark.createDataFrame(odd, "page_id long, url string, html string")
    path = str(tmp_path / "archives")
    warc.write_archives(pages, path)
    got = rows(warc.read_pages(spark, path).select("page_id", "record_type", "refers_to"))
    ids = {r.record_id for r in warc.read_records(spark, path).collect()}
    assert {r.refers_to for r in warc.read_records(spark, path).collect()} - {None} <= ids
    expected = [(None, "revisit", 1), (1, "response", None), (1, "response", None), (2, "revisit", 3), (3, "response", None)]
    assert got == sorted(expected, key=repr)


def test_warc_errors():
    record = warc.page_records("urn:page:1:row:0", None, b"abc" * 100, None, 64)
    data = b"".join(r + b"\r\n\r\n" for r in record)
    assert len(list(warc.parse_records(data))) == len(record) > 2
    with pytest.raises(ValueError):
        list(warc.parse_records(data[:-9]))
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nabc")
    assert warc.dechunked(b"3;x=y\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"


def test_empty_tables(spark, docs, tmp_path):
    none = docs.limit(0)
    items = spark.createDataFrame([], "item_id long, text string")
    assert lines.drop_repeated_lines(none).count() == 0
    assert near.group_near_duplicates(none).count() == 0
    assert secrets.find_secrets(none).count() == 0
    assert substrings.drop_repeated_spans(none).count() == 0
    assert pii.find_personal_data(none).count() == 0
    assert bpe.encode_texts(none, public_tokenizers.path("word_bpe_49k.json")).count() == 0
    assert sharding.shard_rows(none).count() == 0
    assert contamination.measure_contamination(none, items).count() == 0
    assert contamination.measure_contamination(docs, items).filter("n_hit > 0").count() == 0
    assert quality.judge_quality(none).count() == 0
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "a"))
    assert warc.read_pages(spark, str(tmp_path / "a")).count() == 0


@pytest.mark.parametrize(
    "call",
    [secrets.find_secrets, pii.find_personal_data, sharding.shard_rows, quality.judge_quality, substrings.drop_repeated_spans],
)
def test_odd_rows_come_back(spark, call):
    assert call(frame(spark, ODD)).count() == len(ODD)


@pytest.mark.parametrize("documents,tokens", [(10**9, 10**5), (40, 10**5), (10**9, 12), (1, 10**5)])
def test_training_rows_do_not_depend_on_the_layout(docs, documents, tokens):
    texts = docs.select("text")
    a, b = (sorted(map(repr, pii.training_rows(texts.repartition(n), documents, tokens))) for n in (1, 7))
    assert a == b
    if (documents, tokens) == (10**9, 10**5):
        assert len(a) > 12
    assert len(a) <= tokens


def test_training_sample_of_a_huge_corpus_is_not_empty(docs, monkeypatch):
    """A share far below one in a million still takes texts by their hash."""
    texts = docs.select("text").filter(F.col("text").contains("@")).filter(F.xxhash64("text") < 0)
    assert len(pii.training_rows(texts, docs.count() // 2, 10**5)) > 0
