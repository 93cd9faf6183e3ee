"""Spelling variants against every edit of every word."""

import random

import brute
import pytest
from basketry.llm import variants
from conftest import frame


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def misspelt():
    """Frequent words, their one- and two-letter variants, anagrams and Latin-1 letters."""
    r = random.Random(4)
    letters = "aabcdeeéêfghioürst×"
    stems = ["".join(r.choice(letters) for _ in range(r.randint(5, 11))) for _ in range(60)]
    words = []
    for s in stems:
        words += [s] * r.randint(1, 400)
        for _ in range(6):
            w, at = list(s), r.randrange(len(s))
            for _ in range(r.choice([1, 1, 2])):
                w[at : at + r.choice([0, 1])] = r.choice(["", "a", "é", "st"[:1]])
                at = r.randrange(len(w) or 1)
            words += ["".join(w)] * r.randint(1, 90)
        words += ["".join(sorted(s))] * 6 + [s[::-1]] * 7
    r.shuffle(words)
    return [(i, " ".join(w.title() if r.random() < 0.2 else w for w in words[i::40])) for i in range(40)]


@pytest.mark.parametrize("typo_every,flush", [(0, 300_000), (7, 50), (199, 1_000)])
def test_words(spark, misspelt, typo_every, flush, monkeypatch):
    monkeypatch.setattr(variants, "FLUSH", flush)
    out = variants.count_words(frame(spark, misspelt), typo_every=typo_every)
    assert dict(rows(out)) == brute.spelling_words(misspelt, typo_every)


def test_spellings(spark, misspelt):
    out = rows(variants.group_spellings(variants.count_words(frame(spark, misspelt), typo_every=199)))
    expected = brute.spellings(brute.spelling_words(misspelt))
    assert out == sorted(expected, key=repr)
    assert sum(e[3] is not None for e in expected) > 20


def test_spellings_of_the_mixed_corpus(docs, corpus):
    counted = variants.count_words(docs, min_chars=3, min_count=2)
    expected = brute.spellings(brute.spelling_words(corpus, 0, 3, 2))
    assert rows(variants.group_spellings(counted)) == sorted(expected, key=repr)


def test_words_one_edit_apart_share_a_signature():
    r = random.Random(2)
    for _ in range(4000):
        w = "".join(r.choice("abcaé") for _ in range(r.randint(0, 12)))
        at = r.randint(0, len(w))
        edited = w[:at] + r.choice(["", "a", "z"]) + w[at + r.choice([0, 1]) :]
        assert set(variants.signatures(w)) & set(variants.signatures(edited))


def test_long_chains_are_followed_to_the_end(spark):
    words = [("abcdef" + "x" * i, 5 * 6**i) for i in range(18)]
    out = {r["word"]: r for r in variants.group_spellings(spark.createDataFrame(words, "word string, n long")).collect()}
    assert {r["root"] for r in out.values()} == {words[-1][0]}
    assert out["abcdef"]["form"] == "abcdefx" and out[words[-1][0]]["form"] is None


def test_ties_take_the_smallest_word(spark):
    words = [("abcdez", 5), ("abcdeé", 25), ("abcdeb", 25), ("abcdef", 24), ("zzzzzz", 24)]
    out = {r["word"]: r for r in variants.group_spellings(spark.createDataFrame(words, "word string, n long")).collect()}
    assert (out["abcdez"]["form"], out["abcdez"]["n_near"]) == ("abcdeb", 3)
    assert out["zzzzzz"]["n_near"] == 0 and out["zzzzzz"]["root"] == "zzzzzz"


def test_odd_rows_and_empty_tables(spark):
    odd = [(None, "Lettered lettered"), (3, None), (3, ""), (4, "lettered" * 1), (4, "lettered"), (5, "x" * 3000), (5, "short é ÀÀÀÀÀÀ" * 5)]
    assert dict(rows(variants.count_words(frame(spark, odd), typo_every=1))) == brute.spelling_words(odd, 1)
    assert dict(rows(variants.count_words(frame(spark, odd), min_count=1))) == brute.spelling_words(odd, 0, 6, 1)
    empty = variants.count_words(frame(spark, odd).limit(0))
    assert rows(variants.group_spellings(empty)) == []


def test_signatures_are_not_sent_to_the_driver(spark):
    words = spark.createDataFrame([("apple", 9), ("apples", 2)], "word string, n long").coalesce(1)
    for df in (variants.near_words(words), variants.group_spellings(words)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
