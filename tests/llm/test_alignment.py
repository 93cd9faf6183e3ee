"""Aligned tokenizers against the tokenizers themselves and plain byte ranges."""

import brute
import public_tokenizers
import pytest
import sentencepiece
from basketry.llm import alignment, queries
from conftest import frame
from tokenizers import Tokenizer


@pytest.fixture(scope="module")
def plain():
    """Encoders and bytes of both vocabularies, from their own libraries."""
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    byte = {s: i for i, s in enumerate(alignment.byte_symbols())}
    bytes_a = [bytes(byte[c] for c in a.id_to_token(i)) if i < 50_256 else b"" for i in range(50_257)]
    bytes_b = [
        bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
        for i in range(b.get_piece_size())
    ]
    return (lambda t: a.encode(" " + t, add_special_tokens=False).ids), b.encode, bytes_a, bytes_b


ODD = [
    (None, "null id"),
    (5, "same text"),
    (5, "same text"),
    (6, None),
    (7, ""),
    (8, " "),
    (9, "\u2581 is a space to one side"),
    (10, "<|endoftext|> </s> <s> <unk> <0x41>"),
    (11, "é" * 400 + " 日本語 🙂 \U0001f9d1\u200d\U0001f680 \x00\x07 \t\n\n  x"),
    (12, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 30),
    (13, "1234567890 12.5e-7 don't I'LL  two  spaces   "),
    (14, "ͻ ǅ ʼn ﬁ ½ ² Ⅷ ১২ ".strip() + "\u2028\u00a0\u3000"),
]


def rows(df):
    return sorted(map(tuple, df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum").collect()), key=repr)


@pytest.mark.parametrize("part", [3_000, 4_000_000])
def test_alignment(docs, corpus, plain, part, monkeypatch):
    monkeypatch.setattr(alignment, "PART", part)
    load = queries.public_aligner
    got = rows(alignment.align_tokenizers(docs, load))
    assert got == sorted(brute.alignment(corpus, *plain), key=repr)


def test_alignment_of_odd_rows(spark, plain):
    got = rows(alignment.align_tokenizers(frame(spark, ODD), queries.public_aligner))
    expected = brute.alignment(ODD, *plain)
    assert got == sorted(expected, key=repr)
    assert [e[1:] for e in expected if e[0] == 9] == [(0, 0, 0, 0, "", 0, 0)]


def test_tasks_hold_lists_of_a_slice_or_a_part(docs, corpus, plain, monkeypatch):
    monkeypatch.setattr(alignment, "PART", 3_000)
    monkeypatch.setattr(alignment, "SLICE", 700, raising=False)

    def load():
        aligner = queries.public_aligner()
        align = type(aligner).align

        def sliced(texts):
            assert len(texts) == 1 or sum(map(len, texts)) <= 700
            return align(aligner, texts)

        aligner.align = sliced
        return aligner

    aligned = alignment.align_tokenizers(docs, load)
    assert rows(aligned) == sorted(brute.alignment(corpus, *plain), key=repr)
    # Arrow batches are cut by rows and not by bytes, so lists of texts are not read through them.
    assert "MapInArrow" not in aligned._jdf.queryExecution().toString()


def test_alignment_of_an_empty_table(spark):
    assert rows(alignment.align_tokenizers(frame(spark, ODD).limit(0), queries.public_aligner)) == []
    assert rows(alignment.align_tokenizers(frame(spark, [(1, None), (2, "")]), queries.public_aligner)) == [
        (1, 0, 0, 0, 0, "", 0, 0),
        (2, 0, 0, 0, 0, "", 0, 0),
    ]


def test_pairs_of_equal_bytes_also_count_inside_irregular_groups():
    """Both sides cut the same bytes at other places, so equal tokens overlap without being aligned."""
    a = alignment.Tokens(lambda texts: [[0, 1, 2] for _ in texts], [b" ", b"aa", b"a"])
    b = alignment.Tokens(lambda texts: [[0, 2, 1] for _ in texts], [b" ", b"aa", b"a"])
    found = alignment.Aligner(a, b).align(["aaa"])
    assert [int(c[0]) for c in found["counts"]] == [3, 3, 2, 4]
    pairs = {(int(p) >> alignment.BITS, int(p) & alignment.MASK) for p in found["pair"]}
    assert pairs == {(0, 0), (1, 2), (1, 1), (2, 1)}


def test_every_code_point_is_cut_alike(plain):
    """The rank encoder and the tokenizers library agree on all assigned characters."""
    import unicodedata

    encode = plain[0]
    load = queries.public_aligner()
    kept = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) not in ("Cn", "Cs", "Co")]
    texts = ["".join(f"a{c}1{c} {c}" for c in kept[i : i + 400]) for i in range(0, len(kept), 400)]
    assert load.a.encode(texts) == [encode(t) for t in texts]
