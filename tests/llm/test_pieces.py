"""Encoding and decoding against the sentencepiece library."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import example, given, settings
from hypothesis import strategies as st
from sentencepiece import sentencepiece_model_pb2

from granary.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def both():
    return pieces.Pieces(open(PATH, "rb").read()), sentencepiece.SentencePieceProcessor(model_file=PATH)


ODD = [
    "", " ", "  ", "  a", "a  b \n\n c\t", " a", "a ", "a     ", "▁", "a▁▁b", " ▁ x", "<s>", "</s>x", "<unk>", "<0x41>", "\0a", "\0", "don't", "Élan naïve 漢字 かな", "x" * 5000,
    "aaaa" * 700, " " * 300, "\x1c\x85\xa0 ​　﻿", "🏳️‍🌈👩🏽‍🚀", "１２３ ⅷ", "\r\n\r\n x", "é ́", " ⁇ ", "�", "word " * 4000,
]


def test_odd_texts(both):
    mine, theirs = both
    assert mine.by_word
    for t, got in zip(ODD, mine.encode(ODD), strict=True):
        want = theirs.encode(t, add_eos=True)
        assert got.tolist() == want, t
        assert mine.decode(got) == theirs.decode(want), t


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("   aeinrst'▁<>\n")), max_size=60), max_size=6))
def test_any_text(both, texts):
    mine, theirs = both
    for t, got in zip(texts, mine.encode(texts), strict=True):
        want = theirs.encode(t, add_eos=True)
        assert got.tolist() == want
        assert mine.decode(got) == theirs.decode(want)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 31999), st.integers(0, 262), st.sampled_from([259, 28705, 264])), max_size=12))
@example([197, 1, 131])
@example([1, 264, 1, 264, 197, 0, 131, 2])
def test_any_ids(both, ids):
    """Ids that no text has: bytes that aren't UTF-8, control and unknown ids, markers in front."""
    mine, theirs = both
    assert mine.decode(np.array(ids, np.int64)) == theirs.decode(ids)


def test_words_are_remembered_within_bounds(both, monkeypatch):
    mine, theirs = both
    monkeypatch.setattr(pieces, "KNOWN", 50)
    texts = [f"w{i} and {'y' * (i % 100)}z" for i in range(400)]
    for i in range(0, 400, 20):
        for t, got in zip(texts[i : i + 20], mine.encode(texts[i : i + 20]), strict=True):
            assert got.tolist() == theirs.encode(t, add_eos=True)
        assert len(mine.known) <= 50 + 60
    assert all(len(w) <= pieces.SHORT for w in mine.known)


def test_models_whose_pieces_cross_take_whole_texts():
    told = sentencepiece_model_pb2.ModelProto()
    told.ParseFromString(open(PATH, "rb").read())
    told.pieces[-1].piece = "e▁t"
    told.pieces[-1].score = 1.0
    mine = pieces.Pieces(told.SerializeToString())
    assert not mine.by_word
    texts = ["the table the tree", "", " x"]
    assert [x.tolist() for x in mine.encode(texts)] == [mine.lib.encode(t, add_eos=True) for t in texts]
    assert len(told.pieces) - 1 in mine.encode(texts)[0]


def test_operator(spark, both):
    _, lib = both
    rows = [(1, "one two  three", "n"), (1, "one two  three", "n"), (2, None, "n"), (3, "", None), (None, "x" * 200_000, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").withColumnRenamed("n_tokens", "N_other")
    out = pieces.encode(docs, PATH)
    assert out.columns == ["doc_id", "N_other", "ids", "n_tokens"]
    got = sorted((str(r["doc_id"]), r["ids"]) for r in out.collect())
    assert got == sorted((str(i), lib.encode(t or "", add_eos=True)) for i, t, _ in rows)
    back = sorted((str(r["doc_id"]), r["text"]) for r in pieces.decode(out, PATH).collect())
    assert back == sorted((str(i), t or "") for i, t, _ in rows)
    assert pieces.encode(docs.where("doc_id > 9"), PATH).count() == 0
    clash = docs.select("doc_id", "text", docs.N_other.alias("ids"), docs.N_other.alias("decoded_sha256"))
    assert pieces.round_trip(clash, PATH).columns == ["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_query(spark, sf, both):
    _, lib = both
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = set()
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = lib.encode(r["text"] or "", add_eos=True)
        want.add((r["doc_id"], len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids))))
    assert {tuple(r) for r in pieces.op13_pieces(spark, sf).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()} == want
