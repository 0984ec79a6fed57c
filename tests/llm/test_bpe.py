"""Encoding and decoding against the tokenizers library."""

import hashlib
import json

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from granary.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def both():
    return bpe.Coder(open(PATH, encoding="utf-8").read()), Tokenizer.from_file(PATH)


ODD = [
    "", " ", "  a", "a  b \n\n c\t", "don't I'll we've", "Élan naïve 漢字 かな", "x" * 5000, "aaaa" * 700, " " * 300, "\x1c\x1d\x1e\x1f\x85\xa0 ​　﻿",
    "a<|endoftext|>b<|endoftext|>", "<|endoftext|", "🏳️‍🌈👩🏽‍🚀", "１２３ ⅷ ² 12", "\r\n\r\n x", "é ́", "\0\1", "'s's 'S", "ThE qUiCk\tbrown  fox",
]


def test_odd_texts(both):
    mine, theirs = both
    for t, got in zip(ODD, mine.encode(ODD), strict=True):
        want = theirs.encode(t, add_special_tokens=False).ids
        assert got.tolist() == want, t
        assert mine.decode(got) == theirs.decode(want, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("  aeinrst'<|>\n")), max_size=60), max_size=6))
def test_any_text(both, texts):
    mine, theirs = both
    for t, got in zip(texts, mine.encode(texts), strict=True):
        want = theirs.encode(t, add_special_tokens=False).ids
        assert got.tolist() == want
        assert mine.decode(got) == theirs.decode(want, skip_special_tokens=False)


def test_verification_is_exact(both):
    """A proposal passes exactly if merging gives the same tokens."""
    mine, _ = both
    rng = np.random.default_rng(2)
    ws = [b"".join(mine.pieces[t] for t in rng.integers(0, 50256, 3)) for _ in range(4000)]
    ws += [bytes(rng.choice(list(b"aabeilnst "), 12)) for _ in range(4000)]
    flat, n = mine.encode_words(ws)
    for w, got in zip(ws, np.split(flat, np.cumsum(n)[:-1]), strict=True):
        assert got.tolist() == mine.merged(w)


def test_small_cache_and_chunks(both, monkeypatch):
    mine, theirs = both
    monkeypatch.setattr(bpe, "CACHED", 5)
    for t in ODD:
        assert mine.encode([t, t])[1].tolist() == theirs.encode(t, add_special_tokens=False).ids


def test_table(spark, sf, both):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in bpe.round_trip(docs.select("doc_id", "text"), PATH).collect()}
    for r in docs.collect():
        ids = both[1].encode(r.text or "", add_special_tokens=False).ids
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(both[1].decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_columns_nulls_and_empty(spark):
    df = spark.createDataFrame([(1, None, "k", 7), (1, "", "k", 7), (None, "some text", None, 8)], "doc_id long, text string, ids string, `a b` int")
    back = bpe.decode(bpe.encode(df, PATH), PATH).collect()
    assert sorted((r["a b"], r.n_tokens, r.text) for r in back) == [(7, 0, ""), (7, 0, ""), (8, 2, "some text")]
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_special_tokens_of_any_look():
    told = json.loads(open(PATH, encoding="utf-8").read())
    told["added_tokens"] += [{**told["added_tokens"][0], "id": 50257 + i, "content": c} for i, c in enumerate(["[CLS]", "endoftext", "[CLS] x"])]
    spec = json.dumps(told)
    tok, coder = Tokenizer.from_str(spec), bpe.Coder(spec)
    texts = ["a [CLS] b", "endoftext", "no endoftextual [CLS] x[CLS]", "<|endoftext|>[CLS]", "plain"]
    for t, got in zip(texts, coder.encode(texts), strict=True):
        assert got.tolist() == tok.encode(t, add_special_tokens=False).ids
        assert coder.decode(got) == tok.decode(got.tolist(), skip_special_tokens=False)


@pytest.mark.parametrize("change", [{"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "Whitespace"}}])
def test_other_vocabularies_are_refused(change):
    told = json.loads(open(PATH, encoding="utf-8").read())
    with pytest.raises(ValueError, match="plain byte-level"):
        bpe.Coder(json.dumps(told | change))
