"""Packing by exact round trips, files against the tokenizers library."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from granary.llm import token_files as tf

PATH = public_tokenizers.path("word_bpe_49k.json")


def back(ids):
    ids = np.array(ids, np.uint64)
    words, offsets, escapes = tf.pack(ids)
    assert len(offsets) == -(-len(ids) // tf.BLOCK) + 1 and offsets[-1] == len(words)
    return tf.unpack(words, offsets, escapes, len(ids)), words, ids


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 60000), st.integers(0, 2**64 - 1)), max_size=300))
def test_round_trip(ids):
    got, _, want = back(ids)
    assert np.array_equal(got, want)


@pytest.mark.parametrize("n", [1, 59, 60, 61, 1023, 1024, 1025, 5000])
@pytest.mark.parametrize("bits", [1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 64])
def test_each_width(n, bits):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, 2**bits, n, dtype=np.uint64)
    got, words, want = back(ids)
    assert np.array_equal(got, want)
    if bits <= 60:
        per = max(c for c, b in zip(tf.COUNTS[1:], tf.BITS[1:]) if b >= bits)
        assert len(words) <= n // per + 1 + n // tf.BLOCK


ODD = ["", None, "Hello  World", "don't I'LL", "ΣΑΣ ΟΔΟΣ.", "a\x1cb c\x85d \xa0e ​f", "<|endoftext|> x<|startoftext|>y", "Ǆ é é", "x" * 3000, "12 ٣٤ ½", "İstanbul ﬁ", " lead., x.. ,y .,", "\x0b\x0ca\x0bb"]


def test_against_library(spark, sf):
    tok = Tokenizer.from_file(PATH)
    rows = [(i * 7 % 13, t, "s") for i, t in enumerate(ODD)]
    rows += [(r.doc_id + 100, r.text, "s") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows += [(105, "again", "s"), (None, "no id", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string").repartition(5)
    hashed = {r.text: r.h for r in df.selectExpr("text", "xxhash64(coalesce(text, '')) AS h").collect()}
    got = sorted(tf.read_tokens(tf.write_tokens(df, PATH, 1)).collect(), key=lambda r: r.start)
    at = 0
    order = sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], hashed[r[1]]))
    assert len(got) == len(order)
    for (i, text, _), r in zip(order, got, strict=True):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (i, at, len(ids), ids)
        at += len(ids)


def test_query(spark, sf):
    tok = Tokenizer.from_file(PATH)
    at = 0
    got = {r.doc_id: r for r in tf.op3_token_files(spark, sf).collect()}
    for r in sorted(spark.read.parquet(f"{sf}/documents.parquet").collect()):
        ids = np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_small_segments_and_cache(spark, monkeypatch):
    coder = tf.WordCoder(open(PATH, encoding="utf-8").read())
    monkeypatch.setattr(tf, "KNOWN", 3)
    texts = [t or "" for t in ODD]
    tok = Tokenizer.from_file(PATH)
    for _ in range(2):
        ids, n = coder.encode(texts)
        for t, got in zip(texts, np.split(ids, np.cumsum(n)[:-1]), strict=True):
            assert got.tolist() == tok.encode(t, add_special_tokens=False).ids


def test_other_vocabularies():
    """One that looks across white space goes to the library whole."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    coder, tok = tf.WordCoder(open(path, encoding="utf-8").read()), Tokenizer.from_file(path)
    assert not coder.by_words and tf.WordCoder(open(PATH, encoding="utf-8").read()).by_words
    texts = [t or "" for t in ODD]
    ids, n = coder.encode(texts)
    for t, got in zip(texts, np.split(ids, np.cumsum(n)[:-1]), strict=True):
        assert got.tolist() == tok.encode(t, add_special_tokens=False).ids


def test_one_id_is_dealt_to_many_tasks(spark):
    df = spark.range(0, 4000, 1, 8).selectExpr("cast(NULL AS long) AS doc_id", "concat('word ', id) AS text").union(spark.range(0, 4000, 1, 8).selectExpr("7L", "'the same row'"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        made = tf.write_tokens(df, PATH, 1)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    shards = made.selectExpr("shard", "explode(doc_ids) AS d").groupBy("d").agg({"shard": "approx_count_distinct"}).collect()
    assert len(shards) == 2 and all(r[1] > 1 for r in shards)
    got = tf.read_tokens(made).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None] * 4000 + [7] * 4000
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()


def test_empty(spark):
    assert tf.read_tokens(tf.write_tokens(spark.createDataFrame([], "doc_id long, text string"), PATH, 1), digest=True).count() == 0
