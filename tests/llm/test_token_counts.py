"""Counts against a plain forward pass for each word."""

import functools

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from granary.llm import token_counts as tc


def plain(word, scores):
    @functools.cache
    def best(end):
        if end == 0:
            return (0.0, 0)
        width = len(word[end - 1].encode())
        s, c = best(end - 1)
        found = [(s + tc._BYTE * width, c + width)]
        for start in range(end):
            if word[start:end] in scores:
                s, c = best(start)
                found.append((s + scores[word[start:end]], c + 1))
        return max(found, key=lambda f: (f[0], -f[1]))

    return best(len(word))[1]


PIECES = [tc.SPACE, "a", "b", tc.SPACE + "a", "ab", "ba", "aba", tc.SPACE + "ab", "é", "bb"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abéx漢", min_size=1, max_size=12), max_size=12))
def test_against_plain(words):
    scores = tc.rank_scores(PIECES)
    words = [tc.SPACE + w for w in words]
    assert tc.Trie(scores).lookup(words).tolist() == [plain(w, scores) for w in words]


def test_prefixes_are_computed_once():
    t = tc.Trie(tc.rank_scores(PIECES))
    t.lookup(["abab", "ababa", "ababb", "abab", "b"])
    made = len(t.best) - 1
    assert made == 4 + 1 + 1 + 1
    t.lookup(["ababab", "ba"])  # later words start from the nodes that are there
    assert len(t.best) - 1 == made + 1 + 1


@pytest.fixture(scope="module")
def pieces():
    return tc.load_pieces(public_tokenizers.path("piece_bpe_32k.model"))


def test_table(spark, sf, pieces):
    scores = tc.rank_scores(pieces)
    count = functools.cache(lambda w: plain(w, scores))
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in tc.op7_token_counts(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect():
        words = tc.pre_tokens(r.text or "")
        assert got[r.doc_id] == (len(words), sum(map(count, words)))


def test_edge_cases(spark, pieces, monkeypatch):
    monkeypatch.setattr(tc, "NODES", 2)
    df = spark.createDataFrame([(1, None, 3), (1, "", 3), (2, " \t\n", 3), (None, "x" * 3000, 3), (5, "a b a", 3), (5, "a b a", 3)], "doc_id long, text string, n_words int")
    got = sorted((r.doc_id or -1, r.n_words) for r in tc.count_tokens(df, pieces).collect())
    assert got == [(-1, 1), (1, 0), (1, 0), (2, 0), (5, 3), (5, 3)]
    assert tc.count_tokens(df.limit(0), pieces).count() == 0
