"""Every stage against a brute-force version on its own input, and the whole."""

import collections

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp
from tests.llm.test_mixing import level_targets
from tests.llm.test_near_dedup import brute as near_brute
from tests.llm.test_substring_dedup import brute as cut_brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for name, f in cp.STAGES:
        f(spark, docs, SF).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
        out.append(docs.collect())
    return out


def test_order_and_columns(stages):
    assert [n for n, _ in cp.STAGES] == ["quality_classifier", "near_duplicates", "substring_dedup", "mixing", "bpe"]
    for rows in stages[1:-1]:
        assert rows and rows[0].__fields__ == cp.COLUMNS


def test_quality(spark, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in stages[1]}
    good = [i for i, q in labels.items() if q == 1]
    bad = [i for i, q in labels.items() if q == 0]
    assert sum(i in kept for i in good) >= 0.97 * len(good) and sum(i not in kept for i in bad) >= 0.7 * len(bad)
    assert {tuple(r) for r in stages[1]} <= {tuple(r) for r in stages[0]}


def test_near_duplicates(stages):
    want = near_brute([(r.doc_id, r.text) for r in stages[1]], 5, 80, 100)
    assert sorted(r.doc_id for r in stages[2]) == sorted(i for i, x in want.items() if x[2])
    assert {tuple(r) for r in stages[2]} <= {tuple(r) for r in stages[1]}


def test_substrings(stages):
    want = {r.doc_id: (r, x) for r, x in zip(stages[2], cut_brute([r.text for r in stages[2]], 35), strict=True)}
    assert len(stages[3]) == len(stages[2])
    for r in stages[3]:
        before, (_, removed, kept) = want[r.doc_id]
        assert r.text == (kept if removed else before.text) and r.n_chars == len(r.text)
        assert (r.lang, r.source) == (before.lang, before.source)


def test_mixing(stages):
    size = collections.Counter()
    taken = collections.Counter()
    for r in stages[3]:
        size[r.source] += len(r.text.split())
    for r in stages[4]:
        taken[r.source] += len(r.text.split())
    want = level_targets(dict(size))
    assert max(collections.Counter(r.doc_id for r in stages[4]).values()) <= 3
    assert {tuple(r) for r in stages[4]} <= {tuple(r) for r in stages[3]}
    largest = collections.defaultdict(int)
    for r in stages[3]:
        largest[r.source] = max(largest[r.source], len(r.text.split()))
    assert all(abs(taken[s] - want[s]) <= largest[s] / 2 + 1 for s in want)


def test_bpe(stages):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = collections.Counter((r.doc_id, tuple(tok.encode(r.text, add_special_tokens=False).ids)) for r in stages[4])
    assert collections.Counter((r.doc_id, tuple(r.ids)) for r in stages[5]) == want


def test_run(spark, stages):
    got = cp.run(spark, SF).collect()
    assert sorted((r.doc_id, r.ids) for r in got) == sorted((r.doc_id, r.ids) for r in stages[5])


def test_nulls_repeats_and_no_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    w = " ".join(f"word{i}" for i in range(80))
    rows = [(1, w, "en", "s", 1), (1, w, "en", "s", 1), (2, w + " more", None, None, None), (3, None, "en", "s", 0), (None, "no id", None, "t", 5), (4, "", "", "", 0), (5, "Plain words, and a stop.", "en", "t", 9)]
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, schema)
    for given in (docs, docs.limit(0)):
        now = given
        for i, (_, f) in enumerate(cp.STAGES):
            f(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{id(given)}-{i}")
            now = spark.read.parquet(f"{tmp_path}/{id(given)}-{i}")
            if i == 1 and given is docs:
                assert sorted((r.doc_id or 0) for r in now.collect()) == [0, 1, 3, 4, 5]
        got = {r.doc_id for r in now.collect()}
        assert got <= {None, 1, 2, 5} and (given is not docs) == (not got)


def test_documents_that_share_an_id(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(80)) for x in "ab")
    texts = [(1, a), (1, b), (1, b.upper()), (1, a + " near"), (2, a), (2, "quite another text"), (3, b + " near"), (4, None), (4, ""), (None, a), (None, a)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    for given in (docs, docs.orderBy(F.desc("text"))):
        got = [(r.doc_id, r.text) for r in cp.near_duplicates(spark, given, "").collect()]
        firsts = [t for i, t in got if i == 1]
        assert len(firsts) == 2 and firsts.count(a) + firsts.count(a + " near") == 1 and b.upper() in firsts
        assert sorted((i or 0, t or "") for i, t in got if i != 1) == [(0, a), (0, a), (2, "quite another text"), (4, "")]
