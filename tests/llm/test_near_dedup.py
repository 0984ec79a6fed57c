"""Near-duplicates against brute force over all pairs."""

import numpy as np
import pyarrow as pa
import pytest

from granary.llm import near_dedup, shared
from granary.llm.near_dedup import BINS, near_duplicates, sketch
from granary.llm.textkit import mix64


def brute(rows, k, num, den):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = {b" ".join(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            c = len(sets[a] & sets[b])
            if c and den * c >= num * (len(sets[a]) + len(sets[b]) - c):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def rows_of(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def base(rng, n):
    return [f"w{x}" for x in rng.integers(0, 5000, n)]


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(5)
    rows = []
    for g in range(12):
        w = base(rng, int(rng.integers(30, 300)))
        rows.append(" ".join(w))
        for _ in range(int(rng.integers(1, 9))):
            v = list(w)
            for p in rng.integers(0, len(v), int(rng.integers(0, max(1, len(v) // 30)))):
                v[p] = "changed"
            rows.append(" ".join(v).upper() if g % 2 else "\n".join(v))
    chain = base(rng, 200)  # each links the next, the ends don't link
    for s in range(0, 60, 6):
        rows.append(" ".join(chain[s : s + 120]))
    rows += [None, "", " \t ", "one", "ONE", "one two", "Élan é", "élan é", rows[0], rows[0]]
    return [(int(i), x) for i, x in zip(rng.permutation(len(rows)), rows, strict=True)]


@pytest.mark.parametrize(("num", "den"), [(80, 100), (85, 100)])
def test_against_brute_force(spark, corpus, num, den):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in corpus], "doc_id long, text string, rep string, comp int")
    assert rows_of(near_duplicates(df, 5, num, den)) == brute(corpus, 5, num, den)


def test_small_blocks_and_hot_keys(spark, corpus, monkeypatch):
    """Buckets of many blocks, hubs and star centres dealt to many tasks."""
    monkeypatch.setattr(near_dedup, "BLOCK", 2)
    monkeypatch.setattr(near_dedup, "SHINGLES", 40)
    monkeypatch.setattr(shared, "HOT_ROWS", 2)
    df = spark.createDataFrame(corpus, "doc_id long, text string")
    assert rows_of(near_duplicates(df, 5, 80, 100)) == brute(corpus, 5, 80, 100)


def test_mixed_bucket_pairs():
    """Every pair of different components in a block of members and one of probes, in its first shared bucket."""
    rng = np.random.default_rng(3)
    sets = [mix64(rng.integers(0, 2**63, 300, dtype=np.uint64)) for _ in range(3)]
    sets += [np.unique(np.concatenate([s[:280], mix64(rng.integers(0, 2**63, 20, dtype=np.uint64))])) for s in sets for _ in range(4)]
    sk = [sketch(s) for s in sets]
    key = int(near_dedup.band_keys(sk[0])[0])
    bands = np.array([near_dedup.band_keys(x) for x in sk])
    bands[:, 0] = key  # as if all had met in one bucket
    rows = [{"key": key, "i": 0, "j": 0, "kind": p, "cls": c, "comp": c, "n": len(sets[c]), "sk": (sk[c] & np.uint64(255)).astype(np.uint8).tobytes(), "bands": bands[c].tolist()} for c in range(len(sets)) for p in (near_dedup.OTHER, near_dedup.PROBE)]
    (unit,) = near_dedup._cross(0.72, 0.8)(pa.Table.from_pylist(rows).to_batches())
    got = list(zip(unit.column("a")[0].as_py(), unit.column("b")[0].as_py(), strict=True))
    assert len(got) == len(set(got))
    got = set(got)
    assert got == {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if (sk[a] == sk[b]).mean() > 0.72}
    assert {(0, c) for c in range(3, 7)} <= got


def test_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert rows_of(near_duplicates(docs, 5, 85, 100)) == brute(rows, 5, 85, 100)


def test_empty_and_null(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = near_duplicates(spark.createDataFrame([(None, "a b c"), (4, "a b c"), (4, "a b c"), (9, "a b c")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in got) == [(-1, -1, True), (4, 4, True), (4, 4, True), (9, 4, False)]


def test_different_sets_under_one_id(spark):
    rng = np.random.default_rng(11)
    a, b, c = (" ".join(base(rng, 120)) for _ in range(3))
    rows = [(1, a), (1, b), (1, c), (5, a + " more"), (6, b + " more"), (7, c + " more"), (7, "quite another text"), (8, c), (8, "and one more")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80, 100).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(1, 1, True)] * 3 + [(5, 1, False), (6, 1, False), (7, 1, False), (7, 7, True), (8, 1, False), (8, 8, True)]


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    x = mix64(rng.integers(0, 2**63, 900, dtype=np.uint64))
    for n, share in ((900, 0.5), (900, 0.8), (40, 0.5)):
        errors = []
        for _ in range(20):
            s = rng.permutation(x)[:n]
            c = int(n * 2 * share / (1 + share))
            other = np.concatenate([s[:c], mix64(rng.integers(0, 2**63, n - c, dtype=np.uint64))])
            errors.append((sketch(s) == sketch(other)).mean() - c / (2 * n - c))
        assert abs(np.mean(errors)) < 0.03
    assert len(set(sketch(x[:1]).tolist())) == BINS
