"""Search against brute force."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from granary.llm import ann


def brute(ids, x, queries, k):
    x = np.asarray(x, np.float64)
    out = {}
    for q in queries:
        at = int(np.flatnonzero(ids == q)[0])
        s = (x * x[at]).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((x[at] ** 2).sum()))
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), s[i]) for i in order]
    return out


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_recall(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    want = brute(ids, x, ids[ids % 50 == 0], 5)
    got = {}
    for r in sorted(ann.op9_ann(spark, sf).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    at = {i: n for n, i in enumerate(ids)}
    for q, found in got.items():
        for v, s in found:
            a, b = x[at[q]], x[at[v]]
            assert s == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b), abs=1e-12)
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))


def test_likeliest_first():
    h = ann.Hashes(8)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    v = h.visits(x)
    assert v.shape == (50, h.tables, h.probes) and np.array_equal(v[:, :, 0], h.buckets(x))
    assert all(len(set(v[i, t])) == h.probes for i in range(50) for t in range(h.tables))


def test_hot_bucket_and_few_candidates(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 50)
    rng = np.random.default_rng(2)
    x = np.concatenate([np.tile(rng.normal(size=6), (300, 1)), rng.normal(size=(100, 6))])
    ids = rng.permutation(400)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "id long, v array<double>")
    want = brute(ids, x, ids[ids % 20 == 0], 5)
    # with narrow slots and one probe no find is sure, so all queries are searched exactly
    for fine, coarse in ((ann.Setting(2, 7, 0.8, 32), ann.Setting(2, 7, 1.6, 32)), (ann.Setting(2, 7, 0.05, 1), ann.Setting(1, 7, 0.05, 1))):
        got = {}
        for r in ann.nearest(df, df.where("id % 20 = 0"), 5, fine, coarse).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
        assert all(len(v) == 5 for v in got.values())
        hot = set(ids[:300].tolist())
        for q in want:
            if q in hot or fine.probes == 1:
                assert [v for _, v in sorted(got[q])] == [v for v, _ in want[q]]
        hits = sum(len({v for _, v in got[q]} & {v for v, _ in want[q]}) for q in want)
        assert hits >= 0.9 * 5 * len(want)


def test_few_rows_are_visited_where_neighbours_are_near():
    """50,000 vectors in clusters: the fine hashing visits under a fifth of the rows and finds over nine tenths."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1000, 64))[rng.integers(0, 1000, 50_000)] + 0.5 * rng.normal(size=(50_000, 64))
    u, q = ann._unit(x), np.arange(0, 50_000, 500)
    s = u[q] @ u.T
    s[np.arange(len(q)), q] = -9
    best = np.argsort(-s, axis=1)[:, :5]
    h = ann.Hashes(64, ann.FINE)
    keys, visits = h.buckets(u), h.visits(u[q])
    seen = np.array([np.any([np.isin(keys[:, t], visits[i, t]) for t in range(h.tables)], axis=0) for i in range(len(q))])
    assert seen.mean() < 0.2
    assert np.take_along_axis(seen, best, 1).mean() > 0.9
    assert np.take_along_axis(s, best, 1)[:, 4].mean() > h.least_cosine(ann.SURE)  # so these queries are done


def test_chance_of_success():
    """The simulated chance against what hashing pairs at that distance gives."""
    rng = np.random.default_rng(4)
    for setting, cosine in ((ann.FINE, 0.75), (ann.COARSE, 0.35)):
        h = ann.Hashes(64, setting)
        a = ann._unit(rng.normal(size=(300, 64)))
        b = rng.normal(size=(300, 64))
        b = ann._unit(b - (a * b).sum(1)[:, None] * a)
        b = cosine * a + np.sqrt(1 - cosine**2) * b
        met = (h.visits(a) == h.buckets(b)[:, :, None]).any((1, 2)).mean()
        at, chance = h.success()
        assert met == pytest.approx(np.interp(np.sqrt(2 - 2 * cosine), at, chance), abs=0.06)


def test_large_and_tiny_components(spark):
    rows = [(0, [1e200, 0.0]), (50, [1e200, 5e199]), (1, [3e-310, 3e-310]), (2, [1e-200, 0.0])]
    v = ann.vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {(r.query_id, r.vec_id): r.score for r in ann.nearest(v, v.where("id % 50 = 0")).collect()}
    assert got[0, 50] == pytest.approx(2 / 5**0.5) and got[0, 1] == pytest.approx(0.5**0.5) and got[0, 2] == 1.0
    assert got[50, 1] == pytest.approx(3 / 10**0.5)


def test_bad_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], "a"), (50, [1.0, 1.0], "b"), (1, [0.0, 0.0], "c"), (100, [nan, 1.0], "d"), (150, [inf, 1.0], "e"), (200, None, "f"), (250, [None, 1.0], "g"), (300, [], "h"), (None, [1.0, 1.0], "i"), (350, [1.0, 1.0, 1.0], "j"), (7, [0.9, 0.1], "k"), (7, [0.9, 0.1], "k")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, probe string")
    v = ann.vectors(df)
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in ann.nearest(v, v.where("id % 50 = 0")).collect())
    assert got == [(0, 1, 7), (0, 2, 50), (50, 1, 7), (50, 2, 0)]
    assert ann.nearest(v.limit(0), v).count() == 0
    assert ann.nearest(v, v.limit(0)).count() == 0


@pytest.mark.parametrize("centres", [0, 500])
def test_recall_of_the_query_at_fifty_thousand(spark, tmp_path, centres):
    """The whole query, through all its settings, on vectors that lie evenly and on clusters."""
    rng = np.random.default_rng(11)
    n, dim = 50_000, 64
    x = rng.normal(size=(n, dim)).astype(np.float32)
    if centres:
        x = rng.normal(size=(centres, dim)).astype(np.float32)[rng.integers(0, centres, n)] + np.float32(0.35) * x
    table = pa.table({"vec_id": pa.array(range(n), pa.int64()), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), dim).cast(pa.list_(pa.float32()))})
    (tmp_path / "embeddings.parquet").mkdir()
    for i in range(4):
        pq.write_table(table.slice(i * n // 4, n // 4), f"{tmp_path}/embeddings.parquet/part-{i}.parquet")
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    s = u[::50] @ u.T
    s[np.arange(0, n // 50), np.arange(0, n, 50)] = -2
    want = np.argpartition(-s, 5, axis=1)[:, :5]
    got: dict = {}
    for r in ann.op9_ann(spark, str(tmp_path)).select("query_id", "vec_id").collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert len(got) == n // 50 and all(len(v) == 5 for v in got.values())
    hits = sum(len(got[50 * i] & set(map(int, w))) for i, w in enumerate(want))
    assert hits >= 0.9 * 5 * len(want), hits / 5 / len(want)


def test_few_pairs_are_compared_exactly(monkeypatch):
    """Of a bucket that all queries visit, only pairs that may be among the best are scored in double precision; before, all of them were in each query's first bucket of a unit."""
    rng = np.random.default_rng(3)
    x, asked = rng.normal(size=(3000, 16)), rng.normal(size=(200, 16))
    ids = rng.permutation(3000) // 2 * 2  # every id twice, so a query's best rows may share one
    u = asked / np.linalg.norm(asked, axis=1)[:, None]
    s = u @ (x / np.linalg.norm(x, axis=1)[:, None]).T
    want = {}
    for i, row in enumerate(s):
        best = {}
        for v, c in zip(ids.tolist(), row.tolist(), strict=True):
            if v != 2 * i:
                best[v] = max(best.get(v, -2.0), c)
        want[2 * i] = sorted(best, key=lambda v: (-best[v], v))[:5]
    one = lambda n, kind: pa.array(np.zeros(n), kind)

    def batch(ask, ids, v, least):
        n = len(ids)
        return pa.RecordBatch.from_pydict({"tab": one(n, pa.int32()), "part": one(n, pa.int32()), "blk": one(n, pa.int32()), "ask": pa.array([ask] * n, pa.int32()), "id": pa.array(ids, pa.int64()), "v": pa.array(list(v)), "buckets": pa.array([[7]] * n, pa.list_(pa.int64())), "least": pa.array(least, pa.float64())})

    real, compared = ann._cosines, []
    monkeypatch.setattr(ann, "_cosines", lambda a, b: compared.append(len(a)) or real(a, b))
    asks = [2 * i for i in range(200)]
    for least, most in (([None] * 200, 200 * 3000 // 20), ([float(np.sort(r)[-40]) for r in s], 200 * 40)):
        compared.clear()
        slices = [batch(1 + h, asks[h * 100 : h * 100 + 100], asked[h * 100 : h * 100 + 100], least[h * 100 : h * 100 + 100]) for h in (0, 1)]
        found = {}
        for b in ann._search(16, 5)(iter([batch(0, ids, x, [None] * 3000), *slices])):
            for r in b.to_pylist():
                found.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
        assert {q: [v for _, v in sorted(f)[:5]] for q, f in found.items()} == want
        assert sum(compared) <= most
