"""Exact vector search with odd vectors, in blocks of every size."""

import math
from fractions import Fraction

import numpy as np
import pytest

from granary.operators import retrieval as r

ODD = [(900, None), (901, [0.0] * 4), (902, [1.0, float("nan"), 0.0, 0.0]), (903, [1.0, None, 0.0, 0.0]), (904, [float("inf"), 0.0, 0.0, 0.0]), (905, [1.0, 2.0]), (906, []), (907, [1e200, 2e200, 0.0, 1e200]), (908, [1e-200, 0.0, 0.0, 1e-200]), (None, [1.0] * 4)]


def plain(rows, queries, k, wants=None):
    ok = lambda v: v and all(c is not None and math.isfinite(c) for c in v) and any(v)
    rows = [x for x in rows if x[0] is not None and ok(x[1])]
    exact = lambda a, b: sum(Fraction(x) * Fraction(y) for x, y in zip(a, b, strict=True))
    out = []
    for q in queries:
        if q[0] is None or not ok(q[1]):
            continue
        scored = []
        for x in rows:
            if x[0] == q[0] or len(x[1]) != len(q[1]) or (wants and wants(q) and not wants(q) & wants(x)):
                continue
            d = exact(q[1], x[1])
            c = math.sqrt(d * d / (exact(q[1], q[1]) * exact(x[1], x[1]))) * (-1 if d < 0 else 1)
            scored.append((-round(c, 6) + 0.0, x[0]))
        out += [(q[0], i + 1, x, -s + 0.0) for i, (s, x) in enumerate(sorted(scored)[:k])]
    return sorted(out)


@pytest.mark.parametrize("at_once, rows_at_once", [(4096, 100_000), (3, 7)])
def test_odd_vectors(spark, monkeypatch, at_once, rows_at_once):
    monkeypatch.setattr(r, "ROWS_AT_ONCE", rows_at_once)
    rng = np.random.default_rng(1)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(rng.integers(-9, 10, (60, 4)))] + ODD
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    got = sorted(tuple(x) for x in r.vector_topk_each(df, df.where("id % 3 = 0 OR id IS NULL"), 5, "id", "v", at_once=at_once).collect())
    assert got == plain(rows, [x for x in rows if x[0] is None or x[0] % 3 == 0], 5)
    for q in ([1.0, 2.0, 0.5, -3.0], [1e300, 1e300, 0.0, 0.0]):
        one = [(x["id"], x["score"]) for x in r.vector_topk(df.where("id IS NOT NULL"), q, 70, "id", "v").collect()]
        assert one == [(i, s) for _, _, i, s in plain(rows, [(-1, q)], 70)]
    assert r.vector_topk(df, [0.0] * 4, 5, "id", "v").count() == 0


def test_filtered_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(r, "ROWS_AT_ONCE", 10)
    rng = np.random.default_rng(2)
    rows = [(i, [float(c) for c in v], [f"l{i % 4}", f"m{i % 3}"]) for i, v in enumerate(rng.normal(size=(50, 6)))]
    df = spark.createDataFrame(rows, "id long, v array<double>, labels array<string>")
    asked = [(100 + i, v, None if i % 3 == 0 else [] if i % 3 == 1 else ["l1", "m2"]) for i, v, _ in rows[:9]]
    queries = spark.createDataFrame(asked, "id long, v array<double>, wanted array<string>")
    got = sorted(tuple(x) for x in r.vector_topk_each(df, queries, 4, "id", "v", label_col="labels", wanted_col="wanted", at_once=2).collect())
    assert got == plain(rows, asked, 4, wants=lambda x: set(x[2] or ()))


def test_empty(spark):
    df = spark.createDataFrame(ODD, "id long, v array<double>")
    assert r.vector_topk_each(df.limit(0), df, 3, "id", "v").count() == 0
    assert r.vector_topk_each(df, df.limit(0), 3, "id", "v").count() == 0
