"""Mixing against a plain version and its promises."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest

from granary.llm import mixing


def level_targets(sizes):
    """Targets by sharing the excess again until none is above."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, held = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in held]
        rest = total - sum(held.values())
        share = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return held | share
        held |= {s: 3 * sizes[s] for s in over}


def check(rows, got):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += size(t)
    want = level_targets(dict(sizes))
    assert len(got) == len(rows)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]], rel=1e-9)
        assert r["taken"] == r["size"] * r["copies"] and 0 <= r["copies"] <= 3
        whole = min(3, int(r["target"] // r["source_size"])) if r["source_size"] else 0
        assert r["size"] == 0 or whole <= r["copies"] <= whole + 1
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(1, largest[s] / 2 + 1)
    return taken, want


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = [r.asDict() for r in mixing.mix(docs).collect()]
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    taken, want = check(rows, out)
    assert max(abs(taken[s] / want[s] - 1) for s in want) < 0.01
    again = {r.doc_id: r.taken for r in mixing.mix(docs.repartition(9)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in out}


def test_ranking_is_pareto(spark):
    """Chosen documents are the beginning of the order by Q that fits, and a few more at most."""
    rng = np.random.default_rng(1)
    rows = [(i, "w " * int(n), "abc"[i % 3]) for i, n in enumerate(rng.integers(1, 400, 600))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = [r.asDict() for r in mixing.mix(df, weights=(5, 2, 1)).collect()]
    for s in "abc":
        part = [r for r in out if r["source"] == s]
        whole = min(3, int(part[0]["target"] // part[0]["source_size"]))
        missing = part[0]["target"] - whole * part[0]["source_size"]
        sq = sum(r["size"] ** 2 for r in part)

        def q(r):
            text = hashlib.md5(("w " * r["size"]).encode()).hexdigest()
            u = (int(hashlib.md5(f"{r['doc_id']}:{text}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
            p = min(1, missing * r["size"] / sq)
            return 0 if p >= 1 else (u / (1 - u)) / (p / (1 - p)) if p else np.inf

        order = sorted(part, key=q)
        got = [r["copies"] > whole for r in order]
        fits = (np.cumsum([r["size"] for r in order]) <= missing).sum() if missing else 0
        assert all(got[:fits]) and sum(got[fits:]) <= mixing.MORE


def test_edge_cases(spark):
    schema = "doc_id long, text string, source string, size int, target string, whole int, s string"
    rows = [(1, None, "a"), (1, "", None), (None, "one two", None), (2, "x y z", "z"), (2, "x y z", "z"), (2, "x y z", "z"), (3, "long " * 3000, "b"), (4, "a", "b"), (5, "é ü", ""), (None, "one two", None)]
    df = spark.createDataFrame([(*r, 1, "t", 2, "q") for r in rows], schema)
    out = [r.asDict() for r in mixing.mix(df).collect()]
    check(rows, out)
    assert {"whole", "s"} <= set(out[0])
    assert mixing.mix(df.limit(0)).count() == 0
    empty = [r.asDict() for r in mixing.mix(df.where("text IS NULL")).collect()]
    assert [(r["size"], r["taken"], r["target"]) for r in empty] == [(0, 0, 0.0)]


@pytest.mark.parametrize("ids", [None, 7])
def test_equal_rows_are_taken_in_part(spark, ids):
    """A thousand rows of one id, source and size: the mix takes as many as its target needs, whether their texts differ or not."""
    for text in (lambda i: "w " * 40, lambda i: f"v{i} " + "w " * 39):
        rows = [(ids, text(i), "a", i % 3) for i in range(1000)] + [(10_000 + i, "x " * 50, "b", 0) for i in range(300)] + [(20_000 + i, "y " * 60, "c", 0) for i in range(900)]
        df = spark.createDataFrame(rows, "doc_id long, text string, source string, other int").repartition(5)
        out = [r.asDict() for r in mixing.mix(df, weights=(1, 2, 5)).collect()]
        of = {s: sum(r["taken"] for r in out if r["source"] == s) for s in "abc"}
        want = {r["source"]: r["target"] for r in out}
        assert 0 < want["a"] < 40_000 and all(abs(of[s] - want[s]) <= 30 for s in "abc")
        again = mixing.mix(df.repartition(3), weights=(1, 2, 5)).groupBy("source").sum("taken").collect()
        assert {r[0]: r[1] for r in again} == of


def test_equal_rows_against_sql(spark, tmp_path):
    import duckdb

    rows = [(None, "w " * (3 + i % 2), "a") for i in range(400)] + [(i % 5, "x y z", "b") for i in range(200)] + [(9, f"q{i % 7} r", None) for i in range(300)] + [(i, None, "a") for i in range(3)] + [(i, "only words here", "c") for i in range(40)]
    path = str(tmp_path / "t")
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4).write.parquet(f"{path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    want = con.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.SQL['op8_mixing']})").fetchall()
    got = mixing.op8_mixing(spark, path).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))
    assert len({r[4] for r in want if r[0] is None}) > 1


def test_few_tables_between(spark, monkeypatch):
    """Each table between costs the driver a plan, stages and broadcasts; with one or two for each filling document it ran out of memory."""
    made, stored = [], mixing.stored
    monkeypatch.setattr(mixing, "stored", lambda df, name: made.append(name) or stored(df, name))
    mixing.mix(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).count()
    assert len(made) <= 7
