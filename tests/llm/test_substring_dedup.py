"""Repeated windows against brute force."""

import collections
import zlib

import numpy as np
import pytest

from granary.llm import substring_dedup as sd


def brute(texts, window):
    ws = [(t or "").encode().split() for t in texts]
    count = collections.Counter(tuple(w[i : i + window]) for w in ws for i in range(len(w) - window + 1))
    out = []
    for w in ws:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return out


def texts():
    rng = np.random.default_rng(3)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 3000, n)]
    shared = [word(n) for n in (34, 35, 36, 60, 200)]
    out = []
    for i in range(60):
        w = word(int(rng.integers(0, 200)))
        if i % 2:
            w += shared[i % 5]
        w += word(int(rng.integers(0, 80)))
        out.append(" ".join(w))
    out += [out[3], out[3], out[8], None, "", "  \n", "Und " * 90, "a b " * 60, " ".join(word(35)), "é x " * 3]
    out.append("\t\n".join(word(3000) + shared[4] + word(3000)))
    return out


@pytest.mark.parametrize("window", [35, 20, 5])
def test_against_brute_force(spark, window):
    given = texts()
    df = spark.createDataFrame([(i, t, i * 2, "x") for i, t in enumerate(given)], "doc_id long, text string, c0 long, key string").repartition(3)
    got = {r.doc_id: r for r in sd.remove_repeats(df, window).collect()}
    want = brute(given, window)
    assert len(got) == len(given)
    for i, x in enumerate(want):
        assert (got[i].n_words, got[i].n_removed, got[i].kept_text) == x, i
        assert got[i].c0 == 2 * i and got[i].key == "x"


@pytest.mark.parametrize("hot", [200, 2, 20])
def test_small_flush_and_crowded_sketch(monkeypatch, hot):
    monkeypatch.setattr(sd, "FLUSH", 50)
    monkeypatch.setattr(sd, "CELLS", 64)
    monkeypatch.setattr(sd, "SLICE", 16)
    monkeypatch.setattr(sd, "HOT", hot)
    assert sd._often.__globals__["CELLS"] == 64
    # in one process: a sketch with far too few cells must lose nothing
    import pyarrow as pa

    given = texts()
    parts = list(sd._sketch(35, 16)(iter([pa.RecordBatch.from_pydict({"text": pa.array(given, pa.string())})])))
    parts = sorted(parts, key=lambda b: b.column(0)[0].as_py())
    bits = np.zeros((2, sd.DEPTH * sd.CELLS // 8), np.uint8)
    for b in sd._merge(iter(parts)):
        p = b.column(0)[0].as_py()
        for row in (0, 1):
            bits[row, p * 2 : p * 2 + 2] = np.frombuffer(b.column(1 + row)[0].as_py(), np.uint8)

    class Held:
        value = bits

    docs = pa.RecordBatch.from_pydict({"key": list(range(len(given))), "crc": pa.array([0] * len(given), pa.int64()), "text": pa.array(given, pa.string())})
    sent = pa.Table.from_batches(list(sd._candidates(Held, 35, 16)(iter([docs])))).sort_by("anchor")
    marks = collections.defaultdict(set)
    for b in sd._repeated(iter(sent.to_batches(max_chunksize=7))):
        for r in b.to_pylist():
            for s in range(r["start"], r["start"] + r["len"]):
                marks[r["key"]].update(range(s, s + 35))
    assert [len(marks[i]) for i in range(len(given))] == [x[1] for x in brute(given, 35)]


def test_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    want = {r.doc_id: x for r, x in zip(rows, brute([r.text for r in rows], 35), strict=True)}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in sd.remove_repeats(docs).collect()}
    assert got == want


def test_empty_null_and_repeated_rows(spark):
    assert sd.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    w = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(1, w), (1, w), (None, w + " tail"), (2, "other " + w), (2, None)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_words, r.n_removed, r.kept_text) for r in sd.remove_repeats(df).collect())
    assert got == [(-1, 41, 40, "tail"), (1, 40, 40, ""), (1, 40, 40, ""), (2, 0, 0, ""), (2, 41, 40, "other")]


def test_texts_of_one_id_with_equal_crc(spark):
    # "plumless" and "buckeroo" have the same CRC-32, so have texts that go on equally behind them
    tail = " ".join(f"t{i}" for i in range(50))
    head = [f"{w} " + " ".join(f"h{i}" for i in range(20)) for w in ("plumless", "buckeroo")]
    given = [f"{h} {tail}" for h in head] + [tail]
    assert zlib.crc32(given[0].encode()) == zlib.crc32(given[1].encode())
    for i in (None, 1):
        df = spark.createDataFrame([(i, n, t) for n, t in enumerate(given)], "doc_id long, n int, text string").repartition(2)
        got = {r.n: (r.n_words, r.n_removed, r.kept_text) for r in sd.remove_repeats(df).collect()}
        assert got == dict(enumerate(brute(given, 35)))


def test_null_ids_and_repeated_rows(spark):
    """Texts under one id with the same checksum keep apart, and a row that repeats is cut in all its copies."""
    import itertools


    seen, pair = {}, None
    for n in itertools.count():
        c = zlib.crc32(t := f"text number {n} of many, told apart by nothing but its number {n * n}".encode())
        if c in seen:
            pair = [seen[c].decode(), t.decode()]
            break
        seen[c] = t
    long = " ".join(f"w{i}" for i in range(40))
    many = spark.range(0, 20_000, 1, 8).selectExpr("5L AS doc_id", f"'{long} tail' AS text")
    df = many.union(spark.createDataFrame([(None, pair[0]), (None, pair[1]), (None, None)], "doc_id long, text string"))
    got = sd.remove_repeats(df).groupBy("doc_id", "kept_text", "n_words", "n_removed").count().collect()
    want = {(None, pair[0], len(pair[0].split()), 0, 1), (None, pair[1], len(pair[1].split()), 0, 1), (None, "", 0, 0, 1), (5, "", 41, 41, 20_000)}
    assert {tuple(r) for r in got} == want
