"""The kept word index against the search that reads all texts."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from granary.operators import retrieval as r
from granary.operators import text_index
from granary.operators.store import shared_folder
from granary.operators.text_index import TextIndex

TEXT = "id long, text string"


def rows_of(n, seed, base=0):
    rng = np.random.default_rng(seed)
    weight = 1 / np.arange(1, 61)
    words = np.array([f"w{i}" for i in range(60)])
    return [(base + i, " ".join(rng.choice(words, rng.integers(1, 60), p=weight / weight.sum()))) for i in range(n)]


def same(index, docs, queries, k):
    cols = ["query_id", "rank", "id", "score"]
    want = r.bm25_topk(docs, queries, k, "id", "text", "q", "text").select(*cols).collect()
    got = index.topk(queries, k, "q", "text").select(*cols).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    return got


def test_search_replace_delete(spark, monkeypatch):
    monkeypatch.setattr(text_index, "BLOCK", 8)
    monkeypatch.setattr(text_index, "HOT", 100)  # frequent terms are dealt to shards
    rows = rows_of(400, 1) + [(1000, ""), (1001, None), (None, "w1 w2"), (1002, "w59 " * 30)]
    docs = spark.createDataFrame(rows, TEXT)
    queries = spark.createDataFrame([(i, t) for i, t in enumerate(["w0", "w59 w0", "w1 w2 w3", "nothing here", "", "w40 w41 w40", "W5, w6!"])], "q long, text string")
    index = TextIndex(spark, shared_folder(spark, "index"), buckets=8).build(docs, "id", "text")
    living = docs.where("id IS NOT NULL")
    assert same(index, living, queries, 5)
    changed = spark.createDataFrame(rows_of(50, 2, base=20) + rows_of(30, 3, base=5000) + [(1002, "w1")], TEXT)
    index.replace(changed, "id", "text")
    living = living.join(changed.select("id"), "id", "left_anti").union(changed)
    same(index, living, queries, 5)
    index.delete(spark.createDataFrame([(i,) for i in range(0, 5010, 3)], "id long"), "id")
    living = living.where("id % 3 != 0 OR id >= 5010")
    same(index, living, queries, 7)
    index.replace(changed.where("id < 40"), "id", "text")  # some of them again, some deleted ones back
    living = living.where("id >= 40 OR id < 20").union(changed.where("id < 40"))
    same(index, living, queries, 5)
    assert len(index.generations()) == 4


def test_few_buckets_and_blocks_are_read(spark, monkeypatch):
    monkeypatch.setattr(text_index, "BLOCK", 8)
    docs = spark.createDataFrame(rows_of(3000, 4), TEXT)
    index = TextIndex(spark, shared_folder(spark, "index"), buckets=16).build(docs, "id", "text")
    one = spark.createDataFrame([(1, "w7")], "q long, text string")
    files = lambda df: {x[0] for x in df.select(F.input_file_name()).distinct().collect()}
    read = files(index.postings_of(spark.createDataFrame([("w7",)], "term string"), index.generations()))
    assert len(read) == 1 < len(files(index.table("postings", index.generations())))
    read, of = index.read_share(one, 5, "q", "text")
    assert 5 * read < of
    same(index, docs, one, 5)
    read, of = index.read_share(spark.createDataFrame([(1, "w0 w58")], "q long, text string"), 5, "q", "text")
    assert read < of


def test_failed_change_is_not_read(spark, monkeypatch):
    docs = spark.createDataFrame(rows_of(60, 5), TEXT)
    index = TextIndex(spark, shared_folder(spark, "index"), buckets=4).build(docs, "id", "text")
    queries = spark.createDataFrame([(1, "w0 w3")], "q long, text string")
    real = index.spark.createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        index.delete(docs.where("id < 30").select("id"), "id")
    monkeypatch.undo()
    assert real and index.generations() == [0]
    same(index, docs, queries, 4)
    index.delete(docs.where("id >= 50").select("id"), "id")
    same(index, docs.where("id < 50"), queries, 4)
    with pytest.raises(ValueError):
        index.build(docs, "id", "text")


def test_empty(spark):
    none = spark.createDataFrame([], TEXT)
    index = TextIndex(spark, shared_folder(spark, "index")).build(none, "id", "text")
    assert index.topk(spark.createDataFrame([(1, "w0")], "q long, text string"), 3, "q", "text").count() == 0


def test_units_send_the_best_only(spark, monkeypatch):
    """A unit adds its weights up and sends k rows a query on, ties to the smaller id; before, each pair of a query and a document's term was a row."""
    monkeypatch.setattr(text_index, "PAIRS", 300)  # many steps within a unit
    rng = np.random.default_rng(6)
    asked = sorted({(int(q), int(c)) for q, c in zip(rng.integers(0, 9, 60), rng.integers(0, 30, 60), strict=True)})
    weight = {(int(d), int(c)): float(rng.integers(1, 4)) for d, c in zip(rng.integers(0, 400, 3000), rng.integers(0, 40, 3000), strict=True)}
    entries = [(d * 7, c, w) for (d, c), w in weight.items()]
    rng.shuffle(entries)

    def batch(what, rows):
        ids, codes, w = zip(*rows, strict=True)
        return pa.RecordBatch.from_pydict({"unit": pa.array([3] * len(rows), pa.int32()), "what": pa.array([what] * len(rows), pa.int32()), "id": pa.array([int(i) for i in ids], pa.int64()), "code": pa.array([int(c) for c in codes], pa.int64()), "w": pa.array([float(x) for x in w])})

    batches = [batch(0, [(q, c, 0.0) for q, c in asked]), *(batch(1, entries[i : i + 500]) for i in range(0, len(entries), 500))]
    got = [tuple(r.values()) for b in text_index._added_up(5, 6)(iter(batches)) for r in b.to_pylist()]
    want = []
    for q in {q for q, _ in asked}:
        mine, sums = [c for x, c in asked if x == q], {}
        for d, c, w in entries:
            if c in mine:
                sums[int(d)] = sums.get(int(d), 0.0) + w
        want += [(q, d, sums[d]) for d in sorted(sums, key=lambda d: (-sums[d], d))[:5]]
    assert sorted(got) == sorted(want)
    monkeypatch.setattr(text_index, "UNIT", 256)
    monkeypatch.setattr(text_index, "AT_ONCE", 2)  # several units of queries and of documents
    docs = spark.createDataFrame(rows_of(300, 8), TEXT)
    index = TextIndex(spark, shared_folder(spark, "index"), buckets=4).build(docs, "id", "text")
    same(index, docs, spark.createDataFrame([(i, f"w{i} w{i + 3} w0") for i in range(7)], "q long, text string"), 6)


def test_repeated_ids(spark):
    rows = rows_of(40, 9) + [(3, "w1 w2 w2"), (3, "w5"), (7, None), (7, "w9 w9")]
    docs = spark.createDataFrame(rows, TEXT)
    index = TextIndex(spark, shared_folder(spark, "index"), buckets=4).build(docs, "id", "text")
    one = docs.groupBy("id").agg(F.max("text").alias("text"))
    same(index, one, spark.createDataFrame([(1, "w2 w5"), (2, "w9 w0")], "q long, text string"), 9)
