"""The bucketed table against a dictionary: what is rewritten, what a repeated or failed batch does."""

import random

import pytest
from pyspark.sql import functions as F

from granary.operators.store import shared_folder
from granary.sources.buckets import BucketTable, upsert_step
from granary.streaming import queue as q

SCHEMA = "k long, at int, x string"


def rows_of(table, version=None):
    return sorted((tuple(r) for r in table.read(version).collect()), key=repr)


def test_against_dictionary(spark):
    rng = random.Random(1)
    table, held = BucketTable(spark, shared_folder(spark, "buckets"), SCHEMA, ["k"], ["at"], buckets=8), {}
    assert rows_of(table) == []
    versions = {}
    for number in range(5):
        rows = [(rng.choice([None, *range(30)]), rng.randrange(20), f"{number}-{i}", rng.random() < 0.15) for i in range(12)]
        rows = list({(k, at): (k, at, x, gone) for k, at, x, gone in rows}.values())
        assert table.upsert(spark.createDataFrame(rows, SCHEMA + ", gone boolean"), number) == number
        best = {}
        for r in rows:
            best[r[0]] = max(best.get(r[0], r), r, key=lambda y: y[1])
        for k, (_, at, x, gone) in best.items():
            if k not in held or at >= held[k][1]:
                held[k] = (k, at, x)
                if gone:
                    del held[k]
        versions[number] = sorted(held.values(), key=repr)
        assert rows_of(table) == versions[number]
        assert table.upsert(spark.createDataFrame([(1, 99, "again")], SCHEMA), number) == number  # a batch that comes again
    assert rows_of(table, 1) == versions[1]
    assert table.prune(2) > 0 and rows_of(table) == versions[4] and rows_of(table, 3) == versions[3]
    assert table.manifest(1) == (-1, -1, {})


def test_only_touched_buckets_are_written(spark):
    table = BucketTable(spark, shared_folder(spark, "buckets"), SCHEMA, ["k"], ["at"], buckets=16)
    table.upsert(spark.createDataFrame([(i, 0, "a") for i in range(500)], SCHEMA))
    files = lambda: {r[0] for r in table.read().select(F.input_file_name()).distinct().collect()}
    before = files()
    table.upsert(spark.createDataFrame([(7, 1, "b"), (7, 0, "c")], SCHEMA))
    after = files()
    assert len(before) == len(after) == 16 and len(before & after) == 15
    assert table.read().where("k = 7").first().x == "b" and table.read().count() == 500
    assert table.upsert(spark.createDataFrame([], SCHEMA)) == 1


def test_failed_upsert_shows_nothing(spark, monkeypatch):
    table = BucketTable(spark, shared_folder(spark, "buckets"), SCHEMA, ["k"], ["at"], buckets=4)
    table.upsert(spark.createDataFrame([(i, 0, "a") for i in range(20)], SCHEMA))
    before = rows_of(table)
    new = spark.createDataFrame([(i, 1, "b") for i in range(30)], SCHEMA)
    real = type(spark).createDataFrame
    lost = lambda self, data, schema=None, **kw: real(self, data, schema, **kw) if not data or len(data[0]) != 3 or "batch" not in str(schema) else (_ for _ in ()).throw(RuntimeError("lost"))
    monkeypatch.setattr(type(spark), "createDataFrame", lost)
    with pytest.raises(RuntimeError):
        table.upsert(new)
    monkeypatch.undo()
    assert rows_of(table) == before
    table.upsert(new)
    assert rows_of(table) == sorted(((i, 1, "b") for i in range(30)), key=repr)


def test_stream(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([(k, i, f"{i}") for k in range(i, 6)], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    table = BucketTable(spark, shared_folder(spark, "buckets"), SCHEMA, ["k"], ["at"], buckets=4)
    stream = q.event_stream(spark, f"{tmp_path}/in")
    q.each_batch(stream, upsert_step(table), f"{tmp_path}/c")
    want = [(k, min(k, 2), str(min(k, 2))) for k in range(6)]
    assert rows_of(table) == want
    q.each_batch(stream, upsert_step(table), f"{tmp_path}/c2")  # all batches again, from the start
    assert rows_of(table) == want and table.manifest()[0] == 2
