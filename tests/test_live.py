"""Indicator files with pushed filters, and live results with late, repeated and unordered events."""

import json
import random

from granary.operators import tables as tb
from granary.sources import buckets, indicators
from granary.streaming import queue as q


def test_indicator_files(spark, tmp_path):
    values = {"KEN.SP.POP": {"2020": 1.5, "2021": None, "2022": "", "2023": 4}, "KEN.X": {"1999": 7}, "UGA.SP.POP": {"2020": 2, "2022": " 3.5 "}, "UGA.X": {}}
    for name, v in values.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(v))
    (tmp_path / "notes.txt").write_text("no")
    indicators.register(spark)
    df = spark.read.format("indicators").load(str(tmp_path))
    assert df.schema.simpleString() == "struct<country_iso3:string,indicator:string,year:int,value:double>"
    every = [(n.split(".")[0], n.split(".", 1)[1], int(y), float(x)) for n, v in values.items() for y, x in v.items() if x is not None and str(x).strip()]
    got = lambda d: sorted(map(tuple, d.collect()))
    assert got(df) == sorted(every) and df.rdd.getNumPartitions() == 4
    some = df.where("country_iso3 = 'KEN'")
    assert some.rdd.getNumPartitions() == 2 and got(some) == sorted(r for r in every if r[0] == "KEN")
    both = df.where("country_iso3 IN ('KEN', 'TZA') AND indicator = 'SP.POP' AND year > 2020 AND year <= 2023")
    assert both.rdd.getNumPartitions() == 1 and got(both) == [("KEN", "SP.POP", 2023, 4.0)]
    assert df.where("year > 2021 AND year < 2021").rdd.getNumPartitions() <= 1 and got(df.where("year IN (1999, 2020)")) == sorted(r for r in every if r[2] in (1999, 2020))
    assert got(spark.read.format("indicators").load(f"file://{tmp_path}").where("value > 3")) == sorted(r for r in every if r[3] > 3)


def test_live_results(spark, tmp_path):
    rng = random.Random(4)
    events = [(f"d{rng.randrange(12)}", f"s{rng.randrange(3)}", i, rng.choice(["completed", "completed", "failed"])) for i in range(150)]
    events += rng.sample(events, 40)  # repeated
    rng.shuffle(events)  # late and unordered
    schema = "document_id string, step string, event_id long, status string"
    for at in range(0, len(events), 70):
        spark.createDataFrame(events[at : at + 70], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    spark.createDataFrame([("d1", None, 999, "failed")], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    held = buckets.BucketTable(spark, f"{tmp_path}/held", schema, ["document_id", "step"], ["event_id"], buckets=4)
    q.each_batch(q.live_latest(q.event_stream(spark, f"{tmp_path}/in"), ["document_id", "step"], "event_id"), buckets.upsert_step(held), f"{tmp_path}/c", "update")
    whole = spark.createDataFrame([*events, ("d1", None, 999, "failed")], schema)
    assert sorted(map(repr, held.read().collect())) == sorted(map(repr, tb.latest(whole, ["document_id", "step"], ["event_id"]).select(*whole.columns).collect()))
    done = lambda df: {r.document_id: r.done for r in tb.completed(df.where("step IS NOT NULL"), "document_id", "step", "event_id", 3).collect()}
    assert done(held.read()) == done(whole) and set(done(whole).values()) == {True, False}
