"""The kept vector index: exact with all candidates, recall and cells read with fewer."""

import numpy as np
from pyspark.sql import functions as F

from granary.operators import retrieval as r
from granary.operators import vector_index
from granary.operators.store import shared_folder
from granary.operators.vector_index import VectorIndex

SCHEMA = "id long, v array<double>, labels array<string>"


def clustered(n, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(30, 16))
    x = centres[rng.integers(0, 30, n)] + 0.3 * rng.normal(size=(n, 16))
    return [(i, [float(c) for c in v], [f"l{i % 3}"]) for i, v in enumerate(x)]


def rows_of(df):
    return sorted(map(tuple, df.select("query_id", "rank", "id", "score").collect()))


def test_all_candidates_is_exact(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "ROWS_AT_ONCE", 20)
    monkeypatch.setattr(vector_index, "QUERIES_AT_ONCE", 5)
    odd = [(900, None, None), (901, [0.0] * 16, None), (902, [1.0] * 3, None), (903, [float("nan")] * 16, ["l1"]), (904, [1e200] * 16, None), (None, [1.0] * 16, None)]
    df = spark.createDataFrame(clustered(300, 1) + odd, SCHEMA).repartition(3)
    index = VectorIndex(spark, shared_folder(spark, "vectors")).build(df, "id", "v", "labels", cells=9)
    asked = df.where("id % 10 = 0 OR id > 890").withColumn("wanted", F.when(F.col("id") % 20 == 0, F.array(F.lit("l1"))))
    same = df.where("size(v) = 16")
    assert rows_of(index.topk(asked, 4, "id", "v", candidates=10**9)) == rows_of(r.vector_topk_each(same, asked.where("size(v) = 16"), 4, "id", "v"))
    want = r.vector_topk_each(same, asked.where("size(v) = 16"), 4, "id", "v", label_col="labels", wanted_col="wanted")
    assert rows_of(index.topk(asked, 4, "id", "v", candidates=10**9, wanted_col="wanted")) == rows_of(want)


def test_recall_and_cells_read(spark):
    """In clusters 5 % of the rows hold over 90 % of the nearest ten."""
    df = spark.createDataFrame(clustered(4000, 2), SCHEMA)
    index = VectorIndex(spark, shared_folder(spark, "vectors")).build(df, "id", "v", cells=60)
    asked = df.where("id % 20 = 0")
    exact = {(q, i) for q, _, i, _ in rows_of(r.vector_topk_each(df, asked, 10, "id", "v"))}
    got = {(q, i) for q, _, i, _ in rows_of(index.topk(asked, 10, "id", "v", candidates=200))}
    assert len(got & exact) / len(exact) > 0.9
    _, sizes = index.cells()
    seen = index.probes(asked, "id", "v", 200).join(index.rows().groupBy("cell").count(), "cell").groupBy("id").agg(F.sum("count").alias("n"))
    assert seen.agg(F.avg("n")).first()[0] < 0.08 * 4000 and sizes.sum() == 4000
    one = index.probes(df.where("id = 20"), "id", "v", 100).select("cell").distinct()
    cells = [x[0] for x in one.collect()]
    files = lambda d: {x[0] for x in d.select(F.input_file_name()).distinct().collect()}
    assert len(files(index.rows().where(F.col("cell").isin(cells)))) < len(files(index.rows())) / 5


def test_given_vectors(spark, sf):
    """The given vectors lie evenly in 64 dimensions, where cells help little: 0.9 of the nearest ten need over half of the rows."""
    df = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    index = VectorIndex(spark, shared_folder(spark, "vectors")).build(df, "id", "v", cells=16)
    asked, n = df.where("id % 20 = 0"), df.count()
    exact = {(q, i) for q, _, i, _ in rows_of(r.vector_topk_each(df, asked, 10, "id", "v"))}
    got = {(q, i) for q, _, i, _ in rows_of(index.topk(asked, 10, "id", "v", candidates=int(0.7 * n)))}
    assert len(got & exact) / len(exact) >= 0.9


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    index = VectorIndex(spark, shared_folder(spark, "vectors")).build(none, "id", "v")
    assert index.topk(spark.createDataFrame([(1, [1.0], None)], SCHEMA), 3, "id", "v").count() == 0
