"""A vector index that is kept: rows stored by cell, searched in the nearest cells until enough candidates are met.

Cells are the centres of k-means over a bounded sample (SAMPLE rows, those of the least hashes of their
ids), fitted where the driver is; every row is then put into the cell of its nearest centre, rows of a
cell side by side in a folder of their own.  A search takes each query's cells from the nearest on
until they hold ``candidates`` rows, reads those cells only, and ranks their rows exactly.  With as many
candidates as there are rows it is the exact search.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.operators.retrieval import _FOUND, QUERIES_AT_ONCE, ROWS_AT_ONCE, _matrix, _scan, usable
from granary.operators.store import kept

SAMPLE = 50_000  # rows that the cells are fitted to
ROUNDS = 8


def fit(x: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of unit vectors by spherical k-means, from evenly spaced starts; empty cells start again at the row farthest from its centre."""
    cells = min(cells, len(x))
    c = x[np.linspace(0, len(x) - 1, cells).astype(int)] if cells else x[:0]
    for _ in range(rounds if cells else 0):
        near = x @ c.T
        which, best = near.argmax(1), near.max(1)
        sums = np.zeros_like(c)
        np.add.at(sums, which, x)
        empty = np.flatnonzero(np.bincount(which, minlength=cells) == 0)
        sums[empty] = x[np.argsort(best, kind="stable")[: len(empty)]]
        size = np.sqrt((sums * sums).sum(1, keepdims=True))
        c = np.divide(sums, size, out=c.copy(), where=size > 0)
    return c


def _assign(told):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = (_matrix(batch.column(1)) @ told.value.T).argmax(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], [*batch.schema.names, "cell"])

    return run


def _probe(told, sizes, candidates: int):
    """(id, v, ...) -> a row for each cell that is searched: the nearest ones, until they hold enough rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            order = np.argsort(-(_matrix(batch.column(1)) @ told.value.T), axis=1, kind="stable")
            before = np.cumsum(sizes[order], axis=1) - sizes[order]
            row, at = np.nonzero((before < candidates) & (sizes[order] > 0))
            out = [c.take(pa.array(row)) for c in batch.columns]
            yield pa.RecordBatch.from_arrays([*out, pa.array(order[row, at], pa.int32())], [*batch.schema.names, "cell"])

    return run


class VectorIndex:
    """An index in a folder that all executors share: ``cells`` (centres and sizes) and ``rows`` by cell."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def build(self, rows: DataFrame, id_col: str, vec_col: str, label_col: str | None = None, cells: int = 64) -> "VectorIndex":
        """All rows whose vector is there, finite and not zero, of the length that most of the sample have; others take no part."""
        labels = F.col(label_col).cast("array<string>") if label_col else F.lit(None).cast("array<string>")
        fine = rows.where(usable(F.col(vec_col)) & F.col(id_col).isNotNull())
        given = fine.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), labels.alias("labels"))
        sample = given.select("v", F.xxhash64("id").alias("h"), "id").orderBy("h", "id").limit(SAMPLE).select("v").toArrow().column("v").combine_chunks()
        lengths = np.diff(sample.offsets.to_numpy()) if len(sample) else np.zeros(0, int)
        dim = int(np.bincount(lengths).argmax()) if len(lengths) else 0
        centres = fit(_matrix(sample.filter(pa.array(lengths == dim))), cells) if len(lengths) else np.zeros((0, 1))
        told = self.spark.sparkContext.broadcast(centres)
        placed = given.where(F.size("v") == dim).mapInArrow(_assign(told), "id long, v array<double>, labels array<string>, cell int")
        # a large cell is dealt to several files
        placed.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(4))).write.mode("overwrite").partitionBy("cell").parquet(f"{self.path}/rows")
        sizes = self.rows().groupBy("cell").count()
        n = {r["cell"]: r["count"] for r in sizes.collect()}  # a row for each cell
        about = [(i, int(n.get(i, 0)), json.dumps(c.tolist())) for i, c in enumerate(centres)]
        self.spark.createDataFrame(about, "cell int, rows long, centre string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/cells")
        return self

    def rows(self) -> DataFrame:
        return self.spark.read.schema("id long, v array<double>, labels array<string>, cell int").parquet(f"{self.path}/rows")

    def cells(self) -> tuple[np.ndarray, np.ndarray]:
        """Centres and numbers of rows."""
        about = sorted(self.spark.read.parquet(f"{self.path}/cells").collect())  # a row for each cell
        centres = [json.loads(r["centre"]) for r in about]
        return np.array(centres, np.float64).reshape(len(about), len(centres[0]) if centres else 0), np.array([r["rows"] for r in about], np.int64)

    def probes(self, queries: DataFrame, id_col: str, vec_col: str, candidates: int, wanted_col: str | None = None) -> DataFrame:
        """(id, v, labels, cell): which cells each query searches."""
        centres, sizes = self.cells()
        wanted = F.col(wanted_col).cast("array<string>") if wanted_col else F.lit(None).cast("array<string>")
        fine = queries.where(usable(F.col(vec_col)) & F.col(id_col).isNotNull() & (F.size(vec_col) == centres.shape[1]))
        asked = fine.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), wanted.alias("labels"))
        schema = "id long, v array<double>, labels array<string>, cell int"
        if not len(centres):
            return asked.limit(0).withColumn("cell", F.lit(0))
        return asked.mapInArrow(_probe(self.spark.sparkContext.broadcast(centres), sizes, candidates), schema)

    def topk(self, queries: DataFrame, k: int, id_col: str, vec_col: str, candidates: int = 100, wanted_col: str | None = None, digits: int = 6) -> DataFrame:
        """Each query's k nearest rows of its cells by cosine, but itself: (query_id, rank, id, score); ties to the smaller id.

        With ``wanted_col`` only rows with one of a query's labels count, in the cells that it searches.
        A cell's rows meet the queries that search it in blocks of both, as in ``vector_topk_each``.
        """
        asked = kept(self.probes(queries, id_col, vec_col, candidates, wanted_col), "probes")
        seen = [(r["cell"], r["count"]) for r in asked.groupBy("cell").count().collect()]  # a row for each cell
        _, sizes = self.cells()
        shape = [(c, max(1, -(-n // QUERIES_AT_ONCE)), max(1, -(-int(sizes[c]) // ROWS_AT_ONCE))) for c, n in seen]
        blocks = F.broadcast(self.spark.createDataFrame(shape, "cell int, qn int, rn int"))
        part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        cols = ["cell", "qb", "rb", "what", "id", "v", "labels"]
        near = self.rows().where(F.col("cell").isin([c for c, _ in seen])).join(blocks, "cell")
        left = asked.join(blocks, "cell").withColumns({"qb": part("qn"), "what": F.lit(0)}).withColumn("rb", every("rn")).select(cols)
        right = near.withColumns({"rb": part("rn"), "what": F.lit(1)}).withColumn("qb", every("qn")).select(cols)
        keys = ["cell", "qb", "rb"]
        found = left.union(right).repartition(*keys).sortWithinPartitions(*keys, "what").mapInArrow(_scan(k, digits), _FOUND)
        top = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
