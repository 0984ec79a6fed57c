"""Approximate nearest neighbours by multiprobe p-stable hashing.

(Datar et al., "Locality-sensitive hashing scheme based on p-stable distributions", 2004; Lv et al.,
"Multi-probe LSH", 2007.)  Vectors are scaled to length one, where the largest cosine is the least
distance.  In each of several tables Gaussian projections, shifted and cut into slots, name a bucket.
A query visits, beside its own bucket, buckets with some slots one lower or higher, in the order of
estimated success: the fewest squared distances from the query to the slot borders that must be
crossed come first.

How many buckets a query needs depends on how near its neighbours are, so there are three steps.
FINE hashing visits few rows.  The chance that it meets a row at a given distance follows from the
hash functions alone (``success``); a query whose k-th find lies so near that this chance is at least
SURE is done.  The others search COARSE hashing, whose buckets hold more, and are judged again.  Those
whose neighbours are too far for it too are searched exactly.  So recall doesn't depend on the data,
only the share of rows visited does: small where vectors have near neighbours, most of the table where
they lie about evenly on the sphere and no hashing can tell the nearest from the rest.

Plan: index rows and queries meet in units, (table, part of the buckets), of about UNIT rows; a query
goes to a unit once with all the buckets it visits there.  A bucket of more than BLOCK rows is dealt
into blocks and its queries go to each, so no bucket is met whole in one task and none is cut short.
Inside a task candidates are scored in numpy, in single precision first and exactly if they may be among
the best, and only the best k of each query go on.  A query's finds go on to the next setting with it:
what doesn't reach its k-th best score is dropped there at once.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.shared import grouped, stored
from granary.llm.textkit import mix64


class Setting(NamedTuple):
    """Tables, hash functions in each, width of a slot, buckets visited in each table."""

    tables: int
    hashes: int
    width: float
    probes: int


FINE, COARSE = Setting(8, 12, 2.0, 64), Setting(8, 7, 2.0, 48)
SURE = 0.92
BLOCK, UNIT = 4096, 1 << 16
PAIRS = 1 << 17  # candidate pairs scored at once
ASKED = 1 << 14  # queries that a task holds beside a unit
HELD = 400_000  # candidates a task holds before it keeps each query's best

_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


class Hashes:
    """The projections of all tables; a function of the dimension, the setting and the seed alone."""

    def __init__(self, dim: int, setting: Setting = COARSE, seed: int = 20):
        self.tables, self.hashes, self.width, probes = setting
        rng = np.random.default_rng(seed)
        self.a = rng.normal(size=(dim, self.tables * self.hashes))
        self.b = rng.uniform(0, 1, self.tables * self.hashes)
        # moves by one slot; with many hash functions those of up to three of them, the likeliest
        most = self.hashes if self.hashes <= 8 else 3
        places = [c for k in range(most + 1) for c in itertools.combinations(range(self.hashes), k)]
        self.moves = np.zeros((sum(2 ** len(c) for c in places), self.hashes), np.int64)
        row = 0
        for c in places:
            for signs in itertools.product((-1, 1), repeat=len(c)):
                self.moves[row, list(c)] = signs
                row += 1
        self.probes = min(probes, len(self.moves))
        self.odd = mix64(np.arange(1, self.hashes + 1, dtype=np.uint64)) | np.uint64(1)

    def _slots(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = (unit @ self.a / self.width + self.b).reshape(len(unit), self.tables, self.hashes)
        slot = np.floor(p)
        return slot.astype(np.int64), p - slot

    def _keys(self, slots: np.ndarray) -> np.ndarray:
        return mix64((slots.view(np.uint64) * self.odd).sum(-1, dtype=np.uint64)).view(np.int64)

    def _costs(self, down: np.ndarray) -> np.ndarray:
        return (down**2) @ (self.moves == -1).T + ((1 - down) ** 2) @ (self.moves == 1).T

    def buckets(self, unit: np.ndarray) -> np.ndarray:
        """(rows, tables): the bucket of each vector in each table."""
        return self._keys(self._slots(unit)[0])

    def visits(self, unit: np.ndarray) -> np.ndarray:
        """(rows, tables, probes): the buckets a query visits, likeliest first."""
        slot, down = self._slots(unit)
        cost = self._costs(down)
        some = np.argpartition(cost, self.probes - 1, axis=2)[:, :, : self.probes]
        order = np.argsort(np.take_along_axis(cost, some, 2), axis=2, kind="stable")
        best = np.take_along_axis(some, order, 2)
        return self._keys(slot[:, :, None, :] + self.moves[best])

    def success(self, samples: int = 400, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
        """(distances, chances): how likely a query's visits meet a vector at a distance, by simulated projections."""
        rng = np.random.default_rng(seed)
        down = rng.uniform(size=(samples, self.hashes))
        cost = self._costs(down)
        last = np.partition(cost, self.probes - 1, axis=1)[:, self.probes - 1]
        step = rng.normal(size=(samples, self.hashes)) / self.width
        at = np.linspace(0, 2, 81)
        chance = []
        for d in at:
            move = np.floor(down + d * step)
            need = (np.where(move == -1, down, 0) ** 2 + np.where(move == 1, 1 - down, 0) ** 2).sum(1)
            one = ((np.abs(move).max(1) <= 1) & (np.abs(move).sum(1) <= np.abs(self.moves).sum(1).max()) & (need <= last)).mean()
            chance.append(1 - (1 - one) ** self.tables)
        return at, np.minimum.accumulate(chance)

    def least_cosine(self, sure: float) -> float:
        """The cosine from which a row is met with a chance of at least ``sure``."""
        at, chance = self.success()
        far = at[chance >= sure].max(initial=0.0)
        return 1 - far * far / 2


def _given(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return _given(column, dim).astype(np.float64)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings the largest component near one: exact, and no square overflows or vanishes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.sqrt((x * x).sum(1))[:, None]


def _single(x: np.ndarray) -> np.ndarray:
    """Unit vectors in single precision, made from a few rows at a time."""
    out = np.empty(x.shape, np.float32)
    for s in range(0, len(x), 4096):
        out[s : s + 4096] = _unit(x[s : s + 4096].astype(np.float64))
    return out


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, in one fixed order of additions."""
    x, y = _scaled(x), _scaled(y)
    return (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))


def _best(q: np.ndarray, v: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k best distinct vectors: largest score, then smallest id."""
    order = np.lexsort((-s, v, q))  # the same pair from several tables, once
    q, v, s = q[order], v[order], s[order]
    one = np.ones(len(q), bool)
    one[1:] = (q[1:] != q[:-1]) | (v[1:] != v[:-1])
    q, v, s = q[one], v[one], s[one]
    order = np.lexsort((v, -s, q))
    q, v, s = q[order], v[order], s[order]
    start = np.maximum.accumulate(np.where(np.diff(q, prepend=~q[:1]) != 0, np.arange(len(q)), 0))
    keep = np.arange(len(q)) - start < k
    return q[keep], v[keep], s[keep]


def _search(dim: int, k: int):
    """Rows sorted by (tab, part, blk, ask), indexed ones (ask 0) and then slices of the queries with the buckets they visit -> each query's best k of what this task saw.

    Pairs are scored in single precision first.  What can't be among a query's best k, by more than that
    precision is off, goes no further; the rest are compared exactly.  A task holds one unit of rows and
    one slice of queries.
    """
    off = (dim + 8) * 2.0**-23  # more than products of unit vectors are off in single precision

    def laid(t: pa.Table) -> tuple:
        """Of a unit's rows, in order of their buckets: bucket, id, vector, unit vector; and how many rows share an id at most."""
        key = t.column("buckets").combine_chunks().flatten().to_numpy()
        order = np.argsort(key, kind="stable")
        ids, x = t.column("id").to_numpy()[order], _given(t.column("v").combine_chunks(), dim)[order]
        return key[order], ids, x, _single(x), int(np.unique(ids, return_counts=True)[1].max())

    def met(key: np.ndarray, rows: np.ndarray, want: np.ndarray, owner: np.ndarray, asked: np.ndarray, bar: np.ndarray, deep: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query row, index row) of pairs that share a bucket and may be among the query's best; bar, what a query's pairs must reach, rises meanwhile."""
        held, held_n, scored = [], 0, 0

        def told() -> tuple[np.ndarray, np.ndarray]:
            q, at, s = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((-s, q))
            q, at, s = q[order], at[order], s[order]
            first = np.flatnonzero(np.diff(q, prepend=-1) != 0)
            full = first[np.diff([*first, len(q)]) >= deep]
            bar[q[full]] = np.maximum(bar[q[full]], s[full + deep - 1] - 2 * off)
            keep = s >= bar[q]
            return q[keep], at[keep]

        by = np.argsort(want, kind="stable")
        want, owner = want[by], owner[by]
        first = np.flatnonzero(np.diff(want, prepend=~want[:1]) != 0)
        count = np.diff([*first, len(want)])
        lo, hi = np.searchsorted(key, want[first], "left"), np.searchsorted(key, want[first], "right")
        some = hi > lo
        first, count, lo, size = first[some], count[some], lo[some], (hi - lo)[some]
        large = count * size >= 128
        for f, c, at, m in zip(*(v[large].tolist() for v in (first, count, lo, size)), strict=True):
            for r in range(at, at + m, BLOCK):
                block = rows[r : min(at + m, r + BLOCK)].T
                n = block.shape[1]
                for s in range(f, f + c, max(1, PAIRS // n)):
                    q = owner[s : min(f + c, s + max(1, PAIRS // n))]
                    score = asked[q] @ block
                    hit = np.flatnonzero(score >= bar[q][:, None])
                    scored += score.size
                    if len(hit):
                        row = hit // n
                        held.append((q[row], r + hit - row * n, score.ravel()[hit]))
                        held_n += len(hit)
                    if held_n and (held_n >= PAIRS // 4 or scored >= 32 * PAIRS):
                        yield told()
                        held, held_n, scored = [], 0, 0
        # small buckets, many at a time
        each = np.repeat(np.flatnonzero(~large), count[~large])
        inside = np.arange(len(each)) - np.repeat(np.cumsum(count[~large]) - count[~large], count[~large])
        owner, lo, size = owner[first[each] + inside], lo[each], size[each]
        run, s = np.cumsum(size), 0
        while s < len(size):
            e = max(s + 1, int(np.searchsorted(run, (run[s - 1] if s else 0) + PAIRS, "right")))
            m = size[s:e]
            at = np.repeat(lo[s:e], m) + np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
            q = np.repeat(owner[s:e], m)
            score = np.einsum("ij,ij->i", asked[q], rows[at])
            hit = np.flatnonzero(score >= bar[q])
            held.append((q[hit], at[hit], score[hit]))
            held_n += len(hit)
            if held_n >= PAIRS // 4:
                yield told()
                held, held_n = [], 0
            s = e
        if held_n:
            yield told()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n = 0
        unit, index = None, None

        def out():
            best = _best(*(np.concatenate(x) for x in zip(*held, strict=True)), k)
            return [best], len(best[0]), pa.RecordBatch.from_arrays([pa.array(x) for x in best], schema=_FOUND)

        for t in grouped(batches, ["tab", "part", "blk", "ask"]):
            *of, ask = (t.column(c)[0].as_py() for c in ("tab", "part", "blk", "ask"))
            if ask == 0:
                unit, index = of, laid(t)
                continue
            if unit != of:
                continue
            key, ids, x, rows, most = index
            asked_ids, asked = t.column("id").to_numpy(), _given(t.column("v").combine_chunks(), dim)
            lists = t.column("buckets").combine_chunks()
            least = t.column("least").combine_chunks().fill_null(-8.0).to_numpy(zero_copy_only=False)
            # of (k + 1) * most rows, k + 1 have different ids and k another one than the query
            for a, b in met(key, rows, lists.flatten().to_numpy(), np.repeat(np.arange(len(asked)), lists.value_lengths().to_numpy()), _single(asked), (least - off).astype(np.float32), (k + 1) * most):
                ok = asked_ids[a] != ids[b]
                a, b = a[ok], b[ok]
                if not len(a):
                    continue
                held.append(_best(asked_ids[a], ids[b], _cosines(asked[a].astype(np.float64), x[b].astype(np.float64)), k))
                n += len(held[-1][0])
            if n > HELD:
                held, n, batch = out()
                if n > HELD // 2:
                    yield batch
                    held, n = [], 0
        if held:
            yield out()[2]

    return run


def _placed(hashes: Hashes, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 2048):
                part = batch.slice(s, 2048)
                b = hashes.buckets(_unit(_matrix(part.column(1), dim)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(list(b))], ["id", "v", "buckets"])

    return run


def _visits(hashes: Hashes, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 64):
                part = batch.slice(s, 64)
                b = hashes.visits(_unit(_matrix(part.column(1), dim))).reshape(-1, hashes.probes)
                row = np.repeat(np.arange(part.num_rows), hashes.tables)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(np.tile(np.arange(hashes.tables, dtype=np.int32), part.num_rows)), pa.array(list(b))], ["id", "tab", "visits"])

    return run


def vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, v) of the vectors that take part: no null id, vector or component, all finite, not zero."""
    kind = df.schema[vec_col].dataType.simpleString()
    v = F.col(vec_col).cast(kind if kind in ("array<float>", "array<double>") else "array<double>")
    fit = F.size(v) > 0
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & fit).where(fine)


def _slice(queries: int):
    """Which slice of at most about ASKED queries one belongs to, from 1."""
    return (F.pmod(F.xxhash64("id"), F.lit(max(1, -(-queries // ASKED)))) + 1).cast("int").alias("ask")


def candidates(rows: DataFrame, queries: DataFrame, hashes: Hashes, dim: int) -> DataFrame:
    """Index rows and queries placed in the units where they meet: (tab, part, blk, ask, id, v, buckets, least).

    A query's row is there once for each unit, with all the buckets that it visits in it.
    """
    kind = rows.schema["v"].dataType.simpleString()
    parts = F.lit(max(1, -(-rows.count() // UNIT)))
    index = stored(rows.mapInArrow(_placed(hashes, dim), f"id long, v {kind}, buckets array<long>"), "index")
    index = index.select("id", "v", F.posexplode("buckets").alias("tab", "bucket"))
    # Blocks of large buckets: at most tables * rows / BLOCK of them.
    hot = stored(index.groupBy("tab", "bucket").count().where(F.col("count") > BLOCK).select("tab", "bucket", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "hot")
    visits = queries.select("id", "v").mapInArrow(_visits(hashes, dim), "id long, tab int, visits array<long>").select("id", "tab", F.explode("visits").alias("bucket"))
    if hot.isEmpty():
        index, visits = (d.withColumn("blocks", F.lit(1)) for d in (index, visits))
    else:
        index, visits = (d.join(hot, ["tab", "bucket"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))) for d in (index, visits))
    part = F.pmod("bucket", parts).cast("int").alias("part")
    placed = index.select("tab", part, F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("blk"), F.lit(0).alias("ask"), "id", "v", F.array("bucket").alias("buckets"), F.lit(None).cast("double").alias("least"))
    asked = visits.select("tab", part, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("blk"), "id", "bucket").groupBy("tab", "part", "blk", "id").agg(F.collect_set("bucket").alias("buckets"))
    return placed.union(asked.join(queries, "id").select("tab", "part", "blk", _slice(queries.count()), "id", "v", "buckets", "least"))


def nearest(rows: DataFrame, queries: DataFrame, k: int = 5, fine: Setting = FINE, coarse: Setting = COARSE, sure: float = SURE) -> DataFrame:
    """Each query's k nearest rows by cosine: query_id, rank, vec_id, score.

    Both tables are (id, v) as ``vectors`` gives them.  A row with the query's own id is no
    candidate; rows that share an id count once, at their best score.  Nearest first, ties to the
    smaller id; fewer than k if there are fewer candidates.  Vectors of another length than most of
    ``rows`` take no part.  Components of any finite size are compared without overflow.  No rows or
    no queries give no rows.
    """
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dim = size.n if size else 1
    rows, queries = rows.where(F.size("v") == dim), queries.where(F.size("v") == dim)
    keys = ["tab", "part", "blk"]
    found_schema = "query_id long, vec_id long, score double"
    top = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def ranked(found: DataFrame) -> DataFrame:
        once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        return once.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    def search(met: DataFrame) -> DataFrame:
        return met.repartition(*keys).sortWithinPartitions(*keys, "ask").mapInArrow(_search(dim, k), found_schema)

    # What a query has found goes on with it: its k-th best score is what further finds must reach.
    done, left = [], queries.select("id", "v").distinct().withColumn("least", F.lit(None).cast("double"))
    before = None
    for setting in (fine, coarse):
        h = Hashes(dim, setting)
        found = search(candidates(rows, left, h, dim))
        found = stored(ranked(found if before is None else found.union(before)), "found")
        last = found.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("least"))
        near = last.where(F.col("least") >= h.least_cosine(sure)).select(F.col("id").alias("query_id"))
        done.append(found.join(near, "query_id", "left_semi").select("query_id", "rank", "vec_id", "score"))
        left = stored(left.drop("least").join(near.withColumnRenamed("query_id", "id"), "id", "left_anti").join(last, "id", "left"), "left")
        before = found.join(near, "query_id", "left_anti").select("query_id", "vec_id", "score")
        if left.isEmpty():
            break
    else:  # exactly, against all rows in blocks
        blocks = max(1, -(-rows.count() // BLOCK))
        one = [F.lit(0).alias("tab"), F.lit(0).alias("part")]
        bucket = F.array(F.lit(0).cast("long")).alias("buckets")
        whole = rows.select(*one, F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("blk"), F.lit(0).alias("ask"), "id", "v", bucket, F.lit(None).cast("double").alias("least"))
        asked = left.select(*one, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("blk"), _slice(left.count()), "id", "v", bucket, "least")
        done.append(ranked(search(whole.union(asked)).union(before)))
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out


def op9_ann(spark, sf_dir: str) -> DataFrame:
    """The five nearest rows of every vector whose id is divisible by 50."""
    rows = vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return nearest(rows, rows.where("id % 50 = 0"), k=5)


QUERIES = {"op9_ann": op9_ann}
#: An approximate search: tested by recall against brute force, and each score against the exact measure.
SQL: dict[str, str] = {}
