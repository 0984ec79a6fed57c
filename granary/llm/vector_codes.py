"""Product codes of vectors, nearest codebook entries found by slicing and intersecting bit masks.

Every component x becomes the integer floor(1024 x), and a vector is cut into equal parts with a
codebook each.  For the nearest entry of a part, each coordinate of a codebook is kept sorted, with a
mask for each prefix of that order: the set of entries in it, 64 to a word.  Exact distances to one
entry near the part in each coordinate give an initial radius.  No entry within that radius differs
by more in any coordinate, so each coordinate cuts out a slice of its order, whose set is what two
prefix masks differ in; the sets of all coordinates are intersected by AND, and the entries left are
compared exactly, in integers.  On parts that lie evenly in many dimensions most entries are left,
and the search costs about as much as a full one; in clusters few are.

Codebooks are trained by rounds of assignment: a task sends sums and counts for each entry, never
vectors, and only those sums (as many as the codebooks have components) reach the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.shared import spread_join, stored

SCALE = 1024
MOST = 2**62  # integers beyond are taken as this
SMALL = 2**28  # up to here all sums of squares of a part fit 64 bits; beyond, Python's integers are used
PAIRS = 1 << 16  # parts times entries compared at once
LABELS_SENT = 1_000_000  # labels whose sums may be broadcast
_LONG = 2**63 - 1


class Book:
    """One part's codebook, ready to be searched."""

    def __init__(self, entries: list[list[int]]):
        big = any(abs(c) >= SMALL for e in entries for c in e)
        self.listed = entries
        self.entries = np.array(entries, object if big else np.int64).reshape(len(entries), -1)
        k, self.width = self.entries.shape
        words = -(-k // 64)
        self.order = np.argsort(self.entries, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.entries, self.order, 0)
        bits = np.zeros((self.width, k + 1, words), np.uint64)  # of each coordinate and place in its order: that entry alone
        for d in range(self.width):
            at = self.order[:, d]
            bits[d, np.arange(1, k + 1), at // 64] = np.uint64(1) << (at % 64).astype(np.uint64)
        self.prefix = np.bitwise_or.accumulate(bits, axis=1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each row, ties to the lower entry."""
        k = len(self.entries)
        step = max(1, PAIRS // k)
        found = [self._nearest(x[at : at + step]) for at in range(0, len(x), step)]
        return np.concatenate([e for e, _ in found]), np.concatenate([d for _, d in found])

    def candidates(self, x: np.ndarray) -> np.ndarray:
        """Masks of the entries within the initial radius in every coordinate: a row of words for each row of ``x``."""
        k = len(self.entries)
        close = None
        for d in range(self.width):  # one entry near in each coordinate
            at = np.minimum(np.searchsorted(self.sorted[:, d], x[:, d]), k - 1)
            gap = x - self.entries[self.order[at, d]]
            far = (gap * gap).sum(1)
            close = far if close is None else np.minimum(close, far)
        if close is None:
            return np.ones((len(x), 1), np.uint64)  # no coordinates: all entries are equal, the first is taken
        r = _root(close)
        masks = None
        for d in range(self.width):
            low = np.searchsorted(self.sorted[:, d], x[:, d] - r, "left")
            high = np.searchsorted(self.sorted[:, d], x[:, d] + r, "right")
            mine = self.prefix[d, high] ^ self.prefix[d, low]
            masks = mine if masks is None else masks & mine
        return masks

    def _nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        masks = np.ascontiguousarray(self.candidates(x))
        set_ = np.unpackbits(masks.view(np.uint8), axis=1, bitorder="little")
        row, entry = np.nonzero(set_)
        gap = x[row] - self.entries[entry]
        far = (gap * gap).sum(1) if self.width else np.zeros(len(row), np.int64)
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        least = np.minimum.reduceat(far, first)
        hit = np.flatnonzero(far == np.repeat(least, np.diff(np.append(first, len(row)))))
        hit = hit[np.append(True, row[hit][1:] != row[hit][:-1])]
        return entry[hit], least


def _root(x: np.ndarray) -> np.ndarray:
    """Integer square roots, rounded down."""
    if x.dtype == object:
        return np.frompyfunc(math.isqrt, 1, 1)(x)
    r = np.sqrt(x.astype(np.float64)).astype(np.int64)
    r -= r * r > x
    return r + ((r + 1) * (r + 1) <= x)


def _whole(x: np.ndarray) -> np.ndarray:
    """floor(1024 x) as 64-bit integers, or Python's where some are too large to square."""
    with np.errstate(over="ignore"):
        y = np.floor(x * float(SCALE))
    if not len(y) or np.abs(y).max(initial=0) < SMALL:
        return y.astype(np.int64)
    y = np.clip(y, -float(MOST), float(MOST))
    return np.frompyfunc(int, 1, 1)(y)


def _parts(column: pa.Array, width: int, parts: int) -> np.ndarray:
    """Rows of integers, shorter vectors filled up with zeros: rows x parts x width."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), parts * width))
    if len(flat):
        row = np.repeat(np.arange(len(column)), size)
        out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return _whole(out).reshape(len(column), parts, width)


def _books(told: list[list[list[int]]]) -> list[Book]:
    return [Book(entries) for entries in told]


_SUMS = "part int, entry int, place int, total string, n long"


def _sums(told, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = _books(told.value)
        k = len(books[0].entries)
        total, large = np.zeros((len(books), k, width), np.int64), None
        count = np.zeros((len(books), k), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _parts(batch.column(0), width, len(books))
            for p, book in enumerate(books):
                entry, _ = book.nearest(x[:, p])
                count[p] += np.bincount(entry, minlength=k)
                if x.dtype == object:
                    large = np.zeros(total.shape, object) if large is None else large
                    np.add.at(large[p], entry, x[:, p])
                else:
                    np.add.at(total[p], entry, x[:, p])
        part, entry = np.nonzero(count)
        if not len(part) or not width:
            return
        sums = total[part, entry].astype(object) + (0 if large is None else large[part, entry])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(part, width), pa.int32()),
                pa.array(np.repeat(entry, width), pa.int32()),
                pa.array(np.tile(np.arange(width), len(part)), pa.int32()),
                pa.array(list(map(str, sums.ravel())), pa.string()),
                pa.array(np.repeat(count[part, entry], width), pa.int64()),
            ],
            ["part", "entry", "place", "total", "n"],
        )

    return run


def _codes(told, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = _books(told.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _parts(batch.column(0), width, len(books))
            entries, error = [], None
            for p, book in enumerate(books):
                entry, far = book.nearest(x[:, p])
                entries.append(entry.astype(np.uint8))
                error = far.astype(object) if error is None else error + far
            code = np.stack(entries, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([c.tobytes().hex() for c in code]), pa.array([min(e, _LONG) for e in error], pa.int64())], [*batch.schema.names[1:], "code", "error"])

    return run


def usable(rows: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is there and holds no null and nothing infinite or undefined."""
    x = F.col(vector)
    fine = F.forall(x, lambda c: F.coalesce(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")), F.lit(False)))
    return rows.where(x.isNotNull() & fine)


def fit(rows: DataFrame, id_col: str, vector: str, parts: int = 4, entries: int = 256, rounds: int = 4) -> tuple[list[list[list[int]]], int]:
    """(codebooks, width of a part) of rows that ``usable`` let through.

    Codebooks start as the parts of the ``entries`` rows of the smallest ids (nulls last, equal ids by
    vector) and stay that long if there are fewer rows.  A round gives every part to its nearest entry
    and makes an entry the floor of its parts' mean; unused ones stay.  Every round scans the rows; the
    driver sees ``parts * entries * width`` sums.
    """
    if entries > 256:
        raise ValueError("a code has two hexadecimal digits for each part")
    longest = rows.agg(F.coalesce(F.max(F.size(vector)), F.lit(0))).first()[0]
    width = -(-longest // parts)
    head = rows.select(id_col, F.col(vector).cast("array<double>").alias("v")).orderBy(F.col(id_col).asc_nulls_last(), "v").limit(entries).select("v").toArrow()
    start = _parts(head.column("v").combine_chunks(), width, parts) if head.num_rows else np.zeros((0, parts, width), np.int64)
    told = [[[int(c) for c in row] for row in start[:, p]] for p in range(parts)]
    if not head.num_rows:
        return told, width
    given = rows.select(F.col(vector).cast("array<double>").alias("v"))
    for _ in range(rounds):
        held = rows.sparkSession.sparkContext.broadcast(told)
        sums = given.mapInArrow(_sums(held, width), _SUMS).groupBy("part", "entry", "place")
        for r in sums.agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).toArrow().to_pylist():
            told[r["part"]][r["entry"]][r["place"]] = int(r["total"]) // r["n"]
    return told, width


def digest(told: list[list[list[int]]]) -> str:
    """sha256 of all components in decimal, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(c) for entries in told for e in entries for c in e).encode()).hexdigest()


def encode(rows: DataFrame, vector: str, books: tuple[list[list[list[int]]], int], keep: list[str]) -> DataFrame:
    """The columns ``keep`` with code (two hexadecimal digits for each part's nearest entry) and error (squared distances, summed).

    An error that no long holds is the greatest long.
    """
    told, width = books
    given = rows.select(F.col(vector).cast("array<double>").alias("v"), *[F.col(c) for c in keep])
    schema = ", ".join([*(f"`{c}` {given.schema[c].dataType.simpleString()}" for c in keep), "code string", "error long"])
    if not told[0]:  # no rows, no entries
        return given.limit(0).select(*keep, F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    return given.mapInArrow(_codes(rows.sparkSession.sparkContext.broadcast(told), width), schema)


def coded(rows: DataFrame) -> DataFrame:
    """(vec_id, embedding, label) -> vec_id, code, error, label_error, codebooks_sha256.

    Rows whose vector is null or holds null or non-finite components are dropped; shorter vectors are
    filled up with zeros to the longest one's length, and that to a multiple of four.  Integers beyond
    2^62 are taken as that.  Rows repeat, and lack an id or a label, freely; ``label_error`` sums the
    errors of equal labels, null being one of them.
    """
    rows = usable(rows.select("vec_id", "embedding", "label"), "embedding")
    books = fit(rows, "vec_id", "embedding")
    out = stored(encode(rows, "embedding", books, ["vec_id", "label"]).withColumn("_key", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("null"))), "codes")
    sums = stored(out.groupBy("_key").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("label_error")), "label-errors")
    if sums.count() <= LABELS_SENT:
        met = out.join(F.broadcast(sums), "_key")
    else:
        met = spread_join(out, sums, "_key", "vec_id")
    total = F.least(F.col("label_error"), F.lit(_LONG).cast("decimal(38,0)")).cast("long")
    return met.select("vec_id", "code", "error", total.alias("label_error"), F.lit(digest(books[0])).alias("codebooks_sha256"))


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    """Codes and errors of all vectors."""
    return coded(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op11_vector_codes": op11_vector_codes}


def _sql() -> str:
    dot = lambda a, b: f"list_inner_product({a}::DOUBLE[], {b}::DOUBLE[])"
    far = f"({dot('x', 'x')} - 2 * {dot('x', 'c')} + {dot('c', 'c')})::BIGINT"
    steps = []
    for i in range(5):
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, p, any_value(x) AS x, min({{'d': {far}, 'e': e}}) AS n FROM parts JOIN b{i} USING (p) GROUP BY r, p)")
        if i < 4:
            steps.append(
                f"m{i} AS (SELECT p, e, list(c ORDER BY i) AS c FROM (SELECT p, n.e AS e, i, floor(sum(x[i])::DOUBLE / count(*))::BIGINT AS c FROM a{i}, LATERAL (SELECT unnest(generate_series(1, len(x))) AS i) GROUP BY ALL) GROUP BY p, e), "
                f"b{i + 1} AS MATERIALIZED (SELECT o.p, o.e, coalesce(m.c, o.c) AS c FROM b{i} o LEFT JOIN m{i} m ON o.p = m.p AND o.e = m.e)"
            )
    return (
        "WITH kept AS MATERIALIZED (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, list_transform(embedding, lambda y: floor(1024 * y::DOUBLE)::BIGINT) AS v FROM embeddings "
        "WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0), "
        "parts AS MATERIALIZED (SELECT r, p, v[p * len(v) // 4 + 1 : (p + 1) * len(v) // 4] AS x FROM kept, range(4) t(p)), "
        f"b0 AS MATERIALIZED (SELECT p, r - 1 AS e, x AS c FROM parts WHERE r <= 256), {', '.join(steps)}, "
        "t AS (SELECT sha256(string_agg(list_aggregate(c, 'string_agg', ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b4), "
        "f AS (SELECT r, string_agg(printf('%02x', n.e), '' ORDER BY p) AS code, sum(n.d)::BIGINT AS error FROM a4 GROUP BY r) "
        "SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM f JOIN kept USING (r), t"
    )


SQL = {"op11_vector_codes": _sql()}
