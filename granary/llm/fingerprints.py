"""Document fingerprints by Order MinHash.

(Marçais, DeBlasio, Pandey and Kingsford, "Locality-sensitive hashing for the edit distance",
2019.)  The k-mers of a text are numbered by occurrence, so that repeats count.  For each of
COORDINATES hash functions the TUPLE least numbered k-mers are chosen, put back into the order in
which they stand in the text, and hashed together.  Two fingerprints agree in a coordinate only if
they chose the same k-mers in the same order, which makes the share of equal coordinates fall with
the edit distance, where a MinHash sees only sets.

Pairs of neighbours in id order come from one range-like shuffle.  Keys alone (id, hash of the text,
place in the table) are put in order first, and every BUCKET_ROWS-th of them starts a bucket; texts
then move once, each to its bucket, and a bucket's first row to the bucket before as well.  Keys differ
even where ids or whole rows repeat, so no id is a bucket of its own.  No text is joined, collected
or put in order by one task.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.textkit import mix64

K, TUPLE, COORDINATES = 6, 2, 96
#: Rows a bucket of neighbours holds, and the most starts of buckets that are broadcast, 32 bytes each:
#: beyond BUCKET_ROWS * MOST_BUCKETS rows, a quarter of a billion, buckets grow, to a million rows each at 10^12.
BUCKET_ROWS, MOST_BUCKETS = 256, 1 << 20
_PART = 1 << 18  # hashed k-mers held at once

_MULT = (mix64(np.arange(1, COORDINATES + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_XOR = (mix64(np.arange(1001, 1001 + COORDINATES, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def _numbered(text: str, k: int) -> np.ndarray:
    """A 32-bit hash of each k-mer of code points together with its occurrence number; a shorter text is one k-mer."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(c)
    if n == 0:
        return np.empty(0, np.uint32)
    k = min(k, n)
    h = c[: n - k + 1].astype(np.uint64)
    for j in range(1, k):
        h = h * np.uint64(0x100000001B3) + c[j : n - k + 1 + j]
    h = mix64(h)
    # the hash's upper bits and the place in one sortable number: equal k-mers stand together in text order
    bits = np.uint64(max(1, int(len(h) - 1).bit_length()))
    order = np.sort((h >> bits << bits) | np.arange(len(h), dtype=np.uint64))
    at = (order & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    kind = order >> bits
    first = np.maximum.accumulate(np.where(np.diff(kind, prepend=~kind[:1]) != 0, np.arange(len(h)), 0))
    number = np.empty(len(h), np.uint64)
    number[at] = np.arange(len(h)) - first
    return (mix64(h + number * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def fingerprint(text: str | None, k: int = K) -> np.ndarray:
    """COORDINATES 64-bit numbers; of an empty text all are zero."""
    h = _numbered(text or "", k)
    n = len(h)
    out = np.zeros(COORDINATES, np.uint64)
    if n == 0:
        return out
    width = max(1, _PART // n)
    for s in range(0, COORDINATES, width):
        m = (h[None, :] ^ _XOR[s : s + width, None]) * _MULT[s : s + width, None]
        rows = np.arange(len(m))
        picked = []
        for _ in range(min(TUPLE, n)):
            at = m.argmin(1)
            picked.append(at)
            m[rows, at] = np.uint32(0xFFFFFFFF)
        at = np.sort(np.stack(picked, 1), 1)  # text order
        x = h[at].astype(np.uint64)
        v = np.full(len(m), n if n < TUPLE else 0, np.uint64)
        for j in range(x.shape[1]):
            v = mix64(v * np.uint64(0x9E3779B97F4A7C15) + x[:, j] + np.uint64(1))
        out[s : s + width] = v
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal coordinates."""
    return float((a == b).mean())


def as_text(f: np.ndarray) -> str:
    """16 hex digits a coordinate."""
    return f.astype(">u8").tobytes().hex()


def fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """Adds fingerprint (string of 16 hex digits a coordinate) to every row; null and empty texts get zeros.

    Takes a column text; a column fingerprint in ``docs`` is replaced.  One pass, no shuffle.
    """
    own = [c for c in docs.columns if c != "fingerprint"]
    given = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_fingerprinted"), *[F.col(f"`{c}`") for c in own])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [as_text(fingerprint(t.as_py(), k)) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(made, pa.string())], [*batch.schema.names[1:], "fingerprint"])

    return given.mapInArrow(run, ", ".join([*(f"`{c}` {given.schema[c].dataType.simpleString()}" for c in own), "fingerprint string"]))


_MADE = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _edited(text: str, following: str) -> str:
    """The last half of a text replaced by the first as many code points of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compare(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = doc = text = None  # the row that waits for the one after it
        own = None
        for batch in batches:
            rows = []
            for b, d, guest, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if guest and (bucket != b or text is None):
                    continue  # only the first of the rows that follow a bucket counts
                t = t.as_py()
                f = own if t == text else fingerprint(t, k)
                if bucket == b and text is not None:
                    e = _edited(text, t)
                    g = fingerprint(e, k)
                    rows.append((doc, len(text), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), as_text(own), as_text(g), likeness(own, g), likeness(own, f)))
                if guest:
                    bucket = text = None
                else:
                    bucket, doc, text, own = b, d, t, f
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)

    return run


_NAMES = [x.split()[0] for x in _MADE.split(", ")]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def _every(step: int):
    """Every step-th row of a partition, from its first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            yield batch.take(pa.array(range(-seen % step, batch.num_rows, step), pa.int64()))
            seen += batch.num_rows

    return run


def _key(doc_id: int | None, h: int, row: int) -> tuple:
    """A row's place in the order: falling ids, null ids last, then hash and place in the table."""
    return doc_id is None, -(doc_id or 0), h, row


def compare_with_next(docs: DataFrame, k: int = K, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Fingerprints of each whole text and of its edited text, and their likeness to each other and to the next text.

    Takes columns doc_id (long) and text; others are ignored; null texts count as ''.  The next
    document is the one that follows in descending doc_id, after the last the first; rows that share
    a doc_id follow one another in the order of the xxhash64 of their texts; null ids come last.  The
    edited text is the text with its last floor(n / 2) code points replaced by the first as many (or
    all) of the next.  One row is its own next.  Returns doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.  No rows in, no rows out.  ``docs`` is read twice and
    must give its rows in the same order, as a table does.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("row"), text.alias("text"))
    keys, order = given.select("doc_id", "h", "row"), [F.col("doc_id").desc_nulls_last(), "h", "row"]
    step = max(bucket_rows, -(-keys.count() // MOST_BUCKETS))
    starts = keys.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_every(step), keys.schema).toArrow()
    told = spark.sparkContext.broadcast(sorted(map(_key, *(c.to_pylist() for c in starts.columns))))

    @F.pandas_udf("b int, before int")
    def place(doc_id: pd.Series, null: pd.Series, h: pd.Series, row: pd.Series) -> pd.DataFrame:
        all_ = told.value
        found = []
        for d, none, x, r in zip(doc_id.tolist(), null.tolist(), h.tolist(), row.tolist(), strict=True):
            key = _key(None if none else d, x, r)
            b = bisect.bisect_right(all_, key) - 1
            found.append((b, (b - 1) % len(all_) if all_[b] == key else -1))
        return pd.DataFrame(found, columns=["b", "before"])

    rows = given.withColumn("at", place(F.coalesce("doc_id", F.lit(0)), F.isnull("doc_id"), "h", "row"))
    here, guest = F.struct(F.col("at.b").alias("b"), F.lit(0).alias("guest")), F.struct(F.col("at.before").alias("b"), F.lit(1).alias("guest"))
    rows = rows.select(F.inline(F.when(F.col("at.before") < 0, F.array(here)).otherwise(F.array(here, guest))), "doc_id", "text", "h", "row")
    rows = rows.repartition("b").sortWithinPartitions("b", "guest", *order).select("b", "doc_id", "guest", "text")
    return rows.mapInArrow(_compare(k), _MADE)


def op1_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Order MinHash of all documents and of their edited texts."""
    return compare_with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op1_fingerprints": op1_fingerprints}
#: SQL has no Order MinHash: tested against a plain version.
SQL: dict[str, str] = {}
