"""Where intermediate tables go, and how sorted Arrow streams are cut into groups."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.textkit import np


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster shares: ``spark.checkpoint.dir``, or the context's; our own only where neither is set and Spark runs in this process (tests)."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="granary-"))
        found = sc.getCheckpointDir()
    return f"{found.rstrip('/')}/granary/{sc.applicationId}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it back: a cut in the lineage that outlives executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of one key that a join may meet in one task; keys with more are dealt to several.
HOT_ROWS = 50_000
#: Hot keys that may be broadcast; there are at most rows / HOT_ROWS of them, so this is reached at 10^11 rows.
HOT_KEYS = 2_000_000


def spread_join(many: DataFrame, one: DataFrame, key: str, by: str, hot_rows: int | None = None, rows: int | None = None) -> DataFrame:
    """Inner join of ``many`` with ``one`` (a row for each key) in which a key of over ``hot_rows`` rows meets in as many tasks as it needs.

    Rows of a hot key are told apart by a hash of the column ``by``; only its row of ``one`` is
    repeated.  The hot keys are counted first (partial sums, then one row for
    each), unless ``many`` is known to have at most ``rows`` rows, too few for any.
    """
    hot_rows = hot_rows or HOT_ROWS
    if rows is not None and rows <= hot_rows:
        return many.join(one, key)
    hot = many.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_n")).where(F.col("_n") > hot_rows)
    hot = hot.select("_k", F.ceil(F.col("_n") / hot_rows).cast("int").alias("_parts"))
    if hot.isEmpty():
        return many.join(one, key)
    hot = stored(hot, "hot")
    n = hot.count()
    told = F.broadcast(hot) if n <= HOT_KEYS else hot
    part = F.coalesce(F.pmod(F.xxhash64(by), F.col("_parts")).cast("int"), F.lit(0))
    dealt = many.join(told, F.col(key) == F.col("_k"), "left").withColumn("_part", part).drop("_k", "_parts")
    copies = one.join(told, F.col(key) == F.col("_k"), "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1))).drop("_k", "_parts")
    return dealt.join(copies, [key, "_part"]).drop("_part")


def give_back() -> None:
    """What a finished pass no longer needs goes back to the machine, as Python's workers live on for the next stage."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Cut a stream of batches, sorted by ``keys`` (integers or strings without nulls), into one table per key."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            v = c.to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
        first = tuple(c[0].as_py() for c in cols)
        starts = np.flatnonzero(change).tolist()
        if last is not None and first != last:
            yield pa.Table.from_batches(held)
            held = []
        at = 0
        for s in [*starts, batch.num_rows]:
            held.append(batch.slice(at, s - at))
            if s < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
            at = s
        last = tuple(c[batch.num_rows - 1].as_py() for c in cols)
    if held:
        yield pa.Table.from_batches(held)
