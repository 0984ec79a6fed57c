"""A table that is changed in place: rows in buckets of their keys' hash, and a manifest for each version.

Rows lie in ``data/v=<version>/bucket=<bucket>``; a manifest says for every bucket in which version it
was last written.  An upsert reads and rewrites the buckets of its own keys only, into a folder of its
own, and then publishes a manifest, one small file.  Whoever reads sees the last published version
whole.  What a failed upsert leaves is in no manifest; the next one writes over it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators.store import kept
from granary.operators.tables import latest

BUCKETS = 64


class BucketTable:
    """The latest row of each key, in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, schema, keys: list[str], order: list[str], buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.keys, self.order, self.buckets = spark, path.rstrip("/"), schema, keys, order, buckets

    def manifest(self, version: int | None = None) -> tuple[int, int, dict[int, int]]:
        """(version, number of its batch, bucket -> version of its data) as last published, or of one version; (-1, -1, {}) of none."""
        try:
            found = self.spark.read.schema("batch long, bucket int, data int, version int").parquet(f"{self.path}/manifests")
        except Exception as e:  # noqa: BLE001 - Spark has one error class for a missing path
            if "PATH_NOT_FOUND" in str(e):
                return -1, -1, {}
            raise
        last = found.agg(F.max("version")).first()[0] if version is None else version
        rows = found.where(F.col("version") == F.lit(last)).collect()  # a row for each bucket
        if not rows:
            return -1, -1, {}
        return last, rows[0]["batch"], {r["bucket"]: r["data"] for r in rows if r["bucket"] is not None}

    def _buckets_at(self, where: dict[int, int]) -> DataFrame:
        if not where:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/v={v}/bucket={b}" for b, v in sorted(where.items())])

    def read(self, version: int | None = None) -> DataFrame:
        """All rows as last published, or as of one version that isn't pruned yet."""
        return self._buckets_at(self.manifest(version)[2])

    def upsert(self, rows: DataFrame, batch: int | None = None) -> int:
        """Rows in place of those of their keys that are no later; returns the version, the old one if nothing is to be done.

        Rows with ``gone`` true (a column that may be absent) take their key out.  ``batch`` is the
        number of a stream's batch: one that was published already changes nothing.  Null keys are keys.
        """
        version, done, where = self.manifest()
        if batch is not None and batch <= done:
            return version
        names = [f.name for f in self.spark.createDataFrame([], self.schema).schema.fields]
        gone = F.coalesce(F.col("gone"), F.lit(False)) if "gone" in rows.columns and "gone" not in names else F.lit(False)
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int").alias("bucket")
        new = kept(latest(rows.select(*names, gone.alias("_gone")), self.keys, self.order), "upsert")
        touched = {r[0] for r in new.select(bucket).distinct().collect()}  # at most BUCKETS numbers
        if not touched and batch is None:
            return version
        old = self._buckets_at({b: v for b, v in where.items() if b in touched})
        both = old.withColumn("_gone", F.lit(False)).withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
        merged = latest(both, self.keys, [*self.order, "_new"]).where("NOT _gone").select(*names, bucket)
        version += 1
        merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/v={version}")
        left = {r[0] for r in self.spark.read.schema("bucket int").parquet(f"{self.path}/data/v={version}").select("bucket").distinct().collect()} if touched else set()
        where = {b: v for b, v in where.items() if b not in touched} | dict.fromkeys(left, version)
        about = [(done if batch is None else batch, b, v) for b, v in sorted(where.items())] or [(done if batch is None else batch, None, None)]
        self.spark.createDataFrame(about, "batch long, bucket int, data int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifests/version={version}")
        return version

    def prune(self, versions: int = 2) -> int:
        """Deletes data and manifests that none of the last ``versions`` needs; returns how many folders went."""
        last = self.manifest()[0]
        held = {(v, b) for n in range(max(0, last - versions + 1), last + 1) for b, v in self.manifest(n)[2].items()}
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        files = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        went = 0
        for v in range(last + 1):
            for name in (f"manifests/version={v}", *(f"data/v={v}/bucket={b}" for b in range(self.buckets))):
                needed = v > last - versions if name.startswith("manifests") else (v, int(name.rsplit("=", 1)[1])) in held
                if not needed:
                    went += bool(files.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}"), True))
        return went


def upsert_step(table: BucketTable, versions: int = 2):
    """A stream's step that upserts each batch under its number, so that one that comes again changes nothing."""

    def step(rows: DataFrame, number: int) -> None:
        table.upsert(rows, number)
        table.prune(versions)

    return step
