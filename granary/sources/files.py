"""Readers and writers beyond plain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.classify import successful
from granary.operators.store import kept
from granary.operators.tables import map_difference, resolve_sources

_SOURCE = "struct<name string, exclusive boolean>"
USE_CASE = f"name string, description string, data_sources array<{_SOURCE}>, metrics array<struct<name string, description string, example string, unit string, data_sources array<{_SOURCE}>>>"


def use_case(spark: SparkSession, path: str) -> DataFrame:
    """Metrics of a use-case file in order: (use_case, n, name, description, example, unit, sources); a file without a name is called by its own.

    Sources are the metric's exclusive ones, or else the file's and the metric's own.
    """
    raw = spark.read.schema(USE_CASE).option("multiLine", True).option("mode", "FAILFAST").json(path)
    none = F.expr(f"cast(array() AS array<{_SOURCE}>)")
    plain = lambda c: F.transform(F.coalesce(c, none), lambda x: F.named_struct(F.lit("name"), x["name"], F.lit("exclusive"), F.coalesce(x["exclusive"], F.lit(False))))
    stem = F.regexp_replace(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1), r"\.[^.]*$", "")
    title = F.coalesce(F.nullif(F.trim("name"), F.lit("")), stem)
    m = raw.select(title.alias("use_case"), plain(F.col("data_sources")).alias("defaults"), F.posexplode("metrics").alias("i", "m"))
    sources = F.transform(resolve_sources(F.col("defaults"), plain(F.col("m.data_sources"))), lambda x: x["name"])
    return m.select("use_case", (F.col("i") + 1).alias("n"), "m.name", "m.description", "m.example", "m.unit", sources.alias("sources"))


def report_files(spark: SparkSession, folder: str) -> DataFrame:
    """(name, text) of the files NNNN.md in a folder."""
    files = spark.read.option("pathGlobFilter", "[0-9][0-9][0-9][0-9].md").text(folder, wholetext=True)
    return files.select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("name"), F.col("value").alias("text"))


#: A document's titles, the first that is there counts, and bulky fields that aren't kept (fixed values).
TITLES = ("title", "title_english", "title_original", "subtitle_english", "subtitle_original")
DROPPED = ("key_concepts", "organizations")


def external_document(raw: DataFrame) -> DataFrame:
    """JSON text of a fetched document (document_id, body) -> one row a page, or one with error.

    (document_id, url, title, metadata, nested, page_no, text, error).  The id must match and
    document, handle_url, a title and chunks must be there; pages count from 1.  metadata and nested
    (its own entry "metadata") are maps of JSON text without bulky fields, and nested without what
    the metadata say too; null where nothing is left.
    """
    shape = "document_id string, document map<string,string>, chunks array<struct<content string>>"
    d = raw.select("document_id", F.from_json("body", shape).alias("d")).withColumn("m", F.col("d.document"))
    own = lambda k: F.nullif(F.element_at("m", k), F.lit(""))
    title = F.coalesce(*[own(k) for k in TITLES])
    error = (
        F.when(~F.col("d.document_id").eqNullSafe(F.col("document_id")), "document_id differs")
        .when(F.coalesce(F.cardinality("m"), F.lit(0)) < 1, "document missing")
        .when(own("handle_url").isNull(), "handle_url missing")
        .when(title.isNull(), "title missing")
        .when(F.coalesce(F.size("d.chunks"), F.lit(0)) < 1, "chunks missing")
    )
    top = F.map_filter("m", lambda k, _: ~k.isin(*DROPPED, "metadata"))
    nested = map_difference(F.from_json(F.element_at("m", "metadata"), "map<string,string>"), F.col("metadata"), DROPPED)
    d = d.select("document_id", own("handle_url").alias("url"), title.alias("title"), "m", F.when(F.cardinality(top) > 0, top).alias("metadata"), error.alias("error"), F.when(error.isNull(), F.col("d.chunks")).alias("pages"))
    d = d.withColumn("nested", nested)
    rows = d.select("document_id", "url", "title", "metadata", "nested", "error", F.posexplode_outer("pages").alias("i", "c"))
    return rows.select("document_id", "url", "title", "metadata", "nested", (F.col("i") + 1).alias("page_no"), F.when(F.col("i").isNotNull(), F.coalesce("c.content", F.lit(""))).alias("text"), "error")


def write_reports(reports: DataFrame, folder: str) -> None:
    """(number, text) -> files NNNN.md in a folder that all executors share (a local path or any file system that pyarrow knows); each task writes its own."""

    def write(rows) -> None:
        from pyarrow import fs

        held, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        held.create_dir(base, recursive=True)
        for r in rows:
            with held.open_output_stream(f"{base.rstrip('/')}/{r.number:04d}.md") as f:
                f.write((r.text or "").encode("utf-8"))

    reports.select("number", "text").foreachPartition(write)


def write_bodies(bodies: DataFrame, folder: str) -> DataFrame:
    """(id, body as text or bytes, suffix) -> (id, path): every body in a file <folder>/<id><suffix>, written by the task that holds it.

    Null bodies are written as empty files; ids that repeat leave the last one written.
    """
    schema = "id string, path string"

    def write(batches):
        import pyarrow as pa
        from pyarrow import fs

        held, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        held.create_dir(base, recursive=True)
        for batch in batches:
            paths = []
            for i, body, suffix in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                with held.open_output_stream(f"{base.rstrip('/')}/{i}{suffix or ''}") as f:
                    f.write(body or b"")
                paths.append(f"{folder.rstrip('/')}/{i}{suffix or ''}")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.string())], ["id", "path"])

    given = bodies.select(F.col("id").cast("string").alias("id"), F.col("body").cast("binary").alias("body"), F.col("suffix").cast("string").alias("suffix"))
    return kept(given.mapInArrow(write, schema), "bodies")


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Replace whole documents in a table partitioned by a hash of document_id: only touched partitions are rewritten.

    Rows of other documents in a touched partition are carried over; the new files are complete
    before the old ones go, so a failed run changes nothing.
    """
    spark = chunks.sparkSession
    new = chunks.withColumn("part", F.pmod(F.xxhash64("document_id"), F.lit(64)).cast("int"))
    try:
        old = spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        new.write.partitionBy("part").parquet(path)
        return
    keep = old.join(new.select("part").distinct(), "part", "left_semi").join(new.select("document_id").distinct(), "document_id", "left_anti")
    both = keep.select(*chunks.columns, "part").unionByName(new)
    kept(both).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def fetch_cached(wanted: DataFrame, cache: DataFrame, fetch) -> tuple[DataFrame, DataFrame]:
    """Bodies for wanted urls: cached successes first, ``fetch`` (urls -> url, body, status) for the rest; (results, new cache)."""
    known = cache.where("successful")
    miss = wanted.select("url").distinct().join(known.select("url"), "url", "left_anti")
    # fetched once: both results read what was stored
    got = kept(fetch(miss).withColumn("successful", successful(F.col("body"), F.col("status"), F.lit(False))), "fetched")
    fresh = cache.join(got.select("url"), "url", "left_anti").unionByName(got.select(*cache.columns))
    return wanted.join(fresh, "url", "left"), fresh
