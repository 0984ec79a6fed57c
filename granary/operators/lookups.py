"""Lookups in the evidence store: documents, chunks, sources and countries by their keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chunks_of(chunks: DataFrame, wanted: DataFrame, key: str = "document_id") -> DataFrame:
    """All chunks of the wanted documents; which are ordered by their index when read."""
    return chunks.join(wanted.select(key).distinct(), key, "left_semi")


def documents_of(tasks: DataFrame, documents: DataFrame) -> DataFrame:
    """(task_id, document_id, url, source) -> (task_id, found): a task's document by its id, or without one by url and source, nulls being alike.

    Of several documents of one url and source the one with the smallest id counts; null if there is none.
    """
    d = documents.select(F.col("document_id").alias("found"), F.col("url").alias("_u"), F.col("source").alias("_s"))
    named = tasks.where("document_id IS NOT NULL").join(d.select("found").distinct(), F.col("document_id") == F.col("found"), "left").select("task_id", "found")
    first = d.groupBy("_u", "_s").agg(F.min("found").alias("found"))
    by_url = tasks.where("document_id IS NULL").join(first, (F.col("url") == F.col("_u")) & F.col("source").eqNullSafe(F.col("_s")), "left").select("task_id", "found")
    return named.union(by_url)


def by_url(wanted: DataFrame, documents: DataFrame) -> DataFrame:
    """(url) -> (url, document_id): the first document of an address, whatever its source."""
    first = documents.groupBy("url").agg(F.min("document_id").alias("document_id"))
    return wanted.select("url").distinct().join(first, "url")


def completed_pages(results: DataFrame, pages: DataFrame) -> DataFrame:
    """(document_id, stage, seq, status, version_id) and (version_id, document_id, page_no, text) -> (document_id, page_no, text, error).

    Pages of each document's latest completed result; a document without one, or whose result has no
    pages, has one row with an error.
    """
    done = results.where("status = 'completed'").groupBy("document_id").agg(F.max_by("version_id", "seq").alias("version_id"))
    every = results.select("document_id").distinct().join(done, "document_id", "left")
    met = every.join(pages, ["document_id", "version_id"], "left")
    error = F.when(F.col("version_id").isNull(), "no completed result").when(F.col("page_no").isNull(), "no pages")
    return met.select("document_id", "page_no", "text", error.alias("error"))


def largest(rows: DataFrame, key: str, body: str, seq: str) -> DataFrame:
    """(key, seq, size): each key's largest body, the later of equals."""
    size = F.length(F.col(body))
    return rows.groupBy(key).agg(F.max(F.struct(size.alias("size"), F.col(seq).alias("seq"))).alias("_m")).select(key, F.col("_m.seq").alias(seq), F.col("_m.size").alias("size"))


def best_title(items: DataFrame, key: str, text: str, rank: str, pos: str, fallback: Column | None = None) -> DataFrame:
    """(key, title): the text of the highest heading (lowest rank), the longest of those, the first of equals; blank ones and rows without a rank don't count."""
    clean = F.trim(F.regexp_replace(text, r"\s+", " "))
    fit = F.col(rank).isNotNull() & (clean != "")
    best = F.max_by(clean, F.when(fit, F.struct(-F.col(rank), F.length(clean), -F.col(pos))))
    some = F.coalesce(best, fallback) if fallback is not None else best
    return items.groupBy(key).agg(some.alias("title"))


def chunk_refs(chunks: DataFrame) -> DataFrame:
    """Found chunks as sources: (source_id, source_type, document_id, chunk_index, uri, name, page, origin, text); pages count from 1, a missing title is the address."""
    return chunks.select(
        F.concat_ws(":", F.lit("vs"), F.col("document_id").cast("string"), F.col("chunk_index").cast("string")).alias("source_id"),
        F.lit("vectorstore").alias("source_type"),
        F.col("document_id").cast("string").alias("document_id"),
        F.col("chunk_index").cast("int").alias("chunk_index"),
        F.col("url").alias("uri"),
        F.coalesce(F.nullif(F.col("title"), F.lit("")), "url").alias("name"),
        (F.col("chunk_index") + 1).cast("int").alias("page"),
        F.col("source").alias("origin"),
        F.col("chunk_text").alias("text"),
    )


def web_refs(sources: DataFrame) -> DataFrame:
    """Web pages as sources, in the same columns."""
    none = F.lit(None)
    return sources.select("source_id", F.lit("web").alias("source_type"), none.cast("string").alias("document_id"), none.cast("int").alias("chunk_index"), F.col("url").alias("uri"), F.coalesce(F.nullif(F.col("title"), F.lit("")), "url").alias("name"), none.cast("int").alias("page"), none.cast("string").alias("origin"), F.col("content").alias("text"))


def source_table(chunks: DataFrame, web: DataFrame) -> DataFrame:
    """Both kinds of sources, one row for each source_id; a web page takes the place of a chunk of its name."""
    both = chunk_refs(chunks).withColumn("_o", F.lit(0)).unionByName(web_refs(web).withColumn("_o", F.lit(1)))
    rest = [c for c in both.columns if c not in ("source_id", "_o")]
    return both.groupBy("source_id").agg(F.max_by(F.struct(*rest), "_o").alias("_r")).select("source_id", "_r.*")


def new_sources(found: DataFrame, known: DataFrame, order: list[str], key: str = "source_id") -> DataFrame:
    """Finds that aren't known yet, the first of each key."""
    rest = [c for c in found.columns if c != key]
    first = found.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_f")).select(key, "_f.*")
    return first.join(known.select(key), key, "left_anti")


def two_letter_codes(codes: DataFrame, dimension: DataFrame, code: str = "iso3") -> DataFrame:
    """Adds iso2: the two-letter code of a three-letter one in any case; dimension: (iso3, iso2).  An unknown code, or one without, is an error."""
    dim = dimension.select(F.upper("iso3").alias("_c"), F.nullif(F.trim("iso2"), F.lit("")).alias("iso2"))
    met = codes.withColumn("_c", F.upper(code)).join(dim, "_c", "left").drop("_c")
    fail = F.raise_error(F.concat(F.lit("no two letters for "), F.coalesce(F.col(code), F.lit("null"))))
    return met.withColumn("iso2", F.coalesce("iso2", fail.cast("string")))


def country_names(codes: DataFrame, dimension: DataFrame, code: str = "iso3", strict: bool = True) -> DataFrame:
    """Adds country: the official name of a code in any case, or its plain name; dimension: (iso3, name, official).

    An unknown code is an error, or with ``strict`` off a null.
    """
    dim = dimension.select(F.upper("iso3").alias("_c"), F.coalesce("official", "name").alias("country"))
    met = codes.withColumn("_c", F.upper(code)).join(dim, "_c", "left").drop("_c")
    if not strict:
        return met
    fail = F.raise_error(F.concat(F.lit("unknown country "), F.coalesce(F.col(code), F.lit("null"))))
    return met.withColumn("country", F.coalesce("country", fail.cast("string")))
