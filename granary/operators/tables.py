"""Relational pieces of the evidence store: latest rows, upserts, zips, islands, first-seen, sets and merges."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order`` (which must be unique within a key).

    An aggregate, so tasks send one row a key on, however long a key's history is.
    """
    rest = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")
    return df.groupBy(*keys).agg(last).select(*keys, "_last.*")


def first_seen(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")).select(*keys, "_first.*")


def completed_prefix(df: DataFrame, key: str, step: str, done: Column) -> DataFrame:
    """Steps of each key before its first one that isn't done."""
    w = Window.partitionBy(key).orderBy(step).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("_ok", F.min(F.when(done, 1).otherwise(0)).over(w)).where("_ok = 1").drop("_ok")


def page_ranges(df: DataFrame, key: str, page: str, name: str = "pages") -> DataFrame:
    """'1-3, 5, 7-8' of each key's distinct pages: islands of consecutive numbers."""
    w = Window.partitionBy(key).orderBy(page)
    island = df.select(key, page).where(F.col(page).isNotNull()).distinct().withColumn("_i", F.col(page) - F.row_number().over(w))
    runs = island.groupBy(key, "_i").agg(F.min(page).alias("a"), F.max(page).alias("b"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", "a", "b"))
    joined = F.concat_ws(", ", F.transform(F.array_sort(F.collect_list(F.struct("a", text.alias("t")))), lambda x: x["t"]))
    return runs.groupBy(key).agg(joined.alias(name))


def grouped_pages(parts: Iterable[DataFrame], key: str, page: str) -> DataFrame:
    """Pages of each trimmed, non-empty key over all parts, sorted and distinct; keys without pages stay."""
    both = None
    for p in parts:
        p = p.select(F.trim(F.col(key).cast("string")).alias(key), F.col(page).alias(page)).where(F.col(key) != "")
        both = p if both is None else both.unionByName(p)
    return both.groupBy(key).agg(F.array_sort(F.collect_set(page)).alias("pages"))


def upsert_pages(now: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, source, pages) merged: page sets united, a missing source filled in, unmatched rows of either side kept."""
    b = new.select(key, F.col("source").alias("_s"), F.col("pages").alias("_p"))
    pages = F.array_sort(F.array_union(F.coalesce("pages", F.expr("cast(array() AS array<int>)")), F.coalesce("_p", F.expr("cast(array() AS array<int>)"))))
    return now.join(b, key, "full_outer").select(key, F.coalesce("source", "_s").alias("source"), pages.alias("pages"))


def zip_checked(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> tuple[DataFrame, DataFrame]:
    """Rows of both sides by (key, at); and (key, n_left, n_right) of keys whose numbers of rows differ, which are left out."""
    n = left.groupBy(key).agg(F.count("*").alias("n_left")).join(right.groupBy(key).agg(F.count("*").alias("n_right")), key, "full_outer")
    n = n.na.fill(0, ["n_left", "n_right"])
    bad = n.where("n_left != n_right")
    good = left.join(n.where("n_left = n_right").select(key), key, "left_semi").join(right.select(key, at, value), [key, at])
    return good, bad


def get_or_create(known: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows of ``wanted`` whose key isn't known yet, once each."""
    return wanted.dropDuplicates([key]).join(known.select(key), key, "left_anti")


def replace_rows(now: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``now`` with all rows of the keys in ``new`` replaced by ``new``'s."""
    return now.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def resolve_sources(defaults: Column, own: Column) -> Column:
    """Arrays of (name, exclusive): only the exclusive ones if there are any, else defaults and own ones."""
    return F.when(F.exists(own, lambda x: x["exclusive"]), F.filter(own, lambda x: x["exclusive"])).otherwise(F.concat(defaults, own))


def map_difference(nested: Column, parent: Column, dropped: tuple[str, ...] = ()) -> Column:
    """A nested map without the dropped keys and without entries equal to the parent's; null if nothing is left."""
    left = F.map_filter(nested, lambda k, v: ~k.isin(*dropped or ("",)) & ~F.coalesce(F.element_at(parent, k).eqNullSafe(v) & F.map_contains_key(parent, k), F.lit(False)))
    return F.when(F.cardinality(left) > 0, left)


def unpivoted(df: DataFrame, ids: list[str], years: list[str]) -> DataFrame:
    """Wide year columns to (ids, year, value), blanks left out."""
    return df.unpivot(ids, years, "year", "value").where("value IS NOT NULL").withColumn("year", F.col("year").cast("int"))


def year_between(year: Column, start: int | None, end: int | None, first: int = 1960, last: int | None = None) -> Column:
    """Inclusive range, an open start being ``first`` and an open end ``last`` or this year; all years if both are open; ValueError if it is turned round."""
    last = datetime.now(UTC).year if last is None else last
    if start is None and end is None:
        return F.lit(True)
    a, b = first if start is None else start, last if end is None else end
    if a > b:
        raise ValueError(f"start year {a} is after end year {b}")
    return year.between(a, b)


def chunked(docs: DataFrame, key: str, text: str, keep_blank: bool = False) -> DataFrame:
    """(key, chunk_index, chunk_text): a document's lines as chunks; blank ones go unless they are kept, and the index counts them all the same."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n", -1)).alias("chunk_index", "chunk_text"))
    return lines if keep_blank else lines.where(F.regexp_like("chunk_text", F.lit(r"\S")))


def status_report(results: DataFrame, keys: list[str], order: list[str], by: str, status: str, error: str) -> DataFrame:
    """(by, ok, errors, others, messages): the latest result of each key, counted, with the distinct errors in order."""
    last = latest(results, keys, order)
    s = F.col(status)
    return last.groupBy(by).agg(F.count_if(s == "completed").alias("ok"), F.count_if(s == "failed").alias("errors"), F.count_if(~s.isin("completed", "failed")).alias("others"), F.array_sort(F.collect_set(F.when(s == "failed", F.col(error)))).alias("messages"))


def completed(results: DataFrame, key: str, step: str, seq: str, steps: int) -> DataFrame:
    """(key, done): whether the latest result of each of a document's ``steps`` steps is completed."""
    last = latest(results.select(key, step, seq, "status"), [key, step], [seq])
    return last.groupBy(key).agg((F.count_if(F.col("status") == "completed") == steps).alias("done"))


def corpus_counts(docs: DataFrame, source: str, kind: str, text: str, size: str) -> DataFrame:
    """(source, kind, chunks, texts, chars): rows, distinct texts (by 128 bits of each) and characters; a missing source is '(none)'."""
    return docs.groupBy(F.coalesce(source, F.lit("(none)")).alias(source), kind).agg(F.count("*").alias("chunks"), F.countDistinct(F.md5(F.col(text).cast("binary"))).alias("texts"), F.sum(size).alias("chars"))
