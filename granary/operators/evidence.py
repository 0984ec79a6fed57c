"""Claims, quotations, citations and statements: validation rules as set-based steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.text import casefold, country_key, example_leaked, normalize_query, normalize_quote, numbered, quote_match, short_country, too_broad

#: What counts as a quantity in a statement (fixed values); a year alone doesn't.
QUANTITIES = (
    r"\d+(?:[.,]\d+)?\s*%",
    r"\d+(?:[.,]\d+)?\s*(?:percent|per\s*cent)\b",
    r"\d+(?:[.,]\d+)?\s*(?:ha\b|hectares?\b|acres?\b|km²|km2\b)",
    r"\d+(?:[.,]\d+)?\s*(?:tonnes?\b|tons?\b|kg\b|mt\b)",
    r"\d+(?:[.,]\d+)?\s*(?:million|billion)\b",
    r"(?:fell|rose|increased|decreased|declined|dropped|grew|lost|loss(?:es)?)\s+(?:by\s+)?\d",
    r"\d+(?:[.,]\d+)?\s*(?:heads?\b|animals?\b|cattle\b|livestock\b|people\b|farmers?\b|households?\b)",
)


def quantitative(text: Column) -> Column:
    """Whether a statement holds a quantity."""
    return F.regexp_like(text, F.lit("(?i)" + "|".join(QUANTITIES)))


def country_implied(query: Column, name: Column, iso3: Column) -> Column:
    """The code, the name or its part before a comma or bracket stands in a query, whatever the case."""
    q, short = casefold(query), short_country(name)
    return F.contains(q, casefold(iso3)) | F.contains(q, casefold(name)) | ((short != "") & F.contains(q, short))


def filter_queries(queries: DataFrame, executed: DataFrame, country: Column, iso3: Column, open_gaps: Column | None = None) -> DataFrame:
    """(batch, pos, query) worth asking: not empty, naming the country, three words or more, not asked before.

    With ``open_gaps`` (an array) a query must also have target_gap_ids (a column), and one of those
    that are open unless none is.  A column purpose is "coverage" where blank.  Only accepted ones
    count as seen, so the dedupe comes after the other filters.
    """
    q = queries.withColumn("norm", normalize_query(F.col("query")))
    q = q.where((F.col("norm") != "") & ~too_broad(F.col("query")) & country_implied(F.col("query"), country, iso3))
    if open_gaps is not None:
        some = F.coalesce(F.size("target_gap_ids"), F.lit(0)) > 0
        q = q.where(some & ((F.size(open_gaps) == 0) | F.arrays_overlap("target_gap_ids", open_gaps)))
    q = q.join(executed.select(normalize_query(F.col("query")).alias("norm")).distinct(), "norm", "left_anti")
    w = Window.partitionBy("batch", "norm").orderBy("pos")
    q = q.withColumn("_n", F.row_number().over(w)).where("_n = 1").withColumn("query", F.trim("query"))
    more = [c for c in ("target_gap_ids",) if c in q.columns]
    purpose = [F.coalesce(F.nullif(F.trim("purpose"), F.lit("")), F.lit("coverage")).alias("purpose")] if "purpose" in q.columns else []
    return q.select("batch", "pos", "query", *purpose, *more)


def validate_mentions(mentions: DataFrame, texts: DataFrame, countries: DataFrame) -> DataFrame:
    """(id, pos, substring, official_name) with iso3 and reasons: empty, not in the text, unknown country; valid where there are none.

    Names meet the country table (name, iso3) with and without a leading article.
    """
    dim = countries.select(country_key(F.col("name")).alias("_k"), F.col("iso3").alias("_iso"))
    m = mentions.withColumn("_k1", country_key(F.col("official_name"))).withColumn("_k2", F.regexp_replace("_k1", "^the ", ""))
    m = m.join(dim.select(F.col("_k").alias("_k1"), F.col("_iso").alias("_i1")), "_k1", "left").join(dim.select(F.col("_k").alias("_k2"), F.col("_iso").alias("_i2")), "_k2", "left")
    m = m.join(texts.select("id", "text"), "id", "left").withColumn("iso3", F.coalesce("_i1", "_i2"))
    blank = F.trim("substring") == ""
    reasons = F.array_compact(F.array(F.when(blank, "empty"), F.when(~blank & ~F.coalesce(F.contains("text", "substring"), F.lit(False)), "not_in_text"), F.when(F.col("iso3").isNull(), "unknown_country")))
    return m.select("id", "pos", "substring", "official_name", "iso3", reasons.alias("reasons"))


def validate_claims(claims: DataFrame, sources: DataFrame, known: DataFrame, example: Column) -> DataFrame:
    """Claims (batch, pos, source_id, quote, country_specific) with match, reason and claim_id.

    The first reason that applies, in this order: unknown_source_id, substring_validation_failed,
    not_country_specific, duplicate_claim, metric_example_leak (the example stands in the quotation).
    A claim's fingerprint is its source and normal quotation; it is a duplicate of known ones and of
    the first that is accepted, not of leaked ones before that.  Numbers go to claims that pass all but
    the last rule, so a leaked example uses up its number.
    """
    c = claims.join(sources.select("source_id", F.col("text").alias("_source")), "source_id", "left")
    c = c.withColumn("match", quote_match(F.col("quote"), F.col("_source"))).withColumn("_f", F.concat_ws("::", "source_id", normalize_quote(F.col("quote"))))
    c = c.join(known.select(F.col("fingerprint").alias("_f"), F.lit(True).alias("_known")).distinct(), "_f", "left")
    early = F.when(F.col("_source").isNull(), "unknown_source_id").when(F.col("match").isNull(), "substring_validation_failed").when(~F.col("country_specific"), "not_country_specific")
    c = c.withColumn("_early", early).withColumn("_leak", example_leaked(F.col("quote"), example))
    fine = F.col("_early").isNull() & ~F.col("_leak")
    first = F.min(F.when(fine, F.col("pos"))).over(Window.partitionBy("_f"))
    c = c.withColumn("_dup", F.coalesce(F.col("_known"), F.col("pos") > first, F.lit(False)))
    c = c.withColumn("reason", F.coalesce("_early", F.when(F.col("_dup"), "duplicate_claim").when(F.col("_leak"), "metric_example_leak")))
    counted = c.where(F.col("reason").isNull() | (F.col("reason") == "metric_example_leak"))
    run = Window.partitionBy("batch").orderBy("pos")
    ids = counted.select("batch", "pos", F.row_number().over(run).alias("n"))
    out = c.join(ids, ["batch", "pos"], "left")
    return out.select("batch", "pos", "source_id", "match", "reason", F.when(F.col("reason").isNull(), numbered("claim", F.col("n"))).alias("claim_id"))


def resolve_citations(statements: DataFrame, claims: DataFrame, sources: DataFrame) -> DataFrame:
    """(statement_id, citations): statements' claims to sources, first-seen order, one for each (uri, page)."""
    each = statements.select("statement_id", F.posexplode("claim_ids").alias("i", "claim_id"))
    cited = each.join(claims.select("claim_id", "source_id"), "claim_id").join(sources.select("source_id", "uri", "page"), "source_id")
    first = cited.groupBy("statement_id", "uri", "page").agg(F.min("i").alias("i"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("i", "uri", "page"))), lambda x: F.concat_ws("#", x["uri"], x["page"].cast("string")))
    return first.groupBy("statement_id").agg(ordered.alias("citations"))


def next_action(has_claims: Column, left: Column, said: Column) -> Column:
    """What a research round does next: the model's word, corrected by what there is."""
    stop, draft, more = "return_insufficient_evidence", "draft_answer", "generate_more_queries"
    return (
        F.when(has_claims & (said == stop), draft)
        .when(has_claims & (left <= 0) & (said == more), draft)
        .when(~has_claims & (left <= 0) & said.isin(more, draft), stop)
        .when(~has_claims & (left > 0) & (said == draft), more)
        .otherwise(said)
    )


def verdict_action(verdict: Column, attempt: Column, most: Column) -> Column:
    """keep, repair or drop a statement after one more look."""
    last = attempt >= most
    return F.when(verdict == "entailed", "keep").when((verdict == "partially_entailed") & last, "keep").when(last, "drop").otherwise("repair")


def answer_status(statements: DataFrame, key: str, text: str) -> DataFrame:
    """cannot_answer without statements, answered with a quantity in one, else high_level_answer."""
    hit = quantitative(F.col(text))
    return statements.groupBy(key).agg(F.when(F.count(text) == 0, "cannot_answer").when(F.bool_or(hit), "answered").otherwise("high_level_answer").alias("status"))


def detections_ok(codes: Column, spans: Column, error: Column) -> Column:
    """Exactly one of codes with as many spans, or an error."""
    both = codes.isNotNull() & spans.isNotNull()
    return (both & error.isNull() & (F.size(codes) == F.size(spans))) | (codes.isNull() & spans.isNull() & error.isNotNull())


def web_result(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bucket, url, title, content) of a web search: sources that were scraped whole, once each, and counts of the other buckets."""
    sid = F.concat_ws(":", F.lit("web"), "url", F.substring(F.sha2(F.col("content").cast("binary"), 256), 1, 16))
    fine = (F.col("bucket") == "scraped") & (F.trim(F.coalesce("url", F.lit(""))) != "") & (F.trim(F.coalesce("content", F.lit(""))) != "")
    sources = found.where(fine).withColumn("source_id", sid).groupBy("source_id").agg(F.min(F.struct("url", "title", "content")).alias("s")).select("source_id", "s.*")
    return sources, found.where("bucket != 'scraped'").groupBy("bucket").agg(F.count("*").alias("n"))
