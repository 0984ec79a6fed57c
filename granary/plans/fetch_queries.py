"""Fetching, web results and configuration rules over the given tables, each beside the SQL that gives the same."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from granary.functions import classify as c
from granary.functions import text as t
from granary.operators import evidence as e
from granary.operators import report as rp
from granary.operators import tables as tb
from granary.sources import files

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, d: f(lambda name: spark.read.parquet(f"{d}/{name}.parquet"))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(
    "SELECT page_id, CASE WHEN page_id % 9 = 0 THEN 'api' WHEN page_id % 7 = 0 OR length(html) < 512 THEN 'raw' WHEN page_id % 6 = 0 AND page_id % 4 = 0 THEN 'raw' WHEN page_id % 6 = 0 THEN 'rendered' ELSE 'http' END AS choice, CASE WHEN page_id % 4 = 0 AND page_id % 6 = 0 THEN true ELSE page_id % 5 = 0 END AS pdf, CASE WHEN page_id % 7 = 0 OR length(html) < 512 THEN 'raw' ELSE 'done' END AS route, length(html) >= 512 AND (page_id % 5 = 0 OR page_id % 3 > 0) AS successful, "
    "CASE WHEN page_id % 4 = 0 THEN 'PDF' ELSE 'HTML' END AS kind FROM pages"
)
def fetch_route(table):
    """Which fetcher comes next, whether a fetch was good, and the file type by body, suffix and header."""
    p, html = table("pages"), F.col("html")
    headers = F.create_map(F.lit("Content-TYPE"), F.when(F.col("page_id") % 4 == 0, "Application/PDF").otherwise("Text/HTML; charset=utf-8"))
    status = F.when(F.col("page_id") % 3 == 0, 404).otherwise(200)
    kind = c.content_type(html, t.url_suffix(F.col("url")), t.header_value(headers, "content-type"))
    shell = F.when(F.col("page_id") % 6 == 0, F.concat(F.lit("<html><body><div id='app'></div><!--"), F.lpad(F.lit(""), 600, "-"), F.lit("--></body></html>"))).otherwise(html)
    address = F.when(F.col("page_id") % 4 == 0, F.concat("url", F.lit("/bitstreams/1/content/"))).otherwise(F.col("url"))
    choice = c.reliable_choice(F.when(F.col("page_id") % 9 == 0, F.concat(F.lit("%PDF"), "url")), F.col("page_id") % 7 == 0, shell, address)
    pdf = c.may_be_pdf(F.when(F.col("page_id") % 6 == 0, address).otherwise(F.col("url")), F.when(F.col("page_id") % 5 == 0, "Application/Octet-Stream"))
    return p.select("page_id", choice.alias("choice"), pdf.alias("pdf"), c.fetch_route(html, F.col("url"), F.col("page_id") % 7 == 0).alias("route"), c.successful(html, status, F.col("page_id") % 5 == 0).alias("successful"), kind.alias("kind"))


_ENTRY = "'PK' || chr(1) || chr(2) || repeat('x', 42)"  # an entry of a zip's directory, up to its name
_FILES = f"""CASE page_id % 12 WHEN 0 THEN '%PDF-1.7 ' || url WHEN 1 THEN 'PK' || chr(3) || chr(4) || 'ppt/media' || {_ENTRY} || 'word/document.xml' || {_ENTRY} || 'ppt/slide.xml'
WHEN 2 THEN 'PK' || chr(3) || chr(4) || 'word/media' || {_ENTRY} || 'ppt/slide.xml' WHEN 3 THEN 'PK' || chr(3) || chr(4) || 'word/ and ppt/ in its text' WHEN 4 THEN 'PK' || chr(3) || chr(4) || {_ENTRY} || 'ppt/slide.xml'
WHEN 5 THEN 'PK' || chr(3) || chr(4) || {_ENTRY} || 'word/document.xml' WHEN 6 THEN 'PK' || chr(3) || chr(4) WHEN 7 THEN 'plain ' || url WHEN 8 THEN html ELSE '  ' || html END AS body,
CASE page_id % 12 WHEN 4 THEN 'Application/MSWord' WHEN 5 THEN 'application/vnd.openxmlformats-officedocument.presentationml.presentation' WHEN 6 THEN CASE page_id % 5 WHEN 0 THEN 'application/vnd.ms-powerpoint' ELSE 'application/zip' END WHEN 7 THEN CASE page_id % 5 WHEN 0 THEN 'TEXT/html; charset=x' WHEN 1 THEN 'application/pdf' ELSE 'text/plain' END ELSE '' END AS header,
url || CASE WHEN page_id % 12 = 6 AND page_id % 5 = 1 THEN '.DOCX?x=1' WHEN page_id % 12 = 7 AND page_id % 5 = 3 THEN '.htm#top' ELSE '' END AS address"""


@query(
    f"WITH f AS (SELECT page_id, {_FILES} FROM pages), r AS (SELECT page_id, body, lower(header) AS h, nullif(regexp_extract(lower(regexp_replace(address, '[?#].*$', '')), '\\.(pdf|html|htm|docx|doc|pptx|ppt)$', 1), '') AS s FROM f) "
    "SELECT page_id, CASE WHEN starts_with(body, '%PDF') OR contains(h, 'application/pdf') THEN 'PDF' "
    "WHEN starts_with(body, 'PK') AND (contains(h, 'wordprocessingml') OR contains(h, 'msword') OR s = 'docx') THEN 'DOCX' WHEN starts_with(body, 'PK') AND (contains(h, 'presentationml') OR contains(h, 'ms-powerpoint') OR s = 'pptx') THEN 'PPTX' "
    "WHEN starts_with(body, 'PK') AND regexp_matches(body, 'PK\\x01\\x02x{42}word/') THEN 'DOCX' WHEN starts_with(body, 'PK') AND regexp_matches(body, 'PK\\x01\\x02x{42}ppt/') THEN 'PPTX' "
    "WHEN starts_with(ltrim(lower(body)), '<!doctype') OR contains(substr(ltrim(lower(body)), 1, 512), '<html') OR contains(h, 'text/html') OR s IN ('html', 'htm') THEN 'HTML' END AS kind FROM r"
)
def content_type(table):
    """Files of all kinds by magic, header, suffix and what stands in their zips, made from pages."""
    f = table("pages").select("page_id", *[F.expr(x) for x in _split(_FILES)])
    headers = F.create_map(F.lit("Content-TYPE"), F.col("header"))
    return f.select("page_id", c.content_type(F.col("body"), t.url_suffix(F.col("address")), t.header_value(headers, "content-type")).alias("kind"))


def _split(sql: str) -> list[str]:
    """A select list's three expressions, each ended by its name and a comma at a line's end."""
    return [x.rstrip(",") for x in sql.replace(" AS body,\n", " AS body,\u0000").replace(" AS header,\n", " AS header,\u0000").split("\u0000")]


@query(
    "WITH p AS (SELECT url, min(page_id) AS id, min(html) AS html FROM pages GROUP BY url) "
    "SELECT url, CASE WHEN id % 2 = 0 THEN 'cached' ELSE 'fetched' END AS origin, length(html) AS n_chars, length(html) >= 512 AS successful FROM p"
)
def fetch_cache(table):
    """Half of the pages are cached; only the others are fetched, here from the table itself."""
    p = table("pages").groupBy("url").agg(F.min("page_id").alias("id"), F.min("html").alias("body"))
    cache = p.where("id % 2 = 0").select("url", "body", F.lit(200).alias("status"), F.lit(True).alias("successful"), F.lit("cached").alias("origin"))
    fetch = lambda urls: p.join(urls, "url", "left_semi").select("url", "body", F.lit(200).alias("status"), F.lit("fetched").alias("origin"))
    got, _ = files.fetch_cached(p.select("url"), cache, fetch)
    return got.select("url", "origin", F.length("body").cast("long").alias("n_chars"), (c.successful(F.col("body"), F.col("status"), F.lit(False))).alias("successful"))


@query(
    "WITH f AS (SELECT ['scraped', 'snippet_only', 'scrape_failed', 'bot_detected'][1 + (doc_id % 4)::INT] AS bucket, CASE WHEN doc_id % 12 = 0 THEN '' ELSE 'https://' || source END AS url, text FROM documents) "
    "SELECT bucket, count(DISTINCT CASE WHEN bucket <> 'scraped' THEN NULL WHEN url <> '' AND trim(text) <> '' THEN 'web:' || url || ':' || substr(sha256(text), 1, 16) END) AS sources, count(*) AS found FROM f GROUP BY 1"
)
def web_result(table):
    """Documents as a web search's finds: whole ones become sources once each, other buckets are counted."""
    d = table("documents")
    bucket = F.element_at(F.array(*[F.lit(b) for b in ("scraped", "snippet_only", "scrape_failed", "bot_detected")]), (F.col("doc_id") % 4 + 1).cast("int"))
    found = d.select(bucket.alias("bucket"), F.when(F.col("doc_id") % 12 == 0, "").otherwise(F.concat(F.lit("https://"), "source")).alias("url"), F.lit("t").alias("title"), F.col("text").alias("content"))
    sources, counts = e.web_result(found)
    whole = sources.agg(F.count("*").alias("sources")).select(F.lit("scraped").alias("bucket"), "sources")
    n = found.groupBy("bucket").agg(F.count("*").alias("found"))
    return n.join(whole, "bucket", "left").join(counts, "bucket", "left").select("bucket", F.coalesce("sources", F.lit(0)).alias("sources"), F.coalesce("n", "found").alias("found"))


@query(
    "WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, l_linestatus, l_shipdate FROM lineitem) "
    "SELECT l_returnflag, l_linestatus, count(*) AS rows, count(*) FILTER (WHERE l_returnflag <> 'N' AND l_linestatus <> 'F') AS kept_both, "
    "sum(CASE WHEN l_returnflag = l_linestatus THEN 1 ELSE 2 END)::BIGINT AS entries FROM x GROUP BY ALL"
)
def map_difference(table):
    """Nested maps without a dropped key and without what their parent says too."""
    one = F.create_map(F.lit("flag"), F.col("l_returnflag"), F.lit("status"), F.col("l_linestatus"), F.lit("key_concepts"), F.lit("dropped"))
    parent = F.create_map(F.lit("flag"), F.lit("N"), F.lit("status"), F.lit("F"))
    left = tb.map_difference(one, parent, ("key_concepts",))
    other = tb.map_difference(F.create_map(F.lit("flag"), F.col("l_returnflag"), F.lit("status"), F.col("l_linestatus")), F.create_map(F.lit("flag"), F.col("l_linestatus")))
    li = table("lineitem").select("l_returnflag", "l_linestatus", F.coalesce(F.cardinality(left), F.lit(0)).alias("n"), F.coalesce(F.cardinality(other), F.lit(0)).alias("m"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("rows"), F.count_if(F.col("n") == 2).alias("kept_both"), F.sum(F.col("m").cast("long")).alias("entries"))


@query(
    "WITH x AS (SELECT doc_id, regexp_extract_all(text, '[0-9]+') AS a, contains(text, 'http') OR lang = 'de' AND doc_id % 2 = 0 AS bad FROM documents) "
    "SELECT doc_id, CASE WHEN bad THEN doc_id % 3 = 0 ELSE len(list_distinct(a)) = len(a) END AS ok FROM x"
)
def detection_check(table):
    """The distinct numbers of a text as codes and all of them as spans, or an error; some have an error beside them."""
    numbers = F.regexp_extract_all(F.col("text"), F.lit("[0-9]+"), F.lit(0))
    bad = F.contains("text", F.lit("http")) | ((F.col("lang") == "de") & (F.col("doc_id") % 2 == 0))
    out = ~bad | (F.col("doc_id") % 3 != 0)
    d = table("documents").select("doc_id", F.when(out, F.array_distinct(numbers)).alias("codes"), F.when(out, numbers).alias("spans"), F.when(bad, "failed").alias("error"))
    return d.select("doc_id", e.detections_ok(F.col("codes"), F.col("spans"), F.col("error")).alias("ok"))


@query(
    "SELECT DISTINCT 'https://example.org/search?q=' || replace(replace(replace(url_encode(p_name || ' ' || p_type), '+', '%20'), '*', '%2A'), '%7E', '~') || '&brand=' || url_encode(p_brand) AS url FROM part UNION SELECT DISTINCT 'https://example.org/' || url_encode(p_brand) FROM part"
)
def expand_search_urls(table):
    """A brand's address with a placeholder, once for each of its searches, and one without searches."""
    search = F.concat(t.percent_encode(F.concat_ws(" ", "p_name", "p_type")), F.lit("&brand="), t.percent_encode(F.col("p_brand")))
    b = table("part").groupBy("p_brand").agg(F.collect_set(search).alias("searches"))
    some = b.select(F.explode(t.expanded_urls(F.lit("https://example.org/search?q={search}"), F.col("searches"))).alias("url"))
    return some.union(b.select(F.explode(t.expanded_urls(F.concat(F.lit("https://example.org/"), t.percent_encode(F.col("p_brand"))), F.lit(None).cast("array<string>"))))).distinct()


@query(
    "WITH m AS (SELECT p_brand, list(p_name ORDER BY p_partkey) AS ms FROM part GROUP BY 1), s AS (SELECT p_brand, unnest([3, 1, 3]) AS n, unnest([1, 2, 3]) AS ordinal, ms FROM m) SELECT p_brand, ordinal, ms[n] AS metric FROM s"
)
def select_metrics(table):
    """Metrics by position from 1, in the order asked for, repeats kept."""
    m = table("part").select("p_brand", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")).alias("n"), F.col("p_name").alias("metric"))
    asked = m.select("p_brand").distinct().select("p_brand", F.posexplode(F.array(F.lit(3), F.lit(1), F.lit(3))).alias("i", "n"))
    return rp.selected(m, "p_brand", "n", asked, strict=False).select("p_brand", (F.col("i") + 1).alias("ordinal"), "metric")


_UUID = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12)"


@query(f"SELECT page_id, CASE WHEN page_id % 3 > 0 THEN 'https://files.example.org/server/api/core/bitstreams/' || {_UUID} || '/content' END AS content_url FROM (SELECT page_id, sha256(url) AS h FROM pages)")
def bitstream_url(table):
    """Viewer addresses of files, one third of them not of that form, to content addresses."""
    h = F.sha2(F.col("url").cast("binary"), 256)
    uuid = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    tail = F.when(F.col("page_id") % 3 == 0, "/view").when(F.col("page_id") % 3 == 1, "/download?x=1").otherwise("/content")
    return table("pages").select("page_id", t.bitstream_url(F.concat(F.lit("http://www.files.example.org/bitstreams/"), uuid, tail), "files.example.org").alias("content_url"))
