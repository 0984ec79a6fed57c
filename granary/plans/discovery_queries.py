"""Walks, titles, addresses and names over the given tables, each beside the SQL that gives the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import discovery as dc
from granary.operators import embedding as em
from granary.operators import graph as g
from granary.operators import names as nm
from granary.operators import tables as tb
from granary.sources import links as ls

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
    "WITH RECURSIVE e AS (SELECT 'n' || c_nationkey AS src, 'c' || c_custkey AS dst, c_custkey::BIGINT AS pos FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey, o_orderkey::BIGINT FROM orders "
    "UNION ALL SELECT 'c' || min(c_custkey), 'n' || (c_nationkey + 1), 0 FROM customer GROUP BY c_nationkey), "
    "w AS (SELECT * FROM (VALUES ('n20', 1, 'n20', 0, []::BIGINT[]), ('n10', 2, 'n10', 0, []::BIGINT[]), ('n12', 3, 'n12', 0, []::BIGINT[])) AS s(seed, o, node, depth, key) UNION ALL "
    "SELECT seed, o, e.dst, depth + 1, list_append(key, e.pos) FROM w JOIN e ON w.node = e.src WHERE e.dst NOT LIKE 'n%' OR substr(e.dst, 2)::INT < 25), "
    "f AS (SELECT * FROM w WHERE node LIKE 'o%' QUALIFY row_number() OVER (PARTITION BY node ORDER BY o, depth, key) = 1) "
    "SELECT seed, node AS file, depth, row_number() OVER (ORDER BY o, depth, key) - 1 AS n FROM f"
)
def files_in_order(table):
    """Orders as files that nations lead to over their customers, in order of discovery; a nation's first customer links to the next nation."""
    s = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    c, o = table("customer"), table("orders")
    first = c.groupBy("c_nationkey").agg(F.min("c_custkey").alias("c_custkey"))
    edges = c.select(s("n", "c_nationkey").alias("src"), s("c", "c_custkey").alias("dst"), F.col("c_custkey").cast("long").alias("pos"))
    edges = edges.union(o.select(s("c", "o_custkey"), s("o", "o_orderkey"), F.col("o_orderkey").cast("long")))
    edges = edges.union(first.select(s("c", "c_custkey"), F.concat(F.lit("n"), (F.col("c_nationkey") + 1).cast("string")), F.lit(0).cast("long")))
    nodes = table("nation").select(s("n", "n_nationkey").alias("url"), F.lit("page").alias("kind")).union(c.select(s("c", "c_custkey"), F.lit("page"))).union(o.select(s("o", "o_orderkey"), F.lit("file")))
    seeds = table("nation").where("n_nationkey IN (10, 12, 20)").select(s("n", "n_nationkey").alias("seed"), F.expr("CASE n_nationkey WHEN 20 THEN 1 WHEN 10 THEN 2 ELSE 3 END").alias("pos"))
    return dc.files_reached(edges, nodes, seeds)


_FOREST = "o_orderkey AS url, CASE WHEN o_orderkey >= 3 THEN o_orderkey DIV 3 END AS parent, CASE o_orderkey % 7 WHEN 3 THEN o_orderpriority WHEN 4 THEN ' ' END AS title"


@query(
    f"WITH RECURSIVE p AS (SELECT {_FOREST.replace(' DIV ', ' // ')} FROM orders), w(url, title, lft) AS (SELECT url, NULL::VARCHAR, 0 FROM p WHERE parent IS NULL OR parent NOT IN (SELECT url FROM p) UNION ALL "
    "SELECT c.url, CASE WHEN trim(a.title) <> '' THEN a.title WHEN lft > 1 THEN w.title END, CASE WHEN trim(a.title) <> '' THEN 3 WHEN lft > 1 THEN lft - 1 ELSE 0 END FROM w JOIN p a USING (url) JOIN p c ON c.parent = w.url) SELECT url, title, lft AS left_levels FROM w"
)
def titles_inherited(table):
    """Orders as pages in a forest by their numbers, a seventh with titles that last three levels."""
    pages = table("orders").select(*[F.expr(x) for x in _FOREST.split(", ")])
    return dc.inherited_titles(pages, 3).withColumnRenamed("left", "left_levels")




@query(
    "WITH l AS (SELECT url, i - 1 AS pos, h[i] AS href FROM (SELECT url, regexp_extract_all(html, '(?i)<a\\s[^>]*href\\s*=\\s*[\"'']([^\"'']*)[\"'']', 1) AS h FROM pages), unnest(range(1, len(h) + 1)) AS x(i)), "
    "m AS (SELECT url, pos, CASE pos % 5 WHEN 0 THEN href WHEN 1 THEN '?q=' || pos WHEN 2 THEN '//files.example.org' || href WHEN 3 THEN 'HTTP://other.example.org/x' ELSE './' || substr(href, 2) || '/../y' END AS href FROM l WHERE starts_with(href, '/') AND NOT contains(href, '?') AND NOT contains(href, '#') AND length(href) > 1) "
    "SELECT url, pos, CASE pos % 5 WHEN 0 THEN regexp_extract(url, '^[a-z]+://[^/]*') || href WHEN 1 THEN regexp_replace(url, '[?#].*$', '') || href WHEN 2 THEN regexp_extract(url, '^[a-z]+:') || href WHEN 3 THEN href ELSE regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', '') || 'y' END AS dst FROM m WHERE pos % 5 <> 4 OR NOT contains(substr(href, 3, length(href) - 7), '/')"
)
def link_addresses(table):
    """Pages' links, many put in other forms, against their pages' addresses."""
    e = g.links(table("pages"), "url", "html").where("startswith(href, '/') AND NOT contains(href, '?') AND NOT contains(href, '#') AND length(href) > 1")
    form = "CASE pos % 5 WHEN 0 THEN href WHEN 1 THEN concat('?q=', pos) WHEN 2 THEN concat('//files.example.org', href) WHEN 3 THEN 'HTTP://other.example.org/x' ELSE concat('./', substr(href, 2), '/../y') END"
    e = e.where("pos % 5 <> 4 OR NOT contains(substr(href, 2), '/')").withColumn("href", F.expr(form))
    return g.resolved(e).select("url", F.col("pos").cast("long").alias("pos"), "dst")


_NAMES = "SELECT regexp_extract(text, '^\\p{L}+ \\p{L}+', 0) AS name, CAST(item_id AS VARCHAR(20)) AS code FROM benchmark UNION SELECT regexp_extract(text, '^\\p{L}+', 0), 'w' FROM benchmark"


@query(
    f"WITH n AS MATERIALIZED (SELECT lower(name) AS name, min(code) AS code FROM ({_NAMES}) AS x WHERE name <> '' GROUP BY 1), "
    "d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w, regexp_split_to_array(lower(text), '[\\p{L}\\p{N}_]+') AS s FROM documents), "
    "u AS (SELECT doc_id, i, w[i] AS word, s[i] AS before FROM d, unnest(range(1, len(w) + 1)) AS x(i)), "
    "p AS MATERIALIZED (SELECT *, sum(length(before) + length(word)) OVER (PARTITION BY doc_id ORDER BY i) AS z FROM u), "
    "b AS MATERIALIZED (SELECT doc_id, z - length(word) AS a, z, name, code FROM p JOIN n ON name = word UNION ALL "
    "SELECT l.doc_id, l.z - length(l.word), r.z, name, code FROM p l JOIN p r ON l.doc_id = r.doc_id AND r.i = l.i + 1 AND r.before = ' ' JOIN n ON name = l.word || ' ' || r.word) "
    "SELECT doc_id, a::INT AS start, z::INT AS stop, name, code FROM b WHERE NOT EXISTS (SELECT 1 FROM b o WHERE o.doc_id = b.doc_id AND o.a <= b.a AND o.z >= b.z AND (o.a, o.z) <> (b.a, b.z))"
)
def name_spans(table):
    """Where the first words, and pairs of words, of benchmark items stand in documents, whatever their case."""
    b = table("benchmark")
    pairs = b.select(F.regexp_extract("text", r"^\p{L}+ \p{L}+", 0).alias("name"), F.col("item_id").cast("string").alias("code"))
    names = pairs.union(b.select(F.regexp_extract("text", r"^\p{L}+", 0), F.lit("w")))
    found = nm.detected(table("documents"), names, "doc_id", "text")
    return found.select(F.col("id").alias("doc_id"), "start", F.col("end").alias("stop"), "name", "code")


@query(
    "WITH l AS (SELECT doc_id, i - 1 AS chunk_index, s[i] AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents), unnest(range(1, len(s) + 1)) AS x(i)), "
    "k AS (SELECT * FROM l WHERE regexp_matches(t, '\\S') AND doc_id % 13 <> 5), "
    "w AS (SELECT doc_id, chunk_index, unnest(regexp_extract_all(lower(t), '[\\p{L}\\p{N}]+')) AS w FROM k), "
    "h AS (SELECT doc_id, chunk_index, ('0x' || substr(md5(w), 1, 8))::BIGINT % 16 AS b, sum(CASE WHEN ('0x' || substr(md5(w), 9, 1))::INT % 2 = 0 THEN 1 ELSE -1 END) AS n FROM w GROUP BY ALL), "
    "z AS (SELECT doc_id, chunk_index, sqrt(sum(n * n)) AS z FROM h GROUP BY ALL) "
    "SELECT k.doc_id, k.chunk_index, g.b::INT AS place, round(coalesce(n, 0) / coalesce(nullif(z, 0), 1), 6) AS value, CASE WHEN k.doc_id % 2 = 0 THEN 'KEN' ELSE '' END AS countries "
    "FROM k CROSS JOIN range(16) AS g(b) LEFT JOIN h ON h.doc_id = k.doc_id AND h.chunk_index = k.chunk_index AND h.b = g.b LEFT JOIN z ON z.doc_id = k.doc_id AND z.chunk_index = k.chunk_index"
)
def chunk_vectors(table):
    """Documents' lines as chunks with hashed vectors; a document in 13 has a detection too few and fails, odd ones' detections failed."""
    chunks = tb.chunked(table("documents"), "doc_id", "text", keep_blank=True).withColumnRenamed("doc_id", "document_id")
    found = chunks.where("document_id % 13 != 5 OR chunk_index > 0").select("document_id", "chunk_index", F.array(F.lit("KEN")).alias("countries"), F.when(F.col("document_id") % 2 == 1, "failed").alias("error"))
    rows, _ = em.embed_chunks(chunks, found, em.Hashed(16))
    each = rows.select(F.col("document_id").alias("doc_id"), F.col("chunk_index").cast("long").alias("chunk_index"), F.array_join("countries", ",").alias("countries"), F.posexplode("embedding").alias("place", "value"))
    return each.withColumn("value", F.round("value", 6) + 0.0)


@query(
    "SELECT page_id, (i - 1)::INT AS pos, h[i] AS href, CASE WHEN starts_with(h[i], '/') THEN regexp_extract(url, '^[a-z]+://[^/]*') || h[i] ELSE h[i] END AS link FROM (SELECT page_id, url, regexp_extract_all(html, '(?i)<a\\s[^>]*href\\s*=\\s*[\"'']([^\"'']*)[\"'']', 1) AS h FROM pages), unnest(range(1, len(h) + 1)) AS x(i)"
)
def page_links(table):
    """Pages' links through a table function in SQL, with a lateral join."""
    p = table("pages")
    ls.register(p.sparkSession)
    return p.sparkSession.sql("SELECT p.page_id, l.pos, l.href, l.url AS link FROM {p} AS p, LATERAL page_links(p.url, p.html) AS l", p=p)
