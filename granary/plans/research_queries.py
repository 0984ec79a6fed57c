"""Lookups, research rules and queue rules over the given tables, each beside the SQL that gives the same."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from granary.functions import text as t
from granary.operators import graph as g
from granary.operators import lookups as lk
from granary.operators import report as rp
from granary.operators import research as rs
from granary.operators import tables as tb
from granary.operators import tasks as tk
from granary.sources import files

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    """Register a function (table, ...) -> DataFrame, where table(name) reads one of the given tables, and the SQL that gives the same."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, d: f(lambda name: spark.read.parquet(f"{d}/{name}.parquet"))
        SQL[f.__name__] = sql
        return f

    return add


def _sql(table, name: str, text: str):
    """Rows of one table shaped by a SELECT list that both engines understand."""
    return table(name).selectExpr(*text.split(" ; "))


# --- documents and sources --------------------------------------------------------------------


@query(
    "WITH d AS (SELECT *, doc_id % 7 = 3 AS other, doc_id % 11 = 5 AS no_url, doc_id % 6 = 5 AS no_title, doc_id % 13 = 6 AS no_chunks, string_split(text, chr(10)) AS c FROM documents), "
    "e AS (SELECT *, CASE WHEN other THEN 'document_id differs' WHEN no_url THEN 'handle_url missing' WHEN no_title THEN 'title missing' WHEN no_chunks THEN 'chunks missing' END AS error FROM d) "
    "SELECT doc_id, error, CASE WHEN no_title THEN NULL ELSE 'T' || doc_id END AS title, CASE WHEN error IS NULL THEN len(c) ELSE 0 END AS pages, CASE WHEN error IS NULL THEN sum_chars ELSE 0 END AS chars, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE 1 END AS nested, 2 + (NOT no_url)::INT + CASE WHEN no_title THEN 0 ELSE CASE doc_id % 6 WHEN 1 THEN 2 ELSE 1 END END AS fields "
    "FROM (SELECT *, list_sum(list_transform(c, lambda x: length(x)))::BIGINT AS sum_chars FROM e)"
)
def external_pages(table):
    """Documents as an API's JSON, with titles under any of five names and things missing, read into pages."""
    d = table("documents").withColumn("t", F.concat(F.lit("T"), F.col("doc_id").cast("string")))
    k, at = F.col("doc_id") % 6, lambda n: F.when(k == n, F.col("t"))
    nested = F.struct(F.col("lang").alias("lang"), F.lit("x").alias("organizations"), F.when(F.col("doc_id") % 4 != 0, F.col("n_chars").cast("string")).alias("size"))
    doc = F.struct(
        F.when(F.col("doc_id") % 11 != 5, F.concat(F.lit("https://example.org/"), "t")).alias("handle_url"), F.when(k == 1, "").otherwise(at(0)).alias("title"), at(1).alias("title_english"), at(2).alias("title_original"),
        at(3).alias("subtitle_english"), at(4).alias("subtitle_original"), F.col("lang"), F.col("n_chars").cast("string").alias("n"), F.lit("dropped").alias("key_concepts"), nested.alias("metadata"),
    )
    chunks = F.when(F.col("doc_id") % 13 != 6, F.transform(F.split("text", "\n", -1), lambda x: F.struct(x.alias("content")))).otherwise(F.array().cast("array<struct<content:string>>"))
    own = F.when(F.col("doc_id") % 7 == 3, "another").otherwise(F.col("t"))
    raw = d.select(F.col("t").alias("document_id"), F.to_json(F.struct(own.alias("document_id"), doc.alias("document"), chunks.alias("chunks"))).alias("body"))
    rows = files.external_document(raw)
    per = rows.groupBy("document_id", "error", "title").agg(F.count("page_no").alias("pages"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"), F.max(F.coalesce(F.cardinality("nested"), F.lit(0))).alias("nested"), F.max(F.coalesce(F.cardinality("metadata"), F.lit(0))).alias("fields"))
    return per.select(F.substring("document_id", 2, 20).cast("long").alias("doc_id"), "error", "title", "pages", "chars", "nested", "fields")


@query("SELECT d.doc_id, i - 1 AS chunk_index, length(l[i]) AS n_chars FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) d, unnest(range(1, len(l) + 1)) AS x(i) WHERE regexp_matches(l[i], '\\S')")
def document_chunks(table):
    """All chunks of the documents that are labelled good."""
    wanted = table("labels").where("quality = 1").select("doc_id")
    found = lk.chunks_of(tb.chunked(table("documents"), "doc_id", "text"), wanted, "doc_id")
    return found.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.length("chunk_text").cast("long").alias("n_chars"))


_TASKS = "event_id AS task_id ; CASE WHEN event_id % 3 = 0 THEN event_id % 700 END AS document_id ; 'u' || event_id % 150 AS url ; CASE WHEN event_id % 4 = 0 THEN NULL ELSE 's' || event_id % 4 END AS source"
_DOCS = "doc_id AS document_id ; 'u' || doc_id % 100 AS url ; CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 's' || doc_id % 5 END AS source"


@query(
    f"WITH t AS (SELECT {_TASKS.replace(' ; ', ', ')} FROM events), d AS (SELECT {_DOCS.replace(' ; ', ', ')} FROM documents) "
    "SELECT task_id, CASE WHEN t.document_id IS NOT NULL THEN (SELECT min(d.document_id) FROM d WHERE d.document_id = t.document_id) ELSE (SELECT min(d.document_id) FROM d WHERE d.url = t.url AND d.source IS NOT DISTINCT FROM t.source) END AS found FROM t"
)
def task_documents(table):
    """Tasks to documents by id, or by address and source."""
    return lk.documents_of(_sql(table, "events", _TASKS), _sql(table, "documents", _DOCS))


@query(f"WITH t AS (SELECT {_TASKS.replace(' ; ', ', ')} FROM events), d AS (SELECT {_DOCS.replace(' ; ', ', ')} FROM documents) SELECT url, min(document_id) AS document_id FROM d WHERE url IN (SELECT url FROM t) GROUP BY url")
def url_documents(table):
    """The first document of each address that a task has."""
    return lk.by_url(_sql(table, "events", _TASKS), _sql(table, "documents", _DOCS))


@query(
    "WITH r AS (SELECT user_id AS document_id, max(event_id) FILTER (WHERE value >= 200) AS v FROM events GROUP BY 1), p AS (SELECT event_id AS v, unnest(range(1, (event_id % 3)::BIGINT + 1)) AS page_no FROM events) "
    "SELECT document_id, page_no, CASE WHEN r.v IS NULL THEN 'no completed result' WHEN page_no IS NULL THEN 'no pages' END AS error FROM r LEFT JOIN p ON r.v = p.v"
)
def completed_pages(table):
    """Pages of each user's latest completed result, none to two of them."""
    e = table("events")
    r = e.select(F.col("user_id").alias("document_id"), "event_type", F.col("event_id").alias("seq"), F.when(F.col("value") >= 200, "completed").otherwise("failed").alias("status"), F.col("event_id").alias("version_id"))
    p = e.where("event_id % 3 > 0").select(F.col("event_id").alias("version_id"), F.col("user_id").alias("document_id"), F.explode(F.sequence(F.lit(1), (F.col("event_id") % 3).cast("int"))).alias("page_no"), F.lit("x").alias("text"))
    return lk.completed_pages(r, p).select("document_id", F.col("page_no").cast("long").alias("page_no"), "error")


@query("SELECT source, arg_max(doc_id, (length(text), doc_id)) AS doc_id, max(length(text)) AS size FROM documents GROUP BY source")
def largest_body(table):
    """The largest text of each source, the later of equals."""
    return lk.largest(table("documents"), "source", "text", "doc_id").withColumn("size", F.col("size").cast("long"))


@query(
    "WITH l AS (SELECT doc_id, i, trim(regexp_replace(l[i], '\\s+', ' ', 'g')) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) AS u(i)), "
    "r AS (SELECT *, CASE WHEN length(x) % 5 > 0 AND x <> '' THEN length(x) % 5 END AS k FROM l) SELECT doc_id, coalesce(arg_max(x, (-k, length(x), -i)) FILTER (WHERE k IS NOT NULL), 'untitled') AS title FROM r GROUP BY doc_id"
)
def best_title(table):
    """Lines as headings of four ranks: the longest of the highest rank is the title."""
    lines = table("documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "x"))
    clean = F.trim(F.regexp_replace("x", r"\s+", " "))
    rank = F.when(F.length(clean) % 5 > 0, F.length(clean) % 5)
    return lk.best_title(lines.withColumn("k", rank), "doc_id", "x", "k", "i", F.lit("untitled"))


@query(
    "WITH v AS (SELECT 'vs:' || doc_id || ':' || doc_id % 5 AS source_id, 'vectorstore' AS source_type, CASE WHEN doc_id % 3 = 0 THEN 'u' || doc_id ELSE 't' || lang END AS name, 1 + doc_id % 5 AS page, source AS origin, length(text) AS n FROM documents), "
    "w AS (SELECT CASE WHEN doc_id % 8 = 0 THEN 'vs:' || doc_id || ':' || doc_id % 5 ELSE 'web:' || doc_id END AS source_id, 'web' AS source_type, 'w' || doc_id AS name, NULL::BIGINT AS page, NULL AS origin, 3 AS n FROM documents WHERE doc_id % 4 = 0) "
    "SELECT * FROM v WHERE source_id NOT IN (SELECT source_id FROM w) UNION ALL SELECT * FROM w"
)
def source_refs(table):
    """Chunks and web pages as one table of sources; web pages that share a chunk's id take its place."""
    d = table("documents")
    chunks = d.select(F.col("doc_id").alias("document_id"), (F.col("doc_id") % 5).alias("chunk_index"), F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("url"), F.when(F.col("doc_id") % 3 == 0, F.when(F.col("doc_id") % 2 == 0, "")).otherwise(F.concat(F.lit("t"), "lang")).alias("title"), "source", F.col("text").alias("chunk_text"))
    same = F.concat_ws(":", F.lit("vs"), F.col("doc_id").cast("string"), (F.col("doc_id") % 5).cast("string"))
    web = d.where("doc_id % 4 = 0").select(F.when(F.col("doc_id") % 8 == 0, same).otherwise(F.concat(F.lit("web:"), F.col("doc_id").cast("string"))).alias("source_id"), F.concat(F.lit("w"), F.col("doc_id").cast("string")).alias("url"), F.lit(None).cast("string").alias("title"), F.lit("abc").alias("content"))
    return lk.source_table(chunks, web).select("source_id", "source_type", "name", F.col("page").cast("long").alias("page"), "origin", F.length("text").cast("long").alias("n"))


@query("SELECT l_partkey AS source_id, arg_min(l_suppkey, (l_orderkey, l_linenumber, l_suppkey)) AS l_suppkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 20) GROUP BY 1")
def new_sources(table):
    """Parts of orders as finds: the first of each that isn't known."""
    li = table("lineitem").select(F.col("l_partkey").alias("source_id"), "l_orderkey", "l_linenumber", "l_suppkey")
    return lk.new_sources(li, table("part").where("p_size < 20").select(F.col("p_partkey").alias("source_id")), ["l_orderkey", "l_linenumber", "l_suppkey"]).select("source_id", "l_suppkey")


@query(
    "WITH f AS (SELECT l_orderkey AS parent, l_partkey AS url, min(l_linenumber) AS pos FROM lineitem GROUP BY ALL), n AS (SELECT url, arg_min(parent, (parent, pos)) AS parent FROM f WHERE url % 4 <> 0 GROUP BY url) "
    "SELECT 'new' AS what, url, parent AS n FROM n UNION ALL SELECT 'edges', url, count(DISTINCT parent) FROM f GROUP BY url"
)
def discovered(table):
    """Orders as pages that link to parts, every fourth part visited: new pages with their first parent, edges of all parents."""
    found = table("lineitem").select(F.col("l_orderkey").alias("parent"), F.col("l_partkey").alias("url"), F.col("l_linenumber").alias("pos"))
    new, edges = g.discovered(found, table("part").where("p_partkey % 4 = 0").select(F.col("p_partkey").alias("url")))
    return new.select(F.lit("new").alias("what"), "url", F.col("parent").alias("n")).union(edges.groupBy(F.lit("edges").alias("what"), F.col("dst").alias("url")).agg(F.count("*").alias("n")))


# --- research rounds --------------------------------------------------------------------------

_GAPS = "o_custkey AS batch ; 'gap_' || o_orderkey AS gap_id ; o_orderpriority AS description ; CASE o_orderstatus WHEN 'F' THEN 'closed' WHEN 'O' THEN 'open' ELSE 'stale' END AS status"
_GAPS_SQL = f"SELECT {_GAPS.replace(' ; ', ', ')} FROM orders"


@query(f"SELECT batch, count(*) FILTER (WHERE status = 'open') AS open, count(*) FILTER (WHERE status = 'closed') AS closed, count(*) FILTER (WHERE status = 'stale') AS others FROM ({_GAPS_SQL}) AS x GROUP BY 1")
def gap_counts(table):
    """Orders as a customer's gaps, by status."""
    return rs.gap_counts(_sql(table, "orders", _GAPS), "batch")


@query(
    f"WITH o AS ({_GAPS_SQL}), new AS (SELECT * FROM o WHERE description = '1-URGENT'), old AS (SELECT * FROM o WHERE description = '2-HIGH') "
    "SELECT batch, gap_id, description, status FROM new UNION ALL SELECT * FROM old WHERE batch NOT IN (SELECT batch FROM new) "
    "UNION ALL SELECT c_custkey, 'gap_001', 'Country-specific evidence is missing', 'open' FROM customer WHERE c_custkey NOT IN (SELECT batch FROM new) AND c_custkey NOT IN (SELECT batch FROM old) AND c_acctbal >= 0"
)
def gaps_after(table):
    """Urgent orders as reported gaps, high ones as former gaps; customers in debt have claims."""
    o = _sql(table, "orders", _GAPS)
    c = table("customer").select(F.col("c_custkey").alias("batch"), "c_acctbal")
    return rs.gaps_after(o.where("description = '1-URGENT'"), o.where("description = '2-HIGH'"), c.where("c_acctbal < 0"), c, "batch")


@query(
    "WITH f AS (SELECT o_custkey AS batch, list(o_orderpriority ORDER BY o_orderkey) AS facts FROM orders WHERE o_orderstatus = 'P' GROUP BY 1), "
    "c AS (SELECT o_custkey AS batch, list('claim_' || lpad(o_orderkey::VARCHAR, 8, '0') || ': ' || o_orderpriority ORDER BY o_orderkey) AS facts FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1) "
    "SELECT batch, array_to_string(facts, '|') AS facts FROM f UNION ALL SELECT batch, array_to_string(facts, '|') FROM c WHERE batch NOT IN (SELECT batch FROM f)"
)
def established_facts(table):
    """Pending orders as reported facts, all others as claims that stand in where none are."""
    o = table("orders").select(F.col("o_custkey").alias("batch"), F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("fact"), "o_orderstatus")
    claims = o.where("o_orderstatus != 'P'").select("batch", F.concat(F.lit("claim_"), F.lpad(F.col("pos").cast("string"), 8, "0")).alias("claim_id"), F.col("fact").alias("quoted_text"))
    return rs.facts(o.where("o_orderstatus = 'P'"), claims, "batch").withColumn("facts", F.array_join("facts", "|"))


@query(
    "WITH x AS (SELECT conv_id, count(*) AS n, count(*) FILTER (WHERE role = 'user' AND length(text) > 200) AS a, conv_id % 4 AS r FROM conversations GROUP BY ALL) "
    "SELECT conv_id, n > 0 AND a = 0 AND r < 3 AS again, CASE WHEN n < 3 THEN 'Got ' || n || CASE WHEN n = 1 THEN ' query' ELSE ' queries' END || '; need at least 3.' WHEN n > 6 THEN 'Got ' || n || ' queries; need at most 6.' END AS message FROM x"
)
def round_checks(table):
    """Whether a conversation's claims are extracted again, and whether it has too few or too many queries."""
    x = table("conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.count_if((F.col("role") == "user") & (F.length("text") > 200)).alias("a"))
    return x.select("conv_id", rs.extract_again(F.col("n"), F.col("a"), F.col("conv_id") % 4, F.lit(3)).alias("again"), rs.query_count_message(F.col("n"), 3, 6).alias("message"))


@query(
    "WITH q AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'vectorstore' ELSE 'both' END AS destination FROM conversations) SELECT conv_id, turn, destination FROM q WHERE destination <> 'vectorstore' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 2"
)
def web_budget(table):
    """The first two queries of each round that go to the web."""
    kind = F.when(F.col("turn") % 3 == 0, "web").when(F.col("turn") % 3 == 1, "vectorstore").otherwise("both")
    return rs.web_queries(table("conversations").select("conv_id", "turn", kind.alias("destination")), "conv_id", "turn", 2)


@query(
    "WITH g AS (SELECT doc_id, list_filter([CASE WHEN doc_id % 2 = 0 THEN 'gap_' || lang END, CASE WHEN doc_id % 3 = 0 THEN 'gap_' || source END], lambda x: x IS NOT NULL) AS t, CASE WHEN doc_id % 10 = 0 THEN [] ELSE ['gap_en', 'gap_de'] END AS o FROM documents) SELECT doc_id, len(o) = 0 OR list_has_any(t, o) AS on_target FROM g"
)
def gap_targets(table):
    """Whether a query aims at an open gap, or none is open."""
    targets = F.array_compact(F.array(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("gap_"), "lang")), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("gap_"), "source"))))
    open_ = F.when(F.col("doc_id") % 10 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("gap_en"), F.lit("gap_de")))
    return table("documents").select("doc_id", rs.targets_open(targets, open_).alias("on_target"))


def _statements(table):
    """Orders as statements with their lines' parts as claims."""
    li = table("lineitem").groupBy(F.col("l_orderkey").alias("statement_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("claim_ids"))
    return li.join(table("orders").select(F.col("o_orderkey").alias("statement_id"), "o_custkey", F.concat(F.lit("It "), F.when(F.col("o_orderkey") % 3 == 0, "rose by ").otherwise("was "), F.floor("o_totalprice").cast("long").cast("string")).alias("text")), "statement_id")


@query(
    "WITH s AS (SELECT l_orderkey AS statement_id, list(l_partkey ORDER BY l_linenumber, l_partkey) AS c FROM lineitem JOIN part ON p_partkey = l_partkey AND p_size >= 25 GROUP BY 1) SELECT statement_id, array_to_string(c, ',') AS claim_ids, len(c) AS n FROM s JOIN orders ON o_orderkey = statement_id"
)
def supported_statements(table):
    """Statements with only the claims that were validated, here parts of a size; others go."""
    claims = table("part").where("p_size >= 25").select(F.col("p_partkey").alias("claim_id"))
    out = rs.supported(_statements(table), claims)
    return out.select("statement_id", F.array_join("claim_ids", ",").alias("claim_ids"), F.size("claim_ids").cast("long").alias("n"))


@query("SELECT DISTINCT l_orderkey AS statement_id, l_partkey AS claim_id, p_name AS quoted_text FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey WHERE p_size < 40")
def verification_claims(table):
    """The claims that each statement is verified against."""
    claims = table("part").where("p_size < 40").select(F.col("p_partkey").alias("claim_id"), F.col("p_name").alias("quoted_text"))
    return rs.claims_for(_statements(table), claims)


@query(
    "WITH x AS (SELECT o_orderkey AS statement_id, o_orderkey % 4 AS attempt, CASE o_orderkey % 3 WHEN 0 THEN 'entailed' WHEN 1 THEN 'partially_entailed' ELSE 'contradicted' END AS v, o_orderkey % 5 = 0 AS removed, CASE WHEN o_orderkey % 7 = 0 THEN ' ' ELSE ' new text ' END AS fixed FROM orders), "
    "y AS (SELECT *, CASE WHEN v = 'entailed' THEN 'keep' WHEN attempt >= 2 AND v = 'partially_entailed' THEN 'keep' WHEN attempt >= 2 THEN 'drop' WHEN removed OR trim(fixed) = '' THEN 'drop' ELSE 'repair' END AS action FROM x) "
    "SELECT statement_id, CASE WHEN action = 'repair' THEN 'new text' ELSE 'old text' END AS text, attempt + (action = 'repair')::INT AS attempt, action FROM y"
)
def after_verdict(table):
    """One step of verification for every order as a statement."""
    k = F.col("o_orderkey")
    x = table("orders").select(k.alias("statement_id"), F.lit("old text").alias("text"), F.when(k % 3 == 0, "entailed").when(k % 3 == 1, "partially_entailed").otherwise("contradicted").alias("verdict"), (k % 4).alias("attempt"), (k % 5 == 0).alias("removed"), F.when(k % 7 == 0, " ").otherwise(" new text ").alias("repaired"))
    return rs.after_verdict(x, 2)


_VERDICTS = "CASE (statement_id + attempt) % 5 WHEN 0 THEN 'entailed' WHEN 1 THEN 'partially_entailed' ELSE 'contradicted' END AS verdict ; (statement_id + attempt) % 11 = 0 AS removed ; CASE WHEN (statement_id + attempt) % 7 = 0 THEN ' ' ELSE text || '*' END AS repaired"


@query(
    f"WITH RECURSIVE r AS (SELECT o_orderkey AS statement_id, 'said' AS text, 0 AS attempt, 'repair' AS action FROM orders UNION ALL "
    "SELECT statement_id, CASE WHEN a = 'repair' THEN trim(repaired) ELSE text END, CASE WHEN a = 'repair' THEN attempt + 1 ELSE attempt END, a FROM ("
    "SELECT *, CASE WHEN verdict = 'entailed' THEN 'keep' WHEN attempt >= 2 AND verdict = 'partially_entailed' THEN 'keep' WHEN attempt >= 2 THEN 'drop' WHEN removed OR trim(repaired) = '' THEN 'drop' ELSE 'repair' END AS a "
    f"FROM (SELECT *, {_VERDICTS.replace(' ; ', ', ')} FROM r WHERE action = 'repair') AS v) AS x) SELECT statement_id, text, attempt FROM r WHERE action = 'keep'"
)
def verified_statements(table):
    """Orders as statements through up to three rounds of verification by a made-up judge."""
    first = table("orders").select(F.col("o_orderkey").alias("statement_id"), F.lit("said").alias("text"))
    judge = lambda open_: open_.select("statement_id", *[F.expr(x) for x in _VERDICTS.split(" ; ")])
    return rs.verified(first, judge, 2)[0]


@query(
    f"WITH g AS ({_GAPS_SQL}), s AS (SELECT o_custkey AS batch, l_partkey AS claim_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey), "
    "c AS (SELECT DISTINCT batch, claim_id, p_size AS source_id FROM s JOIN part ON p_partkey = claim_id WHERE p_size < 45) "
    "SELECT 'claim' AS what, batch, claim_id::VARCHAR AS id FROM c UNION ALL SELECT DISTINCT 'source', batch, source_id::VARCHAR FROM c WHERE source_id < 30 UNION ALL SELECT 'gap', batch, gap_id::VARCHAR FROM g WHERE status <> 'closed'"
)
def report_rows(table):
    """A customer's report as rows: the claims that its statements cite, their sources, the gaps left."""
    part = table("part")
    claims = part.where("p_size < 45").select(F.col("p_partkey").alias("claim_id"), F.col("p_size").alias("source_id"))
    sources = part.where("p_size < 30").select(F.col("p_size").alias("source_id")).distinct()
    said = table("orders").join(table("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_custkey").alias("batch"), "o_orderkey").agg(F.collect_list("l_partkey").alias("claim_ids"))
    held, used, gaps = rs.report_rows(said, claims, sources, _sql(table, "orders", _GAPS), "batch")
    row = lambda df, what, of: df.select(F.lit(what).alias("what"), "batch", F.col(of).cast("string").alias("id"))
    return row(held, "claim", "claim_id").union(row(used, "source", "source_id")).union(row(gaps, "gap", "gap_id"))


@query(
    f"WITH g AS ({_GAPS_SQL}), s AS (SELECT o_custkey AS batch, o_orderkey, o_orderkey % 3 = 0 AS q FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)), "
    "a AS (SELECT batch, bool_or(q) AS q, count(*) AS statements FROM s GROUP BY 1), "
    "c AS (SELECT batch, count(DISTINCT l_partkey) AS claims, count(DISTINCT p_size) AS sources FROM s JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey AND p_size < 30 GROUP BY 1), "
    "o AS (SELECT batch, count(*) AS n FROM g WHERE status <> 'closed' GROUP BY 1) "
    "SELECT batch, CASE WHEN q THEN 'answered' ELSE 'high_level_answer' END AS status, statements, coalesce(claims, 0) AS claims, coalesce(sources, 0) AS sources, coalesce(n, 0) AS open_gaps FROM a LEFT JOIN c USING (batch) LEFT JOIN o USING (batch)"
)
def final_report(table):
    """A customer's report: its status anew, what its statements cite, and the gaps left."""
    claims = table("part").select(F.col("p_partkey").alias("claim_id"), F.col("p_size").alias("source_id"))
    sources = claims.where("source_id < 30").select("source_id").distinct()
    return rs.final_report(_statements(table).withColumnRenamed("o_custkey", "batch"), claims, sources, _sql(table, "orders", _GAPS), "batch")


# --- reports ----------------------------------------------------------------------------------


@query(
    "WITH m AS (SELECT p_brand, p_size % 3 = 0 AS w FROM part) SELECT p_brand, count(*) FILTER (WHERE w) AS worldbank, count(*) FILTER (WHERE NOT w) AS researcher FROM m GROUP BY 1"
)
def route_counts(table):
    """How many metrics of each brand go which way."""
    sources = F.when(F.col("p_size") % 3 == 0, F.array(F.lit("WorldBank"))).otherwise(F.array(F.lit("WorldBank"), F.lit("web")))
    return rp.route_counts(table("part").select("p_brand", rp.metric_route(sources).alias("route")), "p_brand")


@query(
    "WITH f AS (SELECT c_nationkey AS k, c_custkey, lpad(c_custkey::VARCHAR, 8, '0') AS name, CASE WHEN c_custkey % 4 = 0 THEN c_custkey ELSE 900000 - c_custkey END AS number FROM customer WHERE c_custkey % 7 > 0), "
    "b AS (SELECT k, name, number, CASE WHEN c_custkey % 4 = 0 THEN '## ' || c_custkey || '. Metric ' || c_custkey || chr(10) || 'no heading ' || c_custkey ELSE '## ' || number || '. Title' || chr(10) || 'before' || chr(10) || 'after' END AS body FROM f), "
    "t AS (SELECT k, arg_min('# Report ' || c_custkey, name) FILTER (WHERE c_custkey % 3 = 0) AS title FROM f GROUP BY k) "
    "SELECT k, sha256(coalesce(any_value(title), '# Research report') || chr(10) || chr(10) || string_agg(body, chr(10) || chr(10) ORDER BY number, name) || chr(10)) AS sha, count(*) AS sections FROM b JOIN t USING (k) GROUP BY k"
)
def report_combined(table):
    """Customers as files of metrics, blank, without a heading or with one in the middle: one report for each nation."""
    c = table("customer")
    key = F.col("c_custkey").cast("string")
    title = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("\n# Report "), key, F.lit("  \n\n"))).otherwise("")
    plain = F.concat(F.lit("no heading "), key, F.lit("\n# gone"))
    headed = F.concat(F.lit("before\n##  "), (F.lit(900000) - F.col("c_custkey")).cast("string"), F.lit(".  Title\nafter\n"))
    text = F.when(F.col("c_custkey") % 7 == 0, " \n").otherwise(F.concat(title, F.when(F.col("c_custkey") % 4 == 0, plain).otherwise(headed)))
    files_ = c.select(F.col("c_nationkey").alias("k"), F.lpad(key, 8, "0").alias("name"), text.alias("text"))
    # headings are kept as they are written; here their blanks are made single for the comparison
    report = F.regexp_replace("report", r"(?m)^##  (\d+)\.  ", "## $1. ")
    n = files_.where("trim(text) != '' AND text != ' \n'").groupBy("k").agg(F.count("*").alias("sections"))
    return rp.combined(files_, "k", "name", "text").join(n, "k").select("k", F.sha2(report.cast("binary"), 256).alias("sha"), "sections")


@query(
    "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity::INT::VARCHAR AS quantity, rtrim(rtrim((round(l_discount, 4))::DECIMAL(9, 4)::VARCHAR, '0'), '.') AS discount FROM lineitem"
)
def report_numbers(table):
    """Quantities and discounts in at most four significant digits."""
    return table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", rp.number_text(F.col("l_quantity"), "double").alias("quantity"), rp.number_text(F.col("l_discount"), "double").alias("discount"))


# --- the queue --------------------------------------------------------------------------------

_QUEUE = "event_id ; event_type AS stage_name ; ts ; user_id ; CASE event_id % 5 WHEN 0 THEN 'scheduled' WHEN 1 THEN 'retrying' WHEN 2 THEN 'running' WHEN 3 THEN 'completed' ELSE 'failed' END AS status ; event_id % 4 AS attempts"
_QUEUE_SQL = f"SELECT {_QUEUE.replace(' ; ', ', ')} FROM events"


@query(
    f"WITH t AS ({_QUEUE_SQL}), r AS (SELECT stage_name, count(*) FILTER (WHERE status = 'running') AS n FROM t GROUP BY 1) "
    "SELECT stage_name, event_id, attempts + 1 AS attempts FROM t JOIN r USING (stage_name) WHERE status = 'scheduled' OR status = 'retrying' AND attempts < 3 QUALIFY row_number() OVER (PARTITION BY stage_name ORDER BY ts, event_id) <= (SELECT max(n) + 60 FROM r) - any_value(n) OVER (PARTITION BY stage_name)"
)
def claim_within(table):
    """Claims up to each stage's limit (60 more than what is in flight at the busiest) less what is in flight there."""
    e = _sql(table, "events", _QUEUE)
    most = e.where("status = 'running'").groupBy("stage_name").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    return tk.claim_within(e, most + 60, ["ts", "event_id"]).select("stage_name", "event_id", "attempts")


@query(f"WITH t AS ({_QUEUE_SQL}) SELECT user_id AS run_id, 'node' AS what, stage_name AS value, count(*) AS n FROM t WHERE status NOT IN ('completed', 'failed') GROUP BY ALL UNION ALL SELECT user_id, 'status', status, count(*) FROM t WHERE status NOT IN ('completed', 'failed') GROUP BY ALL")
def active_counts(table):
    """A run's tasks that aren't done, by node and by status."""
    return tk.active_counts(_sql(table, "events", _QUEUE).withColumnRenamed("user_id", "run_id"), "run_id", "stage_name")


@query("SELECT user_id AS executor_id, max(ts) AS updated_at FROM events WHERE event_id % 3 <> 2 GROUP BY 1")
def heartbeats(table):
    """Two batches of heartbeats, the later upserted into the earlier."""
    e = table("events").select(F.col("user_id").alias("executor_id"), F.col("ts").alias("updated_at"), "event_id")
    old = e.where("event_id % 3 = 0").groupBy("executor_id").agg(F.max("updated_at").alias("updated_at"))
    return tk.heartbeat(old, e.where("event_id % 3 = 1").select("executor_id", "updated_at"))


@query("WITH l AS (SELECT user_id, event_type, arg_max(value >= 50, event_id) AS ok FROM events GROUP BY ALL) SELECT user_id, count(*) FILTER (WHERE ok) = 4 AS done FROM l GROUP BY 1")
def documents_done(table):
    """Whether the latest result of each of a document's four steps is completed."""
    r = table("events").select("user_id", "event_type", "event_id", F.when(F.col("value") >= 50, "completed").otherwise("failed").alias("status"))
    return tb.completed(r, "user_id", "event_type", "event_id", 4)


@query("SELECT c_custkey, sha256('.' || lower(c_mktsegment)) AS kind, c_name AS name FROM customer")
def names_decoded(table):
    """File extensions, and names from bytes."""
    return table("customer").select("c_custkey", F.sha2(t.extension(F.col("c_mktsegment")).cast("binary"), 256).alias("kind"), t.decoded(F.col("c_name").cast("binary")).alias("name"))


@query(
    "WITH s AS (SELECT o_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) SELECT o_custkey, o_orderkey FROM s WHERE n <= 3"
)
def first_of_batch(table):
    """The first three rows of each batch."""
    o = table("orders").withColumn("at", F.struct("o_orderdate", "o_orderkey"))
    return rs.first_of_batch(o, "o_custkey", "at", 3).select("o_custkey", "o_orderkey")


@query(
    "SELECT l_orderkey, count(*) AS n, round(sum(l_quantity + p_size), 2) AS total FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size < 48 GROUP BY 1 HAVING count(*) = count(p_partkey)) GROUP BY 1"
)
def zip_join(table):
    """Lines and what was made of them, by position; orders whose numbers differ are left out."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    x = table("lineitem").withColumn("at", F.row_number().over(w)).select("l_orderkey", "at", "l_partkey", "l_quantity")
    made = x.join(table("part").where("p_size < 48").select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "at", "p_size")
    good, _ = tb.zip_checked(x, made, "l_orderkey", "at", "p_size")
    return good.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_quantity") + F.col("p_size")), 2).alias("total"))
