"""Evidence, workflow and report operators over the given tables, each beside the SQL that gives the same where there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import text as t
from granary.operators import evidence as e
from granary.operators import report as rp
from granary.plans import workflow as wf

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
    r"WITH q AS (SELECT conv_id AS batch, turn AS pos, trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\s+', ' ', 'g')) AS norm, trim(text) AS query, role FROM conversations), "
    r"x AS (SELECT DISTINCT norm FROM q WHERE role <> 'user'), "
    r"g AS (SELECT * FROM q WHERE role = 'user' AND norm <> '' AND len(regexp_extract_all(norm, '\S+')) >= 3 AND contains(norm, 'the') AND norm NOT IN (SELECT norm FROM x)) "
    r"SELECT batch, pos, query FROM g QUALIFY row_number() OVER (PARTITION BY batch, norm ORDER BY pos) = 1"
)
def filter_queries(table):
    """User turns as queries, other turns as what was asked before; 'The, Republic of' as the country."""
    c = table("conversations").select(F.col("conv_id").alias("batch"), F.col("turn").alias("pos"), F.col("text").alias("query"), "role")
    return e.filter_queries(c.where("role = 'user'").drop("role"), c.where("role != 'user'").select("query"), F.lit("The, Republic of"), F.lit("THE, REPUBLIC"))


@query(
    r"WITH q AS (SELECT conv_id AS batch, turn AS pos, trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\s+', ' ', 'g')) AS norm, trim(text) AS query, CASE turn % 3 WHEN 0 THEN ['gap_' || conv_id % 4, 'gap_9'] WHEN 1 THEN ['gap_' || conv_id % 7] ELSE [] END AS gaps FROM conversations) "
    r"SELECT batch, pos, query, CASE WHEN pos % 2 = 0 THEN 'coverage' ELSE 'detail' END AS purpose FROM q WHERE norm <> '' AND len(regexp_extract_all(query, '\S+')) >= 3 AND contains(norm, 'the') AND list_has_any(gaps, ['gap_1', 'gap_2']) AND norm NOT IN (SELECT norm FROM q WHERE batch % 3 = 0) QUALIFY row_number() OVER (PARTITION BY batch, norm ORDER BY pos) = 1"
)
def filter_followups(table):
    """Turns as follow-up queries with gaps of their own, two gaps being open; every third conversation was asked before; a blank purpose is coverage."""
    c = table("conversations")
    none, n = F.array().cast("array<string>"), lambda k: F.concat(F.lit("gap_"), (F.col("conv_id") % k).cast("string"))
    gaps = F.when(F.col("turn") % 3 == 0, F.array(n(4), F.lit("gap_9"))).when(F.col("turn") % 3 == 1, F.array(n(7))).otherwise(none)
    q = c.select(F.col("conv_id").alias("batch"), F.col("turn").alias("pos"), F.col("text").alias("query"), F.when(F.col("turn") % 2 == 0, " ").otherwise("detail").alias("purpose"), gaps.alias("target_gap_ids"))
    out = e.filter_queries(q, c.where("conv_id % 3 = 0").select(F.col("text").alias("query")), F.lit("The, Republic of"), F.lit("THE, REPUBLIC"), F.array(F.lit("gap_1"), F.lit("gap_2")))
    return out.select("batch", "pos", "query", "purpose")


@query(
    "WITH m AS (SELECT doc_id, d.n_nationkey AS nk, n_name FROM documents, nation d WHERE doc_id % 25 = n_nationkey), "
    "r AS (SELECT doc_id, 0 AS pos, n_name AS substring, CASE WHEN doc_id % 2 = 0 THEN 'The ' || n_name ELSE n_name || ' Land' END AS official_name, text FROM m JOIN documents USING (doc_id)) "
    "SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'valid' ELSE 'unknown_country' END AS country, contains(text, substring) AS in_text FROM r"
)
def validate_mentions(table):
    """Each document with a nation's name as its mention, half of them with a name that the dimension lacks."""
    n = table("nation").select("n_nationkey", "n_name")
    d = table("documents").select("doc_id", "text")
    m = d.select("doc_id").join(n, F.col("doc_id") % 25 == F.col("n_nationkey"))
    m = m.select(F.col("doc_id").alias("id"), F.lit(0).alias("pos"), F.col("n_name").alias("substring"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("The "), "n_name")).otherwise(F.concat("n_name", F.lit(" Land"))).alias("official_name"))
    out = e.validate_mentions(m, d.select(F.col("doc_id").alias("id"), "text"), n.select(F.col("n_name").alias("name"), F.upper(F.substring("n_name", 1, 3)).alias("iso3")))
    return out.select("id", F.when(F.array_contains("reasons", "unknown_country"), "unknown_country").otherwise("valid").alias("country"), (~F.array_contains("reasons", "not_in_text")).alias("in_text"))


_CLAIMS = (
    "b AS (SELECT doc_id % 10 AS batch, doc_id AS pos, CASE WHEN doc_id % 11 = 0 THEN -1 ELSE doc_id END AS source_id, "
    "CASE WHEN doc_id % 7 = 0 THEN 'nowhere in it' ELSE substr(text, 1, 60) END AS quote, doc_id % 5 <> 0 AS specific, text FROM documents), "
    "c AS (SELECT * FROM b UNION ALL SELECT batch, pos + 1000000, source_id, quote, specific, text FROM b WHERE pos % 6 = 0), "
)


@query(
    f"WITH {_CLAIMS} s AS (SELECT c.*, d.text AS source FROM c LEFT JOIN documents d ON c.source_id = d.doc_id), "
    "e AS (SELECT *, CASE WHEN source IS NULL THEN 'unknown_source_id' WHEN quote = '' OR NOT contains(source, quote) THEN 'substring_validation_failed' WHEN NOT specific THEN 'not_country_specific' END AS early, CASE pos % 9 WHEN 0 THEN substr(source, 1, 50) WHEN 1 THEN substr(source, 61, 60) END AS ex FROM s), "
    r"l AS (SELECT *, length(regexp_replace(ex, '^\s+|\s+$', '', 'g')) >= 40 AND contains(quote, substr(regexp_replace(ex, '^\s+|\s+$', '', 'g'), 1, 80)) IS TRUE AS leak FROM e), "
    "y AS (SELECT *, source_id % 13 = 0 OR coalesce(pos > min(pos) FILTER (early IS NULL AND NOT coalesce(leak, false)) OVER (PARTITION BY source_id, quote), false) AS dup FROM l), "
    "z AS (SELECT *, CASE WHEN early IS NOT NULL THEN early WHEN dup THEN 'duplicate_claim' WHEN leak THEN 'metric_example_leak' END AS reason FROM y) "
    "SELECT coalesce(reason, 'accepted') AS reason, batch, count(*) AS n, count(*) FILTER (WHERE reason IS NULL) AS ids FROM z GROUP BY ALL"
)
def validate_claims(table):
    """A quotation from each document as a claim: some unknown, made up, not of the country, made twice or known before, or leaking an example (which also stands in texts whose quotation lacks it); reasons counted by batch."""
    d = table("documents").select("doc_id", "text")
    c = d.select((F.col("doc_id") % 10).alias("batch"), F.col("doc_id").alias("pos"), F.when(F.col("doc_id") % 11 == 0, F.lit(-1)).otherwise(F.col("doc_id")).alias("source_id"), F.when(F.col("doc_id") % 7 == 0, "nowhere in it").otherwise(F.substring("text", 1, 60)).alias("quote"), (F.col("doc_id") % 5 != 0).alias("country_specific"), "text")
    c = c.union(c.where("pos % 6 = 0").withColumn("pos", F.col("pos") + 1000000))
    known = d.where("doc_id % 13 = 0").select(F.concat_ws("::", "doc_id", t.normalize_quote(F.substring("text", 1, 60))).alias("fingerprint"))
    example = F.when(F.col("pos") % 9 == 0, F.substring("text", 1, 50)).when(F.col("pos") % 9 == 1, F.substring("text", 61, 60))
    out = e.validate_claims(c, d.select(F.col("doc_id").alias("source_id"), "text"), known, example)
    return out.groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason"), "batch").agg(F.count("*").alias("n"), F.count("claim_id").alias("ids"))


@query(
    "WITH s AS (SELECT l_orderkey AS statement_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS i, l_partkey AS claim_id FROM lineitem), "
    "x AS (SELECT statement_id, p_brand AS uri, p_size AS page, min(i) AS i FROM s JOIN part ON p_partkey = claim_id GROUP BY ALL) "
    "SELECT statement_id, list(uri || '#' || page ORDER BY i, uri, page) AS citations FROM x GROUP BY 1"
)
def resolve_citations(table):
    """Orders as statements, their lines as claims, parts as sources."""
    li = table("lineitem").groupBy(F.col("l_orderkey").alias("statement_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("claim_ids"))
    p = table("part")
    claims = p.select(F.col("p_partkey").alias("claim_id"), F.col("p_partkey").alias("source_id"))
    return e.resolve_citations(li, claims, p.select(F.col("p_partkey").alias("source_id"), F.col("p_brand").alias("uri"), F.col("p_size").alias("page")))


@query(
    "WITH x AS (SELECT event_id % 2 = 0 AS h, event_id % 3 AS l, ['return_insufficient_evidence', 'draft_answer', 'generate_more_queries'][1 + (event_id // 6 % 3)::INT] AS said, ['entailed', 'partially_entailed', 'contradicted'][1 + (event_id % 3)::INT] AS v, event_id % 4 AS a FROM events) "
    "SELECT CASE WHEN h AND said = 'return_insufficient_evidence' THEN 'draft_answer' WHEN h AND l <= 0 AND said = 'generate_more_queries' THEN 'draft_answer' WHEN NOT h AND l <= 0 AND said <> 'return_insufficient_evidence' THEN 'return_insufficient_evidence' WHEN NOT h AND l > 0 AND said = 'draft_answer' THEN 'generate_more_queries' ELSE said END AS action, "
    "CASE WHEN v = 'entailed' OR v = 'partially_entailed' AND a >= 2 THEN 'keep' WHEN a >= 2 THEN 'drop' ELSE 'repair' END AS verdict, count(*) AS n FROM x GROUP BY ALL"
)
def research_actions(table):
    """The rules between research rounds and for a statement's verification."""
    pick = lambda xs, i: F.element_at(F.array(*[F.lit(x) for x in xs]), (i + 1).cast("int"))
    i = F.col("event_id")
    said = pick(("return_insufficient_evidence", "draft_answer", "generate_more_queries"), F.floor(i / 6) % 3)
    action = e.next_action(i % 2 == 0, i % 3, said)
    verdict = e.verdict_action(pick(("entailed", "partially_entailed", "contradicted"), i % 3), i % 4, F.lit(2))
    return table("events").groupBy(action.alias("action"), verdict.alias("verdict")).agg(F.count("*").alias("n"))


@query(
    "WITH y AS (SELECT o_custkey, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY ALL) "
    "SELECT o_custkey, '| year | value |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || y || ' | ' || n || ' |', chr(10) ORDER BY y) AS \"table\" FROM y GROUP BY 1"
)
def report_series(table):
    y = table("orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"))
    return rp.series_table(y, "o_custkey", "y", "n")


@query(
    "SELECT c_nationkey, string_agg('## ' || c_custkey || '. ' || c_name || chr(10) || chr(10) || 'Segment ' || c_mktsegment, chr(10) || chr(10) ORDER BY c_custkey) AS report FROM customer GROUP BY 1"
)
def report_sections(table):
    c = table("customer").withColumn("part", rp.section(F.col("c_custkey"), F.col("c_name"), F.concat(F.lit("Segment "), "c_mktsegment")))
    return rp.joined(c, "c_nationkey", "c_custkey", "part")


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'worldbank' ELSE 'researcher' END AS route, p_name || '. - ' || (1990 + p_size) || '. Pages ' || p_size || '. https://example.org/' || p_partkey AS citation FROM part")
def citations(table):
    p = table("part")
    sources = F.when(F.col("p_size") % 3 == 0, F.array(F.lit("WorldBank"), F.lit("WorldBank"))).when(F.col("p_size") % 3 == 1, F.array(F.lit("WorldBank"), F.lit("web"))).otherwise(F.expr("cast(array() AS array<string>)"))
    cite = t.citation(F.col("p_name"), F.col("p_size") + 1990, F.col("p_size").cast("string"), F.concat(F.lit("https://example.org/"), F.col("p_partkey").cast("string")))
    return p.select("p_partkey", rp.metric_route(sources).alias("route"), cite.alias("citation"))


def halving() -> wf.Workflow:
    """shrink: size halved, back to itself while over 4, then to tag, with count beside it if even; tag: value + 1; count: value + 10."""
    plus = lambda n: lambda df: df.withColumn("value", F.col("value") + n)
    half = lambda df: df.withColumn("size", F.floor(F.col("size") / 2))
    to = [("size > 4", ["shrink"]), ("size <= 4 AND size % 2 = 1", ["tag"]), ("size <= 4 AND size % 2 = 0", ["tag", "count"])]
    return wf.Workflow("halving", [wf.Node("shrink", half, to), wf.Node("tag", plus(1)), wf.Node("count", plus(10))], ["shrink"])


@query(
    "WITH RECURSIVE w(document_id, size) AS (SELECT doc_id, n_chars % 50 // 2 FROM documents UNION ALL SELECT document_id, size // 2 FROM w WHERE size > 4) "
    "SELECT document_id, min(size) AS size, CASE WHEN min(size) % 2 = 1 THEN 1 ELSE 11 END AS value, count(*) + CASE WHEN min(size) % 2 = 1 THEN 1 ELSE 2 END AS tasks, 'completed' AS status FROM w GROUP BY 1"
)
def workflow_run(table):
    """A cyclic workflow over all documents, from what is left of their lengths."""
    docs = table("documents").select(F.col("doc_id").cast("string").alias("document_id"), (F.col("n_chars") % 50).alias("size"), F.lit(0).cast("long").alias("value"))
    flow = halving()
    tasks, docs = wf.run(flow, wf.submit(flow, docs), docs)
    per = tasks.groupBy("document_id").agg(F.count("*").alias("tasks"), F.max("status").alias("status"))
    return docs.join(per, "document_id").select(F.col("document_id").cast("long").alias("document_id"), "size", "value", "tasks", "status")


@query(
    "WITH d AS (SELECT doc_id, n_chars FROM documents) SELECT doc_id::VARCHAR AS document_id, 'extract' AS step, 1 AS seq, CASE WHEN n_chars < 300 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN n_chars < 300 THEN 'too short' END AS error FROM d "
    "UNION ALL SELECT doc_id::VARCHAR, 'tag', 1, 'completed', NULL FROM d"
)
def pipeline_run(table):
    """Two steps, the first failing for short documents; the second runs all the same, and a repeated pass records nothing new."""
    d = table("documents").select(F.col("doc_id").cast("string").alias("document_id"), "n_chars")
    extract = lambda x: x.select("document_id", F.when(F.col("n_chars") < 300, "failed").otherwise("completed").alias("status"), F.when(F.col("n_chars") < 300, "too short").alias("error"))
    tag = lambda x: x.select("document_id", F.lit("completed").alias("status"), F.lit(None).cast("string").alias("error"))
    steps = [("extract", extract), ("tag", tag)]
    return wf.pipeline(d, steps, wf.pipeline(d, steps))
