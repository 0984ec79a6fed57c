"""The evidence store's operators over the given tables, each beside the SQL that gives the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import classify as c
from granary.functions import text as t
from granary.operators import evidence as ev
from granary.operators import graph as g
from granary.operators import lookups as lk
from granary.operators import quotes
from granary.operators import tables as tb
from granary.operators import tasks as tk
from granary.operators.store import shared_folder
from granary.sources.buckets import BucketTable

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (table, ...) -> DataFrame, where table(name) reads one of the given tables."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, d: f(lambda name: spark.read.parquet(f"{d}/{name}.parquet"))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- content and text -------------------------------------------------------------------------


@query("SELECT page_id, CASE WHEN html LIKE '\\%PDF%' ESCAPE '\\' THEN 'pdf' WHEN lower(substr(regexp_replace(html, '^\\s+', ''), 1, 512)) LIKE '<!doctype%' OR contains(lower(substr(regexp_replace(html, '^\\s+', ''), 1, 512)), '<html') THEN 'html' ELSE 'other' END AS kind FROM pages")
def content_kind(table):
    return table("pages").select("page_id", c.content_kind(F.col("html")).alias("kind"))


#: Pages and what their addresses make of a client-rendered page, one in six as it is.
_SHELLS = """CASE page_id % 6
WHEN 0 THEN html
WHEN 1 THEN '<!doctype html><html><body><div class="x" id="' || CASE page_id % 5 WHEN 0 THEN 'root' WHEN 1 THEN 'main' WHEN 2 THEN '__next' WHEN 3 THEN '_r_' ELSE '___gatsby' END || '"> </div><p>' || url || '</p></body></html>'
WHEN 2 THEN '<!doctype html><html><body><div id="root">' || url || '</div></body></html>'
WHEN 3 THEN '<html><body><my-list class="x"></my-' || CASE page_id % 5 WHEN 0 THEN 'menu' ELSE 'list' END || '><a href="' || url || '">x</a></body></html>'
WHEN 4 THEN '<html ' || CASE page_id % 5 WHEN 0 THEN 'data-v-app' WHEN 1 THEN 'Q:Container' ELSE 'lang="x"' END || '><body>' || url || '</body></html>'
ELSE '<html><script>1</script><script src="' || url || '"></script><SCRIPT>' || CASE page_id % 5 WHEN 0 THEN '</script>' ELSE '</script><script></script>' END || '</html>' END"""


@query(
    f"WITH p AS (SELECT page_id, lower({_SHELLS}) AS h FROM pages), "
    "x AS (SELECT page_id, h, length(trim(regexp_replace(regexp_replace(regexp_replace(h, '(?s)<script\\b[^>]*>.*?</script>|<style\\b[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))) AS seen, "
    "len(regexp_extract_all(h, '<a\\b[^>]*\\bhref\\s*=')) AS links, len(regexp_extract_all(h, '<script\\b')) AS scripts, "
    "regexp_matches(h, '<div[^>]*\\bid=[\"\'\'](root|app|__next|___gatsby|_r_)[\"\'\'][^>]*>\\s*</div>') "
    "OR len(list_filter(list_zip(regexp_extract_all(h, '<([a-z][a-z0-9]*-[a-z0-9-]*)\\b[^>]*>\\s*</([a-z][a-z0-9-]*)>', 1), regexp_extract_all(h, '<([a-z][a-z0-9]*-[a-z0-9-]*)\\b[^>]*>\\s*</([a-z][a-z0-9-]*)>', 2)), lambda z: z[1] = z[2])) > 0 "
    "OR len(list_filter(['data-reactroot', 'ng-version=', '<app-root', '__next_f', 'data-v-app', '__sveltekit', 'q:container', 'astro-island'], lambda m: contains(h, m))) > 0 AS mark FROM p) "
    "SELECT page_id, seen, links, scripts, CASE WHEN seen >= 500 AND links >= 3 THEN false WHEN mark AND seen < 300 THEN true ELSE scripts >= 3 AND links = 0 AND seen < 300 END AS shell FROM x"
)
def spa_shell(table):
    """Client-rendered pages among pages and what is made of their addresses."""
    html = F.col("html")
    made = table("pages").select("page_id", F.expr(_SHELLS).alias("html"))
    return made.select("page_id", c.visible_length(html).cast("long").alias("seen"), F.regexp_count(html, F.lit(c.LINK)).cast("long").alias("links"), F.regexp_count(html, F.lit(c.SCRIPT)).cast("long").alias("scripts"), c.spa_shell(html).alias("shell"))


_VIEWERS = "CASE WHEN page_id % 10 = 3 THEN repeat('\u00e9', 150 + (page_id % 300)::INT) WHEN page_id % 20 = 10 THEN '\n \t<HTML><LINK href=\"PDF_Embedder.CSS\">' || html WHEN page_id % 5 = 0 THEN '<html><link href=\"' || CASE page_id % 2 WHEN 0 THEN 'chrome-extension://x/' ELSE '' END || 'pdf_embedder.css\">' || html WHEN page_id % 5 = 1 THEN '%PDF' || url ELSE html END"


@query(
    f"WITH p AS (SELECT {_VIEWERS} AS h FROM pages) "
    "SELECT CASE WHEN starts_with(h, '%PDF') THEN 'useful' WHEN strlen(h) < 512 OR contains(lower(substr(ltrim(h, ' ' || chr(10) || chr(9)), 1, 2048)), 'pdf_embedder.css') OR contains(lower(substr(ltrim(h, ' ' || chr(10) || chr(9)), 1, 2048)), 'chrome-extension://') THEN 'useless' ELSE 'useful' END AS verdict, count(*) AS n, sum(length(h))::BIGINT AS chars FROM p GROUP BY 1"
)
def useless_body(table):
    """Pages, a fifth of them behind a browser's PDF viewer (some indented, in capitals), a fifth small PDFs, a tenth short texts of two bytes a character."""
    v = F.when(c.useless(F.col("html")), "useless").otherwise("useful")
    return table("pages").select(F.expr(_VIEWERS).alias("html")).groupBy(v.alias("verdict")).agg(F.count("*").alias("n"), F.sum(F.length("html")).alias("chars"))


@query("SELECT page_id, url, nullif(regexp_extract(lower(regexp_replace(url, '[?#].*$', '')), '\\.(pdf|html|htm|docx|doc|pptx|ppt)$', 1), '') AS suffix, substr(sha256(url), 1, 16) AS url_hash, replace(replace(replace(replace(url_encode(url), '+', '%20'), '*', '%2A'), '%7E', '~'), ' ', '%20') AS encoded FROM pages")
def url_parts(table):
    u = F.col("url")
    return table("pages").select("page_id", "url", t.url_suffix(u).alias("suffix"), t.short_hash(u).alias("url_hash"), t.percent_encode(u).alias("encoded"))


@query("SELECT url, i - 1 AS pos, h[i] AS href FROM (SELECT url, regexp_extract_all(html, '(?i)<a\\s[^>]*href\\s*=\\s*[\"'']([^\"'']*)[\"'']', 1) AS h FROM pages), unnest(range(1, len(h) + 1)) AS x(i)")
def link_extract(table):
    return g.links(table("pages"), "url", "html").withColumn("pos", F.col("pos").cast("long"))


_HREFS = "regexp_extract_all(html, '(?i)<a\\s[^>]*href\\s*=\\s*[\"\'\']([^\"\'\']*)[\"\'\']', 1)"


@query(
    f"WITH h AS (SELECT page_id, unnest({_HREFS}) AS url FROM pages), t AS (SELECT page_id, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS title FROM pages), "
    "k AS (SELECT page_id, url, NULL AS title FROM h UNION SELECT h.page_id + 1, url, title FROM h JOIN t USING (page_id)), "
    "x AS (SELECT page_id, contains(coalesce(html, ''), k.url) AS u, coalesce(title, '') = '' OR contains(coalesce(html, ''), title) AS t FROM k LEFT JOIN pages p USING (page_id)) "
    "SELECT page_id, count(*) AS links, count(*) FILTER (WHERE NOT u) AS bad_url, count(*) FILTER (WHERE NOT t) AS bad_title FROM x GROUP BY page_id"
)
def link_validate(table):
    """Each page's links, and those of the page before it with that page's title, looked for in its body."""
    p = table("pages")
    hrefs = p.select("page_id", F.explode(F.regexp_extract_all(F.col("html"), F.lit(r"""(?i)<a\s[^>]*href\s*=\s*["']([^"']*)["']"""), F.lit(1))).alias("url"), F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("title"))
    others = hrefs.select((F.col("page_id") + 1).alias("page_id"), "url", "title")
    out = g.links_in_body(p, hrefs.select("page_id", "url", F.lit(None).cast("string").alias("title")).union(others), "page_id", "html")
    return out.groupBy("page_id").agg(F.count("*").alias("links"), F.count_if(F.array_contains("reasons", "url_not_in_body")).alias("bad_url"), F.count_if(F.array_contains("reasons", "title_not_in_body")).alias("bad_title"))


@query("SELECT conv_id, turn, trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\\s+', ' ', 'g')) AS query, len(regexp_extract_all(text, '\\S+')) < 3 AS too_broad FROM conversations QUALIFY row_number() OVER (PARTITION BY query ORDER BY conv_id, turn) = 1")
def normalize_query_dedupe(table):
    rows = table("conversations").select("conv_id", "turn", t.normalize_query(F.col("text")).alias("query"), t.too_broad(F.col("text")).alias("too_broad"))
    return tb.first_seen(rows, ["query"], ["conv_id", "turn"]).select("conv_id", "turn", "query", "too_broad")


#: The rule in DuckDB's pattern language.
_QUANTITY = "'(?i)[0-9]+([.,][0-9]+)?\\s*(%|(percent|per\\s*cent)\\b|(ha\\b|hectares?\\b|acres?\\b|km²|km2\\b)|(tonnes?|tons?|kg|mt)\\b|(million|billion)\\b|(heads?|animals?|cattle|livestock|people|farmers?|households?)\\b)|(fell|rose|increased|decreased|declined|dropped|grew|lost|loss|losses)\\s+(by\\s+)?[0-9]'"
#: Units after each document's numbers, since its own text has hardly any.
_UNITS = "text || ' It ' || CASE doc_id % 8 WHEN 0 THEN 'fell by ' WHEN 1 THEN 'was ' ELSE 'had ' END || n_chars || CASE doc_id % 8 WHEN 0 THEN '' WHEN 1 THEN ' per cent' WHEN 2 THEN '%' WHEN 3 THEN ' km²' WHEN 4 THEN ' Tonnes' WHEN 5 THEN ' tonnage' WHEN 6 THEN ' in 1997' ELSE ',5 million' END || '.'"


@query(
    f"WITH d AS (SELECT doc_id, regexp_extract_all(CASE WHEN n_chars % 3 = 0 THEN {_UNITS} ELSE text END, '[^.!?\\n]+[.!?]') AS s FROM documents) SELECT doc_id, bool_or(regexp_matches(x, {_QUANTITY})) AS quantitative FROM d, unnest(s) AS u(x) GROUP BY doc_id"
)
def quantitative_flag(table):
    """Whether any sentence of a document holds a quantity; a third of them end with a figure."""
    d = table("documents").select("doc_id", F.expr(f"CASE WHEN n_chars % 3 = 0 THEN {_UNITS} ELSE text END").alias("text"))
    s = d.select("doc_id", t.sentences(F.col("text")).alias("s")).where(F.size("s") > 0)
    return s.select("doc_id", F.exists("s", ev.quantitative).alias("quantitative"))


@query(
    f"WITH d AS (SELECT doc_id, unnest(string_split(CASE WHEN doc_id % 9 = 0 THEN '' WHEN n_chars % 3 = 0 THEN {_UNITS} ELSE text END, chr(10))) AS x FROM documents), "
    f"s AS (SELECT doc_id, count(*) FILTER (WHERE regexp_matches(x, '\\S')) AS n, bool_or(regexp_matches(x, '\\S') AND regexp_matches(x, {_QUANTITY})) AS q FROM d GROUP BY doc_id) "
    "SELECT CASE WHEN n = 0 THEN 'cannot_answer' WHEN q THEN 'answered' ELSE 'high_level_answer' END AS status, count(*) AS docs FROM s GROUP BY 1"
)
def status_class(table):
    """Documents' lines as a report's statements: its status by whether there are any and whether one is quantitative."""
    lines = table("documents").select("doc_id", F.explode(F.split(F.expr(f"CASE WHEN doc_id % 9 = 0 THEN '' WHEN n_chars % 3 = 0 THEN {_UNITS} ELSE text END"), "\n", -1)).alias("x"))
    said = lines.select("doc_id", F.when(F.regexp_like("x", F.lit(r"\S")), F.col("x")).alias("x"))
    return ev.answer_status(said, "doc_id", "x").groupBy("status").agg(F.count("*").alias("docs"))


@query("SELECT doc_id, i - 1 AS chunk_index, length(l[i]) AS n_chars, sha256(l[i]) AS chunk_sha256 FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) AS x(i) WHERE regexp_matches(l[i], '\\S')")
def doc_chunks(table):
    """Lines as chunks; blank ones go, and the index counts them all the same."""
    x = F.col("chunk_text")
    return tb.chunked(table("documents"), "doc_id", "text").select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.length(x).cast("long").alias("n_chars"), F.sha2(x.cast("binary"), 256).alias("chunk_sha256"))


_PASSAGES = """SELECT item_id, text AS q FROM benchmark
UNION ALL SELECT 100000 + item_id, array_to_string(string_split(text, ' ')[2:CASE item_id % 3 WHEN 0 THEN 3 ELSE 5 END], ' ') FROM benchmark WHERE item_id % 2 = 0
UNION ALL SELECT 200000 + item_id, replace(text, ' ', '  ') FROM benchmark WHERE item_id % 4 = 1
UNION ALL SELECT 300000 + item_id, regexp_replace(text, '([a-z]{3})([a-z]{3})', '\\1-' || chr(10) || '\\2', 'g') FROM benchmark WHERE item_id % 4 = 2
UNION ALL SELECT 400000 + item_id, replace(replace(text, 'a', 'a' || chr(173)), 'fi', chr(64257)) FROM benchmark WHERE item_id % 4 = 3
UNION ALL SELECT 500000 + item_id, string_split(text, ' ')[3] FROM benchmark WHERE item_id % 20 = 7"""
_PLAIN = "trim(regexp_replace(regexp_replace(replace(replace(regexp_replace({}, '(\\w)-\\n(\\w)', '\\1\\2', 'g'), chr(173), ''), chr(64257), 'fi'), '[ \\t]+', ' ', 'g'), '\\n+', ' ', 'g'))"


@query(
    f"WITH p AS (SELECT item_id, q, {_PLAIN.format('q')} AS nq FROM ({_PASSAGES}) AS x), d AS MATERIALIZED (SELECT doc_id, text, {_PLAIN.format('text')} AS s FROM documents) "
    "SELECT item_id, doc_id, CASE WHEN contains(text, q) THEN 'exact' ELSE 'normalized' END AS match FROM p JOIN d ON contains(text, q) OR contains(s, nq)"
)
def quote_match(table):
    """Which document holds which passage, word for word or normalised: benchmark items as they are, some words of them, and with other blanks, hyphenated lines, soft hyphens and ligatures."""
    b = table("benchmark").select("item_id", "text")
    some = lambda when, base, text: b.where(when).select((F.col("item_id") + base).alias("item_id"), text.alias("text"))
    x, words = F.col("text"), F.split("text", " ")
    parts = [
        some("item_id % 2 = 0", 100000, F.array_join(F.slice(words, F.lit(2), F.when(F.col("item_id") % 3 == 0, 2).otherwise(4)), " ")),
        some("item_id % 4 = 1", 200000, F.replace(x, F.lit(" "), F.lit("  "))),
        some("item_id % 4 = 2", 300000, F.regexp_replace(x, "([a-z]{3})([a-z]{3})", "$1-\n$2")),
        some("item_id % 4 = 3", 400000, F.replace(F.replace(x, F.lit("a"), F.lit("a\u00ad")), F.lit("fi"), F.lit("\ufb01"))),
        some("item_id % 20 = 7", 500000, F.get(words, F.lit(2))),
    ]
    for part in parts:
        b = b.union(part)
    return quotes.quoted(b, table("documents"), "item_id", "doc_id", "text")


# --- joins, aggregates, windows ---------------------------------------------------------------


@query("SELECT user_id, event_type, event_id, round(value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def bucket_upsert(table):
    """Events upserted by user and type in three batches, one of them twice, into a table of buckets."""
    e = table("events").select("user_id", "event_type", "event_id", "ts", F.round("value", 6).alias("value"))
    held = BucketTable(e.sparkSession, shared_folder(e.sparkSession, "latest"), e.schema, ["user_id", "event_type"], ["ts", "event_id"])
    for number in (0, 1, 1, 2):
        held.upsert(e.where(F.col("event_id") % 3 == 2 - number), number)
    return held.read().drop("ts")


@query("SELECT user_id, event_type, event_id, round(value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def latest_result(table):
    return tb.latest(table("events").select("user_id", "event_type", "event_id", "ts", "value"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", F.round("value", 6).alias("value"))


@query("SELECT event_type, event_id, 'running' AS status, 1 + event_id % 4 AS attempts FROM events WHERE event_id % 3 = 0 OR (event_id % 3 = 1 AND event_id % 4 < 3) QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) <= 25")
def fifo_claim(table):
    e = table("events").select(F.col("event_type").alias("stage_name"), "event_id", "ts", F.expr("CASE event_id % 3 WHEN 0 THEN 'scheduled' WHEN 1 THEN 'retrying' ELSE 'completed' END").alias("status"), (F.col("event_id") % 4).alias("attempts"))
    return tk.claim(e, 25, ["ts", "event_id"]).select(F.col("stage_name").alias("event_type"), "event_id", "status", "attempts")


@query("WITH h AS (SELECT user_id, max(ts) AS u FROM events GROUP BY 1), n AS (SELECT max(ts) AS now FROM events), s AS (SELECT user_id FROM h, n WHERE u < now - INTERVAL 90 MINUTE) SELECT event_id, CASE WHEN event_id % 2 = 0 AND s.user_id IS NOT NULL THEN 'scheduled' WHEN event_id % 2 = 0 THEN 'running' ELSE 'completed' END AS status, CASE WHEN event_id % 2 = 0 AND s.user_id IS NOT NULL THEN greatest(0, event_id % 3 - 1) ELSE event_id % 3 END AS attempts, CASE WHEN event_id % 2 = 0 AND s.user_id IS NOT NULL THEN NULL ELSE e.user_id END AS executor_id FROM events e LEFT JOIN s USING (user_id)")
def stale_sweep(table):
    """Users as workers: the last event is the heartbeat."""
    e = table("events").withColumn("ts", F.col("ts").cast("timestamp"))
    now = e.agg(F.max("ts")).first()[0]
    beats = e.groupBy(F.col("user_id").alias("executor_id")).agg(F.max("ts").alias("updated_at"))
    tasks = e.select("event_id", F.when(F.col("event_id") % 2 == 0, "running").otherwise("completed").alias("status"), (F.col("event_id") % 3).alias("attempts"), F.col("user_id").alias("executor_id"))
    return tk.sweep(tasks, tk.stale(beats, F.lit(now), 30)).select("event_id", "status", "attempts", "executor_id")


@query("SELECT l_orderkey AS run_id, count(*) AS total, count(*) FILTER (WHERE l_linestatus = 'F') AS completed, count(*) FILTER (WHERE l_returnflag = 'R' AND l_linestatus <> 'F') AS failed, count(*) FILTER (WHERE l_returnflag <> 'R' AND l_linestatus <> 'F') AS active FROM lineitem GROUP BY 1")
def run_progress(table):
    s = F.when(F.col("l_linestatus") == "F", "completed").when(F.col("l_returnflag") == "R", "failed").otherwise("running")
    return tk.progress(table("lineitem").select(F.col("l_orderkey").alias("run_id"), s.alias("status")))


@query("WITH x AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linestatus = 'F' THEN 'completed' WHEN l_returnflag = 'R' THEN 'failed' ELSE 'completed' END AS s FROM lineitem) SELECT l_orderkey AS run_id, CASE WHEN count(*) FILTER (WHERE l_linenumber = 1) > 0 AND count(*) FILTER (WHERE l_linenumber = 1 AND s <> 'completed') = 0 THEN 'completed' ELSE 'failed' END AS status FROM x GROUP BY 1")
def run_status(table):
    s = F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") != "F"), "failed").otherwise("completed")
    return tk.run_status(table("lineitem").select(F.col("l_orderkey").alias("run_id"), "l_linenumber", s.alias("status")), entry=F.col("l_linenumber") == 1)


@query("WITH x AS (SELECT event_id, user_id, CASE event_id % 4 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' WHEN 2 THEN 'odd' ELSE 'completed' END AS r, event_id % 5 AS a, event_id % 7 = 0 AS raised FROM events) SELECT event_id, CASE WHEN raised THEN 'failed' WHEN r = 'completed' THEN 'completed' WHEN r = 'failed' AND a < 3 THEN 'retrying' ELSE 'failed' END AS status, CASE WHEN raised OR r = 'odd' THEN 'Unhandled executor exception' WHEN r = 'failed' THEN CASE WHEN a < 3 THEN 'Stage failed' ELSE 'Stage failed; max attempts reached' END END AS error FROM x")
def task_outcome(table):
    e = table("events").select("event_id", F.expr("CASE event_id % 4 WHEN 1 THEN 'failed' WHEN 2 THEN 'odd' ELSE 'completed' END").alias("r"), (F.col("event_id") % 5).alias("a"), (F.col("event_id") % 7 == 0).alias("raised"))
    return e.select("event_id", tk.outcome(F.col("r"), F.col("a"), F.col("raised")).alias("status"), tk.outcome_error(F.col("r"), F.col("a"), F.col("raised"), F.lit(None).cast("string")).alias("error"))


@query("WITH o AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN ['b', 'c'] ELSE ['a', 'z'] END AS ts, 'a' AS node, o_custkey FROM orders), e AS (SELECT *, unnest(ts) AS t FROM o) SELECT t AS node, count(*) AS children, count(DISTINCT o_custkey) AS documents FROM e WHERE t IN ('a', 'b', 'c') GROUP BY 1")
def route_children(table):
    o = table("orders").select(F.col("o_orderkey").cast("string").alias("id"), F.lit("a").alias("node"), F.col("o_custkey").alias("document_id"), F.create_map(F.lit("k"), F.lit("v")).alias("context"), "o_orderstatus")
    child, _ = tk.route(o, F.when(F.col("o_orderstatus") == "F", F.array(F.lit("b"), F.lit("c"))).otherwise(F.array(F.lit("a"), F.lit("z"))), {"a": ["a", "b", "c"]})
    return child.groupBy("node").agg(F.count("*").alias("children"), F.countDistinct("document_id").alias("documents"))


@query("SELECT user_id, arg_max(event_type, event_id) AS last_type, sum(event_id % 3)::BIGINT AS attempts, list(event_id ORDER BY event_id) FILTER (WHERE event_type = 'purchase') AS pushed FROM events GROUP BY 1")
def event_fold(table):
    """Partial updates folded: set, increment, push."""
    e = table("events").select("user_id", "event_id", F.col("event_type").alias("last_type"), (F.col("event_id") % 3).alias("attempts"), F.when(F.col("event_type") == "purchase", F.col("event_id")).alias("pushed"))
    out = tk.fold(e, "user_id", "event_id", ["last_type"], ["attempts"], ["pushed"])
    return out.withColumn("pushed", F.when(F.size("pushed") > 0, F.col("pushed")))


@query("WITH r AS (SELECT DISTINCT l_orderkey, l_linenumber AS p FROM lineitem), g AS (SELECT *, p - row_number() OVER (PARTITION BY l_orderkey ORDER BY p) AS i FROM r), s AS (SELECT l_orderkey, min(p) AS a, max(p) AS b FROM g GROUP BY l_orderkey, i) SELECT l_orderkey, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ', ' ORDER BY a) AS pages FROM s GROUP BY 1")
def page_ranges(table):
    return tb.page_ranges(table("lineitem"), "l_orderkey", "l_linenumber")


@query("SELECT trim(l_partkey::VARCHAR) AS document_id, list_sort(list(DISTINCT l_linenumber)) AS pages FROM lineitem GROUP BY 1")
def grouped_pages_merge(table):
    x = table("lineitem").select(F.col("l_partkey").alias("document_id"), F.col("l_linenumber").alias("page"), "l_returnflag")
    return tb.grouped_pages([x.where("l_returnflag = 'R'"), x.where("l_returnflag != 'R'")], "document_id", "page")


@query("WITH a AS (SELECT l_suppkey AS id, 'old' AS source, list_sort(list(DISTINCT l_linenumber)) AS p FROM lineitem WHERE l_returnflag = 'R' AND l_suppkey % 3 > 0 GROUP BY 1), b AS (SELECT l_suppkey AS id, 'new' AS source, list_sort(list(DISTINCT l_linenumber)) AS p FROM lineitem WHERE l_returnflag = 'A' AND l_suppkey % 3 < 2 GROUP BY 1) SELECT id, coalesce(a.source, b.source) AS source, list_sort(list_distinct(list_concat(coalesce(a.p, []), coalesce(b.p, [])))) AS pages FROM a FULL JOIN b USING (id)")
def upsert_union(table):
    part = lambda flag, keep, name: table("lineitem").where((F.col("l_returnflag") == flag) & F.expr(f"l_suppkey % 3 {keep}")).groupBy(F.col("l_suppkey").alias("id")).agg(F.lit(name).alias("source"), F.array_sort(F.collect_set("l_linenumber")).alias("pages"))
    return tb.upsert_pages(part("R", "> 0", "old"), part("A", "< 2", "new"), "id")


@query("WITH n AS (SELECT o_orderkey, count(l_orderkey) AS lines FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1), b AS (SELECT l_orderkey, count(*) AS n_left, count(*) FILTER (WHERE l_quantity > 2) AS n_right FROM lineitem GROUP BY 1) SELECT l_orderkey, n_left, n_right FROM b WHERE n_left <> n_right")
def zip_join_mismatch(table):
    """Keys whose two lists differ in length."""
    x = table("lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    _, bad = tb.zip_checked(x, x.where("l_quantity > 2").withColumnRenamed("l_quantity", "q"), "l_orderkey", "l_linenumber", "q")
    return bad


@query("SELECT d.doc_id, source, n_chars FROM documents d WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_cited(table):
    return table("documents").join(table("labels").where("quality = 1"), "doc_id", "left_semi").select("doc_id", "source", "n_chars")


@query("SELECT d.doc_id, source, n_chars FROM documents d WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_known(table):
    return table("documents").join(table("labels"), "doc_id", "left_anti").select("doc_id", "source", "n_chars")


@query("SELECT event_type, user_id, min(event_id) AS event_id FROM events GROUP BY ALL")
def first_seen_dedupe(table):
    return tb.first_seen(table("events").select("event_type", "user_id", "event_id"), ["event_type", "user_id"], ["event_id"])


@query("SELECT coalesce(source, '(none)') AS source, lang, count(*) AS chunks, count(DISTINCT text) AS texts, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ALL")
def corpus_stats(table):
    return tb.corpus_counts(table("documents"), "source", "lang", "text", "n_chars")


@query(
    "WITH l AS (SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS v FROM events GROUP BY ALL) "
    "SELECT event_type, count(*) FILTER (WHERE v >= 50) AS ok, count(*) FILTER (WHERE v < 10) AS errors, count(*) FILTER (WHERE v >= 10 AND v < 50) AS others, coalesce(string_agg(DISTINCT 'value ' || floor(v)::INT, '; ' ORDER BY 'value ' || floor(v)::INT) FILTER (WHERE v < 10), '') AS messages FROM l GROUP BY 1"
)
def stage_report(table):
    """The latest result of each user and kind of event: counts by outcome, and the distinct errors."""
    v = F.col("value")
    status = F.when(v >= 50, "completed").when(v < 10, "failed").otherwise("running")
    e = table("events").select("user_id", "event_type", "ts", "event_id", status.alias("status"), F.concat(F.lit("value "), F.floor(v).cast("int").cast("string")).alias("error"))
    return tb.status_report(e, ["user_id", "event_type"], ["ts", "event_id"], "event_type", "status", "error").withColumn("messages", F.array_join("messages", "; "))


@query("WITH p AS (SELECT p_brand, list({'name': p_type, 'exclusive': p_size = 50} ORDER BY p_partkey) AS s FROM part GROUP BY 1) SELECT p_brand, CASE WHEN len(list_filter(s, lambda x: x.exclusive)) > 0 THEN list_transform(list_filter(s, lambda x: x.exclusive), lambda x: x.name) ELSE list_concat(['default'], list_transform(s, lambda x: x.name)) END AS sources FROM p")
def exclusive_sources(table):
    own = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", F.col("p_type").alias("name"), (F.col("p_size") == 50).alias("exclusive")))), lambda x: F.struct(x["name"].alias("name"), x["exclusive"].alias("exclusive")))
    p = table("part").groupBy("p_brand").agg(own.alias("own"))
    defaults = F.array(F.struct(F.lit("default").alias("name"), F.lit(False).alias("exclusive")))
    return p.select("p_brand", F.transform(tb.resolve_sources(defaults, F.col("own")), lambda x: x["name"]).alias("sources"))


@query("WITH y AS (SELECT o_custkey, year(o_orderdate) AS year, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY ALL) SELECT o_custkey, year, value FROM y WHERE year BETWEEN 1993 AND 1997")
def timeseries_long(table):
    """A wide table of years turned long again, blanks left out, an inclusive range of years."""
    years = [str(y) for y in range(1990, 2005)]
    wide = table("orders").withColumn("y", F.year("o_orderdate").cast("string")).groupBy("o_custkey").pivot("y", years).agg(F.round(F.sum("o_totalprice"), 2))
    out = tb.unpivoted(wide, ["o_custkey"], years)
    return out.where(tb.year_between(F.col("year"), 1993, 1997)).select("o_custkey", F.col("year").cast("long").alias("year"), "value")


@query("SELECT c_custkey, substr(n_name, 1, 1) || n_nationkey AS iso2 FROM customer JOIN nation ON n_nationkey = c_nationkey")
def two_letter_codes(table):
    """Customers' country codes, in lower case, to two-letter ones."""
    code = F.concat(F.upper(F.substring("n_name", 1, 3)), F.col("n_nationkey").cast("string"))
    n = table("nation").select("n_nationkey", code.alias("iso3"), F.concat(F.substring("n_name", 1, 1), F.col("n_nationkey").cast("string")).alias("iso2"))
    c = table("customer").join(n.select("n_nationkey", F.lower("iso3").alias("iso3")), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "iso3")
    return lk.two_letter_codes(c, n).select("c_custkey", "iso2")


@query("SELECT p_partkey, 'q=' || replace(replace(replace(url_encode(p_name), '+', '%20'), '*', '%2A'), '%7E', '~') || '&size=' || p_size AS entry FROM part")
def search_entries(table):
    """Parts as searches of two keys."""
    entry = F.create_map(F.lit("q"), F.col("p_name"), F.lit("size"), F.col("p_size").cast("string"))
    return table("part").select("p_partkey", t.search_entry(entry).alias("entry"))


@query("SELECT s_suppkey, upper(substr(n_name, 1, 3)) || n_nationkey AS iso3, CASE WHEN n_nationkey % 2 = 0 THEN 'The ' || n_name ELSE n_name END AS country FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def country_dimension(table):
    """Suppliers' country codes, in lower case, to official names, or plain ones where there are none."""
    code = F.concat(F.upper(F.substring("n_name", 1, 3)), F.col("n_nationkey").cast("string"))
    n = table("nation").select("n_nationkey", code.alias("iso3"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("The "), "n_name")).alias("official"))
    s = table("supplier").join(n.select("n_nationkey", F.lower("iso3").alias("iso3")), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "iso3")
    return lk.country_names(s, n).withColumn("iso3", F.upper("iso3"))


@query("SELECT user_id, event_id FROM (SELECT *, min((value >= 10)::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS ok FROM events) WHERE ok = 1")
def completed_prefix(table):
    return tb.completed_prefix(table("events").select("user_id", "event_id", "value"), "user_id", "event_id", F.col("value") >= 10).select("user_id", "event_id")


@query("WITH v AS (SELECT DISTINCT substr(sha256(p_brand || '|' || p_type), 1, 32) AS version_id, p_brand, p_type FROM part) SELECT version_id, p_brand, p_type FROM v WHERE p_brand <> 'Brand#11'")
def stage_versions(table):
    """Version rows that aren't stored yet."""
    want = table("part").select(t.version_id(F.col("p_brand"), F.col("p_type")).alias("version_id"), "p_brand", "p_type")
    return tb.get_or_create(want.where("p_brand = 'Brand#11'"), want, "version_id")


@query("SELECT c_custkey, coalesce(n, 0) AS orders, coalesce(v, c_acctbal) AS balance FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, round(max(o_totalprice), 2) AS v FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def replace_partition(table):
    """Delete and insert by key: new rows of a document take the place of all its old ones."""
    old = table("customer").select("c_custkey", F.lit(0).cast("long").alias("orders"), F.col("c_acctbal").alias("balance"))
    new = table("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"), F.round(F.max("o_totalprice"), 2).alias("balance"))
    return tb.replace_rows(old, new.join(old, "c_custkey", "left_semi"), "c_custkey")


@query("WITH s AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) SELECT o_custkey, o_orderkey, 'claim_' || CASE WHEN n < 1000 THEN lpad(n::VARCHAR, 3, '0') ELSE n::VARCHAR END AS claim_id FROM s")
def sequence_ids(table):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table("orders").select("o_custkey", "o_orderkey", t.numbered("claim", F.row_number().over(w)).alias("claim_id"))


# --- graph ------------------------------------------------------------------------------------

_EDGES = "e AS (SELECT DISTINCT 'n' || n_nationkey AS src, 'c' || c_custkey AS dst FROM nation JOIN customer ON c_nationkey = n_nationkey UNION SELECT DISTINCT 'c' || o_custkey, 'o' || o_orderkey FROM orders UNION SELECT DISTINCT 'r' || n_regionkey, 'n' || n_nationkey FROM nation UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"


def _edges(table):
    s = lambda p, col: F.concat(F.lit(p), F.col(col).cast("string"))
    n = table("nation")
    e = table("customer").select(s("n", "c_nationkey").alias("src"), s("c", "c_custkey").alias("dst")).join(n.select(s("n", "n_nationkey").alias("src")), "src", "left_semi")
    e = e.union(table("orders").select(s("c", "o_custkey"), s("o", "o_orderkey"))).union(n.select(s("r", "n_regionkey"), s("n", "n_nationkey")))
    return e.union(n.select(s("n", "n_nationkey"), s("r", "n_regionkey")))


@query(f"WITH RECURSIVE {_EDGES}, w(seed, node, depth) AS (SELECT DISTINCT 'r' || r_regionkey, 'r' || r_regionkey, 0 FROM region UNION SELECT w.seed, e.dst, w.depth + 1 FROM w JOIN e ON w.node = e.src WHERE w.depth < 5) SELECT seed, node, min(depth) AS depth FROM w GROUP BY ALL")
def reachable(table):
    """What each region leads to, over nations, customers and orders, with links back."""
    seeds = table("region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("seed"))
    return g.reachable(_edges(table), seeds)


@query(f"WITH {_EDGES} SELECT src, dst, 'link' AS type, 'to' AS side FROM e UNION ALL SELECT dst, src, 'link', 'from' FROM e")
def link_both_ways(table):
    return g.both_ways(_edges(table).withColumn("type", F.lit("link")))


@query()
def crawl_budget(table):
    """Depth first from every region with budgets of pages and files; orders are files."""
    seeds = table("region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("seed"))
    edges = _edges(table)
    edges = edges.withColumn("pos", F.crc32(F.col("dst").cast("binary")))
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("url")).distinct().withColumn("kind", F.when(F.startswith("url", F.lit("o")), "pdf").otherwise("html"))
    return g.crawl(edges, nodes, seeds, max_depth=4, max_files=50, max_urls=200)
