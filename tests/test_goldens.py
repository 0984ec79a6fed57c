"""Golden cases of the evidence store."""

import json

import pytest
from pyspark.sql import functions as F

from granary.functions import classify as c
from granary.functions import text as t
from granary.operators import evidence as ev
from granary.operators import graph as g
from granary.operators import report as rp
from granary.operators import lookups as lk
from granary.operators import quotes
from granary.operators import retrieval as r
from granary.operators import tables as tb
from granary.operators import tasks as tk
from granary.plans import workflow as wf
from granary.plans.evidence_queries import halving
from granary.sources import buckets, files


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


def test_content(spark):
    bodies = ["%PDF-1.4\n", "<!doctype html><html></html>", "\n\n<!DOCTYPE HTML>", "plain text"]
    assert column(spark, bodies, c.content_kind) == ["pdf", "html", "html", "other"]
    page = "<html><body>" + "<p>content</p>" * 80 + "</body></html>"
    assert column(spark, ["", "<html></html>", "%PDF-1.4" + "x" * 600, page, None], c.useless) == [True, True, False, False, True]
    shell = "\n <HTML><link href='PDF_EMBEDDER.css'>" + "x" * 600
    assert column(spark, [shell, "é" * 300, "é" * 255], c.useless) == [True, False, True]
    shell = "<!doctype html><html><body><div id='root'></div><script></script></body></html>"
    links = "<html>" + "<a href='x'>word word word</a>" * 60 + "</html>"
    assert column(spark, [shell, "%PDF", "not html", links], c.spa_shell) == [True, False, False, False]
    one = lambda x: f"<!doctype html><html><body>{x}</body></html>"
    marks = ["<div id='root'>text of the server</div>", "<my-app class='x'> </my-app>", "<my-app>text</my-app>", "<div data-v-app></div>", "<div id='main'></div>", "<script>1</script>" * 3, "<script>1</script>" * 3 + "<a href='x'>y</a>"]
    assert column(spark, [one(x) for x in marks], c.spa_shell) == [False, True, False, True, False, True, False]
    urls = spark.createDataFrame([("http://x/a.pdf?y", None), ("http://x/bitstreams/1/content/", None), ("http://x/y", "application/PDF; q"), ("http://x/y", None)], "u string, h string")
    assert [r[0] for r in urls.select(c.may_be_pdf(F.col("u"), F.col("h"))).collect()] == [True, True, True, False]
    kept_ = ["%PDF", "", '{"a": 1}', "  [1]", "<html>small</html>", "plain bytes"]
    assert column(spark, kept_, c.acceptable_capture) == [True, False, False, False, False, True]


def test_text(spark):
    assert column(spark, ["el nino", "a*b~c"], t.percent_encode) == ["el%20nino", "a%2Ab~c"]
    assert column(spark, ["http://x/a.PDF?y=1#z", "http://x/a", "http://x/a.docx"], t.url_suffix) == ["pdf", None, "docx"]
    assert column(spark, ["  A\n b ", "  "], t.normalize_title) == ["A b", None]
    src = "Kenya maize  production\nfell by 12%. The agri-\nculture sector"
    df = spark.createDataFrame([(0, "Kenya maize  production\nfell by 12%."), (1, "Kenya maize production fell by 12%."), (2, "rose by"), (3, "agriculture"), (4, " ")], "i int, q string")
    assert [x[0] for x in df.orderBy("i").select(t.quote_match(F.col("q"), F.lit(src))).collect()] == ["exact", "normalized", None, "normalized", "exact"]
    assert column(spark, ["ﬁve\u00adteen “marks”\u2014and  more\n\n", "a\u00a0b", "agri-\r\nculture"], t.normalize_quote) == ['fiveteen "marks"-and more', "a b", "agri- culture"]
    assert column(spark, ["Straße  A", "ＡＢＣ x"], t.normalize_query) == ["strasse a", "ａｂｃ x"]
    assert column(spark, [" Côte d’Ivoire.", "(The  Gambia)"], t.country_key) == ["côte d'ivoire", "the  gambia"]
    assert column(spark, [20.5, 123456.0, 0.00001234, 7.0, None], t.general4, "double") == ["20.5", "1.235e+05", "1.234e-05", "7", None]
    assert column(spark, [bytearray(b"ab\xff"), None], t.decoded, "binary") == ["ab\ufffd", None]
    labels = {"archive": "archive", "Main_Repository": "Repository"}
    assert column(spark, ["Archive", "main repository", "other", None], lambda x: t.origin_label(x, labels)) == ["archive", "Repository", "other", None]
    with pytest.raises(Exception, match="don't agree"):
        spark.range(1).select(t.expanded_urls(F.lit("http://x/{search}"), F.lit(None).cast("array<string>"))).collect()
    assert column(spark, [1, 12, 1234], lambda x: t.numbered("claim", x), "int") == ["claim_001", "claim_012", "claim_1234"]
    got = spark.range(1).select(t.citation(F.lit("Institute, Water Report"), F.lit(2021), F.lit("2-3, 5"), F.lit("https://example.org/d1"))).first()[0]
    assert got == "Institute, Water Report. - 2021. Pages 2-3, 5. https://example.org/d1"
    h = spark.createDataFrame([({"CONTENT-Type": "Text/HTML"},), ({},)], "h map<string,string>")
    assert [x[0] for x in h.select(t.header_value(F.col("h"), "content-type")).collect()] == ["text/html", None]


def test_ranges_and_years(spark):
    df = spark.createDataFrame([("a", p) for p in (8, 1, 2, 3, 5, 7, 7)], "k string, p int")
    assert tb.page_ranges(df, "k", "p").first()["pages"] == "1-3, 5, 7-8"
    wide = spark.createDataFrame([("KEN", 22.7, 21.5, None)], "iso3 string, `2020` double, `2021` double, `2022` double")
    assert sorted(map(tuple, tb.unpivoted(wide, ["iso3"], ["2020", "2021", "2022"]).collect())) == [("KEN", 2020, 22.7), ("KEN", 2021, 21.5)]
    with pytest.raises(ValueError):
        tb.year_between(F.col("x"), 2025, 2020)
    years = spark.createDataFrame([(1959,), (1960,), (2020,), (2024,), (2999,)], "y int")
    within = lambda a, b: [r.y for r in years.where(tb.year_between(F.col("y"), a, b)).collect()]
    assert within(2020, 2023) == [2020] and within(None, 1970) == [1960] and within(2020, None) == [2020, 2024] and len(within(None, None)) == 5
    codes = spark.createDataFrame([("ken",), ("UGA",)], "iso3 string")
    two = lambda dim: [r.iso2 for r in lk.two_letter_codes(codes, spark.createDataFrame(dim, "iso3 string, iso2 string")).orderBy("iso3").collect()]
    assert two([("KEN", "KE"), ("UGA", "UG")]) == ["UG", "KE"]
    for dim in ([("KEN", "KE")], [("KEN", "KE"), ("UGA", " ")]):
        with pytest.raises(Exception, match="no two letters"):
            two(dim)
    entry = spark.createDataFrame([({"q": "el nino", "year": "2010"},)], "m map<string,string>")
    assert entry.select(t.search_entry(F.col("m"))).first()[0] == "q=el%20nino&year=2010"


def test_pages_over_queries_and_upsert(spark):
    hits = spark.createDataFrame([("q1", " doc-1", 2), ("q1", "doc-1 ", 5), ("q2", "doc-2", 1), ("q2", " ", 3), ("q2", "doc-3", None)], "q string, document_id string, page int")
    new = tb.grouped_pages([hits.where("q = 'q1'"), hits.where("q = 'q2'")], "document_id", "page")
    assert {r.document_id: r.pages for r in new.collect()} == {"doc-1": [2, 5], "doc-2": [1], "doc-3": []}
    old = spark.createDataFrame([("doc-1", None, [1, 2]), ("doc-9", "s", [4])], "document_id string, source string, pages array<int>")
    out = {r.document_id: (r.source, r.pages) for r in tb.upsert_pages(old, new.withColumn("source", F.lit("api")), "document_id").collect()}
    assert out == {"doc-1": ("api", [1, 2, 5]), "doc-2": ("api", [1]), "doc-3": ("api", []), "doc-9": ("s", [4])}


def test_queue(spark):
    tasks = spark.createDataFrame([(1, "s", "scheduled", 0, 9), (2, "s", "retrying", 1, 1), (3, "s", "retrying", 3, 0), (4, "s", "completed", 1, 0)], "id int, stage_name string, status string, attempts int, at int")
    assert [(r.id, r.status, r.attempts) for r in tk.claim(tasks, 1, ["at", "id"]).collect()] == [(2, "running", 2)]
    runs = spark.createDataFrame([("a", None, "completed"), ("a", "x", "failed"), ("b", None, "failed"), ("c", "x", "completed"), ("d", None, "completed"), ("d", "x", "running")], "run_id string, parent_id string, status string")
    assert {r.run_id: r.status for r in tk.run_status(runs).collect()} == {"a": "completed", "b": "failed", "c": "failed", "d": "waiting"}
    done = spark.createDataFrame([("t", "a", {"k": "v"}, None), ("u", "a", {"k": "v"}, {"n": "w"})], "id string, node string, context map<string,string>, new_context map<string,string>")
    child, bad = tk.route(done, F.array(F.lit("b"), F.lit("zzz")), {"a": ["b"], "b": []})
    assert sorted((r.parent_id, r.node, tuple(r.context.items())) for r in child.collect()) == [("t", "b", (("k", "v"),)), ("u", "b", (("n", "w"),))]
    assert bad.count() == 2


def test_workflow(spark):
    docs = spark.createDataFrame([("d0", 21, 0), ("d1", 7, 0)], "document_id string, size int, value int")
    flow = halving()
    tasks, out = wf.run(flow, wf.submit(flow, docs), docs)
    assert {(r.document_id, r["size"], r.value) for r in out.collect()} == {("d0", 2, 11), ("d1", 3, 1)}
    assert {r.status for r in tasks.collect()} == {"completed"}
    assert {r.status for r in tk.run_status(tasks).collect()} == {"completed"}
    last = tasks.where("node IN ('tag', 'count')").groupBy("document_id").agg(F.countDistinct("parent_id").alias("n"), F.count("*").alias("m")).collect()
    assert {(r.document_id, r.n, r.m) for r in last} == {("d0", 1, 2), ("d1", 1, 1)}
    with pytest.raises(ValueError):
        wf.Workflow("x", [wf.Node("a", lambda d: d, [("true", ["b"])])], ["a"])
    with pytest.raises(ValueError, match="query"):
        wf.submit(wf.Workflow("x", [wf.Node("a", lambda d: d, needs=["query"])], ["a"]), docs)


def test_retries_end(spark):
    docs = spark.createDataFrame([("d",)], "document_id string")
    flow = wf.Workflow("x", [wf.Node("a", lambda d: d.withColumn("stage_status", F.lit("failed")))], ["a"])
    tasks, _ = wf.run(flow, wf.submit(flow, docs), docs)
    assert [(r.status, r.attempts, r.error) for r in tasks.collect()] == [("failed", 3, "Stage failed")]


EDGES = [("root", "page1"), ("root", "pdf2"), ("root", "page2"), ("page1", "pdf1"), ("page1", "page3"), ("page2", "page3"), ("page3", "pdf3"), ("page3", "pdf4")]


def test_crawl(spark):
    edges = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(EDGES)], "src string, dst string, pos int")
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("url")).distinct().withColumn("kind", F.when(F.startswith("url", F.lit("pdf")), "pdf").otherwise("html"))
    seeds = spark.createDataFrame([("root",)], "seed string")
    visits = lambda **k: [r.node for r in g.crawl(edges, nodes, seeds, **k).orderBy("n").collect()]
    assert visits() == ["root", "page1", "pdf1", "page3", "pdf3", "pdf4", "pdf2", "page2"]
    assert visits(max_files=2) == ["root", "page1", "pdf1", "page3", "pdf3"]
    assert visits(max_urls=3) == ["root", "page1", "pdf1"]
    assert visits(max_depth=1) == ["root", "page1", "pdf2", "page2"]
    depths = {r.node: r.depth for r in g.reachable(edges.union(spark.createDataFrame([("pdf4", "root", 9)], edges.schema)), seeds).collect()}
    assert depths == {"root": 0, "page1": 1, "page2": 1, "pdf2": 1, "page3": 2, "pdf1": 2, "pdf3": 3, "pdf4": 3}


def whole_crawl(edges, kinds, seed, max_depth, max_files, max_urls):
    """The crawl with the whole graph in memory."""
    out = {}
    for a, b, _ in sorted(edges, key=lambda e: (e[0], e[2] is None, e[2] or 0, e[1])):
        out.setdefault(a, []).append(b)
    seen, stack, got, n_files, n_urls = {seed}, [], [seed], 0, 1

    def push(page, depth):
        fresh = [c for c in dict.fromkeys(out.get(page, [])) if c not in seen]
        seen.update(fresh)
        stack.extend((c, depth) for c in reversed(fresh))

    push(seed, 1)
    while stack and n_files < max_files and (max_urls is None or n_urls < max_urls):
        node, depth = stack.pop()
        if depth > max_depth or node not in kinds:
            continue
        n_urls, n_files = n_urls + 1, n_files + (kinds[node] == "pdf")
        if kinds[node] in ("pdf", "html"):
            got.append(node)
        if kinds[node] == "html" and depth < max_depth:
            push(node, depth + 1)
    return got


def test_crawl_of_fetched_links(monkeypatch):
    """A crawl that knows a few links of a page at a time visits what one with the whole graph does, and never holds more than these."""
    import random

    monkeypatch.setattr(g, "AHEAD", 3)
    for seed in range(300):
        rnd = random.Random(seed)
        n = rnd.choice((5, 12, 30))
        name = [f"p{i}" for i in range(n)]
        edges = list({(a, b): (a, b, rnd.choice((None, *range(9)))) for a in name for b in rnd.sample(name, rnd.randint(0, min(n, 8)))}.values())
        kinds = {x: rnd.choice(("html", "html", "pdf", "image")) for x in name if rnd.random() < 0.9}
        depth, files, urls, links = rnd.randint(0, 5), rnd.randint(0, 6), rnd.choice((None, rnd.randint(0, 15))), rnd.randint(1, 4)
        fetched, most = {}, 0
        for _ in range(500):
            got, marked, soon, need = g._crawl(fetched, "p0", "html", links, depth, files, urls)
            if not need:
                break
            fetched = {x: fetched[x] for x in {*marked, *soon} if x in fetched}
            for page, part, upto, pos, url in need:
                at = {b: (p is None, p or 0, b) for a, b, p in edges if a == page and b in kinds and b != "p0"}
                old = {b for a, b, _ in edges if a in marked[:upto]}
                fresh = sorted(v for b, v in at.items() if b not in old and (part == 0 or v > (pos is None, pos or 0, url)))[: links + 1]
                fetched[page] = [*(fetched[page] if part else []), (upto, [(None if x[0] else x[1], x[2], kinds[x[2]]) for x in fresh])]
            most = max(most, len(fetched) - len(marked))
        assert not need and [x[0] for x in got] == whole_crawl(edges, kinds, "p0", depth, files, urls), seed
        assert most <= 4


def test_crawl_by_rounds(spark, monkeypatch):
    """Few links at a time, budgets that end in a large page, pages that link to marked ones, equal and missing places, seeds without links."""
    monkeypatch.setattr(g, "LINKS", 2)
    monkeypatch.setattr(g, "AHEAD", 2)
    edges = [("a", f"b{i}", 9 - i % 4) for i in range(7)] + [("b1", f"b{i}", i) for i in range(7)] + [("b3", x, None) for x in ("z", "y", "gone", "a")] + [("b3", "x", 5), ("b2", "y", 1), ("b2", "w", 1), ("b2", "w", 0), (None, "a", 0), ("b2", None, 0), ("only", None, 1)]
    kinds = {**{f"b{i}": "html" for i in range(7)}, "a": "html", "x": "pdf", "y": "pdf", "z": "image", "w": "pdf", "alone": "pdf"}
    e = spark.createDataFrame(edges, "src string, dst string, pos int")
    nodes = spark.createDataFrame(list(kinds.items()), "url string, kind string")
    seeds = spark.createDataFrame([("a",), ("a",), ("b2",), ("alone",), ("only",), ("nowhere",), (None,)], "seed string")
    got = {}
    for r in sorted(g.crawl(e, nodes, seeds, max_depth=3, max_files=3, max_urls=9).collect(), key=lambda r: r.n):
        got.setdefault(r.seed, []).append(r.node)
    fit = [x for x in edges if x[0] and x[1]]
    assert got == {s: whole_crawl(fit, kinds, s, 3, 3, 9) for s in ("a", "b2", "alone", "only")}


def test_titles(spark):
    df = spark.createDataFrame([("New", "Old", 2, 3), (None, "Old", 2, 3), (None, "Old", 1, 3), ("Only", None, 0, 0)], "d string, i string, t int, n int")
    title, ttl = g.title_state(F.col("d"), F.col("i"), F.col("t"), F.col("n"))
    assert [tuple(x) for x in df.select(title, ttl).collect()] == [("New", 3), ("Old", 1), (None, 0), (None, 0)]


def test_claims(spark):
    sources = spark.createDataFrame([("s1", "Maize production in Kenya fell by 12%. " + "long example text " * 8)], "source_id string, text string")
    ex = "long example text " * 4
    rows = [(0, "no", "Maize", True, "c"), (1, "s1", "rose", True, "c"), (2, "s1", "Maize", False, "c"), (3, "s1", "Maize  production", True, ex * 2), (6, "s1", ex.strip(), True, "c"), (7, "s1", ex.strip(), True, "c"), (8, "s1", "long  example", True, "c"), (4, "s1", "fell by 12%", True, "c"), (5, "s1", "fell  by 12%", True, "c")]
    claims = spark.createDataFrame([("b", *x) for x in rows], "batch string, pos int, source_id string, quote string, country_specific boolean, text string")
    known = spark.createDataFrame([], "fingerprint string")
    got = [(r.reason, r.claim_id) for r in ev.validate_claims(claims, sources, known, F.lit(ex)).orderBy("pos").collect()]
    assert got == [("unknown_source_id", None), ("substring_validation_failed", None), ("not_country_specific", None), (None, "claim_001"), (None, "claim_002"), ("duplicate_claim", None), ("metric_example_leak", None), ("metric_example_leak", None), (None, "claim_005")]


def test_mentions(spark):
    texts = spark.createDataFrame([(1, "Rain in Kenya and the Gambia.")], "id int, text string")
    m = spark.createDataFrame([(1, 0, "Kenya", "Kenya"), (1, 1, "Gambia", "The Gambia"), (1, 2, "", "Kenya"), (1, 3, "Peru", "Atlantis")], "id int, pos int, substring string, official_name string")
    dim = spark.createDataFrame([("Kenya", "KEN"), ("Gambia", "GMB")], "name string, iso3 string")
    got = {r.pos: (r.iso3, r.reasons) for r in ev.validate_mentions(m, texts, dim).collect()}
    assert got == {0: ("KEN", []), 1: ("GMB", []), 2: ("KEN", ["empty"]), 3: (None, ["not_in_text", "unknown_country"])}


def test_answer_status(spark):
    df = spark.createDataFrame([("a", None), ("b", "In 1997 heavy rains began."), ("c", "More than 35% of fields")], "k string, t string")
    assert {r.k: r.status for r in ev.answer_status(df, "k", "t").collect()} == {"a": "cannot_answer", "b": "high_level_answer", "c": "answered"}
    said = ["2,5 per cent", "12 km² of land", "3 Tonnes", "tonnage 3", "5 billion", "Yields fell by 3", "losses 4", "40 households", "in 2020 and 2021", "10 hay"]
    assert column(spark, said, ev.quantitative) == [True, True, True, False, True, True, True, True, False, False]


def test_fetch_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def fetch(urls):
        def go(batches):
            for b in batches:
                calls.add(b.num_rows)
                yield b

        return urls.mapInArrow(go, urls.schema).select("url", F.lit("x" * 600).alias("body"), F.lit(200).alias("status"))

    cache = spark.createDataFrame([("a", "y" * 600, 200, True)], "url string, body string, status int, successful boolean")
    got, fresh = files.fetch_cached(spark.createDataFrame([("a",), ("b",), ("c",)], "url string"), cache, fetch)
    assert got.count() == 3 and fresh.where("successful").count() == 3 and calls.value == 2


def test_quoted(spark):
    docs = spark.createDataFrame([(1, "The quick brown fox jumps over the lazy dog again"), (2, "catalogues of foxes"), (3, "")], "d long, text string")
    p = spark.createDataFrame([(10, "ick brown fox jumps over the la"), (11, "cat"), (12, "of fox"), (13, "brown  fox jumps over"), (14, ""), (15, "nothing like it here")], "p long, text string")
    got = sorted(map(tuple, quotes.quoted(p, docs, "p", "d", "text").collect()))
    assert got == [(10, 1, "exact"), (11, 2, "exact"), (12, 2, "exact"), (13, 1, "normalized")]


def test_hybrid(spark):
    a = spark.createDataFrame([(1, 1, 10), (1, 2, 11)], "query_id long, rank int, id long")
    b = spark.createDataFrame([(1, 1, 11), (1, 2, 12)], "query_id long, rank int, id long")
    assert [x.id for x in r.rank_fusion([(a, 1.0), (b, 1.0)], 2).orderBy("rank").collect()] == [11, 10]
    empty = spark.createDataFrame([(1, "  ")], "q long, t string")
    docs = spark.createDataFrame([(1, "some words")], "d long, x string")
    assert r.bm25_topk(docs, empty, 3, "d", "x", "q", "t").count() == 0


def test_sources(spark, tmp_path):
    (tmp_path / "u.json").write_text(json.dumps({"name": "u", "data_sources": [{"name": "A"}], "metrics": [{"name": "m1", "data_sources": [{"name": "WorldBank", "exclusive": True}, {"name": "B"}]}, {"name": "m2", "data_sources": [{"name": "T"}]}, {"name": "m3"}]}))
    assert [r.sources for r in files.use_case(spark, str(tmp_path / "u.json")).orderBy("n").collect()] == [["WorldBank"], ["A", "T"], ["A"]]
    (tmp_path / "0001.md").write_text("# T\n\n## 1. First\n\nbody\nmore\n## 2. Second\nx")
    (tmp_path / "0012.md").write_text("# T\n\nno heading")
    (tmp_path / "notes.md").write_text("other")
    got = rp.parsed_sections(files.report_files(spark, str(tmp_path)), "name", "text").orderBy("number").collect()
    assert [(s.number, s.title, s.body) for s in got] == [(1, "First", "## 1. First\n\nbody\nmore\n## 2. Second\nx"), (12, "Metric 12", "## 12. Metric 12\nno heading")]
    whole = rp.combined(files.report_files(spark, str(tmp_path)).withColumn("k", F.lit(1)), "k", "name", "text").first().report
    assert whole == "# T\n\n## 1. First\n\nbody\nmore\n## 2. Second\nx\n\n## 12. Metric 12\nno heading\n"
    files.write_reports(spark.createDataFrame([(3, "## 3. x"), (14, "ä")], "number int, text string"), str(tmp_path / "out"))
    assert sorted((r.name, r.text) for r in files.report_files(spark, str(tmp_path / "out")).collect()) == [("0003.md", "## 3. x"), ("0014.md", "ä")]
    got = files.write_bodies(spark.createDataFrame([("a", "text", ".html"), ("b", None, None)], "id string, body string, suffix string"), f"file://{tmp_path}/bodies").collect()
    assert {r.id: r.path for r in got} == {"a": f"file://{tmp_path}/bodies/a.html", "b": f"file://{tmp_path}/bodies/b"}
    assert (tmp_path / "bodies" / "a.html").read_text() == "text"
    doc = {"title": "", "title_original": "N", "handle_url": "h", "organizations": ["x"], "lang": "en", "metadata": {"lang": "en", "extra": "y", "key_concepts": "z"}}
    body = lambda i, d, c: json.dumps({"document_id": i, "document": d, "chunks": c})
    chunks = [{"content": "Chunk A"}, {"content": None}]
    rows = [("d", body("d", doc, chunks)), ("e", body("x", doc, chunks)), ("f", body("f", {}, chunks)), ("g", body("g", {"handle_url": "h"}, chunks)), ("h", body("h", {"title": "t"}, chunks)), ("i", body("i", doc, [])), ("j", "no json")]
    got = files.external_document(spark.createDataFrame(rows, "document_id string, body string")).orderBy("document_id", "page_no").collect()
    assert [(x.document_id, x.title, x.page_no, x.text) for x in got if x.error is None] == [("d", "N", 1, "Chunk A"), ("d", "N", 2, "")]
    assert got[0].nested == {"extra": "y"} and got[0].metadata.keys() == {"title", "title_original", "handle_url", "lang"}
    assert [(x.document_id, x.error) for x in got[2:]] == [("e", "document_id differs"), ("f", "document missing"), ("g", "title missing"), ("h", "handle_url missing"), ("i", "chunks missing"), ("j", "document_id differs")]
    path = str(tmp_path / "chunks")
    one = spark.createDataFrame([("d", 99, "old"), ("e", 0, "keep")], "document_id string, i int, t string")
    files.write_chunks(one, path)
    files.write_chunks(spark.createDataFrame([("d", 0, "new")], one.schema), path)
    assert sorted((x.document_id, x.i, x.t) for x in spark.read.parquet(path).collect()) == [("d", 0, "new"), ("e", 0, "keep")]


def test_pipeline_records_once(spark):
    docs = spark.createDataFrame([("a",), ("b",)], "document_id string")
    bad = lambda d: d.select("document_id", F.when(F.col("document_id") == "a", "failed").otherwise("completed").alias("status"), F.lit(None).cast("string").alias("error"))
    good = lambda d: d.select("document_id", F.lit("completed").alias("status"), F.lit(None).cast("string").alias("error"))
    first = wf.pipeline(docs, [("s", bad), ("t", good)])
    again = wf.pipeline(docs, [("s", bad), ("t", good)], first)
    assert again.count() == first.count() == 4
    fixed = wf.pipeline(docs, [("s", good)], again)
    assert sorted((x.document_id, x.seq, x.status) for x in fixed.where("step = 's'").collect()) == [("a", 1, "failed"), ("a", 2, "completed"), ("b", 1, "completed")]


def drained(spark, stream, mode, name, checkpoint):
    """Run a stream over all there is, into a table in memory."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_streaming(spark, sf, tmp_path):
    from granary.streaming import queue as q

    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    live = drained(spark, q.live_progress(q.event_stream(spark, f"{tmp_path}/in"), "event_type"), "complete", "live", f"{tmp_path}/c1")
    assert {r.event_type: r.events for r in live.collect()} == {r.event_type: r["count"] for r in events.groupBy("event_type").count().collect()}
    first = drained(spark, q.first_only(q.event_stream(spark, f"{tmp_path}/in"), ["event_id"], "ts", "3650 days"), "append", "firsts", f"{tmp_path}/c2")
    assert first.count() == events.select("event_id").distinct().count()
    beats = q.event_stream(spark, f"{tmp_path}/in").select(F.col("user_id").alias("executor_id"), F.col("ts").alias("updated_at"))
    want = {r.user_id: r.t for r in events.groupBy("user_id").agg(F.max("ts").alias("t")).collect()}
    assert {r.executor_id: r.updated_at for r in drained(spark, q.live_heartbeats(beats), "complete", "beats", f"{tmp_path}/c3").collect()} == want
    held = buckets.BucketTable(spark, f"{tmp_path}/held", beats.schema, ["executor_id"], ["updated_at"], buckets=4)
    q.each_batch(beats, buckets.upsert_step(held), f"{tmp_path}/c4")
    assert {r.executor_id: r.updated_at for r in held.read().collect()} == want


def test_context_and_cascade(spark):
    df = spark.createDataFrame([(["a", "b"], {"a": "1"}), (["a"], None)], "r array<string>, c map<string,string>")
    assert [r[0] for r in df.select(tk.missing_context(F.col("r"), F.col("c"))).collect()] == [["b"], ["a"]]
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "src string, dst string")
    pending = spark.createDataFrame([("b", "p", "failed"), ("c", "p", "completed"), ("c", "q", "created"), ("y", "p", "failed")], "document_id string, pipeline string, status string")
    got = wf.cascade(edges, pending, spark.createDataFrame([("a",)], "document_id string")).collect()
    assert sorted(map(tuple, got)) == [("b", "p"), ("c", "q")]
    links = spark.createDataFrame([("https://x.org/a/b", "../c?d#e"), ("https://x.org/a", "//y.org/z"), ("https://x.org", None)], "url string, href string")
    assert [r.dst for r in g.resolved(links).collect()] == ["https://x.org/c?d#e", "https://y.org/z", None]
