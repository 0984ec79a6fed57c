"""Walks and titles against plain versions, names in texts against every place looked at."""

import random
from collections import deque
from urllib.parse import urljoin

import pytest

from granary.operators import discovery as d
from granary.operators import names as nm


def walk(edges, kinds, seeds):
    out, got = {}, set()
    for a, b, pos in edges:
        if a is not None and kinds.get(b) and kinds.get(a) == "page":
            out.setdefault(a, {})
            out[a][b] = min(pos, out[a].get(b, pos))
    told = []
    for _, seed in sorted({s: min(p for p, x in seeds if x == s) for _, s in seeds}.items(), key=lambda x: x[1]) and sorted((min(p for p, x in seeds if x == s), s) for s in {x for _, x in seeds}):
        if kinds.get(seed) != "page":
            continue
        visited, mine, queue = set(), set(), deque([(seed, 0)])
        while queue:
            page, depth = queue.popleft()
            if page in visited:
                continue
            visited.add(page)
            for dst in sorted(out.get(page, {}), key=lambda x: (out[page][x], x)):
                if kinds[dst] == "file":
                    if dst not in mine:
                        mine.add(dst)
                        if dst not in got:
                            told.append((seed, dst, depth + 1))
                elif dst not in visited:
                    queue.append((dst, depth + 1))
        got |= mine
    return [(s, f, dep, n) for n, (s, f, dep) in enumerate(told)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_files_in_order(spark, seed):
    rng = random.Random(seed)
    kinds = {f"p{i}": "page" for i in range(40)} | {f"f{i}": "file" for i in range(30)} | {"odd": "other"}
    names = [*kinds, "unknown"]
    edges, used = [], set()
    for _ in range(150):
        a, b, pos = rng.choice(names), rng.choice(names), rng.randrange(50)
        if (a, pos) not in used:
            used.add((a, pos))
            edges.append((a, b, pos))
    edges += [(None, "f1", 1), ("p1", None, 99)]
    seeds = [(2, "p3"), (1, "p7"), (3, "p3"), (4, "f2"), (5, "unknown"), (6, "p0")]
    got = d.files_reached(
        spark.createDataFrame(edges, "src string, dst string, pos int").repartition(3),
        spark.createDataFrame(list(kinds.items()), "url string, kind string"),
        spark.createDataFrame([(s, p) for p, s in seeds], "seed string, pos int"),
    )
    assert sorted(map(tuple, got.collect()), key=lambda x: x[3]) == walk(edges, kinds, seeds)


def test_long_chain_and_no_files(spark):
    edges = [(f"p{i}", f"p{i + 1}", 0) for i in range(12)] + [("p12", "f", 1), ("p12", "p0", 0)]
    kinds = [(f"p{i}", "page") for i in range(13)] + [("f", "file")]
    df = spark.createDataFrame(edges, "src string, dst string, pos int"), spark.createDataFrame(kinds, "url string, kind string")
    assert [tuple(r) for r in d.files_reached(*df, spark.createDataFrame([("p0", 1)], "seed string, pos int")).collect()] == [("p0", "f", 13, 0)]
    assert d.files_reached(*df, spark.createDataFrame([], "seed string, pos int")).count() == 0


@pytest.mark.parametrize("lasts", [0, 1, 3, 10])
def test_titles(spark, lasts):
    rng = random.Random(lasts)
    pages = [("r", None, "Root"), ("s", "gone", None), ("a", "b", None), ("b", "a", None)]
    for i in range(150):
        pages.append((f"n{i}", rng.choice(["r", "s", *[f"n{j}" for j in range(max(0, i - 4), i)]]), rng.choice([None, None, None, "", f"T{i}"])))
    by = {u: (p, t if (t or "").strip() else None) for u, p, t in pages}

    def inherited(u, depth=0):
        p = by[u][0]
        if p not in by or depth > 400:
            return None, 0
        if by[p][1]:
            return (by[p][1], lasts) if lasts > 0 else (None, 0)
        title, left = inherited(p, depth + 1)
        return (title, left - 1) if title and left - 1 > 0 else (None, 0)

    got = {r.url: (r.title, r.left) for r in d.inherited_titles(spark.createDataFrame(pages, "url string, parent string, title string"), lasts).collect()}
    assert got == {u: inherited(u) for u in by}


def test_addresses(spark):
    bases = ["https://e.org/a/b/c.html?q=1#x", "https://e.org", "http://e.org/", "https://e.org/a/../b/"]
    hrefs = ["", "x.pdf", "/y", "../z", "../../../up", "./", "..", "?k=v", "#part", "//host/p", "http://other/x", "mailto:a@b", "a/./b/../c?d#e", " sp ", "?q#f"]
    rows = [(b, h) for b in bases for h in hrefs]
    got = spark.createDataFrame(rows, "b string, h string").select("b", "h", d.link_address(d.F.col("b"), d.F.col("h")).alias("x")).collect()
    for r in got:
        want = urljoin(r.b, r.h.strip())
        assert r.x.split("#")[0].rstrip("/") == want.split("#")[0].rstrip("/"), (r.b, r.h, r.x, want)


def everywhere(text, names):
    low = nm.lowered(text)
    hits = set()
    for name, code in names:
        n = nm.lowered(name or "")
        for i in range(len(low)):
            if n and low.startswith(n, i):
                e = i + len(n)
                if not (i and nm._word(low[i - 1]) and nm._word(low[i])) and not (e < len(low) and nm._word(low[e]) and nm._word(low[e - 1])):
                    hits.add((i, e, n, min(c for m, c in names if nm.lowered(m or "") == n)))
    return sorted(h for h in hits if not any((o[0] <= h[0] and o[1] >= h[1]) and o[:2] != h[:2] for o in hits))


@pytest.mark.parametrize("at_once", [500_000, 3])
def test_names(spark, monkeypatch, at_once):
    monkeypatch.setattr(nm, "NAMES_SENT", at_once)
    names = [("Congo", "COG"), ("Democratic Republic of the Congo", "COD"), ("Republic of the Congo", "COG"), ("Niger", "NER"), ("Nigeria", "NGA"), ("Guinea", "GIN"), ("Guinea-Bissau", "GNB"), ("Côte d'Ivoire", "CIV"), ("niger", "AAA"), ("İzmir", "x"), ("", "no"), (None, "no"), ("São Tomé", "STP"), ("a b", "1"), ("b c", "2")]
    words = ["the", "congo", "Democratic Republic of the Congo", "NIGERIA", "Niger", "Nigerian", "Guinea-Bissau", "guinea,", "Côte d'Ivoire.", "xCongo", "İzmir", "𝒜", "São Tomé", "a b c", "Republic of the"]
    rng = random.Random(2)
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(12)))) for i in range(60)] + [(90, None), (91, ""), (92, "Congo" * 3), (None, "Congo")]
    got = nm.detected(spark.createDataFrame(texts, "id long, text string").repartition(3), spark.createDataFrame(names, "name string, code string"), "id", "text")
    want = sorted(repr((i, *h)) for i, t in texts for h in everywhere(t or "", names))
    assert sorted(repr(tuple(r)) for r in got.collect()) == want
    one = {r.id: (r.codes, r.spans) for r in nm.codes_of(got.where("id IS NOT NULL")).collect()}
    assert all(one[i] == (list(dict.fromkeys(h[3] for h in everywhere(t, names))), [h[2] for h in everywhere(t, names)]) for i, t in texts if i in one)
    assert nm.detected(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([], "name string, code string"), "id", "text").count() == 0
