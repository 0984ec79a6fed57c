"""Vectors of chunks, with the cases of misaligned, failed and blank ones; links by a table function."""

import numpy as np
import pytest

from granary.operators import embedding as em
from granary.sources import links


def test_hashed():
    h = em.Hashed(8)
    x = h(["", "one", "One one", "ß ÜBER 12", "!?", "one two three"])
    assert x.shape == (6, 8) and not x[0].any() and not x[4].any()
    assert np.allclose(x[1], x[2]) and np.allclose((x[[1, 3, 5]] ** 2).sum(1), 1)
    want = np.zeros(8)
    for w in ("one", "two", "three"):
        at, sign = h.place(w)
        want[at] += sign
    assert np.allclose(x[5], want / max(np.linalg.norm(want), 1e-9))


def test_chunks(spark):
    texts = [("a", 0, "Farmers in Kenya.", "t"), ("a", 1, "Markets in Uganda.", "t"), ("b", 0, "one", "t"), ("c", 0, "one", "t"), ("c", 1, "  ", "t"), ("c", 2, "two", "t"), ("d", 0, "x", "t"), ("e", 0, None, "t")]
    chunks = spark.createDataFrame(texts, "document_id string, chunk_index int, chunk_text string, title string")
    found = [("a", 0, ["KEN"], None), ("a", 1, ["UGA"], None), ("b", 0, ["KEN"], None), ("b", 1, ["KEN"], None), ("c", 0, None, "failed"), ("c", 1, [], None), ("c", 2, ["UGA"], None), ("e", 0, [], None), ("x", 0, [], None)]
    detections = spark.createDataFrame(found, "document_id string, chunk_index int, countries array<string>, error string")
    rows, counts = em.embed_chunks(chunks, detections, lambda ts: [[float(len(t)), 0.0] for t in ts], batch_size=2)
    got = sorted((r.document_id, r.chunk_index, r.title, r.countries, r.embedding) for r in rows.collect())
    assert got == [("a", 0, "t", ["KEN"], [17.0, 0.0]), ("a", 1, "t", ["UGA"], [18.0, 0.0]), ("c", 0, "t", [], [3.0, 0.0]), ("c", 2, "t", ["UGA"], [3.0, 0.0])]
    assert sorted(map(tuple, counts.collect())) == [("a", "COMPLETED", 2), ("b", "FAILED", 0), ("c", "COMPLETED", 2), ("d", "FAILED", 0), ("e", "COMPLETED", 0)]


def test_counts_are_checked(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "t string")
    with pytest.raises(Exception, match="vectors for"):
        em.embedded(df, "t", lambda ts: [[1.0]] * (len(ts) + 1)).collect()
    sizes = spark.sparkContext.accumulator(0)

    def embed(ts):
        sizes.add(1)
        assert len(ts) <= 4
        return em.Hashed(4)(ts)

    assert em.embedded(spark.range(50).selectExpr("cast(id AS string) AS t"), "t", embed, batch_size=4).count() == 50 and sizes.value >= 13
    assert em.embedded(df.limit(0), "t", em.Hashed(4)).count() == 0


def test_page_links(spark):
    links.register(spark)
    body = """<A class=x HREF='../p.pdf'>The <b>first</b>&amp; best</a> <a href="//y.org/?a=1&amp;b=2">two <a name=n>no</a><a href="#x"></a><a href='http://[bad'>x</a>"""
    spark.createDataFrame([("https://x.org/a/b", body), ("u", None), (None, "<a href='k'>t</a>")], "url string, body string").createOrReplaceTempView("pages_in")
    got = [tuple(r) for r in spark.sql("SELECT l.* FROM pages_in p, LATERAL page_links(p.url, p.body) l ORDER BY p.url NULLS LAST, pos").collect()]
    assert got == [(0, "../p.pdf", "https://x.org/p.pdf", "The first & best"), (1, "//y.org/?a=1&amp;b=2", "https://y.org/?a=1&b=2", "two"), (2, "#x", "https://x.org/a/b#x", None), (3, "http://[bad", None, "x"), (0, "k", None, "t")]
