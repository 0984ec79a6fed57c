"""Quotations over tables against every pair looked at by itself."""

import random

import pytest
from pyspark.sql import functions as F

from granary.functions.text import quote_match
from granary.operators import quotes

PIECES = ["rain", "agri-\nculture", "ﬁve", "fi", "“marks”", '"', "’s", "a­b", "—", "-", "- ", "x y", "É", "É", "½", "  ", "\t", "\n", "\r\n", "12%", "…", "漢字", "ſt", "and", "the", "of", "maize", ",", "."]


def told(df):
    return sorted(tuple(r) for r in df.collect())


def brute(p, docs):
    both = p.crossJoin(docs).select("p", "d", quote_match(F.col("q"), F.col("t")).alias("match")).where("match IS NOT NULL")
    return told(both.groupBy("p", "d").agg(F.min("match")))


def texts(seed, n):
    rng = random.Random(seed)
    return [" ".join("".join(rng.choice(PIECES) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 25))) for _ in range(n)]


@pytest.mark.parametrize("most", [None, 0])
def test_against_every_pair(spark, monkeypatch, most):
    rng = random.Random(3)
    docs = [(i, t) for i, t in enumerate(texts(1, 40))] + [(100, None), (101, ""), (102, " "), (7, "rain and maize again")]
    cut = []
    for _, t in docs[:40]:
        for _ in range(4):
            a = rng.randrange(len(t))
            q = t[a : a + rng.choice([1, 3, 9, 30, 60, 200])]
            cut += [q, q.replace("\n", " "), q.replace("-\n", ""), q.replace("ﬁ", "fi").replace("­", ""), q.replace("“", '"').replace("”", '"').replace(" ", "  ")]
    p = [(i, q) for i, q in enumerate(cut)] + [(9000, None), (9001, ""), (9002, "-"), (9003, " "), (9004, "—"), (9005, "rain"), (9005, "maize"), (9006, "r"), (9007, "never there"), (9008, "never there at all, however long it is made to be")]
    p, docs = spark.createDataFrame(p, "p long, text string"), spark.createDataFrame(docs, "d long, text string")
    if most is not None:  # nothing is sent to the tasks
        monkeypatch.setattr(quotes, "SEEDS_SENT", most)
        monkeypatch.setattr(quotes, "PAIRS_SENT", most)
    got = told(quotes.quoted(p, docs, "p", "d", "text"))
    assert got == brute(p.withColumnRenamed("text", "q"), docs.withColumnRenamed("text", "t"))
    assert {"exact", "normalized"} == {m for _, _, m in got}


def test_cores_are_made_of_cores():
    for t in texts(4, 300):
        for at in (1, len(t) // 2):
            assert quotes.core(t) == quotes.core(t[:at]) + quotes.core(t[at:])


def test_every_passage_has_a_seed_in_its_text():
    rng = random.Random(5)
    for t in texts(6, 200):
        c = quotes.core(t)
        for _ in range(5):
            a = rng.randrange(max(1, len(c)))
            q = c[a : a + rng.choice([2, 8, 26, 27, 28, 80])]
            n, seed = quotes.passage_seed(q)
            assert n == 0 or seed in next(quotes.text_seeds(quotes._points(c), [n])).view("int64")
            assert quotes._points(t).tolist() == [ord(x) for x in c]


def test_few_seeds_a_text():
    """Long passages cost a text about two seeds for each window, not one a place."""
    x = quotes._points("".join(random.Random(7).choice("abcdefgh") for _ in range(50_000)))
    assert len(next(quotes.text_seeds(x, [quotes.GRAM]))) < 0.15 * len(x)


def test_empty_tables(spark):
    p, docs = spark.createDataFrame([], "p long, text string"), spark.createDataFrame([(1, "text")], "d long, text string")
    assert quotes.quoted(p, docs, "p", "d", "text").collect() == []
    assert quotes.quoted(spark.createDataFrame([(1, "text")], "p long, text string"), docs.where("d > 1"), "p", "d", "text").collect() == []
