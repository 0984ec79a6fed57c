"""The classifier by held-out accuracy, its risk and its edge cases."""

import zlib

import numpy as np
import pytest

from granary.llm import quality


def auc(pos, neg):
    return (pos[:, None] > neg[None]).mean() + 0.5 * (pos[:, None] == neg[None]).mean()


@pytest.fixture(scope="module")
def table(spark):
    return [r.asDict() for r in quality.op5_quality(spark, "/root/testdata/sf0.01").collect()]


def test_held_out_accuracy(spark, table):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert len(table) == 1000
    held = [r for r in table if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert all(r["held_out"] for r in held) and sum(r["held_out"] for r in table) == len(held)
    assert all(r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in table)
    pos = np.array([r["score"] for r in held if labels.get(r["doc_id"]) == 1])
    neg = np.array([r["score"] for r in held if labels.get(r["doc_id"]) == 0])
    assert auc(pos, neg) > 0.95
    assert (pos >= 0.7).mean() > 0.97 and (neg < 0.7).mean() > 0.8


def test_held_out_accuracy_by_language(spark):
    """What the readme claims, on the larger tables."""
    d = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in quality.op5_quality(spark, d).collect() if r.held_out and labels.get(r.doc_id) in (0, 1)]
    scores = lambda good, of=None: np.array([r.score for r in held if labels[r.doc_id] == good and (of is None or lang[r.doc_id] == of)])
    assert auc(scores(1), scores(0)) > 0.99
    assert all(auc(scores(1, x), scores(0, x)) > 0.98 for x in ("en", "de", "es", "fr"))
    assert (scores(1) >= 0.7).mean() > 0.97 and (scores(0) < 0.7).mean() > 0.85, ((scores(1) >= 0.7).mean(), (scores(0) < 0.7).mean())


def test_reruns_agree(spark, table):
    again = {r.doc_id: r.score for r in quality.op5_quality(spark, "/root/testdata/sf0.01").collect()}
    assert all(abs(again[r["doc_id"]] - r["score"]) < 1e-9 for r in table)


def test_held_out_labels_are_not_used(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    spoilt = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(doc_id AS string)) % 4 = 2 THEN 1 - quality ELSE quality END AS quality")
    a = {r.doc_id: r.score for r in quality.classify(docs, labels).collect()}
    b = {r.doc_id: r.score for r in quality.classify(docs, spoilt).collect()}
    assert a.keys() == b.keys() and all(abs(a[i] - b[i]) < 1e-9 for i in a)


def test_risk_does_not_fit_hidden_positives_as_negatives():
    rng = np.random.default_rng(4)
    pos = rng.normal(1.5, 1, (300, 5))
    unl = np.concatenate([rng.normal(1.5, 1, (700, 5)), rng.normal(-1.5, 1, (300, 5))])
    s = quality.fit(pos, unl, 0.7, steps=300).score(np.concatenate([rng.normal(1.5, 1, (500, 5)), rng.normal(-1.5, 1, (500, 5))]))
    assert (s[:500] >= 0.5).mean() > 0.93 and (s[500:] < 0.5).mean() > 0.93


def test_gradients_are_those_of_the_risk():
    """Every partial derivative against differences of the risk, on both sides of zero."""
    rng = np.random.default_rng(8)
    signs = set()
    for prior in (0.2, 0.9):
        for shift in (0.0, 3.0):
            p, u = rng.normal(1, 1, (20, 3)), rng.normal(shift, 1, (30, 3))
            w = [rng.normal(size=(3, 4)), rng.normal(size=4), rng.normal(size=4) * 2, np.array(rng.normal())]
            above = quality.risks(w, p, u, prior)[1] >= 0
            signs.add(bool(above))
            of = lambda w: sum(quality.risks(w, p, u, prior)) if above else -quality.risks(w, p, u, prior)[1]  # noqa: B023, E731
            for i, g in enumerate(quality.gradients(w, p, u, prior)):
                for at in np.ndindex(np.shape(w[i])):
                    more, less = [x.copy() for x in w], [x.copy() for x in w]
                    more[i][at] += 1e-6
                    less[i][at] -= 1e-6
                    assert abs((of(more) - of(less)) / 2e-6 - np.asarray(g)[at]) < 1e-5
    assert signs == {True, False}


def test_fit_reaches_what_plain_descent_reaches():
    """The risk after the fit against many small steps along differences of the risk, from the same kind of start."""
    rng = np.random.default_rng(9)
    p, u = rng.normal(1, 1, (40, 2)), np.concatenate([rng.normal(1, 1, (30, 2)), rng.normal(-2, 1, (30, 2))])
    model = quality.fit(p, u, 0.5, hidden=3, steps=400)
    mean, sd, *w = model.parts
    own = lambda x: np.clip((x - mean) / sd, -8, 8)
    risk = lambda w: (lambda a, b: a + max(0.0, b))(*quality.risks(w, own(p), own(u), 0.5))
    plain = [rng.normal(0, 0.7, (2, 3)), np.zeros(3), rng.normal(0, 0.6, 3), np.array(0.0)]
    for _ in range(1500):
        step = []
        for i, x in enumerate(plain):
            g = np.zeros(np.shape(x))
            for at in np.ndindex(np.shape(x)):
                more = [y.copy() for y in plain]
                more[i][at] += 1e-5
                g[at] = (risk(more) - risk(plain)) / 1e-5
            step.append(g)
        plain = [np.array(x - 0.3 * g) for x, g in zip(plain, step, strict=True)]
    assert risk(w) < risk(plain) + 0.03


@pytest.mark.parametrize("prior", [0.3, 0.6, 0.85])
def test_prior_from_positives_and_unlabelled(prior):
    rng = np.random.default_rng(3)
    n = int(2000 * prior)
    pos, unl = rng.normal(1.2, 1, (1500, 6)), np.concatenate([rng.normal(1.2, 1, (n, 6)), rng.normal(-1.2, 1, (2000 - n, 6))])
    assert abs(quality.estimated_prior(pos, unl) - prior) < 0.05
    assert quality.estimated_prior(pos[:3], unl) == 0.5


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, "a", 0.1), (1, "", "a", 0.1), (None, "x" * 100_000, None, 3.0), (4, "Some words.", "b", None)], "doc_id long, text string, good string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, none).collect()
    assert len(got) == 4 and {r.score for r in got} == {0.5} and {r.predicted for r in got} == {0}
    some = spark.createDataFrame([(4, 1, 0), (4, 1, 0), (1, None, 0), (None, 1, 1), (7, 5, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, some).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    assert quality.classify(docs.limit(0), some).count() == 0
    assert len(set(docs.columns) & set(quality.classify(docs, some).columns)) == 4
