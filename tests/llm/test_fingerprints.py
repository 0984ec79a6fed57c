"""Fingerprints against a plain version, neighbours against a sorted list."""

import hashlib

import numpy as np

from granary.llm import fingerprints as fp


def plain(text, k=fp.K):
    """The same choice made k-mer by k-mer: least numbered k-mers by hash, ties by place, put in text order."""
    h = fp._numbered(text, k)
    out = []
    for x, m in zip(fp._XOR, fp._MULT):
        v = [int((int(a) ^ int(x)) * int(m) & 0xFFFFFFFF) for a in h]
        out.append(tuple(int(h[i]) for i in sorted(sorted(range(len(v)), key=lambda i: (v[i], i))[: fp.TUPLE])))
    return out


def test_choice_against_plain_version():
    texts = ["a", "ab", "abcdef", "abcdefg", "ababababab" * 5, "Order MinHash keeps the order of what it picks. " * 3, "漢字かな" * 9, "x" * 50]
    want, got = [plain(t) for t in texts], [fp.fingerprint(t) for t in texts]
    for i in range(len(texts)):
        for j in range(len(texts)):
            same = np.array([a == b and len(want[i]) == len(want[j]) for a, b in zip(want[i], want[j])])
            if min(map(len, (texts[i], texts[j]))) >= fp.K + fp.TUPLE - 1:
                assert np.array_equal(got[i] == got[j], same), (i, j)


def test_numbering_counts_occurrences():
    h = fp._numbered("abcabcabc", 3)
    assert len(set(h.tolist())) == 7  # repeats have numbers of their own
    a, b = fp._numbered("abcabc", 3), fp._numbered("xyzabcabc", 3)
    assert a[0] == b[3] and a[3] == b[6]


def test_sees_order_and_edits():
    rng = np.random.default_rng(3)
    w = [f"word{x}" for x in rng.integers(0, 10**6, 400)]
    text = " ".join(w)
    f = fp.fingerprint(text)
    turned = fp.likeness(f, fp.fingerprint(" ".join(w[200:] + w[:200])))
    near = fp.likeness(f, fp.fingerprint(" ".join([*w[:200], "changed", *w[201:]])))
    other = fp.likeness(f, fp.fingerprint(" ".join(f"word{x}" for x in rng.integers(0, 10**6, 400))))
    assert near > 0.9 and turned < 0.8 and other < 0.15
    assert fp.likeness(f, fp.fingerprint(text)) == 1


def expected(rows, df):
    hashed = {(r.text or ""): r.h for r in df.selectExpr("text", "xxhash64(coalesce(text, '')) AS h").collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashed[r[1] or ""]))
    out = []
    for i, (d, t) in enumerate(order):
        t, n = t or "", order[(i + 1) % len(order)][1] or ""
        e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        f, g, h = (fp.fingerprint(x) for x in (t, e, n))
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), fp.as_text(f), fp.as_text(g), fp.likeness(f, g), fp.likeness(f, h)))
    return sorted(out, key=repr)


def test_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(7)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, fp.compare_with_next(docs, bucket_rows=3).collect()), key=repr) == expected(rows, docs)


def test_one_id_is_dealt_to_many_buckets(spark):
    df = spark.range(0, 300, 1, 4).selectExpr("cast(NULL AS long) AS doc_id", "concat('text number ', id) AS text").union(spark.range(0, 300, 1, 4).selectExpr("5L", "'the same row'"))
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert sorted(map(tuple, fp.compare_with_next(df, bucket_rows=7).collect()), key=repr) == expected(rows, df)


def test_edge_cases(spark):
    schema = "doc_id long, text string, key long, b int"
    for rows in (
        [(5, "only one row here")],
        [(1, None), (2, ""), (3, "x"), (3, "x"), (3, "y"), (None, "no id at all"), (-7, "é" * 40), (2**62, "long " * 5000), (-(2**63), "least"), (2**63 - 1, "largest")],
        [(9, "same text")] * 5,
        [(None, "a text"), (None, None)],
    ):
        df = spark.createDataFrame([(*r, 1, 2) for r in rows], schema)
        assert sorted(map(tuple, fp.compare_with_next(df).collect()), key=repr) == expected(rows, df), rows
    assert fp.compare_with_next(spark.createDataFrame([], schema)).count() == 0
    got = fp.fingerprints(spark.createDataFrame([(1, None, 0, 0), (2, "ab", 0, 0)], schema)).collect()
    assert {r.doc_id: r.fingerprint for r in got} == {1: "0" * 16 * fp.COORDINATES, 2: fp.as_text(fp.fingerprint("ab"))}
