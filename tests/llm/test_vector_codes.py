"""Vector codes against a plain version in Python's integers, and the query against its SQL."""

import hashlib
import math
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from granary.llm import vector_codes as vc


def plain(rows, parts=4, entries=256, rounds=4):
    """(vec_id, vector, label) -> the query's rows, in Python's integers."""
    rows = [r for r in rows if r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1])]
    width = -(-max((len(r[1]) for r in rows), default=0) // parts)
    whole = lambda v: [max(-vc.MOST, min(vc.MOST, math.floor(Fraction(c) * 1024))) for c in v] + [0] * (width * parts - len(v))
    cut = [[whole(r[1])[p * width : (p + 1) * width] for p in range(parts)] for r in rows]
    first = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))[:entries]
    books = [[list(cut[i][p]) for i in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda x, book: min((far(x, c), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            mine: dict = {}
            for x in cut:
                mine.setdefault(near(x[p], books[p])[1], []).append(x[p])
            for e, xs in mine.items():
                books[p][e] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out, by = [], {}
    for r, x in zip(rows, cut, strict=True):
        got = [near(x[p], books[p]) for p in range(parts)]
        error = min(sum(d for d, _ in got), 2**63 - 1)
        out.append((r[0], "".join(f"{e:02x}" for _, e in got), error, r[2]))
        by[r[2]] = by.get(r[2], 0) + error
    return sorted(repr((i, code, error, min(by[label], 2**63 - 1), sha)) for i, code, error, label in out)


def got(df):
    return sorted(repr(tuple(r)) for r in df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())


def rows_of(n, dim, seed, centres=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    if centres:
        x = rng.normal(size=(centres, dim))[rng.integers(0, centres, n)] + 0.01 * x
    return [(int(i), [float(np.float32(c)) for c in v], None if i % 7 == 0 else int(i % 3)) for i, v in enumerate(x)]


SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("seed, centres", [(1, 0), (2, 9)])
def test_against_plain(spark, seed, centres):
    rows = rows_of(420, 12, seed, centres)
    assert got(vc.coded(spark.createDataFrame(rows, SCHEMA).repartition(3))) == plain(rows)


def test_odd_rows(spark):
    rows = rows_of(40, 8, 3) * 2 + [(None, [0.5] * 8, None), (None, [0.25] * 8, 1), (5, [-0.0001] * 8, 4), (6, [0.1] * 5, 2), (7, [], None)]
    bad = [(8, None, 1), (9, [1.0, None] + [0.0] * 6, 1), (10, [float("nan")] * 8, 1), (11, [float("inf")] + [0.0] * 7, None)]
    assert got(vc.coded(spark.createDataFrame(rows + bad, SCHEMA))) == plain(rows + bad)
    assert got(vc.coded(spark.createDataFrame([], SCHEMA))) == [] == got(vc.coded(spark.createDataFrame(bad, SCHEMA)))
    assert got(vc.coded(spark.createDataFrame([(1, [], 3)], SCHEMA))) == plain([(1, [], 3)])
    more = spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in rows], SCHEMA + ", code string, error int")
    assert got(vc.coded(more)) == plain(rows)


def test_huge_components(spark):
    rows = [(i, [c * (-1) ** i * (1 + i) for c in v], label) for i, v, label in rows_of(30, 8, 4)]
    rows += [(100 + i, [1e9 * (i + 1)] * 8, 0) for i in range(4)] + [(200, [3e38] * 8, 1), (201, [-3e38] + [1e12] * 7, 1)]
    rows = [(i, [float(np.float32(c)) for c in v], label) for i, v, label in rows]
    want = plain(rows)
    assert got(vc.coded(spark.createDataFrame(rows, SCHEMA))) == want
    doubles = [(i, [1e308, -1e308, *v[2:]], label) for i, v, label in rows]
    assert got(vc.coded(spark.createDataFrame(doubles, SCHEMA.replace("float", "double")))) == plain(doubles)


def test_masks_hold_every_nearest_entry_and_few_others_in_clusters():
    rng = np.random.default_rng(5)
    centres = rng.integers(-1000, 1000, (130, 6))
    book = vc.Book(centres.tolist())
    x = centres[rng.integers(0, 130, 3000)] + rng.integers(-20, 21, (3000, 6))
    far = ((x[:, None] - centres[None]) ** 2).sum(2)
    entry, least = book.nearest(x)
    assert (entry == far.argmin(1)).all() and (least == far.min(1)).all()
    masks = book.candidates(x)
    held = np.unpackbits(masks.view(np.uint8), axis=1, bitorder="little")[:, :130]
    assert (held[np.arange(3000), entry] == 1).all() and held.sum(1).mean() < 13  # a tenth
    tied = vc.Book([[0, 0], [2, 0], [0, 0], [2, 2]])
    assert tied.nearest(np.array([[1, 0], [0, 0], [3, 3]]))[0].tolist() == [0, 0, 3]


def test_many_labels(spark, monkeypatch):
    rows = rows_of(60, 8, 6)
    monkeypatch.setattr(vc, "LABELS_SENT", 2)
    assert got(vc.coded(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_query(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = con.execute(f"SELECT vec_id, code, error, label_error, codebooks_sha256 FROM ({vc.SQL['op11_vector_codes']})").fetchall()
    assert got(vc.op11_vector_codes(spark, sf)) == sorted(map(repr, want))
