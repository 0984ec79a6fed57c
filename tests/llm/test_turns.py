"""Repairs of conversations against every sequence of edits, and the query against a plain version."""

import hashlib
import itertools
import random
import zlib
from functools import lru_cache

import pytest

from granary.llm import turns

ROLES = ["system", "user", "assistant", "tool"]


def plain(codes: bytes) -> tuple[int, str]:
    """The cheapest edits by trying every edit at every place, whole audits compared."""

    @lru_cache(None)
    def best(i: int, said: str, inserted: int) -> tuple[int, str] | None:
        found = [(0, "")] if i == len(codes) and said in ("", "a") else []
        want = {"": "su", "s": "u", "u": "a", "a": "u"}[said]

        def add(cost, letter, rest):
            if rest is not None:
                found.append((cost + rest[0], letter + rest[1]))

        if i < len(codes):
            c = codes[i]
            add(3, "D", best(i + 1, said, 0))
            if c < turns.BLANK:
                cut = 1 if c & 12 else 0
                for w in want:
                    if "sua"[c & 3 : (c & 3) + 1] == w:
                        add(cut, "K", best(i + 1, w, 0))
                    elif w != "s":
                        add(2 + cut, "R", best(i + 1, w, 0))
        if inserted < 4:
            w = want[-1]
            add(2, "I", best(i, w, inserted + 1))
        return min(found) if found else None

    return best(0, "", 0)


def exhaustive(codes: bytes) -> tuple[int, str]:
    """The same from all strings of edits, up to three insertions."""
    found = []
    for n in range(len(codes), len(codes) + 4):
        for audit in itertools.product("DIKR", repeat=n):
            if sum(a != "I" for a in audit) != len(codes):
                continue
            i = cost = 0
            out = ""
            for a in audit:
                if a == "I":
                    out, cost = out + ("a" if out.endswith("u") else "u"), cost + 2
                    continue
                c, i = codes[i], i + 1
                if a == "D":
                    cost += 3
                    continue
                if c >= 8:
                    break
                cost += (2 if a == "R" else 0) + (1 if c & 12 else 0)
                out += "suax"[c & 3] if a == "K" else "a" if out.endswith("u") else "u"
            else:
                rest = out[1:] if out.startswith("s") else out
                if out == "" or (rest and rest == "ua" * (len(rest) // 2)):
                    found.append((cost, "".join(audit)))
    return min(found)


def test_against_every_string_of_edits():
    kinds = [0, 1, 2, 3, 5, 6, 4, 9]
    for n in range(4):
        for codes in itertools.product(kinds, repeat=n):
            assert turns.align(bytes(codes)) == exhaustive(bytes(codes)), codes
            assert plain(bytes(codes)) == exhaustive(bytes(codes)), codes


def test_random_shapes_and_blocks(monkeypatch):
    rng = random.Random(5)
    for block in (64, 3, 1):
        monkeypatch.setattr(turns, "BLOCK", block)
        turns._shapes.clear()
        for _ in range(400):
            codes = bytes(rng.choice([0, 1, 2, 3, 1, 2, 1, 2, 4, 5, 6, 7, 8, 13]) for _ in range(rng.randrange(14)))
            assert turns.align(codes) == plain(codes), (block, list(codes))
    turns._shapes.clear()


def test_long_conversation():
    rng = random.Random(6)
    codes = bytes(c if rng.random() > 0.15 else rng.choice([0, 3, 5, 9, 14]) for c in [0, *[1, 2] * 150])
    assert turns.align(codes) == plain(codes)
    many = bytes(c if rng.random() > 0.1 else rng.choice([0, 3, 5, 9, 14]) for c in [1, 2] * 10_000)
    cost, audit = turns.align(many)
    assert len(audit) - audit.count("I") == len(many) and cost > 1000
    assert turns.align(bytes([9]) * 500) == (1500, "D" * 500)
    assert turns.align(bytes([0]) * 200)[0] == plain(bytes([0]) * 200)[0]


def test_shapes_are_forgotten(monkeypatch):
    monkeypatch.setattr(turns, "SHAPES", 3)
    for n in range(20):
        assert turns.align(bytes([1, 2] * (n % 5) + [1] * (n // 5))) == plain(bytes([1, 2] * (n % 5) + [1] * (n // 5)))
    assert len(turns._shapes) <= 4


def want(rows, damage=True):
    """The query in plain Python."""
    by: dict = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        if hit == 1:
            text = ""
        if hit == 2:
            text = text.translate({ord(c): None for c in ".!?"})
        if hit == 4:
            role = "user"
        by[conv] += [(turn is not None, turn or 0, role, hashlib.md5(text.encode()).digest(), text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    out = []
    for conv, rs in by.items():
        rs.sort()
        seen, codes = set(), []
        for _, _, role, _, text in rs:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = 8 if not bare else 12 if (role, text) in seen else 4 if bare[-1] not in ".!?" else 0
            seen.add((role, text))
            codes.append(("sua".find(role[:1]) if role[:1] and role[:1] in "sua" else 3) + fault)
        cost, audit = plain(bytes(codes))
        known = [r[1] for r in rs if r[0]]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rs, rs[1:]))
        said, i = [], 0
        for a in audit:
            new = "assistant" if said and said[-1][0].startswith("u") else "user"
            if a == "I":
                said.append((new, "", "I"))
                continue
            r, i = rs[i], i + 1
            if a != "D":
                said.append((new if a == "R" else r[2], r[4], a))
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t, _ in said).encode()).hexdigest()
        faults = [c & 12 for c in codes]
        out.append(((conv, gaps, faults.count(8), faults.count(12), faults.count(4), illegal, cost, audit, sha), said))
    return out


COLS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


@pytest.mark.parametrize("damage", [True, False])
def test_odd_rows(spark, damage):
    rng = random.Random(7)
    texts = ["One.", "Two!", "three", "", " \t\n", None, "Four?  ", "é…", "..?!", "Two!"]
    roles = ["system", "user", "assistant", None, "", "User", "usher", "tool", "assistant", "user"]
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(texts)) for _ in range(500)]
    rows += [(77, t, r, f"Text {t}.") for t, r in enumerate(["user", "assistant"] * 60)] + [(78, 3, "user", "Same.")] * 9 + [(-5, 10**12, "assistant", "x" * 100_000 + ".")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    given = turns.damaged(df) if damage else df
    told = want(rows, damage)
    assert sorted(map(repr, (tuple(r) for r in turns.digests(given).select(*COLS).collect()))) == sorted(repr(t) for t, _ in told)
    fixed = turns.repaired(given).orderBy("conv_id", "pos").collect()
    assert sorted(map(repr, (tuple(r) for r in fixed))) == sorted(repr((t[0], i, *s)) for t, said in told for i, s in enumerate(said))


def test_batches_cut_conversations(spark):
    rows = [(i // 37, i % 37, ROLES[i % 3], f"t{i % 29}.") for i in range(400)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = sorted(map(repr, (tuple(r) for r in turns.digests(turns.damaged(df)).select(*COLS).collect())))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted(repr(t) for t, _ in want(rows))


def test_empty_and_clashing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert turns.digests(none).count() == 0 and turns.repaired(none).count() == 0
    more = spark.createDataFrame([("x", 1, "user", "Hi.", 5, "no")], "conv_id string, turn int, role string, text string, cost int, audit string")
    assert [tuple(r)[6:8] for r in turns.digests(more).select(*COLS).collect()] == [(2, "KI")]


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted(map(repr, (tuple(r) for r in turns.op12_turns(spark, sf).select(*COLS).collect())))
    assert got == sorted(repr(t) for t, _ in want(rows))


def test_sql(spark, tmp_path):
    """The query's SQL on damaged conversations of all kinds, some of them again as random rows."""
    import duckdb

    rng = random.Random(9)
    texts, roles = ["One.", "Two!", "three", "", " \t\n", None, "Four?  ", "é…"], ["system", "user", "assistant", None, "", "usher", "tool", "assistant", "user"]
    rows = [(rng.choice([None, *range(120)]), rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(texts)) for _ in range(700)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(COLS)} FROM ({turns.SQL['op12_turns']})").fetchall()
    got = turns.op12_turns(spark, str(tmp_path)).select(*COLS).collect()
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))
