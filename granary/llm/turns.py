"""Repair of conversations by aligning their turns with the alternating grammar.

A conversation's roles should read ``(s?(ua)+)?``: nothing, or an optional system turn and then pairs
of user and assistant.  Turns are kept (0), given another role (2), deleted (3; blank and repeated ones
must be) or inserted (2); a truncated turn that stays costs 1.  The turns are aligned by Wagner and
Fischer's table with the grammar's string of each feasible length.  Ukkonen's band, from the cost of
the best alignment known so far, bounds both the lengths that are tried and the cells of each table,
and the audits that are traced back from tables of equal cost are compared.

What an alignment depends on is a byte for each turn, so equal shapes are aligned once by a worker.
A long conversation is aligned block by block: at a block's end the lengths that end with the same
role are interchangeable from there on, so the cheapest of each goes on.  Texts are not looked at:
they pass by afterwards, sorted, beside their conversation's audit, one row at a time.
"""

from __future__ import annotations

import hashlib
import os.path
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"  # ASCII white space
START, AFTER = 0, {"s": 1, "u": 2, "a": 3}  # what the repaired turns end with so far
SYSTEM, USER, ASSISTANT, OTHER = range(4)  # a turn's initial, the low bits of its byte
FINE, TRUNCATED, BLANK, DUPLICATE = 0, 4, 8, 12  # its first fault, the high bits
DELETE, INSERT, REROLE, CUT = 3, 2, 2, 1  # costs
BLOCK = 64  # turns aligned at once
SHAPES = 200_000  # blocks whose alignments a worker remembers
#: By how much an alignment may cost more than another of the same block and still be the better start for what follows:
#: two insertions bring the other to the same role, and one deletion makes up for a system turn that only an empty start takes.
SLACK = 2 * INSERT + DELETE
_CLASS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}


def _greedy(codes: bytes, at: int) -> tuple[int, int]:
    """(cost, end) of keeping what fits, deleting what must go, and changing other roles: the first incumbent."""
    cost = 0
    for c in codes:
        if c >= BLANK:
            cost += DELETE
            continue
        kind, cost = c & 3, cost + (CUT if c & 12 == TRUNCATED else 0)
        if at == START and kind == SYSTEM:
            at = AFTER["s"]
            continue
        want = ASSISTANT if at == AFTER["u"] else USER
        cost += REROLE if kind != want else 0
        at = AFTER["u"] if want == USER else AFTER["a"]
    return cost, at


def _align(codes: bytes, target: str, most: int) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest alignment with one target string, the ASCII-least of equal ones; none above ``most``.

    The table holds costs to the end, so the audit is read from the front.  A path within ``most`` has
    at most ``d`` deletions and as many insertions as the lengths then need, which is the band.
    """
    m, n = len(codes), len(target)
    d = (most - INSERT * (n - m)) // (DELETE + INSERT)
    if d < max(0, m - n):
        return None
    low, high = -d, d + n - m
    far = most + 1
    kinds = [_CLASS[t] for t in target]
    rows: list[list[int]] = []  # of turn i: costs for columns i + low to i + high
    width = high - low + 1
    after = [far] * (width + 2)
    for i in range(m, -1, -1):
        row = [far] * (width + 2)
        c = codes[i] if i < m else BLANK
        cut = CUT if c & 12 == TRUNCATED else 0
        for at in range(width - 1, -1, -1):
            j = i + low + at
            if j < 0 or j > n:
                continue
            if i == m and j == n:
                row[at] = 0
                continue
            best = far
            if i < m and at > 0:
                best = DELETE + after[at - 1]
            if j < n:
                system = kinds[j] == SYSTEM
                if not system:
                    best = min(best, INSERT + row[at + 1])
                if c < BLANK:
                    if c & 3 == kinds[j]:
                        best = min(best, cut + after[at])
                    elif not system:
                        best = min(best, REROLE + cut + after[at])
            row[at] = min(best, far)
        rows.append(row)
        after = row
    rows.reverse()
    if rows[0][-low] > most:
        return None
    i = j = 0
    audit = []
    while i < m or j < n:
        at = j - i - low
        here = rows[i][at]
        c = codes[i] if i < m else BLANK
        cut = CUT if c & 12 == TRUNCATED else 0
        if i < m and at > 0 and here == DELETE + rows[i + 1][at - 1]:
            audit.append("D")
            i += 1
        elif j < n and kinds[j] != SYSTEM and here == INSERT + rows[i][at + 1]:
            audit.append("I")
            j += 1
        else:
            audit.append("K" if c & 3 == kinds[j] else "R")
            i, j = i + 1, j + 1
    return rows[0][-low], "".join(audit)


_shapes: dict[tuple[bytes, int, bool], list[tuple[int, int, str]]] = {}


def _block(codes: bytes, entry: int, last: bool) -> list[tuple[int, int, str]]:
    """(end, cost, audit): a block's cheapest alignment from ``entry`` to each end, or to the ends that finish a conversation."""
    key = (codes, entry, last)
    if key in _shapes:
        return _shapes[key]
    m = len(codes)
    cost, end = _greedy(codes, entry)
    if last:
        most = cost + (INSERT if end == AFTER["u"] else 2 * INSERT if end == AFTER["s"] else 0)
    else:
        most = cost + SLACK
    best: dict[int, tuple[int, str]] = {}
    longest = m + most // INSERT
    pairs = "ua" * (longest // 2 + 1)
    strings = ["au" * (longest // 2 + 1)] if entry == AFTER["u"] else [pairs]
    if entry == START and any(c & 3 == SYSTEM and c < BLANK for c in codes):
        strings.append("s" + pairs)
    for string in strings:
        for n in sorted(range(longest + 1), key=lambda n: (abs(n - m), n)):
            if n == 0 and string[0] == "s":
                continue
            end = AFTER[string[n - 1]] if n else entry
            if last and end not in (START, AFTER["a"]):
                continue
            bound = min(most, best[end][0]) if end in best else most
            if DELETE * (m - n) > bound or INSERT * (n - m) > bound:
                continue
            found = _align(codes, string[:n], bound)
            if found and (end not in best or found < best[end]):
                best[end] = found
                if last:
                    most = min(most, found[0])
    out = [(end, *found) for end, found in best.items()]
    if len(_shapes) >= SHAPES:
        _shapes.clear()
    _shapes[key] = out
    return out


def align(codes: bytes) -> tuple[int, str]:
    """(cost, audit) of a whole conversation, a byte a turn."""
    ends = {START: (0, "")}
    done: list[str] = []
    for at in range(0, len(codes), BLOCK):
        part, last = codes[at : at + BLOCK], at + BLOCK >= len(codes)
        met: dict[int, tuple[int, str]] = {}
        for entry, (before, audit) in ends.items():
            for end, cost, more in _block(part, entry, last):
                found = (before + cost, audit + more)
                if end not in met or found < met[end]:
                    met[end] = found
        same = os.path.commonprefix([audit for _, audit in met.values()])
        done.append(same)
        ends = {end: (cost, audit[len(same) :]) for end, (cost, audit) in met.items()}
    cost, audit = min(ends.values())
    return cost, "".join(done) + audit


_LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
_told: dict[bytes, tuple] = {}


def _tell(codes: bytes) -> tuple[int, int, int, int, int, str]:
    """blank, duplicate, truncated, illegal, cost and audit of a conversation."""
    if codes in _told:
        return _told[codes]
    faults = np.bincount(np.frombuffer(codes, np.uint8) >> 2, minlength=4).tolist()
    illegal = sum((a & 3, b & 3) not in _LEGAL for a, b in zip(codes, codes[1:]))
    out = (faults[2], faults[3], faults[1], illegal, *align(codes))
    if len(codes) <= BLOCK:
        if len(_told) >= SHAPES:
            _told.clear()
        _told[codes] = out
    return out


def _starts(column: pa.Array) -> np.ndarray:
    """Where a value differs from the one before, nulls being equal; the first row always."""
    n = len(column)
    if n < 2:
        return np.ones(n, bool)
    a, b = column.slice(1), column.slice(0, n - 1)
    other = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.not_equal(pc.is_null(a), pc.is_null(b)))
    return np.append(True, other.to_numpy(zero_copy_only=False))


_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_MOST = 2**63 - 1


def _alignments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, turn, code, copies), sorted -> one row for each conversation."""
    held = None  # conv_id, its codes, least turn, greatest turn, number of turns

    def finished() -> tuple:
        conv, codes, least, most, turns = held
        gaps = 0 if least is None else min(most - least + 1 - turns, _MOST)
        return (conv, gaps, *_tell(b"".join(codes)))

    kind = None
    for batch in batches:
        if not batch.num_rows:
            continue
        kind = batch.column(0).type
        out = []
        cuts = np.flatnonzero(_starts(batch.column(0))).tolist()
        turn = batch.column(1).fill_null(0).to_numpy(zero_copy_only=False)
        code = batch.column(2).to_numpy(zero_copy_only=False).astype(np.uint8)
        copies = batch.column(3).to_numpy(zero_copy_only=False)
        there = batch.column(1).is_valid().to_numpy(zero_copy_only=False) & (copies > 0)
        stop = np.cumsum(copies)
        again = np.arange(stop[-1]) > np.repeat(stop - copies, copies)
        first = np.repeat(code, copies)
        repeated = (first & 3) | np.where((first & 12) == BLANK, BLANK, DUPLICATE).astype(np.uint8)
        codes = np.where(again, repeated, first).tobytes()
        at = np.append(0, stop).tolist()
        for a, b in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
            conv = batch.column(0)[a].as_py()
            if held is None or held[0] != conv:
                if held is not None:
                    out.append(finished())
                held = [conv, [], None, None, 0]
            held[1].append(codes[at[a] : at[b]])
            own = turn[a:b][there[a:b]]
            if len(own):
                least, most = int(own[0]), int(own[-1])  # sorted
                held[4] += int((own[1:] != own[:-1]).sum()) + (held[3] != least)
                held[2], held[3] = least if held[2] is None else held[2], most
        if out:
            yield _table(out, kind)
    if held is not None:
        yield _table([finished()], kind)


def _table(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), *(pa.array(c, pa.int64()) for c in cols[1:7]), pa.array(cols[7], pa.string())], ["conv_id", *_COUNTS, "audit"])


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with faults dealt by the checksum of conversation and turn; ``copies`` is how often a row is there.

    (conv_id, turn, role, text), nulls in the last two being one blank -> the same and copies: 0, 1 or
    2.  A dropped row stays with no copies, so that its conversation is known.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))  # noqa: E731
    hit = F.pmod(F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")), F.lit(20))
    text = F.when(hit == 1, "").when(hit == 2, F.regexp_replace(part("text"), "[.!?]", "")).otherwise(part("text"))
    role = F.when(hit == 4, "user").otherwise(part("role"))
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.when(hit == 0, 0).when(hit == 3, 2).otherwise(1).alias("copies"))


def _given(rows: DataFrame) -> DataFrame:
    """The columns that matter, with a digest that orders rows of equal turn and role."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))  # noqa: E731
    copies = F.col("copies").cast("int") if "copies" in rows.columns else F.lit(1)
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), part("role").alias("role"), part("text").alias("text"), copies.alias("copies")).withColumn("digest", F.unhex(F.md5("text")))


_ORDER = ["turn", "role", "digest"]


def _code() -> tuple[Column, Column, Column]:
    """A turn's byte, and what it needs of the text: whether it is blank, whether it is cut short."""
    kind = F.substring("role", 1, 1)
    klass = F.when(kind == "s", SYSTEM).when(kind == "u", USER).when(kind == "a", ASSISTANT).otherwise(OTHER)
    trimmed = F.rtrim("text", F.lit(SPACE))
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "digest", F.col("copies") > 0).orderBy("turn")) > 1
    fault = F.when(F.col("blank"), BLANK).when(seen, DUPLICATE).when(F.col("cut"), TRUNCATED).otherwise(FINE)
    return klass + fault, (trimmed == ""), ~F.right(trimmed, F.lit(1)).isin(".", "!", "?")


def aligned(rows: DataFrame) -> DataFrame:
    """Faults and cheapest edits of every conversation: (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit).

    rows: conv_id, turn, role, text, and perhaps copies (0: the row is gone, its conversation is
    known).  Turns go by number, nulls first, then role, then their text's digest; repeated rows are
    duplicates.  A null role or text is one blank, a null conv_id a conversation of its own.  A row
    counts by its first fault: blank, duplicate (role and text stood before), truncated.  ``gaps`` are
    turn numbers missing between the least and the greatest.  Without rows: zeros and no edits.
    An audit has a letter an edit: Keep, Rerole, Delete, Insert.

    Turns meet by conversation without their texts (a byte, a number and a digest each).
    """
    code, blank, cut = _code()
    light = _given(rows).withColumns({"blank": blank, "cut": cut}).drop("text").repartition("conv_id")
    light = light.withColumn("code", code).sortWithinPartitions("conv_id", *_ORDER).select("conv_id", "turn", "code", "copies")
    kind = rows.schema["conv_id"].dataType.simpleString()
    return light.mapInArrow(_alignments, f"conv_id {kind}, {', '.join(f'{c} long' for c in _COUNTS)}, audit string")


class _Rows:
    """Repaired turns as rows."""

    schema = "pos int, role string, text string, edit string"

    def __init__(self):
        self.out: list[tuple] = []

    def open(self, head: tuple):
        self.head, self.pos = head, 0

    def turn(self, role: str, text: str, edit: str):
        self.out.append((self.head[0], self.pos, role, text, edit))
        self.pos += 1

    def close(self):
        pass

    def batch(self, kind: pa.DataType) -> pa.RecordBatch | None:
        rows, self.out = self.out, []
        cols = list(zip(*rows, strict=True)) or [()] * 5
        types = [kind, pa.int32(), pa.string(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["conv_id", "pos", "role", "text", "edit"])


class _Digests:
    """What was told of each conversation, and a hash of its repaired turns."""

    schema = ", ".join([*(f"{c} long" for c in _COUNTS), "audit string", "repaired_sha256 string"])

    def __init__(self):
        self.out: list[tuple] = []

    def open(self, head: tuple):
        self.head, self.sha, self.some = head, hashlib.sha256(), False

    def turn(self, role: str, text: str, edit: str):
        self.sha.update(f"\n{role}:{text}".encode() if self.some else f"{role}:{text}".encode())
        self.some = True

    def close(self):
        self.out.append((*self.head, self.sha.hexdigest()))

    def batch(self, kind: pa.DataType) -> pa.RecordBatch:
        rows, self.out = self.out, []
        cols = list(zip(*rows, strict=True)) or [()] * 9
        types = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["conv_id", *_COUNTS, "audit", "repaired_sha256"])


def _edits(sink: Callable) -> Callable:
    """Sorted rows, each conversation's counts and audit before its turns -> what ``sink`` makes of the repaired turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, audit, at, after, kind = sink(), None, 0, None, None

        def inserted():
            nonlocal at, after
            while at < len(audit) and audit[at] == "I":
                role = "assistant" if after == "u" else "user"
                out.turn(role, "", "I")
                at, after = at + 1, role[0]

        for batch in batches:
            kind = batch.column(0).type
            for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
                if row[8] == 0:  # a head
                    if audit is not None:
                        inserted()
                        out.close()
                    out.open((row[0], *row[1:8]))
                    audit, at, after = row[7], 0, None
                    continue
                for _ in range(row[11]):
                    inserted()
                    edit, role = audit[at], row[9]
                    at += 1
                    if edit == "R":
                        role = "assistant" if after == "u" else "user"
                    if edit != "D":
                        out.turn(role, row[10], edit)
                        after = role[0]
            yield out.batch(kind)
        if audit is not None:
            inserted()
            out.close()
            yield out.batch(kind)

    return run


def _repair(rows: DataFrame, sink: Callable) -> DataFrame:
    given = _given(rows)
    heads = aligned(rows).select("*", F.lit(0).alias("what"), *[F.lit(None).cast(given.schema[c].dataType).alias(c) for c in ("role", "text", "copies", "turn", "digest")])
    turns = given.select("conv_id", *[F.lit(None).cast("long").alias(c) for c in _COUNTS], F.lit(None).cast("string").alias("audit"), F.lit(1).alias("what"), "role", "text", "copies", "turn", "digest")
    met = heads.union(turns).repartition("conv_id").sortWithinPartitions("conv_id", "what", *_ORDER).drop("turn", "digest")
    return met.mapInArrow(_edits(sink), f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {sink.schema}")


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired turns: (conv_id, pos, role, text, edit); deleted ones are gone, inserted ones have no text.  Rows as in ``aligned``."""
    return _repair(rows, _Rows)


def digests(rows: DataFrame) -> DataFrame:
    """What ``aligned`` tells of each conversation and the sha256 of its repaired turns, ``role:text`` joined by line ends."""
    return _repair(rows, _Digests)


def op12_turns(spark, sf_dir: str) -> DataFrame:
    """Damaged conversations, their faults and cheapest repairs."""
    return digests(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


QUERIES = {"op12_turns": op12_turns}
_INSERTS = "(VALUES ('', 0, ''), ('', 1, 'u'), ('', 2, 'a'), ('s', 0, 's'), ('s', 1, 'u'), ('s', 2, 'a'), ('u', 0, 'u'), ('u', 1, 'a'), ('u', 2, 'u'), ('a', 0, 'a'), ('a', 1, 'u'), ('a', 2, 'a')) AS ins(st, k, st2)"
_ROLE = "CASE WHEN op = 'K' THEN role WHEN (q - s) % 2 = 1 THEN 'user' ELSE 'assistant' END"
#: The same by another way: the checksum bit by bit, then turn by turn the cheapest audit for each role that the repaired turns may end with.
SQL: dict[str, str] = {
    "op12_turns": rf"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') AS conv, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
h AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(key) + 1), lambda i: ascii(substr(key, i::INT, 1))::BIGINT)), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 AS hit FROM k),
d AS (SELECT conv, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role, CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, copy FROM h, unnest(range(CASE hit WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS c(copy)),
r AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i, regexp_replace(text, '[ 	-]+$', '') AS bare FROM d),
f AS (SELECT *, row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 AS seen, substr(role, 1, 1) AS ini FROM r),
g AS MATERIALIZED (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN seen THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, lag(ini) OVER (PARTITION BY conv ORDER BY i) AS before FROM f),
t AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (i > 1 AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM g GROUP BY 1),
w AS (SELECT conv, 0::BIGINT AS i, '' AS st, 0::BIGINT AS cost, '' AS audit FROM t UNION ALL
SELECT conv, i, st3, c, a FROM (SELECT w.conv, w.i + 1 AS i, CASE op WHEN 'D' THEN st2 WHEN 'K' THEN ini ELSE CASE WHEN st2 = 'u' THEN 'a' ELSE 'u' END END AS st3,
cost + 2 * k + CASE op WHEN 'D' THEN 3 WHEN 'K' THEN 0 ELSE 2 END + (op <> 'D' AND fault = 'truncated')::INT AS c, audit || repeat('I', k) || op AS a
FROM w JOIN {_INSERTS} USING (st) JOIN g ON g.conv = w.conv AND g.i = w.i + 1 CROSS JOIN (VALUES ('D'), ('K'), ('R')) AS o(op)
WHERE op = 'D' OR fault NOT IN ('blank', 'duplicate') AND (op = 'R' OR ini = 's' AND st2 = '' OR ini = 'u' AND st2 <> 'u' OR ini = 'a' AND st2 = 'u')) AS x QUALIFY row_number() OVER (PARTITION BY conv, st3 ORDER BY c, a) = 1),
e AS MATERIALIZED (SELECT w.conv, min({{'cost': cost + 2 * k, 'audit': audit || repeat('I', k)}}) AS b FROM w JOIN t ON t.conv = w.conv AND t.n = w.i JOIN {_INSERTS} USING (st) WHERE st2 IN ('', 'a') GROUP BY 1),
p AS (SELECT conv, b.audit[p] AS op, p, length(replace(b.audit[1:p], 'I', '')) AS i, length(replace(b.audit[1:p], 'D', '')) AS q FROM e, unnest(range(1, length(b.audit) + 1)) AS u(p)),
m AS (SELECT p.*, g.role, g.text, max(CASE WHEN q = 1 AND op = 'K' AND ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY p.conv) AS s FROM p LEFT JOIN g ON op <> 'I' AND g.conv = p.conv AND g.i = p.i),
z AS (SELECT conv, string_agg({_ROLE} || ':' || CASE WHEN op = 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS said FROM m WHERE op <> 'D' GROUP BY 1)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b.cost, 0)::BIGINT AS cost, coalesce(b.audit, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, conv FROM k) AS c LEFT JOIN t USING (conv) LEFT JOIN e USING (conv) LEFT JOIN z USING (conv)"""
}
