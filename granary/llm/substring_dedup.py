"""Substring dedup: a count-min prefilter over word windows, then exact grouping of what it leaves.

A window is ``window`` consecutive words.  Every word covered by a window whose word sequence
also starts anywhere else is removed.

1. Sketch.  Each partition adds its windows to a count-min sketch; partial sketches are merged
   slice by slice on the executors and only one bit per cell ("counted twice or more") reaches
   the driver, CELLS / 8 bytes for each of DEPTH rows whatever the input is (and one more that says
   "HOT times or more").  A window is counted
   through its anchor, the least-hashed run of GRAM words in it: equal windows have equal anchors
   at equal places, so an anchor's count is never below its window's, and there are eight times
   fewer of them to add.
2. Exact pass.  Windows whose anchor the sketch puts at two or more are grouped by 128 bits (the
   anchor's hash and the window's own) and those that start in two or more places are marked.
   The sketch only over-counts, so no repeated window is lost; too small a sketch costs traffic,
   never results.
3. Removal.  Marks travel as spans to their row's text.

Rows are told apart by a number that is written with them into the shared folder first, so neither
equal ids, null ids nor equal texts bring rows together.

Skew: windows travel by their anchor, so that those of one place share a row; an anchor that the
sketch calls hot, say in a line that a third of all documents have, sends its windows by their own
hash instead, which all tasks decide alike.  Equal windows that meet in one flush of a task are sent on once with a doubled weight, and
their own spans are settled at once, so a passage in a third of all documents sends a few rows
from each task and no group grows with the number of documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.shared import give_back, stored
from granary.llm.textkit import gram_hashes, mix64, word_hashes, words

WINDOW = 35
GRAM = 16
DEPTH, CELLS, SLICE = 2, 1 << 26, 1 << 20
HOT = 200  # count of an anchor from which its windows travel one by one
COUNTED = 1 << 21  # anchors a task holds before it sends its counts on
FLUSH = 1 << 18  # windows held by a task before it sends them on

_ROW_SEEDS = mix64(np.arange(1, DEPTH + 1, dtype=np.uint64))
_PART = np.dtype([("h", "<u8"), ("o", "<u2"), ("w", "u1")])


def _cells(anchors: np.ndarray, row: int) -> np.ndarray:
    return (mix64(anchors ^ _ROW_SEEDS[row]) & np.uint64(CELLS - 1)).astype(np.int64) + row * CELLS


def _anchors(h: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``gram`` words, and for each window the place of its first least one."""
    g = gram_hashes(h, gram)
    at, span, need = np.arange(len(g)), 1, window - gram + 1
    while span < need:
        step = min(span, need - span)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(g[left] <= g[right], left, right)
        span += step
    return g, at


def _sketch(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0
        for batch in batches:
            for text in batch.column(0):
                h = word_hashes(words(text.as_py()))
                if len(h) >= window:
                    g, at = _anchors(h, window, gram)
                    held.append(g[np.unique(at)])
                    n += len(held[-1])
                    if n >= COUNTED:
                        yield from counted(np.concatenate(held))
                        held, n = [], 0
        if held:
            yield from counted(np.concatenate(held))
        held.clear()
        give_back()

    def counted(anchors: np.ndarray) -> Iterator[pa.RecordBatch]:
        for row in range(DEPTH):
            cells, counts = np.unique(_cells(anchors, row), return_counts=True)
            counts = np.minimum(counts, HOT).astype(np.uint8)
            part = cells // SLICE
            for s, e in zip(np.flatnonzero(np.diff(part, prepend=-1)), [*np.flatnonzero(np.diff(part)) + 1, len(part)], strict=True):
                inside = (cells[s:e] - part[s] * SLICE).astype(np.uint32)
                yield pa.RecordBatch.from_pydict({"part": pa.array([int(part[s])], pa.int32()), "cells": [inside.tobytes()], "counts": [counts[s:e].tobytes()]})

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum the partial sketches of each slice; rows come sorted by slice."""
    last, sums = None, np.zeros(SLICE, np.uint16)

    def bits():
        return pa.RecordBatch.from_pydict({"part": pa.array([last], pa.int32()), "bits": [np.packbits(sums >= 2).tobytes()], "hot": [np.packbits(sums >= HOT).tobytes()]})

    for batch in batches:
        for part, cells, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if last is not None and part != last:
                yield bits()
                sums[:] = 0
            last = part
            at = np.frombuffer(cells, np.uint32)
            sums[at] = np.minimum(sums[at] + np.frombuffer(counts, np.uint8), HOT)
    if last is not None:
        yield bits()


def window_sketch(texts: DataFrame, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """Bits of the merged sketch's cells that are at two or more, and of those at HOT or more: two rows of DEPTH * CELLS / 8 bytes."""
    parts = texts.select("text").mapInArrow(_sketch(window, gram), "part int, cells binary, counts binary")
    merged = parts.repartition("part").sortWithinPartitions("part").mapInArrow(_merge, "part int, bits binary, hot binary")
    out = np.zeros((2, DEPTH * CELLS // 8), np.uint8)
    for r in merged.toLocalIterator():
        for row, b in zip(out, (r.bits, r.hot), strict=True):
            row[r.part * (SLICE // 8) : (r.part + 1) * (SLICE // 8)] = np.frombuffer(b, np.uint8)
    return out


def _often(bits: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    ok = np.ones(len(anchors), bool)
    for row in range(DEPTH):
        c = _cells(anchors, row)
        ok &= (bits[c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1 == 1
    return ok


def _runs(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of true marks."""
    edge = np.diff(np.concatenate([[False], marks, [False]]).astype(np.int8))
    s = np.flatnonzero(edge == 1)
    return s, np.flatnonzero(edge == -1) - s


_SENT = pa.schema([("anchor", pa.int64()), ("key", pa.int64()), ("start", pa.int32()), ("len", pa.int32()), ("wins", pa.binary())])


def _candidates(bits, window: int, gram: int):
    """Windows that the sketch puts at two or more, a row for each anchor's run of them; spans known to repeat already."""

    def send(docs: list, held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        doc, pos, anchor, h = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((h, anchor))
        a, b = anchor[order], h[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        group = np.cumsum(new) - 1
        many = np.bincount(group)[group] > 1
        first, twice = np.empty(len(a), bool), np.empty(len(a), bool)
        first[order], twice[order] = new, many
        cols: list[list] = [[] for _ in _SENT]

        def row(*x):
            for c, v in zip(cols, x, strict=True):
                c.append(v)

        # spans that repeat within this flush are settled
        d, p = doc[twice], pos[twice]
        if len(d):
            cut = np.flatnonzero((np.diff(d) != 0) | (np.diff(p) != 1)) + 1
            for s, e in zip([0, *cut], [*cut, len(d)], strict=True):
                key = docs[d[s]]
                row(int(mix64(np.array([key], np.int64).view(np.uint64)).view(np.int64)[0]), key, int(p[s]), int(e - s), None)
        d, p, a, b, w = doc[first], pos[first], anchor[first], h[first], twice[first]
        if len(d):
            cut = np.flatnonzero((np.diff(d) != 0) | (a[1:] != a[:-1]) | (np.diff(p) >= window)) + 1
            for s, e in zip([0, *cut], [*cut, len(d)], strict=True):
                part = np.empty(e - s, _PART)
                part["h"], part["o"], part["w"] = b[s:e], p[s:e] - p[s], 1 + w[s:e]
                key = docs[d[s]]
                row(int(a[s : s + 1].view(np.int64)[0]), key, int(p[s]), 0, part.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _SENT, strict=True)], schema=_SENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: list = []
        held: list[tuple] = []
        n = 0
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text"), strict=True):
                h = word_hashes(words(text.as_py()))
                if len(h) < window:
                    continue
                g, at = _anchors(h, window, gram)
                used, back = np.unique(at, return_inverse=True)
                twice, hot = bits.value
                pos = np.flatnonzero(_often(twice, g[used])[back])
                if len(pos):
                    anchor, own = g[at[pos]], gram_hashes(h, window, seed=7)[pos]
                    alone = _often(hot, g[used])[back[pos]]
                    held.append((np.full(len(pos), len(docs)), pos, np.where(alone, mix64(anchor ^ mix64(own)), anchor), own))
                    docs.append(key)
                    n += len(pos)
                    if n >= FLUSH:
                        yield from send(docs, held)
                        docs, held, n = [], [], 0
        if held:
            yield from send(docs, held)
        held.clear()
        give_back()

    return run


_SPANS = pa.schema([("key", pa.int64()), ("start", pa.int32()), ("len", pa.int32())])


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor -> spans of window starts whose sequence starts in two or more places."""

    def settle(t: pa.Table) -> Iterator[pa.RecordBatch]:
        wins = t.column("wins").to_pylist()
        mine = np.array([w is not None for w in wins], bool)
        known = t.filter(pa.array(~mine))
        yield from known.select(_SPANS.names).to_batches()
        t = t.filter(pa.array(mine))
        if not t.num_rows:
            return
        wins = [np.frombuffer(w, _PART) for w in wins if w is not None]
        n = np.array([len(w) for w in wins])
        part, src = np.concatenate(wins), np.repeat(np.arange(len(n)), n)
        a = t.column("anchor").to_numpy()[src]
        order = np.lexsort((part["h"], a))
        x, y = a[order], part["h"][order]
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        group = np.cumsum(new) - 1
        hit = np.empty(len(x), bool)
        hit[order] = np.bincount(group, weights=part["w"][order])[group] > 1
        src, o = src[hit], part["o"][hit].astype(np.int64)
        if not len(src):
            return
        start = (np.diff(src, prepend=-1) != 0) | (np.diff(o, prepend=-9) != 1)
        s = np.flatnonzero(start)
        row = src[s]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(t.column("key").to_numpy()[row]),
                pa.array((t.column("start").to_numpy()[row] + o[s]).astype(np.int32)),
                pa.array(np.diff([*s, len(src)]).astype(np.int32)),
            ],
            schema=_SPANS,
        )

    rest: list[pa.RecordBatch] = []  # rows of an anchor that may go on in the next batch
    for batch in batches:
        if not batch.num_rows:
            continue
        a = batch.column(0).to_numpy()
        last = int(np.searchsorted(a, a[-1], "left"))
        if last:
            yield from settle(pa.Table.from_batches([*rest, batch.slice(0, last)]))
            rest = []
        elif rest and rest[-1].column(0)[0].as_py() != int(a[0]):
            yield from settle(pa.Table.from_batches(rest))
            rest = []
        rest.append(batch.slice(last))
    if rest:
        yield from settle(pa.Table.from_batches(rest))


def _removed(window: int, out: pa.Schema, as_given: bool):
    """Rows sorted by (key, kind): a document's row, then its spans -> rows with the words left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the row as a batch of one, text
        spans: list = []
        now = None
        made: list[pa.RecordBatch] = []
        size = 0

        def flush() -> tuple[pa.RecordBatch, int]:
            row, text = held
            ws = words(text)
            gone = np.zeros(len(ws) + 1, np.int32)
            for s, n in spans:
                gone[s] += 1
                gone[min(s + n - 1 + window, len(ws))] -= 1
            gone = np.cumsum(gone)[:-1] > 0
            if as_given and not gone.any():
                kept = text or ""
            else:
                kept = b" ".join(w for w, g in zip(ws, gone.tolist(), strict=True) if not g).decode("utf-8", "replace")
            return pa.RecordBatch.from_arrays([*row.columns, pa.array([kept]), pa.array([len(ws)], pa.int64()), pa.array([int(gone.sum())], pa.int64())], schema=out), len(kept)

        for batch in batches:
            key, kind, text, start, n = (batch.column(i).to_pylist() if i != 2 else batch.column(i) for i in range(5))
            rows = batch.select(list(range(5, batch.num_columns)))
            for i in range(batch.num_rows):
                if key[i] != now:
                    if held:
                        got, k = flush()
                        made.append(got)
                        size += k + 100
                        if size > 1 << 23 or len(made) >= 4096:
                            yield from pa.Table.from_batches(made).combine_chunks().to_batches()
                            made, size = [], 0
                    held, spans, now = None, [], key[i]
                if kind[i] == 0:
                    held = rows.slice(i, 1), text[i].as_py()
                else:
                    spans.append((start[i], n[i]))
        if held:
            made.append(flush()[0])
        if made:
            yield from pa.Table.from_batches(made).combine_chunks().to_batches()
        made.clear()
        give_back()

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, untouched_as_given: bool = False) -> DataFrame:
    """Remove the words of every document that stand in a window repeated anywhere in the table.

    Takes columns doc_id (long) and text.  Returns all columns of ``docs``, with three more:
    kept_text (the words left, joined by one space; '' if none; with ``untouched_as_given`` texts that lose
    nothing stay as they are), n_words and n_removed.  Columns of
    those names in ``docs`` are replaced.  Windows are judged on the table as given.  Null and empty
    texts have no words; a text under ``window`` words keeps all; every copy of a row or a text
    counts as another place, and so do overlapping repeats within one text.  Null ids are allowed.
    A table without rows gives none.
    """
    spark = docs.sparkSession
    docs = docs.drop("kept_text", "n_words", "n_removed")
    if gram > window:
        gram = window
    names = [c for c in docs.columns if c != "text"]
    own = {f"c{i}": c for i, c in enumerate(names)}
    given = stored(docs.select(F.monotonically_increasing_id().alias("key"), F.col("text").cast("string").alias("text"), *[F.col(f"`{c}`").alias(a) for a, c in own.items()]), "numbered")
    bits = spark.sparkContext.broadcast(window_sketch(given, window, gram))
    sent = given.select("key", "text").mapInArrow(_candidates(bits, window, gram), "anchor long, key long, start int, len int, wins binary")
    spans = sent.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_repeated, "key long, start int, len int")
    rows = given.select("key", F.lit(0).alias("kind"), "text", F.lit(0).alias("start"), F.lit(0).alias("len"), *own)
    marks = spans.select("key", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("text"), "start", "len", *[F.lit(None).cast(rows.schema[a].dataType).alias(a) for a in own])
    both = rows.unionByName(marks).repartition("key").sortWithinPartitions("key", "kind")
    kept = rows.drop("key", "kind", "text", "start", "len").schema
    for n, t in (("kept_text", "string"), ("n_words", "long"), ("n_removed", "long")):
        kept = kept.add(n, t)
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(kept)
    done = both.mapInArrow(_removed(window, schema, untouched_as_given), kept)
    return done.select(*[F.col(a).alias(c) for a, c in own.items()], "kept_text", "n_words", "n_removed")


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Words left after windows of 35 words that repeat anywhere in all documents are removed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


_WINDOW_LIST = " || ' ' || ".join(f"w[i + {j}]" for j in range(WINDOW))
#: For each word, whether one of the windows over it repeats; window starts are grouped by their words.
SQL: dict[str, str] = {
    "op6_substring_dedup": f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
n AS (SELECT *, row_number() OVER () AS r FROM d),
s AS (SELECT r, i, {_WINDOW_LIST} AS k FROM n, unnest(range(1, len(w) - {WINDOW - 2})) AS t(i) WHERE len(w) >= {WINDOW}),
c AS (SELECT k FROM s GROUP BY k HAVING count(*) > 1),
m AS (SELECT r, i FROM s SEMI JOIN c USING (k)),
g AS (SELECT DISTINCT r, i + j AS i FROM m, range({WINDOW}) AS t(j)),
x AS (SELECT r, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM n),
y AS (SELECT x.r, count(g.i) AS gone, string_agg(x.word, ' ' ORDER BY x.i) FILTER (WHERE g.i IS NULL) AS kept FROM x LEFT JOIN g ON x.r = g.r AND x.i = g.i GROUP BY x.r)
SELECT doc_id, len(w) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM n LEFT JOIN y USING (r)
"""
}
QUERIES = {"op6_substring_dedup": op6_substring_dedup}
