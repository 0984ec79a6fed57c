"""Which texts hold which passages, word for word or after normalisation, over whole tables.

A passage stands in a text, exactly or normalised, only if its *core* stands in the text's core: what
is left once every character is decomposed, and marks, white space and hyphens of all kinds are gone
and quotation marks are plain.  The core of a text is the cores of its characters one after the other,
so line ends, hyphenation, ligatures and where a passage is cut don't change it.

Cores meet by minimisers (winnowing; Schleimer, Wilkerson and Aiken, 2003): of every WINDOW runs of
GRAM characters in a row the one with the least hash is kept, so a passage of WINDOW + GRAM - 1
characters or more shares its least hash with every text that holds it.  Shorter passages are met by
runs of their own length, up to SHORT, at every place; one without a core (dashes, blanks) meets
every text.  What meets by equality is looked at in full.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.text import MARKS, SOFT_HYPHEN, normalize_quote
from granary.operators.store import kept

GRAM, WINDOW = 12, 16
SHORT = 8  # characters of the longest run by which shorter passages are met
SEEDS_SENT = 2_000_000  # hashes of passages, 8 bytes each, that are sent to every task
PAIRS_SENT = 64 << 20  # characters of passages beside the texts that they may stand in, that are sent to every task
AT_ONCE = 1 << 18  # characters of texts that a task hashes together
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


class _Core(dict):
    """What a character leaves in a core, found once for each."""

    def __missing__(self, point: int) -> str:
        left = unicodedata.normalize("NFKD", chr(point))
        left = "".join(MARKS.get(c, c) for c in left)
        self[point] = out = "".join(c for c in left if not (c.isspace() or c in ("-", SOFT_HYPHEN) or unicodedata.category(c)[0] == "M"))
        return out


_CORE = _Core()


def core(text: str) -> str:
    """A text without what normalisation may change."""
    return text.translate(_CORE)


_MANY = 1  # in the table: what leaves more than one character


@functools.cache
def _table() -> np.ndarray:
    """What each character of the basic plane leaves, if it is one character or none (0)."""
    left = [_CORE[i] for i in range(1 << 16)]
    return np.array([0 if not x else ord(x) if len(x) == 1 else _MANY for x in left], np.uint32)


def _points(text: str) -> np.ndarray:
    """The characters of a text's core as numbers."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(x) and x.max() < 1 << 16:
        y = _table()[x]
        if not (y == _MANY).any():
            return y[y != 0].astype(np.uint64)
    return np.frombuffer(core(text).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _hashes(x: np.ndarray, lengths: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """Hashes of every run of each of some lengths (ascending), told apart by length; none where there are fewer characters."""
    h = np.zeros(len(x), np.uint64)
    done = 0
    for n in lengths:
        left = len(x) - n + 1
        if left <= 0:
            yield n, np.empty(0, np.uint64)
            continue
        for i in range(done, n):
            h = h[: len(x) - i] * _ODD
            h += x[i:]
        done = n
        yield n, (h[:left] + np.uint64(n)) * _MIX


def run_length(n: int) -> int:
    """By runs of how many characters a passage with a core of n is met."""
    return GRAM if n >= GRAM + WINDOW - 1 else min(n, SHORT)


def passage_seed(text: str) -> tuple[int, int]:
    """(length, hash): a run of the passage's core that every text with the passage has among its seeds."""
    x = _points(text)
    n = run_length(len(x))
    return n, int(next(_hashes(x, [n]))[1].min().astype(np.int64)) if n else 0


def _minimisers(h: np.ndarray) -> np.ndarray:
    """The least of every WINDOW hashes in a row, once where neighbours agree; the least of all if there are fewer."""
    if not len(h):
        return h
    span, most = 1, min(WINDOW, len(h))
    while span < most:  # minima of 2, 4, 8, ... in a row
        step = min(span, most - span)
        h, span = np.minimum(h[:-step], h[step:]), span + step
    return h[np.append(True, h[1:] != h[:-1])]


def text_seeds(x: np.ndarray, lengths: list[int]) -> Iterator[np.ndarray]:
    """Of a core, for each length the hashes of its runs: all of them, or the minimisers where it is GRAM."""
    for n, h in _hashes(x, [n for n in lengths if n]):
        yield _minimisers(h) if n == GRAM else h
    if 0 in lengths:
        yield np.zeros(1, np.uint64)


def _seeds_of_passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [passage_seed(t) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in found], pa.int32()), pa.array([h for _, h in found], pa.int64())], ["_q", "_n", "_h"])


def _seeds_of_texts(lengths: list[int], asked):
    """(text, id) -> (id, hash) of its seeds; only of those asked for, where they were sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = table = None
        if asked is not None:
            wanted = asked.value
            table = np.zeros(1 << 20, bool)
            table[wanted.view(np.uint64) >> np.uint64(44)] = True
        for batch in batches:
            at, hits, size = [], [], 0
            for i, text in enumerate(batch.column(0)):
                text = text.as_py()
                if not text:
                    continue
                x = _points(text)
                size += len(x)
                for h in text_seeds(x, lengths):
                    if table is not None:
                        h = np.unique(h[table[h >> np.uint64(44)]].view(np.int64))
                        h = h[wanted[np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)] == h]
                    else:
                        h = np.unique(h.view(np.int64))
                    if len(h):
                        at.append(np.full(len(h), i))
                        hits.append(h)
                if size >= AT_ONCE or i == batch.num_rows - 1:
                    if at:
                        yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(np.concatenate(at))), pa.array(np.concatenate(hits))], ["_d", "_h"])
                    at, hits, size = [], [], 0
            if at:
                yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(np.concatenate(at))), pa.array(np.concatenate(hits))], ["_d", "_h"])

    return run


def quoted(passages: DataFrame, docs: DataFrame, passage_id: str, doc_id: str, text: str) -> DataFrame:
    """(passage_id, doc_id, match): which text holds which passage word for word (exact) or after normalisation (normalized).

    Passages of any length and kind meet by their seeds; null and empty ones, and null texts, match
    nothing.  Passages of equal text are looked for once.  Texts of one id are looked at each by
    itself, and the id is told once, with its best match.  The texts are read twice: for their seeds,
    of which only those that some passage has are kept while they are few enough to be sent, and to be
    looked at; they are shuffled only where the pairs to look at are too many to be sent to them.
    """
    spark = docs.sparkSession
    asked = passages.select(F.col(passage_id).alias("_p"), F.col(text).alias("_q")).where("_q != ''")
    seeds = kept(asked.select("_q").distinct().mapInArrow(_seeds_of_passages, "_q string, _n int, _h long"), "passages")
    lengths = sorted(r[0] for r in seeds.select("_n").distinct().collect())  # GRAM and at most SHORT + 1 others
    given = docs.select(F.col(text).alias("_t"), F.col(doc_id).alias("_d"))
    hashes = seeds.select("_h").distinct()
    sent = None
    if hashes.count() <= SEEDS_SENT:
        sent = spark.sparkContext.broadcast(np.sort(hashes.toArrow().column(0).to_numpy()))
    kind = docs.schema[doc_id].dataType.simpleString()
    hits = given.where("_d IS NOT NULL").mapInArrow(_seeds_of_texts(lengths, sent), f"_d {kind}, _h long") if lengths else given.limit(0).select("_d", F.lit(0).cast("long").alias("_h"))
    near = kept(hits.join(seeds.select("_h", "_q"), "_h").select("_d", "_q").distinct(), "near")
    plain = kept(_looked_at(near, given, lambda t, q: F.when(F.contains(t, q), "exact")), "exact")
    other = plain.where("match IS NULL").drop("match").withColumnRenamed("_q", "_raw")
    other = kept(other.join(seeds.select(F.col("_q").alias("_raw"), normalize_quote(F.col("_q")).alias("_q")), "_raw"), "others")
    told = other.select("_d").distinct()
    told = F.broadcast(told) if other.count() <= SEEDS_SENT else told
    # stored before it is met, so that a text is normalised once
    normal = kept(given.join(told, "_d", "left_semi").select("_d", normalize_quote(F.col("_t")).alias("_t")), "normal")
    rest = _looked_at(other, normal, lambda t, q: F.when(F.contains(t, q), "normalized"))
    found = plain.union(rest.select("_d", F.col("_raw").alias("_q"), "match")).where("match IS NOT NULL")
    found = found.groupBy("_d", "_q").agg(F.min("match").alias("match"))  # exact before normalized
    return found.join(asked, "_q").select(F.col("_p").alias(passage_id), F.col("_d").alias(doc_id), "match").distinct()


def _looked_at(pairs: DataFrame, texts: DataFrame, kind: Callable[[Column, Column], Column]) -> DataFrame:
    """(_d, ..., _q) with match, what ``kind`` tells of text and passage; pairs are sent to the texts while they are few."""
    size = pairs.agg(F.coalesce(F.sum(F.length("_q") + 16), F.lit(0))).first()[0]
    rest = [c for c in pairs.columns if c != "_d"]
    if size > PAIRS_SENT:
        return pairs.join(texts, "_d").select("_d", *rest, kind(F.col("_t"), F.col("_q")).alias("match"))
    told = pairs.groupBy("_d").agg(F.collect_list(F.struct(*rest)).alias("_qs"))
    met = texts.join(F.broadcast(told), "_d")
    return met.select("_d", F.inline(F.transform("_qs", lambda x: F.struct(*[x[c].alias(c) for c in rest], kind(F.col("_t"), x["_q"]).alias("match")))))
