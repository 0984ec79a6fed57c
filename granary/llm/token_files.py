"""Token ids in files: Simple-8b words with escapes and per-block offsets.

Simple-8b (Anh and Moffat, "Index compression using 64-bit words", 2010): the top four bits of a
64-bit word name a selector, which says how many ids of how many bits the other sixty hold.

Layout.  Documents are ordered by id over range partitions; each partition is a shard, and each
row of the Parquet files that Spark writes is a segment of about SEGMENT ids made of whole
documents:

    shard, segment   place in the order
    first            ids in the shard before this segment
    doc_ids, lengths the segment's documents and how many ids each has
    words            little-endian 64-bit words
    offsets          for each block of BLOCK ids, the number of its first word (uint32), and the end
    escapes          ids of over sixty bits, in order; their words have selector 0

Blocks start at a word of their own, so every block of a segment decodes independently and all at
once in numpy.  Segments hold whole documents, so every row decodes by itself and reading needs no
shuffle: only the shards' totals (a row each) are summed to give each document its start.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from granary.llm.bpe import chunks
from granary.llm.shared import stored

#: Spark runs a task on each core; threads of the library's own would cost each worker memory and spinning.
os.environ["TOKENIZERS_PARALLELISM"] = "false"

BLOCK, SEGMENT = 1024, 1 << 18
KNOWN = 1_000_000  # words that a worker remembers
CHUNK = 1 << 22  # characters encoded together
#: Ids per word and bits of each for selectors 1 to 14 (fixed values of Simple-8b); 0 is an escape.
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
_PAYLOAD = np.uint64((1 << 60) - 1)


def _widths(ids: np.ndarray) -> np.ndarray:
    """Bits that each id needs, 1 at least."""
    out = np.zeros(len(ids), np.uint8)
    for shift in (32, 16, 8, 4, 2, 1):
        big = (ids >> np.uint64(shift)) > 0
        out[big] += shift
        ids = np.where(big, ids >> np.uint64(shift), ids)
    return out + 1


_SMALL = _widths(np.arange(1 << 16, dtype=np.uint64))


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, block offsets and escapes of ids (uint64)."""
    n = len(ids)
    if n == 0:
        return np.empty(0, np.uint64), np.zeros(1, np.uint32), np.empty(0, np.uint64)
    blocks = -(-n // BLOCK)
    # a row for each block; past the end and past a block's end there is room for anything
    wide = np.zeros((blocks, BLOCK + 64), np.uint8)
    width = _SMALL[ids] if ids.max() < len(_SMALL) else _widths(ids)
    flat = np.zeros(blocks * BLOCK, np.uint8)
    flat[:n] = width
    wide[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    wide = wide.ravel()
    # the largest width among the next c, for growing c, and the selector with the most ids that fit
    choice = np.where(wide > 60, 0, 14).astype(np.uint8)
    most, span = wide, 1
    for s in range(13, 0, -1):
        step = int(COUNTS[s]) - span
        while step > 0:
            k = min(step, span)
            most = np.maximum(most, np.concatenate([most[k:], np.zeros(k, np.uint8)]))
            span += k
            step -= k
        choice[most <= BITS[s]] = s
    size = np.full(blocks, BLOCK)
    size[-1] = n - BLOCK * (blocks - 1)
    at, live, base = np.zeros(blocks, np.int64), np.arange(blocks), np.arange(blocks) * (BLOCK + 64)
    where, which = [], []
    while len(live):
        where.append(at[live])
        which.append(live)
        at[live] += COUNTS[choice[base[live] + at[live]]]
        live = live[at[live] < size[live]]
    where, which = np.concatenate(where), np.concatenate(which)
    order = np.argsort(which * BLOCK + where)
    where, which = where[order], which[order]
    sel = choice[base[which] + where]
    padded = np.zeros(blocks * BLOCK + 64, np.uint64)
    padded[:n] = ids
    start = which * BLOCK + where
    end = which * BLOCK + size[which]
    words = sel.astype(np.uint64) << np.uint64(60)
    for s in range(1, 15):
        w = np.flatnonzero(sel == s)
        if not len(w):
            continue
        c, b = int(COUNTS[s]), int(BITS[s])
        for j in range(c):
            i = start[w] + j
            words[w] |= np.where(i < end[w], padded[i], 0) << np.uint64(b * j)
    escapes = padded[start[sel == 0]]
    offsets = np.searchsorted(which, np.arange(blocks + 1)).astype(np.uint32)
    return words, offsets, escapes


def unpack(words: np.ndarray, offsets: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The n ids of a segment."""
    out = np.zeros(n, np.uint64)
    if n == 0:
        return out
    sel = (words >> np.uint64(60)).astype(np.int64)
    count = COUNTS[sel]
    total = np.cumsum(count) - count
    block = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets.astype(np.int64)))
    start = total - total[offsets[:-1].astype(np.int64)][block] + block * BLOCK
    end = np.minimum((block + 1) * BLOCK, n)
    for s in range(1, 15):
        w = np.flatnonzero(sel == s)
        if not len(w):
            continue
        c, b = int(COUNTS[s]), int(BITS[s])
        mask, word, i, e = np.uint64((1 << b) - 1), words[w] & _PAYLOAD, start[w], end[w]
        inside = i + c <= e
        if inside.all():
            for j in range(c):
                out[i + j] = (word >> np.uint64(b * j)) & mask
        else:
            for j in range(c):
                ok = i + j < e
                out[i[ok] + j] = (word[ok] >> np.uint64(b * j)) & mask
    out[start[sel == 0]] = escapes
    return out


class _Memory:
    """Ids of strings: Arrow finds a string's place, the ids of all stand in one pool."""

    def __init__(self):
        self.words = pa.array([], pa.string())
        self.pool = np.empty(1 << 18, np.int32)
        self.ends = np.zeros(1, np.int64)  # where each string's ids end; the first starts at 0

    def places(self, items: pa.Array) -> np.ndarray:
        """The place of each string, -1 for unknown ones."""
        return pc.fill_null(pc.index_in(items, value_set=self.words), -1).to_numpy().copy()

    def add(self, new: pa.Array, ids: np.ndarray, n: np.ndarray) -> None:
        used = int(self.ends[-1])
        if used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty(max(len(self.pool), len(ids)), np.int32)])
        self.pool[used : used + len(ids)] = ids
        self.ends = np.concatenate([self.ends, used + np.cumsum(n)])
        self.words = pa.concat_arrays([self.words, new])

    def get(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the strings at these places in a row, and how many each has."""
        lists = pa.LargeListArray.from_arrays(pa.array(self.ends), pa.array(self.pool[: self.ends[-1]]))
        got = lists.take(pa.array(places))
        return got.flatten().to_numpy(), np.diff(got.offsets.to_numpy())


#: Normaliser and pre-tokeniser of vocabularies that drop white space and never look across it (fixed values).
_NORMAL = ["NFC", ("Replace", "\\s+", " "), "Lowercase"]
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Latin letters that are one letter when lower-cased too, with or without a stop or comma after them.
_PLAIN = r"^[A-Za-z\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}]+[.,]?$"


def _by_words(told: dict) -> bool:
    """Whether words can be encoded by themselves, lower-cased and apart from a stop or comma."""
    steps = [(n["type"], n["pattern"].get("Regex"), n["content"]) if n["type"] == "Replace" else n["type"] for n in (told.get("normalizer") or {}).get("normalizers", [])]
    splits = (told.get("pre_tokenizer") or {}).get("pretokenizers", [])
    cut = splits and splits[0].get("pattern", {}).get("Regex") == _SPLIT and splits[0].get("behavior") == "Removed" and splits[0].get("invert") is True
    marks = all(not re.search(r"\s", t["content"]) and re.search(r"[^\w.,]", t["content"]) and not (t["lstrip"] or t["rstrip"] or t["normalized"]) for t in told.get("added_tokens", []))
    return bool(steps == _NORMAL and cut and marks and told["model"].get("end_of_word_suffix"))


class WordCoder:
    """The tokenizers library with a memory of words.

    Arrow cuts texts at ASCII white space, finds the distinct words and those not met before.  Of these,
    words of plain letters, with or without a stop or comma after them, share the letters' ids, and are
    encoded many at a time: a token that ends in the model's word suffix ends a word.  Other words
    are encoded as they are.  Where the vocabulary looks across white space or doesn't lower-case
    (see _by_words), the library encodes whole texts.
    """

    def __init__(self, spec: str):
        self.tok = Tokenizer.from_str(spec)
        self.tok.no_padding()
        self.tok.no_truncation()
        told = json.loads(spec)
        self.by_words = _by_words(told)
        suffix = told["model"].get("end_of_word_suffix")
        self.ends = np.zeros(self.tok.get_vocab_size() + 1, bool)
        for t, i in self.tok.get_vocab().items():
            self.ends[i] = bool(suffix) and t.endswith(suffix)
        self._forget()

    def _forget(self) -> None:
        self.all, self.letters = _Memory(), _Memory()
        if self.by_words:
            self.all.add(pa.array([""]), np.empty(0, np.int32), np.zeros(1, np.int64))
            self._learn_letters(pa.array([".", ","]))

    def _slow(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = self.tok.encode(new, is_pretokenized=True, add_special_tokens=False)
        if None not in got.word_ids:
            return np.array(got.ids, np.int32), np.bincount(np.array(got.word_ids, np.int64), minlength=len(new))
        each = [self.tok.encode(w, add_special_tokens=False).ids for w in new]  # special tokens have no word
        return np.array([x for e in each for x in e], np.int32), np.array([len(e) for e in each])

    def _learn_letters(self, new: pa.Array) -> None:
        for t in range(0, len(new), 1 << 14):
            part = new.slice(t, 1 << 14)
            words = part.to_pylist()
            runs = [words[s : s + 256] for s in range(0, len(words), 256)]
            made = []
            for run, got in zip(runs, self.tok.encode_batch_fast([" ".join(r) for r in runs], add_special_tokens=False), strict=True):
                ids = np.array(got.ids, np.int32)
                stop = np.flatnonzero(self.ends[ids]) + 1
                made.append((ids, np.diff(stop, prepend=0)) if len(stop) == len(run) and stop[-1] == len(ids) else self._slow(run))
            self.letters.add(part, *(np.concatenate(x) for x in zip(*made, strict=True)))

    def _learn(self, new: pa.Array) -> np.ndarray:
        """The places that new words get."""
        plain = pc.match_substring_regex(new, _PLAIN)
        whole = new.filter(plain)
        if len(whole):
            core = pc.utf8_lower(pc.utf8_rtrim(whole, characters=".,")).dictionary_encode()
            place = self.letters.places(core.dictionary)
            fresh = core.dictionary.filter(pa.array(place < 0))
            if len(fresh):
                place[place < 0] = len(self.letters.words) + np.arange(len(fresh))
                self._learn_letters(fresh)
            # each word as its letters and its stop (place 0), comma (place 1) or nothing
            tail = np.where(pc.ends_with(whole, ".").to_numpy(zero_copy_only=False), 0, np.where(pc.ends_with(whole, ",").to_numpy(zero_copy_only=False), 1, -1))
            both = np.stack([place[core.indices.to_numpy()], tail], 1)
            ids, n = self.letters.get(both[both >= 0])
            of = np.zeros(both.shape, np.int64)
            of[both >= 0] = n
            self.all.add(whole, ids, of.sum(1))
        other = new.filter(pc.invert(plain))
        for s in range(0, len(other), 1 << 14):
            part = other.slice(s, 1 << 14)
            words = part.to_pylist()
            made = [self._slow(words[t : t + 512]) for t in range(0, len(words), 512)]
            self.all.add(part, *(np.concatenate(x) for x in zip(*made, strict=True)))
        where = plain.to_numpy(zero_copy_only=False)
        return len(self.all.words) - len(new) + np.where(where, np.cumsum(where) - 1, len(whole) + np.cumsum(~where) - 1)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many each text has."""
        if not self.by_words:
            got = [np.array(e.ids, np.int32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
            return np.concatenate([np.empty(0, np.int32), *got]), np.array([len(g) for g in got], np.int64)
        split = pc.ascii_split_whitespace(pa.array(texts, pa.string()))
        ends = split.offsets.to_numpy().astype(np.int64)
        words = split.values.dictionary_encode()
        place = self.all.places(words.dictionary)
        if len(self.all.words) + int((place < 0).sum()) > KNOWN:
            self._forget()
            place = self.all.places(words.dictionary)
        if (place < 0).any():
            place[place < 0] = self._learn(words.dictionary.filter(pa.array(place < 0)))
        ids, n = self.all.get(place[words.indices.to_numpy()])
        return ids, np.diff(np.concatenate([[0], np.cumsum(n)])[ends])


_coders: dict[str, WordCoder] = {}

SCHEMA = "shard int, segment int, first long, n_ids long, doc_ids array<long>, lengths array<long>, words binary, offsets binary, escapes binary"


def _segments(spec, end_id: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = spec.value
        if text not in _coders:
            _coders.clear()
            _coders[text] = WordCoder(text)
        coder = _coders[text]
        shard = TaskContext.get().partitionId()
        docs: list = []
        held: list[np.ndarray] = []
        n = first = segment = 0

        def made() -> pa.RecordBatch:
            ids = np.concatenate(held)
            words, offsets, escapes = pack(ids.astype(np.uint64))
            row = {"shard": shard, "segment": segment, "first": first, "n_ids": len(ids), "doc_ids": [d for d, _ in docs], "lengths": [k for _, k in docs], "words": words.astype("<u8").tobytes(), "offsets": offsets.astype("<u4").tobytes(), "escapes": escapes.astype("<u8").tobytes()}
            return pa.RecordBatch.from_pylist([row], schema=_SEGMENT)

        for batch in batches:
            docs_of = batch.column(0).to_pylist()
            for at, texts in chunks(batch.column(1), CHUNK):
                ids, lens = coder.encode(texts)
                if end_id is not None:
                    ids = np.insert(ids, np.cumsum(lens), end_id)
                    lens = lens + 1
                s = 0
                for d, k in zip(docs_of[at : at + len(texts)], lens.tolist(), strict=True):
                    docs.append((d, k))
                    held.append(ids[s : s + k])
                    s += k
                    n += k
                    if n >= SEGMENT or len(docs) >= SEGMENT:
                        yield made()
                        first, segment, docs, held, n = first + n, segment + 1, [], [], 0
        if docs:
            yield made()

    return run


_SEGMENT = pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("words", pa.binary()), ("offsets", pa.binary()), ("escapes", pa.binary())])


def write_tokens(docs: DataFrame, path: str, end_id: int | None = None, name: str = "token-files") -> DataFrame:
    """Encode every whole text with the tokenizer file at ``path`` and write the ids in ascending doc_id order.

    Takes columns doc_id (long) and text; others are ignored.  Each document's ids are followed by
    ``end_id`` if there is one.  Null and empty texts have no other ids.  Rows that share a doc_id
    stay separate and are ordered by the xxhash64 of their text, so that they can be dealt to many
    tasks; equal rows, even a third of all, are dealt freely.  Null ids come first.  Returns the
    written segments as read back (columns SCHEMA).
    """
    spark = docs.sparkSession
    with open(path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), "h", "row"]
    keyed = given.withColumn("h", F.xxhash64(F.coalesce("text", F.lit("")))).withColumn("row", F.monotonically_increasing_id())
    ordered = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    return stored(ordered.mapInArrow(_segments(spec, end_id), SCHEMA), name)


def _read(whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                shard, _, first, n, doc_ids, lengths, *held = (c[row] for c in batch.columns)
                words, offsets, escapes = (np.frombuffer(b.as_buffer(), t) for b, t in zip(held, ("<u8", "<u4", "<u8"), strict=True))
                ids = unpack(words, offsets, escapes, n.as_py())
                k = np.array(lengths.as_py(), np.int64)
                ends = np.cumsum(k)
                cols = {"doc_id": doc_ids.values, "shard": pa.array(np.full(len(k), shard.as_py()), pa.int32()), "at": pa.array(first.as_py() + ends - k), "n_tokens": pa.array(k)}
                if whole:
                    cols["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int64)))
                else:
                    raw = memoryview(ids.astype("<u4").tobytes())
                    cols["ids_crc32"] = pa.array([zlib.crc32(raw[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), k.tolist(), strict=True)], pa.int64())
                yield pa.RecordBatch.from_pydict(cols)

    return run


def read_tokens(segments: DataFrame, digest: bool = False) -> DataFrame:
    """Documents of written segments: doc_id, start (ids of all documents before it), n_tokens, ids (or ids_crc32)."""
    made = "doc_id long, shard int, at long, n_tokens long, " + ("ids_crc32 long" if digest else "ids array<long>")
    totals = segments.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    starts = totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    docs = segments.mapInArrow(_read(not digest), made)
    return docs.join(F.broadcast(starts), "shard").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32" if digest else "ids")


def op3_token_files(spark, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """All documents' ids written as Simple-8b segments, and what the files give back."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_tokens(write_tokens(docs, vocabulary, end_id=1), digest=True)


QUERIES = {"op3_token_files": op3_token_files}
#: SQL has no tokenizer: tested against the tokenizers library and exact round trips.
SQL: dict[str, str] = {}
