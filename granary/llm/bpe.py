"""Byte-level BPE encoding and decoding by speculation and verification.

A text is cut into pre-tokens by the byte-level pattern.  For each distinct pre-token greedy
longest match proposes tokens.  A sequence of tokens is the BPE encoding exactly if every token
encodes to itself and every two neighbours are compatible, that is, no merge across their
boundary would have come before the merges that build them; compatibility is checked for all
neighbouring pairs of a batch at once by walking both sides back down their merge trees in numpy.
Only pre-tokens with a failing pair go through exact merging.

Everything runs inside one Arrow pass over the documents, without a shuffle.  The vocabulary is
read on the driver and broadcast (a few MB, the size of the file).
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.shared import give_back

#: The byte-level pattern of public byte-level BPE vocabularies (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NEVER = np.iinfo(np.int64).max
CACHED = 200_000  # pre-tokens that a worker remembers
CHUNK = 1 << 20  # characters encoded together


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes for themselves, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _check(told: dict) -> None:
    """ValueError for a vocabulary file that isn't plain byte-level BPE: other options would give other ids."""
    pre, model = told.get("pre_tokenizer") or {}, told["model"]
    wrong = [
        told.get("normalizer") is not None and "a normalizer",
        (pre.get("type"), pre.get("use_regex", True), bool(pre.get("add_prefix_space"))) != ("ByteLevel", True, False) and "another pre-tokenizer",
        model.get("type", "BPE") != "BPE" and "another model",
        *(bool(model.get(k)) and k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")),
        any(t.get(k) for t in told.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word", "normalized")) and "options of added tokens",
    ]
    if found := [w for w in wrong if w]:
        raise ValueError(f"not a plain byte-level BPE vocabulary: {', '.join(found)}")


class Coder:
    """Encoder and decoder for one vocabulary."""

    def __init__(self, spec: str):
        told = json.loads(spec)
        _check(told)
        model, letters = told["model"], byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.special = {t["content"]: t["id"] for t in told.get("added_tokens", [])}
        vocab = {k: v for k, v in model["vocab"].items() if k not in self.special}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.pieces = [b""] * size
        for k, v in vocab.items():
            self.pieces[v] = raw(k)
        for k, v in self.special.items():
            self.pieces[v] = k.encode()
        self.ids = {self.pieces[v]: v for v in vocab.values()}
        self.rank = np.full(size, -1, np.int64)
        self.left, self.right = np.zeros(size, np.int64), np.zeros(size, np.int64)
        pair, order = [], []
        for r, (a, b) in enumerate(merges):
            a, b, c = vocab[a], vocab[b], vocab[a + b]
            if self.rank[c] >= 0:
                raise ValueError("two merges make the same token")
            self.rank[c], self.left[c], self.right[c] = r, a, b
            pair.append(a * size + b)
            order.append(r)
        self.size = size
        at = np.argsort(pair)
        self.pairs, self.pair_rank = np.array(pair, np.int64)[at], np.array(order, np.int64)[at]
        self.merge = {(int(p) // size, int(p) % size): (int(r), None) for p, r in zip(pair, order, strict=True)}
        made = {int(self.rank[t]): t for t in range(size) if self.rank[t] >= 0}
        self.merge = {k: (r, made[r]) for k, (r, _) in self.merge.items()}
        self.prefixes = {p[:n] for p in self.ids for n in range(1, len(p) + 1)}
        inner = np.flatnonzero(self.rank >= 0)
        self.sound = np.ones(size, bool)  # tokens that encode to themselves
        self.sound[inner] = self.compatible(self.left[inner], self.right[inner], below=True)
        for t in inner[np.argsort(self.rank[inner])]:
            self.sound[t] &= self.sound[self.left[t]] and self.sound[self.right[t]]
        self.cut = regex.compile(PATTERN)
        self.marks = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self._forget()

    def _forget(self):
        self.known: dict[str, int] = {}
        self.pool = np.empty(1 << 16, np.int32)
        self.used = 0
        self.first, self.count = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)

    def _pair_ranks(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        want = x * self.size + y
        at = np.minimum(np.searchsorted(self.pairs, want), len(self.pairs) - 1)
        return np.where(self.pairs[at] == want, self.pair_rank[at], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray, below: bool = False) -> np.ndarray:
        """Whether a and b stay apart when their bytes are merged together; ``below``: before the merge of a and b itself."""
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        x, y = a.astype(np.int64), b.astype(np.int64)
        over_x = np.full(len(a), NEVER)
        over_y = over_x.copy()  # ranks of the merges that take x and y up into their parents
        top = below
        while len(live):
            cross = self._pair_ranks(x, y)
            # leftmost first among equal ranks: the merge that takes x comes before, that of y after the one across
            bad = (cross < over_x) & (cross <= over_y) & (cross < NEVER)
            if top:
                bad[:] = False
                top = False
            ok[live[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~bad & ((rx >= 0) | (ry >= 0))
            live, x, y, over_x, over_y, rx, ry = (v[go] for v in (live, x, y, over_x, over_y, rx, ry))
            undo = rx > ry
            over_x, over_y = np.where(undo, rx, over_x), np.where(undo, over_y, ry)
            x, y = np.where(undo, self.right[x], x), np.where(undo, y, self.left[y])
        return ok

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        out, at, ids, prefixes = [], 0, self.ids, self.prefixes
        while at < len(word):
            end = hit = at + 1
            while word[at:end] in prefixes and end <= len(word):
                if word[at:end] in ids:
                    hit = end
                end += 1
            out.append(ids[word[at:hit]])
            at = hit
        return out

    def merged(self, word: bytes) -> list[int]:
        """Exact merging: the lowest rank first, leftmost among equals."""
        part = [self.ids[word[i : i + 1]] for i in range(len(word))]
        nxt, prv, n = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1)), len(part)
        merge = self.merge
        heap = [(m[0], i, part[i], part[i + 1]) for i in range(n - 1) if (m := merge.get((part[i], part[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if part[i] != a or j >= n or part[j] != b:
                continue
            part[i], part[j] = merge[a, b][1], -1
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
                if m := merge.get((part[i], part[nxt[i]])):
                    heapq.heappush(heap, (m[0], i, part[i], part[nxt[i]]))
            if (p := prv[i]) >= 0 and (m := merge.get((part[p], part[i]))):
                heapq.heappush(heap, (m[0], p, part[p], part[i]))
        return [x for x in part if x >= 0]

    def encode_words(self, ws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all words in a row, and how many each has."""
        proposed = [self.propose(w) for w in ws]
        n = np.array([len(p) for p in proposed], np.int64)
        flat = np.array([t for p in proposed for t in p], np.int64)
        word = np.repeat(np.arange(len(ws)), n)
        wrong = np.zeros(len(ws), bool)
        wrong[word[~self.sound[flat]]] = True
        near = np.flatnonzero(word[1:] == word[:-1])
        pairs, back = np.unique(flat[near] * self.size + flat[near + 1], return_inverse=True)
        ok = self.compatible(pairs // self.size, pairs % self.size)
        wrong[word[near[~ok[back]]]] = True
        for i in np.flatnonzero(wrong):
            proposed[i] = self.merged(ws[i])
        if wrong.any():
            n = np.array([len(p) for p in proposed], np.int64)
            flat = np.array([t for p in proposed for t in p], np.int64)
        return flat, n

    def _learn(self, new: list[str]) -> None:
        plain = [w.encode("utf-8", "surrogatepass") for w in new]
        flat, n = self.encode_words(plain)
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        self.pool[self.used : self.used + len(flat)] = flat
        at = len(self.known)
        while at + len(new) > len(self.first):
            self.first, self.count = (np.concatenate([v, np.empty_like(v)]) for v in (self.first, self.count))
        self.first[at : at + len(new)] = self.used + np.cumsum(n) - n
        self.count[at : at + len(new)] = n
        self.used += len(flat)
        self.known.update(zip(new, range(at, at + len(new)), strict=True))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text; the vocabulary's special tokens in a text are found first."""
        words: list[str] = []
        ends = []
        for t in texts:
            if self.marks and any(s in t for s in self.special):
                for p in self.marks.split(t):
                    words += [p] if p in self.special else self.cut.findall(p)
            else:
                words += self.cut.findall(t)
            ends.append(len(words))
        fresh = set(words).difference(self.known)
        if len(self.known) + len(fresh) > CACHED:
            self._forget()
            fresh = set(words)
        if marks := fresh.intersection(self.special):
            for s in sorted(marks):
                at = len(self.known)
                if self.used + 1 > len(self.pool):
                    self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
                if at + 1 > len(self.first):
                    self.first, self.count = (np.concatenate([v, np.empty_like(v)]) for v in (self.first, self.count))
                self.pool[self.used], self.first[at], self.count[at] = self.special[s], self.used, 1
                self.used += 1
                self.known[s] = at
            fresh -= marks
        if fresh:
            self._learn(sorted(fresh))
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        n = self.count[at]
        stop = np.cumsum(n)
        total = int(stop[-1]) if len(stop) else 0
        ids = self.pool[np.repeat(self.first[at] - (stop - n), n) + np.arange(total)]
        edge = np.concatenate([[0], stop])[np.array(ends, np.int64)]
        return np.split(ids, edge[:-1]) if len(texts) else []

    def decode(self, ids: np.ndarray) -> str:
        """Text of token ids, special ones included; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.pieces.__getitem__, ids.tolist())).decode("utf-8", "replace")


_coders: dict[str, Coder] = {}


def _coder(spec) -> Coder:
    if spec.id not in _coders:
        _coders.clear()
        _coders[spec.id] = Coder(spec.value)
    return _coders[spec.id]


class _Spec:
    """The vocabulary file's text as a broadcast, with a name for the worker's cache."""

    def __init__(self, spark, path: str):
        with open(path, encoding="utf-8") as f:
            text = f.read()
        self.id, self.held = hashlib.sha256(text.encode()).hexdigest(), spark.sparkContext.broadcast(text)

    @property
    def value(self) -> str:
        return self.held.value


def chunks(column: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, list[str]]]:
    """Texts of a column in runs of about ``most`` characters, with the row each run starts at; nulls are ''."""
    held, size, at = [], 0, 0
    for i, t in enumerate(column):
        t = t.as_py() or ""
        held.append(t)
        size += len(t)
        if size >= most:
            yield at, held
            held, size, at = [], 0, i + 1
    if held:
        yield at, held


def _pass(spec: _Spec, rest: int, finish: Callable) -> Callable:
    """A mapInArrow function: rows of (text, others...) -> (others..., what finish makes of coder and ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(spec)
        for batch in batches:
            for at, texts in chunks(batch.column(0)):
                names, arrays = finish(coder, coder.encode(texts))
                own = [batch.column(1 + i).slice(at, len(texts)) for i in range(rest)]
                yield pa.RecordBatch.from_arrays([*own, *arrays], [*(batch.schema.names[1 : 1 + rest]), *names])
        give_back()

    return run


def _as_lists(ids: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, ids)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32), pa.int32()))


def _ids(coder: Coder, ids: list[np.ndarray]):
    return ["ids", "n_tokens"], [_as_lists(ids), pa.array([len(x) for x in ids], pa.int64())]


def _digests(coder: Coder, ids: list[np.ndarray]):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return ["n_tokens", "ids_sha256", "decoded_sha256"], [
        pa.array([len(x) for x in ids], pa.int64()),
        pa.array([sha(x.astype("<u4").tobytes()) for x in ids], pa.string()),
        pa.array([sha(coder.decode(x).encode("utf-8", "surrogatepass")) for x in ids], pa.string()),
    ]


def _over(docs: DataFrame, path: str, finish: Callable, made: str, dropped: list[str]) -> DataFrame:
    own = [c for c in docs.columns if c != "text" and c not in dropped]
    given = docs.select(F.col("text").cast("string").alias("text"), *[F.col(f"`{c}`") for c in own])
    schema = ", ".join([*(f"`{c}` {given.schema[c].dataType.simpleString()}" for c in own), made])
    return given.mapInArrow(_pass(_Spec(docs.sparkSession, path), len(own), finish), schema)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """Token ids of every whole text.

    Takes a column text; returns all other columns, ids (array of int) and n_tokens (long); columns
    of those names in ``docs`` are replaced.  Null and empty texts have no ids.  Special tokens of
    the vocabulary that stand in a text become their ids, as the tokenizers library has it.
    """
    return _over(docs, path, _ids, "ids array<int>, n_tokens long", ["ids", "n_tokens"])


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds a column text to rows with a column ids: the decoded text ('' for no or null ids)."""
    spec = _Spec(encoded.sparkSession, path)

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        coder = _coder(spec)
        return ids.map(lambda x: coder.decode(np.asarray(x, np.int64)) if x is not None else "")

    return encoded.withColumn("text", text("ids"))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of every whole text beside its other columns, encoded and decoded in one pass."""
    return _over(docs, path, _digests, "n_tokens long, ids_sha256 string, decoded_sha256 string", ["n_tokens", "ids_sha256", "decoded_sha256"])


def op4_bpe(spark, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """Digests of ids and of the decoded text for every document."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return round_trip(docs, vocabulary)


QUERIES = {"op4_bpe": op4_bpe}
#: SQL has no BPE: tested against the tokenizers library.
SQL: dict[str, str] = {}
