"""SentencePiece encoding and decoding through a table of distinct chunks.

Where no piece of a vocabulary holds a whitespace marker behind another character, no piece crosses
from one marked word into the next, so a text's segmentation is that of its marked words (a run of
markers and what follows it), one after the other.  A task cuts its texts into marked words, keeps
the distinct ones in a table, segments each of them once with the sentencepiece library, and joins
the ids back by position: all in numpy and Arrow, in one pass without a shuffle.  A worker remembers
the words of earlier batches, up to KNOWN of them.

Of vocabularies that let pieces cross, or that change texts before cutting them, every whole text is
a chunk of its own.  The model's file is read on the driver and broadcast (its size, about 0.5 MB).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.bpe import chunks
from granary.llm.shared import give_back

MARK = "▁"  # stands for a blank in pieces (fixed value of the library)
KNOWN = 400_000  # marked words that a worker remembers
SHORT = 64  # bytes of the longest one that it remembers
CHUNK = 1 << 20  # characters encoded together


class Pieces:
    """A model: ids of texts, texts of ids."""

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        told = sentencepiece_model_pb2.ModelProto()
        told.ParseFromString(model)
        norm, spec = told.normalizer_spec, told.trainer_spec
        plain = not norm.precompiled_charsmap and norm.add_dummy_prefix and not norm.remove_extra_whitespaces and norm.escape_whitespaces
        own = any(p.type == p.USER_DEFINED for p in told.pieces)
        crossing = any(MARK in p.piece.lstrip(MARK) for p in told.pieces)
        #: whether marked words can be segmented one by one
        self.by_word = plain and not own and not crossing and spec.model_type == spec.BPE and self.lib.piece_to_id(MARK) != self.lib.unk_id() and not spec.treat_whitespace_as_suffix
        self.end = self.lib.eos_id()
        self.pieces, self.control, self.marked = [], [], []
        for p in told.pieces:
            byte = p.type == p.BYTE
            self.pieces.append(bytes([int(p.piece[3:5], 16)]) if byte else p.piece.replace(MARK, " ").encode())
            self.control.append(p.type == p.CONTROL)
            self.marked.append(not byte and p.piece.startswith(MARK))
        self.is_control = np.array(self.control, bool)
        self.pieces[self.lib.unk_id()] = spec.unk_surface.encode()
        self.prefixed = bool(norm.add_dummy_prefix)
        self.lone = np.array([self.lib.piece_to_id(MARK)], np.int32).tobytes()  # the library gives an empty text no marker
        self.known: dict[bytes, bytes] = {}

    def _segmented(self, words: list[bytes]) -> list[bytes]:
        """Ids of marked words as bytes of 32-bit integers; the library puts the first marker back itself."""
        out = [self.lone if w == b" " else self.known.get(w) for w in words]
        new = [i for i, x in enumerate(out) if x is None]
        if new:
            if len(self.known) > KNOWN:
                self.known.clear()
            made = self.lib.encode([words[i][1:].decode("utf-8") for i in new], num_threads=1)
            for i, ids in zip(new, made, strict=True):
                out[i] = np.array(ids, np.int32).tobytes()
                if len(words[i]) <= SHORT:
                    self.known[words[i]] = out[i]
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, with the end id."""
        if not self.by_word:
            return [np.array([*ids, self.end], np.int32) for ids in self.lib.encode(list(texts), num_threads=1)]
        marked = [b" " + t.replace(MARK, " ").encode("utf-8") if t else b"" for t in texts]
        ends = np.cumsum([0, *map(len, marked)])
        raw = b"".join(marked)
        blank = np.frombuffer(raw, np.uint8) == 0x20
        start = blank.copy()
        start[1:] &= ~blank[:-1]
        start[ends[:-1][np.diff(ends) > 0]] = True
        at = np.flatnonzero(start)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(at, len(raw))), pa.py_buffer(raw)]).dictionary_encode()
        distinct = self._segmented(words.dictionary.to_pylist())
        pool = np.frombuffer(b"".join(distinct), np.int32)
        size = np.fromiter(map(len, distinct), np.int64, len(distinct)) // 4
        first = np.cumsum(size) - size
        which = words.indices.to_numpy()
        n = size[which]
        stop = np.cumsum(n)
        total = int(stop[-1]) if len(stop) else 0
        ids = pool[np.repeat(first[which] - (stop - n), n) + np.arange(total)]
        edge = np.append(0, stop)[np.searchsorted(at, ends)]
        return [np.append(ids[a:b], np.int32(self.end)) for a, b in zip(edge[:-1], edge[1:], strict=True)]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: control ids are nothing, the first piece loses one marker, bytes that aren't UTF-8 are U+FFFD each."""
        ids = np.asarray(ids, np.int64)
        if len(ids) and ids.min() < 0:
            raise IndexError("negative piece id")
        # bytes on both sides of a control id don't make one character
        cuts = np.flatnonzero(self.is_control[ids])
        out, prefixed = [], self.prefixed
        for a, b in zip([0, *(cuts + 1)], [*cuts, len(ids)], strict=True):
            listed = ids[a:b].tolist()
            raw = b"".join(map(self.pieces.__getitem__, listed))
            if listed and prefixed:
                raw, prefixed = raw[self.marked[listed[0]] :], False
            try:
                out.append(raw.decode("utf-8"))
            except UnicodeDecodeError:
                out.append(_lenient(raw))
        return "".join(out)


def _lenient(raw: bytes) -> str:
    """UTF-8 with U+FFFD for every single byte that belongs to no character."""
    out, at = [], 0
    while at < len(raw):
        try:
            out.append(raw[at:].decode("utf-8"))
            break
        except UnicodeDecodeError as e:
            out.append(raw[at : at + e.start].decode("utf-8") + "�")
            at += e.start + 1
    return "".join(out)


_models: dict[str, Pieces] = {}


class _Spec:
    """The model's bytes as a broadcast, with a name for the worker's cache."""

    def __init__(self, spark, path: str):
        with open(path, "rb") as f:
            model = f.read()
        self.id, self.held = hashlib.sha256(model).hexdigest(), spark.sparkContext.broadcast(model)

    def load(self) -> Pieces:
        if self.id not in _models:
            _models.clear()
            _models[self.id] = Pieces(self.held.value)
        return _models[self.id]


def _pass(spec: _Spec, rest: int, finish: Callable) -> Callable:
    """A mapInArrow function: rows of (text, others...) -> (others..., what finish makes of model and ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = spec.load()
        for batch in batches:
            for at, texts in chunks(batch.column(0), CHUNK):
                names, arrays = finish(model, model.encode(texts))
                own = [batch.column(1 + i).slice(at, len(texts)) for i in range(rest)]
                yield pa.RecordBatch.from_arrays([*own, *arrays], [*(batch.schema.names[1 : 1 + rest]), *names])
        give_back()

    return run


def _ids(model: Pieces, ids: list[np.ndarray]):
    ends = np.cumsum([0, *map(len, ids)])
    listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids), pa.int32()))
    return ["ids", "n_tokens"], [listed, pa.array(np.diff(ends), pa.int64())]


def _digests(model: Pieces, ids: list[np.ndarray]):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return ["n_tokens", "ids_sha256", "decoded_sha256"], [
        pa.array([len(x) for x in ids], pa.int64()),
        pa.array([sha(" ".join(map(str, x.tolist())).encode()) for x in ids], pa.string()),
        pa.array([sha(model.decode(x).encode("utf-8")) for x in ids], pa.string()),
    ]


def _over(docs: DataFrame, path: str, finish: Callable, made: str, dropped: list[str]) -> DataFrame:
    own = [c for c in docs.columns if c != "text" and c not in dropped]
    given = docs.select(F.col("text").cast("string").alias("text"), *[F.col(f"`{c}`") for c in own])
    schema = ", ".join([*(f"`{c}` {given.schema[c].dataType.simpleString()}" for c in own), made])
    return given.mapInArrow(_pass(_Spec(docs.sparkSession, path), len(own), finish), schema)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """Piece ids of every whole text, with an end id.

    Takes a column text; returns all other columns, ids (array of int) and n_tokens (long); columns
    of those names in ``docs`` are replaced.  Null and empty texts have the end id alone.  Rows
    repeat freely; a text without blanks is one chunk however long it is.
    """
    return _over(docs, path, _ids, "ids array<int>, n_tokens long", ["ids", "n_tokens"])


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds a column text to rows with a column ids: the decoded text ('' for no or null ids)."""
    spec = _Spec(encoded.sparkSession, path)

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        model = spec.load()
        return ids.map(lambda x: model.decode(np.asarray(x, np.int64)) if x is not None else "")

    return encoded.withColumn("text", text("ids"))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of every whole text beside its other columns, encoded and decoded in one pass."""
    return _over(docs, path, _digests, "n_tokens long, ids_sha256 string, decoded_sha256 string", ["n_tokens", "ids_sha256", "decoded_sha256"])


def op13_pieces(spark, sf_dir: str, model: str | None = None) -> DataFrame:
    """Digests of ids and of the decoded text for every document."""
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return round_trip(docs, model)


QUERIES = {"op13_pieces": op13_pieces}
#: SQL has no segmentation: tested against the sentencepiece library.
SQL: dict[str, str] = {}
