"""Vectors of chunks: hashed features, or any function of texts, in batches of bounded size, with counts checked."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.operators.store import kept

TOKEN = regex.compile(r"[\p{L}\p{N}]+")
KNOWN = 200_000  # words whose places a worker remembers


class Hashed:
    """Texts to vectors: each word adds its sign to its place, both from the word's md5; then length one, or all zeros without words."""

    def __init__(self, dim: int = 64):
        self.dim, self.known = dim, {}

    def __getstate__(self):
        return {"dim": self.dim, "known": {}}

    def place(self, word: str) -> tuple[int, float]:
        """(place, sign) of a lower-case word."""
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= KNOWN:
                self.known.clear()
            h = hashlib.md5(word.encode("utf-8", "surrogatepass")).hexdigest()
            found = self.known[word] = int(h[:8], 16) % self.dim, 1.0 if int(h[8], 16) % 2 == 0 else -1.0
        return found

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for i, text in enumerate(texts):
            for word in TOKEN.findall(text.lower()):
                at, sign = self.place(word)
                out[i, at] += sign
        size = np.sqrt((out * out).sum(1, keepdims=True))
        return np.divide(out, size, out=out, where=size > 0)


def _pass(embed: Callable[[list[str]], np.ndarray], batch_size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, batch_size):
                some = batch.slice(at, batch_size)
                made = embed(some.column(0).to_pylist())
                if len(made) != some.num_rows:
                    raise ValueError(f"{len(made)} vectors for {some.num_rows} texts")
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array([[float(x) for x in v] for v in made], pa.list_(pa.float64()))], [*some.schema.names, "embedding"])

    return run


def embedded(texts: DataFrame, text_col: str, embed: Callable[[list[str]], np.ndarray], batch_size: int = 32) -> DataFrame:
    """Adds embedding (array of double), what ``embed`` makes of at most ``batch_size`` texts at a time; another number of vectors than texts is an error.  Null texts are empty."""
    own = [c for c in texts.columns if c not in (text_col, "embedding")]
    given = texts.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias(text_col), *own)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema] + ["embedding array<double>"])
    return given.mapInArrow(_pass(embed, batch_size), schema)


def embed_chunks(chunks: DataFrame, detections: DataFrame, embed: Callable[[list[str]], np.ndarray], batch_size: int = 32) -> tuple[DataFrame, DataFrame]:
    """Chunks with vectors and countries, and (document_id, status, chunks): a document with another number of detections than chunks fails and has no rows.

    chunks: (document_id, chunk_index, chunk_text, ...); detections: (document_id, chunk_index,
    countries, error).  Blank chunks are left out and keep their number; a chunk whose detection failed
    has no countries.
    """
    n = chunks.groupBy("document_id").agg(F.count("*").alias("n"))
    m = detections.groupBy("document_id").agg(F.count("*").alias("m"))
    counts = kept(n.join(m, "document_id", "left").select("document_id", F.when(F.col("n") == F.coalesce("m", F.lit(0)), "COMPLETED").otherwise("FAILED").alias("status")), "counts")
    good = chunks.join(counts.where("status = 'COMPLETED'"), "document_id", "left_semi").where(F.regexp_like(F.coalesce("chunk_text", F.lit("")), F.lit(r"\S")))
    none = F.array().cast("array<string>")
    found = detections.select("document_id", "chunk_index", F.when(F.col("error").isNull(), F.coalesce("countries", none)).otherwise(none).alias("countries"))
    rows = embedded(good.join(found, ["document_id", "chunk_index"], "left").withColumn("countries", F.coalesce("countries", none)), "chunk_text", embed, batch_size)
    made = good.groupBy("document_id").agg(F.count("*").alias("chunks"))
    return rows, counts.join(made, "document_id", "left").select("document_id", "status", F.coalesce("chunks", F.lit(0)).alias("chunks"))
