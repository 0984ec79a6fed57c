"""Token counts under a unigram model by dynamic programming shared over a trie.

The distinct pre-tokens of the documents that a worker meets go into a trie, which it keeps from
batch to batch and task to task.  Each node holds its forward score, the best sum of piece scores over
the ways to cut the path up to it, computed once when the node is made, however many pre-tokens share
the prefix; the ends of pre-tokens also store how many pieces the best cut has.  The documents'
counts are then sums of the stored terminal counts.  A trie of over NODES nodes is started anew: that
bounds a worker's memory and costs time only.

All work stays in one Arrow pass, without a shuffle.

The model is a vocabulary of pieces with scores, log probabilities by rank (Zipf's law over the
vocabulary's own order).  A character that no piece covers falls back to one piece per byte.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.bpe import chunks

SPACE = "▁"
NODES = 1_000_000
#: Score of one fallback byte: below every piece's.
_BYTE = -30.0
_GAP = re.compile(r"[\x20\x09-\x0D]+")


def rank_scores(pieces: list[str]) -> dict[str, float]:
    """Log probabilities by rank for pieces in falling order of frequency."""
    norm = math.log(sum(1 / (r + 1) for r in range(len(pieces))))
    return {p: -math.log(r + 1) - norm for r, p in reversed(list(enumerate(pieces)))}


def load_pieces(path: str) -> list[str]:
    """Pieces of a sentencepiece model file in its order, without control and byte pieces."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return [m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]


class Trie:
    """Forward scores at the nodes, piece counts at the ends of the pre-tokens put in."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self._start()

    def _start(self) -> None:
        self.child: dict[int, int] = {}  # node << 21 | character -> node
        self.best, self.pieces = [0.0], [0]  # by node; 0 is the root
        self.ends: dict[str, int] = {}  # terminal counts

    def insert(self, words: list[str]) -> None:
        """Put in words; in sorted order a word starts from the node where it leaves the one before."""
        scores, longest, child, best, pieces = self.scores, self.longest, self.child, self.best, self.pieces
        path, last = [0], ""
        for w in words:
            n = min(len(w), len(last))
            d = 0
            while d < n and w[d] == last[d]:
                d += 1
            del path[d + 1 :]
            node = path[-1]
            for end in range(d + 1, len(w) + 1):
                key = node << 21 | ord(w[end - 1])
                node = child.get(key)
                if node is None:
                    width = len(w[end - 1].encode("utf-8", "surrogatepass"))
                    before = path[-1]
                    top, k = best[before] + _BYTE * width, pieces[before] + width
                    for start in range(max(0, end - longest), end):
                        s = scores.get(w[start:end])
                        if s is not None:
                            s += best[path[start]]
                            c = pieces[path[start]] + 1
                            if s > top or s == top and c < k:
                                top, k = s, c
                    node = child[key] = len(best)
                    best.append(top)
                    pieces.append(k)
                path.append(node)
            self.ends[w] = pieces[path[-1]]
            last = w

    def lookup(self, words: list[str]) -> np.ndarray:
        """Counts of all words, new ones inserted first."""
        if len(self.best) > NODES:
            self._start()
        self.insert(sorted(set(words).difference(self.ends)))
        return np.fromiter(map(self.ends.__getitem__, words), np.int64, len(words))


def pre_tokens(text: str) -> list[str]:
    """Words of a text (runs of anything but ASCII white space), each with a space mark before it."""
    return [SPACE + w for w in _GAP.split(text) if w]


_tries: dict[str, Trie] = {}


def _count(name: str, spec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _tries:
            _tries.clear()
            _tries[name] = Trie(rank_scores(spec.value))
        trie = _tries[name]
        for batch in batches:
            for at, texts in chunks(batch.column(0)):
                words: list[str] = []
                ends = [0]
                for t in texts:
                    words += pre_tokens(t)
                    ends.append(len(words))
                total = np.concatenate([[0], np.cumsum(trie.lookup(words))])[ends]
                own = [c.slice(at, len(texts)) for c in batch.columns[1:]]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.diff(ends), pa.int64()), pa.array(np.diff(total), pa.int64())], [*batch.schema.names[1:], "n_words", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, pieces: list[str]) -> DataFrame:
    """Adds n_words and n_tokens (pieces of the best cut of each word, summed) to every document.

    Takes a column text, which isn't returned; other columns stay, but n_words and n_tokens are
    replaced.  Null, empty and blank texts have 0 of both.  Rows repeat freely; no rows in, none out.
    """
    own = [c for c in docs.columns if c not in ("text", "n_words", "n_tokens")]
    given = docs.select(F.col("text").cast("string").alias("text"), *[F.col(f"`{c}`") for c in own])
    spec = docs.sparkSession.sparkContext.broadcast(list(pieces))
    name = hashlib.sha256("\0".join(pieces).encode("utf-8", "surrogatepass")).hexdigest()
    return given.mapInArrow(_count(name, spec), ", ".join([*(f"`{c}` {given.schema[c].dataType.simpleString()}" for c in own), "n_words long, n_tokens long"]))


def op7_token_counts(spark, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """Words and unigram tokens of every whole document."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("piece_bpe_32k.model")
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), load_pieces(vocabulary))


QUERIES = {"op7_token_counts": op7_token_counts}
#: A dynamic programme over each word: tested against a plain one.
SQL: dict[str, str] = {}
