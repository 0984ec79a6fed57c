"""Document quality by positive-unlabelled learning with the non-negative risk.

(Kiryo et al., "Positive-Unlabeled Learning with Non-Negative Risk Estimator", 2017.)  The trusted
positives are documents labelled good; the unlabelled set is web text as it comes.  With the class
prior p the risk of a classifier is p R_P(+) + max(0, R_U(-) - p R_P(-)): the second term
estimates the risk on negatives without any, and is kept from going below zero.  The prior is
estimated from the positives and the unlabelled alone; labels of bad documents are never used.

Features are computed on executors from whole texts, and describe form alone: shares of character
classes, case, symbols at word ends, repetition of words, pairs and lines, lengths.  Two bounded
samples (SAMPLE rows each, chosen by a hash of doc_id) are fitted on the driver: at most 2 * SAMPLE
rows of a few dozen numbers, whatever the size of the corpus.  Scoring is one pass without a shuffle.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.shared import give_back

#: Most rows of either sample that the fit sees.
SAMPLE = 6_000
GOOD = 0.7

_CLASSES = ["lower", "upper", "other_letter", "digit", "blank", "newline", "stop", "comma", "exclaim", "quote", "symbol", "bar", "control", "other"]


def _class_table() -> np.ndarray:
    at = {c: i for i, c in enumerate(_CLASSES)}
    out = np.full(1 << 16, at["other"], np.uint8)
    kinds = {"Ll": "lower", "Lu": "upper", "Lt": "upper", "Nd": "digit", "Zs": "blank", "Cc": "control", "Sm": "symbol", "Sc": "symbol", "Sk": "symbol", "So": "symbol", "Po": "symbol"}
    for c in range(1 << 16):
        k = unicodedata.category(chr(c))
        out[c] = at[kinds.get(k, "other_letter" if k[0] in "LM" else "quote" if k[0] == "P" else "other")]
    for text, name in ((".?…", "stop"), (",;:", "comma"), ("!", "exclaim"), ("'\"’‘“”«»", "quote"), ("|", "bar"), ("\t", "blank"), ("\n", "newline")):
        for c in text:
            out[ord(c)] = at[name]
    return out


_TABLE = _class_table()
_LETTERS, _UPPER, _BLANK, _NEWLINE = 3, 1, _CLASSES.index("blank"), _CLASSES.index("newline")
_ODD = np.uint64(0x9E3779B97F4A7C15)
N_FEATURES = 3 * len(_CLASSES) + 15


def features(text: str | None) -> np.ndarray:
    """Form of a whole text as N_FEATURES numbers; zeros for null and empty ones."""
    out = np.zeros(N_FEATURES)
    if not text:
        return out
    k = len(_CLASSES)
    kind = _TABLE[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), (1 << 16) - 1)]
    n = len(kind)
    counts = np.bincount(kind, minlength=k)
    out[:k] = counts / n
    gap = (kind == _BLANK) | (kind == _NEWLINE)
    word = np.flatnonzero(np.diff(gap, prepend=True) & ~gap)
    end = np.flatnonzero(np.diff(gap, append=True) & ~gap)
    words = text.split()
    m = max(1, len(words))
    if len(word):
        out[k : 2 * k] = np.bincount(kind[word], minlength=k) / len(word)
        out[2 * k : 3 * k] = np.bincount(kind[end], minlength=k) / len(word)
    letters = max(1, counts[:_LETTERS].sum())
    lines = [x for x in text.split("\n") if x]
    nl = max(1, len(lines))
    # words by their hashes: no copies of them, however long the text
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    distinct, pairs = len(np.unique(h)), len(np.unique(h[:-1] * _ODD + h[1:]))
    short = np.array([len(w) for w in words] or [0])
    out[3 * k :] = [
        np.log1p(n) / 10,
        np.log1p(m) / 10,
        n / m / 10,
        short.std() / 10,
        short.max() / 100,
        counts[_UPPER] / letters,
        sum(map(str.isupper, words)) / m,
        (h[1:] == h[:-1]).sum() / m,
        distinct / m,
        pairs / max(1, len(words) - 1),
        np.log1p(distinct) / 10,
        len(set(lines)) / nl,
        np.log1p(n / nl) / 10,
        1 - letters / n,
        np.log1p(m / nl) / 10,
    ]
    return out


class Model:
    """Standardised features, one hidden layer of tanh units, a logistic output."""

    def __init__(self, parts: list[np.ndarray]):
        self.parts = parts

    def score(self, x: np.ndarray) -> np.ndarray:
        mean, sd, w1, b1, w2, b2 = self.parts
        h = np.tanh(np.clip((x - mean) / sd, -8, 8) @ w1 + b1)
        return 1 / (1 + np.exp(-np.clip(h @ w2 + b2, -30, 30)))


def fit(pos: np.ndarray, unl: np.ndarray, prior: float, hidden: int = 12, steps: int = 500, rate: float = 0.02, decay: float = 1e-4, seed: int = 7) -> Model:
    """Minimise the non-negative unbiased risk with the logistic loss by full-batch Adam.

    Where the negatives' risk is estimated below zero, the step goes the other way on that term, as
    the method's authors do, instead of fitting positives among the unlabelled as negatives.
    """
    rng = np.random.default_rng(seed)
    both = np.concatenate([pos, unl])
    mean, sd = both.mean(0), both.std(0) + 1e-3
    p, u = (np.clip((x - mean) / sd, -8, 8) for x in (pos, unl))
    w = [rng.normal(0, 1 / np.sqrt(p.shape[1]), (p.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.array(np.log(prior / (1 - prior)))]
    m, v = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
    for t in range(1, steps + 1):
        for i, g in enumerate(gradients(w, p, u, prior)):
            g = g + decay * w[i] * (i in (0, 2))
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            w[i] = w[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return Model([mean, sd, w[0], w[1], w[2], w[3]])


def _out(w: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = np.tanh(x @ w[0] + w[1])
    return h, 1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -30, 30)))


def risks(w: list[np.ndarray], p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float]:
    """(prior * R_P(+), R_U(-) - prior * R_P(-)) with the logistic loss: the positives' risk, and the negatives' as it is estimated without any."""
    sp, su = _out(w, p)[1], _out(w, u)[1]
    low = lambda s: -np.log1p(-np.clip(s, 0, 1 - 1e-9)).mean()
    return -prior * np.log(np.clip(sp, 1e-9, 1)).mean(), low(su) - prior * low(sp)


def gradients(w: list[np.ndarray], p: np.ndarray, u: np.ndarray, prior: float) -> list[np.ndarray]:
    """Of the risk; where the negatives' risk is below zero, of that term alone and against it."""
    (hp, sp), (hu, su) = _out(w, p), _out(w, u)
    below = risks(w, p, u, prior)[1]
    sign = 1.0 if below >= 0 else -1.0
    good = prior * (sp - 1) / len(p) * (below >= 0)

    def back(x, h, slope):
        """Gradients for the sum of slope * output."""
        d = np.outer(slope, w[2]) * (1 - h * h)
        return [x.T @ d, d.sum(0), h.T @ slope, slope.sum()]

    return [a + b for a, b in zip(back(p, hp, good - sign * prior * sp / len(p)), back(u, hu, sign * su / len(u)), strict=True)]


LEAST = 8  # rows of either sample without which the prior is taken as one half
TAIL = 0.5  # least share of the positives in a tail that the prior is read from; smaller tails are noisy


def estimated_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """The share of positives among the unlabelled, from both samples alone.

    Of any tail of scores the unlabelled hold at least the prior times the positives' share of it, so
    the least ratio of tails, over scores that tell the two apart, is close above the prior.  Scores come
    from a fit to the other half of the rows, and tails of under TAIL of the positives don't count.
    """
    if min(len(pos), len(unl)) < LEAST:
        return 0.5
    halves = [(pos[i::2], unl[i::2]) for i in (0, 1)]
    models = [fit(p, u, 0.5, steps=200) for p, u in halves]
    p = np.concatenate([models[1 - i].score(halves[i][0]) for i in (0, 1)])
    u = np.concatenate([models[1 - i].score(halves[i][1]) for i in (0, 1)])
    cuts = np.quantile(p, np.linspace(0, 1 - TAIL, 60))
    return float(np.clip(min(((u >= t).mean() + 1 / len(u)) / (p >= t).mean() for t in cuts), 0.02, 0.98))


def fold(doc_id) -> F.Column:
    """crc32 of the doc_id as text, modulo 4; the remainder 2 is held out from learning."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(t.as_py()).tolist() for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.float64()))], ["good", "doc_id", "x"])
    give_back()


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fit on at most ``sample`` good documents and as many unlabelled ones, none of them held out.

    Labels other than 0 and 1 and null ids don't count.  An id that stands over several rows counts
    once, by the least of its texts' features.  None if nothing is labelled good.
    """
    chance = F.xxhash64("doc_id", F.lit(11))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id IS NOT NULL AND quality IN (0, 1)")
    known = known.where(fold(F.col("doc_id")) != 2)
    known = known.where("quality = 1")
    if known.isEmpty():
        return None
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chosen = known.select("doc_id").distinct().orderBy(chance, "doc_id").limit(sample).select("doc_id", F.lit(1).alias("good"))
    web = texts.where(F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 2)).select("doc_id").distinct().orderBy(chance, "doc_id").limit(sample).select("doc_id", F.lit(0).alias("good"))
    rows = texts.join(F.broadcast(chosen.union(web)), "doc_id").select("good", "doc_id", "text").mapInArrow(_feature_rows, "good int, doc_id long, x array<double>")
    # one row for each chosen id, however many rows it has: at most 2 * sample come to the driver
    got = rows.groupBy("good", "doc_id").agg(F.min("x").alias("x")).select("good", "x").toArrow()
    if not got.num_rows:
        return None
    x = got.column("x").combine_chunks().flatten().to_numpy().reshape(got.num_rows, -1)
    is_good = got.column("good").to_numpy() == 1
    order = np.lexsort(x.T[::-1])  # the same fit in whatever order rows arrive
    x, is_good = x[order], is_good[order]
    if is_good.all() or not is_good.any():
        return None
    return fit(x[is_good], x[~is_good], estimated_prior(x[is_good], x[~is_good]))


def _scored(model: Model | None, unknown: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column(0)]).reshape(-1, N_FEATURES)
            s = model.score(x) if model else np.full(len(x), unknown)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(s, pa.float64())], [*batch.schema.names[1:], "score"])
        give_back()

    return run


def classify(docs: DataFrame, labels: DataFrame, good: float = GOOD, sample: int = SAMPLE, unknown: float = 0.5) -> DataFrame:
    """Adds score (0 to 1, higher: better) and predicted (1 from ``good`` up) to every document.

    Takes columns doc_id (long) and text; all columns but those two names stay.  Null and empty
    texts are scored by the features of an empty one.  Without good labels every score is ``unknown``.  Rows
    repeat or lack an id freely; equal texts get equal scores.  No rows in, no rows out.
    """
    own = [c for c in docs.columns if c not in ("score", "predicted")]
    given = docs.select(F.col("text").cast("string").alias("_scored_text"), *[F.col(f"`{c}`") for c in own])
    schema = ", ".join([*(f"`{c}` {given.schema[c].dataType.simpleString()}" for c in own), "score double"])
    scored = given.mapInArrow(_scored(train(docs, labels, sample), unknown), schema)
    return scored.withColumn("predicted", (F.col("score") >= good).cast("int"))


def op5_quality(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents, learnt from the labels that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(docs, labels).select("doc_id", F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "score", "predicted")


QUERIES = {"op5_quality": op5_quality}
#: A fitted model: tested by held-out accuracy.
SQL: dict[str, str] = {}
