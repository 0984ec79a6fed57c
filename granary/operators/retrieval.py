"""Retrieval: exact vector top-k, BM25 and rank fusion, each with an optional filter inside the search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.operators.store import kept

TOKEN = r"[\p{L}\p{N}]+"


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; null if either vector is zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def usable(vector: Column) -> Column:
    """Whether a vector is there, holds no null and nothing infinite or undefined, and isn't all zeros."""
    fine = F.forall(vector, lambda c: F.coalesce(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")), F.lit(False)))
    return F.coalesce(fine & F.exists(vector, lambda c: c != 0), F.lit(False))


def vector_topk(rows: DataFrame, query: list[float], k: int, id_col: str, vec_col: str, keep: Column | None = None, digits: int = 6) -> DataFrame:
    """The k rows nearest to one query by cosine: (id, score); ties to the smaller id.

    A top-k node: each task keeps k rows, no full sort and no shuffle of vectors.  Vectors that are
    null, zero, of another length or not finite take no part; they are scaled before they are squared,
    so that large components don't overflow.
    """
    if keep is not None:
        rows = rows.where(keep)
    top = max((abs(x) for x in query), default=0.0)
    if not (0 < top < float("inf")):
        return rows.select(id_col, F.lit(0.0).alias("score")).limit(0)
    q = F.array(*[F.lit(float(x) / top) for x in query])
    rows = rows.where(usable(F.col(vec_col)) & (F.size(vec_col) == len(query)))
    most = F.array_max(F.transform(vec_col, lambda c: F.abs(c.cast("double"))))
    scaled = F.transform(vec_col, lambda c: c.cast("double") / most)
    scored = rows.select(id_col, F.round(cosine(scaled, q), digits).alias("score")).where("score IS NOT NULL")
    return scored.orderBy(F.desc("score"), id_col).limit(k)


def overlaps(column: str, wanted: list[str] | None) -> Column | None:
    """Array membership filter: any of the wanted values; no filter for none."""
    return F.arrays_overlap(F.col(column), F.array(*[F.lit(w) for w in wanted])) if wanted else None


_FOUND = "query_id long, id long, score double"
QUERIES_AT_ONCE = 4096  # queries that a task holds while rows pass by
ROWS_AT_ONCE = 100_000  # rows that pass by in one task


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that nothing overflows."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    return _unit(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1))


def _scan(k: int, digits: int):
    """Sorted (dim, qb, rb, what, id, v, labels): of each block the queries (what 0), then the rows -> each query's k best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, qid, q, wanted, best_s, best_i = None, [], [], [], None, None

        def told() -> pa.RecordBatch:
            ok = np.isfinite(best_s)
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(qid, ok.sum(1))), pa.array(best_i[ok]), pa.array(best_s[ok])], ["query_id", "id", "score"])

        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)], 1)
            cuts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1))).tolist() if len(keys) else []
            for a, b in zip(cuts, [*cuts[1:], len(keys)], strict=True):
                if block != tuple(keys[a, :3]):
                    if best_s is not None:
                        yield told()
                    block, qid, q, wanted, best_s, best_i = tuple(keys[a, :3]), [], [], [], None, None
                part = batch.slice(a, b - a)
                if keys[a, 3] == 0:
                    qid.append(part.column(4).to_numpy(zero_copy_only=False))
                    q.append(_matrix(part.column(5)))
                    wanted += [set(w or ()) for w in part.column(6).to_pylist()]
                    continue
                if isinstance(qid, list):
                    if not qid:
                        continue
                    qid, q = np.concatenate(qid), np.concatenate(q)
                    best_s, best_i = np.full((len(qid), 0), -np.inf), np.zeros((len(qid), 0), np.int64)
                for at in range(0, part.num_rows, 1024):
                    some = part.slice(at, 1024)
                    ids = some.column(4).to_numpy(zero_copy_only=False)
                    s = np.round(q @ _matrix(some.column(5)).T, digits)
                    s[qid[:, None] == ids[None, :]] = -np.inf
                    if any(wanted):
                        labels = [set(v or ()) for v in some.column(6).to_pylist()]
                        for r, w in enumerate(wanted):
                            if w:
                                s[r, [w.isdisjoint(v) for v in labels]] = -np.inf
                    best_s, best_i = np.concatenate([best_s, s], 1), np.concatenate([best_i, np.broadcast_to(ids, s.shape)], 1)
                    order = np.lexsort((best_i, -best_s), axis=1)[:, :k]
                    best_s, best_i = np.take_along_axis(best_s, order, 1), np.take_along_axis(best_i, order, 1)
        if best_s is not None:
            yield told()

    return run


def vector_topk_each(rows: DataFrame, queries: DataFrame, k: int, id_col: str, vec_col: str, digits: int = 6, label_col: str | None = None, wanted_col: str | None = None, at_once: int = QUERIES_AT_ONCE) -> DataFrame:
    """Every query's k nearest rows by cosine, but itself: (query_id, rank, id, score); ties to the smaller id.

    With ``label_col`` (an array of the rows) and ``wanted_col`` (an array of the queries) only rows
    with one of a query's wanted labels count; a query that wants none is not filtered.  Exact: blocks
    of ROWS_AT_ONCE rows meet blocks of ``at_once`` queries, each pair in a task of its own, through
    one shuffle; a task holds its queries and their k best while its rows pass by, and sends k rows a
    query on.  Vectors that are null, zero or not finite are near nothing, those of different lengths
    don't meet; rows without an id take no part.
    """
    filtered = label_col is not None and wanted_col is not None
    labels = lambda c: F.col(c).cast("array<string>") if filtered else F.lit(None).cast("array<string>")
    fine = usable(F.col(vec_col)) & F.col(id_col).isNotNull()
    given = lambda df, c: df.where(fine).select(F.size(vec_col).alias("dim"), F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), labels(c).alias("labels"))
    rows, queries = given(rows, label_col), given(queries, wanted_col)
    q_blocks, r_blocks = max(1, -(-queries.count() // at_once)), max(1, -(-rows.count() // ROWS_AT_ONCE))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cols = ["dim", "qb", "rb", "what", "id", "v", "labels"]
    asked = queries.withColumns({"qb": block(q_blocks), "what": F.lit(0)}).withColumn("rb", every(r_blocks)).select(cols)
    offered = rows.withColumns({"rb": block(r_blocks), "what": F.lit(1)}).withColumn("qb", every(q_blocks)).select(cols)
    keys = ["dim", "qb", "rb"]
    met = asked.union(offered).repartition(*keys).sortWithinPartitions(*keys, "what")
    top = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    found = met.mapInArrow(_scan(k, digits), _FOUND)
    return found.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def bm25_stats(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(term, df), (id, term, tf, len) and one row (n, avg_len): what BM25 needs of the corpus."""
    words = docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("ts"))
    lens = words.select(F.coalesce(F.size("ts"), F.lit(0)).alias("len"))
    corpus = lens.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
    postings = words.select("id", F.size("ts").alias("len"), F.explode("ts").alias("term")).groupBy("id", "len", "term").agg(F.count("*").alias("tf"))
    return postings.groupBy("term").agg(F.count("*").alias("df")), postings, corpus


TERMS_SENT = 1_000_000  # query terms that may be broadcast
_END = "\u0000"  # a term that no text has: one stands for each document


def bm25_topk(docs: DataFrame, queries: DataFrame, k: int, id_col: str, text_col: str, query_id: str, query_text: str, k1: float = 1.2, b: float = 0.75, digits: int = 6, label_col: str | None = None, wanted_col: str | None = None, least: float | None = None) -> DataFrame:
    """Each query's k best documents: (query_id, rank, id, score).

    With ``label_col`` (an array of the documents) and ``wanted_col`` (an array of the queries) only
    documents with one of a query's wanted labels are found; a query that wants none is not filtered,
    and statistics are always the whole corpus's.  ``least`` leaves out lower scores.  Texts are cut
    into terms once: only terms of some query, and one row for each document's length, are kept and
    stored.  Queries without words find nothing.
    """
    filtered = label_col is not None and wanted_col is not None
    asked = queries.select(F.col(query_id).alias("query_id"), *([F.col(wanted_col).alias("wanted")] if filtered else []), F.explode(F.array_distinct(tokens(F.col(query_text)))).alias("term"))
    terms = kept(asked.select("term").distinct().union(docs.sparkSession.createDataFrame([(_END,)], "term string")), "terms")
    if terms.count() <= TERMS_SENT:
        terms = F.broadcast(terms)
    labels = [F.col(label_col).alias("labels")] if filtered else []
    words = docs.select(F.col(id_col).alias("id"), *labels, F.coalesce(tokens(F.col(text_col)), F.array().cast("array<string>")).alias("ts"))
    hits = words.select("id", *(["labels"] if filtered else []), F.size("ts").alias("len"), F.explode(F.concat("ts", F.array(F.lit(_END)))).alias("term")).join(terms, "term", "left_semi")
    tf = kept(hits.groupBy("id", *(["labels"] if filtered else []), "len", "term").agg(F.count("*").alias("tf")), "postings")
    n, avg_len = tf.where(F.col("term") == _END).agg(F.coalesce(F.sum("tf"), F.lit(0)), F.avg("len")).first()  # two numbers
    tf = tf.where(F.col("term") != _END)
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = df.select("term", F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    weight = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.lit(avg_len or 1.0)))
    met = tf.join(idf, "term").select("id", *(["labels"] if filtered else []), "term", weight.alias("w")).join(asked, "term")
    if filtered:
        met = met.where((F.coalesce(F.size("wanted"), F.lit(0)) == 0) | F.arrays_overlap("labels", "wanted"))
    scored = met.groupBy("query_id", "id").agg(F.round(F.sum("w"), digits).alias("score"))
    if least is not None:
        scored = scored.where(F.col("score") >= least)
    top = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def hybrid(rows: DataFrame, queries: DataFrame, k: int, id_col: str, text_col: str, vec_col: str, weights: tuple[float, float] = (1.0, 1.0), label_col: str | None = None, wanted_col: str | None = None) -> DataFrame:
    """Each query's k best rows by both searches: (query_id, rank, id, score), vector and words each limited to k, fused by weighted ranks.

    Queries have the rows' columns; both searches look for rows of the same table, with the same
    filter.  A query whose text is blank finds nothing on either side.
    """
    asked = queries.where(F.regexp_like(F.col(text_col), F.lit(r"\S")))
    near = vector_topk_each(rows, asked, k, id_col, vec_col, label_col=label_col, wanted_col=wanted_col)
    words = bm25_topk(rows, asked, k, id_col, text_col, id_col, text_col, label_col=label_col, wanted_col=wanted_col)
    return rank_fusion([(near, weights[0]), (words, weights[1])], k)


def rank_fusion(lists: list[tuple[DataFrame, float]], k: int, constant: int = 60, digits: int = 9) -> DataFrame:
    """Weighted reciprocal ranks summed over ranked lists (query_id, rank, id): (query_id, rank, id, score); what a list lacks counts nothing."""
    parts = [df.select("query_id", "id", (F.lit(float(w)) / (constant + F.col("rank"))).alias("s")) for df, w in lists]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    fused = both.groupBy("query_id", "id").agg(F.round(F.sum("s"), digits).alias("score"))
    top = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return fused.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
