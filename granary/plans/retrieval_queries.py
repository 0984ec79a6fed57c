"""Retrieval over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import retrieval as r
from granary.operators.store import shared_folder
from granary.operators.text_index import TextIndex
from granary.operators.vector_index import VectorIndex


def _table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _query_vector(rows):
    return list(rows.orderBy("vec_id").select("embedding").first()[0])


def vector_topk(spark, d):
    rows = _table(spark, d, "embeddings")
    return r.vector_topk(rows, _query_vector(rows), 10, "vec_id", "embedding")


def vector_topk_filtered(spark, d):
    """Every twentieth vector against all rows with its own label or the next."""
    rows = _table(spark, d, "embeddings").withColumn("labels", F.array(F.col("label").cast("string"), F.concat(F.lit("odd"), (F.col("label") % 2).cast("string"))))
    asked = rows.where("vec_id % 20 = 0").withColumn("wanted", F.when(F.col("vec_id") % 60 == 0, F.array().cast("array<string>")).otherwise(F.array(F.col("label").cast("string"), (F.col("label") + 1).cast("string"))))
    return r.vector_topk_each(rows, asked, 10, "vec_id", "embedding", label_col="labels", wanted_col="wanted").withColumnRenamed("id", "vec_id")


def vector_topk_each(spark, d):
    rows = _table(spark, d, "embeddings")
    return r.vector_topk_each(rows, rows.where("vec_id % 20 = 0"), 10, "vec_id", "embedding").withColumnRenamed("id", "vec_id")


def bm25_stats(spark, d):
    df, _, corpus = r.bm25_stats(_table(spark, d, "documents"), "doc_id", "text")
    n, avg_len = corpus.first()
    return df.select("term", "df", F.lit(n).alias("n"), F.round(F.lit(avg_len), 6).alias("avg_len"))


def bm25_topk(spark, d):
    return r.bm25_topk(_table(spark, d, "documents"), _table(spark, d, "benchmark"), 10, "doc_id", "text", "item_id", "text").withColumnsRenamed({"id": "doc_id", "query_id": "item_id"})


_LABELS = "array(lang, coalesce(source, 'none'))"


def bm25_filtered(spark, d):
    """Benchmark items against the documents of one or two languages, or all; low scores are left out."""
    docs = _table(spark, d, "documents").withColumn("labels", F.expr(_LABELS))
    items = _table(spark, d, "benchmark").withColumn("wanted", F.expr("CASE item_id % 3 WHEN 0 THEN array('en') WHEN 1 THEN array('de', 'fr') ELSE CAST(array() AS array<string>) END"))
    found = r.bm25_topk(docs, items, 10, "doc_id", "text", "item_id", "text", label_col="labels", wanted_col="wanted", least=5.0)
    return found.withColumnsRenamed({"id": "doc_id", "query_id": "item_id"})


def hybrid_rank_fusion(spark, d):
    """All documents, some with the vector of their number, searched by benchmark items with theirs; every second item wants one language."""
    rows, v = _table(spark, d, "documents").withColumn("labels", F.expr(_LABELS)), _table(spark, d, "embeddings")
    rows = rows.join(v.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")
    items = _table(spark, d, "benchmark").join(v.withColumnRenamed("vec_id", "item_id"), "item_id")
    wanted = F.expr("CASE WHEN item_id % 2 = 0 THEN array('en') ELSE CAST(array() AS array<string>) END")
    asked = items.select((-1 - F.col("item_id")).alias("doc_id"), F.when(F.col("item_id") % 10 == 9, " ").otherwise(F.col("text")).alias("text"), "embedding", wanted.alias("wanted"))
    found = r.hybrid(rows, asked, 10, "doc_id", "text", "embedding", (0.7, 0.3), "labels", "wanted")
    return found.select((-1 - F.col("query_id")).alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


def text_index_topk(spark, d):
    """A kept index of all documents, a tenth of them replaced and some deleted since, searched by benchmark items."""
    docs = _table(spark, d, "documents")
    index = TextIndex(spark, shared_folder(spark, "text-index")).build(docs, "doc_id", "text")
    index.replace(docs.where("doc_id % 10 = 3").select("doc_id", F.concat_ws(" ", "source", "lang", "text").alias("text")), "doc_id", "text")
    index.delete(docs.where("doc_id % 17 = 5").select("doc_id"), "doc_id")
    found = index.topk(_table(spark, d, "benchmark"), 10, "item_id", "text")
    return found.withColumnsRenamed({"id": "doc_id", "query_id": "item_id"})


SHARE = 0.7  # of the rows that a query may meet: the given vectors lie evenly, and this gives a recall of 0.9


def vector_index_topk(spark, d):
    """A kept index of all vectors, every twentieth searched in its nearest cells; approximate, with exact scores."""
    rows = _table(spark, d, "embeddings")
    index = VectorIndex(spark, shared_folder(spark, "vector-index")).build(rows, "vec_id", "embedding", cells=32)
    found = index.topk(rows.where("vec_id % 20 = 0"), 10, "vec_id", "embedding", candidates=max(100, int(SHARE * rows.count())))
    return found.withColumnRenamed("id", "vec_id")


QUERIES = {f.__name__: f for f in (vector_index_topk, text_index_topk, vector_topk, vector_topk_filtered, vector_topk_each, bm25_stats, bm25_topk, bm25_filtered, hybrid_rank_fusion)}

_DOT = "round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6)"


def _bm25(docs: str, queries: str, keep: str = "true", least: float = -1) -> str:
    return rf"""
q AS (SELECT item_id, wanted, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+'))) AS term FROM ({queries}) AS asked),
w AS (SELECT doc_id, labels, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS ts FROM ({docs}) AS docs),
c AS (SELECT count(*) AS n, avg(len(ts)) AS avg_len FROM w),
p AS (SELECT doc_id, labels, len, term, count(*) AS tf FROM (SELECT doc_id, labels, len(ts) AS len, unnest(ts) AS term FROM w) SEMI JOIN q USING (term) GROUP BY ALL),
i AS (SELECT term, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM p, c GROUP BY term),
s AS (SELECT item_id, doc_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / avg_len))), 6) AS score FROM p JOIN i USING (term) JOIN q USING (term), c WHERE {keep} GROUP BY ALL HAVING score >= {least}),
b AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s QUALIFY rank <= 10)"""


_DOCS = "SELECT doc_id, text, [lang, coalesce(source, 'none')] AS labels FROM documents"
_PLAIN = _bm25(_DOCS, "SELECT item_id, text, [] AS wanted FROM benchmark")
_WANTED = "len(wanted) = 0 OR list_has_any(labels, wanted)"
_SOME = _bm25(_DOCS, "SELECT item_id, text, CASE item_id % 3 WHEN 0 THEN ['en'] WHEN 1 THEN ['de', 'fr'] ELSE [] END AS wanted FROM benchmark", _WANTED, 5)
_ITEMS = "SELECT item_id, CASE WHEN item_id % 10 = 9 THEN ' ' ELSE text END AS text, embedding, CASE WHEN item_id % 2 = 0 THEN ['en'] ELSE [] END AS wanted FROM benchmark JOIN embeddings ON vec_id = item_id"
_WITH = "SELECT doc_id, text, [lang, coalesce(source, 'none')] AS labels, embedding FROM documents LEFT JOIN embeddings ON vec_id = doc_id"
_NEAR = f"SELECT q.vec_id AS query_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DOT} DESC, e.vec_id) AS rank, e.vec_id, {_DOT} AS score FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id"
_CHANGED = "SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN concat_ws(' ', source, lang, text) ELSE text END AS text, [] AS labels FROM documents WHERE doc_id % 17 <> 5"
SQL = {
    "vector_topk": f"SELECT e.vec_id, {_DOT} AS score FROM embeddings e, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) q ORDER BY score DESC, e.vec_id LIMIT 10",
    "vector_topk_filtered": f"{_NEAR} WHERE q.vec_id % 20 = 0 AND (q.vec_id % 60 = 0 OR e.label IN (q.label, q.label + 1)) QUALIFY rank <= 10",
    "vector_topk_each": f"{_NEAR} WHERE q.vec_id % 20 = 0 QUALIFY rank <= 10",
    "bm25_stats": r"WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ts FROM documents), c AS (SELECT count(*) AS n, avg(len(ts)) AS a FROM w), p AS (SELECT DISTINCT doc_id, unnest(ts) AS term FROM w) SELECT term, count(*) AS df, any_value(n) AS n, round(any_value(a), 6) AS avg_len FROM p, c GROUP BY term",
    "bm25_topk": f"WITH {_PLAIN} SELECT * FROM b",
    "text_index_topk": f"WITH {_bm25(_CHANGED, 'SELECT item_id, text, [] AS wanted FROM benchmark')} SELECT * FROM b",
    "bm25_filtered": f"WITH {_SOME} SELECT * FROM b",
    "hybrid_rank_fusion": f"WITH k AS ({_ITEMS}), t AS ({_WITH}), {_bm25('SELECT * FROM t', 'SELECT item_id, text, wanted FROM k', _WANTED)}, v AS (SELECT q.item_id, row_number() OVER (PARTITION BY q.item_id ORDER BY {_DOT} DESC, e.doc_id) AS rank, e.doc_id FROM k q JOIN t e ON (len(q.wanted) = 0 OR list_has_any(e.labels, q.wanted)) AND trim(q.text) <> '' AND e.embedding IS NOT NULL QUALIFY rank <= 10), u AS (SELECT item_id, doc_id, 0.7::DOUBLE / (60 + rank) AS s FROM v UNION ALL SELECT item_id, doc_id, 0.3::DOUBLE / (60 + rank) FROM b), f AS (SELECT item_id, doc_id, round(sum(s), 9) AS score FROM u GROUP BY ALL) SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM f QUALIFY rank <= 10",
}
