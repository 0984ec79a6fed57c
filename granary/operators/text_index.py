"""A word index that is kept: postings as tables, searched by BM25 with blocks skipped, changed document by document.

A folder holds one table of each kind, a part of it for each *generation* (a build, a replacement, a
deletion).  A generation counts once its row in ``summary`` is written, which is done last; what a
failed one left behind is never read, and its number is used again.

* ``postings``: by bucket of the term's hash, blocks of at most BLOCK documents of one term, in order of
  falling frequency and growing length, with the greatest frequency and least length of each block.
  Terms in more than HOT documents are dealt to shards, each with blocks of its own.
* ``frequencies``: by bucket, how the generation changes each term's number of documents.
* ``documents``: each document's length and terms, by which a replaced one is taken out again.
* ``dead``: documents of earlier generations that this one replaces or deletes.
* ``summary``: how the number of documents and of words change.

A search reads the buckets of its terms only.  It scores the first block of each term, takes each
query's k-th best sum as a threshold (whole scores are no less), and then reads the blocks that can
still reach it: a document of a block scores no more than the block's bound and the greatest bounds of
the query's other terms.  Their entries meet the queries in units, (part of the queries, part of the
documents), of bounded size; a task adds a unit's weights up and sends each query's k best on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.operators.retrieval import tokens
from granary.operators.store import kept

BLOCK = 128  # documents in a block
HOT = 100_000  # documents of a term that one task puts in order
BUCKETS = 64
SLOT = 1 << 20  # postings of a bucket that one task cuts into blocks, about
AT_ONCE = 4096  # queries of a unit
UNIT = 1 << 19  # entries of a unit, about
PAIRS = 1 << 21  # pairs of an entry and a query, or sums, that a task holds
SENT = 1_000_000  # terms, blocks or dead documents that may be broadcast
_TABLES = {
    "postings": "term string, shard int, block int, most int, least int, entries array<struct<id long, tf int, len int>>, gen int, bucket int",
    "frequencies": "term string, change long, gen int, bucket int",
    "documents": "id long, len int, terms array<struct<term string, tf int>>, gen int",
    "dead": "id long, of int, gen int",
    "summary": "docs long, words long, gen int",
}
_MARGIN = 1e-5  # more than rounding can change


def _sent(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= SENT else df


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


_COUNTED = "id long, len int, terms array<struct<term string, tf int>>"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, ts) -> each document's length and terms with their frequencies."""
    for batch in batches:
        for s in range(0, batch.num_rows, 256):
            part = batch.slice(s, 256)
            length = part.column(1).value_lengths().to_numpy().astype(np.int64)
            words = part.column(1).flatten().dictionary_encode()
            rows, some = len(length), len(words.dictionary)
            at, tf = np.unique(np.repeat(np.arange(rows), length) * some + words.indices.to_numpy(), return_counts=True)
            row = at // max(some, 1)
            terms = pa.StructArray.from_arrays([words.dictionary.take(pa.array(at - row * some)), pa.array(tf, pa.int32())], ["term", "tf"])
            ends = pa.array(np.searchsorted(row, np.arange(rows + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(length, pa.int32()), pa.ListArray.from_arrays(ends, terms)], ["id", "len", "terms"])


def _cut(block: int, buckets: int):
    """(term, shard, id, tf, len, key) sorted by key, the term's hash -> blocks of at most ``block`` documents."""

    def blocks(t: pa.Table) -> pa.RecordBatch:
        words = t.column("term").combine_chunks().dictionary_encode()
        key, shard, ids, tf, length = (t.column(c).to_numpy() for c in ("key", "shard", "id", "tf", "len"))
        term = words.indices.to_numpy()
        order = np.lexsort((ids, length, -tf, shard, term))
        key, shard, ids, tf, length, term = (x[order] for x in (key, shard, ids, tf, length, term))
        new = np.append(True, (term[1:] != term[:-1]) | (shard[1:] != shard[:-1]))
        place = np.arange(len(ids)) - np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))
        at = np.flatnonzero(place % block == 0)
        entries = pa.StructArray.from_arrays([pa.array(ids), pa.array(tf), pa.array(length)], ["id", "tf", "len"])
        entries = pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)), pa.int32()), entries)
        columns = [words.dictionary.take(pa.array(term[at])), pa.array(shard[at]), pa.array((place[at] // block).astype(np.int32)), pa.array(tf[at]), pa.array(np.minimum.reduceat(length, at)), entries, pa.array(np.mod(key[at], buckets).astype(np.int32))]
        return pa.RecordBatch.from_arrays(columns, ["term", "shard", "block", "most", "least", "entries", "bucket"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < 1 << 17:
                continue
            t = pa.Table.from_batches(held)
            key = t.column("key").to_numpy()
            whole = int(np.searchsorted(key, key[-1]))  # the last key may go on
            if whole:
                yield blocks(t.slice(0, whole))
            held, n = t.slice(whole).to_batches(), len(key) - whole
        if n:
            yield blocks(pa.Table.from_batches(held))

    return run


def _best(q: np.ndarray, ids: np.ndarray, sums: np.ndarray, rounded: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Each query's k best: greatest rounded sum, then smallest id."""
    order = np.lexsort((ids, -rounded, q))
    q, ids, sums, rounded = (x[order] for x in (q, ids, sums, rounded))
    start = np.maximum.accumulate(np.where(np.diff(q, prepend=-1) != 0, np.arange(len(q)), 0))
    keep = np.arange(len(q)) - start < k
    return q[keep], ids[keep], sums[keep], rounded[keep]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """A stream sorted by (unit, what), one table for each."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], 1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and tuple(keys[a]) != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = tuple(keys[a])
    if held:
        yield pa.Table.from_batches(held)


def _added_up(k: int, digits: int):
    """Rows sorted by (unit, what): a unit's queries with their terms' codes (what 0), then documents' weights of these codes (what 1) -> (q, id, s), each query's k best of the unit."""

    def unit(queries: pa.Table, entries: pa.Table) -> Iterator[pa.RecordBatch]:
        names, q = np.unique(queries.column("id").to_numpy(), return_inverse=True)
        code = queries.column("code").to_numpy()
        order = np.argsort(code, kind="stable")
        q, (codes, first, count) = q[order], np.unique(code[order], return_index=True, return_counts=True)
        code, weight, (ids, doc) = entries.column("code").to_numpy(), entries.column("w").to_numpy(), np.unique(entries.column("id").to_numpy(), return_inverse=True)
        at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
        order = np.flatnonzero(codes[at] == code)
        order = order[np.argsort(doc[order], kind="stable")]
        at, weight, doc = at[order], weight[order], doc[order]
        met = np.cumsum(count[at])  # pairs of an entry and a query so far
        held, n, a = [], 0, 0
        while a < len(doc):
            # whole documents, one at least, of about PAIRS pairs and as many sums
            b = min(int(np.searchsorted(met, (met[a - 1] if a else 0) + PAIRS, "right")), int(np.searchsorted(doc, doc[a] + max(1, PAIRS // len(names)))))
            b = max(int(np.searchsorted(doc, doc[b])) if b < len(doc) else b, int(np.searchsorted(doc, doc[a], "right")))
            some, start = count[at[a:b]], doc[a]
            docs = int(doc[b - 1] - start) + 1
            place = np.repeat(first[at[a:b]], some) + np.arange(int(some.sum())) - np.repeat(np.cumsum(some) - some, some)
            sums = np.bincount(q[place] * docs + np.repeat(doc[a:b] - start, some), np.repeat(weight[a:b], some), len(names) * docs).reshape(len(names), docs)
            rounded = np.round(sums, digits)
            least = np.partition(rounded, docs - k, axis=1)[:, docs - k, None] if docs > k else -1.0
            r, d = np.nonzero((sums > 0) & (rounded >= least))
            held.append((r, ids[start + d], sums[r, d], rounded[r, d]))
            n += len(r)
            if n > PAIRS // 4:
                held = [_best(*(np.concatenate(x) for x in zip(*held, strict=True)), k)]
                n = len(held[0][0])
            a = b
        if held:
            r, found, total, _ = _best(*(np.concatenate(x) for x in zip(*held, strict=True)), k)
            yield pa.RecordBatch.from_arrays([pa.array(names[r]), pa.array(found), pa.array(total)], ["q", "id", "s"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = None
        for t in _runs(batches):
            if t.column("what")[0].as_py() == 0:
                queries = t
            elif queries is not None and queries.column("unit")[0] == t.column("unit")[0]:
                yield from unit(queries, t)

    return run


class TextIndex:
    """An index in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    # --- reading

    def generations(self) -> list[int]:
        """Numbers of the generations that count."""
        try:
            found = self.spark.read.parquet(f"{self.path}/summary")
        except Exception as e:  # noqa: BLE001 - Spark has one error class for a missing path
            if "PATH_NOT_FOUND" in str(e):
                return []
            raise
        return sorted(r[0] for r in found.select("gen").distinct().collect())  # a number for each change

    def table(self, name: str, gens: list[int]) -> DataFrame:
        """The parts of one table that count."""
        return self.spark.read.schema(_TABLES[name]).parquet(f"{self.path}/{name}").where(F.col("gen").isin(gens))

    # --- writing

    def build(self, docs: DataFrame, id_col: str, text_col: str) -> "TextIndex":
        """The first generation, of all documents; rows of one id are one document, the greatest text."""
        if self.generations():
            raise ValueError("an index stands here; replace or delete")
        self._write(docs, id_col, text_col, None)
        return self

    def replace(self, docs: DataFrame, id_col: str, text_col: str) -> None:
        """Documents as they are now, in place of those with their ids; new ones are added."""
        self._write(docs, id_col, text_col, docs.select(F.col(id_col).alias("id")))

    def delete(self, ids: DataFrame, id_col: str) -> None:
        """Documents that are gone; unknown ids change nothing."""
        none = ids.select(F.col(id_col).alias("id"), F.lit("").alias("text")).limit(0)
        self._write(none, "id", "text", ids.select(F.col(id_col).alias("id")))

    def _write(self, docs: DataFrame, id_col: str, text_col: str, gone: DataFrame | None) -> None:
        gens = self.generations()
        gen = max(gens, default=-1) + 1
        out = lambda df: df.write.mode("overwrite").option("compression", "zstd")
        put = lambda df, name, *by: (out(df).partitionBy(*by) if by else out(df)).parquet(f"{self.path}/{name}/gen={gen}")
        given = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        twice = kept(given.groupBy("id").count().where("count > 1").select("id"), "twice")
        one = given  # texts are shuffled only where an id repeats
        if not twice.isEmpty():
            twice = _sent(twice)
            one = given.join(twice, "id", "left_anti").union(given.join(twice, "id", "left_semi").groupBy("id").agg(F.max("text").alias("text")))
        words = one.select("id", F.coalesce(tokens(F.col("text")), F.array().cast("array<string>")).alias("ts"))
        put(words.mapInArrow(_counted, _COUNTED), "documents")
        added = self.spark.read.schema(_COUNTED).parquet(f"{self.path}/documents/gen={gen}")
        postings = added.select("id", "len", F.inline("terms"))
        df = kept(postings.groupBy("term").agg(F.count("*").alias("df")), "frequencies")
        hot = df.where(F.col("df") > HOT).select("term", F.ceil(F.col("df") / HOT).cast("int").alias("shards"))
        dealt = postings.join(_sent(hot), "term", "left").withColumn("shard", F.coalesce(F.pmod(F.xxhash64("id"), F.col("shards")).cast("int"), F.lit(0)))
        slots = max(1, -(-(df.agg(F.sum("df")).first()[0] or 0) // (self.buckets * SLOT)))
        placed = dealt.select("term", "shard", "id", "tf", "len").repartition(_bucket(F.col("term"), self.buckets), F.pmod(F.xxhash64("term", "shard"), F.lit(slots)))
        placed = placed.withColumn("key", F.xxhash64("term")).sortWithinPartitions("key")
        put(placed.mapInArrow(_cut(BLOCK, self.buckets), "term string, shard int, block int, most int, least int, entries array<struct<id long, tf int, len int>>, bucket int"), "postings", "bucket")
        change = df.select("term", F.col("df").alias("change"))
        counts = added.agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first()
        if gone is not None and gens:
            ids = _sent(kept(gone.where("id IS NOT NULL").select(F.col("id").cast("long").alias("id")).distinct(), "gone"))
            dead = self.table("dead", gens).select("id", F.col("of").alias("gen"))
            old = kept(self.table("documents", gens).join(ids, "id", "left_semi").join(_sent(dead), ["id", "gen"], "left_anti"), "old")
            put(old.select("id", F.col("gen").alias("of")), "dead")
            lost = old.select(F.explode("terms").alias("t")).groupBy("t.term").agg((-F.count("*")).alias("change"))
            change = change.union(lost).groupBy("term").agg(F.sum("change").alias("change")).where("change != 0")
            less = old.agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first()
        else:
            put(added.select("id", F.lit(gen).alias("of")).limit(0), "dead")
            less = (0, 0)
        put(change.withColumn("bucket", _bucket(F.col("term"), self.buckets)).repartition("bucket"), "frequencies", "bucket")
        put(self.spark.createDataFrame([(counts[0] - less[0], counts[1] - less[1])], "docs long, words long").coalesce(1), "summary")

    # --- searching

    def topk(self, queries: DataFrame, k: int, query_id: str, query_text: str, k1: float = 1.2, b: float = 0.75, digits: int = 6) -> DataFrame:
        """Each query's k best documents by BM25: (query_id, rank, id, score), as ``bm25_topk`` over the documents as they are now."""
        asked, blocks, weighed, idf = self._chosen(queries, k, query_id, query_text, k1, b)
        names = kept(asked.select("query_id").distinct().withColumn("q", F.monotonically_increasing_id()), "names")
        # units of some queries and some documents; a block is counted as a full one
        q_parts, parts = max(1, -(-names.count() // AT_ONCE)), max(1, -(-blocks.count() * BLOCK // UNIT))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
        cols = ["unit", "what", "id", "code", "w"]
        asked = asked.join(_sent(names), asked.query_id.eqNullSafe(names.query_id)).select("q", "term").join(_sent(idf), "term").withColumn("part", every(parts))
        asked = asked.select((part("q", q_parts) * parts + F.col("part")).alias("unit"), F.lit(0).alias("what"), F.col("q").alias("id"), "code", F.lit(0.0).alias("w"))
        entries = weighed(blocks).withColumn("part", every(q_parts)).select((F.col("part") * parts + part("id", parts)).alias("unit"), F.lit(1).alias("what"), "id", "code", "w").select(cols)
        met = asked.union(entries).repartition("unit").sortWithinPartitions("unit", "what")
        found = met.mapInArrow(_added_up(k, digits), "q long, id long, s double").withColumn("score", F.round("s", digits))
        ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
        return ranked.join(_sent(names), "q").select("query_id", "rank", "id", "score")

    def postings_of(self, terms: DataFrame, gens: list[int]) -> DataFrame:
        """The blocks of some terms: only their buckets are read."""
        buckets = [r[0] for r in terms.select(_bucket(F.col("term"), self.buckets)).distinct().collect()]  # at most BUCKETS numbers
        return self.table("postings", gens).where(F.col("bucket").isin(buckets)).join(_sent(terms), "term", "left_semi")

    def _chosen(self, queries: DataFrame, k: int, query_id: str, query_text: str, k1: float, b: float) -> tuple:
        """What a search reads: queries' terms, the blocks that may hold a k-th best, how to weigh them, and the terms' weights and codes."""
        gens = self.generations()
        asked = kept(queries.select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(tokens(F.col(query_text)))).alias("term")), "asked")
        terms = asked.select("term").distinct()
        n, words = self.table("summary", gens).agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
        avg = words / n if n and words else 1.0
        buckets = [r[0] for r in terms.select(_bucket(F.col("term"), self.buckets)).distinct().collect()]
        df = self.table("frequencies", gens).where(F.col("bucket").isin(buckets)).join(_sent(terms), "term", "left_semi").groupBy("term").agg(F.sum("change").alias("df"))
        idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")
        idf = kept(df.where("df > 0").select("term", idf, F.monotonically_increasing_id().alias("code")), "idf")
        weight = lambda tf, length: F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / F.lit(avg)))
        heads = self.postings_of(terms, gens).drop("entries").join(_sent(idf), "term").withColumn("bound", weight(F.col("most"), F.col("least")))
        heads = kept(heads.select("gen", "bucket", "term", "shard", "block", "bound"), "heads")
        most = heads.groupBy("term").agg(F.max("bound").alias("top"))
        met = asked.join(_sent(most), "term")
        rest = met.withColumn("rest", F.sum("top").over(Window.partitionBy("query_id")) - F.col("top"))
        weighed = lambda blocks: self._weighed(blocks, idf, weight, gens)
        first = heads.where("block = 0").select("gen", "bucket", "term", "shard", "block")
        sums = weighed(first).join(_sent(asked), "term").groupBy("query_id", "id").agg(F.sum("w").alias("s"))
        order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("s")))
        enough = sums.withColumn("n", order).where(F.col("n") == k).select("query_id", F.col("s").alias("enough"))
        bounds = kept(rest.join(enough, "query_id", "left").groupBy("term").agg(F.min(F.coalesce(F.col("enough") - F.col("rest"), F.lit(-1.0))).alias("needed")), "needed")
        blocks = heads.join(_sent(bounds), "term").where(F.col("bound") >= F.col("needed") - _MARGIN)
        return asked, kept(blocks.select("gen", "bucket", "term", "shard", "block"), "blocks"), weighed, idf

    def _weighed(self, blocks: DataFrame, idf: DataFrame, weight, gens: list[int]) -> DataFrame:
        """(term, code, id, w): weights of living documents in some blocks."""
        buckets = [r[0] for r in blocks.select("bucket").distinct().collect()]  # at most BUCKETS numbers
        entries = self.table("postings", gens).where(F.col("bucket").isin(buckets)).join(_sent(blocks.drop("bucket")), ["gen", "term", "shard", "block"], "left_semi")
        entries = entries.join(_sent(idf), "term").select("gen", "term", "code", "idf", F.inline("entries"))
        dead = self.table("dead", gens).select("id", F.col("of").alias("gen"))
        living = entries.join(_sent(dead), ["id", "gen"], "left_anti")
        return living.select("term", "code", "id", weight(F.col("tf"), F.col("len")).alias("w"))

    def read_share(self, queries: DataFrame, k: int, query_id: str, query_text: str) -> tuple[int, int]:
        """(blocks that a search reads, blocks that its terms have)."""
        asked, blocks, *_ = self._chosen(queries, k, query_id, query_text, 1.2, 0.75)
        return blocks.count(), self.postings_of(asked.select("term").distinct(), self.generations()).count()
