"""From raw documents to token ids: five stages, each one operator of granary.llm.

Every stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read
again as the next one's documents; all but the last return the columns of ``documents``.  Rows
without an id pass through the stages that go by ids.  Nulls, empty texts, repeated rows and empty
tables are handled as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import bpe, mixing, near_dedup, quality, substring_dedup
from granary.llm.shared import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Ids that a stage may send to every executor, 8 bytes each; with more, both sides are shuffled.
SENT = 4_000_000


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.  If nothing is labelled good, all stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.classify(docs.select(*COLUMNS), labels, unknown=1.0).where("predicted = 1").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8) stays.

    Rows that share a doc_id are one document if their shingle sets are equal, and of those the
    least row stays; different texts under one doc_id are documents of their own.
    """
    docs = docs.select(*COLUMNS)
    found = stored(near_dedup.linked(docs).where("doc_id IS NOT NULL").select("doc_id", "s1", "s2", "stays"), "stays")
    ids = stored(found.groupBy("doc_id").agg(F.max("stays").alias("stays"), F.count("*").alias("rows")), "ids")
    gone, clash = ids.where("NOT stays").select("doc_id"), ids.where("stays AND rows > 1").select("doc_id")
    small = lambda ids: F.broadcast(ids) if ids.count() <= SENT else ids
    left = docs.join(small(gone), "doc_id", "left_anti")
    if clash.count() == 0:
        return left
    clash = small(clash)
    keys = ["doc_id", "s1", "s2"]
    kept = found.where("stays").join(clash, "doc_id", "left_semi").select(*keys).distinct()
    own = near_dedup.digests(left.join(clash, "doc_id", "left_semi").select(*COLUMNS))
    one = own.groupBy(*keys).agg(F.min(F.struct(*COLUMNS[1:])).alias("row")).join(kept, keys, "left_semi")
    return left.join(clash, "doc_id", "left_anti").select(*COLUMNS).union(one.select("doc_id", *[f"row.{c}" for c in COLUMNS[1:]]))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows that repeat are cut out; texts that lose nothing stay as they are."""
    cut = substring_dedup.remove_repeats(docs.select(*COLUMNS), untouched_as_given=True)
    return cut.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix takes it.

    Null and wordless texts are taken no times and go.  A null source is a source of its own.  Rows
    of one id, source and size are taken alike; rows without an id rank by their size.
    """
    mixed = mixing.mix(docs.select(*COLUMNS)).where("copies > 0")
    return mixed.select(*COLUMNS, F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """Token ids of every text: doc_id, source, ids, n_tokens.

    Null and empty texts have no ids.  Rows repeat, and lack an id or a source, freely.
    """
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.encode(docs.select("doc_id", "text", "source"), vocabulary)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substrings),
    ("mixing", mixture),
    ("bpe", token_ids),
]
#: A fitted model and BPE are beyond SQL: tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what comes between is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
