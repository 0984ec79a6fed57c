"""Names in texts: which, where, and the codes they stand for, found by one automaton for all names."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.operators.store import kept

NAMES_SENT = 500_000  # names in one automaton; more are dealt to several passes


def lowered(text: str) -> str:
    """Lower case where that leaves one character for one, so that places stay the same."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


def automaton(names: list[tuple[str, str]]):
    """Of (name, code): finds all names at once; equal names in lower case are one, with the least code."""
    import ahocorasick

    found: dict[str, str] = {}
    for name, code in names:
        low = lowered(name)
        if low and (low not in found or code < found[low]):
            found[low] = code
    a = ahocorasick.Automaton()
    for name, code in found.items():
        a.add_word(name, (len(name), name, code))
    if found:
        a.make_automaton()
    return a


def spans(a, text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, name, code) in code points: names between word borders, those within a longer one left out."""
    if not len(a):
        return []
    low = lowered(text)
    hits = []
    for last, (n, name, code) in a.iter(low):
        start, end = last + 1 - n, last + 1
        if (start and _word(low[start - 1]) and _word(low[start])) or (end < len(low) and _word(low[end]) and _word(low[end - 1])):
            continue
        hits.append((start, -end, name, code))
    hits.sort()
    out, reached = [], 0
    for start, end, name, code in hits:
        if -end > reached:
            out.append((start, -end, name, code))
            reached = -end
    return out


def _pass(told, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(told.value)
        for batch in batches:
            rows = []
            for i, text in zip(batch.column(0), batch.column(1), strict=True):
                rows += [(i.as_py(), *s) for s in spans(a, text.as_py() or "")]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            types = [batch.column(0).type, pa.int32(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["id", "start", "end", "name", "code"])

    return run


def detected(texts: DataFrame, names: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, start, end, name, code): each place of each text where a name of (name, code) stands, whatever its case.

    Names are found between word borders only; a name within a longer one that is found there isn't
    told.  Places are code points from 0, the end behind the last.  Of equal names the least code
    counts; null and empty names and null texts have nothing.  Up to NAMES_SENT names go to every task
    as one automaton; more are dealt to several, each a pass over the texts, and what stands within a
    longer name of another pass goes afterwards.
    """
    spark = texts.sparkSession
    usable = names.where("name IS NOT NULL AND name != ''").select(F.col("name").cast("string"), F.coalesce(F.col("code").cast("string"), F.lit("")).alias("code")).distinct()
    usable = kept(usable, "names")
    passes = max(1, -(-usable.count() // NAMES_SENT))
    given = texts.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {given.schema['id'].dataType.simpleString()}, start int, end int, name string, code string"
    found = None
    for p in range(passes):
        some = usable.where(F.pmod(F.xxhash64("name"), F.lit(passes)) == p).toArrow()  # at most about NAMES_SENT rows
        told = spark.sparkContext.broadcast(list(zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True)))
        part = given.mapInArrow(_pass(told, None), schema)
        found = part if found is None else found.union(part)
    if passes == 1:
        return found
    own = kept(found.groupBy("id", "start", "end", "name").agg(F.min("code").alias("code")), "found")
    wide = own.select("id", F.col("start").alias("_s"), F.col("end").alias("_e"))
    inside = (own.id == wide.id) & (F.col("_s") <= own.start) & (F.col("_e") >= own.end) & ((F.col("_s") != own.start) | (F.col("_e") != own.end))
    return own.join(wide, inside, "left_anti")


def codes_of(found: DataFrame) -> DataFrame:
    """(id, codes, spans): a text's codes in the order in which they are first told, and all its spans in order."""
    ordered = F.array_sort(F.collect_list(F.struct("start", "end", "name", "code"))).alias("s")
    each = found.groupBy("id").agg(ordered)
    return each.select("id", F.array_distinct(F.transform("s", lambda x: x["code"])).alias("codes"), F.transform("s", lambda x: x["name"]).alias("spans"))
