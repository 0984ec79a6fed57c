"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions alone.

(Rosén, "On sampling with probability proportional to size", 1997.)  A source of S words with a
target of T words takes floor(T / S) certain copies of every document.  The words still missing,
R = T mod S, come from a sample without replacement: document i has inclusion probability
l_i = min(1, R * size_i / sum size^2), proportional to its size, so that the expected words are R.
Documents are ranked by random odds over inclusion odds, U / (1 - U) : l / (1 - l); those with
l_i = 1 come first, certain.  The sample is the ranking's beginning that fits R words, and up to MORE
further documents of different sizes: each the largest that fits what is then missing, and the last
the nearest to it.

U is a hash of the document's id and text, so reruns agree and nothing is drawn.  Rows of equal id,
source and text are one unit of several rows, of which as many are taken as fit.  The beginning of the
ranking is found without putting a source in order: ranks fall into CELLS slices of the unit
interval, slices are summed per source (one partial sum a slice and task), and only the slice that
holds the boundary is ordered unit by unit, a CELLS-th part of a source.  Documents with l_i = 1 have a
slice of their own, which never holds the boundary: their words are at most R.

Texts are read twice, for their sizes and digests and for the rows that are returned; what goes on
is a row of a few numbers for each unit, and documents meet their copies by id, source and digest.
Rows of a unit that is taken in part are numbered by their place in a stored table, file by file.
Tables with a row for each source are broadcast while there are at most SOURCES of them, else Spark
shuffles; only in ``targets`` they pass through one task, sorted and spilled by Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.shared import stored

WEIGHTS = (5, 2, 1)
MOST = 3  # a target is at most so many times its source
CELLS = 4096
MORE = 4  # documents that may fill a source's gap after the ranking's beginning
SOURCES = 100_000  # sources whose rows, some dozens of bytes each, may be broadcast


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size) with a row a source -> target added: all words shared by weight, held at ``most`` times a source.

    Sources in code point order, null last, weigh as ``weights``, repeating.  The excess of sources
    held at their limit is shared again by weight until none is above, which is the same as one level
    t for all: target = min(limit, weight * t).  A source of no words gets no target.
    """
    in_order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))  # a row for each source
    ranked = sources.withColumn("n", F.row_number().over(in_order) - 1)
    ranked = ranked.withColumn("w", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("n") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("top", F.col("source_size") * most)
    # Sources by how soon they meet their limit; held ones are a beginning of that order.
    by_level = Window.orderBy(F.col("top") / F.col("w"), "n")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy()
    ranked = ranked.withColumn("left", F.sum("source_size").over(all_) - F.coalesce(F.sum("top").over(before), F.lit(0)))
    ranked = ranked.withColumn("w_left", F.sum("w").over(all_) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    ranked = ranked.withColumn("held", F.col("top") * F.col("w_left") < F.col("left") * F.col("w"))
    level = F.min(F.when(~F.col("held"), F.struct("n_level", "left", "w_left"))).over(all_)
    ranked = ranked.withColumn("n_level", F.row_number().over(by_level)).withColumn("at", level)
    target = F.when(F.col("held"), F.col("top").cast("double")).otherwise(F.col("at.left").cast("double") * F.col("w") / F.col("at.w_left"))
    return ranked.select("source", "source_size", target.alias("target"))


def unit(doc_id: Column, digest: Column) -> Column:
    """A number in (0, 1) from the md5 of an id's text and a text's digest: 48 bits and a half."""
    text = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.lower(F.hex(digest)))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long").cast("double") + 0.5) / float(1 << 48)


_UNIT = ["doc_id", "source", "_h"]


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Adds size, source_size, target, copies and taken (size * copies) to every row of ``docs``.

    Takes columns doc_id, text and source.  Size is the number of words (runs of anything but ASCII
    white space), 0 for null texts.  Columns of the added names are replaced.  A null source is one
    source, the last.  Documents without words take none.  Rows may share an id, lack it, or repeat:
    they are told apart by their texts, and of equal rows as many are taken as fit.  No rows in, no
    rows out.
    """
    docs = docs.drop("size", "source_size", "target", "copies", "taken", "_h", "_whole", "_some", "_rows")
    sized = docs.select("doc_id", "source", _digest(), words_of(F.col("text")).alias("size"))
    units = stored(chosen(sized, weights, most), "units")
    out = _met(docs.select("*", _digest()), units, _UNIT)
    more = ["size", "source_size", "target", "_whole", "_some", "_rows"]
    out = out.select(*[F.col(f"d.`{c}`") for c in docs.columns], "d._h", *[f"x.{c}" for c in more])
    in_part = F.col("_some").between(F.lit(1), F.col("_rows") - 1)
    if units.where(in_part).isEmpty():
        told = out.withColumn("copies", F.col("_whole") + (F.col("_some") > 0).cast("int"))
    else:
        told = out.where(~in_part).withColumn("copies", F.col("_whole") + (F.col("_some") > 0).cast("int"))
        told = told.unionByName(_numbered(stored(out.where(in_part), "in-part")).withColumn("copies", F.col("_whole") + (F.col("_number") <= F.col("_some")).cast("int")).drop("_number"))
    copies = F.when(F.col("size") > 0, F.least(F.lit(most), F.col("copies"))).otherwise(0).cast("int")
    return told.withColumn("copies", copies).select(*[F.col(f"`{c}`") for c in docs.columns], "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def _numbered(table: DataFrame) -> DataFrame:
    """Rows of a stored table with ``_number``, from 1 within their unit: by file, and by place in it.

    A unit's rows are only ordered within a file, so a unit of very many rows is numbered by many tasks.
    """
    placed = table.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_place"))
    keys = [F.col(c) for c in _UNIT]
    per = placed.groupBy(*keys, "_file").agg(F.count("*").alias("_here"))
    before = Window.partitionBy(*keys).orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    per = per.withColumn("_start", F.coalesce(F.sum("_here").over(before), F.lit(0))).drop("_here")
    ranked = placed.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys, "_file").orderBy("_place")))
    met = _met(ranked, per, [*_UNIT, "_file"])
    return met.select(*[F.col(f"d.`{c}`") for c in table.columns], (F.col("x._start") + F.col("d._rank")).alias("_number"))


def words_of(text: Column) -> Column:
    """Number of runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _digest() -> Column:
    """What tells texts of one id and source apart; null texts are empty."""
    return F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))).alias("_h")


def _met(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join as d and x on columns that may be null."""
    on = F.lit(True)
    for c in keys:
        on = on & F.col(f"d.{c}").eqNullSafe(F.col(f"x.{c}"))
    return left.alias("d").join(right.alias("x"), on, "left")


def _left_anti(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    on = F.lit(True)
    for c in keys:
        on = on & F.col(f"d.{c}").eqNullSafe(F.col(f"x.{c}"))
    return left.alias("d").join(right.alias("x"), on, "left_anti")


def _sent(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SOURCES else df


def chosen(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(doc_id, source, _h, size) of all rows -> the distinct ones with source_size, target and _rows, how many there are.

    ``_whole`` is how often each row is taken for certain, ``_some`` how many of them are taken once more.
    """
    slim = stored(sized.groupBy(*_UNIT, "size").agg(F.count("*").alias("rows")), "sizes")
    total = F.sum(F.col("size") * F.col("rows")).cast("long")
    squares = F.sum(F.col("size").cast("decimal(19,0)") * F.col("size").cast("decimal(19,0)") * F.col("rows")).cast("double")
    per = slim.groupBy("source").agg(total.alias("source_size"), squares.alias("sq"))
    aimed = targets(per.select("source", "source_size"), weights, most).join(per.select(F.col("source").alias("s2"), "sq"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    whole = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("int")
    aimed = aimed.withColumn("whole", whole).withColumn("missing", F.col("target") - F.col("whole") * F.col("source_size"))
    aimed = stored(aimed.withColumnRenamed("source", "s"), "targets")
    sources = aimed.count()
    on = F.col("source").eqNullSafe(F.col("s"))
    chance = F.when(F.col("sq") > 0, F.least(F.lit(1.0), F.col("missing") * F.col("size") / F.col("sq"))).otherwise(0.0)
    u = unit(F.col("doc_id"), F.col("_h"))
    ranked = slim.join(_sent(aimed, sources), on).drop("s").withColumn("chance", chance)
    # Q = odds of U over odds of the chance; Q / (1 + Q) keeps the order and lies in the unit interval.
    q = F.when(F.col("chance") >= 1, F.lit(0.0)).when(F.col("chance") <= 0, F.lit(1.0)).otherwise(u * (1 - F.col("chance")) / (u * (1 - F.col("chance")) + (1 - u) * F.col("chance")))
    ranked = ranked.withColumn("q", q).withColumn("cell", F.when(F.col("chance") >= 1, F.lit(-1)).otherwise(F.least(F.lit(CELLS - 1), F.floor(F.col("q") * CELLS))).cast("int"))
    able = (F.col("size") > 0) & (F.col("missing") > 0) & (F.col("chance") > 0)
    words = F.col("size") * F.col("rows")
    cells = ranked.where(able).groupBy("source", "missing", "cell").agg(F.sum(words).alias("in_cell"))
    run = Window.partitionBy("source").orderBy("cell")  # at most CELLS rows a source
    cells = cells.withColumn("upto", F.sum("in_cell").over(run)).withColumn("start", F.col("upto") - F.col("in_cell"))
    edge = cells.where((F.col("start") <= F.col("missing")) & (F.col("upto") > F.col("missing"))).select(F.col("source").alias("s"), F.col("cell").alias("edge"), "start")
    edge = _sent(stored(edge, "edges"), sources)
    placed = ranked.join(edge, on, "left").drop("s")
    sure = able & (F.col("edge").isNull() | (F.col("cell") < F.col("edge")))
    # Unit by unit in the slice of the boundary: all rows of those that fit, and what fits of the next.
    row = Window.partitionBy("source").orderBy("q", "size", "doc_id", "_h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = placed.where(able & (F.col("cell") == F.col("edge"))).withColumn("upto", F.col("start") + F.sum(words).over(row))
    room = F.floor((F.col("missing") - (F.col("upto") - words)) / F.col("size"))
    inside = inside.withColumn("fit", F.greatest(F.lit(0), F.least(F.col("rows"), room)).cast("long"))
    fitting = stored(inside.select(*_UNIT, "start", "missing", "fit", (F.col("fit") * F.col("size")).alias("words")), "boundary")
    gap = fitting.groupBy("source").agg((F.max("missing") - F.max("start") - F.sum("words")).alias("gap")).withColumnRenamed("source", "s")
    # A few more documents, of those left: each the largest that fits the gap, the last the nearest, if that is nearer than none.
    firsts = fitting.where("fit > 0").select(*_UNIT, "fit")
    marked = _met(placed.withColumn("sure", sure), firsts, _UNIT).select("d.*", F.when(F.col("d.sure"), F.col("d.rows")).otherwise(F.coalesce("x.fit", F.lit(0))).alias("some"))
    able_left = marked.where(able & (F.col("some") < F.col("rows"))).join(_sent(gap, sources), on).drop("s").where(F.col("size") < 2 * F.col("gap"))
    left = stored(able_left.groupBy("source", "size").agg(F.min(F.struct("q", "doc_id", "_h")).alias("x"), F.max("gap").alias("gap")), "left")  # a row for each size
    more = stored(_fillers(left, sources), "more")
    done = _met(marked, F.broadcast(more) if sources <= SOURCES else more, _UNIT)
    cols = [F.col(f"d.{c}") for c in (*_UNIT, "size", "source_size", "target")]
    return done.select(*cols, F.col("d.whole").alias("_whole"), (F.col("d.some") + F.coalesce("x.more", F.lit(0))).alias("_some"), F.col("d.rows").alias("_rows"))


def _fillers(left: DataFrame, sources: int) -> DataFrame:
    """(source, size, x, gap) -> source, doc_id, _h and more = 1 of up to MORE documents a source that fill its gap.

    All rounds are one query, a row a source from each to the next with what is still missing and the
    picks so far: a query for each cost the driver a plan, its stages and their broadcasts each time.
    """
    now = left.groupBy(F.col("source").alias("s")).agg(F.max("gap").alias("now"))
    picks: list[str] = []
    for i in range(MORE):
        off = F.abs(F.col("size") - F.col("now"))
        fits = F.col("size") <= F.col("now") if i < MORE - 1 else off < F.col("now")
        for c in picks:
            fits = fits & ~F.col(f"{c}.size").eqNullSafe(F.col("size"))
        near = F.min(F.when(fits, F.struct(off.alias("off"), F.col("x"), F.col("size")))).alias(f"n{i}")
        met = left.drop("gap").join(_sent(now, sources), F.col("source").eqNullSafe(F.col("s"))).drop("s")
        now = met.groupBy(F.col("source").alias("s")).agg(*[F.max(c).alias(c) for c in ("now", *picks)], near)
        picks.append(f"n{i}")
        now = now.withColumn("now", F.col("now") - F.coalesce(F.col(f"n{i}.size"), F.lit(0)))
    found = now.select(F.col("s").alias("source"), F.explode(F.array(*picks)).alias("n")).where("n IS NOT NULL")
    return found.select("source", F.col("n.x.doc_id").alias("doc_id"), F.col("n.x._h").alias("_h"), F.lit(1).alias("more"))


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op8_mixing": op8_mixing}
_U = "(('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || h), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0"
_ROUNDS = "".join(
    f"l{i} AS (SELECT source, min({{'off': abs(size - gap), 'x': x, 'size': size}}) AS n FROM c{i} WHERE {'size <= gap' if i < MORE - 1 else 'abs(size - gap) < gap'} GROUP BY source), "
    f"c{i + 1} AS (SELECT c.source, c.size, gap - coalesce(l.n.size, 0) AS gap, c.x FROM c{i} c LEFT JOIN l{i} l ON c.source IS NOT DISTINCT FROM l.source WHERE c.size IS DISTINCT FROM l.n.size),\n"
    for i in range(MORE)
)
_LASTS = " UNION ALL ".join(f"SELECT source, n.x.doc_id AS doc_id, n.x.h AS h FROM l{i}" for i in range(MORE))
SQL: dict[str, str] = {
    "op8_mixing": f"""
WITH RECURSIVE d AS (SELECT doc_id, source, md5(coalesce(text, '')) AS h, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
slim AS (SELECT doc_id, source, h, size, count(*) AS n FROM d GROUP BY ALL),
per AS (SELECT source, sum(size * n)::BIGINT AS source_size, sum(size::HUGEINT * size * n)::DOUBLE AS sq FROM slim GROUP BY source),
w AS (SELECT *, [5, 2, 1][1 + ((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3)::INT] AS w, {MOST} * source_size AS top FROM per),
lv AS (SELECT *, row_number() OVER o AS i, (sum(source_size) OVER () - coalesce(sum(top) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS lft, (sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS wl FROM w WINDOW o AS (ORDER BY top::DOUBLE / w, source IS NULL, source)),
held AS (SELECT *, top * wl < lft * w AS h FROM lv),
t AS (SELECT source, source_size, sq, CASE WHEN h THEN top::DOUBLE ELSE (SELECT arg_min(lft, i) FROM held WHERE NOT h)::DOUBLE * w / (SELECT arg_min(wl, i) FROM held WHERE NOT h) END AS target FROM held),
a AS (SELECT *, CASE WHEN source_size > 0 THEN least({MOST}, floor(target / source_size))::INT ELSE 0 END AS whole FROM t),
m AS (SELECT *, target - whole * source_size AS missing FROM a),
c AS (SELECT s.doc_id, s.source, s.h, s.size, s.n, m.source_size, m.target, m.whole, m.missing, CASE WHEN sq > 0 THEN least(1.0, missing * size / sq) ELSE 0.0 END AS chance, {_U} AS u FROM slim s JOIN m ON s.source IS NOT DISTINCT FROM m.source),
q AS (SELECT *, CASE WHEN chance >= 1 THEN 0.0 WHEN chance <= 0 THEN 1.0 ELSE u * (1 - chance) / (u * (1 - chance) + (1 - u) * chance) END AS q, size > 0 AND missing > 0 AND chance > 0 AS able FROM c),
r AS (SELECT *, sum(CASE WHEN able THEN size * n ELSE 0 END) OVER (PARTITION BY source ORDER BY able DESC, q, size, doc_id, h ROWS UNBOUNDED PRECEDING) AS upto FROM q),
f AS (SELECT *, CASE WHEN able THEN greatest(0, least(n, floor((missing - (upto - size * n)) / size)))::BIGINT ELSE 0 END AS fit FROM r),
g AS (SELECT source, max(missing) - sum(fit * size) AS gap FROM f GROUP BY source),
c0 AS (SELECT f.source, size, any_value(gap) AS gap, min({{'q': q, 'doc_id': doc_id, 'h': h}}) AS x FROM f JOIN g ON f.source IS NOT DISTINCT FROM g.source WHERE able AND fit < n GROUP BY f.source, size),
{_ROUNDS}
x AS (SELECT f.*, fit + (l.h IS NOT NULL)::INT AS k FROM f LEFT JOIN ({_LASTS}) l ON f.source IS NOT DISTINCT FROM l.source AND f.doc_id IS NOT DISTINCT FROM l.doc_id AND f.h = l.h),
e AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, h) AS i FROM d)
SELECT e.doc_id, e.size, x.source_size, x.target, e.size * CASE WHEN e.size > 0 THEN least({MOST}, whole + (i <= k)::INT) ELSE 0 END AS taken FROM e JOIN x ON e.doc_id IS NOT DISTINCT FROM x.doc_id AND e.source IS NOT DISTINCT FROM x.source AND e.h = x.h
"""
}
