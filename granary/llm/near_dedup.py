"""MinHash near-duplicates by fast similarity sketching.

Method (Dahlgaard, Knudsen and Thorup, "Fast Similarity Sketching", 2017): a sketch has t
coordinates, seen as bins.  In round i < t every element of the set falls into one hashed bin
with value (i, hash); in round t + j it falls into bin j.  A coordinate keeps its least value,
so one filled in an early round is final, and after 2t rounds every coordinate is filled.
Rounds stop as soon as all are.  Equal coordinates estimate the Jaccard similarity as closely
as t independent MinHashes do.

Plan: one pass makes a small row per document (set digest, band keys, a byte per coordinate).
Equal sets form one class, told by its digest and numbered when it is written, so a thousand copies
count once and one doc_id may stand over different sets.  Buckets of a band link each class
to the smallest in the bucket (a star, never all pairs); those links are confirmed on the full
shingle sets, in units of bounded size that hold each set once, and merged.  In buckets that still hold several components the members of all but the
largest are compared with all members of other components, in blocks of bounded size, by set size
and sketch; the pairs that may reach the threshold are confirmed on full sets too, unit by unit.  A
bucket that is one component but for a few sends its rows once, not once for each block, and a unit
gives only the links that join its classes, never all its pairs.  So every pair that shares a bucket is either
already joined, ruled out by its sketch, or decided exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.llm import shared
from granary.llm.components import components
from granary.llm.shared import give_back, grouped, spread_join, stored
from granary.llm.textkit import common, mix64, shingle_set

BINS, BANDS, ROWS = 512, 25, 5  # bands use the first coordinates
BLOCK = 128  # members, or probes, of a unit: classes that meet at once
SHINGLES = 1 << 13  # a class of so many shingles weighs as much as two
LARGEST, OTHER, PROBE = 0, 1, 2  # a member of a bucket's largest component, another member, a probe
SENT = 4_000_000  # ids that may be broadcast
#: A sketch rules a pair out if its estimate is this much below the threshold: over four and a half standard deviations.
MARGIN = 0.08

_BIN, _ROUND = np.uint64(55), np.uint64(46)  # a key holds bin, round and value from the top
_TOP = np.arange(BINS, dtype=np.uint64) << _BIN
_ALL = np.arange(BINS, dtype=np.uint64)
_SEEDS = mix64(np.arange(1, 2 * BINS + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_POWERS = mix64(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def sketch(s: np.ndarray) -> np.ndarray:
    """The fast similarity sketch of a non-empty set of 64-bit hashes: BINS coordinates."""
    n = len(s)
    out, open_ = np.zeros(BINS, np.uint64), np.ones(BINS, bool)
    done = 0
    while done < BINS and open_.any():
        r = min(BINS - done, max(1, 6 * BINS // n))
        h = mix64(s[None, :] ^ _SEEDS[done : done + r, None])
        # the first key of a bin is its earliest round's least value
        rounds = np.arange(done, done + r, dtype=np.uint64)[:, None] << _ROUND
        keys = np.sort(((h & _TOP[-1]) | rounds | ((h << (np.uint64(64) - _BIN)) >> (np.uint64(64) - _ROUND))).ravel())
        at = np.minimum(np.searchsorted(keys, _TOP), len(keys) - 1)
        got = keys[at]
        new = open_ & ((got >> _BIN) == _ALL)
        out[new] = got[new]
        open_ &= ~new
        done += r
    left = np.flatnonzero(open_)
    for some in np.array_split(left, -(-len(left) * n // (1 << 20)) or 1):
        out[some] = mix64(s[None, :] ^ _SEEDS[BINS + some, None]).min(1)
    return mix64(out)


def band_keys(sk: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of ROWS coordinates; the band's number is part of it."""
    x = (sk[: BANDS * ROWS] * _POWERS).reshape(BANDS, ROWS).sum(1, dtype=np.uint64)
    return mix64(x + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def _sketches(k: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("bands", pa.list_(pa.int64())), ("sk", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = shingle_set(text.as_py(), k)
                if len(s) == 0:
                    rows.append((i, 0, 0, 0, None, None))
                    continue
                sk = sketch(s)
                rows.append((i, len(s), *_halves(s), band_keys(sk), (sk & np.uint64(255)).astype(np.uint8).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    return run


def _halves(s: np.ndarray) -> tuple[int, int]:
    """The 128-bit digest of a set as two longs; zeros for an empty one."""
    if len(s) == 0:
        return 0, 0
    d = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def _digests(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [_halves(shingle_set(t.as_py(), k)) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([g[i] for g in got], pa.int64()) for i in (0, 1))], [*batch.schema.names, "s1", "s2"])

    return run


def digests(docs: DataFrame, k: int = 5) -> DataFrame:
    """Adds s1 and s2, the digest of each text's shingle set, to a table of documents."""
    return docs.mapInArrow(_digests(k), docs.select("*", F.lit(0).cast("long").alias("s1"), F.lit(0).cast("long").alias("s2")).schema)


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), k) for t in batch.column(0)]
            got = [_halves(s) for s in sets]
            yield pa.RecordBatch.from_arrays([*(pa.array([g[i] for g in got], pa.int64()) for i in (0, 1)), pa.array([s.tobytes() for s in sets], pa.binary())], ["s1", "s2", "s"])

    return run


def _confirm(num: int, den: int):
    """Rows sorted by unit and kind (a unit's pairs, then the sets in them) -> links that join what the unit's pairs join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, ["u1", "u2", "u3"]):
            sets = {c: np.frombuffer(s.as_buffer(), np.uint64) for c, s in zip(t.column("cls").to_pylist()[1:], t.column("s").combine_chunks()[1:], strict=True)}
            root = {c: c for c in sets}

            def find(x):
                while root[x] != x:
                    root[x] = x = root[root[x]]
                return x

            links = []
            for a, b in zip(t.column("a")[0].as_py(), t.column("b")[0].as_py(), strict=True):
                if find(a) == find(b):
                    continue
                p, q = sets[a], sets[b]
                c = common(p, q)
                if den * c >= num * (len(p) + len(q) - c):
                    links.append((a, b))
                    root[find(b)] = find(a)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links, strict=True)], ["a", "b"])
        give_back()

    return run


_UNITS = pa.schema([("u1", pa.int64()), ("u2", pa.int32()), ("u3", pa.int32()), ("a", pa.list_(pa.int64())), ("b", pa.list_(pa.int64()))])


def _cross(least: float, ratio: float):
    """A row for each unit, a block of members and one of probes: the pairs of different components whose sketches and set sizes allow the threshold, each in the first bucket it shares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, ["key", "i", "j"]):
            ids, comp, n, kind = (t.column(c).to_numpy() for c in ("cls", "comp", "n", "kind"))
            p, m = np.flatnonzero(kind == PROBE), np.flatnonzero(kind != PROBE)
            if not len(p) or not len(m):
                continue
            sk = np.frombuffer(b"".join(t.column("sk").to_pylist()), np.uint8).reshape(-1, BINS)
            bands = t.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
            unit = [t.column(c)[0].as_py() for c in ("key", "i", "j")]
            band = int(np.flatnonzero(bands[0] == unit[0])[0])
            a, b = p[:, None], m[None, :]
            # two that are probes both meet in two units and count in one
            fit = (comp[a] != comp[b]) & (np.minimum(n[a], n[b]) >= ratio * np.maximum(n[a], n[b])) & ((kind[b] == LARGEST) | (ids[a] < ids[b]))
            x, y = np.nonzero(fit)
            x, y = p[x], m[y]
            found = []
            for s in range(0, len(x), 1 << 14):
                u, v = x[s : s + (1 << 14)], y[s : s + (1 << 14)]
                ok = (bands[u] == bands[v]).argmax(1) == band
                u, v = u[ok], v[ok]
                ok = (sk[u] == sk[v]).mean(1) >= least
                found.append((u[ok], v[ok]))
            if found:
                u, v = (ids[np.concatenate(z)].tolist() for z in zip(*found, strict=True))
                if u:
                    yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*unit, u, v), _UNITS, strict=True)], schema=_UNITS)

    return run


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Link documents whose sets of k-word shingles have den * intersection >= num * union.

    Takes columns doc_id (long) and text; others are ignored.  Returns a row per input row:
    doc_id, n_shingles, component_id (the smallest doc_id that links lead to, itself included),
    kept (doc_id = component_id).  Null or wordless texts have no shingles and no links; fewer
    than k words are one shingle; rows that share a doc_id are one document if their sets are
    equal.  Rows with a null doc_id take no part: component_id is null and they are kept.
    Tables without rows give no rows.
    """
    found = linked(docs, k, num, den)
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def linked(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of near_duplicates with s1, s2 (the digest of the row's set) and stays in place of kept.

    stays: the row has a null doc_id, no links, or the one set that stands for its component (of the
    sets under the smallest doc_id the one with the least digest) under that doc_id.  Rows that
    stay and share doc_id and digest are one document.
    """
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sk = stored(given.mapInArrow(_sketches(k), "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>, sk binary"), "sketches")
    real = sk.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # One class for each set of shingles, numbered as it is written; rep is its smallest doc_id.
    classes = real.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sk").alias("sk"))
    classes = stored(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    # A class weighs one, and more if its set is large, so that what a unit holds is bounded.
    weight = (1 + F.floor(F.col("n") / SHINGLES)).cast("long").alias("wt")
    band = classes.select("cls", weight, F.explode("bands").alias("key"))
    shared_ = band.groupBy("key").agg(F.min("cls").alias("hub"), F.count("*").alias("m"), F.sum("wt").alias("of_key")).where("m > 1")
    shared_ = shared_.withColumn("of_hub", F.sum("of_key").over(Window.partitionBy("hub")))  # a hub has a bucket in each band
    members = stored(band.join(shared_, "key"), "members")

    def confirmed(units: DataFrame, name: str) -> DataFrame:
        """Links of units (u1, u2, u3, lists a and b of pairs), decided on full sets; what a unit's pairs join stays joined."""
        units = stored(units, f"{name}-units")
        within = units.select("u1", "u2", "u3", F.explode(F.array_distinct(F.concat("a", "b"))).alias("cls"))
        needed = stored(classes.select("cls", "rep", "s1", "s2").join(within.select("cls").distinct(), "cls", "left_semi"), f"{name}-classes")
        ids = needed.select(F.col("rep").alias("doc_id")).distinct()
        if needed.count() <= SENT:  # 8 bytes each; beyond it Spark shuffles both sides
            ids = F.broadcast(ids)
        sets = given.where("doc_id IS NOT NULL").join(ids, "doc_id", "left_semi").select("text").mapInArrow(_sets(k), "s1 long, s2 long, s binary")
        sets = sets.groupBy("s1", "s2").agg(F.min("s").alias("s"))
        sets = stored(needed.select("cls", "s1", "s2").join(sets, ["s1", "s2"]).select("cls", "s"), f"{name}-sets")
        none = F.lit(None).cast("array<long>")
        rows = spread_join(within, sets, "cls", "u1").select("u1", "u2", "u3", F.lit(1).alias("kind"), none.alias("a"), none.alias("b"), "cls", "s")
        heads = units.select("u1", "u2", "u3", F.lit(0).alias("kind"), "a", "b", F.lit(None).cast("long").alias("cls"), F.lit(None).cast("binary").alias("s"))
        both = heads.union(rows).repartition("u1", "u2", "u3").sortWithinPartitions("u1", "u2", "u3", "kind")
        return stored(both.mapInArrow(_confirm(num, den), "a long, b long"), f"{name}-links")

    star = members.where("cls != hub").select("hub", "cls", F.pmod(F.xxhash64("cls"), F.ceil(F.col("of_hub") / BLOCK)).cast("int").alias("part")).distinct()
    star = star.groupBy("hub", "part").agg(F.collect_list("cls").alias("b")).select(F.col("hub").alias("u1"), F.col("part").alias("u2"), F.lit(0).alias("u3"), F.transform("b", lambda _: F.col("hub")).alias("a"), "b")
    first = confirmed(star, "hub")
    roots = stored(components(first), "roots")
    # What is left: buckets whose members are still in several components.  Members of a bucket's largest
    # component are only met by the others, the probes; both are dealt into blocks of BLOCK.
    placed = members.join(roots.withColumnsRenamed({"node": "cls", "root": "comp"}), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    placed = stored(placed.select("key", "cls", "comp", "wt"), "placed")
    parts = placed.groupBy("key", "comp").agg(F.sum("wt").alias("k"))
    mixed = parts.groupBy("key").agg(F.max(F.struct("k", "comp")).alias("top"), F.sum("k").alias("all"), F.count("*").alias("comps")).where("comps > 1")
    mixed = mixed.select("key", F.col("top.comp").alias("largest"), F.ceil(F.col("all") / BLOCK).cast("int").alias("ni"), F.ceil((F.col("all") - F.col("top.k")) / BLOCK).cast("int").alias("nj"))
    mixed = stored(mixed, "mixed")
    if mixed.isEmpty():
        return _named_rows(sk, classes, roots)
    rows = spread_join(placed, mixed, "key", "cls").join(classes.select("cls", "n", "sk", "bands"), "cls")
    at = lambda seed, n: F.pmod(F.xxhash64("cls", F.lit(seed)), F.col(n)).cast("int")
    own = ["cls", "comp", "n", "sk", "bands"]
    kind = F.when(F.col("comp") == F.col("largest"), LARGEST).otherwise(OTHER)
    met = rows.select("key", at(1, "ni").alias("i"), F.explode(F.expr("sequence(0, nj - 1)")).alias("j"), kind.alias("kind"), *own)
    probes = rows.where("comp != largest").select("key", F.explode(F.expr("sequence(0, ni - 1)")).alias("i"), at(2, "nj").alias("j"), F.lit(PROBE).alias("kind"), *own)
    blocks = met.union(probes).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    cross = blocks.mapInArrow(_cross(num / den - MARGIN, num / den), "u1 long, u2 int, u3 int, a array<long>, b array<long>")
    second = confirmed(cross, "cross")
    named = lambda c: F.coalesce(c, F.col("x"))
    between = second.select(F.col("a").alias("x"), "b").join(roots.withColumnRenamed("node", "x"), "x", "left").select(named(F.col("root")).alias("a"), F.col("b").alias("x"))
    between = between.join(roots.withColumnRenamed("node", "x"), "x", "left").select("a", named(F.col("root")).alias("b")).where("a != b")
    again = stored(components(between), "roots")
    roots = roots.withColumnRenamed("root", "x").join(again.withColumnRenamed("node", "x"), "x", "left").select("node", named(F.col("root")).alias("root")).union(again.join(roots.select("node"), "node", "left_anti"))
    return _named_rows(sk, classes, roots)


def _named_rows(sk: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of ``linked`` from (node, root): the class that each linked class was merged into."""
    # Each class that has copies or links: its component, named by the smallest doc_id and led by one class.
    nodes = roots.union(roots.select("root", "root")).distinct().withColumnRenamed("node", "cls")
    several = classes.select("cls", "s1", "s2", "rep", "copies").join(nodes, "cls", "left").where("copies > 1 OR root IS NOT NULL").withColumn("root", F.coalesce("root", "cls"))
    several = stored(several, "several")
    lead = several.groupBy("root").agg(F.min(F.struct("rep", "s1", "s2")).alias("lead"))
    led = (F.col("lead.s1") == F.col("s1")) & (F.col("lead.s2") == F.col("s2"))
    several = several.join(lead, "root").select("s1", "s2", F.col("lead.rep").alias("component_id"), led.alias("leads"), "copies")
    # Each document: what its class has, or else itself.  Rows without a set or an id meet nothing, and
    # those of a class with very many copies meet it where they are.
    rows, keys = sk.drop("bands", "sk"), ["s1", "s2"]
    takes_part = F.coalesce((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.lit(False))
    hot = several.where(F.col("copies") > shared.HOT_ROWS)  # at most rows / HOT_ROWS classes
    some, none = rows.where(takes_part), [F.lit(None).cast(t).alias(c) for c, t in (("component_id", "long"), ("leads", "boolean"))]
    several = several.drop("copies")
    if hot.isEmpty():
        met = some.join(several, keys, "left")
    else:
        hot = F.broadcast(stored(hot.drop("copies"), "hot"))
        met = some.join(hot, keys).unionByName(some.join(hot.select(*keys), keys, "left_anti").join(several, keys, "left"))
    out = met.unionByName(rows.where(~takes_part).select("*", *none)).withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
    stays = F.coalesce((F.col("doc_id") == F.col("component_id")) & F.coalesce("leads", F.lit(True)), F.lit(True))
    return out.select("doc_id", "n_shingles", "component_id", "s1", "s2", stays.alias("stays"))


def op10_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Near-duplicates of all documents at a similarity of 0.85."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=5, num=85, den=100)


QUERIES = {"op10_minhash_near_dedup": op10_minhash_near_dedup}
#: Links over shingle sets and their transitive closure: tested against brute force instead.
SQL: dict[str, str] = {}
