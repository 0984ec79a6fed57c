"""Files that pages lead to, in the order in which a breadth-first walk meets them, and titles handed down along links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.operators.store import kept

SENT = 1_000_000  # rows that may be broadcast


def placed(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """A stored copy in the order of ``keys`` with ``_at``, a number that grows along it: the file's and the row's in it.

    Sorted by ranges, so no task sees more than its own; numbers have gaps between files.
    """
    out = kept(df.repartitionByRange(*keys).sortWithinPartitions(*keys), name)
    file = F.regexp_extract(F.element_at(F.split("_metadata.file_path", "/"), -1), r"^part-(\d+)", 1).cast("long")
    return out.select("*", (file * F.lit(1 << 36) + F.col("_metadata.row_index")).alias("_at"))


def numbered(df: DataFrame, keys: list[str], number: str) -> DataFrame:
    """Adds a number from 0 in the order of ``keys``, without gaps: files are counted, and each starts where the one before ends."""
    out = placed(df, keys, "numbered").withColumn("_file", F.shiftright("_at", 36))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    starts = out.groupBy("_file").agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    low = F.col("_at").bitwiseAND(F.lit((1 << 36) - 1))
    return out.join(F.broadcast(starts), "_file").withColumn(number, F.col("_start") + low).drop("_file", "_at", "_start")


def files_reached(edges: DataFrame, nodes: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, file, depth, n): every file that some seed's walk meets, once, with the first seed that meets it, n in order of discovery.

    edges: (src, dst, pos); nodes: (url, kind), kind "page" or "file", links to others lead nowhere;
    seeds: (seed, pos), walked by pos.  A walk takes pages breadth first and a page's links by pos; it
    expands each page once, and files never.  A file that a link names twice counts where it is first
    named.  Links without an end, and unknown seeds, are left out.

    All seeds' walks go on level by level together.  A page's place in a level is its parent's place
    and the link's pos; ranks come from one sort by ranges a level, never from one task's window.  It
    ends when no new page is met, however deep.
    """
    kinds = nodes.where("url IS NOT NULL AND kind IN ('page', 'file')").groupBy("url").agg(F.max("kind").alias("kind"))
    links = edges.where("src IS NOT NULL").groupBy("src", "dst").agg(F.min("pos").alias("pos"))
    links = kept(links.join(kinds.withColumnRenamed("url", "dst"), "dst").join(kinds.where("kind = 'page'").select(F.col("url").alias("src")), "src", "left_semi"), "links")
    first = seeds.groupBy("seed").agg(F.min("pos").alias("order")).join(kinds.where("kind = 'page'"), F.col("seed") == F.col("url"), "left_semi")
    front = placed(first.select("seed", "order", F.col("seed").alias("page")), ["order", "seed"], "front")
    seen, found, depth = [front.select("seed", "page")], None, 0
    while True:
        depth += 1
        step = front.select("seed", "order", F.col("page").alias("src"), "_at").join(links, "src").groupBy("seed", "order", "kind", "dst").agg(F.min(F.struct("_at", "pos")).alias("_p"))
        step = kept(step.select("seed", "order", "kind", "dst", F.col("_p._at").alias("parent"), F.col("_p.pos").alias("pos")), "step")
        files = step.where("kind = 'file'").select("seed", "order", F.col("dst").alias("file"), F.lit(depth).alias("depth"), "parent", "pos")
        found = files if found is None else found.union(files)
        pages = step.where("kind = 'page'").withColumnRenamed("dst", "page")
        for s in seen:
            pages = pages.join(s, ["seed", "page"], "left_anti")
        front = placed(pages.select("seed", "order", "page", "parent", "pos"), ["order", "seed", "parent", "pos", "page"], "front")
        if front.isEmpty():
            break
        seen.append(front.select("seed", "page"))
        if len(seen) > 8:
            whole = seen[0]
            for s in seen[1:]:
                whole = whole.union(s)
            seen = [kept(whole, "seen")]
            found = kept(found, "found")
    at = F.struct("order", "seed", "depth", "parent", "pos")
    once = found.groupBy("file").agg(F.min(at).alias("_x")).select("file", "_x.*")
    return numbered(once, ["order", "seed", "depth", "parent", "pos", "file"], "n").select("seed", "file", "depth", "n")


def inherited_titles(pages: DataFrame, lasts: int) -> DataFrame:
    """(url, parent, title) -> (url, title, left): what each page gets from the pages above it.

    A page with a title of its own hands that to its children, good for ``lasts`` levels; another hands
    on what it got, good for one level less, while anything is left.  Pages without a parent, or with
    an unknown one, get nothing (null and 0); blank titles are none.  Several rows of one url count as
    one, the least; pages that are their own ancestors get nothing from there.

    By doubling: a page that can't tell yet looks where the page that it waits for looks, so titles
    that last n levels take about log n rounds, however deep the forest is.
    """
    own = F.when(F.trim("title") != "", F.col("title"))
    once = kept(pages.where("url IS NOT NULL").groupBy("url").agg(F.min(F.struct("parent", own.alias("title"))).alias("_r")).select("url", "_r.parent", "_r.title"), "pages")
    above = once.select(F.col("url").alias("parent"), F.col("title").alias("_t"), F.lit(True).alias("_known"))
    met = once.select("url", "parent").join(above, "parent", "left")
    told = F.col("_known").isNull() | F.col("_t").isNotNull()
    alive = F.col("_t").isNotNull() & (F.lit(lasts) > 0)
    state = met.select(
        "url",
        F.when(~told, F.col("parent")).alias("waits"),
        F.when(~told, 1).otherwise(0).alias("levels"),
        F.when(alive, F.col("_t")).alias("title"),
        F.when(alive, F.lit(lasts)).otherwise(0).alias("left"),
    )
    state = kept(state, "titles")
    while True:
        open_ = state.where(F.col("waits").isNotNull() & (F.col("levels") < lasts))
        if open_.isEmpty():
            break
        there = state.select(F.col("url").alias("waits"), F.col("waits").alias("_w"), F.col("levels").alias("_l"), F.col("title").alias("_t"), F.col("left").alias("_left"))
        x = open_.select("url", "waits", "levels").join(there, "waits", "left")
        goes_on, left = F.col("_w").isNotNull(), F.col("_left") - F.col("levels")
        some = ~goes_on & F.col("_t").isNotNull() & (left > 0)
        done = x.select(
            "url",
            F.when(goes_on, F.col("_w")).alias("waits"),
            F.when(goes_on, F.col("levels") + F.col("_l")).otherwise(0).alias("levels"),
            F.when(some, F.col("_t")).alias("title"),
            F.when(some, left).otherwise(0).alias("left"),
        )
        state = kept(done.unionByName(state.where(F.col("waits").isNull() | (F.col("levels") >= lasts))), "titles")
    return state.select("url", "title", F.coalesce("left", F.lit(0)).alias("left"))


def link_address(base: Column, href: Column) -> Column:
    """An absolute address for a link of a page: whole ones stay, //host, /path, ?query, #part and relative ones are put after what they keep of the page's.

    Dot segments are taken out of paths, as RFC 3986 has it.  Null for null parts.
    """
    href, base = F.trim(href), F.trim(base)
    part = lambda n: F.regexp_extract(base, r"^(([A-Za-z][A-Za-z0-9+.-]*):)?(//([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$", n)
    root, path, query = F.concat(part(1), part(3)), part(5), part(6)
    own = lambda n: F.regexp_extract(href, r"^([^?#]*)(\?[^#]*)?(#.*)?$", n)
    folder = F.regexp_replace(path, r"[^/]*$", "")
    folder = F.when((folder == "") & (part(3) != ""), F.lit("/")).otherwise(folder)
    merged = F.when(F.startswith(own(1), F.lit("/")), own(1)).otherwise(F.concat(folder, own(1)))
    return (
        F.when(F.regexp_like(href, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*:")), href)
        .when(F.startswith(href, F.lit("//")), F.concat(part(1), href))
        .when(href == "", F.concat(root, path, query))
        .when(own(1) == "", F.concat(root, path, F.when(own(2) != "", own(2)).otherwise(query), own(3)))
        .otherwise(F.concat(root, _without_dots(merged), own(2), own(3)))
    )


def _without_dots(path: Column) -> Column:
    """A path without . and .. segments."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    kept_ = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda done, p: F.when(p == ".", done)
        .when((p == "..") & (F.size(done) > 1), F.slice(done, F.lit(1), F.size(done) - 1))
        .when(p == "..", done)
        .otherwise(F.concat(done, F.array(p))),
    )
    ends = F.concat(kept_, F.when(last.isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>")))
    return F.array_join(ends, "/")
