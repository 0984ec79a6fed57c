"""The link graph: edges, what seeds reach, and a crawl with budgets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.operators.discovery import link_address
from granary.operators.store import kept


def links(pages: DataFrame, url: str, body: str) -> DataFrame:
    """(url, pos, href) of every anchor in page order, from 0."""
    found = F.regexp_extract_all(F.col(body), F.lit(r"""(?i)<a\s[^>]*href\s*=\s*["']([^"']*)["']"""), F.lit(1))
    return pages.select(F.col(url).alias("url"), F.posexplode(found).alias("pos", "href"))


def resolved(edges: DataFrame) -> DataFrame:
    """Adds dst, the link against its page's address."""
    return edges.withColumn("dst", link_address(F.col("url"), F.col("href")))


def links_in_body(pages: DataFrame, candidates: DataFrame, page: str, body: str) -> DataFrame:
    """(page, url, title) candidates -> (page, url, title, reasons): url_not_in_body, title_not_in_body; none where both stand in it word for word.

    A page's candidates are gathered first, so its body is joined once.  A blank title isn't looked
    for; candidates of unknown pages have no body to stand in.
    """
    each = candidates.groupBy(page).agg(F.collect_set(F.struct("url", "title")).alias("_c"))
    met = each.join(pages.select(page, F.coalesce(F.col(body), F.lit("")).alias("_body")), page, "left").withColumn("_body", F.coalesce("_body", F.lit("")))
    no_url = lambda c: ~F.coalesce(F.contains(F.col("_body"), c["url"]), F.lit(False))
    no_title = lambda c: (F.trim(F.coalesce(c["title"], F.lit(""))) != "") & ~F.contains(F.col("_body"), F.coalesce(c["title"], F.lit("")))
    reasons = lambda c: F.array_compact(F.array(F.when(no_url(c), "url_not_in_body"), F.when(no_title(c), "title_not_in_body")))
    return met.select(page, F.inline(F.transform("_c", lambda c: F.struct(c["url"].alias("url"), c["title"].alias("title"), reasons(c).alias("reasons")))))


def discovered(found: DataFrame, visited: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(parent, url, pos) links of a round -> pages not visited yet with their first parent, and the edges of all parents."""
    found = found.where("url IS NOT NULL")
    first = found.groupBy("url").agg(F.min(F.struct("parent", "pos")).alias("_p")).join(visited.select("url"), "url", "left_anti")
    return first.select("url", F.col("_p.parent").alias("parent")), found.select(F.col("parent").alias("src"), F.col("url").alias("dst")).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    """(src, dst, type) once each, and each one's reverse with the side it is seen from."""
    once = edges.select("src", "dst", "type").distinct()
    return once.select("src", "dst", "type", F.lit("to").alias("side")).union(once.select(F.col("dst"), F.col("src"), "type", F.lit("from")))


def reachable(edges: DataFrame, seeds: DataFrame, most_depth: int | None = None) -> DataFrame:
    """(seed, node, depth): every node that links lead to from each seed, at its least depth, the seed itself at 0.

    With ``most_depth`` only what is no deeper; without, all.  Breadth first: a round joins the frontier with the edges and drops what was met before, so cycles
    end.  Frontiers are tables in the shared folder; the driver sees only whether one is empty.
    """
    edges = edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct()
    front = kept(seeds.select(F.col("seed"), F.col("seed").alias("node"), F.lit(0).alias("depth")).distinct())
    met = [front]
    depth = 0
    while most_depth is None or depth < most_depth:
        depth += 1
        step = front.join(edges, front.node == edges.src).select("seed", F.col("dst").alias("node")).distinct()
        for m in met:
            step = step.join(m.select("seed", "node"), ["seed", "node"], "left_anti")
        front = kept(step.withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        met.append(front)
        if len(met) > 8:  # few tables to look through
            whole = met[0]
            for m in met[1:]:
                whole = whole.unionByName(m)
            met = [kept(whole)]
    out = met[0]
    for m in met[1:]:
        out = out.unionByName(m)
    return out


LINKS = 1000  # links of a page that are fetched at once
AHEAD = 256  # pages of a seed's crawl whose links are fetched before it gets there
SENT = 100_000  # rows that may be broadcast


class _Missing(Exception):
    """Links that a crawl needs next and that weren't fetched yet."""


def _crawl(fetched: dict, seed: str, kind: str | None, links: int, max_depth: int, max_files: int, max_urls: int | None) -> tuple[list, list, list, list]:
    """Depth first in link order; a page is marked when it is first seen; budgets are looked at before each page.

    Goes as far as the links that were fetched.  fetched: by page its parts, each (upto, [(pos, url,
    kind)]): the links, one more than ``links`` if there are others, that none of the first ``upto``
    pages marked.  Parts fetched earlier are good as long as all that was marked since is known.
    Returns visits (node, depth, kind, n), pages that marked their links in order, fetched pages that
    come soon, and what to fetch: (page, part, upto, pos and url of the last known link).
    """
    seen, stack, got = {seed}, [], [(seed, 0, kind, 0)]
    n_files, n_urls, marked, known_from = 0, 1, [], 0

    def good(page: str) -> bool:
        return page in fetched and fetched[page][0][0] >= known_from

    def push(page: str, depth: int) -> None:
        nonlocal known_from
        if not good(page):
            raise _Missing(page, 0, len(marked), None, None)
        parts = [found[:links] for _, found in fetched[page]]
        fresh = [x for i, found in enumerate(parts) for x in found if i or x[1] not in seen]
        seen.update(url for _, url, _ in fresh)
        if len(fetched[page][-1][1]) > links:  # what else it marks isn't known
            known_from = len(marked) + 1
            stack.append((page, None, (page, len(parts), len(marked), *parts[-1][-1][:2])))
        stack.extend((url, depth, kind) for _, url, kind in reversed(fresh))
        marked.append(page)

    try:
        if max_depth > 0 and max_files > 0 and (max_urls is None or max_urls > 1):
            push(seed, 1)
        while stack and n_files < max_files and (max_urls is None or n_urls < max_urls):
            node, depth, kind = stack.pop()
            if depth is None:
                raise _Missing(*kind)
            n_urls += 1
            if kind == "pdf":
                n_files += 1
            if kind in ("pdf", "html"):
                got.append((node, depth, kind, len(got)))
            if kind == "html" and depth < max_depth:
                push(node, depth + 1)
    except _Missing as e:
        soon = [node for node, depth, kind in reversed(stack) if depth is not None and kind == "html" and depth < max_depth]
        soon = soon[: AHEAD if max_urls is None else min(AHEAD, max_urls - n_urls)]
        return got, marked, [x for x in soon if good(x)], [e.args, *((x, 0, len(marked), None, None) for x in soon if not good(x))]
    return got, marked, [], []


def _sent(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= SENT else df


def crawl(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, max_depth: int = 10, max_files: int = 50, max_urls: int | None = None) -> DataFrame:
    """(seed, node, depth, kind, n): the pages each seed's crawl visits, in order, under its budgets.

    What a budget cuts off depends on the order of visits, so one seed's crawl is sequential; seeds run
    side by side.  A crawl holds the links of the pages it visits and of at most AHEAD more, LINKS at a
    time of each, not the graph: a round goes as far as they reach, and the links it needs next are
    then looked for in the table, without those that visited pages marked.
    edges: (src, dst, pos), equal links at their first place, ties by dst; nodes: (url, kind), absent
    ones can't be fetched, of several kinds the greatest counts; seeds: (seed).  Seeds that are neither
    a node nor have links visit nothing.
    """
    nodes = kept(nodes.where("url IS NOT NULL").groupBy("url").agg(F.max("kind").alias("kind")), "nodes")
    some = seeds.select("seed").distinct()
    some = some.join(_sent(kept(some.join(nodes, some.seed == nodes.url).select("seed", "kind"), "kinds")).withColumn("known", F.lit(True)), "seed", "left")
    some = some.join(edges.join(_sent(kept(seeds.select(F.col("seed").alias("src")).distinct(), "seeds")), "src", "left_semi").select(F.col("src").alias("seed"), F.lit(True).alias("linked")).distinct(), "seed", "left")
    some = kept(some.where("known OR linked").select("seed", F.when(F.col("known"), F.col("kind")).otherwise("html").alias("kind")), "seeds")
    nodes, edges = nodes.where("kind IS NOT NULL"), kept(edges.select("src", "dst", F.col("pos").cast("long").alias("pos")).where("src IS NOT NULL AND dst IS NOT NULL"), "edges")
    links = LINKS if max_urls is None else max(1, min(LINKS, max_urls))
    row = "seed string, page string, part int, upto int, n int, pos long, url string, kind string"
    known = some.select("seed", F.lit(None).cast("string").alias("page"), F.lit(0).alias("part"), F.lit(0).alias("upto"), F.lit(0).alias("n"), F.lit(None).cast("long").alias("pos"), F.lit(None).cast("string").alias("url"), "kind")

    def run(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        none = df["page"].isna()
        kind = df["kind"][none].iloc[0]
        fetched: dict = {}
        for (page, _, upto), part in df[~none].sort_values("n", kind="stable").groupby(["page", "part", "upto"]):  # parts in order
            found = part[part["url"].notna()]
            fetched.setdefault(page, []).append((upto, list(zip((None if p != p else int(p) for p in found["pos"]), found["url"], found["kind"], strict=True))))
        got, marked, soon, need = _crawl(fetched, key[0], kind if isinstance(kind, str) else None, links, max_depth, max_files, max_urls)
        rows = [("visit", node, depth, kind, n, 0, None, None) for node, depth, kind, n in got]
        rows += [("marked", page, 0, None, n, 0, None, None) for n, page in enumerate(marked)] + [("soon", page, 0, None, 0, 0, None, None) for page in soon]
        rows += [("need", page, 0, None, upto, part, pos, url) for page, part, upto, pos, url in need]
        out = pd.DataFrame(rows, columns=["what", "node", "depth", "kind", "n", "part", "pos", "url"])
        return out.assign(seed=key[0], pos=out["pos"].astype("Int64"))

    while True:
        at = kept(known.groupBy("seed").applyInPandas(run, "seed string, what string, node string, depth int, kind string, n int, part int, pos long, url string"), "crawled")
        need = at.where("what = 'need'").select("seed", F.col("node").alias("src"), "part", F.col("n").alias("upto"), F.col("pos").alias("last_pos"), F.col("url").alias("last_url"))
        if need.isEmpty():
            return at.where("what = 'visit'").select("seed", "node", "depth", "kind", "n")
        need, used = _sent(need), at.where("what IN ('marked', 'soon')").select("seed", F.col("node").alias("page"))
        found = edges.join(need, "src").where(F.col("dst") != F.col("seed")).groupBy("seed", "src", "part", "upto", "last_pos", "last_url", "dst").agg(F.min("pos").alias("pos"))
        place = lambda pos, url: F.struct(pos.isNull(), F.coalesce(pos, F.lit(0)), url)
        found = found.where((F.col("part") == 0) | (place(F.col("pos"), F.col("dst")) > place(F.col("last_pos"), F.col("last_url"))))
        marks = edges.join(_sent(at.where("what = 'marked'").select("seed", F.col("node").alias("src"), F.col("n").alias("nth"))), "src").groupBy("seed", "dst").agg(F.min("nth").alias("nth"))
        fresh = kept(found.join(marks, ["seed", "dst"], "left").where(F.col("nth").isNull() | (F.col("nth") >= F.col("upto"))).select("seed", F.col("src").alias("page"), "part", "upto", "pos", F.col("dst").alias("url")), "fresh")
        order = Window.partitionBy("seed", "page", "part", "upto").orderBy(F.col("pos").asc_nulls_last(), "url")
        first = nodes.join(_sent(fresh), "url").withColumn("n", F.row_number().over(order)).where(F.col("n") <= links + 1)
        asked = need.select("seed", F.col("src").alias("page"), "part", "upto").join(first, ["seed", "page", "part", "upto"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
        cols = [c.split()[0] for c in row.split(", ")]
        known = kept(known.where("page IS NULL").union(known.join(used, ["seed", "page"], "left_semi").select(cols)).union(asked.select(cols)), "known")


def title_state(detected, inherited, ttl, depth):
    """(title, ttl) that a page hands to its children: its own for ``depth`` levels, else the inherited one while it lasts."""
    alive = inherited.isNotNull() & (ttl > 0)
    title = F.when(detected.isNotNull(), F.when(depth > 0, detected)).when(alive & (ttl > 1), inherited)
    left = F.when(detected.isNotNull(), F.when(depth > 0, depth).otherwise(0)).when(alive & (ttl > 1), ttl - 1).otherwise(0)
    return title, left
