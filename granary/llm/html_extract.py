"""Main text of web pages by line-block distribution.

(Chen, "General web page text extraction based on line-block distribution", 2009.)  Markup is
stripped into lines, one for each block of the page.  A line's block is the text length of SPAN
lines from it on.  Text surges where a block rises over the threshold and dives where blocks fall to
nothing again; the region from surge to dive with the most text marks the article.  Menus,
headers, footers, sidebars, notices, adverts, forms and comments hold text too, so lines inside such
elements count as empty.  Short paragraphs at an article's ends have flat blocks of their own: the
region therefore grows to the element that holds most of it, an article or main element if there is one
(and then to the page's other articles), or else over neighbouring lines with the same parent.  An advert or the like between them, however
long, doesn't end the article: growth steps over dropped lines to the next line of the same holder.
Names say less than tags: a wrapper may be called "top" or "sidebar-layout" and hold the article, so
an element that is dropped for its name alone comes back if it holds most of the page's prose, and an
ordinary word within a longer name ("recommended-dose") drops nothing.  Readers' comments are told by
name, or by being articles within an article.

A page is handled by itself, in one pass without a shuffle; each step is linear in its length.
"""

from __future__ import annotations

import functools
import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPAN = 3
THRESHOLD = 86  # characters in a block where text surges, or the page's largest block if that is less

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^<>]*>?|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"']|\"[^\"<]*+\"|'[^'<]*+')*+)>|<(/?)([a-zA-Z][^\s/<>]*+)([^<>]*+)>", re.S)
_ATTR = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
#: Elements whose content is not text: to their end tag, or the page's end.
_RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp"}
#: The same, but nested ones are closed one by one, and one that is never closed hides nothing.
_HIDDEN = {"noscript", "template", "svg", "object", "select", "canvas", "audio", "video", "annotation", "annotation-xml"}
#: Elements that are not part of an article wherever they stand; ``header`` only outside of one.
_ASIDE = {"nav", "footer", "aside", "form", "button", "dialog", "menu", "head", "datalist"}
_INLINE = set("a abbr acronym b bdi bdo big cite code data dfn em font i img ins del input kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br meta link base area source track param embed col math mi mn mo ms mtext mspace mrow msup msub msubsup mfrac msqrt mroot mstyle mover munder munderover mtable mtr mtd mpadded menclose mfenced semantics".split())
_VOID = set("br img input meta link base area source track param embed col hr wbr".split())
#: Elements that divide a text without being its holder; so do divs beside each other of one class.
_WITHIN = {"ul", "ol", "dl", "table", "figure", "details", "hgroup", "blockquote", "section", "fieldset", "center"}
_HOLDS = _ASIDE | {"div", "section", "article", "main", "header", "body", "html", "ul", "ol", "dl", "table", "figure", "details", "fieldset", "center", "hgroup", "blockquote"}
#: Words in class, id or role that name what is not the article; the second set only outside of one.
_NOT = set("ad ads adv advert advertisement adverts advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login comment comments commentlist disqus respond replies share sharing social related recommended recommendations widget feedback thread pagination pager sidebar sidenav aside complementary nav navbar navigation menu breadcrumb breadcrumbs search contentinfo paywall adsbygoogle adsense adslot adbox adunit topnav mainnav sitenav mainmenu submenu relatedposts commentform".split())
_NOT_OUTSIDE = _NOT | set("header masthead banner footer topbar toolbar copyright skip top bottom sitefooter pagefooter siteheader pageheader".split())
_COMMENT = set("comment comments commentlist reply replies feedback thread disqus respond ad ads advert advertisement promo sponsored related recommended widget".split())


#: What names adverts, also inside of a sentence.
_ADS = set("ad ads adv advert advertisement adverts advertising sponsor sponsored promo promotion adsbygoogle adsense adslot adbox adunit".split())
#: Words that don't name wrappers of an article: such elements come back only where there is no other text.
_CERTAIN = _ADS | _COMMENT - {"related", "recommended", "widget"} | set("cookie cookies consent gdpr notice notices alert popup newsletter subscribe subscription signup login commentform contentinfo footer sitefooter pagefooter".split())
#: "no-sidebar" or "with-comments" is a page's layout, not a sidebar or comments.
_LAYOUT = {"has", "have", "no", "non", "not", "with", "without"}
#: And so is "comments-open".
_STATE = {"open", "opened", "closed", "enabled", "disabled", "allowed", "on", "off"}
#: Words of the lists above that also stand in names of an article's own parts ("recommended-dose", "search-and-rescue"): in a
#: longer name they count only beside other listed words and words that name a frame.
_ORDINARY = set("alert notice notices recommended recommendations search related widget share sharing social complementary promotion replies reply respond menu navigation top bottom header banner skip comment comments copyright subscription overlay login consent feedback thread aside pager".split())
_FRAME = set("a an the of for to in on and by with my this page site global main inner outer left right center primary secondary container wrapper wrap holder box block blocks area areas section sections panel panels pane list lists item items row col column columns group bar bars strip button buttons btn link links icon icons image title heading head headline label text-box form field input post posts article articles story stories news content region zone unit slot module component body view js ui is has c l o u b reader readers user users visitor visitors customer customers guest guests public community blog facebook fb discussion add leave write new all latest recent popular more trending you your might like also read next prev previous follow us tweet email print tool tools action actions count counter meta info message messages notification close dismiss accept policy privacy legal terms offer offers cta teaser teasers card cards carousel slider feed prompt inline sticky fixed floating mobile desktop tablet large small wide narrow full dark light hidden visible default theme style shell root app layout footer".split())
#: Pairs of words in a name that speak of readers' comments or of consent.
_PHRASES = {("user", "reviews"), ("customer", "reviews"), ("reader", "reviews"), ("user", "comments"), ("discussion", "thread"), ("discussion", "board"), ("cc", "window"), ("cc", "banner"), ("cc", "revoke")}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
PROSE = 40  # least characters of a line of prose, most of them outside of links

_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def _names(attrs: str, words: set[str], ids: bool = True) -> set[str]:
    """The words that class, id or role hold, each by itself or as a part of a compound that doesn't speak of a layout."""
    found = set()
    for m in _ATTR.finditer(attrs):
        if not ids and m[1].lower() == "id":
            continue
        for token in m[2].strip("\"'").split():
            for parts in (re.split(r"[^a-z0-9]+", token.lower()), [w.lower() for w in _WORD.findall(token)]):
                if not _PHRASES.isdisjoint(zip(parts, parts[1:], strict=False)):
                    found.add("comments")
                if not words.isdisjoint(parts):
                    first = next(i for i, w in enumerate(parts) if w in words)
                    mine = words.intersection(parts)
                    if mine <= _ORDINARY and any(w and not w.isdigit() and w not in _FRAME and w not in _NOT_OUTSIDE for w in parts):
                        continue  # part of a longer name
                    if _LAYOUT.isdisjoint(parts[:first]) and _STATE.isdisjoint(parts[first + 1 : first + 2]):
                        found |= mine
    return found


def _class(attrs: str) -> str:
    return next((m[2].strip("\"'").strip() for m in _ATTR.finditer(attrs) if m[1].lower() == "class"), "")


@functools.cache
def _ends(tag: str) -> re.Pattern:
    """Start and end tags of one element."""
    return re.compile(rf"<(/?){re.escape(tag)}(?=[\s/>])[^>]*>?", re.I)


def lines_of(page: str) -> list[tuple[str, int, int, bool, int]]:
    """Blocks of a page in order: (text, number of the element around it, number of the article around it or 0, whether it may be article text, number of its holder)."""
    out: list[tuple] = []  # as above, then the element dropped by name around it or -1, and whether most of it is outside of links
    holders = {0: 0}  # number of an element -> of its holder
    alike: dict[tuple[int, str], int] = {}  # (holder of the element around it, class) -> holder of divs
    text: list[str] = []
    cuts: list[tuple[str, int | None, bool]] = []  # open inline elements to cut out, where their text starts, whether they go even in a sentence
    alone: list[tuple[int, int]] = []  # texts that go if nothing else stands in their line
    linked, in_link = 0, False
    suspects: list[tuple[int, bool, bool]] = []  # elements dropped by name: (such an element around it or -1, certain, whether it may come back)
    # open elements: (tag, number, dropped by tag from here on, article number, element dropped by name around it or -1)
    stack: list[tuple[str, int, bool, int, int]] = [("", 0, False, 0, -1)]
    number, at, pos = 0, 0, page

    opened: Counter[str] = Counter()
    endless: set[str] = set()  # hidden elements that no end tag follows any more

    def hidden_end(tag: str, at: int) -> int:
        """Behind the end tag of a hidden element that opens before ``at``, or ``at`` if none follows."""
        depth, last = 1, at
        if tag not in endless:
            for m in _ends(tag).finditer(pos, at):
                if not m[1]:
                    depth += not m[0].rstrip(">").endswith("/")
                    continue
                depth, last = depth - 1, m.end()
                if not depth:
                    return last
        if last == at:
            endless.add(tag)
        return last

    def push(element, holder=None):
        holders[element[1]] = element[1] if holder is None else holder
        stack.append(element)
        opened[element[0]] += 1

    def pop():
        opened[stack.pop()[0]] -= 1

    def suspect(around, names, may_return):
        suspects.append((around, not names.isdisjoint(_CERTAIN), may_return))
        return len(suspects) - 1

    def flush():
        nonlocal linked
        if alone:
            ends = [0, *(x for span in alone for x in span), len(text)]
            if not any(c.isalnum() for s, e in zip(ends[::2], ends[1::2], strict=True) for t in text[s:e] for c in t):
                text.clear()
        line = " ".join(html.unescape("".join(text)).split())
        if line:
            out.append((line, stack[-1][1], stack[-1][3], not stack[-1][2], holders[stack[-1][1]], stack[-1][4], 2 * linked < len(line)))
        text.clear()
        cuts.clear()
        alone.clear()
        linked = 0

    while True:
        m = _TAG.search(pos, at)
        text.append(pos[at : m.start() if m else len(pos)])
        if in_link:
            linked += len(text[-1])
        if not m:
            break
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:  # comment or declaration
            continue
        tag, closing, attrs = tag.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag in _RAW and not closing:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(pos, at)
            if not attrs.rstrip().endswith("/"):
                at = end.end() if end else len(pos)
            continue
        if tag in _HIDDEN:
            if not closing and not attrs.rstrip().endswith("/"):
                at = hidden_end(tag, at)
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in _INLINE:
            if tag == "a":
                in_link = not closing
            # what an inline advert holds is cut out of its line when it closes, what other names hold if it is all of the line
            if closing:
                if cuts and cuts[-1][0] == tag:
                    _, start, ad = cuts.pop()
                    if start is not None and ad:
                        del text[start:]
                    elif start is not None:
                        alone.append((start, len(text)))
            elif tag not in _VOID:
                if cuts:
                    cuts.append((tag, None, False)) if cuts[-1][0] == tag else None
                elif not stack[-1][2] and (names := _names(attrs, _NOT)):
                    cuts.append((tag, len(text), not names.isdisjoint(_ADS)))
            continue
        flush()
        if tag in _VOID:
            continue
        # a block of text ends with whatever block comes next
        while stack[-1][0] in ("p", "li", "td", "h"):
            if closing and tag == stack[-1][0]:
                break
            pop()
        if closing:
            if opened[tag]:  # a stray end closes nothing
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        _, _, dropped, article, around = stack[-1]
        if tag in ("article", "main") or re.search(r"\brole\s*=\s*[\"']?(?:main|article)\b", attrs, re.I):
            number += 1
            strong = any(e[2] and e[0] in _ASIDE for e in stack)
            around = around if article else -1
            if (names := _names(attrs, _COMMENT)) or (article and tag == "article"):  # an article within one is a comment, unless it holds the prose
                around = suspect(around, names or {"comment"}, True)
            push((tag, number, strong or bool(article and dropped), number if not article else article, around))
            continue
        if tag in ("body", "html"):
            number += 1
            push((tag, number, False, 0, -1))
            continue
        drop = dropped or tag in _ASIDE or (tag == "header" and not article)
        names = set() if drop else _names(attrs, _NOT if article else _NOT_OUTSIDE, tag not in _HEADINGS)
        if names:
            around = suspect(around, names, tag in _HOLDS)
        if tag in _HOLDS:
            number += 1
            holder = holders[stack[-1][1]] if tag in _WITHIN else None
            if tag == "div" and (name := _class(attrs)):
                holder = alike.setdefault((holders[stack[-1][1]], name), number)
            push((tag, number, drop, article, around), holder)
        elif names:
            number += 1
            push(("p" if tag not in ("li", "td", "th", "tr") else "li", number, drop, article, around), holders[stack[-1][1]])
    flush()
    back = _returned(suspects, out)
    return [(t, parent, article, ok and (around < 0 or back[around]), holder) for t, parent, article, ok, holder, around, _ in out]


def _returned(suspects: list[tuple[int, bool, bool]], lines: list[tuple]) -> list[bool]:
    """For each element dropped by name, whether it holds most of the page's prose after all; ones inside of it are judged for themselves."""
    n = len(suspects)
    own, prose, many, plain = [0] * n, [0] * n, [0] * n, 0
    for t, _, _, ok, _, around, mine in lines:
        if not ok or not mine:
            continue
        if around < 0:
            plain += len(t)
            continue
        own[around] += len(t)
        if len(t) >= PROSE:
            prose[around] += len(t)
            many[around] += 1
    for s in range(n - 1, -1, -1):
        around, certain, _ = suspects[s]
        if around >= 0 and not certain:
            prose[around] += prose[s]
            many[around] += many[s]
    back, left = [False] * n, sorted((s for s in range(n) if suspects[s][2] and prose[s]), key=lambda s: (suspects[s][1], -prose[s], s))
    before = -1
    while len(left) != before:
        before = len(left)
        for s in left:
            around, certain, _ = suspects[s]
            if around >= 0 and not back[around]:
                continue
            if plain < PROSE and (many[s] > 2 or not certain or not plain) or not certain and many[s] > 2 and prose[s] > plain:
                back[s] = True
                plain += own[s]
        left = [s for s in left if not back[s]]
    return back


def _grow(lines: list, at: int, step: int, around: list[int]) -> int:
    """The first place from ``at`` on that isn't the article's: lines follow by their parent, and behind dropped lines also by their holder."""
    parents, holders = {lines[s][1] for s in around}, {lines[s][4] for s in around}
    stop, crossed = at, False
    while 0 <= at < len(lines):
        _, parent, _, ok, holder = lines[at]
        if not ok:
            crossed = True
        elif parent in parents or (crossed and holder in holders):
            stop = at + step
        else:
            break
        at += step
    return stop


def main_text(page: str | None, span: int = SPAN, threshold: int = THRESHOLD) -> str:
    """The article's blocks, white space inside each turned into single spaces, joined by newlines; '' if there is none."""
    lines = lines_of(page or "")
    size = [len(t) if ok else 0 for t, _, _, ok, _ in lines]
    if not any(size):
        return ""
    blocks = [sum(size[i : i + span]) for i in range(len(size))]
    least = min(threshold, max(blocks))
    best, i = (0, 0, 0), 0
    while i < len(lines):
        if blocks[i] < least:  # no surge here
            i += 1
            continue
        j = i
        while j < len(lines) and blocks[j] > 0:  # until the text dives
            j += 1
        best = max(best, (sum(size[i:j]), -i, j))
        i = j
    start, end = -best[1], best[2]
    held: Counter[int] = Counter()  # the region's text by article, 0 for none
    for k in range(start, end):
        held[lines[k][2]] += size[k]
    article = max(held, key=lambda a: (held[a], a))
    if article:
        kept = [t for t, _, a, ok, _ in lines if ok and a]
    else:
        around = [s for s in (start, end - 1) if size[s]] or [max(range(start, end), key=lambda k: (size[k], -k))]
        start = _grow(lines, start - 1, -1, around) + 1
        end = _grow(lines, end, 1, around)
        kept = [t for t, _, _, ok, _ in lines[start:end] if ok]
    return "\n".join(kept)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h.as_py()) for h in batch.column(0)]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*batch.schema.names[1:], "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """Adds text and n_chars (code points) to every page, from a column html that isn't returned.

    All other columns stay; columns text and n_chars are replaced.  Null, empty and textless pages
    give '' and 0.  Tags that are never closed, cut-off pages and stray ends are read as far as they
    go.  Rows repeat freely; no rows in, no rows out.
    """
    own = [c for c in pages.columns if c not in ("html", "text", "n_chars")]
    given = pages.select(F.col("html").cast("string").alias("html"), *[F.col(f"`{c}`") for c in own])
    return given.mapInArrow(_extract, ", ".join([*(f"`{c}` {given.schema[c].dataType.simpleString()}" for c in own), "text string, n_chars long"]))


def op2_html_extract(spark, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


QUERIES = {"op2_html_extract": op2_html_extract}
#: A parse of markup: tested against the pages' own structure and hand-written pages.
SQL: dict[str, str] = {}
