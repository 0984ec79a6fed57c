"""What kind of content a fetched body is, as column expressions over text or its first part."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What marks a client-rendered page: an empty mount point, an empty custom element, or one of these texts (fixed values).
EMPTY_MOUNT = r"""(?i)<div[^>]*\bid=["'](root|app|__next|___gatsby|_r_)["'][^>]*>\s*</div>"""
EMPTY_ELEMENT = r"(?i)<([a-z][a-z0-9]*-[a-z0-9-]*)\b[^>]*>\s*</\1>"
SPA_TEXTS = ("data-reactroot", "ng-version=", "<app-root", "__next_f", "data-v-app", "__sveltekit", "q:container", "astro-island")
#: Addresses whose bodies are files (fixed value).
DOWNLOAD = r"(?i)(?:/download(?:\?|$))|(?:/bitstreams/)|(?:\.pdf(?:\?|$))"
#: What counts as a link and a script where a rule has thresholds for their numbers (fixed values).
LINK, SCRIPT = r"(?i)<a\b[^>]*\bhref\s*=", r"(?i)<script\b"


def _head(body: Column, n: int = 512) -> Column:
    return F.lower(F.substring(F.regexp_replace(body, r"^\s+", ""), 1, n))


def looks_like_html(body: Column) -> Column:
    """Doctype at the start of, or an html tag in, the first 512 characters."""
    h = _head(body)
    return F.startswith(h, F.lit("<!doctype")) | F.contains(h, F.lit("<html"))


def content_kind(body: Column) -> Column:
    """'pdf', 'html' or 'other' by the body's own first characters."""
    return F.when(F.startswith(body, F.lit("%PDF")), "pdf").when(looks_like_html(body), "html").otherwise("other")


def content_type(body: Column, suffix: Column, header: Column) -> Column:
    """File type with precedence: PDF by magic or header, old office files, zipped office files, HTML by magic, header or suffix, else null.

    A zipped file is what its header or suffix says, Word before PowerPoint, else what stands in its
    zip: Word if the directory at its end has a name under word/, PowerPoint if one under ppt/.  Files
    packed inside of others don't count, as only names behind the directory's own marks are looked at.
    """
    has = lambda *names: F.coalesce(suffix.isin(*names), F.lit(False))
    says = lambda p: F.coalesce(F.contains(header, F.lit(p)), F.lit(False))
    raw = F.decode(body.cast("binary"), "ISO-8859-1")  # a character for each byte
    ole = F.startswith(body, F.lit("��\x11�")) | F.startswith(raw, F.lit("\u00d0\u00cf\u0011\u00e0"))
    zipped, inside = F.startswith(body, F.lit("PK")), lambda folder: F.regexp_like(raw, F.lit(rf"(?s)PK\x01\x02.{{42}}{folder}/"))
    return (
        F.when(F.startswith(body, F.lit("%PDF")) | says("application/pdf"), "PDF")
        .when(ole, F.when(says("presentation") | says("ms-powerpoint") | has("ppt"), "PPT").when(says("word") | has("doc"), "DOC").when(says("powerpoint"), "PPT").otherwise("DOC"))
        .when(zipped & (says("wordprocessingml") | says("msword") | has("docx")), "DOCX")
        .when(zipped & (says("presentationml") | says("ms-powerpoint") | has("pptx")), "PPTX")
        .when(zipped & inside("word"), "DOCX")
        .when(zipped & inside("ppt"), "PPTX")
        .when(looks_like_html(body) | says("text/html") | has("html", "htm"), "HTML")
    )


def visible_length(body: Column) -> Column:
    """Characters left without scripts, styles, tags and repeated white space."""
    x = F.regexp_replace(body, r"(?is)<(script|style)\b[^>]*>.*?</\1>", " ")
    return F.length(F.trim(F.regexp_replace(F.regexp_replace(x, r"<[^>]+>", " "), r"\s+", " ")))


def spa_mark(body: Column) -> Column:
    """An empty mount point, an empty custom element or a text that client-side frameworks leave."""
    low = F.lower(body)
    found = F.regexp_like(low, F.lit(EMPTY_MOUNT)) | F.regexp_like(low, F.lit(EMPTY_ELEMENT))
    for text in SPA_TEXTS:
        found = found | F.contains(low, F.lit(text))
    return found


def spa_shell(body: Column) -> Column:
    """A page that a client fills in: little visible text with a mark, or scripts without links."""
    seen, links, scripts = visible_length(body), F.regexp_count(body, F.lit(LINK)), F.regexp_count(body, F.lit(SCRIPT))
    return F.when(~looks_like_html(body) | ((seen >= 500) & (links >= 3)), False).when(spa_mark(body) & (seen < 300), True).otherwise((scripts >= 3) & (links == 0) & (seen < 300))


def viewer_shell(body: Column) -> Column:
    """An HTML page that only holds a browser's PDF viewer."""
    h = _head(body, 2048)
    return looks_like_html(body) & (F.contains(h, F.lit("pdf_embedder.css")) | F.contains(h, F.lit("chrome-extension://")))


def useless(body: Column, least: int = 512) -> Column:
    """Not a PDF and empty, under ``least`` bytes, or a viewer's shell."""
    return F.when(F.startswith(body, F.lit("%PDF")), False).otherwise(F.coalesce(F.octet_length(body) < least, F.lit(True)) | viewer_shell(body))


def acceptable_capture(body: Column, least: int = 512) -> Column:
    """A raw capture worth keeping: PDF, or neither shell nor JSON nor a tiny page."""
    fine = ~viewer_shell(body) & ~spa_shell(body) & ~F.regexp_like(body, F.lit(r"^\s*[{\[]")) & ~(looks_like_html(body) & (F.octet_length(body) < least))
    return (F.length(body) > 0) & (F.startswith(body, F.lit("%PDF")) | fine)


def successful(body: Column, status: Column, by_browser: Column) -> Column:
    """A useful body that came from a browser or with a status of 200 to 299."""
    return ~useless(body) & (by_browser | status.between(200, 299))


def fetch_route(body: Column, url: Column, failed: Column) -> Column:
    """Which fetcher is next for a body from the plain one: 'raw', 'rendered' or 'done'."""
    download = F.regexp_like(url, F.lit(DOWNLOAD))
    return F.when(failed, "raw").when(spa_shell(body) & download, "raw").when(spa_shell(body), "rendered").when(useless(body), "raw").otherwise("done")


def may_be_pdf(url: Column, header: Column) -> Column:
    """Whether a response is worth reading for a PDF, by its content type or address."""
    u, h = F.lower(url), F.coalesce(F.lower(header), F.lit(""))
    named = F.endswith(u, F.lit(".pdf")) | F.contains(u, F.lit(".pdf?")) | (F.contains(u, F.lit("/bitstreams/")) & F.endswith(F.rtrim(u, F.lit("/")), F.lit("/content")))
    return F.contains(h, F.lit("application/pdf")) | F.contains(h, F.lit("octet-stream")) | F.coalesce(named, F.lit(False))


def reliable_choice(api_body: Column, http_failed: Column, http_body: Column, url: Column) -> Column:
    """Which of the fetchers' bodies is taken, in order: 'api' if it is a PDF, else 'http' if it is good, else what a browser gives, 'raw' or 'rendered'."""
    route = fetch_route(http_body, url, http_failed)
    return F.when(F.coalesce(F.startswith(api_body, F.lit("%PDF")), F.lit(False)), "api").when(route == "done", "http").otherwise(route)
