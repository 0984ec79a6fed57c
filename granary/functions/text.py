"""Text scalars as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Typographic marks and what stands for them in a quote match; the soft hyphen goes (fixed values).
MARKS = {"‘": "'", "’": "'", "“": '"', "”": '"', "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-"}
SOFT_HYPHEN = "\u00ad"


@F.pandas_udf(StringType())
def nfkc(c: pd.Series) -> pd.Series:
    """Unicode compatibility composition; Spark has no such function."""
    return c.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


@F.pandas_udf(StringType())
def casefold(c: pd.Series) -> pd.Series:
    """Unicode case folding, which also makes ß and ss equal."""
    return c.map(lambda x: x if x is None else x.casefold())


@F.pandas_udf(StringType())
def general4(c: pd.Series) -> pd.Series:
    """A number in at most four significant digits, as C's %.4g has it; Java's keeps trailing zeros."""
    return c.map(lambda x: None if x is None or x != x else f"{x:.4g}")


def squeeze(c: Column) -> Column:
    """All white space to single blanks, trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def sentences(c: Column) -> Column:
    """Runs of a line's characters up to and with a stop, question or exclamation mark; linear in the text, however long a line is."""
    pieces = F.split(F.regexp_replace(c, r"([.!?])", "$1\u0001"), "[\u0001\\n]")
    return F.filter(pieces, lambda x: (F.length(x) > 1) & F.regexp_like(F.right(x, F.lit(1)), F.lit("[.!?]")))


def normalize_query(c: Column) -> Column:
    """Trimmed, case folded, white space squeezed."""
    return squeeze(casefold(c))


def normalize_title(c: Column) -> Column:
    """White space squeezed; null if nothing is left."""
    return F.nullif(squeeze(c), F.lit(""))


def normalize_quote(c: Column) -> Column:
    """For comparing quotations: compatibility forms and marks to plain ones, soft hyphens dropped, words joined over hyphenated line ends, blanks and line ends to single blanks.

    A hyphen before a carriage return and line feed isn't joined, as line ends are made plain later.
    """
    x = F.translate(nfkc(c), "".join(MARKS) + SOFT_HYPHEN, "".join(MARKS.values()))
    x = F.regexp_replace(x, r"(?U)(\w)-\n(\w)", "$1$2")
    x = F.regexp_replace(F.regexp_replace(x, r"\r\n?", "\n"), r"[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(x, r"\n+", " "), r"(?U)^\s+|\s+$", "")


def quote_match(quote: Column, source: Column) -> Column:
    """'exact' if the quote stands in the source, 'normalized' if its normal form stands in the source's, else null; null for empty ones."""
    q, s = normalize_quote(quote), normalize_quote(source)
    return F.when((quote == "") | (source == ""), None).when(F.contains(source, quote), "exact").when(F.contains(s, q), "normalized")


def country_key(c: Column) -> Column:
    """A country's name for comparing: compatibility forms to plain ones, no marks around it, case folded."""
    return casefold(F.regexp_replace(F.replace(nfkc(c), F.lit("’"), F.lit("'")), r"^[ \t\r\n,.;:()\[\]{}]+|[ \t\r\n,.;:()\[\]{}]+$", ""))


def short_country(name: Column) -> Column:
    """A country's name up to the first comma or bracket, case folded."""
    return casefold(F.regexp_extract(name, r"^[^,(\[]*", 0))


def too_broad(c: Column, least: int = 3) -> Column:
    """Fewer than ``least`` words."""
    return F.regexp_count(c, F.lit(r"\S+")) < least


def example_leaked(text: Column, example: Column, least: int = 40, head: int = 80) -> Column:
    """A trimmed example of ``least`` characters or more whose first ``head`` occur in the text."""
    e = F.regexp_replace(example, r"(?U)^\s+|\s+$", "")
    return F.coalesce((F.length(e) >= least) & F.contains(text, F.substring(e, 1, head)), F.lit(False))


def short_hash(c: Column, n: int = 16) -> Column:
    """The first n hex digits of the sha256."""
    return F.substring(F.sha2(c.cast("binary"), 256), 1, n)


def version_id(*parts: Column) -> Column:
    """A 32-digit id of a stage's parameters."""
    return F.substring(F.sha2(F.concat_ws("|", *parts).cast("binary"), 256), 1, 32)


def url_suffix(url: Column, known: tuple[str, ...] = ("pdf", "html", "htm", "docx", "doc", "pptx", "ppt")) -> Column:
    """The known file suffix of a URL's path in lower case, without query and fragment, or null."""
    path = F.lower(F.regexp_replace(url, r"[?#].*$", ""))
    return F.nullif(F.regexp_extract(path, rf"\.({'|'.join(known)})$", 1), F.lit(""))


def percent_encode(c: Column) -> Column:
    """RFC 3986 percent-encoding of everything but unreserved characters."""
    x = F.url_encode(c)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def search_entry(entry: Column) -> Column:
    """A map of a search's parts as key=value&key=value in their order, values percent-encoded, keys as they are."""
    return F.array_join(F.transform(F.map_entries(entry), lambda e: F.concat(e["key"], F.lit("="), percent_encode(e["value"]))), "&")


def header_value(headers: Column, name: str) -> Column:
    """A header's value in lower case, whatever the case of its name."""
    hit = F.map_values(F.map_filter(headers, lambda k, _: F.lower(k) == name.lower()))
    return F.lower(F.get(hit, F.lit(0)))


def origin_label(c: Column, names: dict[str, str]) -> Column:
    """The canonical label of a source: compared without case, blanks and underscores; other labels stay."""
    key = F.regexp_replace(F.lower(c), r"[_\s]", "")
    out = c
    for k, v in names.items():
        out = F.when(key == F.lit(k.lower().replace("_", "").replace(" ", "")), F.lit(v)).otherwise(out)
    return out


def numbered(prefix: str, n: Column, digits: int = 3) -> Column:
    """claim_001 and the like."""
    return F.concat(F.lit(f"{prefix}_"), F.when(F.length(n.cast("string")) >= digits, n.cast("string")).otherwise(F.lpad(n.cast("string"), digits, "0")))


def citation(title: Column, year: Column, pages: Column, url: Column) -> Column:
    """'Title. - 2021. Pages 2-3, 5. https://…' from the parts that there are."""
    return F.concat_ws(". ", title, F.concat(F.lit("- "), year.cast("string")), F.when(F.length(pages) > 0, F.concat(F.lit("Pages "), pages)), url)


def bitstream_url(url: Column, host: str) -> Column:
    """A repository's viewer address of a file to its API's content address, or null."""
    uuid = r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}"
    found = F.regexp_extract(F.trim(url), rf"(?i)^https?://(?:www\.)?{host.replace('.', '[.]')}/bitstreams/({uuid})/(?:download|content)(?:[?#]|$)", 1)
    return F.when(found != "", F.concat(F.lit(f"https://{host}/server/api/core/bitstreams/"), found, F.lit("/content")))


def expanded_urls(url: Column, searches: Column, placeholder: str = "{search}") -> Column:
    """An address once for each (encoded) search, or itself without searches; an error where only one of placeholder and searches is there."""
    some, marked = F.coalesce(F.size(searches), F.lit(0)) > 0, F.contains(url, F.lit(placeholder))
    fine = F.when(some, F.transform(searches, lambda s: F.replace(url, F.lit(placeholder), s))).otherwise(F.array(url))
    return F.when(some == marked, fine).otherwise(F.raise_error(F.concat(F.lit("searches and placeholder don't agree: "), url)).cast("array<string>"))


def extension(kind: Column) -> Column:
    """'.pdf' and the like from a file type."""
    return F.concat(F.lit("."), F.lower(kind))


def decoded(c: Column) -> Column:
    """Bytes as UTF-8 text, wrong ones replaced."""
    return F.make_valid_utf8(c.cast("string"))
