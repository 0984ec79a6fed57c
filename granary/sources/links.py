"""Links of a page as a table function, for SQL and lateral joins."""

from __future__ import annotations

import html
import re
from urllib.parse import urljoin

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

_LINK = re.compile(r"""<a\s[^>]*?href\s*=\s*["']([^"']*)["'][^>]*>(.*?)(?=</a\s*>|<a\s|\Z)""", re.I | re.S)
_TAG = re.compile(r"<[^>]*>")


@udtf(returnType="pos int, href string, url string, title string")
class PageLinks:
    """page_links(url, body): each anchor in page order, from 0, with its address against the page's and its text; null bodies have none."""

    def eval(self, url: str, body: str):
        for pos, m in enumerate(_LINK.finditer(body or "")):
            href = m[1]
            try:
                whole = urljoin(url, html.unescape(href).strip()) if url is not None else None
            except ValueError:  # not an address
                whole = None
            yield pos, href, whole, " ".join(html.unescape(_TAG.sub(" ", m[2])).split()) or None


def register(spark: SparkSession) -> None:
    """Makes page_links known to SQL."""
    spark.udtf.register("page_links", PageLinks)
