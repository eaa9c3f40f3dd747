"""HTML pages as a corpus, in built-in expressions: what a crawler's page store is turned into before indexing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The five basic entities; the ampersand comes last, so nothing is unescaped twice.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
#: White space of HTML and the no-break space.
SPACE = r"[ \t\n\f\r\x0B\u00A0]+"


def _plain(text: Column) -> Column:
    for entity, sign in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(text, SPACE, " "))


def html_title(html: Column | str) -> Column:
    """The first title; null where there is none."""
    html = F.col(html) if isinstance(html, str) else html
    title = F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1)
    return F.when(title != "", _plain(title))


def html_text(html: Column | str) -> Column:
    """The text: without head, scripts, styles and comments, every tag a blank, entities unescaped, white space run together."""
    html = F.col(html) if isinstance(html, str) else html
    own = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style|head)\b[^>]*>.*?</\1\s*>", " ")
    return _plain(F.regexp_replace(own, r"(?s)<[^>]*>", " "))


def from_html(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``title`` and ``content`` in place of its HTML. Null HTML gives null content."""
    return pages.withColumns({"title": html_title(html), "content": html_text(html)}).drop(html)
