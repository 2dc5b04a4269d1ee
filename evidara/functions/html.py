"""HTML expressions that stay in the JVM."""

from __future__ import annotations

from html import unescape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# fixed values: elements that begin a new paragraph
BLOCKS = (
    "p", "div", "section", "article", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "header", "footer", "main", "aside", "nav",
    "figure", "figcaption", "br", "hr", "li", "ol", "ul", "dl", "dt", "dd", "table", "tr",
)


@F.pandas_udf(StringType())
def decode_references(text: pd.Series) -> pd.Series:
    """Character references, named and numbered, as the characters themselves."""
    return text.map(lambda t: unescape(t) if t is not None and "&" in t else t)


def closed_references(html: Column) -> Column:
    """The page with each & that begins no reference closed by a semicolon written out, so that decoding leaves it as it stands."""
    return F.regexp_replace(html, r"&(?!(?:[a-zA-Z][a-zA-Z0-9]*|#[0-9]+|#[xX][0-9a-fA-F]+);)", "&amp;")


def page_text(html: Column) -> Column:
    """Visible text with a blank line between paragraphs.

    Scripts and styles go with what they hold, block elements part paragraphs, other tags become spaces, references are
    decoded, and no space stands before closing punctuation. A mark that no page holds keeps the breaks apart from other
    white space meanwhile.
    """
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1>", " ")
    parted = F.regexp_replace(bare, r"(?i)</?(?:" + "|".join(BLOCKS) + r")\b[^>]*>", " \u0001 ")
    text = F.regexp_replace(decode_references(F.regexp_replace(parted, "<[^>]+>", " ")), r"(?U)\s+", " ")
    close = F.regexp_replace(text, r" ([,.;:!?)])", "$1")
    return F.btrim(F.regexp_replace(close, "\u0001", "\n\n"), F.lit(" \n"))


def html_to_text(html: Column) -> Column:
    """Visible text: scripts and styles out, tags to spaces, the five basic entities decoded, white space normalised."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>", " "), r"(?is)<style[^>]*>.*?</style>", " ")
    text = F.regexp_replace(bare, r"(?s)<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'(?i)<a\s[^>]*href="([^"]*)"'), F.lit(1))
