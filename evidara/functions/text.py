"""Text expressions shared by the evidence queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often use mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def normalize_ws(text: Column) -> Column:
    """Every run of Unicode white space becomes one space, ends trimmed, and no space stands beside a parenthesis' inner edge."""
    spaced = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.regexp_replace(F.regexp_replace(spaced, r"\( ", "("), r" \)", ")")


def visible_ws(text: Column) -> Column:
    """Spaces, tabs and line ends as signs that can be seen."""
    return F.translate(text, " \t\n", "\u2423\u2192\u2424")


def occurrences(haystack: Column, needle: Column) -> Column:
    """Non-overlapping occurrences of needle in haystack; zero where the needle is empty or either side is null."""
    shrunk = F.length(F.replace(haystack, needle, F.lit("")))
    count = (F.length(haystack) - shrunk) / F.length(needle)
    return F.when(F.length(needle) > 0, F.coalesce(count.cast("long"), F.lit(0))).otherwise(F.lit(0).cast("long"))


def ellipsis_parts(quote: Column) -> tuple[Column, Column]:
    """What stands before the first three dots and after the last; null for both unless each side holds something."""
    parts = F.split(normalize_ws(quote), r"\.\.\.")
    head, tail = F.trim(F.get(parts, F.lit(0))), F.trim(F.element_at(parts, -1))
    both = (F.size(parts) > 1) & (head != "") & (tail != "")
    return F.when(both, head), F.when(both, tail)


def holds_normalized(text: Column, quote: Column) -> Column:
    """holds_quote for a page whose white space is normalised already."""
    plain = normalize_ws(quote)
    head, tail = ellipsis_parts(quote)
    at = F.instr(text, head)
    after = F.substring(text, at + F.length(head), F.length(text))
    there = F.when(head.isNull(), F.contains(text, plain)).otherwise((at > 0) & F.contains(after, tail))
    return F.coalesce((F.length(quote) > 0) & there, F.lit(False))


def holds_quote(page: Column, quote: Column) -> Column:
    """Whether a page, white space normalised, holds the quote, or first its part before three dots and later the one after."""
    return F.coalesce(F.length(page) > 0, F.lit(False)) & holds_normalized(normalize_ws(page), quote)


def slug(title: Column) -> Column:
    """Lower case, without signs, words joined by single dashes."""
    bare = F.regexp_replace(F.lower(F.trim(title)), r"[^a-z0-9_\s-]", "")
    return F.regexp_replace(F.regexp_replace(bare, r"[\s_-]+", "-"), "^-+|-+$", "")


def slug_title(name: Column) -> Column:
    """The words of a slug with capitals."""
    return F.initcap(F.regexp_replace(name, "[-_]+", " "))


def csv_field(value: Column) -> Column:
    """Quoted where it holds a comma, a quotation mark or a line break, with quotation marks doubled."""
    doubled = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(F.rlike(value, F.lit('[,"\n\r]')), doubled).otherwise(value)


def hue(name: Column) -> Column:
    """A steady colour for a tag: the 32-bit shift hash of its characters (h * 31 + c), without sign, by 360."""
    codes = F.transform(F.split(name, ""), lambda c: F.ascii(c).cast("long"))
    wrapped = lambda h: F.pmod(h + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)
    return (F.abs(F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: wrapped(h * 31 + c))) % 360).cast("int")


def clock(time: Column) -> Column:
    """A time of day as read aloud: 12 hours, minutes only where there are any, AM or PM."""
    return F.when(F.minute(time) == 0, F.date_format(time, "h a")).otherwise(F.date_format(time, "h:mm a"))


def slug_keywords(name: Column, stop: tuple[str, ...]) -> Column:
    """The different words of a slug that are longer than two letters and no stop words."""
    return F.array_distinct(F.filter(F.split(F.lower(name), r"[^a-z0-9]+"), lambda w: (F.length(w) > 2) & ~w.isin(*stop)))


def cjk_share(text: Column) -> Column:
    """The share of Han characters (unified, extension A, compatibility), kana and hangul left aside; 0 for an empty text."""
    n = F.length(text)
    return F.when(n > 0, F.regexp_count(text, F.lit("[\\u3400-\\u4dbf\\u4e00-\\u9fff\\uf900-\\ufaff]")) / n).otherwise(F.lit(0.0))


def whole_sentences(text: Column, limit: int) -> Column:
    """The text's first sentences, each closed by a full stop, as long as what precedes one and itself don't exceed the limit."""
    start = F.struct(F.lit("").alias("text"), F.lit(True).alias("open"))

    def add(state: Column, sentence: Column) -> Column:
        fits = state["open"] & (F.length(state["text"]) + F.length(sentence) <= limit)
        return F.struct(F.when(fits, F.concat(state["text"], sentence, F.lit(". "))).otherwise(state["text"]).alias("text"), fits.alias("open"))

    return F.trim(F.aggregate(F.split(text, r"\n |\. "), start, add, lambda s: s["text"]))


def locale_order(label: Column, descending: bool = False) -> Column:
    """A sort key by the rules of languages, whatever the case: accents beside their letters, not after z."""
    collated = F.collate(label, "UNICODE_CI")
    return collated.desc() if descending else collated.asc()
