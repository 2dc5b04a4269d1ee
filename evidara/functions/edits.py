"""Edits of documents with front matter, as expressions of their text; the caller writes what changed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidara.functions.text import let, occurrences


def _front(text: Column) -> Column:
    return F.regexp_extract(text, r"(?s)\A---[^\S\n]*\n(.*?\n|)---[^\S\n]*(?:\n|\z)", 1)


def has_front(text: Column) -> Column:
    return text.rlike(r"(?s)\A---[^\S\n]*\n(?:.*?\n|)---[^\S\n]*(?:\n|\z)")


def _with_front(text: Column, front: Column) -> Column:
    rest = F.regexp_replace(text, r"(?s)\A---[^\S\n]*\n(?:.*?\n|)(?=---[^\S\n]*(?:\n|\z))", "")
    return F.concat(F.lit("---\n"), front, rest)


def set_checked(text: Column, day: Column) -> Column:
    """The text with last_checked set to the day, in its place or as the last line of the front matter; unchanged without front matter."""
    line = F.concat(F.lit('last_checked: "'), F.date_format(day, "yyyy-MM-dd"), F.lit('"'))
    changed = lambda front: F.when(front.rlike(r"(?m)^last_checked\s*:"), F.regexp_replace(front, F.lit(r"(?m)^last_checked\s*:.*$"), line)).otherwise(F.concat(front, line, F.lit("\n")))
    return let(text, lambda t: F.when(has_front(t), _with_front(t, let(_front(t), changed))).otherwise(t))


def add_field(text: Column, name: str, value: Column, after: tuple[str, ...]) -> Column:
    """The text with a field added behind the first of the named ones that it has, else at the end of the front matter.

    A field that is there already is left as it is, and so is a text without front matter or with a null value.
    """
    line = F.concat(F.lit(f"{name}: "), value, F.lit("\n"))

    def grown(front: Column) -> Column:
        changed = F.concat(front, line)
        for before in reversed(after):
            own = F.regexp_substr(front, F.lit(rf"(?m)^{before}\s*:.*\n"))
            at = F.instr(front, own) + F.length(own)
            changed = F.when(own.isNotNull(), F.concat(F.substring(front, F.lit(1), at - 1), line, F.substring(front, at, F.length(front)))).otherwise(changed)
        return F.when(front.rlike(rf"(?m)^{name}\s*:"), front).otherwise(changed)

    return let(text, lambda t: F.when(has_front(t) & value.isNotNull(), _with_front(t, let(_front(t), grown))).otherwise(t))


def add_feed(text: Column, url: Column) -> Column:
    """rss_feed behind website, else behind news_page."""
    return add_field(text, "rss_feed", url, ("website", "news_page"))


def add_calendar(text: Column, url: Column) -> Column:
    """ics_feed behind rss_feed, else behind website; webcal addresses become https ones."""
    return add_field(text, "ics_feed", F.regexp_replace(url, "(?i)^webcal://", "https://"), ("rss_feed", "website"))


def set_block(text: Column, name: str, lines: Column, after: tuple[str, ...] = ("website",)) -> Column:
    """The text with a field of several lines (its name's line first, each line ended) in place of the one it has, else added.

    The field's old lines are its name's and the indented, not empty ones that follow. It is added as in ``add_field``.
    Unchanged without front matter or with null lines.
    """

    def grown(front: Column) -> Column:
        old = F.regexp_substr(front, F.lit(rf"(?m)^{name}\s*:.*\n(?:  .*\S.*\n)*"))
        begin = F.instr(front, old)
        swapped = F.concat(F.substring(front, F.lit(1), begin - 1), lines, F.substring(front, begin + F.length(old), F.length(front)))
        added = F.concat(front, lines)
        for before in reversed(after):
            own = F.regexp_substr(front, F.lit(rf"(?m)^{before}\s*:.*\n"))
            at = F.instr(front, own) + F.length(own)
            added = F.when(own.isNotNull(), F.concat(F.substring(front, F.lit(1), at - 1), lines, F.substring(front, at, F.length(front)))).otherwise(added)
        return F.when(old.isNotNull(), swapped).otherwise(added)

    return let(text, lambda t: F.when(has_front(t) & lines.isNotNull(), _with_front(t, let(_front(t), grown))).otherwise(t))


def set_logo(text: Column, path: Column, force: bool = False) -> Column:
    """logo behind website; one that is there is replaced only with force."""
    line = F.concat(F.lit("logo: "), path, F.lit("\n"))
    return set_block(text, "logo", line) if force else add_field(text, "logo", path, ("website",))


def replace_single(text: Column, old: Column, new: Column) -> Column:
    """The text with the one occurrence of old replaced; null where there is none or more than one, since nothing is guessed."""
    at = F.instr(text, old)
    return F.when(occurrences(text, old) == 1, F.concat(F.substring(text, F.lit(1), at - 1), new, F.substring(text, at + F.length(old), F.length(text))))
