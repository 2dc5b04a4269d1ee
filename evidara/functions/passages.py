"""Where a quote stands in a page: its own spelling there, its paragraph, what surrounds it, and how to mend it."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from evidara.functions.text import let, normalize_ws, occurrences, visible_ws

WHOLE_PARAGRAPH = 1000
SURROUNDINGS = 150
AROUND = 80


def passage(page: Column, quote: Column, verbatim: bool = False) -> Column:
    """The quote as the page itself spells it, whatever white space stands between its words; null where it doesn't stand there.

    With ``verbatim`` the quote's own spelling, where the page has it, goes before an earlier passage with other white space.
    """
    words = F.array_join(F.split(normalize_ws(quote), " "), "\\E\\s+\\Q")
    loose = F.regexp_substr(page, F.concat(F.lit("(?U)\\Q"), words, F.lit("\\E")))
    return F.when((F.length(quote) > 0) & (F.length(page) > 0), F.when(F.contains(page, quote), quote).otherwise(loose) if verbatim else loose)


def span(page: Column, quote: Column, verbatim: bool = False) -> Column:
    """Struct (start, end) of the first passage in the page's own characters, from 0, the end exclusive."""
    start = lambda found: F.instr(page, found) - 1
    return let(passage(page, quote, verbatim), lambda found: F.when(found.isNotNull(), F.struct(start(found).alias("start"), (start(found) + F.length(found)).alias("end"))))


def _around(page: Column, quote: Column, verbatim: bool = False) -> Column:
    """Struct (before, found, after) of the first passage; null without one."""
    cut = lambda found, at: F.struct(F.substring(page, F.lit(1), at - 1).alias("before"), found.alias("found"), F.substring(page, at + F.length(found), F.length(page)).alias("after"))
    return let(passage(page, quote, verbatim), lambda found: F.when(found.isNotNull(), let(F.instr(page, found), lambda at: cut(found, at))))


def _paragraph(around: Column) -> Column:
    return F.concat(F.substring_index(around["before"], "\n\n", -1), around["found"], F.substring_index(around["after"], "\n\n", 1))


def paragraph(page: Column, quote: Column) -> Column:
    """The text between the blank lines before and after the passage."""
    return let(_around(page, quote), _paragraph)


def paragraph_hash(page: Column, quote: Column) -> Column:
    return F.sha2(normalize_ws(paragraph(page, quote)), 256)


def surroundings(page: Column, quote: Column, verbatim: bool = False) -> Column:
    """Struct (prefix, suffix, text, sha256): 150 characters on either side, the paragraph if it is short, and a digest.

    The digest is that of the paragraph, or of prefix, quote and suffix where it is too long. Null without a passage.
    """

    def known(around: Column) -> Column:
        before, after = F.right(around["before"], F.lit(SURROUNDINGS)), F.left(around["after"], F.lit(SURROUNDINGS))
        text = let(normalize_ws(_paragraph(around)), lambda whole: F.when(F.length(whole) <= WHOLE_PARAGRAPH, whole))
        return F.struct(normalize_ws(before).alias("prefix"), normalize_ws(after).alias("suffix"), text.alias("text"))

    def with_digest(s: Column) -> Column:
        digest = F.sha2(F.coalesce(s["text"], F.concat(s["prefix"], quote, s["suffix"])), 256)
        return F.struct(s["prefix"].alias("prefix"), s["suffix"].alias("suffix"), s["text"].alias("text"), digest.alias("sha256"))

    return let(_around(page, quote, verbatim), lambda around: F.when(around.isNotNull(), let(known(around), with_digest)))


def mended_spacing(page: Column, quote: Column) -> Column:
    """The page's spelling of a quote from which it differs by spaces only; null if there is nothing to mend or no single place.

    A pattern of the quote's characters with optional spaces between them finds the place.
    """
    loose = lambda plain: F.regexp_replace(F.replace(plain, F.lit(" "), F.lit("")), "(?s)(.)", "\\\\Q$1\\\\E *")

    def mend(both: Column) -> Column:
        text, plain = both["text"], both["plain"]
        mended = let(F.rtrim(F.regexp_substr(text, loose(plain))), lambda found: F.when((found != plain) & (occurrences(text, found) == 1), found))
        return F.when((F.length(plain) > 0) & ~F.contains(text, plain), mended)

    return let(F.struct(normalize_ws(page).alias("text"), normalize_ws(quote).alias("plain")), mend)


def _longest_shared(text: str, wanted: str) -> tuple[int, int, int]:
    """Where in the text, where in the wanted, and how long: the longest run that both hold, the first in the text, then in the wanted.

    Runs of the wanted are looked for in the text, each at least one longer than the best so far, so there are at most
    three look-ups for each of its characters, however long the text is.
    """
    size = 0
    for at in range(len(wanted)):
        while at + size < len(wanted) and wanted[at : at + size + 1] in text:
            size += 1
    places = ((text.find(wanted[at : at + size]), at) for at in range(len(wanted) - size + 1))
    return *min(place for place in places if place[0] >= 0), size


def closest_normalized(min_ratio: float = 0.6):
    """closest for texts whose white space is normalised already.

    It counts as not deterministic, so that the optimizer neither repeats it nor moves it before a filter.
    """

    @F.pandas_udf("passage string, ratio double, shared string, changes array<struct<page:string,quote:string>>")
    def compare(page: pd.Series, quote: pd.Series) -> pd.DataFrame:
        rows = []
        for text, wanted in zip(page, quote, strict=True):
            begin, at, size = _longest_shared(text, wanted) if text and wanted else (0, 0, 0)
            spare = max(len(wanted or "") - size, 0)
            first = max(begin - spare // 2, 0)
            window = (text or "")[first : first + len(wanted or "") + spare // 2]
            ratio = SequenceMatcher(None, window, wanted or "", autojunk=False).ratio() if size else 0.0
            if not size or ratio < min_ratio:
                rows.append((None, None, None, None))
                continue
            near, own = (s[max(i - AROUND, 0) : i + size + AROUND] for s, i in ((text, begin), (wanted, at)))
            steps = SequenceMatcher(None, near, own, autojunk=False).get_opcodes()
            rows.append((window, ratio, wanted[at : at + size], [{"page": near[a:b], "quote": own[c:d]} for kind, a, b, c, d in steps if kind != "equal"]))
        return pd.DataFrame(rows, columns=["passage", "ratio", "shared", "changes"])

    return compare.asNondeterministic()


def closest(min_ratio: float = 0.6):
    """A function of (page, quote) -> struct (passage, ratio, shared, changes): what resembles the quote most, to help where it is missing.

    It never decides a verdict. The longest run in common, ``shared``, is widened to about the quote's length; where page
    or quote is empty or null, nothing is shared, or the likeness is below min_ratio, the answer is null. ``changes`` are
    the pairs (page, quote) of differing runs up to 80 characters around it. The search grows with the page's length,
    the comparisons with the quote's alone.
    """
    compare = closest_normalized(min_ratio)
    return lambda page, quote: compare(normalize_ws(page), normalize_ws(quote))


def difference_lines(changes: Column) -> Column:
    """Differing runs as lines, the page's behind a minus and the quote's behind a plus, with visible white space; empty without any."""
    side = lambda sign, run: F.concat(F.lit(f"    {sign} "), F.when(run == "", "\u2205").otherwise(visible_ws(run)))
    return F.array_join(F.transform(changes, lambda c: F.concat(side("-", c["page"]), F.lit("\n"), side("+", c["quote"]))), "\n")
