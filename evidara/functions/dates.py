"""Dates and times that pages show."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidara.functions.urls import path
from evidara.sources.feeds import any_date

# fixed values: English months, whole or by their first letters, and the years looked for
MONTH = r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\.?"
YEAR = r"20[0-3]\d"


def strict_iso(text: Column) -> Column:
    """A date only where the whole text, quotation marks aside, is one."""
    bare = F.btrim(F.trim(text), F.lit("\"'"))
    return F.when(bare.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(bare, F.lit("yyyy-MM-dd")).cast("date"))


def strict_time(text: Column) -> Column:
    """Minutes after midnight of H:MM or HH:MM; null for anything else."""
    fits = F.trim(text).rlike(r"^(?:[01]?\d|2[0-3]):[0-5]\d$")
    return F.when(fits, F.split_part(F.trim(text), F.lit(":"), F.lit(1)).cast("int") * 60 + F.split_part(F.trim(text), F.lit(":"), F.lit(2)).cast("int"))


def _day(text: Column, form: str) -> Column:
    return F.try_to_timestamp(text, F.lit(form)).cast("date")


def _past(days: Column, as_of: Column) -> Column:
    return F.array_distinct(F.filter(days, lambda d: d.isNotNull() & (F.year(d) >= 2000) & (d <= as_of)))


def url_date(url: Column, as_of: Column) -> Column:
    """The day that the path gives as /year/month/day, else the first of the month of /year/month; from 2000 on, not later than as_of."""
    steps = F.split(path(url), "/")
    numbers = lambda *widths: F.transform(
        F.filter(F.sequence(F.lit(0), F.size(steps) - 1), lambda i: F.forall(F.array(*(F.coalesce(F.get(steps, i + n).rlike(f"^[0-9]{{{w}}}$"), F.lit(False)) for n, w in enumerate(widths))), lambda fits: fits)),
        lambda i: F.array_join(F.slice(steps, i + 1, F.lit(len(widths))), "/"),
    )
    full, month = F.get(numbers("4", "1,2", "1,2"), F.lit(0)), F.get(numbers("4", "1,2"), F.lit(0))
    day = F.coalesce(_day(full, "yyyy/M/d"), _day(F.concat(month, F.lit("/1")), "yyyy/M/d"))
    return F.when((F.year(day) >= 2000) & (day <= as_of), day)


def text_dates(text: Column, as_of: Column) -> Column:
    """Different days in English words, month first, then day first, then months alone (their first day); not later than as_of."""

    def found(pattern: str, form: str, *groups: str) -> Column:
        hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        parts = lambda hit: [F.initcap(F.left(F.regexp_extract(hit, "([A-Za-z]+)", 1), F.lit(3))) if g == "month" else F.regexp_extract(hit, rf"({YEAR})$" if g == "year" else r"(?<!\d)(\d{1,2})(?!\d)", 1) for g in groups]
        return F.transform(hits, lambda hit: _day(F.concat_ws(" ", *parts(hit)), form))

    month_first = found(rf"(?i)(?<![a-zA-Z]){MONTH}\s+\d{{1,2}},?\s+{YEAR}(?!\d)", "MMM d yyyy", "month", "day", "year")
    day_first = found(rf"(?i)(?<!\d)\d{{1,2}}\s+{MONTH},?\s+{YEAR}(?!\d)", "MMM d yyyy", "month", "day", "year")
    month_only = F.transform(found(rf"(?i)(?<![a-zA-Z]){MONTH}\s+{YEAR}(?!\d)", "MMM yyyy", "month", "year"), lambda d: d)
    return _past(F.concat(month_first, day_first, month_only), as_of)


def markup_dates(html: Column, as_of: Column) -> Column:
    """Structs (date, title) of what a page's markup dates, best first: JSON-LD, meta tags, time elements.

    JSON-LD blocks give datePublished, else dateModified, for the block itself, its list entries and its graph's.
    """
    kind = "struct<datePublished:string,dateModified:string,headline:string,name:string>"
    blocks = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))
    items = F.flatten(F.transform(blocks, lambda b: F.concat(
        F.array(F.from_json(b, kind)), F.coalesce(F.from_json(b, f"array<{kind}>"), F.array()), F.coalesce(F.from_json(b, f"struct<`@graph`:array<{kind}>>")["@graph"], F.array()))))
    linked = F.transform(F.filter(items, lambda i: i.isNotNull()), lambda i: F.struct(any_date(F.coalesce(i["datePublished"], i["dateModified"])).alias("date"), F.trim(F.coalesce(i["headline"], i["name"], F.lit(""))).alias("title")))
    plain = lambda found: F.transform(found, lambda t: F.struct(any_date(t).alias("date"), F.lit("").alias("title")))
    meta = plain(F.regexp_extract_all(html, F.lit(r"(?i)<meta[^>]*(?:article:published_time|article:modified_time|datePublished|dateModified)[^>]*content=[\"']([^\"']*)[\"']"), F.lit(1)))
    times = plain(F.regexp_extract_all(html, F.lit(r"(?i)<time[^>]*datetime=[\"']([^\"']*)[\"']"), F.lit(1)))
    return F.filter(F.concat(linked, meta, times), lambda d: d["date"].isNotNull() & (d["date"] <= as_of))


def latest(dated: Column) -> Column:
    """The struct with the latest date; of equal dates the first in the array."""
    return F.reduce(dated, F.get(dated, F.lit(0)), lambda best, d: F.when(d["date"] > best["date"], d).otherwise(best))
