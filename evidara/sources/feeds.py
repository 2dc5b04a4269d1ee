"""Feeds, calendars and sitemaps as rows, from their raw text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def any_date(text: Column) -> Column:
    """A date from RFC 2822, ISO or compact text; null for anything else."""
    rfc = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},\s*", "")
    return F.coalesce(
        F.try_to_timestamp(F.regexp_extract(rfc, r"^(\d{1,2} [A-Za-z]{3} \d{4})", 1), F.lit("d MMM yyyy")).cast("date"),
        F.try_to_timestamp(F.regexp_extract(text, r"^\s*(\d{4}-\d{2}-\d{2})", 1), F.lit("yyyy-MM-dd")).cast("date"),
        F.try_to_timestamp(F.regexp_extract(text, r"^\s*(\d{8})", 1), F.lit("yyyyMMdd")).cast("date"),
    )


def calendar_events(calendars: DataFrame, text: str = "text") -> DataFrame:
    """One row for each VEVENT: date, end_date (inclusive, only if later), title, url, uid. Folded lines are joined first."""
    whole = F.regexp_replace(F.regexp_replace(F.col(text), "\r\n", "\n"), "\n[ \t]", "")
    parts = calendars.withColumn("event", F.explode(F.regexp_extract_all(whole, F.lit(r"(?s)BEGIN:VEVENT\n(.*?)END:VEVENT"), F.lit(1))))
    field = lambda name: F.regexp_extract("event", rf"(?m)^{name}(?:;[^:\n]*)?:(.*)$", 1)
    plain = lambda c: F.regexp_replace(F.replace(c, F.lit("\\n"), F.lit(" ")), r"\\([,;\\])", "$1")
    start, end = any_date(F.left(field("DTSTART"), F.lit(8))), any_date(F.left(field("DTEND"), F.lit(8)))
    last = F.when(field("DTEND").rlike("^[0-9]{8}$"), F.date_sub(end, 1)).otherwise(end)
    keep = [c for c in calendars.columns if c != text]
    return parts.select(*keep, start.alias("date"), F.when(last > start, last).alias("end_date"), plain(field("SUMMARY")).alias("title"), field("URL").alias("url"), field("UID").alias("uid")).where("date is not null")


_ITEM = "array<struct<title string, link string, pubDate string, date string>>"
_ENTRY = "array<struct<title string, link array<struct<_href string>>, id string, updated string, published string>>"
_MARK = "array<struct<loc string, lastmod string>>"
#: Feeds of both kinds and sitemaps of both kinds, by their elements' local names. Items lie in the channel, or beside it.
XML = f"channel struct<item {_ITEM}>, item {_ITEM}, entry {_ENTRY}, url {_MARK}, sitemap {_MARK}, malformed string"
#: Of a sitemap index so many children count.
INDEX_CHILDREN = 5


def read_xml(text: Column) -> Column:
    """The parts of a feed or sitemap; ``malformed`` holds what is no XML. Prefixes of names don't matter."""
    return F.from_xml(F.trim(text), XML, {"mode": "PERMISSIVE", "ignoreNamespace": "true", "columnNameOfCorruptRecord": "malformed"})


def _list(column: Column, kind: str) -> Column:
    return F.coalesce(column, F.array().cast(kind))


def feed_items(feeds: DataFrame, text: str = "text") -> DataFrame:
    """One row for each item of an RSS or entry of an Atom feed: date, title, link. Text that is no XML has none."""
    keep = [c for c in feeds.columns if c != text]
    xml = F.col("_xml")
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    items = F.transform(F.concat(_list(xml["channel"]["item"], _ITEM), _list(xml["item"], _ITEM)), lambda i: F.struct(F.coalesce(some(i["pubDate"]), some(i["date"])).alias("date"), some(i["title"]).alias("title"), some(i["link"]).alias("link")))
    href = lambda e: F.get(F.filter(F.transform(_list(e["link"], "array<struct<_href string>>"), lambda link: some(link["_href"])), lambda h: h.isNotNull()), F.lit(0))
    entries = F.transform(_list(xml["entry"], _ENTRY), lambda e: F.struct(F.coalesce(some(e["updated"]), some(e["published"])).alias("date"), some(e["title"]).alias("title"), F.coalesce(href(e), some(e["id"])).alias("link")))
    each = feeds.withColumn("_xml", read_xml(F.col(text))).select(*keep, F.explode(F.concat(items, entries)).alias("_item"))
    return each.select(*keep, any_date(F.col("_item.date")).alias("date"), F.col("_item.title").alias("title"), F.col("_item.link").alias("link"))


def latest_item(items: DataFrame, *keys: str) -> DataFrame:
    """The item with the latest date of each feed; of equal dates the one whose title, then link, comes last. Items without a date don't count."""
    best = F.max(F.struct("date", "title", "link")).alias("best")
    return items.where("date is not null").groupBy(*keys).agg(best).select(*keys, "best.*")


def latest_past_event(events: DataFrame, as_of: Column, *keys: str) -> DataFrame:
    """The last event of each calendar that is not later than as_of."""
    best = F.max(F.struct("date", "title", "url", "uid")).alias("best")
    return events.where(F.col("date") <= as_of).groupBy(*keys).agg(best).select(*keys, "best.*")


def coming_events(events: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Events that are not over on as_of and begin within so many days of it."""
    return events.where((F.coalesce("end_date", "date") >= as_of) & (F.col("date") <= F.date_add(as_of, days)))


# fixed values: content types of feeds, and how their bodies begin
FEED_TYPES = ("application/rss+xml", "application/atom+xml", "application/feed+json", "application/xml", "text/xml", "text/rss+xml", "text/atom+xml")
FEED_BEGINNINGS = r"^\s*(?:<\?xml|<rss|<feed|\{\"version\": ?\"https://jsonfeed\.org)"


def looks_like_feed(content_type: Column, body: Column) -> Column:
    """By the content type, else by how the body begins."""
    named = F.exists(F.array(*map(F.lit, FEED_TYPES)), lambda t: F.contains(F.lower(F.coalesce(content_type, F.lit(""))), t))
    return named | F.coalesce(F.left(body, F.lit(512)).rlike(FEED_BEGINNINGS), F.lit(False))


def sitemap_urls(sitemaps: DataFrame, text: str = "text") -> DataFrame:
    """One row for each url of a sitemap: loc and lastmod."""
    keep = [c for c in sitemaps.columns if c != text]
    each = sitemaps.select(*keep, F.explode(read_xml(F.col(text))["url"]).alias("_url"))
    return each.select(*keep, F.trim("_url.loc").alias("loc"), any_date(F.col("_url.lastmod")).alias("lastmod"))


def sitemap_lastmod(text: Column) -> Column:
    """The latest lastmod of a sitemap's urls, or of the first INDEX_CHILDREN children of a sitemap index; null without any."""
    xml = read_xml(text)
    marks = F.coalesce(F.slice(xml["sitemap"], 1, INDEX_CHILDREN), xml["url"])
    return F.array_max(F.transform(marks, lambda m: any_date(F.trim(m["lastmod"]))))
