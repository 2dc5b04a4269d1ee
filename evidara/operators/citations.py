"""Citations by URL, with what an earlier list knew of them and of each quote."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a quote keeps from the earlier list.
CARRIED = ("status", "last_verified", "verified_by", "context")
ARCHIVE_NAME = "Internet Archive Wayback Machine"


def merge_citations(items: DataFrame, existing: DataFrame, archive: DataFrame) -> DataFrame:
    """A row for each cited URL: id, type, url, title, accessed, archive, archive_location, url_status, evidence.

    ``items`` are (url, title, quote, place), place being the order of scanning; only web addresses with a quote count.
    ``existing`` is an earlier result, (url, title, accessed, evidence) with the quotes nested; of rows that repeat a URL
    one is read. The title is the first that isn't empty, else the earlier one; ``accessed`` and what is known of a quote
    are carried forward by URL and by (URL, quote); URLs and quotes that are cited no longer vanish. Where the
    page is archived and whether it lives comes from ``archive`` (url, archive_url, url_status) alone, never from the
    earlier list. Empty texts count as missing.

    Quotes are matched as rows, and nested only at the end, so a URL cited by many rows is aggregated before the shuffle.
    """
    some = lambda c: F.nullif(c, F.lit(""))
    cited = items.where(F.col("url").rlike("^https?://") & some(F.col("quote")).isNotNull())
    titles = cited.groupBy("url").agg(F.min_by(some(F.col("title")), F.when(some(F.col("title")).isNotNull(), F.col("place"))).alias("new_title"))
    one = existing.groupBy("url").agg(F.max(F.struct("accessed", "title", "evidence")).alias("old"))
    places = archive.groupBy("url").agg(F.max(F.struct(some(F.col("archive_url")).alias("archive_url"), some(F.col("url_status")).alias("url_status"))).alias("place"))

    told = one.select("url", F.posexplode("old.evidence").alias("at", "e")).groupBy("url", F.col("e.quote").alias("quote")).agg(F.max_by("e", "at").alias("e"))
    quotes = cited.select("url", "quote").distinct().join(told, ["url", "quote"], "left")
    row = F.struct("quote", F.lit("quote-match").alias("type"), *[F.nullif(F.col(f"e.{name}"), F.lit("")).alias(name) for name in CARRIED])
    evidence = quotes.groupBy("url").agg(F.array_sort(F.collect_list(row)).alias("evidence"))

    merged = titles.join(evidence, "url").join(one, "url", "left").join(places, "url", "left")
    location = F.col("place.archive_url")
    return merged.select(
        F.left(F.md5("url"), F.lit(8)).alias("id"), F.lit("webpage").alias("type"), "url", F.coalesce("new_title", "old.title", F.lit("")).alias("title"), F.nullif(F.col("old.accessed"), F.lit("")).alias("accessed"),
        F.when(location.isNotNull(), ARCHIVE_NAME).alias("archive"), location.alias("archive_location"), F.col("place.url_status").alias("url_status"), "evidence",
    )
