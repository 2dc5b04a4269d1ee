"""All the evidence that documents hold, of three kinds in one table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidara.operators import footnotes

ITEM = ("url", "quote", "label", "kind", "path")


def event_evidence(records: DataFrame, slugs: list[str] | None = None) -> DataFrame:
    """Quotes of events, from path, slug and the ``record`` that ``frontmatter.parse_records`` gives.

    Events without URL or quote, and those with a proof warning, give nothing; neither does an index page.
    """
    chosen = records.where("slug <> 'index'")
    chosen = chosen if slugs is None else chosen.where(F.col("slug").isin(*slugs))
    events = chosen.select("path", "slug", F.explode("record.events").alias("e")).where("length(e.url) > 0 and length(e.quote) > 0 and not coalesce(e.proof_warning, false)")
    label = F.concat(F.col("slug"), F.lit(" ["), F.coalesce("e.date", F.lit("?")), F.lit("] "), F.left(F.coalesce("e.title", F.lit("")), F.lit(50)))
    return events.select("e.url", "e.quote", label.alias("label"), F.lit("event").alias("kind"), "path")


def footnote_evidence(docs: DataFrame) -> DataFrame:
    """Quotes of footnotes that can be checked, from path and text; the label gives path, line and footnote."""
    found = footnotes.definitions(docs.select("path", "text")).withColumn("cited", footnotes.citation(F.col("body"))).where("cited is not null")
    label = F.concat(F.col("path"), F.lit(":"), F.col("line"), F.lit(" [^"), F.col("label"), F.lit("]"))
    return found.select("cited.url", "cited.quote", label.alias("label"), F.lit("footnote").alias("kind"), "path")


def shared_link_evidence(posts: DataFrame) -> DataFrame:
    """Descriptions of shared links, from path and shared_link (url, title, description)."""
    said = posts.where("length(shared_link.url) > 0 and length(shared_link.description) > 0")
    label = F.concat(F.col("path"), F.lit(" shared_link ("), F.left(F.coalesce("shared_link.title", F.lit("")), F.lit(50)), F.lit(")"))
    return said.select("shared_link.url", F.col("shared_link.description").alias("quote"), label.alias("label"), F.lit("shared_link").alias("kind"), "path")


def collect_evidence(records: DataFrame, docs: DataFrame, posts: DataFrame, slugs: list[str] | None = None, events_only: bool = False) -> DataFrame:
    """All three kinds, repeats included; with events_only the first alone."""
    found = event_evidence(records, slugs)
    return found if events_only else found.unionByName(footnote_evidence(docs)).unionByName(shared_link_evidence(posts))


def unchecked(evidence: DataFrame, verified: DataFrame) -> DataFrame:
    """Evidence of which no verdict is known for its URL and quote; verified has both columns."""
    known = verified.select("url", "quote").distinct()
    return evidence.join(known, ["url", "quote"], "left_anti").select(*ITEM)


def worklist(evidence: DataFrame, blocked: DataFrame) -> DataFrame:
    """Evidence on pages that refuse to be read, with the reason and the day since, for a reader; blocked has url, blocked, blocked_since."""
    return evidence.join(blocked.where("blocked is not null").select("url", "blocked", "blocked_since"), "url").select(*ITEM, "blocked", "blocked_since")


def by_url(evidence: DataFrame) -> DataFrame:
    """(url, quotes, items): each URL's different quotes in order and how often it is cited.

    Quotes are made different before they are gathered, so a URL cited over and over gathers few; what is gathered is one
    URL's quotes.
    """
    counted = evidence.groupBy("url", "quote").agg(F.count("*").alias("n"))
    return counted.groupBy("url").agg(F.array_sort(F.collect_list("quote")).alias("quotes"), F.sum("n").alias("items"))


def shown(quote: Column, longest: int = 200) -> Column:
    """A quote cut for reports."""
    return F.left(quote, F.lit(longest))
