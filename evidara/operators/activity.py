"""Choosing the best signal of activity of an entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: sources in the order that breaks ties, and for how many days (inclusive) each stays fresh
CONTENT_SOURCES = ("manual", "dod", "social", "rss", "ical", "scrape")
SITE_SOURCES = ("sitemap",)
FRESH_DAYS = {"manual": 730, "dod": 365, "social": 365, "rss": 365, "ical": 365, "scrape": 365, "sitemap": 180}


def _lookup(key: Column, table: dict) -> Column:
    out = F.lit(None)
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def candidates(signals: DataFrame, as_of: Column, content=CONTENT_SOURCES, site=SITE_SOURCES, fresh_days=FRESH_DAYS) -> DataFrame:
    """(entity, source, date) rows with age, freshness and the source's place; rows without date or of unknown source go."""
    order = {s: i for i, s in enumerate([*content, *site])}
    known = signals.where(F.col("date").isNotNull() & F.col("source").isin(*order))
    return (
        known.withColumn("age_days", F.datediff(as_of, F.col("date")))
        .withColumn("place", _lookup(F.col("source"), order))
        .withColumn("is_content", F.col("source").isin(*content))
        .withColumn("fresh", F.col("age_days") <= _lookup(F.col("source"), fresh_days))
    )


def select_activity(signals: DataFrame, as_of: Column, **rules) -> DataFrame:
    """The latest fresh content signal of each entity, else a fresh site signal, else the latest content, else the site's.

    Equal dates keep the order of the sources. One aggregation per entity: the minimum of (step, latest date, place).
    """
    rated = candidates(signals, as_of, **rules).withColumn(
        "step", F.when(F.col("is_content") & F.col("fresh"), 1).when(~F.col("is_content") & F.col("fresh"), 2).when(F.col("is_content"), 3).otherwise(4)
    )
    best = rated.groupBy("entity").agg(F.min(F.struct("step", F.col("age_days"), "place", "source", "date")).alias("b"))
    return best.select("entity", F.col("b.source").alias("source"), F.col("b.date").alias("date"), F.col("b.age_days").alias("age_days"), F.col("b.step").alias("step"))


def first_fresh(signals: DataFrame, as_of: Column, **rules) -> DataFrame:
    """The first fresh signal in the order of the sources, else the latest of any source."""
    rated = candidates(signals, as_of, **rules)
    stale = F.when(F.col("fresh"), 0).otherwise(1)
    key = F.struct(stale.alias("stale"), F.when(F.col("fresh"), F.col("place")).otherwise(F.col("age_days")).alias("rank"), F.col("place"), F.col("source"), F.col("date"))
    best = rated.groupBy("entity").agg(F.min(key).alias("b"))
    return best.select("entity", F.col("b.source").alias("source"), F.col("b.date").alias("date"))


def latest_of_any(signals: DataFrame) -> DataFrame:
    return signals.groupBy("entity").agg(F.max("date").alias("date"))


def freshness_bucket(age: Column, edges=(0, 30, 90, 180, 365)) -> Column:
    """Label of the age's bucket, lower edge inclusive; null and negative ages have none."""
    out = F.lit(None).cast("string")
    for low, high in zip(edges, [*edges[1:], None], strict=True):
        inside = (age >= low) if high is None else (age >= low) & (age < high)
        out = F.when(inside, F.lit(f"{low}+" if high is None else f"{low}-{high}")).otherwise(out)
    return out
