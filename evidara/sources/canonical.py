"""Canonical order of what stands in a document's front matter."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from evidara.functions.edits import replace_single

# fixed values: the order of fields at the top, within an event, and of sources of activity
TOP_FIELDS = (
    "title", "type", "status", "country", "website", "logo", "logo_bg", "banner", "contact", "summary", "concepts", "location", "news_page", "rss_feed", "ics_feed",
    "related_orgs", "events", "activity", "last_checked",
)
EVENT_FIELDS = (
    "date", "title", "url", "source", "quote", "note", "proof_level", "url_checked", "end_date", "time", "end_time", "notable", "type", "location", "proof_warning", "coverage_url",
)
ACTIVITY_SOURCES = ("manual", "dod", "social", "rss", "ical", "scrape", "sitemap")

_FRONT = r"(?s)\A---\n(.*?)\n---\n"


def _sorted_by(fields: tuple[str, ...], found: object) -> object:
    """A mapping with the listed keys first and all others after them as they stood; anything else as it is."""
    if not isinstance(found, dict):
        return found
    rank = {name: at for at, name in enumerate(fields)}
    return dict(sorted(found.items(), key=lambda entry: rank.get(entry[0], len(fields)) if isinstance(entry[0], str) else len(fields)))


def _mapping(text: str | None) -> dict | None:
    """Front matter as a mapping; null where it is none or no YAML."""
    import yaml

    try:
        meta = yaml.safe_load(text) if text is not None else None
    except (yaml.YAMLError, ValueError):
        return None
    return meta if isinstance(meta, dict) else None


def _ordered(meta: dict) -> str:
    import yaml

    meta = _sorted_by(TOP_FIELDS, meta)
    if isinstance(meta.get("events"), list):
        meta["events"] = [_sorted_by(EVENT_FIELDS, event) for event in meta["events"]]
    if "activity" in meta:
        meta["activity"] = _sorted_by(ACTIVITY_SOURCES, meta["activity"])
    return yaml.safe_dump(meta, sort_keys=False, allow_unicode=True, default_flow_style=False).rstrip("\n")


@F.pandas_udf(StringType())
def canonical_yaml(front: pd.Series) -> pd.Series:
    """Front matter in canonical order; null where it is no mapping or no YAML, so the caller leaves it alone."""

    def ordered(text: str | None) -> str | None:
        meta = _mapping(text)
        return None if meta is None else _ordered(meta)

    return front.map(ordered)


@F.pandas_udf(StructType([StructField("front", StringType()), StructField("place", StringType())]))
def _mended_front(front: pd.Series, old: pd.Series, new: pd.Series) -> pd.DataFrame:
    """Front matter with the value of one quote (place event) or of a shared link's description (place link) replaced."""
    import yaml

    def mend(text: str | None, was: str | None, becomes: str | None) -> tuple[str | None, str | None]:
        meta = _mapping(text)
        if meta is None or was is None or becomes is None:
            return None, None
        events = meta.get("events") if isinstance(meta.get("events"), list) else []
        same = [event for event in events if isinstance(event, dict) and event.get("quote") == was]
        if len(same) == 1 and _ordered(_mapping(text)) == text:
            same[0]["quote"] = becomes
            return _ordered(meta), "event"
        link = meta.get("shared_link")
        if isinstance(link, dict) and link.get("description") == was:
            link["description"] = becomes
            return yaml.safe_dump(meta, allow_unicode=True, default_flow_style=False).rstrip("\n"), "link"
        return None, None

    return pd.DataFrame([mend(*row) for row in zip(front, old, new, strict=True)], columns=["front", "place"])


def mended_quotes(docs: DataFrame, text: str = "text", old: str = "old", new: str = "new") -> DataFrame:
    """docs with ``mended``, the text with the old quote replaced by the new one, and ``place``: text, event, link or null.

    A quote that stands in the text just once is replaced there. Otherwise the front matter is read: the quote of just
    one event, if the front matter is in canonical order already, so that nothing else changes; else the description of
    a shared link, whose front matter is written with sorted keys. In any other case (absent, ambiguous, null) nothing is
    guessed and ``mended`` is null. Bodies stay in the JVM, and front matter is read only where the text was no help.
    """
    own, single = F.col(text), replace_single(F.col(text), F.col(old), F.col(new))
    read = docs.withColumn("_single", single).withColumn("_front", F.when(F.col("_single").isNull() & own.rlike(_FRONT), F.regexp_extract(own, _FRONT, 1)))
    found = read.withColumn("_mend", _mended_front("_front", F.when(F.col("_front").isNotNull(), F.col(old)), F.col(new)))
    body = F.substring(own, F.length("_front") + 10, F.length(own))
    gap = F.when(F.col("_mend.place") == "link", F.concat(F.lit("\n"), F.regexp_replace(body, r"^\s+|\s+$", ""))).otherwise(body)
    written = F.coalesce("_single", F.concat(F.lit("---\n"), F.col("_mend.front"), F.lit("\n---\n"), gap))
    place = F.when(F.col("_single").isNotNull(), "text").otherwise(F.col("_mend.place"))
    return found.withColumn("mended", written).withColumn("place", place).drop("_single", "_front", "_mend")


def canonical_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with ``canonical``, the text with its front matter in canonical order, and ``out_of_order``, whether that differs.

    Only the front matter goes through Python; bodies stay as they are. Texts without front matter, and with front matter
    that is no mapping, are their own canonical form; null stays null and is in order.
    """
    own = F.col(text)
    split = docs.withColumn("_front", F.when(own.rlike(_FRONT), F.regexp_extract(own, _FRONT, 1))).withColumn("_ordered", canonical_yaml("_front"))
    body = F.substring(own, F.length("_front") + 10, F.length(own))
    written = F.when(F.col("_ordered").isNull(), own).otherwise(F.concat(F.lit("---\n"), F.col("_ordered"), F.lit("\n---\n"), body))
    return split.withColumn("canonical", written).withColumn("out_of_order", F.coalesce(F.col("canonical") != own, F.lit(False))).drop("_front", "_ordered")


def out_of_order(docs: DataFrame, key: str = "slug", text: str = "text") -> DataFrame:
    """The keys of the documents that would be rewritten."""
    return canonical_documents(docs, text).where("out_of_order").select(key)
