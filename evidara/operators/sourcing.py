"""How well an event is sourced: score, proof level, and the gates that reports count.

Rows have url, source, note, quote, url_checked, and for the gates notable, proof_warning, proof_level and locked; null
stands for a field that is not there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidara.functions import urls

STALE_CHECK_DAYS = 365
MIN_SOURCE_LENGTH = 20


def _has(name: str) -> Column:
    return F.col(name).isNotNull()


def _deep() -> Column:
    """The URL points to more than a site."""
    return ~urls.path(F.trim("url")).isin("", "/")


def checked_recently(as_of: Column) -> Column:
    return F.coalesce(F.datediff(as_of, F.col("url_checked")) <= STALE_CHECK_DAYS, F.lit(False))


def confidence(as_of: Column) -> Column:
    """0 to 6: an encyclopedia article 2, another page 1, or a source 1; a quote 2; a note 1; a recent check 1."""
    article = F.contains(urls.host(F.trim("url")), F.lit("wikipedia.org")) & _deep()
    where = F.when(_has("url"), F.when(article, 2).when(_deep(), 1).otherwise(0)).when(_has("source"), 1).otherwise(0)
    return where + F.when(_has("quote"), 2).otherwise(0) + F.when(_has("note"), 1).otherwise(0) + F.when(checked_recently(as_of), 1).otherwise(0)


def unlocked_level() -> Column:
    by_url = F.when(_has("quote"), "high").when(_has("note") | _deep(), "medium").otherwise("low")
    return F.when(_has("url"), by_url).when(_has("source") & (_has("note") | _has("quote")), "medium").otherwise("low")


def proof_level() -> Column:
    """The level that the signs give, or the one set by hand where that is locked."""
    return F.when(F.coalesce("locked", F.lit(False)) & _has("proof_level"), F.col("proof_level")).otherwise(unlocked_level())


#: Gates that fail a run; the others only warn.
HARD = ("unsourced", "no_proof")


def gates(as_of: Column) -> dict[str, Column]:
    """Each gate's condition. An event without url and source counts as unsourced and for nothing else."""
    sourced = _has("url") | _has("source")
    locked = F.coalesce("locked", F.lit(False))
    conditions = {
        "no_proof": ~_has("quote") & ~_has("note") & ~_has("proof_warning"),
        "vague_source": _has("source") & ~_has("url") & (F.length(F.trim("source")) < MIN_SOURCE_LENGTH),
        "weak_url": _has("url") & urls.is_weak(F.col("url")),
        "notable_no_proof": F.coalesce("notable", F.lit(False)) & ~_has("quote"),
        "stale_level": ~locked & (F.col("proof_level") != unlocked_level()),
        "stale_check": F.col("proof_level").isin("high", "medium") & ~checked_recently(as_of),
    }
    return {"unsourced": ~sourced} | {name: sourced & F.coalesce(rule, F.lit(False)) for name, rule in conditions.items()}


def gate_counts(events: DataFrame, as_of: Column) -> DataFrame:
    """(gate, hard, n) for every gate, counted in one pass."""
    found = gates(as_of)
    one = events.agg(*(F.count_if(rule).alias(name) for name, rule in found.items()))
    rows = F.array(*(F.struct(F.lit(name).alias("gate"), F.lit(name in HARD).alias("hard"), F.col(name).alias("n")) for name in found))
    return one.select(F.inline(rows))
