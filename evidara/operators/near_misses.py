"""Quotes that their pages no longer hold, with what comes closest there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.functions.passages import closest_normalized, difference_lines
from evidara.functions.text import holds_normalized, normalize_ws


def near_misses(claims: DataFrame, pages: DataFrame, min_ratio: float = 0.6) -> DataFrame:
    """The claims (any columns, with url and quote) that miss in their page (url, text), with passage, ratio, shared and difference.

    Each claim is compared with the one page it cites, so there are as many comparisons as claims whose page is at hand;
    texts leave the rows as soon as they are compared. Claims that hold, and claims without a page, give no row. Where
    nothing in the page is alike enough, or either text is empty, the four new columns are null. Verdicts stay exact:
    this says only where to look.
    """
    own = claims.columns
    cited = claims.join(pages.select("url", normalize_ws(F.col("text")).alias("_page")), "url").where(~holds_normalized(F.col("_page"), F.col("quote")))
    hint = cited.withColumn("_hint", closest_normalized(min_ratio)(F.col("_page"), normalize_ws(F.col("quote")))).drop("_page")
    return hint.select(*own, "_hint.passage", "_hint.ratio", "_hint.shared", difference_lines(F.col("_hint.changes")).alias("difference"))
