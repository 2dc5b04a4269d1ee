"""Faceted search: options, filters, and counts that leave a facet's own choice aside."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _passes(facet: str, chosen: list[str], is_array: bool) -> Column:
    if not chosen:
        return F.lit(True)
    if is_array:
        return F.coalesce(F.arrays_overlap(F.col(facet), F.array(*map(F.lit, chosen))), F.lit(False))
    return F.coalesce(F.col(facet).isin(*chosen), F.lit(False))


def _arrays(df: DataFrame) -> set[str]:
    return {name for name, kind in df.dtypes if kind.startswith("array")}


def facet_filter(df: DataFrame, chosen: dict[str, list[str]]) -> DataFrame:
    """Rows that have one of the chosen values in each facet; a facet without choice lets all pass."""
    arrays = _arrays(df)
    return df.where(reduce(lambda a, b: a & b, (_passes(f, v, f in arrays) for f, v in chosen.items()), F.lit(True)))


def facet_options(df: DataFrame, facets: list[str]) -> DataFrame:
    """(facet, value): the different values, blanks left out."""
    return _values(df, facets).where("value <> ''").select("facet", "value").distinct()


def _values(df: DataFrame, facets: list[str]) -> DataFrame:
    """Each row once for each of its facet values. One pass over the data, whatever the number of facets."""
    arrays = _arrays(df)
    none = F.array().cast("array<struct<facet:string,value:string>>")

    def entries(facet: str) -> Column:
        values = F.col(facet) if facet in arrays else F.array(facet)
        return F.coalesce(F.transform(values, lambda v: F.struct(F.lit(facet).alias("facet"), v.cast("string").alias("value"))), none)

    return df.withColumn("entry", F.explode(F.concat(*map(entries, facets)))).select("*", "entry.*").drop("entry")


def drill_sideways(df: DataFrame, chosen: dict[str, list[str]]) -> DataFrame:
    """(facet, value, n): rows with the value that pass all other facets' choices; values nobody passes stay with zero."""
    arrays = _arrays(df)
    flagged = df.select("*", *(_passes(f, v, f in arrays).alias(f"pass_{f}") for f, v in chosen.items()))
    others = F.lit(False)
    for facet in chosen:
        rest = reduce(lambda a, b: a & b, (F.col(f"pass_{f}") for f in chosen if f != facet), F.lit(True))
        others = F.when(F.col("facet") == facet, rest).otherwise(others)
    return _values(flagged, list(chosen)).where("value <> ''").groupBy("facet", "value").agg(F.count_if(others).alias("n"))
