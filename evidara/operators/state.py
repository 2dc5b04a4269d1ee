"""Keyed state that is carried from run to run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert_newer(state: DataFrame, found: DataFrame, keys: list[str], date: str) -> DataFrame:
    """The state after a run: a found row replaces a stored one only if its date is strictly later; new keys are added."""
    rest = [c for c in state.columns if c not in keys]
    old = state.select(*keys, F.struct(*rest).alias("old"))
    new = found.select(*keys, F.struct(*rest).alias("new"))
    joined = old.join(new, keys, "full_outer")
    take = F.col("old").isNull() | (F.col("new").isNotNull() & F.coalesce(F.col(f"new.{date}") > F.col(f"old.{date}"), F.col(f"old.{date}").isNull()))
    return joined.select(*keys, F.when(take, F.col("new")).otherwise(F.col("old")).alias("kept")).select(*keys, "kept.*")


def due(checks: DataFrame, key: str, at: str, days: int) -> DataFrame:
    """Checks that come more than ``days`` after the one before of the same key, or first."""
    last = F.lag(at).over(Window.partitionBy(key).orderBy(at, *[c for c in checks.columns if c not in (key, at)]))
    return checks.withColumn("gap_days", F.datediff(F.to_date(at), F.to_date(last))).where(F.col("gap_days").isNull() | (F.col("gap_days") > days))


def drift(runs: DataFrame, key: str, order: list[str], status: str) -> DataFrame:
    """Rows whose status is another than at the run before, with both."""
    before = F.lag(status).over(Window.partitionBy(key).orderBy(*order))
    return runs.withColumn("old_status", before).where(F.col("old_status") != F.col(status))


def merge_channels(existing: DataFrame, found: DataFrame, keys: list[str], value: str, force: bool) -> DataFrame:
    """Both sides' channels: found ones are added, and replace an existing value only with force."""
    joined = existing.select(*keys, F.col(value).alias("old")).join(found.select(*keys, F.col(value).alias("new")), keys, "full_outer")
    return joined.select(*keys, (F.coalesce("new", "old") if force else F.coalesce("old", "new")).alias(value))


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """(key, before, after, change) of metrics that differ between two snapshots; a missing metric counts as zero."""
    joined = before.select(key, F.col(value).alias("before")).join(after.select(key, F.col(value).alias("after")), key, "full_outer")
    zero = joined.select(key, F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))
    return zero.where("before <> after").withColumn("change", F.col("after") - F.col("before"))


def first_wins(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")
