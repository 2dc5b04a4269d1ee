"""Constraints between tables and within rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidara.functions.text import let


def broken_references(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose key no parent has; null keys refer to nothing and are not broken."""
    return child.where(F.col(child_key).isNotNull()).join(parent.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


def orphans(parent: DataFrame, child: DataFrame, parent_key: str, child_key: str) -> DataFrame:
    """Parent rows to which no child refers."""
    return parent.join(child.select(F.col(child_key).alias(parent_key)), parent_key, "left_anti")


def lint(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) for each rule that a row breaks, in one pass; a rule that is null is not broken."""
    broken = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules.items())))
    return df.select(key, F.explode(broken).alias("rule"))


# fixed values: the states a record may have, and where archived sites live
STATES = ("active", "inactive", "deregistered")
ARCHIVE = "https://web.archive.org"


def record_issues(records: DataFrame, concepts: DataFrame, as_of: Column | None = None, days: int = 0) -> DataFrame:
    """(slug, rule) that records (slug, record) break: status, website-active, website-inactive, location, concepts, country.

    concepts has one column slug. Each record's different concepts are joined to it once. With days, records checked less
    than so many days before as_of are passed over. Empty fields break no rule but that of the location.
    """
    r = lambda name: F.coalesce(F.col(f"record.{name}"), F.lit(""))
    due = records
    if days > 0:
        age = F.datediff(as_of, F.try_to_timestamp(F.btrim("record.last_checked", F.lit('"')), F.lit("yyyy-MM-dd")).cast("date"))
        due = records.where(F.coalesce(age >= days, F.lit(True)))
    archived = F.contains(r("website"), F.lit(ARCHIVE))
    rules = {
        "status": (r("status") != "") & ~r("status").isin(*STATES), "website-active": (r("status") == "active") & archived,
        "website-inactive": r("status").isin("inactive", "deregistered") & (r("website") != "") & ~archived,
        "location": (r("status") == "active") & F.coalesce(F.col("record.latitude").cast("string"), F.col("record.longitude").cast("string"), F.col("record.location_name")).isNull(),
        "country": (r("country") != "") & ~r("country").rlike("^[A-Z]{2}$"),
    }
    named = due.select("slug", F.explode(F.array_distinct("record.concepts")).alias("concept"))
    unknown = named.join(concepts.select(F.col("slug").alias("concept")), "concept", "left_anti").select("slug", F.lit("concepts").alias("rule")).distinct()
    return lint(due, "slug", rules).unionByName(unknown)


def front_matter_issues(docs: DataFrame, key: str = "slug", text: str = "text") -> DataFrame:
    """(key, rule, line) of what is wrong with a document's block: fm-opening, else fm-closing, else stray rules in its body.

    Lines are numbered from 1, and null but for fm-stray. Null texts have no opening.
    """
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    ruled = let(lines, lambda all_: F.filter(F.transform(all_, lambda line, i: F.when(line == "---", i + 1)), lambda n: n.isNotNull()))
    issue = lambda rule, line: F.struct(F.lit(rule).alias("rule"), line.cast("int").alias("line"))
    nowhere = F.lit(None)
    found = let(ruled, lambda at: F.when(F.coalesce(F.get(at, F.lit(0)) != 1, F.lit(True)), F.array(issue("fm-opening", nowhere)))
        .when(F.size(at) == 1, F.array(issue("fm-closing", nowhere)))
        .otherwise(F.transform(F.slice(at, F.lit(3), F.size(at)), lambda n: issue("fm-stray", n))))
    return docs.select(key, F.explode(found).alias("i")).select(key, "i.rule", "i.line")
