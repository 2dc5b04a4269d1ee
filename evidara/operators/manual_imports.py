"""Pages that people saved by hand: where they come from, which quotes they hold, and what is still asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidara.functions import markup
from evidara.functions.text import holds_normalized, normalize_ws
from evidara.session import durable

STAMP_CHARS = 2048


def sidecar(lines: DataFrame) -> DataFrame:
    """(name, url) from lines (line number, value) like "saved page.html https://a.org": the URL is what follows the last white space.

    Empty lines, comments (#) and lines of one word are left out; of several lines for a name the last one counts.
    """
    told = F.regexp_replace("value", r"(?U)^\s+|\s+$", "")
    parts = lines.select("line", told.alias("told")).where("told <> '' and not startswith(told, '#')")
    url = F.regexp_substr("told", F.lit(r"(?U)\S+$"))
    named = parts.select("line", url.alias("url"), F.regexp_replace(F.left("told", F.length("told") - F.length(url)), r"(?U)\s+$", "").alias("name")).where("name <> ''")
    return named.groupBy("name").agg(F.max_by("url", "line").alias("url"))


def stamped_url(html: Column) -> Column:
    """The URL that a browser noted at the head of a page it saved: "saved from url=(length)URL"; else null."""
    rest = F.split_part(F.left(html, F.lit(STAMP_CHARS)), F.lit("saved from url=("), F.lit(2))
    length = F.split_part(rest, F.lit(")"), F.lit(1))
    url = F.regexp_substr(F.substring(rest, F.length(length) + 2, F.length(rest)), F.lit(r"^\S+"))
    return F.when(length.rlike(r"^\d+$"), url)


def declared_url(html: Column) -> Column:
    """The URL that a page gives as its own, canonical link before og:url; one that lacks its scheme is mended."""
    of = lambda tag, kind, value, name: F.get(F.filter(markup.values_where(html, tag, kind, value, name), lambda v: v != ""), F.lit(0))
    told = F.trim(F.coalesce(of("link", "rel", "canonical", "href"), of("meta", "property", "og:url", "content")))
    return F.when(told.startswith("//"), F.concat(F.lit("https:"), told)).when(told.startswith("www."), F.concat(F.lit("https://"), told)).otherwise(told)


def recovered(snapshots: DataFrame, names: DataFrame) -> DataFrame:
    """(name, empty, url, source) of snapshots (name, html, text): what a person noted, else the browser's stamp, else the page's own word.

    Documents that are no pages have a null html, so only a person's note tells their URL. Unknown: both null. Names
    tell snapshots apart. Pages are read where they lie, and only these short rows are checkpointed and move on.
    """
    read = snapshots.select("name", (F.coalesce("text", F.lit("")) == "").alias("empty"), stamped_url(F.col("html")).alias("stamp"), declared_url(F.col("html")).alias("declared"))
    joined = read.join(names.select("name", F.col("url").alias("noted")), "name", "left")
    source = F.when(F.col("noted").isNotNull(), "url-map").when(F.col("stamp").isNotNull(), "stamp").when(F.col("declared").isNotNull(), "meta tag")
    return durable(joined.select("name", "empty", F.coalesce("noted", "stamp", "declared").alias("url"), source.alias("source")))


def matched(found: DataFrame, evidence: DataFrame) -> DataFrame:
    """(name, status, url, source) of ``recovered`` rows: EMPTY, SKIPPED, NO_MATCH or IMPORTED; the URL of an imported one is the evidence's.

    A URL that no evidence cites may lack one slash at its end, or have one too many; nothing else is guessed.
    """
    other = F.when(F.col("url").endswith("/"), F.left("url", F.length("url") - 1)).otherwise(F.concat("url", F.lit("/")))
    tried = found.where("url is not null").select("name", F.posexplode(F.array("url", other)).alias("place", "target"))
    cited = evidence.where("url is not null").select(F.col("url").alias("target")).distinct()
    best = tried.join(cited, "target").groupBy("name").agg(F.min(F.struct("place", "target")).alias("best"))
    status = F.when(F.col("empty"), "EMPTY").when(F.col("url").isNull(), "SKIPPED").when(F.col("best").isNull(), "NO_MATCH").otherwise("IMPORTED")
    rows = found.join(best, "name", "left").withColumn("status", status)
    imported = F.col("status") == "IMPORTED"
    source = F.when(imported & (F.col("best.place") == 1), F.concat("source", F.lit(", trailing slash normalised"))).otherwise(F.col("source"))
    return rows.select("name", "status", F.when(imported, F.col("best.target")).otherwise(F.col("url")).alias("url"), source.alias("source"))


def import_verdicts(snapshots: DataFrame, imported: DataFrame, evidence: DataFrame) -> DataFrame:
    """(name, url, quote, holds) for each different quote that cites an imported page (name, text).

    These verdicts are people's: they are kept beside the automated ones and never replace them. Quotes first meet the
    names of their pages, so a text moves once. Many quotes of one page are parted by adaptive execution, since each
    of their rows stands alone.
    """
    quotes = evidence.where("url is not null and quote is not null").select("url", "quote").distinct()
    asked_of = imported.where("status = 'IMPORTED'").select("name", "url").join(quotes, "url")
    texts = snapshots.select("name", normalize_ws(F.col("text")).alias("text"))
    return asked_of.join(texts, "name").select("name", "url", "quote", holds_normalized(F.col("text"), F.col("quote")).alias("holds"))


def manifest(imported: DataFrame, verdicts: DataFrame, day: Column) -> DataFrame:
    """One row a snapshot: name, status, url, source ("unknown" without one), checked, good, mismatch."""
    sums = verdicts.groupBy("name").agg(F.count_if("holds").alias("good"), F.count_if(~F.col("holds")).alias("mismatch"))
    count = lambda name: F.coalesce(name, F.lit(0).cast("long")).alias(name)
    checked = F.when(F.col("status") == "IMPORTED", day)
    return imported.select("name", "status", "url", F.coalesce("source", F.lit("unknown")).alias("source"), checked.alias("checked")).join(sums, "name", "left").select("name", "status", "url", "source", "checked", count("good"), count("mismatch"))


def manual_state(verdicts: DataFrame) -> DataFrame:
    """(url, quote, holds) after all imports: of several snapshots of one page the one with the greatest name counts."""
    latest = Window.partitionBy("url", "quote").orderBy(F.col("name").desc())
    return verdicts.withColumn("_n", F.row_number().over(latest)).where("_n = 1").select("url", "quote", "holds")


def asked(requests: DataFrame, more: DataFrame, imported: DataFrame) -> DataFrame:
    """The URLs still asked for: the old requests and new ones, each once, without those imported now."""
    done = imported.where("status = 'IMPORTED'").select("url")
    return requests.select("url").union(more.select("url")).where("url is not null and url <> ''").distinct().join(done, "url", "left_anti")
