"""Links between documents, resolved by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: what a link is, and how outside targets begin
LINK = r"!?\[[^\]]*\]\(([^)\s]+)\)"
OUTSIDE = r"^(?:https?://|mailto:|tel:|data:|//|#)"


def clean_path(path: Column) -> Column:
    """The path without empty and single-dot steps, each double dot taking the step before it."""
    steps = F.filter(F.split(path, "/"), lambda s: ~s.isin("", "."))
    walk = lambda done, s: F.when((s == "..") & (F.size(done) > 0), F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(s)))
    return F.array_join(F.aggregate(steps, F.array().cast("array<string>"), walk), "/")


def folder(path: Column) -> Column:
    return F.regexp_replace(path, "[^/]*$", "")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)/?$", 1)


def document_links(docs: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, line, target) for each link to another document, lines from 1; lines between code fences are left out.

    A window over the lines of one document counts the fences above each line.
    """
    lines = docs.select(F.col(path).alias("path"), F.posexplode(F.split(F.col(text), "\r\n|\n")).alias("at", "content"))
    is_fence = F.col("content").rlike(r"^\s*```")
    above = F.sum(is_fence.cast("int")).over(Window.partitionBy("path").orderBy("at"))
    open_lines = lines.withColumn("fences", above).where(~is_fence & (F.col("fences") % 2 == 0))
    links = open_lines.select("path", (F.col("at") + 1).alias("line"), F.explode(F.regexp_extract_all("content", F.lit(LINK), F.lit(1))).alias("target"))
    return links.where(~F.col("target").rlike(OUTSIDE))


def broken_links(docs: DataFrame, files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Links whose target is no file, neither from the document's folder (or the root) nor by its name anywhere.

    files has one column path. Two anti joins: on the resolved path, then on the name with and without its ending.
    """
    bare = F.try_url_decode(F.replace(F.regexp_replace("target", "[#?].*$", ""), F.lit("+"), F.lit("%2B")))
    links = document_links(docs, path, text).withColumn("bare", F.coalesce(bare, F.regexp_replace("target", "[#?].*$", ""))).where("bare <> ''")
    there = F.when(F.col("bare").startswith("/"), F.col("bare")).otherwise(F.concat(folder(F.col("path")), "bare"))
    known = files.select(clean_path(F.col("path")).alias("resolved"))
    folders = known.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("resolved", "/"))), lambda n: F.array_join(F.slice(F.split("resolved", "/"), F.lit(1), n), "/"))).alias("resolved")).distinct()
    name = base_name(F.col("resolved"))
    names = known.select(F.explode(F.array(name, F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""))).alias("name")).distinct()
    missing = links.withColumn("resolved", clean_path(there)).join(folders, "resolved", "left_anti")
    return missing.withColumn("name", base_name(F.col("bare"))).join(names, "name", "left_anti").select("path", "line", "target")


def resolved_links(docs: DataFrame, files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Links to Markdown documents with how they resolve: source-dir, url-based, or null for broken ones."""
    bare = F.regexp_replace("target", "[#?].*$", "")
    links = document_links(docs, path, text).withColumn("bare", bare).where(F.col("bare").endswith(".md"))
    known = files.select(clean_path(F.col("path")).alias("file")).distinct()
    beside = links.withColumn("beside", clean_path(F.concat(folder(F.col("path")), "bare"))).withColumn("below", clean_path(F.concat(F.regexp_replace("path", r"\.md$", ""), F.lit("/"), "bare")))
    met = beside.join(known.select(F.col("file").alias("beside"), F.lit(True).alias("is_beside")), "beside", "left").join(known.select(F.col("file").alias("below"), F.lit(True).alias("is_below")), "below", "left")
    how = F.when(F.col("is_beside"), "source-dir").when(F.col("is_below"), "url-based")
    return met.select("path", "line", "target", how.alias("strategy"), F.when(how == "source-dir", F.col("beside")).when(how == "url-based", F.col("below")).alias("resolved"))
