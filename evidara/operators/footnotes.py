"""Footnotes of Markdown documents as evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# a link: its words in brackets, its target in parentheses, which may hold pairs of parentheses themselves
LINK = r"\[([^\]]*)\]\(([^()]+(?:\([^()]*\)[^()]*)*)\)"

SHORTEST_REASON = 15


def _label(line: Column) -> Column:
    """What stands between [^ and ]: at the start of a line; empty where the line defines no footnote."""
    label = F.split_part(F.substring(line, F.lit(3), F.length(line)), F.lit("]"), F.lit(1))
    return F.when(line.startswith(F.concat(F.lit("[^"), label, F.lit("]:"))), label).otherwise("")


def definitions(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row for each definition: the other columns of docs, line (from 1), label, body."""
    keep = [c for c in docs.columns if c != text]
    lines = docs.select(*keep, F.posexplode(F.split(F.col(text), "\r?\n")).alias("at", "content")).where(F.col("content").startswith("[^")).withColumn("label", _label(F.col("content")))
    body = F.substring("content", F.length("label") + 5, F.length("content"))
    return lines.where("label <> ''").select(*keep, (F.col("at") + 1).alias("line"), "label", F.regexp_replace(body, r"^\s+", "").alias("body"))


def quoted_phrase(text: Column) -> Column:
    """The first phrase between quotation marks, straight or curved; empty without any."""
    return F.btrim(F.regexp_substr(text, F.lit("[\"\u201c][^\"\u201d]+[\"\u201d]")), F.lit("\"\u201c\u201d"))


def citation(body: Column) -> Column:
    """Struct (url, title, quote) of a footnote that can be checked by machine, else null.

    It can where it has just one link, an absolute one, and a quoted phrase outside of this link; of several phrases the
    first counts.
    """
    url = F.regexp_extract(body, LINK, 2)
    quote = quoted_phrase(F.regexp_replace(body, LINK, ""))
    fits = (F.regexp_count(body, F.lit(LINK)) == 1) & url.rlike("^https?://") & (quote != "")
    return F.when(fits, F.struct(url.alias("url"), F.regexp_extract(body, LINK, 1).alias("title"), quote.alias("quote")))


def reason(body: Column) -> Column:
    """Struct (kind, reason) of the first comment "unquoted: kind: reason" in a footnote, else null."""
    comments = F.transform(F.split(body, "<!--"), lambda c, i: F.when((i > 0) & F.contains(c, F.lit("-->")), F.split_part(c, F.lit("-->"), F.lit(1))))
    parts = F.transform(F.array_compact(comments), lambda c: F.transform(F.split(c, ":", 3), lambda p: F.trim(p)))
    stated = F.filter(parts, lambda p: (F.size(p) == 3) & (F.get(p, F.lit(0)) == "unquoted") & F.get(p, F.lit(1)).rlike("^[\\w-]+$") & (F.get(p, F.lit(2)) != ""))
    return F.get(F.transform(stated, lambda p: F.struct(F.get(p, F.lit(1)).alias("kind"), F.get(p, F.lit(2)).alias("reason"))), F.lit(0))


def gate(body: Column, shortest: int = SHORTEST_REASON) -> Column:
    """What a footnote that links to a source lacks: quoted, reasoned, vague_reason, unreasoned; null where it cites nothing."""
    why = reason(body)["reason"]
    verdict = F.when(citation(body).isNotNull(), "quoted").when(F.length(why) >= shortest, "reasoned").when(why.isNotNull(), "vague_reason").otherwise("unreasoned")
    return F.when(body.rlike(r"\]\(https?://"), verdict)


def coverage(found: DataFrame, folder: str) -> DataFrame:
    """Per folder of ``definitions``: total, with_quote, justified, vague (a reason too short) and missing.

    Every footnote counts. One that can't be checked by machine should say why; a vague reason is one all the same, so
    total = with_quote + justified + missing, and vague ones are among the justified.
    """
    quoted, why = citation(F.col("body")).isNotNull(), reason(F.col("body"))["reason"]
    rows = found.select(F.col(folder), quoted.alias("quoted"), F.length(why).alias("reason"))
    left = ~F.col("quoted")
    return rows.groupBy(folder).agg(
        F.count("*").alias("total"), F.count_if("quoted").alias("with_quote"), F.count_if(left & F.col("reason").isNotNull()).alias("justified"),
        F.count_if(left & (F.col("reason") < SHORTEST_REASON)).alias("vague"), F.count_if(left & F.col("reason").isNull()).alias("missing"),
    )
