"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidara.llm.common import WORD, global_prefix, whole
from evidara.llm.exact_dedup import unused
from evidara.session import durable

WEIGHTS = (5, 2, 1)
SPACE_AFTER = r"[\x20\x09-\x0D]*"


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def water_level(sources: DataFrame, total: float, max_epochs: int) -> float:
    """The level at which sources take level * weight words each, or max_epochs times their size if that is less.

    ``sources`` has (source_size, weight). Each round clamps the sources whose share exceeds their cap and deals the rest anew by
    weight, until none is above; the rounds only bring back two sums. Levels rise, so clamped sources stay clamped.
    """
    cap = F.col("source_size") * max_epochs
    level, clamped = 0.0, -1
    while True:
        above = cap <= F.col("weight") * level
        sums = sources.agg(F.sum(F.when(above, cap)).alias("clamped"), F.sum(F.when(~above, F.col("weight"))).alias("weight"), F.count_if(above).alias("n")).first()
        if sums["n"] == clamped or not sums["weight"]:
            return level
        level, clamped = max(0.0, total - (sums["clamped"] or 0)) / sums["weight"], sums["n"]


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, max_epochs: int = 2, seed: int = 20, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """How many words of each document the mix takes.

    The sources, in code point order with null last, get ``weights`` in turn. They share ``share`` times all words by
    weight, but none takes more than max_epochs times what it has; the excess goes to the others. A source whose
    target is r times its size gives every document whole r times, and the fraction once more from the documents that
    come first in a seeded order; the document at the edge gives the words still missing, so a source meets its target
    to the word. The order is a hash of seed, id and text, so reruns agree.

    One range sort by (source, seeded order) gives all prefix sums: a source with a third of all rows spreads over many
    partitions. Null texts have no words; repeated rows count each for itself; an empty table gives no rows; extra
    columns are left out. Returns (doc_id, source, size, source_size, target, taken, text_hash).
    """
    text = whole(text_col)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text).alias("size"), F.xxhash64(text).alias("text_hash"))
    slim = slim.withColumn("draw", F.xxhash64(F.lit(seed), "doc_id", "text_hash"))
    placed, _, total = global_prefix(slim, [F.col("source").asc_nulls_last(), F.col("draw"), F.col("doc_id")], "size")

    sources = placed.groupBy("source").agg(F.sum("size").alias("source_size"), F.min("before").alias("source_before"))
    ranked, _, _ = global_prefix(sources, [F.col("source").asc_nulls_last()], "source_size")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("position") % len(weights) + 1).cast("int"))
    weighed = durable(ranked.select("source", "source_size", "source_before", weight.alias("weight")))
    level = water_level(weighed, share * total, max_epochs)
    target = F.least(F.col("source_size") * float(max_epochs), F.col("weight") * F.lit(level))
    goals = weighed.select("source", "source_size", "source_before", target.alias("target"))

    words = F.round("target").cast("long")
    rounds = F.when(F.col("source_size") > 0, F.expr("cast(round(target) as bigint) div source_size")).otherwise(0)
    once_more = words - rounds * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), once_more - (F.col("before") - F.col("source_before"))))
    joined = placed.withColumnRenamed("source", "placed_source").join(goals, F.col("placed_source").eqNullSafe(F.col("source")))
    return joined.select("doc_id", F.col("placed_source").alias("source"), "size", "source_size", "target", (rounds * F.col("size") + part).cast("long").alias("taken"), "text_hash")


def repeat_documents(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """The mixed corpus: each document as often as the mix takes it, whole; at a source's edge one is cut to the words still missing.

    Columns are those of docs, whatever their names; ``n_chars``, where present, follows a cut. Documents of no words,
    null texts among them, are dropped, since the mix takes none of theirs; null sources are a source, null ids an id.
    Rows that repeat id, source and text come as often as the mix takes them together, to the word; an empty table stays empty.
    """
    names = {}
    for wish in ("mix_hash", "mix_number", "mix_words", "mix_id", "mix_source", "mix_text", "mix_size", "mix_taken", "mix_rows"):
        names[wish[4:]] = unused([*docs.columns, *names.values()], wish)
    col = lambda name: F.col(names[name])
    taken = mix(docs, source_col=source_col, id_col=id_col, text_col=text_col, **parameters).where(F.col("taken") > 0)
    shares = taken.groupBy(F.col("doc_id").alias(names["id"]), F.col("source").alias(names["source"]), F.col("text_hash").alias(names["text"]), F.col("size").alias(names["size"])).agg(F.sum("taken").alias(names["taken"]), F.count("*").alias(names["rows"]))
    keyed = docs.withColumn(names["hash"], F.xxhash64(whole(text_col)))
    alike = Window.partitionBy(id_col, source_col, names["hash"]).orderBy(F.lit(0))
    keyed = keyed.withColumn(names["number"], F.row_number().over(alike))
    joined = keyed.join(shares, F.col(id_col).eqNullSafe(col("id")) & F.col(source_col).eqNullSafe(col("source")) & (col("hash") == col("text")))
    whole_copies, rest = F.expr(f"{names['taken']} div {names['size']}"), col("taken") % col("size")
    copies = F.floor(whole_copies / col("rows")) + F.when(col("number") <= whole_copies % col("rows"), 1).otherwise(0)
    cut_here = (rest > 0) & (col("number") == 1)
    pieces = F.concat(F.array_repeat(col("size"), copies.cast("int")), F.when(cut_here, F.array(rest)).otherwise(F.array().cast("array<bigint>")))
    each = joined.withColumn(names["words"], F.explode(pieces))
    words = F.regexp_extract_all(F.col(text_col), F.lit(WORD + SPACE_AFTER), F.lit(0))
    is_whole = col("words") == col("size")
    out = each.withColumn(text_col, F.when(is_whole, F.col(text_col)).otherwise(F.array_join(F.slice(words, F.lit(1), col("words").cast("int")), "")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(is_whole, F.col("n_chars")).otherwise(F.length(text_col)))
    return out.select(*docs.columns)
