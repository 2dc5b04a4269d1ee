"""Filter interaction audit: what each filter removes under every order, with copies found by partition refinement."""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidara.llm.common import SPACE, let, whole
from evidara.session import durable

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
#: Bytes of the first block; each later block ends at GROWTH times the end of the one before.
FIRST_BLOCK, GROWTH = 256, 16
#: Classes with more than one row in so many are told to all tasks; there are fewer of them than this.
LARGE_CLASSES = 1000
#: Up to so many class keys (a few longs each) are broadcast; beyond, they are joined by a shuffle.
BROADCAST_KEYS = 1_000_000


def failed_conditions(text: Column) -> Column:
    """Bits of the conditions A to D that a text fails: few words, repeated words, many capitals, odd marks."""
    words = let(F.array_remove(F.split(F.regexp_replace(text, SPACE, " "), " "), ""), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct")))
    capitals = F.octet_length(text) - F.octet_length(F.regexp_replace(text, "[A-Z]", ""))
    conditions = [words["n"] < 200, 100 * words["distinct"] < 50 * words["n"], 100 * capitals > 2 * F.length(text), text.rlike("[#$%&*|]")]
    return sum((F.when(failed, 1 << i).otherwise(0) for i, failed in enumerate(conditions[1:], 1)), F.when(conditions[0], 1).otherwise(0))


def block_hashes(text: Column) -> Column:
    """Hashes of successive blocks of a text's bytes; a text has about one more for each factor GROWTH of its size."""

    def cut(raw: Column) -> Column:
        longer = F.ceil(F.log(F.octet_length(raw) / FIRST_BLOCK) / F.log(F.lit(float(GROWTH))))
        end = lambda i: F.least(FIRST_BLOCK * F.pow(F.lit(float(GROWTH)), i), F.lit(float((1 << 31) - 1))).cast("int")
        begin = lambda i: F.when(i == 0, 0).otherwise(end(i - 1))
        last = F.when(F.octet_length(raw) > FIRST_BLOCK, longer).otherwise(0).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.substring(raw, begin(i) + 1, end(i) - begin(i))))

    return let(text.cast("binary"), cut)


def class_key(length: Column, blocks: Column) -> Column:
    return F.xxhash64(length, blocks)


def _join_classes(rows: DataFrame, classes: DataFrame, how: str) -> DataFrame:
    """rows with what ``classes`` (durable; one row for each ``key``, with ``n`` rows) tells of theirs.

    Few classes are broadcast. Of many, those of more than one row in LARGE_CLASSES are, and only the others are shuffled.
    """
    number, rows_in_classes = classes.agg(F.count("*"), F.sum("n")).first()
    told = classes.drop("n")
    if number <= BROADCAST_KEYS:
        return rows.join(F.broadcast(told), "key", how)
    large = F.col("n") * LARGE_CLASSES > rows_in_classes
    hot, cold = F.broadcast(classes.where(large).drop("n")), classes.where(~large).drop("n")
    return rows.join(hot, "key", "left_semi" if how == "left_semi" else "inner").unionByName(rows.join(hot, "key", "left_anti").join(cold, "key", how))


def refine(rows: DataFrame) -> DataFrame:
    """Of (length, blocks) rows the classes that still hold several: (key, n).

    The first partition is by length; each round splits the classes that are left by one more block and drops classes
    of one row. Texts are hashed once, a round reads only slim rows, and the rounds grow with the logarithm of the longest text.
    """
    left, n = rows.select("length", "blocks"), 0
    while True:
        keyed = left.withColumn("key", class_key(F.col("length"), F.slice("blocks", 1, n) if n else F.array().cast("array<bigint>")))
        classes = durable(keyed.groupBy("key").agg(F.count("*").alias("n"), F.max(F.size("blocks")).alias("longest")).where("n > 1"))
        longest = classes.agg(F.max("longest")).first()[0] or 0
        if n >= longest:
            return classes.select("key", "n")
        left, n = durable(_join_classes(keyed, classes.select("key", "n"), "left_semi").select("length", "blocks")), n + 1


def measure(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), whole(text_col).alias("text"))
    return source.select("id", "part", failed_conditions(F.col("text")).alias("mask"), F.length("text").alias("length"), block_hashes(F.col("text")).alias("blocks"), "text")


def failure_masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(id, part, mask) of every row: which of the conditions A to E it fails.

    E holds where the same text stands under a smaller id. Refined classes rest on hashes, so the whole texts of their
    rows are compared: equal texts are grouped before and after the shuffle, and a group of any size is one row from each
    task. Where a class holds one text, its smallest id decides; where it holds several (a collision), its
    rows are read once more and marked by their texts.
    """
    rows = durable(measure(docs, id_col, text_col, part_col).drop("text").withColumn("key", class_key(F.col("length"), F.col("blocks"))))
    classes = durable(refine(rows))
    texts = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text")).withColumn("key", class_key(F.length("text"), block_hashes(F.col("text"))))
    survivors = _join_classes(texts, classes, "left_semi")
    per_text = survivors.groupBy("key", "text").agg(F.min("id").alias("first"))
    firsts = durable(per_text.groupBy("key").agg(F.count("*").alias("texts"), F.min("first").alias("first")).join(classes, "key"))
    collided = firsts.where("texts > 1").select("key", "n")
    marked = _join_classes(rows, firsts.select("key", "first", "n", "texts"), "left").where("texts is null or texts = 1").select("id", "part", "mask", "first")
    if not collided.isEmpty():
        again = _join_classes(measure(docs, id_col, text_col, part_col).withColumn("key", class_key(F.col("length"), F.col("blocks"))), collided, "left_semi")
        marked = marked.unionByName(again.join(per_text, ["key", "text"]).select("id", "part", "mask", "first"))
    return marked.select("id", "part", (F.col("mask") + F.when(F.col("id") > F.col("first"), COPY).otherwise(0)).alias("mask"))


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row for each part, order of the five filters, and step: documents kept, removed, and lost of good and toxic ones.

    Documents are counted by the set of conditions they fail, at most 32 counts a part; all orders are worked out from
    these. Null texts are empty, null parts the empty string; rows without an id are never later copies and have
    no labels; repeated rows count each, and rows that repeat id and text are no copies of one another; where an id has
    several labels the largest counts; extra columns are left out; an empty table gives no rows.
    """
    known = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    masks = failure_masks(docs, id_col, text_col, part_col)
    counts = masks.join(known, "id", "left").groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"))
    by_part = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))

    orders = F.lit(["".join(p) for p in permutations(FILTERS)])
    steps = by_part.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.lit(list(range(1, len(FILTERS) + 1)))))
    place = F.instr(F.lit(FILTERS), F.expr("substring(filter_order, step, 1)"))
    earlier = sum((F.when(F.instr("filter_order", f) < F.col("step"), 1 << i).otherwise(0) for i, f in enumerate(FILTERS)), F.lit(0))
    steps = steps.withColumn("own", F.pow(F.lit(2), place - 1).cast("int")).withColumn("earlier", earlier)

    def total(value, holds) -> Column:
        return F.aggregate("counts", F.lit(0).cast("long"), lambda t, c: t + F.when(holds(c["mask"]), value(c)).otherwise(0).cast("long"))

    own, before = F.col("own"), F.col("earlier")
    fails = lambda m: m.bitwiseAND(own) != 0
    early = lambda m: m.bitwiseAND(before) != 0
    here = lambda m: fails(m) & ~early(m)
    n = lambda c: c["n"]
    return steps.select(
        "part",
        "filter_order",
        "step",
        total(n, lambda m: ~fails(m) & ~early(m)).alias("kept"),
        total(n, here).alias("removed"),
        total(n, lambda m: fails(m) & early(m)).alias("redundant"),
        total(n, lambda m: m == own).alias("unique_fails"),
        total(lambda c: c["good"], here).alias("good_lost"),
        total(lambda c: c["toxic"], here).alias("toxic_lost"),
        # of the filters that a document fails, each comes first in the same number of orders
        total(lambda c: (c["n"] * factorial(len(FILTERS)) / F.bit_count(c["mask"])), fails).alias("shapley"),
    )
