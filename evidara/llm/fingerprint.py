"""Document fingerprints: one-permutation MinHash with optimal densification and b-bit packing, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidara.llm.common import SPACE, let, whole
from evidara.session import shuffle_partitions

BINS = 256
LOW_BITS = 8
SHINGLE_WORDS = 5


def shingle_hashes(text: Column, shingle_words: int = SHINGLE_WORDS) -> Column:
    """Hashes of all word shingles of the whole text; of all its words if there are fewer; none without words."""
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        last = F.greatest(F.size(h) - shingle_words, F.lit(0))
        every = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(shingle_words))))
        return F.when(F.size(h) > 0, every).otherwise(F.array().cast("array<bigint>"))

    return let(hashes, shingles)


def minhash_bins(hashes: Column, bins: int) -> Column:
    """The least hash of each non-empty bin, as hashes sorted by (bin, hash). The top bits of a hash are its bin.

    Hashes are sorted as signed numbers, so the bins of the upper half come first; equal top bits stay together.
    """
    shift = 64 - int(math.log2(bins))
    return let(F.sort_array(hashes), lambda s: F.filter(s, lambda h, i: (i == 0) | (F.shiftrightunsigned(h, shift) != F.shiftrightunsigned(F.get(s, i - 1), shift))))


def _probe(own: Column, attempt: int, bins: int) -> Column:
    return F.xxhash64(F.lit(attempt), own).bitwiseAND(F.lit(bins - 1)).cast("int")


def densified(least: Column, bins: int, attempts: int = 24) -> Column:
    """One value for each bin from the least hashes of the full ones: optimal densification.

    An empty bin tries bins drawn by a hash of (attempt, bin) until it meets a full one, so every full bin is equally
    likely and empty bins choose independently. If ``attempts`` draws all meet empty bins, which takes a nearly empty
    table, the full bin with the least hash of (bin, full bin) is taken: the same law, at the cost of looking at all.
    """
    shift = 64 - int(math.log2(bins))
    bin_of = lambda h: F.shiftrightunsigned(h, shift).cast("int")
    nothing = F.lit(None).cast("bigint")
    # hashes are in signed order, in which the upper half of the bins comes first
    half = bins // 2
    rank = lambda h: (bin_of(h) + half) % bins
    gap = lambda h, i: rank(h) - F.coalesce(rank(F.get(least, i - 1)), F.lit(-1)) - 1
    runs = F.transform(least, lambda h, i: F.concat(F.array_repeat(nothing, gap(h, i)), F.array(h)))
    last = F.array_repeat(nothing, bins - 1 - rank(F.element_at(least, -1)))
    sparse = F.concat(F.flatten(runs), last)

    def fill(sparse: Column) -> Column:
        def value(h: Column, at: Column) -> Column:
            tries = [F.get(sparse, _probe(at, k, bins)) for k in range(attempts)]
            draws = F.array_min(F.transform(least, lambda full: F.struct(F.xxhash64(at, rank(full)).alias("draw"), full.alias("value"))))["value"]
            return F.coalesce(h, *tries, draws)

        return F.transform(sparse, value)

    return let(sparse, fill)


def fingerprint(text: Column, bins: int = BINS, shingle_words: int = SHINGLE_WORDS) -> Column:
    """The packed fingerprint as lowercase hex, LOW_BITS for each bin; empty for a text without words.

    Every shingle is hashed once. The top bits choose the bin, the least hash of a bin stands for it, empty bins are
    filled by optimal densification, and of each value, mixed with its bin, the lowest bits are kept. Without the mixing
    two shingles of short texts that chance to end alike would agree in many bins at once, which no correction takes out.
    """
    digits = F.array(*(F.lit(f"{i:02x}") for i in range(1 << LOW_BITS)))

    def pack(least: Column) -> Column:
        low = F.transform(densified(least, bins), lambda h, at: F.get(digits, F.xxhash64(h, at).bitwiseAND(F.lit((1 << LOW_BITS) - 1)).cast("int")))
        return F.when(F.size(least) > 0, F.array_join(low, "")).otherwise(F.lit(""))

    return let(minhash_bins(shingle_hashes(text, shingle_words), bins), pack)


def likeness(one: Column, other: Column, bins: int = BINS) -> Column:
    """Estimated Jaccard similarity of two fingerprints: the share of equal groups, less what chance makes equal.

    Kept bits of different values agree once in 2**LOW_BITS; the correction takes that out. Two empty fingerprints are
    alike, an empty and another one are not.
    """
    pair = F.struct(F.unhex(one).alias("a"), F.unhex(other).alias("b"))
    byte = lambda raw, i: F.substring(raw, i, F.lit(1))
    same = let(pair, lambda p: F.size(F.filter(F.sequence(F.lit(1), F.lit(bins)), lambda i: byte(p["a"], i) == byte(p["b"], i))))
    chance = 2.0**-LOW_BITS
    corrected = F.greatest(F.lit(0.0), (same / bins - chance) / (1 - chance))
    return F.when((one == "") | (other == ""), (one == other).cast("double")).otherwise(corrected)


def with_next(df: DataFrame, columns: list[str], id_col: str = "doc_id", per_partition: int = 4) -> DataFrame:
    """Each row with the ``columns`` of the next row in descending id order, as next_*; after the last comes the first.

    Ids are cut into buckets at quantiles, and the row that opens a bucket is also sent to the bucket before it (the
    very first row to the last bucket). Each bucket is then ordered on its own, so every row crosses the network once.
    """
    spark = df.sparkSession
    n = shuffle_partitions(spark) * per_partition
    cuts = df.agg(F.percentile_approx(id_col, [i / n for i in range(1, n + 1)], 10 * n).alias("cuts")).first()["cuts"] or []
    heads = sorted(set(cuts), reverse=True)  # one number for each bucket
    heads_column = F.array(*map(F.lit, heads)).cast("array<bigint>")
    last = max(len(heads) - 1, 0)
    place = F.greatest(F.size(F.filter(heads_column, lambda h: h >= F.col(id_col))) - 1, F.lit(0))
    bucket = F.when(F.col(id_col).isNull(), F.lit(last)).otherwise(place) if heads else F.lit(0)
    own = F.struct(bucket.alias("bucket"), F.lit(False).alias("guest"))
    opens = F.coalesce(F.array_contains(heads_column, F.col(id_col)), F.lit(False)) if heads else F.lit(False)
    before = F.struct(F.when(bucket == 0, F.lit(last)).otherwise(bucket - 1).alias("bucket"), F.lit(True).alias("guest"))
    dealt = df.withColumn("_to", F.explode(F.when(opens, F.array(own, before)).otherwise(F.array(own)))).select("*", "_to.bucket", "_to.guest").drop("_to")
    order = Window.partitionBy("bucket").orderBy("guest", F.col(id_col).desc_nulls_last(), *(F.col(c) for c in columns))
    found = dealt.select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in columns))
    return found.where(~F.col("guest")).drop("bucket", "guest")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bins: int = BINS, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """Every document's fingerprint, its edited text's, and the likeness to that and to the next document's.

    The edited text ends in the beginning of the next document (descending id, after the last the first) instead of
    its own second half. Texts are fingerprinted where they are read; then each row, with text and fingerprint, goes
    once to the bucket of its id, where it meets the next one.

    Null texts count as empty. Null ids come last. Rows of one id follow each other by text. A single row is its own next. An empty
    table gives no rows; extra columns are left out.
    """
    mark = lambda text: fingerprint(text, bins, shingle_words)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text")).withColumn("fingerprint", mark(F.col("text")))
    met = with_next(own, ["text", "fingerprint"])
    next_text = F.coalesce(F.col("next_text"), F.col("text"))
    n_chars = F.length("text")
    tail = F.floor(n_chars / 2).cast("int")
    edited = met.withColumn("n_chars", n_chars.cast("long")).withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n_chars - tail), F.substring(next_text, F.lit(1), tail)))
    marked = edited.select(
        "doc_id", "n_chars", F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256"), "fingerprint", mark(F.col("edited")).alias("edited_fingerprint"),
        F.coalesce("next_fingerprint", "fingerprint").alias("next_fingerprint"),
    )
    return marked.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), bins).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint"), bins).alias("near_next"),
    )
