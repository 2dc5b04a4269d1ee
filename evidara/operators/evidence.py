"""Quoted evidence against its sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidara.functions.text import ellipsis_parts, let, normalize_ws, occurrences

#: Words of a quote by which its pages are looked up before the text itself is compared.
PROBE_WORDS = 3
#: Up to so many quotes are looked up by every page at once.
INLINE_PROBES = 10_000
CONTEXT_CHARS = 150


def _runs(words: Column) -> Column:
    """A hash of each run of PROBE_WORDS words."""

    def hashed(held: Column) -> Column:
        firsts = F.slice(held, F.lit(1), F.greatest(F.size(held) - PROBE_WORDS + 1, F.lit(0)))
        return F.transform(firsts, lambda w, i: F.xxhash64(w, *[F.get(held, i + n) for n in range(1, PROBE_WORDS)]))

    return let(words, hashed)


def quote_hits(claims: DataFrame, pages: DataFrame, claim_key: str, page_key: str, quote: str = "quote", text: str = "text") -> DataFrame:
    """(claim, page, text, quote, head, tail) for every page that holds the quote, white space normalised on both sides.

    A quote with three dots stands in a page that holds the part before them (``head``) and later the part after the last
    ones (``tail``). A page can only hold a quote if it holds a run of PROBE_WORDS words from inside its first part
    (the outer words may be cut in the page), so pages look up the hashes of their runs among those of the quotes, and
    only pairs so met are compared as texts. With up to INLINE_PROBES quotes the look-up is done before runs become
    rows, so a page is read once and only its hits are multiplied; more quotes are met in an equi-join. Quotes whose
    first part is too short for such a run, of which there should be few, are compared with all pages.
    """
    head, tail = ellipsis_parts(F.col("quote"))
    quotes = claims.select(F.col(claim_key).alias("claim"), normalize_ws(F.col(quote)).alias("quote")).where("quote <> ''").select("*", head.alias("head"), tail.alias("tail"))
    texts = pages.select(F.col(page_key).alias("page"), normalize_ws(F.col(text)).alias("text"))
    words = F.split(F.coalesce("head", "quote"), " ")
    probed = quotes.withColumn("probe", F.when(F.size(words) >= PROBE_WORDS + 2, F.get(_runs(F.slice(words, 2, PROBE_WORDS)), F.lit(0))))
    long = probed.where("probe is not null")
    n_long, n_short = probed.agg(F.count("probe"), F.count_if(F.col("probe").isNull())).first()
    if n_long <= INLINE_PROBES:
        probes = F.broadcast(long.agg(F.collect_set("probe").alias("probes")))  # one row
        read = pages.select(F.col(page_key).alias("page"), let(normalize_ws(F.col(text)), lambda t: F.struct(t.alias("text"), _runs(F.split(t, " ")).alias("runs"))).alias("read"))
        held = read.join(probes).select("page", "read.text", F.array_intersect("read.runs", "probes").alias("held")).where(F.size("held") > 0)
        met = held.select("page", "text", F.explode("held").alias("probe")).join(F.broadcast(long), "probe")
    else:
        pairs = texts.select("page", F.explode(F.array_distinct(_runs(F.split("text", " ")))).alias("probe")).join(long.select("claim", "probe"), "probe").select("page", "claim").distinct()
        met = pairs.join(texts, "page").join(long, "claim")
    columns = ["claim", "page", "text", "quote", "head", "tail"]
    every = met.select(*columns)
    if n_short:
        short = texts.join(probed.where("probe is null"), F.contains(F.col("text"), F.coalesce("head", "quote")))
        every = every.unionByName(short.select(*columns))
    after = F.substring(F.col("text"), F.instr("text", F.col("head")) + F.length("head"), F.length("text"))
    return every.where(F.when(F.col("head").isNull(), F.contains("text", "quote")).otherwise(F.contains("text", "head") & F.contains(after, F.col("tail"))))


def quote_pages(claims: DataFrame, pages: DataFrame, claim_key: str, page_key: str, quote: str = "quote", text: str = "text") -> DataFrame:
    """(claim, page, hits) for every page that holds the quote; a quote with three dots counts once a page."""
    found = quote_hits(claims, pages, claim_key, page_key, quote, text)
    hits = F.when(F.col("head").isNull(), occurrences(F.col("text"), F.col("quote"))).otherwise(F.lit(1).cast("long"))
    return found.select("claim", "page", hits.alias("hits"))


def verdicts(claims: DataFrame, found: DataFrame, claim_key: str) -> DataFrame:
    """Each claim with its pages, occurrences and status: MATCH once, AMBIGUOUS more often, MISMATCH never."""
    sums = found.groupBy("claim").agg(F.count("*").alias("pages"), F.sum("hits").alias("hits"))
    joined = claims.select(F.col(claim_key).alias("claim")).join(sums, "claim", "left")
    hits = F.coalesce("hits", F.lit(0))
    status = F.when(hits == 0, "MISMATCH").when(hits == 1, "MATCH").otherwise("AMBIGUOUS")
    return joined.select(F.col("claim").alias(claim_key), F.coalesce("pages", F.lit(0)).alias("pages"), hits.alias("hits"), status.alias("status"))


def context(text: Column, quote: Column, chars: int = CONTEXT_CHARS) -> Column:
    """What stands before and after the first occurrence, and a digest of both with the quote."""
    at = F.instr(text, quote)
    before = F.substring(text, F.greatest(at - chars, F.lit(1)), F.least(at - 1, F.lit(chars)))
    after = F.substring(text, at + F.length(quote), F.lit(chars))
    return F.struct(before.alias("prefix"), after.alias("suffix"), F.sha2(F.concat(before, quote, after), 256).alias("sha256"))


def next_state(rows: DataFrame) -> DataFrame:
    """The verdict of each fetched claim by the first rule that fits: block, error, unchanged page, short page, comparison.

    Columns used: blocked, manual, error, not_modified, prior, page_chars, quote_chars, contains.
    """
    verdict = (
        F.when(F.col("blocked").isNotNull() & F.col("manual").isNotNull(), F.when(F.col("manual"), "GOOD").otherwise("BAD"))
        .when(F.col("blocked").isNotNull(), F.col("blocked"))
        .when(F.col("error").isNotNull(), F.col("error"))
        .when(F.col("not_modified") & F.col("prior").isNotNull(), F.when(F.col("prior"), "GOOD").otherwise("BAD"))
        .when((F.col("page_chars") < F.col("quote_chars")) & F.col("manual").isNotNull(), F.when(F.col("manual"), "GOOD").otherwise("BAD"))
        .when(F.col("page_chars") == 0, "EMPTY_RESPONSE")
        .when(F.col("page_chars") < F.col("quote_chars"), "PAGE_TOO_SHORT")
        .when(F.col("contains"), "GOOD")
        .otherwise("BAD")
    )
    return rows.withColumn("verdict", verdict)
