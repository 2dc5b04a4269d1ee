"""Verification state over a history of attempts: blocks that stick, verdicts that failures never erase, manual verdicts apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidara.functions.text import ellipsis_parts, holds_quote, normalize_ws, occurrences

# fixed values: the errors that stick to a page until a forced attempt succeeds
STICKY_ERRORS = ("HTTP 403", "HTTP 429", "ROBOTS_BLOCKED")

FACTS = "url string, claim string, at timestamp, seq long, kind string, verdict boolean, forced boolean, error string, not_modified boolean, body_chars long, claim_chars long, holds boolean, hits long"
OUTCOME = "url string, claim string, at timestamp, seq long, status string, unchanged boolean, ambiguous boolean, queued boolean, blocked string, blocked_since date, checked date"


def attempt_facts(attempts: DataFrame) -> DataFrame:
    """What a state needs to know of each attempt, without the page: (url, claim, at, seq, kind, verdict, forced, error, not_modified, body) becomes FACTS.

    ``kind`` is ``check`` or ``manual`` (a person's verdict). A page that was not modified may still come with a body,
    fetched anew for a claim not seen there before. Null bodies count as empty, null flags as false.
    """
    body, claim = F.coalesce("body", F.lit("")), F.col("claim")
    flag = lambda name: F.coalesce(name, F.lit(False)).alias(name)
    plain = occurrences(normalize_ws(body), normalize_ws(claim))
    hits = F.when(ellipsis_parts(claim)[0].isNull(), plain).otherwise(F.lit(0).cast("long"))
    return attempts.select(
        "url", "claim", "at", "seq", "kind", "verdict", flag("forced"), "error", flag("not_modified"), F.length(body).cast("long").alias("body_chars"), F.length(claim).cast("long").alias("claim_chars"), holds_quote(body, claim).alias("holds"), hits.alias("hits")
    )


def replay(facts: DataFrame) -> DataFrame:
    """The outcome of every check (columns of OUTCOME), in the order of ``at`` and ``seq`` of its page.

    The first rule that fits decides: a sticky block (unless forced: the manual verdict, else the block), an error, an
    unmodified page (the verdict known), a page shorter than its claim (the manual verdict, else an error),
    the comparison. Blocks stick from the first sticky error to the next forced success; a failure changes no verdict.
    ``queued`` asks for a person's copy of the page. Two passes of window functions over the pages' rows, which are sorted and
    spilled rather than held, so a page may have any number of attempts.
    """
    order = [F.col("at"), F.col("seq")]
    page, one = Window.partitionBy("url").orderBy(*order), Window.partitionBy("url", "claim").orderBy(*order)
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    so_far = page.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = lambda value, w: F.last(value, ignorenulls=True).over(w)

    check, short = F.col("kind") == "check", F.col("body_chars") < F.col("claim_chars")
    fine = check & F.col("error").isNull() & ~short
    block, clears = check & F.col("error").isin(*STICKY_ERRORS), fine & F.col("forced")
    unmodified = F.col("not_modified") & ~F.col("forced")
    rows = facts.withColumn("was_blocked", F.coalesce(last(F.when(block, True).when(clears, False), before(page)), F.lit(False)))
    rows = rows.withColumn("ran", check & (F.col("forced") | ~F.col("was_blocked"))).withColumn("block", F.coalesce(block, F.lit(False)) & F.col("ran")).withColumn("era", F.count_if(clears).over(so_far))
    written = fine & F.col("ran")
    rows = rows.select(
        "*",
        F.coalesce(last(F.when(written & ~unmodified, F.col("holds")), before(one)), F.first(F.when(written & unmodified, F.col("holds")), ignorenulls=True).over(before(one))).alias("known"),
        last(F.when(F.col("kind") == "manual", F.col("verdict")), before(one)).alias("manual"),
        F.nullif(last(F.when(F.col("block"), F.col("error")).when(clears, ""), so_far), F.lit("")).alias("blocked"),
        F.min(F.when(F.col("block"), F.col("at"))).over(Window.partitionBy("url", "era").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("since"),
    )
    trusted = F.col("ran") & F.col("error").isNull() & unmodified & F.col("known").isNotNull()
    wrote = written & ~trusted
    rows = rows.withColumn("checked", last(F.when(wrote | trusted, F.col("at")), so_far))

    say = lambda verdict: F.when(verdict, "GOOD").otherwise("BAD")
    manual = F.when(~F.col("forced"), F.col("manual"))
    skipped, too_short = ~F.col("ran"), F.col("ran") & F.col("error").isNull() & ~trusted & short
    status = (
        F.when(skipped, F.when(manual.isNotNull(), say(manual)).otherwise(F.col("blocked")))
        .when(F.col("error").isNotNull(), F.col("error"))
        .when(trusted, say(F.col("known")))
        .when(short, F.when(manual.isNotNull(), say(manual)).otherwise(F.when(F.col("body_chars") == 0, "EMPTY_RESPONSE").otherwise("PAGE_TOO_SHORT")))
        .otherwise(say(F.col("holds")))
    )
    return rows.where(check).select(
        "url", "claim", "at", "seq", status.alias("status"),
        (skipped | trusted | (too_short & manual.isNotNull())).alias("unchanged"),
        (wrote & F.col("holds") & (F.col("hits") > 1)).alias("ambiguous"),
        ((skipped & manual.isNull()) | (F.col("block") & F.col("manual").isNull()) | (too_short & manual.isNull())).alias("queued"),
        "blocked", F.when(F.col("blocked").isNotNull(), F.to_date("since")).alias("blocked_since"), F.to_date("checked").alias("checked"),
    )
