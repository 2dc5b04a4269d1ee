"""Queries over quoted evidence: does a passage still stand in its source?"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.functions.text import normalize_ws
from evidara.functions.urls import text_fragment
from evidara.operators import evidence, state
from evidara.plans.registry import Registry
from evidara.session import table

registry = Registry()
QUERIES, ORACLES = registry.queries, registry.oracles

_NORM = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
_QUOTE = f"replace(replace({_NORM.format('text')}, '( ', '('), ' )', ')')"
_PAIRS = f"""
    q as (select item_id, {_QUOTE} as quote from benchmark), d as (select doc_id, source, lang, {_QUOTE} as body from documents),
    pairs as (select item_id, doc_id, source, lang, (length(body) - length(replace(body, quote, ''))) // length(quote) as hits from q join d on quote <> '' and contains(body, quote))
"""


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.quote_pages(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), "item_id", "doc_id", quote="text")


@registry.query(f"""
    with {_PAIRS}, s as (select item_id, count(*) as pages, sum(hits) as hits from pairs group by 1)
    select b.item_id, coalesce(pages, 0)::bigint as pages, coalesce(hits, 0)::bigint as hits,
           case when coalesce(hits, 0) = 0 then 'MISMATCH' when hits = 1 then 'MATCH' else 'AMBIGUOUS' end as status
    from benchmark b left join s using (item_id)""")
def quote_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.verdicts(table(spark, sf_dir, "benchmark"), _found(spark, sf_dir), "item_id")


@registry.query(f"with {_PAIRS} select source, lang, count(*) as n_pairs, count(distinct item_id) as n_items, sum(hits)::bigint as n_hits from pairs group by 1, 2")
def quote_verify_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), "source", "lang")
    return _found(spark, sf_dir).join(documents, "page").groupBy("source", "lang").agg(
        F.count("*").alias("n_pairs"), F.countDistinct("claim").alias("n_items"), F.sum("hits").alias("n_hits")
    )


@registry.query(f"""
    with {_PAIRS}, c as (select p.item_id, p.doc_id, body, quote, strpos(body, quote) as pos from pairs p join q using (item_id) join d using (doc_id)),
    x as (select item_id, doc_id, quote, substr(body, greatest(pos - 150, 1)::bigint, least(pos - 1, 150)::bigint) as prefix, substr(body, pos + length(quote), 150) as suffix from c)
    select item_id, doc_id, prefix, suffix, sha256(prefix || quote || suffix) as sha256 from x""")
def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = evidence.quote_hits(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), "item_id", "doc_id", quote="text")
    return met.select(F.col("claim").alias("item_id"), F.col("page").alias("doc_id"), evidence.context(F.col("text"), F.col("quote")).alias("c")).select("item_id", "doc_id", "c.*")


@registry.query(f"""
    with done as (select sha256({_QUOTE}) as h from benchmark where item_id % 3 = 0)
    select item_id, sha256({_QUOTE}) as claim_hash from benchmark where sha256({_QUOTE}) not in (select h from done)""")
def unchecked_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims without a stored verdict; every third item plays the verified set."""
    claims = table(spark, sf_dir, "benchmark").withColumn("claim_hash", F.sha2(normalize_ws(F.col("text")), 256))
    verified = claims.where("item_id % 3 = 0").select("claim_hash")
    return claims.join(verified, "claim_hash", "left_anti").select("item_id", "claim_hash")


@registry.query(f"""
    with q as (select item_id, {_QUOTE} as q from benchmark), w as (select *, string_split(q, ' ') as w from q)
    select item_id, case when item_id % 5 <> 0 then 'https://example.org/source#:~:text=' || case when length(q) <= 300 then url_encode(q)
        else url_encode(array_to_string(w[1:8], ' ')) || ',' || url_encode(array_to_string(w[-8:], ' ')) end end as url from w""")
def fragment_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links that scroll to a passage; every fifth page has a fragment of its own, so that none can be added."""
    page = F.when(F.col("item_id") % 5 == 0, "https://example.org/source#old").otherwise("https://example.org/source")
    return table(spark, sf_dir, "benchmark").select("item_id", text_fragment(page, F.col("text")).alias("url"))


@registry.query(f"""
    with t as (select item_id, md5(item_id::varchar) as h, length(text) as quote_chars from benchmark),
    r as (select item_id, quote_chars,
        case when substr(h, 1, 1) in ('0', '1') then 'HTTP 403' end as blocked,
        case when substr(h, 2, 1) in ('0', '1', '2', '3') then true when substr(h, 2, 1) in ('4', '5') then false end as manual,
        case when substr(h, 3, 1) in ('0', '1') then 'HTTP 500' end as error,
        substr(h, 4, 1) in ('0', '1', '2', '3') as not_modified,
        case when substr(h, 5, 1) < '8' then substr(h, 5, 1) < '4' end as prior,
        case when substr(h, 6, 1) = '0' then 0 when substr(h, 6, 1) < '4' then quote_chars - 1 else quote_chars * 3 end as page_chars,
        substr(h, 7, 1) < 'c' as contains from t)
    select item_id, case when blocked is not null and manual is not null then case when manual then 'GOOD' else 'BAD' end
        when blocked is not null then blocked when error is not null then error
        when not_modified and prior is not null then case when prior then 'GOOD' else 'BAD' end
        when page_chars < quote_chars and manual is not null then case when manual then 'GOOD' else 'BAD' end
        when page_chars = 0 then 'EMPTY_RESPONSE' when page_chars < quote_chars then 'PAGE_TOO_SHORT'
        when contains then 'GOOD' else 'BAD' end as verdict from r""")
def evidence_state_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run of the verdict cascade over claims with fetch results drawn from a digest."""
    digit = lambda i: F.substring("h", i, 1)
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.md5(F.col("item_id").cast("string")).alias("h"), F.length("text").alias("quote_chars")).select(
        "item_id", "quote_chars",
        F.when(digit(1).isin("0", "1"), "HTTP 403").alias("blocked"),
        F.when(digit(2).isin("0", "1", "2", "3"), True).when(digit(2).isin("4", "5"), False).alias("manual"),
        F.when(digit(3).isin("0", "1"), "HTTP 500").alias("error"),
        digit(4).isin("0", "1", "2", "3").alias("not_modified"),
        F.when(digit(5) < "8", digit(5) < "4").alias("prior"),
        F.when(digit(6) == "0", 0).when(digit(6) < "4", F.col("quote_chars") - 1).otherwise(F.col("quote_chars") * 3).alias("page_chars"),
        (digit(7) < "c").alias("contains"),
    )
    return evidence.next_state(rows).select("item_id", "verdict")


@registry.query("""
    with old as (select user_id, event_type, max(ts) as ts, max_by(value, ts) as value from events where event_id % 2 = 0 group by 1, 2),
    new as (select user_id, event_type, max(ts) as ts, max_by(value, ts) as value from events where event_id % 2 = 1 group by 1, 2)
    select coalesce(o.user_id, n.user_id) as user_id, coalesce(o.event_type, n.event_type) as event_type,
        case when o.ts is null or n.ts > o.ts then n.ts else o.ts end as ts, case when o.ts is null or n.ts > o.ts then n.value else o.value end as value
    from old o full join new n on o.user_id = n.user_id and o.event_type = n.event_type""")
def strictly_newer_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    latest = lambda part: events.where(f"event_id % 2 = {part}").groupBy("user_id", "event_type").agg(F.max("ts").alias("ts"), F.max_by("value", "ts").alias("value"))
    return state.upsert_newer(latest(0), latest(1), ["user_id", "event_type"], "ts")


@registry.query("""
    with x as (select user_id, event_id, ts, date_diff('day', (lag(ts) over (partition by user_id order by ts, event_id))::date, ts::date) as gap_days from events where event_type = 'signup')
    select user_id, event_id, gap_days from x where gap_days is null or gap_days > 7""")
def recheck_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = table(spark, sf_dir, "events").where("event_type = 'signup'").select("user_id", "ts", "event_id")
    return state.due(checks, "user_id", "ts", 7).select("user_id", "event_id", F.col("gap_days").cast("long").alias("gap_days"))


@registry.query("""
    with x as (select user_id, event_id, event_type, lag(event_type) over (partition by user_id order by ts, event_id) as old_status from events)
    select user_id, event_id, old_status, event_type as new_status from x where old_status <> event_type""")
def status_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = state.drift(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")
    return moved.select("user_id", "event_id", "old_status", F.col("event_type").alias("new_status"))


@registry.query("""
    with e as (select user_id, event_type, max(value) as v from events where event_id % 3 <> 0 group by 1, 2), f as (select user_id, event_type, max(value) as v from events where event_id % 3 = 0 group by 1, 2)
    select coalesce(e.user_id, f.user_id) as user_id, coalesce(e.event_type, f.event_type) as event_type, coalesce(e.v, f.v) as v from e full join f on e.user_id = f.user_id and e.event_type = f.event_type""")
def channel_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    side = lambda rule: events.where(rule).groupBy("user_id", "event_type").agg(F.max("value").alias("v"))
    return state.merge_channels(side("event_id % 3 <> 0"), side("event_id % 3 = 0"), ["user_id", "event_type"], "v", force=False)


@registry.query("""
    with c as (select o_orderstatus || '/' || o_orderpriority as metric, count(*) filter (o_orderdate < timestamp '1998-01-01') as before, count(*) filter (o_orderdate < timestamp '2000-01-01') as after from orders group by 1)
    select metric, before, after, after - before as change from c where before <> after""")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("metric", F.concat_ws("/", "o_orderstatus", "o_orderpriority"))
    at = lambda day: orders.where(F.col("o_orderdate") < F.lit(day).cast("timestamp")).groupBy("metric").agg(F.count("*").alias("n"))
    return state.snapshot_diff(at("1998-01-01"), at("2000-01-01"), "metric", "n")


@registry.query("""
    with x as (select source, lang, min(doc_id) filter (text <> '') as first_doc, list_sort(list(distinct lang)) as _, count(*) as n from documents group by source, lang),
    s as (select source, string_agg(lang, ',' order by lang) as langs, min(first_doc) as first_doc, sum(n)::bigint as n_docs from x group by 1)
    select s.source, langs, n_docs, first_doc, toxic from s left join labels l on l.doc_id = s.first_doc""")
def citation_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: its languages in order, the first non-empty document, and that document's label if it has one."""
    grouped = table(spark, sf_dir, "documents").groupBy("source").agg(
        F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"), F.count("*").alias("n_docs"), F.min(F.when(F.col("text") != "", F.col("doc_id"))).alias("first_doc")
    )
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("first_doc"), "toxic")
    return grouped.join(labels, "first_doc", "left").select("source", "langs", "n_docs", "first_doc", "toxic")


@registry.query(f"""
    with w as (select item_id, string_split({_QUOTE}, ' ') as w from benchmark), q as (select item_id, array_to_string(w[1:5], ' ') as head, array_to_string(w[-5:], ' ') as tail from w where len(w) >= 10),
    d as (select doc_id, {_QUOTE} as body from documents)
    select item_id, doc_id from q join d on contains(body, head) and contains(substr(body, strpos(body, head) + length(head)), tail)""")
def ellipsis_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes shortened to their first and last five words, with three dots between: both must follow each other in the page."""
    words = F.split(normalize_ws(F.col("text")), " ")
    dotted = F.concat_ws(" ... ", F.array_join(F.slice(words, 1, 5), " "), F.array_join(F.slice(words, -5, 5), " "))
    short = table(spark, sf_dir, "benchmark").where(F.size(words) >= 10).select("item_id", dotted.alias("quote"))
    found = evidence.quote_pages(short, table(spark, sf_dir, "documents"), "item_id", "doc_id")
    return found.select(F.col("claim").alias("item_id"), F.col("page").alias("doc_id"))
