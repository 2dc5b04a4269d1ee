"""Sourcing of events, and text and date rules of the pages that show them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.functions import text as texts
from evidara.operators import sourcing
from evidara.plans.registry import Registry
from evidara.session import table
from evidara.sinks import exports

registry = Registry()
QUERIES, ORACLES = registry.queries, registry.oracles
AS_OF = "2024-01-31"

#: Events in the role of the tables at hand: pages give urls, documents sources and quotes; what is missing follows from the key.
_EVENTS = f"""
    with e as (select p.page_id, case when p.page_id % 6 = 0 then 'https://en.wikipedia.org/wiki/X' when p.page_id % 6 = 1 then 'https://a.example/news/' when p.page_id % 6 < 4 then p.url end as url,
        case when p.page_id % 6 = 4 then d.source || ' said so in ' || d.lang when p.page_id % 12 = 3 then 'a printed book of some length' end as source,
        case when p.page_id % 5 = 1 then 'seen' end as note, case when p.page_id % 4 = 1 then d.text end as quote,
        (date '{AS_OF}' - (p.page_id * 37 % 800)::int)::date as url_checked, p.page_id % 9 = 0 as notable, case when p.page_id % 11 = 0 then 'thin' end as proof_warning,
        case when p.page_id % 3 = 0 then 'high' when p.page_id % 3 = 1 then 'medium' end as proof_level, p.page_id % 7 = 0 as locked
        from pages p left join documents d on d.doc_id = p.page_id),
    u as (select *, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) as path, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) as host from e),
    l as (select *, path not in ('', '/') as deep, case when url is not null then case when quote is not null then 'high' when note is not null or path not in ('', '/') then 'medium' else 'low' end
        when source is not null and (note is not null or quote is not null) then 'medium' else 'low' end as computed,
        date_diff('day', url_checked, date '{AS_OF}') <= 365 as recent, url is not null or source is not null as sourced from u)"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("page_id")
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), "text", "lang", F.col("source").alias("outlet"))
    rows = table(spark, sf_dir, "pages").join(documents, "page_id", "left")
    return rows.select(
        "page_id",
        F.when(key % 6 == 0, "https://en.wikipedia.org/wiki/X").when(key % 6 == 1, "https://a.example/news/").when(key % 6 < 4, F.col("url")).alias("url"),
        F.when(key % 6 == 4, F.concat("outlet", F.lit(" said so in "), "lang")).when(key % 12 == 3, "a printed book of some length").alias("source"),
        F.when(key % 5 == 1, "seen").alias("note"), F.when(key % 4 == 1, F.col("text")).alias("quote"),
        F.date_sub(F.lit(AS_OF).cast("date"), (key * 37 % 800).cast("int")).alias("url_checked"), (key % 9 == 0).alias("notable"), F.when(key % 11 == 0, "thin").alias("proof_warning"),
        F.when(key % 3 == 0, "high").when(key % 3 == 1, "medium").alias("proof_level"), (key % 7 == 0).alias("locked"),
    )


@registry.query(f"""{_EVENTS}
    select page_id, (case when url is not null then case when contains(host, 'wikipedia.org') and deep then 2 when deep then 1 else 0 end when source is not null then 1 else 0 end
        + case when quote is not null then 2 else 0 end + case when note is not null then 1 else 0 end + case when recent then 1 else 0 end)::int as score from l""")
def source_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("page_id", sourcing.confidence(F.lit(AS_OF).cast("date")).alias("score"))


@registry.query(f"""{_EVENTS}
    select page_id, case when locked and proof_level is not null then proof_level else computed end as level, computed as unlocked_level from l""")
def source_proof_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("page_id", sourcing.proof_level().alias("level"), sourcing.unlocked_level().alias("unlocked_level"))


@registry.query(f"""{_EVENTS}
    select 'unsourced' as gate, true as hard, count(*) filter (not sourced) as n from l
    union all select 'no_proof', true, count(*) filter (sourced and quote is null and note is null and proof_warning is null) from l
    union all select 'vague_source', false, count(*) filter (source is not null and url is null and length(trim(source)) < 20) from l
    union all select 'weak_url', false, count(*) filter (url is not null and not regexp_matches(url, '#.') and (not deep or regexp_matches(lower(path), '^/*(events?|news|blog|calendar|press|media|updates|whats-on)/*$'))) from l
    union all select 'notable_no_proof', false, count(*) filter (sourced and notable and quote is null) from l
    union all select 'stale_level', false, count(*) filter (sourced and not locked and proof_level <> computed) from l
    union all select 'stale_check', false, count(*) filter (sourced and proof_level in ('high', 'medium') and not recent) from l""")
def source_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sourcing.gate_counts(_events(spark, sf_dir), F.lit(AS_OF).cast("date"))


@registry.query(r"""
    with d as (select doc_id, trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g')) as t from documents), w as (select doc_id, string_split(replace(replace(t, '( ', '('), ' )', ')'), ' ') as w from d)
    select doc_id, case when doc_id % 3 = 0 then len(w) >= 12 else len(w) >= 12 and doc_id % 3 = 1 end as holds from w""")
def ellipsis_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes of a document's own first and last words around three dots: held in this order, and not turned round.

    Every third document has the two parts in order, every third one has them with more dots between, the others ask
    for a part that no document holds.
    """
    words = F.split(texts.normalize_ws(F.col("text")), " ")
    head, tail = F.array_join(F.slice(words, 1, 4), " "), F.array_join(F.slice(words, -4, 4), " ")
    key = F.col("doc_id") % 3
    quote = F.when(key == 0, F.concat(head, F.lit(" ... "), tail)).when(key == 1, F.concat(head, F.lit("... and ... "), tail)).otherwise(F.concat(head, F.lit("... \u2603\u2603 never")))
    enough = F.size(words) >= 12
    return table(spark, sf_dir, "documents").select("doc_id", (enough & texts.holds_quote(F.col("text"), quote)).alias("holds"))


@registry.query(r"""select p_partkey, trim(regexp_replace(regexp_replace(lower(trim(p_name)), '[^a-z0-9_\s-]', '', 'g'), '[\s_-]+', '-', 'g'), '-') as slug from part""".replace("\\\\", "\\"))
def part_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", texts.slug(F.col("p_name")).alias("slug"))


@registry.query("""select conv_id, turn, case when regexp_matches(text, '[,"\\n\\r]') then '"' || replace(text, '"', '""') || '"' else text end as field from conversations""")
def csv_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", texts.csv_field(F.col("text")).alias("field"))


@registry.query(f"""
    with s as (select c_custkey, max(o_orderdate)::date as last from customer left join orders on o_custkey = c_custkey group by 1)
    select c_custkey, coalesce(greatest(0.0, least(1.0, date_diff('day', last, date '{AS_OF}') / 730.0)), 1.0)::double as staleness from s""")
def fractional_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far a customer's last order has aged on the way to two years; fully without any."""
    last = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").cast("date").alias("last"))
    age = F.datediff(F.lit(AS_OF).cast("date"), F.col("last")) / 730.0
    return table(spark, sf_dir, "customer").select("c_custkey").join(last, "c_custkey", "left").select("c_custkey", F.when(F.col("last").isNull(), 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), age))).alias("staleness"))


@registry.query(f"""
    with s as (select o_custkey, max(o_orderdate)::date as last from orders group by 1)
    select c_custkey, c_name from customer left join s on o_custkey = c_custkey
    where contains(lower(c_name || ' ' || c_mktsegment), 'auto') and date_diff('day', last, date '{AS_OF}') <= 9000""")
def search_recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose visible text holds the search word, whatever its case, and that were active lately enough."""
    last = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").cast("date").alias("last"))
    customers = table(spark, sf_dir, "customer").where(F.contains(F.lower(F.concat_ws(" ", "c_name", "c_mktsegment")), F.lit("auto")))
    return customers.join(last, "c_custkey").where(F.datediff(F.lit(AS_OF).cast("date"), F.col("last")) <= 9000).select("c_custkey", "c_name")


@registry.query("""
    select o_custkey, l_partkey, count(*) as n from lineitem join orders on o_orderkey = l_orderkey
    where o_custkey in (select c_custkey from customer where c_acctbal > 0) and l_partkey in (select p_partkey from part where p_size > 25) group by 1, 2""")
def visible_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges customer to part of which both ends are shown, each once with its weight."""
    edges = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    customers = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    parts = table(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("l_partkey"))
    return edges.join(customers, "o_custkey", "left_semi").join(parts, "l_partkey", "left_semi").groupBy("o_custkey", "l_partkey").agg(F.count("*").alias("n"))


@registry.query("""
    select p_partkey, (abs(list_reduce(list_prepend(0::bigint, list_transform(string_split(p_brand || p_type, ''), lambda c: unicode(c)::bigint)),
        lambda h, c: ((h * 31 + c + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648)) % 360)::int as hue from part""")
def tag_hue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", texts.hue(F.concat("p_brand", "p_type")).alias("hue"))


@registry.query("select event_id, case when minute(ts) = 0 then strftime(ts, '%-I %p') else strftime(ts, '%-I:%M %p') end as clock from events")
def event_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", texts.clock(F.col("ts")).alias("clock"))


@registry.query(r"""
    with w as (select p_partkey, unnest(string_split_regex(lower(p_name), '[^a-z0-9]+')) as w from part)
    select p_partkey, count(distinct w) filter (length(w) > 2 and w not in ('the', 'and', 'for')) as n, string_agg(distinct w, ',' order by w) filter (length(w) > 2 and w not in ('the', 'and', 'for')) as keywords from w group by 1""")
def slug_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = texts.slug_keywords(F.col("p_name"), ("the", "and", "for"))
    found = table(spark, sf_dir, "part").select("p_partkey", words.alias("words"))
    return found.select("p_partkey", F.size("words").cast("long").alias("n"), F.when(F.size("words") > 0, F.array_join(F.array_sort("words"), ",")).alias("keywords"))


@registry.query("""
    select n_name, count(*) as n from customer join nation on n_nationkey = c_nationkey group by 1 order by n desc, n_name limit 12""")
def top_countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve countries with most customers; the limit is the report's."""
    counts = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(table(spark, sf_dir, "nation")), "n_nationkey").select("n_name", "n").orderBy(F.desc("n"), "n_name").limit(12)  # 25 nations


@registry.query("""
    select case when o_orderstatus in ('F', 'O') then 'settled' else o_orderstatus end as status, count(*) as n, min(o_orderdate)::date as first_day, max(o_orderdate)::date as last_day from orders group by 1""")
def status_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by status, where two of them make one group."""
    status = F.when(F.col("o_orderstatus").isin("F", "O"), "settled").otherwise(F.col("o_orderstatus"))
    return table(spark, sf_dir, "orders").groupBy(status.alias("status")).agg(F.count("*").alias("n"), F.min("o_orderdate").cast("date").alias("first_day"), F.max("o_orderdate").cast("date").alias("last_day"))


@registry.query("""
    select user_id, event_type, event_id, value from events qualify row_number() over (partition by user_id, event_type order by ts, event_id) = 1""")
def first_of_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first find of each type for each user."""
    first = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id", "value")).alias("first"))
    return first.select("user_id", "event_type", "first.event_id", "first.value")


@registry.query("""
    with kinds as (select distinct event_type from events), users as (select distinct user_id from events)
    select user_id, string_agg(event_type, ',' order by event_type) as missing from users, kinds where (user_id, event_type) not in (select user_id, event_type from events) group by 1""")
def missing_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of all types each user lacks; users who have all are left out."""
    events = table(spark, sf_dir, "events")
    kinds = F.broadcast(events.agg(F.collect_set("event_type").alias("kinds")))  # one row: the few event types
    lacking = events.groupBy("user_id").agg(F.collect_set("event_type").alias("own")).join(kinds).select("user_id", F.array_sort(F.array_except("kinds", "own")).alias("missing"))
    return lacking.where(F.size("missing") > 0).select("user_id", F.array_join("missing", ",").alias("missing"))


@registry.query(r"""select doc_id, length(regexp_replace(text, '[^\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]', '', 'g')) > 0.3 * length(text) and length(text) > 0 as is_cjk from documents""")
def cjk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", (texts.cjk_share(F.col("text")) > 0.3).alias("is_cjk"))


@registry.query(r"""
    with o as (select o_orderkey, o_orderdate::date as d, 'Order; ' || o_orderpriority || ', status ' || o_orderstatus as title from orders)
    select o_orderkey, concat_ws(chr(13) || chr(10), 'BEGIN:VEVENT', 'UID:' || left(sha256(o_orderkey || '|' || strftime(d, '%Y%m%d') || '|' || title), 32), 'DTSTART;VALUE=DATE:' || strftime(d, '%Y%m%d'),
        'DTEND;VALUE=DATE:' || strftime(d + 1, '%Y%m%d'), 'SUMMARY:' || replace(replace(title, ',', '\,'), ';', '\;'), 'END:VEVENT') as vevent from o""")
def ics_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as an all-day calendar entry; the titles are too short to be folded."""
    title = F.concat(F.lit("Order; "), "o_orderpriority", F.lit(", status "), "o_orderstatus")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"), title.alias("title"))
    return exports.ics_events(orders, "o_orderkey", "day", "title")
