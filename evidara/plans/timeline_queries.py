"""Activity, calendars, graphs and web pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidara.functions import html, urls
from evidara.operators import activity, graph, state
from evidara.plans.registry import Registry
from evidara.session import durable, table

registry = Registry()
QUERIES, ORACLES = registry.queries, registry.oracles
AS_OF = "2024-01-31"
#: Event types in the role of activity sources, with their days of freshness.
ROLES = {"content": ("purchase", "signup", "click"), "site": ("view",), "fresh_days": {"purchase": 3, "signup": 5, "click": 2, "view": 1}}


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("entity"), F.col("event_type").alias("source")).agg(F.max("ts").cast("date").alias("date"))


_CANDIDATES = f"""
    with s as (select user_id as entity, event_type as source, max(ts)::date as date from events where event_type <> 'error' group by 1, 2),
    c as (select *, date_diff('day', date, date '{AS_OF}') as age_days, case source when 'purchase' then 0 when 'signup' then 1 when 'click' then 2 else 3 end as place, source <> 'view' as content,
        date_diff('day', date, date '{AS_OF}') <= case source when 'purchase' then 3 when 'signup' then 5 when 'click' then 2 else 1 end as fresh from s)"""


@registry.query(f"""{_CANDIDATES}, r as (select *, case when content and fresh then 1 when fresh then 2 when content then 3 else 4 end as step from c)
    select entity, source, date, age_days::int as age_days, step from r qualify row_number() over (partition by entity order by step, date desc, place) = 1""")
def activity_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.select_activity(_signals(spark, sf_dir), F.lit(AS_OF).cast("date"), **ROLES)


@registry.query(f"""{_CANDIDATES} select entity, source, date from c
    qualify row_number() over (partition by entity order by case when fresh then 0 else 1 end, case when fresh then place else age_days end, place) = 1""")
def activity_select_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.first_fresh(_signals(spark, sf_dir), F.lit(AS_OF).cast("date"), **ROLES)


@registry.query("select user_id as entity, max(ts)::date as date from events group by 1")
def activity_best_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.latest_of_any(_signals(spark, sf_dir))


_CALENDAR = """with cal as (select o_orderdate::date as date, 'manual' as source, o_orderkey as ref, o_custkey as owner from orders where o_orderdate >= timestamp '2001-01-01'
    union all select l_shipdate::date, 'ical', l_orderkey * 10 + l_linenumber, o_custkey from lineitem left join orders on l_orderkey = o_orderkey where l_shipdate >= timestamp '2001-01-01')"""


def _calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All dates from 2001 of both sources, in one shape."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    start = F.lit("2001-01-01").cast("timestamp_ntz")
    manual = orders.where(F.col("o_orderdate") >= start).select(F.col("o_orderdate").cast("date").alias("date"), F.lit("manual").alias("source"), F.col("o_orderkey").alias("ref"), F.col("o_custkey").alias("owner"))
    shipped = lines.where(F.col("l_shipdate") >= start).join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey", "left")
    return manual.unionByName(shipped.select(F.col("l_shipdate").cast("date").alias("date"), F.lit("ical").alias("source"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ref"), F.col("o_custkey").alias("owner")))


@registry.query(f"{_CALENDAR} select date, source, ref, owner from cal")
def calendar_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calendar(spark, sf_dir)


@registry.query(f"{_CALENDAR} select strftime(date, '%B %Y') as month, source, count(*) as n, min(date) as first_date from cal group by 1, 2")
def calendar_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calendar(spark, sf_dir).groupBy(F.date_format("date", "MMMM yyyy").alias("month"), "source").agg(F.count("*").alias("n"), F.min("date").alias("first_date"))


@registry.query(f"{_CALENDAR} select n_name as country, count(*) as n from cal left join customer on c_custkey = owner left join nation on n_nationkey = c_nationkey where n_name is not null group by 1")
def calendar_by_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = _calendar(spark, sf_dir).join(table(spark, sf_dir, "customer"), F.col("owner") == F.col("c_custkey"), "left").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return placed.where("n_name is not null").groupBy(F.col("n_name").alias("country")).agg(F.count("*").alias("n"))


@registry.query("""select event_id, case when d < 0 then 'past' when d = 0 then 'today' when d = 1 then 'tomorrow' when d <= 7 then 'this week' else 'later' end as bucket
    from (select event_id, date_diff('day', date '2024-01-15', ts::date) as d from events)""")
def relative_day_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-15").cast("date"))
    return table(spark, sf_dir, "events").select("event_id", F.when(days < 0, "past").when(days == 0, "today").when(days == 1, "tomorrow").when(days <= 7, "this week").otherwise("later").alias("bucket"))


@registry.query("""with x as (select o_custkey, o_orderkey, o_orderdate, o_orderdate >= timestamp '1998-06-01' as upcoming from orders)
    select o_custkey, o_orderkey, upcoming, row_number() over (partition by o_custkey, upcoming order by case when upcoming then epoch(o_orderdate) else -epoch(o_orderdate) end, o_orderkey)::int as place from x""")
def upcoming_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each owner's dates in two lists: upcoming ones nearest first, past ones latest first."""
    split = table(spark, sf_dir, "orders").withColumn("upcoming", F.col("o_orderdate") >= F.lit("1998-06-01").cast("timestamp_ntz"))
    away = F.abs(F.datediff("o_orderdate", F.lit("1998-06-01")))
    return split.select("o_custkey", "o_orderkey", "upcoming", F.row_number().over(Window.partitionBy("o_custkey", "upcoming").orderBy(away, "o_orderkey")).alias("place"))


@registry.query("select user_id, event_id, row_number() over (partition by user_id order by ts, event_id)::int as place from events where ts >= timestamp '2024-01-10' and ts < timestamp '2024-01-25' qualify place <= 15")
def top_n_per_org(spark: SparkSession, sf_dir: str) -> DataFrame:
    horizon = table(spark, sf_dir, "events").where((F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz")) & (F.col("ts") < F.lit("2024-01-25").cast("timestamp_ntz")))
    return horizon.select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("place")).where("place <= 15")


@registry.query(f"""with a as (select user_id, date_diff('day', max(ts)::date, date '{AS_OF}') as age, count(*) filter (event_type = 'error') as errors from events group by 1)
    select count(*) as n_all, count(*) filter (age > 1) as n_stale, count(*) filter (errors >= 10) as n_failing from a""")
def review_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ages = table(spark, sf_dir, "events").groupBy("user_id").agg(F.datediff(F.lit(AS_OF).cast("date"), F.max("ts").cast("date")).alias("age"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return ages.agg(F.count("*").alias("n_all"), F.count_if(F.col("age") > 1).alias("n_stale"), F.count_if(F.col("errors") >= 10).alias("n_failing"))


_EDGES = "with e as (select distinct least('part:' || l_partkey, 'supplier:' || l_suppkey) as source, greatest('part:' || l_partkey, 'supplier:' || l_suppkey) as target from lineitem)"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return graph.canonical_edges(lines, F.concat(F.lit("part:"), "l_partkey"), F.concat(F.lit("supplier:"), "l_suppkey"))


@registry.query(f"{_EDGES} select source, target from e")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir)


@registry.query(f"{_EDGES} select 'supplier:7' as node union select source from e where target = 'supplier:7' union select target from e where source = 'supplier:7'")
def graph_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbourhood(_edges(spark, sf_dir), "supplier:7")


_RANK = "r as (select c_custkey, (row_number() over (order by max(o_orderdate) desc, c_custkey) - 1.0::double) / (count(*) over () - 1) as t from customer join orders on o_custkey = c_custkey group by 1)"


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last"))
    return graph.reveal_rank(table(spark, sf_dir, "customer").join(last, "c_custkey").select("c_custkey", "last"), [F.desc("last"), F.col("c_custkey")])


@registry.query(f"with {_RANK} select c_custkey, round(t, 9) as t, round(1 + 3 * t, 9) as reveal from r")
def reveal_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir).select("c_custkey", F.round("t", 9).alias("t"), F.round("reveal", 9).alias("reveal"))


@registry.query(f"""with {_RANK}, e as (select distinct o_custkey as a, (o_custkey + o_orderkey) % 1500 as b from orders)
    select a, b, round(greatest(coalesce(x.t, 0), coalesce(y.t, 0)), 9) as staleness from e left join r x on x.c_custkey = a left join r y on y.c_custkey = b""")
def edge_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("a"), ((F.col("o_custkey") + F.col("o_orderkey")) % 1500).alias("b")).distinct()
    ranks = durable(_ranked(spark, sf_dir))
    both = edges.join(ranks.select(F.col("c_custkey").alias("a"), F.col("t").alias("ta")), "a", "left").join(ranks.select(F.col("c_custkey").alias("b"), F.col("t").alias("tb")), "b", "left")
    return both.select("a", "b", F.round(F.greatest(F.coalesce("ta", F.lit(0.0)), F.coalesce("tb", F.lit(0.0))), 9).alias("staleness"))


@registry.query(r"""with t as (select page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g') as t from pages)
    select page_id, trim(regexp_replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) as text from t""")
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", html.html_to_text(F.col("html")).alias("text"))


_LINKS = r"""regexp_extract_all(html, '(?i)<a\s[^>]*href="([^"]*)"', 1)"""


@registry.query(rf"""select page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) as title, len({_LINKS})::int as n_links, contains(html, 'charset="utf-8"') as utf8 from pages""")
def page_title_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", html.title(page).alias("title"), F.size(html.links(page)).alias("n_links"), F.contains(page, F.lit('charset="utf-8"')).alias("utf8"))


@registry.query(rf"""with l as (select page_id, unnest({_LINKS}) as href from pages) select distinct page_id, href from l where href not in (select href from l group by 1 having count(*) >= 5)""")
def page_links_internal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links to targets that are no well-known ones, those to which fewer than five links lead."""
    links = table(spark, sf_dir, "pages").select("page_id", F.explode(html.links(F.col("html"))).alias("href"))
    known = links.groupBy("href").agg(F.count("*").alias("n")).where("n >= 5")
    return links.join(known, "href", "left_anti").select("page_id", "href").distinct()


@registry.query(rf"""select page_id, case when len({_LINKS}) < 5 then 'needs a browser' when not contains(html, '</html>') then 'cut off' else 'ok' end as hint from pages""")
def failure_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    few = F.size(html.links(F.col("html"))) < 5
    return table(spark, sf_dir, "pages").select("page_id", F.when(few, "needs a browser").when(~F.contains(F.col("html"), F.lit("</html>")), "cut off").otherwise("ok").alias("hint"))


@registry.query("select regexp_replace(regexp_replace(url, '#.*$', ''), '/+$', '') as url, count(*) as n_pages, min(page_id) as first_page from pages group by 1")
def url_parts_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy(urls.without_slash(urls.without_fragment(F.col("url"))).alias("url")).agg(F.count("*").alias("n_pages"), F.min("page_id").alias("first_page"))


@registry.query(r"""with p as (select page_id, regexp_replace(url, '[?#].*$', '') as u from pages), k as (select u, min(page_id) as target from p group by 1)
    select p.page_id, coalesce(a.target, b.target, c.target) as target from (select page_id, case when page_id % 2 = 0 then regexp_replace(u, '/+$', '') else u || '/' end as want from p) p
    left join k a on a.u = want left join k b on b.u = regexp_replace(want, '/+$', '') left join k c on c.u = regexp_replace(want, '/+$', '') || '/' """)
def trailing_slash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted URLs against stored ones, as written, without and with an end slash; the first that fits counts.

    The stored URLs meet the wanted ones once, by their form without slash.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("u"))
    stored = pages.groupBy("u").agg(F.min("page_id").alias("target")).withColumn("bare", urls.without_slash(F.col("u")))
    want = F.when(F.col("page_id") % 2 == 0, urls.without_slash(F.col("u"))).otherwise(F.concat("u", F.lit("/")))
    met = pages.select("page_id", want.alias("want")).withColumn("bare", urls.without_slash(F.col("want"))).join(stored.select("bare", "u", "target"), "bare", "left")
    place = F.when(F.col("u") == F.col("want"), 0).when(F.col("u") == F.col("bare"), 1).when(F.col("u") == F.concat("bare", F.lit("/")), 2)
    return met.groupBy("page_id").agg(F.min_by("target", F.when(place.isNotNull(), place)).alias("target"))


@registry.query(r"""with m as (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+')) as email from documents),
    k as (select distinct doc_id, lower(email) as email from m where not contains(lower(email), 'noreply'))
    select doc_id, email from k qualify row_number() over (partition by doc_id order by case when split_part(email, '@', 1) in ('info', 'contact', 'hello', 'office') then 0 else 1 end, email) = 1""")
def email_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One address for each document, a general one first."""
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), F.lit(0))).alias("email"))
    kept = found.select("doc_id", F.lower("email").alias("email")).where(~F.contains("email", F.lit("noreply")))
    general = F.substring_index("email", "@", 1).isin("info", "contact", "hello", "office")
    return kept.groupBy("doc_id").agg(F.min_by("email", F.struct(F.when(general, 0).otherwise(1), "email")).alias("email"))


@registry.query("""select o_orderkey, o_orderdate::date as parsed from orders""")
def text_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates written in three ways, by the last digit of the key, and read back without knowing which."""
    way = F.col("o_orderkey") % 3
    text = F.when(way == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(way == 1, F.date_format("o_orderdate", "d MMMM yyyy")).otherwise(F.date_format("o_orderdate", "MMMM d, yyyy"))
    read = F.coalesce(*(F.try_to_timestamp("written", F.lit(p)).cast("date") for p in ("yyyy-MM-dd", "d MMMM yyyy", "MMMM d, yyyy")))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.alias("written")).select("o_orderkey", read.alias("parsed"))


@registry.query("select c_custkey, o_orderkey as first_order from (select o_custkey as c_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as n from orders) where n = 1")
def first_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("first_order"), "o_orderdate")
    return state.first_wins(orders, ["c_custkey"], [F.col("o_orderdate"), F.col("first_order")]).drop("o_orderdate")
