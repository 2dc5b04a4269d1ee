"""Kept pages, canonical documents, calendar files, logos, the site's graph, and evidence gathered from documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidara.functions import markup
from evidara.functions.text import locale_order
from evidara.operators import collection, integrity, site_graph
from evidara.plans.registry import Registry
from evidara.session import scratch_folder, table
from evidara.sinks import calendars
from evidara.sources import canonical, page_cache

registry = Registry()
QUERIES, ORACLES = registry.queries, registry.oracles


def _folder(spark: SparkSession, name: str) -> str:
    return f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"


@registry.query("""
    with kept as (
        select url, arg_max(html, (era, page_id)) as text, max(era) as era from (
            select url, html, page_id, 1 as era from pages where page_id % 3 <> 0 and html <> '' union all select url, html || ' (again)', page_id, 2 from pages where page_id % 5 = 0)
        group by url)
    select p.page_id, case when k.url is null then 'NOT_CACHED' else 'CACHED' end as page_status, case k.era when 1 then date '2024-01-01' when 2 then date '2024-01-09' end as page_checked,
        left(sha256(k.text), 16) as text_key, length(k.text) as chars, contains(k.text, regexp_extract(p.html, '<h1>([^<]*)</h1>', 1)) as holds
    from pages p left join kept k on k.url = p.url""")
def page_cache_offline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs keep pages, the second over the first; then each page's heading is looked up in what is kept of its URL."""
    pages, folder = table(spark, sf_dir, "pages"), _folder(spark, "page-cache")
    day = lambda text: F.lit(text).cast("date")
    page_cache.store(folder, pages.where("page_id % 3 <> 0").select("url", F.col("html").alias("text"), "page_id"), day("2024-01-01"), "page_id")
    page_cache.store(folder, pages.where("page_id % 5 = 0").select("url", F.concat("html", F.lit(" (again)")).alias("text"), "page_id"), day("2024-01-09"), "page_id")
    claims = pages.select("page_id", "url", F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("quote"))
    found = page_cache.look_up(claims, page_cache.read_cache(spark, folder))
    return found.select("page_id", "page_status", "page_checked", F.left(F.sha2("page_text", 256), F.lit(16)).alias("text_key"), F.length("page_text").cast("long").alias("chars"), F.contains("page_text", "quote").alias("holds"))


@registry.query("""
    with o as (select page_id, split_part(url, ':', 1) as scheme, regexp_extract(url, '^[a-z]+://[^/?#]*', 0) as site, regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '[^/]*$', '') as folder from pages)
    select page_id, case page_id % 4 when 0 then site || '/logos/' || page_id || '.png' when 1 then site || '/touch-180.png' when 2 then scheme || '://cdn.example/card.jpg' else site || case when folder = '' then '/' else folder end || 'icon-32.png?v=' || page_id end as url,
        case page_id % 4 when 0 then 'img-logo' when 1 then 'apple-touch-icon' when 2 then 'og-image' else 'favicon' end as kind,
        case when page_id % 4 < 2 then 'high' else 'low' end as confidence, 3 as n
    from o""")
def logo_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of each page's possible logos, and how many there are; two tags of one kind are put in front of every page."""
    key = F.col("page_id").cast("string")
    tags = (
        F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("<img alt='Award logo' src='/a.png'><img class=\"site-logo\" src=\"dot.gif\" data-src='/logos/"), key, F.lit(".png'><IMG id='logo' src='/second.png'>")))
        .when(F.col("page_id") % 4 == 1, "<link rel='apple-touch-icon' href='/touch-57.png' sizes='57x57'><link href='/touch-180.png' rel=\"Apple-Touch-Icon\" sizes='60x60 180x180'>")
        .when(F.col("page_id") % 4 == 2, "<meta property='og:image' content='//cdn.example/card.jpg'><meta name='twitter:image' content='/other.jpg'><meta name='description' content='logo'>")
        .otherwise(F.concat(F.lit("<link rel='icon' href='/icon-16.png' sizes='16x16'><link rel='shortcut icon' sizes='32x32' href='icon-32.png?v="), key, F.lit("'><link rel='stylesheet' href='x.css'>")))
    )
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.concat(tags, F.col("html")).alias("html"))
    found = pages.select("page_id", markup.logo_candidates(F.col("html"), F.col("url")).alias("all"))
    return found.select("page_id", F.col("all")[0]["url"].alias("url"), F.col("all")[0]["kind"].alias("kind"), F.col("all")[0]["confidence"].alias("confidence"), F.size("all").alias("n"))


@registry.query("""
    select doc_id, doc_id % 3 <> 0 as out_of_order, sha256('---' || chr(10) || 'title: Document ' || doc_id || chr(10) || 'status: active' || chr(10) || 'events:' || chr(10) || '- date: ''2024-01-05''' || chr(10)
        || '  url: https://e.example/' || doc_id || chr(10) || '  extra: 1' || chr(10) || 'last_checked: ''2024-01-31''' || chr(10) || 'size: ' || length(text) || chr(10) || '---' || chr(10) || text) as text_sha256
    from documents where text is not null""")
def canonical_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with front matter in three orders, one of them canonical, and whole texts as bodies, brought in order."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    title, size = F.concat(F.lit("title: Document "), "doc_id"), F.concat(F.lit("size: "), F.length("text"))
    url = F.concat(F.lit("url: https://e.example/"), "doc_id")
    events = F.concat(F.lit("events:\n- date: '2024-01-05'\n  "), url, F.lit("\n  extra: 1"))
    mixed = F.concat(F.lit("events:\n- extra: 1\n  "), url, F.lit("\n  date: '2024-01-05'"))
    status, checked = F.lit("status: active"), F.lit("last_checked: '2024-01-31'")
    front = F.when(F.col("doc_id") % 3 == 0, F.concat_ws("\n", title, status, events, checked, size)).when(F.col("doc_id") % 3 == 1, F.concat_ws("\n", size, checked, mixed, status, title)).otherwise(F.concat_ws("\n", status, title, mixed, size, checked))
    written = docs.select("doc_id", F.concat(F.lit("---\n"), front, F.lit("\n---\n"), "text").alias("text"))
    return canonical.canonical_documents(written).select("doc_id", "out_of_order", F.sha2("canonical", 256).alias("text_sha256"))


@registry.query("""
    with e as (select 'c' || c_nationkey as country, o_orderkey, o_orderpriority as org from orders join customer on c_custkey = o_custkey)
    select country, count(*) as events, count(*) filter (o_orderkey % 3 = 0) as timed, 6 + sum(case when o_orderkey % 4 = 0 then 9 else 8 end - case when o_orderkey % 5 = 0 then 0 else 1 end * case when o_orderkey % 3 = 0 then 0 else 1 end)::bigint as lines,
        count(distinct org) as organisations from e group by 1""")
def country_calendars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as events, written as one calendar file for each nation, and read again line by line."""
    orders, customers, folder = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), _folder(spark, "calendars")
    key = F.col("o_orderkey")
    events = orders.join(customers, F.col("c_custkey") == F.col("o_custkey")).select(
        F.concat(F.lit("c"), "c_nationkey").alias("country"), F.col("o_orderdate").cast("date").alias("date"), F.when(key % 5 == 0, F.date_add(F.col("o_orderdate").cast("date"), 2)).alias("end_date"),
        F.when(key % 3 == 0, "9:30").otherwise("evening").alias("time"), F.when(key % 3 == 0, "11:00").alias("end_time"), F.col("o_orderpriority").alias("org"), F.concat(F.lit("Order, "), key).alias("title"),
        F.when(key % 4 == 0, F.concat(F.lit("https://o.example/"), key)).alias("url"),
    )
    calendars.write_calendars(events, folder, "country", F.concat(F.lit("Events of "), "country"), "evidara.example", "20240131T000000Z")
    lines = spark.read.option("lineSep", "\r\n").text(folder)
    begins = lambda text: F.count_if(F.col("value").startswith(text))
    organisations = F.count_distinct(F.when(F.col("value").startswith("CATEGORIES:"), F.col("value")))
    return lines.groupBy("country").agg(begins("BEGIN:VEVENT").alias("events"), begins("DTSTART:").alias("timed"), F.count("*").alias("lines"), organisations.alias("organisations"))


@registry.query("""
    with n as (select p_brand, p_partkey, case p_partkey % 3 when 0 then upper(p_name) when 1 then p_name else replace(p_name, 'e', 'é') end as label, lower(p_name) as plain, p_partkey % 3 = 2 as accented from part)
    select p_brand, label, p_partkey, (row_number() over (partition by p_brand order by plain, accented and contains(label, 'é'), p_partkey))::int as place from n""")
def locale_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in three spellings in the order of languages within each brand: case aside, accented ones just after plain ones."""
    name = F.col("p_name")
    parts = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.upper(name)).when(F.col("p_partkey") % 3 == 1, name).otherwise(F.replace(name, F.lit("e"), F.lit("é"))).alias("label"))
    order = Window.partitionBy("p_brand").orderBy(locale_order(F.col("label")), "p_partkey")
    return parts.select("p_brand", "label", "p_partkey", F.row_number().over(order).alias("place"))


@registry.query("""
    with items as (
        select 'https://e.example/' || doc_id % 50 as url, substring(text, 1, 40) as quote, doc_id || ' [2024-01-05] ' || substring(text, 1, 50) as label, 'event' as kind, 'docs/' || doc_id || '.md' as path from documents where text <> '' and doc_id % 5 <> 0
        union all select 'https://f.example/' || doc_id, 'note ' || doc_id, 'docs/' || doc_id || '.md:2 [^n]', 'footnote', 'docs/' || doc_id || '.md' from documents where doc_id % 2 = 0 and text is not null
        union all select url, t, 'posts/' || page_id || ' shared_link (' || substring(t, 1, 50) || ')', 'shared_link', 'posts/' || page_id from (select *, regexp_extract(html, '<title>([^<]*)</title>', 1) as t from pages) where url <> '' and t <> ''),
    known as (select distinct url, quote from items where kind = 'event' and length(label) % 3 = 0)
    select url, sha256(quote) as quote_sha256, label, kind, path from items i where not exists (select 1 from known k where k.url = i.url and k.quote = i.quote)""")
def unchecked_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of three kinds from documents and pages, less what is known: events at the start of texts, a footnote before them, shared links of pages."""
    documents, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    path = F.concat(F.lit("docs/"), "doc_id", F.lit(".md"))
    event = lambda url: F.struct(F.lit("2024-01-05").alias("date"), F.col("text").alias("title"), url.alias("url"), F.left("text", F.lit(40)).alias("quote"), (F.col("doc_id") % 5 == 0).alias("proof_warning"))
    events = F.array(event(F.concat(F.lit("https://e.example/"), F.col("doc_id") % 50)), event(F.lit("")))
    records = documents.select(path.alias("path"), F.col("doc_id").cast("string").alias("slug"), F.struct(events.alias("events")).alias("record"))
    note = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("\n[^n]: [T](https://f.example/"), "doc_id", F.lit(') says "note '), "doc_id", F.lit('" plainly\n'))).otherwise(F.lit("\n[^n]: nothing\n"))
    docs = documents.select(path.alias("path"), F.concat(note, F.col("text")).alias("text"))
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    posts = pages.select(F.concat(F.lit("posts/"), "page_id").alias("path"), F.struct("url", title.alias("title"), title.alias("description")).alias("shared_link"))
    known = collection.event_evidence(records).where("length(label) % 3 = 0")
    found = collection.unchecked(collection.collect_evidence(records, docs, posts), known)
    return found.select("url", F.sha2("quote", 256).alias("quote_sha256"), "label", "kind", "path")


@registry.query("""
    with d as (select doc_id, case doc_id % 3 when 0 then 'concept:' when 1 then 'org:' else 'project:' end || doc_id as id from documents),
    e as (
        select id as source, 'concept:' || (doc_id + 3) as target, 'see_also' as type from d where doc_id % 3 = 0
        union all select id, 'concept:' || (doc_id + 2), 'relates_to' from d where doc_id % 3 = 1
        union all select least(id, 'org:' || (doc_id * 2 - 1)), greatest(id, 'org:' || (doc_id * 2 - 1)), 'org_link' from d where doc_id % 3 = 1
        union all select id, 'org:' || (doc_id - 1), 'relates_to' from d where doc_id % 3 = 2
        union all select id, 'concept:' || (doc_id + 1), 'relates_to' from d where doc_id % 3 = 2)
    select distinct source, target, type from e where source in (select id from d) and target in (select id from d)""")
def site_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a site's pages of three kinds, whole texts followed by sections of links, and the edges between pages that exist."""
    key = F.col("doc_id")
    kind = F.when(key % 3 == 0, "concepts").when(key % 3 == 1, "organisations").otherwise("projects")
    target = F.when(key % 3 == 0, F.concat(F.lit("[c]("), key + 3, F.lit(".md#top) [far](../concepts/"), key + 6, F.lit(".md) [web](https://x.example/a.md)"))).when(key % 3 == 1, F.concat(F.lit("[c]("), key + 2, F.lit(".md)"))).otherwise(F.concat(F.lit("[o](../organisations/"), key - 1, F.lit(".md) [c]("), key + 4, F.lit(".md)")))
    text = F.concat(F.coalesce("text", F.lit("")), F.lit("\n## See also\n\n- "), target, F.lit("\n### Deeper\n## Next\n[n]("), key + 9, F.lit(".md)\n"))
    docs = table(spark, sf_dir, "documents").select(
        F.concat(kind, F.lit("/"), key, F.lit(".md")).alias("path"), text.alias("text"), F.lit("T").alias("title"), F.lit("").alias("type"), F.lit("").alias("status"), F.lit("").alias("logo"), F.lit("").alias("activity_date"),
        F.array((key + F.when(key % 3 == 1, 2).otherwise(1)).cast("string")).alias("concepts"), F.array((key * 2 - 1).cast("string")).alias("related_orgs"),
    )
    return site_graph.graph(docs)[1].select("source", "target", "type")


@registry.query("""
    with p as (select c_custkey as part, c_nationkey as nation_key, case c_custkey % 4 when 0 then 'active' when 1 then 'inactive' when 2 then 'gone' else '' end as status, c_acctbal as place from customer),
    r as (select part::varchar as slug, status, case when part % 5 = 0 then 'https://web.archive.org/web/2/https://c' when part % 5 = 1 then 'https://c.example' else '' end as site, place, case when part % 7 = 0 then 'Germany' else 'DE' end as country, nation_key from p)
    select slug, 'status' as rule from r where status = 'gone' union all select slug, 'website-active' from r where status = 'active' and site like '%archive%'
    union all select slug, 'website-inactive' from r where status = 'inactive' and site = 'https://c.example' union all select slug, 'location' from r where status = 'active' and place < 0
    union all select slug, 'country' from r where country = 'Germany' union all select slug, 'concepts' from r where nation_key not in (select n_nationkey from nation where n_regionkey < 3)""")
def record_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six rules of records on customers, whose nations play the concepts and whose balances the places."""
    key = F.col("c_custkey")
    nations = table(spark, sf_dir, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").cast("string").alias("slug"))
    record = F.struct(
        F.when(key % 4 == 0, "active").when(key % 4 == 1, "inactive").when(key % 4 == 2, "gone").otherwise("").alias("status"),
        F.when(key % 5 == 0, "https://web.archive.org/web/2/https://c").when(key % 5 == 1, "https://c.example").otherwise("").alias("website"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("latitude"), F.lit(None).cast("double").alias("longitude"), F.lit(None).cast("string").alias("location_name"),
        F.when(key % 7 == 0, "Germany").otherwise("DE").alias("country"), F.array(F.col("c_nationkey").cast("string")).alias("concepts"), F.lit(None).cast("string").alias("last_checked"),
    )
    return integrity.record_issues(table(spark, sf_dir, "customer").select(key.cast("string").alias("slug"), record.alias("record")), nations)


@registry.query("""
    with w as (select doc_id, text, case doc_id % 4 when 0 then text when 1 then '---' || chr(10) || text when 2 then '---' || chr(10) || 'a: 1' || chr(10) || '---' || chr(10) || text else '---' || chr(10) || 'a: 1' || chr(10) || '---' || chr(10) || text || chr(10) || '---' || chr(10) || 'more' end as t from documents where text is not null)
    select doc_id, case doc_id % 4 when 0 then 'fm-opening' when 1 then 'fm-closing' else 'fm-stray' end as rule, case when doc_id % 4 = 3 then len(string_split(t, chr(10)))::int - 1 end as line from w where doc_id % 4 <> 2""")
def front_matter_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts without front matter, with an open one, a good one, and a stray rule behind it."""
    text = F.col("text")
    good = F.concat(F.lit("---\na: 1\n---\n"), text)
    written = F.when(F.col("doc_id") % 4 == 0, text).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("---\n"), text)).when(F.col("doc_id") % 4 == 2, good).otherwise(F.concat(good, F.lit("\n---\nmore")))
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", written.alias("text"))
    return integrity.front_matter_issues(docs, "doc_id")
