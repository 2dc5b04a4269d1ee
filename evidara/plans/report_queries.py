"""Statistics, work queues, facets, integrity and sourcing reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidara.functions.urls import is_weak
from evidara.operators import facets, footnotes, integrity
from evidara.operators.activity import freshness_bucket
from evidara.plans.registry import Registry
from evidara.session import table

registry = Registry()
QUERIES, ORACLES = registry.queries, registry.oracles
AS_OF = "2001-08-01"


def _as_of():
    return F.lit(AS_OF).cast("date")


@registry.query("select o_orderstatus as status, count(*) as n, count(*) filter (o_orderpriority = '1-URGENT') as n_urgent from orders group by 1")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("n_urgent"))


@registry.query("select n_name as country, count(*) as n, count(distinct c_mktsegment) as n_types from customer join nation on c_nationkey = n_nationkey where c_acctbal > 0 group by 1")
def active_counts_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = table(spark, sf_dir, "customer").where("c_acctbal > 0").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return active.groupBy(F.col("n_name").alias("country")).agg(F.count("*").alias("n"), F.countDistinct("c_mktsegment").alias("n_types"))


@registry.query(f"""
    with a as (select c_custkey, date_diff('day', max(o_orderdate)::date, date '{AS_OF}') as age from customer left join orders on o_custkey = c_custkey group by 1)
    select case when age >= 365 then '365+' when age >= 180 then '180-365' when age >= 90 then '90-180' when age >= 30 then '30-90' when age >= 0 then '0-30' end as bucket, count(*) as n from a group by 1""")
def freshness_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ages(spark, sf_dir).groupBy(freshness_bucket(F.col("age")).alias("bucket")).agg(F.count("*").alias("n"))


def _ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's days since the last order; null without any."""
    last = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").cast("date").alias("last_checked"))
    return table(spark, sf_dir, "customer").join(last, "c_custkey", "left").select("c_custkey", "last_checked", F.datediff(_as_of(), F.col("last_checked")).alias("age"))


@registry.query(f"""
    with a as (select c_custkey, max(o_orderdate)::date as last_checked from customer left join orders on o_custkey = c_custkey group by 1)
    select c_custkey, row_number() over (order by last_checked nulls first, c_custkey) as place from a where last_checked is null or date_diff('day', last_checked, date '{AS_OF}') >= 365
    order by place limit 200""")
def recheck_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 200 entities most in need of a check: never checked first, then the oldest. The limit is the feature."""
    stale = _ages(spark, sf_dir).where("age is null or age >= 365").orderBy(F.col("last_checked").asc_nulls_first(), "c_custkey").limit(200)
    return stale.select("c_custkey", F.row_number().over(Window.orderBy(F.col("last_checked").asc_nulls_first(), "c_custkey")).cast("long").alias("place"))


@registry.query("select o_orderkey, o_orderdate::date as checked from orders where o_orderdate >= timestamp '2001-07-01'")
def checked_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = table(spark, sf_dir, "orders").where(F.col("o_orderdate") >= F.lit("2001-07-01").cast("timestamp_ntz"))
    return recent.select("o_orderkey", F.col("o_orderdate").cast("date").alias("checked"))


@registry.query(r"""
    with w as (select unnest(regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+')) as word from documents)
    select word, count(*) as n from w group by 1 order by n desc, word limit 10""")
def top_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(10)


_KNOWN = "(select p_partkey from part where p_size <= 25)"


@registry.query(f"select l_orderkey, l_linenumber, l_partkey from lineitem where l_partkey not in {_KNOWN}")
def invalid_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "part").where("p_size <= 25")
    return integrity.broken_references(table(spark, sf_dir, "lineitem"), known, "l_partkey", "p_partkey").select("l_orderkey", "l_linenumber", "l_partkey")


@registry.query("select p_partkey, p_name from part where p_partkey not in (select l_partkey from lineitem where l_quantity > 45)")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.orphans(table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem").where("l_quantity > 45"), "p_partkey", "l_partkey").select("p_partkey", "p_name")


@registry.query(f"select count(distinct l_partkey) as n_valid from lineitem where l_partkey in {_KNOWN}")
def referenced_and_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "part").where("p_size <= 25").select(F.col("p_partkey").alias("l_partkey"))
    return table(spark, sf_dir, "lineitem").join(known, "l_partkey", "left_semi").agg(F.countDistinct("l_partkey").alias("n_valid"))


@registry.query("select p_partkey as org_slug, unnest(string_split(p_name, ' ')) as concept_slug from part")
def edge_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("org_slug"), F.explode(F.split("p_name", " ")).alias("concept_slug"))


@registry.query("""
    select r_name, n_name, count(c_custkey) as n, coalesce(string_agg(distinct c_mktsegment, '; ' order by c_mktsegment), '') as segments
    from nation join region on n_regionkey = r_regionkey left join customer on c_nationkey = n_nationkey group by 1, 2""")
def flat_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    joined = places.join(table(spark, sf_dir, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return joined.groupBy("r_name", "n_name").agg(F.count("c_custkey").alias("n"), F.array_join(F.array_sort(F.collect_set("c_mktsegment")), "; ").alias("segments"))


CHOSEN = {"brand": ["Brand#1", "Brand#2", "Brand#3"], "type": ["PROMO", "ECONOMY"], "concepts": ["ring", "widget"]}


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", "p_size", F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.split("p_name", " ").alias("concepts"))


_F = "with f as (select p_partkey, p_size, p_brand as brand, p_type as type, string_split(p_name, ' ') as concepts, p_brand in ('Brand#1', 'Brand#2', 'Brand#3') as b, p_type in ('PROMO', 'ECONOMY') as t, list_has_any(string_split(p_name, ' '), ['ring', 'widget']) as c from part where p_size >= 10)"


@registry.query(f"{_F} select p_partkey from f where b and t and c")
def facet_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.facet_filter(_parts(spark, sf_dir).where("p_size >= 10"), CHOSEN).select("p_partkey")


@registry.query(f"""{_F} select 'brand' as facet, brand as value, count(*) filter (t and c) as n from f group by 1, 2
    union all select 'type', type, count(*) filter (b and c) from f group by 1, 2
    union all select 'concepts', v, count(*) filter (b and t) from (select b, t, unnest(concepts) as v from f) group by 1, 2""")
def facet_counts_drill_sideways(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.drill_sideways(_parts(spark, sf_dir).where("p_size >= 10"), CHOSEN)


@registry.query("select distinct 'brand' as facet, p_brand as value from part union select 'type', p_type from part union select 'concepts', unnest(string_split(p_name, ' ')) from part")
def facet_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.facet_options(_parts(spark, sf_dir), ["brand", "type", "concepts"])


@registry.query(r"""
    select c_custkey, 'negative_balance' as rule from customer where c_acctbal < 0
    union all select c_custkey, 'unknown_country' from customer where c_nationkey not in (select n_nationkey from nation where n_regionkey < 4)
    union all select c_custkey, 'bad_name' from customer where not regexp_matches(c_name, '^Customer#[0-9]{8}[1-9]$')""")
def record_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").where("n_regionkey < 4").select("n_nationkey", F.lit(True).alias("known"))
    joined = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    rules = {"negative_balance": F.col("c_acctbal") < 0, "unknown_country": F.col("known").isNull(), "bad_name": ~F.col("c_name").rlike("^Customer#[0-9]{8}[1-9]$")}
    return integrity.lint(joined, "c_custkey", rules)


@registry.query("""
    select 'events' as source, count(*) as n, count(*) filter (event_type = 'error') as n_failed from events
    union all select 'documents', count(*), count(*) filter (length(text) < 100) from documents
    union all select 'pages', count(*), count(*) filter (not contains(html, '</html>')) from pages""")
def gate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    def gate(name: str, failed) -> DataFrame:
        return table(spark, sf_dir, name).agg(F.count("*").alias("n"), F.count_if(failed).alias("n_failed")).select(F.lit(name).alias("source"), "n", "n_failed")

    return gate("events", F.col("event_type") == "error").unionByName(gate("documents", F.length("text") < 100)).unionByName(gate("pages", ~F.contains(F.col("html"), F.lit("</html>"))))


@registry.query("""
    select case when l.doc_id is null then 'unset' when quality = 1 and toxic = 0 then 'high' when quality = 1 then 'medium' else 'low' end as level, count(*) as n
    from documents d left join labels l using (doc_id) group by 1""")
def proof_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").withColumn("known", F.lit(True))
    level = F.when(F.col("known").isNull(), "unset").when((F.col("quality") == 1) & (F.col("toxic") == 0), "high").when(F.col("quality") == 1, "medium").otherwise("low")
    return table(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id", "left").groupBy(level.alias("level")).agg(F.count("*").alias("n"))


@registry.query(r"""
    with p as (select page_id, url, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) as path from pages)
    select page_id, not regexp_matches(url, '#.') and (path in ('', '/') or regexp_matches(lower(path), '^/*(events?|news|blog|calendar|press|media|updates|whats-on)/*$')) as weak from p""")
def weak_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", is_weak(F.col("url")).alias("weak"))


@registry.query("select c_custkey, count(o_orderkey) as n from customer left join orders on o_custkey = c_custkey where c_acctbal > 0 group by 1 having count(o_orderkey) between 1 and 5")
def thin_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "customer").where("c_acctbal > 0").join(counts, "c_custkey").where("n between 1 and 5").select("c_custkey", "n")


@registry.query("""
    select source as folder, count(*) * 2 as total, count(*) filter (doc_id % 3 = 0) as with_quote, count(*) filter (doc_id % 3 = 1) + count(*) filter (doc_id % 2 = 0) as justified,
        count(*) filter (doc_id % 2 = 0) as vague, count(*) filter (doc_id % 3 = 2) + count(*) filter (doc_id % 2 = 1) as missing from documents group by 1""")
def footnote_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many footnotes of each source's documents can be checked or say why not; two are put below each whole text."""
    link = F.concat(F.lit("\n[^1]: [A page](https://a.example/"), "doc_id", F.lit("_(x)) "))
    first = F.when(F.col("doc_id") % 3 == 0, 'says "so it is"').when(F.col("doc_id") % 3 == 1, "<!-- unquoted: scanned: an image without any text -->").otherwise("says nothing")
    second = F.when(F.col("doc_id") % 2 == 0, '\n[^b]: a book, "read" <!-- unquoted: print: on paper -->').otherwise('\r\n[^b]: ["only in the link"](https://b.example)')
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("folder"), F.concat(F.coalesce("text", F.lit("")), link, first, second).alias("text"))
    return footnotes.coverage(footnotes.definitions(docs), "folder")


_LINES = r"""with l as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) as n, unnest(string_split(text, chr(10))) as line from documents)"""


@registry.query(f"""{_LINES}, h as (select doc_id, n, line, string_agg(line, chr(10)) over (partition by doc_id order by n rows between 1 preceding and 1 following) as context from l)
    select doc_id, n as line_no, line, context from h where contains(line, 'that the')""")
def full_text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with the phrase and the lines around them; a document's lines stay in its row, so nothing is shuffled."""
    lines = F.split("text", "\n")
    near = F.array_join(F.slice(lines, F.greatest(F.col("at"), F.lit(1)), F.when(F.col("at") == 0, 2).otherwise(3)), "\n")
    hits = table(spark, sf_dir, "documents").where(F.contains(F.col("text"), F.lit("that the"))).select("doc_id", "text", F.posexplode(lines).alias("at", "line"))
    return hits.where(F.contains(F.col("line"), F.lit("that the"))).select("doc_id", (F.col("at") + 1).cast("long").alias("line_no"), "line", near.alias("context"))
