"""Near misses of quotes, contacts of whole sites, pages saved by hand, and what these write into documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.functions import edits, html, titles
from evidara.operators import manual_imports, near_misses, site_contacts
from evidara.plans.registry import Registry
from evidara.session import table
from evidara.sources import canonical

registry = Registry()
QUERIES, ORACLES = registry.queries, registry.oracles

_TEXTS = r"""b as (select *, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g') as t from pages),
    w as (select * exclude (t), trim(regexp_replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[\s\p{Z}]+', ' ', 'g')) as t from b),
    p as (select * exclude (t), replace(replace(t, '( ', '('), ' )', ')') as t, regexp_extract(html, '<h1>([^<]*)</h1>', 1) as h1 from w)"""


def _heading() -> Column:
    return F.regexp_extract("html", "<h1>([^<]*)</h1>", 1)


@registry.query(rf"""
    with {_TEXTS}, s as (select page_id, t, string_split(h1, ' ') as words from p),
    q as (select page_id, t, replace(replace(trim(regexp_replace(array_to_string(words[1:len(words) // 2], ' ') || ' zq9 ' || array_to_string(words[len(words) // 2 + 1:], ' '), '[\s\p{{Z}}]+', ' ', 'g')), '( ', '('), ' )', ')') as quote from s),
    r as (select page_id, t, quote, j, list_max(list_filter(range(1, length(quote) - j + 2), lambda n: contains(t, substr(quote, j, n)))) as size from q, unnest(range(1, length(quote) + 1)) as u(j)),
    f as (select page_id, t, quote, size, instr(t, substr(quote, j, size)) as pos, substr(quote, j, size) as shared, row_number() over (partition by page_id order by size desc, instr(t, substr(quote, j, size)), j) as n from r where size is not null)
    select page_id, shared, substr(t, greatest(pos - (length(quote) - size) // 2, 1), length(quote) + (length(quote) - size) // 2) as passage from f where n = 1""")
def near_miss_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's heading with a word put into its middle, and what in the page's text comes closest to it, however far."""
    pages, words = table(spark, sf_dir, "pages"), F.split(_heading(), " ")
    half = F.floor(F.size("words") / 2).cast("int")
    quote = F.concat(F.array_join(F.slice("words", F.lit(1), half), " "), F.lit(" zq9 "), F.array_join(F.slice("words", half + 1, F.size("words") - half), " "))
    texts = pages.select(F.col("page_id").alias("url"), html.html_to_text(F.col("html")).alias("text"))
    claims = pages.select("page_id", words.alias("words")).select(F.col("page_id").alias("url"), quote.alias("quote"))
    return near_misses.near_misses(claims, texts, 0.0).where("shared is not null").select(F.col("url").alias("page_id"), "shared", "passage")


_KINDS = ("telegram", "discord", "whatsapp", "signal", "instagram")
_ADDRESSES = ("https://t.me/c", "https://discord.gg/c", "https://wa.me/1", "https://signal.group/c", "https://www.instagram.com/c")
_FIRSTS = ", ".join(f"min(k) filter (k % 5 = {i})" for i in range(5))
_FOUND = ", ".join(f"'{url}' || min(k) filter (k % 5 = {i}) as {kind}" for i, (kind, url) in enumerate(zip(_KINDS, _ADDRESSES, strict=True)))


@registry.query(rf"""
    with a as (select page_id as k, 's' || left(md5(lower(regexp_extract(coalesce(url, ''), '^[^:]*://([^/?#]*)', 1))), 6) as site from pages),
    v as (select k, site, case when k % 2 = 0 then 0 when k % 4 = 1 then 1 else 2 end as tier, 'https://' || site || '.org/' || case when k % 2 = 0 then 'contact-' when k % 4 = 1 then 'about-' else 'news-' end || k as url from a),
    e as (select site, list_max([min(k) filter (tier = 0 and k % 3 < 2), min(k) filter (k % 7 = 0), min(k) filter (k % 5 = 0 and tier = 0), {_FIRSTS}]) as last,
        len(list_filter([min(k) filter (tier = 0 and k % 3 < 2), min(k) filter (k % 7 = 0), min(k) filter (k % 5 = 0 and tier = 0), {_FIRSTS}], lambda x: x is null)) as missing from v group by site),
    s as (select v.* from v join e using (site) where missing > 0 or k <= last),
    m as (select site, case k % 3 when 0 then 'info@' || site || '.org' else 'ann' || k || '@' || site || '.org' end as email, k, tier, url from s where k % 3 < 2),
    d as (select site, email, min(tier) as tier, min(k) as seen, arg_min(url, tier * 1000000000 + k) as url from m group by 1, 2),
    c as (select site, arg_min(email, (tier, not starts_with(email, 'info@'), seen)) as email, arg_min(url, (tier, not starts_with(email, 'info@'), seen)) as email_source from d group by 1)
    select s.site, any_value(email) as email, any_value(email_source) as email_source, '+49 ' || (10000000 + coalesce(max(k) filter (k % 7 = 0), min(k) filter (k % 7 = 1))) as phone,
        case when max(k) filter (k % 7 = 0) is not null then 'high' when min(k) filter (k % 7 = 1) is not null then 'low' end as phone_confidence, arg_min(url, k) filter (k % 5 = 0 and tier = 0) as form, {_FOUND}
    from s left join c using (site) group by s.site""")
def site_contact_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts of each host from all its pages in order; addresses, numbers, forms and links are put on them by their ids."""
    k = F.col("page_id")
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("s"), F.left(F.md5(F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), "^[^:]*://([^/?#]*)", 1))), F.lit(6))).alias("site"))
    number = F.concat(F.lit("+49 "), k + 10000000)
    where = F.when(k % 2 == 0, "contact-").when(k % 4 == 1, "about-").otherwise("news-")
    mail = F.when(k % 3 == 0, F.concat(F.lit('<a href="mailto:info@'), "site", F.lit('.org">'))).when(k % 3 == 1, F.concat(F.lit("<a href='mailto:ann"), k, F.lit("@"), "site", F.lit(".org?subject=x'>"))).otherwise("")
    call = F.when(k % 7 == 0, F.concat(F.lit('<a href="tel:'), number, F.lit('">'))).otherwise("")
    link = F.element_at(F.array(*map(F.lit, _ADDRESSES)), (k % 5 + 1).cast("int"))
    form = F.when(k % 5 == 0, "<form><textarea></textarea></form>").otherwise("<form><input type='search'></form>")
    made = pages.select(
        "page_id", "site", F.concat(F.lit("https://"), "site", F.lit(".org/"), where, k).alias("url"), F.concat(mail, call, F.lit("<a href='"), link, k, F.lit("'>"), form).alias("html"),
        F.when(k % 7 == 1, F.concat(F.lit("call "), number)).alias("seen"),
    )
    found = site_contacts.site_contacts(site_contacts.page_contacts(made, "site", "page_id", F.col("seen")))
    return found.select("site", "email", "email_source", "phone", "phone_confidence", "form", *(F.col("channels")[kind].alias(kind) for kind in _KINDS))


@registry.query("""
    with c as (select c_custkey as k, c_name, c_custkey % 3 = 0 as had, 'https://c' || c_custkey || '.org' as site from customer)
    select k as c_custkey, sha256('---' || chr(10) || 'title: ' || c_name || chr(10) || 'website: ' || site || chr(10) || 'contact:' || chr(10) || '  email: ' || case when had then 'old@c.org' else 'info@c' || k || '.org' end || chr(10)
        || '  phone: "+49 ' || k || '"' || chr(10) || case when k % 2 = 0 then '  form: ' || site || '/contact' || chr(10) else '' end || '  channels:' || chr(10)
        || case when had then '  - type: signal' || chr(10) || '    url: https://signal.group/old' || chr(10) || '    note: ask first' || chr(10) else '' end || '  - type: telegram' || chr(10) || '    url: https://t.me/c' || k || chr(10)
        || '  source: ' || site || chr(10) || '  checked: 2024-06-30' || chr(10) || 'status: active' || chr(10) || '---' || chr(10) || 'Body' || chr(10)) as sha256 from c""")
def contact_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's document with what was found on its site written into its contact block, what it had before left alone."""
    key = F.col("c_custkey")
    site, had, none = F.concat(F.lit("https://c"), key, F.lit(".org")), key % 3 == 0, F.lit(None).cast("string")
    signal = F.struct(F.lit("signal").alias("type"), F.lit("https://signal.group/old").alias("url"), none.alias("label"), F.lit("ask first").alias("note"))
    old = F.when(had, F.struct(F.lit("old@c.org").alias("email"), none.alias("phone"), none.alias("form"), F.array(signal).alias("channels"), F.lit("https://old").alias("source"), F.lit("2020-01-01").alias("checked"))).cast(site_contacts.BLOCK)
    found = F.struct(F.concat(F.lit("info@c"), key, F.lit(".org")).alias("email"), F.concat(F.lit("+49 "), key).alias("phone"), F.when(key % 2 == 0, F.concat(site, F.lit("/contact"))).alias("form"), F.create_map(F.lit("telegram"), F.concat(F.lit("https://t.me/c"), key)).alias("channels"))
    front = F.concat(F.lit("---\ntitle: "), "c_name", F.lit("\nwebsite: "), site, F.lit("\n"), F.coalesce(site_contacts.block_text(F.col("old")), F.lit("")), F.lit("status: active\n---\nBody\n"))
    rows = table(spark, sf_dir, "customer").select("*", old.alias("old")).select(key, front.alias("text"), site_contacts.merged_block(F.col("old"), found, site, F.lit("2024-06-30").cast("date")).alias("block"))
    return rows.select("c_custkey", F.sha2(edits.set_block(F.col("text"), "contact", site_contacts.block_text(F.col("block"))), 256).alias("sha256"))


@registry.query(rf"""
    with {_TEXTS}, u as (select page_id as k, url, t, trim(regexp_replace(h1, '[\s\p{{Z}}]+', ' ', 'g')) as h1 from p),
    e as (select url, h1 as quote from u where k % 7 <> 0 and h1 <> '' union select url, 'never said ' || k from u where k % 7 <> 0),
    s as (select k, t, case k % 4 when 0 then url when 1 then regexp_extract(url, '^\S+') when 2 then trim(url) || '/' end as url, case k % 4 when 0 then 'url-map' when 1 then 'stamp' when 2 then 'meta tag' end as source from u),
    c as (select distinct url from e), x as (select k, t, s.url, source, case when s.url in (select url from c) then s.url when s.url like '%/' and left(s.url, length(s.url) - 1) in (select url from c) then left(s.url, length(s.url) - 1) when s.url || '/' in (select url from c) then s.url || '/' end as target from s),
    g as (select k, count(*) filter (contains(t, quote)) as good, count(*) filter (not contains(t, quote)) as mismatch from x join e on e.url = target where t <> '' group by k)
    select 'page ' || x.k || '.html' as name, case when coalesce(t, '') = '' then 'EMPTY' when x.url is null then 'SKIPPED' when target is null then 'NO_MATCH' else 'IMPORTED' end as status,
        case when t <> '' then coalesce(target, x.url) else x.url end as url, case when t <> '' and target <> x.url then source || ', trailing slash normalised' else coalesce(source, 'unknown') end as source,
        case when t <> '' and target is not null then date '2024-06-30' end as checked, coalesce(good, 0) as good, coalesce(mismatch, 0) as mismatch
    from x left join g using (k)""")
def manual_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as one saved by hand, its URL told by a note, the browser's stamp or a link of its own, or not at all; its heading is looked for."""
    pages, k = table(spark, sf_dir, "pages"), F.col("page_id")
    name = F.concat(F.lit("page "), k, F.lit(".html"))
    told = F.when(k % 4 == 1, F.concat(F.lit("<!-- saved from url=(0042)"), "url", F.lit(" -->\n"))).when(k % 4 == 2, F.concat(F.lit("<meta content='https://other' property='og:url'><link href='"), "url", F.lit("/' rel=\"canonical\">"))).otherwise("")
    snapshots = pages.select(name.alias("name"), F.concat(F.coalesce(told, F.lit("")), "html").alias("html"), html.html_to_text(F.col("html")).alias("text"))
    lines = pages.select(k.alias("line"), F.when(k % 4 == 0, F.concat(name, F.lit(" \t"), "url", F.lit(" "))).otherwise(F.concat(F.lit("# "), name, F.lit(" "), "url")).alias("value"))
    cited = pages.where(k % 7 != 0)
    evidence = cited.select("url", _heading().alias("quote")).where("trim(quote) <> ''").union(cited.select("url", F.concat(F.lit("never said "), k)))
    imported = manual_imports.matched(manual_imports.recovered(snapshots, manual_imports.sidecar(lines)), evidence)
    return manual_imports.manifest(imported, manual_imports.import_verdicts(snapshots, imported, evidence), F.lit("2024-06-30").cast("date"))


@registry.query("""
    select doc_id, case doc_id % 4 when 0 then 'text' when 1 then 'event' when 2 then 'link' end as place, case when doc_id % 4 < 3 then sha256('---' || chr(10) || case doc_id % 4
        when 0 then 'events:' || chr(10) || '- date: ''2024-01-05''' || chr(10) || '  quote: zq — 9' || chr(10) || 'last_checked: ''2024-01-31'''
        when 1 then 'events:' || chr(10) || '- date: ''2024-01-05''' || chr(10) || '  quote: ''zq: 9''''s — x''' || chr(10) || 'last_checked: ''2024-01-31'''
        else 'shared_link:' || chr(10) || '  description: ''zq: 9''''s — x''' || chr(10) || '  url: https://e.example/' || chr(10) || 'title: Post' end
        || chr(10) || '---' || chr(10) || case when doc_id % 4 = 2 then chr(10) || 'Body ' || text || ' end' else 'Body ' || text || ' end' || chr(10) end) end as sha256
    from documents where text is not null""")
def quote_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes in front matter above whole texts mended: as they stand, as the value of an event or a shared link, or not where two events say the same."""
    kind, wrong = F.col("doc_id") % 4, F.when(F.col("doc_id") % 4 == 0, "zq—9").otherwise("zq: 9's—x")
    event = lambda quote: f"events:\n- date: '2024-01-05'\n  quote: {quote}\nlast_checked: '2024-01-31'"
    twice = "events:\n- quote: 'zq: 9''s—x'\n- quote: 'zq: 9''s—x'"
    front = F.when(kind == 0, event("zq—9")).when(kind == 1, event("'zq: 9''s—x'")).when(kind == 2, "title: Post\nshared_link:\n  url: https://e.example/\n  description: 'zq: 9''s—x'").otherwise(twice)
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.concat(F.lit("---\n"), front, F.lit("\n---\nBody "), "text", F.lit(" end\n")).alias("text"), wrong.alias("old"), F.replace(wrong, F.lit("—"), F.lit(" — ")).alias("new"))
    return canonical.mended_quotes(docs).select("doc_id", "place", F.sha2("mended", 256).alias("sha256"))


@registry.query("""
    select p_partkey, case p_partkey % 5 when 0 then 'Civic Tech Hackathon — ' || p_partkey || '月' when 1 then p_partkey || 'th 大' || ' Hackathon' when 2 then 'Civic Tech 春季 Activity' when 3 then p_brand || ' event' end as title_en from part""")
def translated_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recurring titles, another one in Han characters, and one that is not, with their English."""
    k = F.col("p_partkey")
    title = F.when(k % 5 == 0, F.concat(F.lit("公民科技跑咖松_"), k, F.lit("月"))).when(k % 5 == 1, F.concat(F.lit("第"), k, F.lit("次大松黑客松活動日時間"))).when(k % 5 == 2, "公民科技春季活動").when(k % 5 == 3, "公民大會").otherwise(F.concat("p_name", F.lit(" 大會")))
    return table(spark, sf_dir, "part").select("p_partkey", titles.english_title(title, F.col("p_brand")).alias("title_en"))
