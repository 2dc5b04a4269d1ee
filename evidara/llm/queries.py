"""The registered queries of the pipeline operators and their SQL twins, where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.llm import bitsliced, exact_dedup, filter_audit, fingerprint, html_extract, katz, langid, mixing, packing, sharding, simhash, toxicity, url_filter
from evidara.session import table

QUERIES: dict = {}
ORACLES: dict = {}


def _register(run):
    QUERIES[run.__name__] = run
    return run


@_register
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.assign_shards(table(spark, sf_dir, "documents"), n_shards=40)
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@_register
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


ORACLES["op3_exact_dedup"] = """
    with texts as (select doc_id, coalesce(text, '') as text from documents),
    grouped as (select text, max(doc_id) as keep_id, count(*) as group_size from texts group by text)
    select t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id as kept, sha256(t.text) as text_sha256
    from texts t join grouped g on t.text = g.text
"""


@_register
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@_register
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


@_register
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=3, budget=2)


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where the public vocabulary files lie; another folder can be given to the operator itself."""
    import public_tokenizers

    return public_tokenizers.path(name)


@_register
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary_path(), added=packing.added_tokens(vocabulary_path("byte_bpe_50k.json")))


@_register
def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_documents(table(spark, sf_dir, "documents"))


@_register
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", F.coalesce(~toxicity.learning_row(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")


@_register
def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


@_register
def op6_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score_documents(table(spark, sf_dir, "documents"))


@_register
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLES["op13_filter_audit"] = r"""
    with texts as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text from documents),
    worded as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words, min(doc_id) over (partition by text) as first_id from texts),
    known as (select doc_id, max(quality) as quality, max(toxic) as toxic from labels group by doc_id),
    failed as (
        select part, quality, toxic, [
            len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words),
            100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text),
            regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > first_id, false)] as fails
        from worded left join known using (doc_id)),
    letters as (select * from (values ('A', 1), ('B', 2), ('C', 3), ('D', 4), ('E', 5)) v(f, i)),
    orders as (
        select [a.i, b.i, c.i, d.i, e.i] as places, a.f || b.f || c.f || d.f || e.f as filter_order
        from letters a, letters b, letters c, letters d, letters e
        where len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
    sets as (
        select part, fails, count(*) as n, count(*) filter (where quality = 1) as good, count(*) filter (where toxic = 1) as toxic
        from failed group by part, fails),
    steps as (
        select s.*, filter_order, step::int as step, places[step] as own, fails[places[step]] as fail,
            len(list_filter(places[1:step - 1], lambda p: fails[p])) > 0 as early
        from sets s, orders o, range(1, 6) r(step)),
    report as (
        select part, filter_order, step, own,
            coalesce(sum(n) filter (where not fail and not early), 0)::bigint as kept,
            coalesce(sum(n) filter (where fail and not early), 0)::bigint as removed,
            coalesce(sum(n) filter (where fail and early), 0)::bigint as redundant,
            coalesce(sum(n) filter (where fail and len(list_filter(fails, lambda x: x)) = 1), 0)::bigint as unique_fails,
            coalesce(sum(good) filter (where fail and not early), 0)::bigint as good_lost,
            coalesce(sum(toxic) filter (where fail and not early), 0)::bigint as toxic_lost
        from steps group by part, filter_order, step, own)
    select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
        (sum(removed) over (partition by part, own))::bigint as shapley
    from report
"""


@_register
def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learnt = langid.fit(docs.where(langid.learning_row(F.col("doc_id"))))
    told = langid.identify_documents(docs, learnt)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return told.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


@_register
def op12_bitsliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitsliced.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


ORACLES["op12_bitsliced"] = r"""
    with words as (
        select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
        from documents),
    asked as (
        select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
        from benchmark),
    lengths as (select doc_id, count(*) as n from words group by doc_id),
    totals as (select count(*) as n_docs, sum(n)::bigint as n_terms from lengths),
    held as (select doc_id, term, count(*) as tf from words where term in (select term from asked) group by doc_id, term),
    weights as (
        select term, floor(1000 * ln((2 * any_value(n_docs) + 2)::double / (2 * count(*) + 1)::double))::bigint as w
        from held, totals group by term),
    impacts as (
        select h.doc_id, h.term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))) as impact
        from held h join weights using (term) join lengths using (doc_id), totals),
    scored as (select item_id, doc_id, sum(impact)::bigint as score from asked join impacts using (term) group by item_id, doc_id),
    ranked as (select *, (row_number() over (partition by item_id order by score desc, doc_id))::int as rank from scored where score > 0)
    select item_id, rank, doc_id, score from ranked where rank <= 10
"""
