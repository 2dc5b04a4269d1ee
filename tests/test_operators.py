"""Operators on small hand-made tables."""

from datetime import date

from pyspark.sql import functions as F

from evidara.functions import text, urls
from evidara.operators import activity, evidence, facets, graph, integrity, state


def test_normalize_ws_handles_unicode_space_and_parentheses(spark):
    row = spark.createDataFrame([("a\u00a0 b ( c ) (d)",)], "x string").select(text.normalize_ws(F.col("x")).alias("y")).first()
    assert row["y"] == "a b (c) (d)"


def test_quote_pages_matches_brute_force(spark):
    pages = [(1, "one two three four five six seven"), (2, "xone two  three four five sixy seven"), (3, None), (4, ""), (5, "tiny tiny")]
    claims = [(1, "one two three four five six"), (2, "tiny"), (3, ""), (4, None), (5, "not there at all, never")]
    found = evidence.quote_pages(spark.createDataFrame(claims, "id int, quote string"), spark.createDataFrame(pages, "page int, text string"), "id", "page")
    assert sorted(map(tuple, found.collect())) == [(1, 1, 1), (1, 2, 1), (2, 5, 2)]
    verdicts = evidence.verdicts(spark.createDataFrame(claims, "id int, quote string"), found, "id").select("id", "status")
    assert dict(map(tuple, verdicts.collect())) == {1: "AMBIGUOUS", 2: "AMBIGUOUS", 3: "MISMATCH", 4: "MISMATCH", 5: "MISMATCH"}


def test_activity_rules_differ_as_meant(spark):
    day = lambda n: date.fromordinal(date(2026, 1, 1).toordinal() - n)
    rows = [("a", "manual", day(700)), ("a", "rss", day(10)), ("b", "sitemap", day(5)), ("b", "rss", day(400)), ("c", "rss", day(400)), ("d", "sitemap", day(999)), ("e", "odd", day(1)), ("e", "rss", None)]
    signals = spark.createDataFrame(rows, "entity string, source string, date date")
    as_of = F.lit("2026-01-01").cast("date")
    chosen = {r["entity"]: (r["source"], r["step"]) for r in activity.select_activity(signals, as_of).collect()}
    assert chosen == {"a": ("rss", 1), "b": ("sitemap", 2), "c": ("rss", 3), "d": ("sitemap", 4)}
    first = {r["entity"]: r["source"] for r in activity.first_fresh(signals, as_of).collect()}
    assert first == {"a": "manual", "b": "sitemap", "c": "rss", "d": "sitemap"}


def test_drill_sideways_leaves_own_facet_aside(spark):
    rows = [(1, "x", ["p", "q"]), (2, "y", ["p"]), (3, "y", None), (4, None, ["q"])]
    df = spark.createDataFrame(rows, "id int, kind string, tags array<string>")
    counts = {(r["facet"], r["value"]): r["n"] for r in facets.drill_sideways(df, {"kind": ["x"], "tags": ["p"]}).collect()}
    assert counts == {("kind", "x"): 1, ("kind", "y"): 1, ("tags", "p"): 1, ("tags", "q"): 1}
    assert [r["id"] for r in facets.facet_filter(df, {"kind": ["x"], "tags": []}).collect()] == [1]


def test_integrity(spark):
    parent = spark.createDataFrame([(1,), (2,)], "id int")
    child = spark.createDataFrame([(1, 1), (2, 9), (3, None)], "c int, ref int")
    assert [r["c"] for r in integrity.broken_references(child, parent, "ref", "id").collect()] == [2]
    assert [r["id"] for r in integrity.orphans(parent, child, "id", "ref").collect()] == [2]


def test_upsert_keeps_later_dates_and_untouched_keys(spark):
    schema = "k int, at date, v string"
    old = spark.createDataFrame([(1, date(2026, 1, 2), "old"), (2, date(2026, 1, 2), "old"), (3, None, "none")], schema)
    new = spark.createDataFrame([(1, date(2026, 1, 2), "new"), (2, date(2026, 1, 3), "new"), (3, date(2026, 1, 1), "new"), (4, None, "new")], schema)
    merged = {r["k"]: r["v"] for r in state.upsert_newer(old, new, ["k"], "at").collect()}
    assert merged == {1: "old", 2: "new", 3: "new", 4: "new"}


def test_graph_and_urls(spark):
    edges = graph.canonical_edges(spark.createDataFrame([("b", "a"), ("a", "b"), ("a", "a"), ("a", None)], "x string, y string"), F.col("x"), F.col("y"))
    assert list(map(tuple, edges.collect())) == [("a", "b")]
    rows = [("https://a.org",), ("https://a.org/news/",), ("https://a.org/news#x",), ("https://a.org/news/item",)]
    weak = spark.createDataFrame(rows, "u string").select(urls.is_weak(F.col("u")).alias("w")).collect()
    assert [r["w"] for r in weak] == [True, True, False, False]
