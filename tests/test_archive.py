"""Kept pages, canonical documents, calendar files, language order and gathered evidence, by small cases."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from evidara.functions.text import locale_order
from evidara.operators import collection
from evidara.sinks import calendars
from evidara.sources import canonical, frontmatter, page_cache

day = datetime.date.fromisoformat


def keep(spark, folder, rows, when, order=None):
    fetched = spark.createDataFrame(rows, "url string, text string" + (", turn int" if order else ""))
    page_cache.store(folder, fetched, F.lit(when), order)


def kept(spark, folder):
    return {r["url"]: (r["text"], r["checked"], r["chars"]) for r in page_cache.read_cache(spark, folder).collect()}


def test_cache_keeps_the_last_text_of_each_page(spark, tmp_path):
    folder = str(tmp_path / "cache")
    assert kept(spark, folder) == {}
    keep(spark, folder, [("https://a", "old a"), ("https://b", "b"), ("https://c", ""), ("https://d", None), (None, "x")], "2024-01-01")
    keep(spark, folder, [("https://a", "z first", 1), ("https://a", "new ä", 2), ("https://b", "", 3)], "2024-02-01", "turn")
    assert kept(spark, folder) == {"https://a": ("new ä", day("2024-02-01"), 5), "https://b": ("b", day("2024-01-01"), 1)}
    keep(spark, folder, [("https://a", "")], "2024-03-01")
    assert kept(spark, folder)["https://a"][0] == "new ä"


def test_cache_rewrites_only_the_parts_it_must(spark, tmp_path):
    folder = str(tmp_path / "cache")
    keep(spark, folder, [(f"https://a/{i}", f"text {i}") for i in range(60)], "2024-01-01")
    before = {part: sorted(os.listdir(f"{folder}/{part}")) for part in os.listdir(folder) if part.startswith("part=")}
    keep(spark, folder, [("https://a/7", "again")], "2024-02-01")
    after = {part: sorted(os.listdir(f"{folder}/{part}")) for part in os.listdir(folder) if part.startswith("part=")}
    assert [part for part in before if before[part] != after[part]] == ["part=" + spark.sql("select left(sha2('https://a/7', 256), 2)").first()[0]]
    assert len(kept(spark, folder)) == 60


def test_cache_look_up(spark, tmp_path):
    folder = str(tmp_path / "cache")
    keep(spark, folder, [("https://News.org/a", "one"), ("https://news.org/b", "two")], "2024-01-01")
    keep(spark, folder, [("https://news.org/b", "three")], "2024-02-01")
    cache = page_cache.read_cache(spark, folder)
    claims = spark.createDataFrame([(1, "https://news.org/b"), (2, "https://other"), (3, None), (4, "https://news.org/b")], "id int, url string")
    found = {r["id"]: (r["page_text"], r["page_status"]) for r in page_cache.look_up(claims, cache).collect()}
    assert found == {1: ("three", "CACHED"), 2: (None, "NOT_CACHED"), 3: (None, "NOT_CACHED"), 4: ("three", "CACHED")}
    assert [r["url"] for r in page_cache.matching(cache, "NEWS").collect()] == ["https://news.org/b", "https://News.org/a"]
    assert page_cache.matching(cache, "nowhere").collect() == []
    assert "text" not in page_cache.catalogue(cache).columns


@pytest.mark.parametrize(
    "text, wanted",
    [
        ("---\nzeta: 1\nstatus: active\ntitle: Ö\n---\nbody\n---\nmore", "---\ntitle: Ö\nstatus: active\nzeta: 1\n---\nbody\n---\nmore"),
        ("---\nevents:\n- note: n\n  mine: 1\n  date: 2024-01-05\n- plain\nactivity:\n  scrape: {}\n  own: 2\n  manual:\n    date: x\n---\n", "---\nevents:\n- date: 2024-01-05\n  note: n\n  mine: 1\n- plain\nactivity:\n  manual:\n    date: x\n  scrape: {}\n  own: 2\n---\n"),
        ("---\ntitle: a\n1: b\n---\n", "---\ntitle: a\n1: b\n---\n"),
        ("---\n- a\n- b\n---\nx", None),
        ("---\ntitle: [\n---\nx", None),
        ("no front matter", None),
        ("---\ntitle: a\n", None),
        ("", None),
    ],
)
def test_canonical_order(spark, text, wanted):
    row = canonical.canonical_documents(spark.createDataFrame([("s", text)], "slug string, text string")).first()
    assert row["canonical"] == (text if wanted is None else wanted)
    assert row["out_of_order"] == (wanted is not None and wanted != text)


def test_canonical_form_is_stable_and_bodies_stay(spark):
    text = "---\nsummary: |\n  two\n  lines\ntitle: 'yes'\nevents: none\nactivity: []\n---\n" + "long body äö\r\n" * 300_000
    docs = spark.createDataFrame([("a", text), ("b", None)], "slug string, text string")
    once = canonical.canonical_documents(docs).select("slug", F.col("canonical").alias("text"))
    rows = {r["slug"]: r for r in canonical.canonical_documents(once).collect()}
    assert not rows["a"]["out_of_order"] and rows["a"]["canonical"].endswith("long body äö\r\n" * 300_000) and rows["a"]["canonical"].startswith("---\ntitle: 'yes'\nsummary: ")
    assert rows["b"]["canonical"] is None and not rows["b"]["out_of_order"]
    assert [r["slug"] for r in canonical.out_of_order(docs).collect()] == ["a"]


EVENT = "country string, date date, end_date date, time string, end_time string, org string, title string, url string"


def test_calendar_files(spark, tmp_path):
    rows = [
        ("DE", day("2024-03-02"), None, None, None, "Org, e.V.", "Späte; " + "ü" * 60, "https://a.org/x"),
        ("DE", day("2024-03-01"), day("2024-03-03"), "9:05", "17:30", "Org", "Early", ""),
        ("DE", day("2024-03-01"), day("2024-03-03"), "noon", None, "Org", "Days", None),
        ("FR", day("2024-03-01"), day("2024-03-02"), "23:00", "late", "Org", "Night", None),
        (None, day("2024-03-01"), None, None, None, "Org", "Nowhere", None),
        ("FR", None, None, None, None, "Org", "Never", None),
    ]
    folder = str(tmp_path / "calendars")
    calendars.write_calendars(spark.createDataFrame(rows, EVENT), folder, "country", F.concat(F.lit("Events in "), "country"), "e.example", "20240101T000000Z")
    files = {}
    for part in sorted(p for p in os.listdir(folder) if p.startswith("country=")):
        names = [n for n in os.listdir(f"{folder}/{part}") if n.endswith(".txt")]
        assert len(names) == 1
        with open(f"{folder}/{part}/{names[0]}", "rb") as held:
            files[part.partition("=")[2]] = held.read().decode()
    assert sorted(files) == ["DE", "FR"]
    for text in files.values():
        lines = text.split("\r\n")
        assert lines[0] == "BEGIN:VCALENDAR" and lines[-2:] == ["END:VCALENDAR", ""] and "\n" not in text.replace("\r\n", "")
        assert all(len(line.encode()) <= 75 for line in lines)
    german = files["DE"].replace("\r\n ", "").split("\r\n")
    assert [line for line in german if line.startswith(("DTSTART", "DTEND"))].count("DTSTART;VALUE=DATE:20240302") == 1
    assert german.index("DTSTART:20240301T090500") < german.index("DTSTART;VALUE=DATE:20240302")
    assert "DTEND:20240301T173000" in german and "DTEND;VALUE=DATE:20240304" in german and german.count("BEGIN:VEVENT") == 3
    assert r"SUMMARY:Org\, e.V.: Späte\; " + "ü" * 60 in german and r"CATEGORIES:Org\, e.V." in german and "X-WR-CALNAME:Events in DE" in german
    assert sum(line.startswith("URL:") for line in german) == 1
    french = files["FR"].split("\r\n")
    assert "DTSTART:20240301T230000" in french and "DTEND;VALUE=DATE:20240303" in french and french.count("END:VEVENT") == 1


def test_no_events_no_files(spark, tmp_path):
    folder = str(tmp_path / "calendars")
    calendars.write_calendars(spark.createDataFrame([], EVENT), folder, "country", F.col("country"), "e.example", "20240101T000000Z")
    assert not [p for p in os.listdir(folder) if p.startswith("country=")]


def test_language_order(spark):
    names = spark.createDataFrame([(n,) for n in ("zeta", "Éclair", "echo", "Zebra", "eclair", "Ärger", "apfel", None)], "n string")
    assert [r["n"] for r in names.orderBy(locale_order(F.col("n"))).collect()] == [None, "apfel", "Ärger", "echo", "eclair", "Éclair", "Zebra", "zeta"]
    assert [r["n"] for r in names.orderBy(locale_order(F.col("n"), descending=True)).collect()][:2] == ["zeta", "Zebra"]


def test_evidence_of_three_kinds(spark):
    front = """events:
- {date: 2024-01-05, title: %s, url: 'https://a', quote: said}
- {title: none, url: 'https://a'}
- {title: none, quote: said}
- {url: 'https://b', quote: bad, proof_warning: odd}
- {url: 'https://b', quote: good}
""" % ("T" * 60)
    documents = spark.createDataFrame([("o/x.md", "x", front, ""), ("o/y.md", "y", "events: 3", ""), ("o/index.md", "index", front, ""), ("o/z.md", "z", None, "")], "path string, slug string, yaml string, body string")
    records = frontmatter.parse_records(documents)
    docs = spark.createDataFrame([("d.md", 'x\r\n[^1]: [A](https://a) "said"\r\n[^2]: [A](https://a) no'), ("e.md", None)], "path string, text string")
    posts = spark.createDataFrame([("p.md", ("https://c", "C", "about")), ("q.md", ("", "C", "about")), ("r.md", ("https://c", None, None)), ("s.md", None)], "path string, shared_link struct<url:string,title:string,description:string>")
    found = collection.collect_evidence(records, docs, posts)
    assert sorted(map(tuple, found.collect())) == [
        ("https://a", "said", "d.md:2 [^1]", "footnote", "d.md"),
        ("https://a", "said", "x [2024-01-05] " + "T" * 50, "event", "o/x.md"),
        ("https://b", "good", "x [?] ", "event", "o/x.md"),
        ("https://c", "about", "p.md shared_link (C)", "shared_link", "p.md"),
    ]
    assert collection.collect_evidence(records, docs, posts, ["y"], events_only=True).count() == 0
    known = spark.createDataFrame([("https://a", "said"), ("https://a", "said"), ("https://b", "said")], "url string, quote string")
    assert sorted(r["url"] for r in collection.unchecked(found, known).collect()) == ["https://b", "https://c"]
    assert {r["url"]: (r["quotes"], r["items"]) for r in collection.by_url(found).collect()}["https://a"] == (["said"], 2)
    blocked = spark.createDataFrame([("https://c", "HTTP 403", day("2024-01-01")), ("https://a", None, None)], "url string, blocked string, blocked_since date")
    assert [(r["url"], r["blocked"]) for r in collection.worklist(found, blocked).collect()] == [("https://c", "HTTP 403")]
