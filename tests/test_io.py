"""Sources, sinks and streams."""

import hashlib
import io
import json
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from evidara.operators import citations, tagging
from evidara.sinks import exports
from evidara.sources import feeds, frontmatter, office, robots
from evidara.streaming import evidence_stream

PAGE = """---
title: First
status: active
concepts: [alpha, beta]
location: {latitude: 1.5, longitude: 2.5}
activity:
  rss: {date: 2026-01-05, note: post -- with dashes}
  manual: {date: '2025-01-01'}
  url: stray string
events:
  - {date: 2026-02-01, title: Meeting, url: 'https://a.org/x', proof_warning: }
---
Body text
---
not a block
"""


def test_frontmatter(spark, tmp_path):
    (tmp_path / "first.md").write_text(PAGE)
    (tmp_path / "windows.md").write_text(PAGE.replace("\n", "\r\n"))
    (tmp_path / "plain.md").write_text("no block")
    (tmp_path / "bad.md").write_text("---\na: [1\n---\nx")
    (tmp_path / "index.md").write_text(PAGE)
    records = frontmatter.parse_records(frontmatter.read_documents(spark, str(tmp_path)))
    rows = {r["slug"]: r for r in records.collect()}
    assert set(rows) == {"first", "windows", "plain", "bad"}
    record = rows["first"]["record"]
    assert (record["title"], record["concepts"], record["latitude"]) == ("First", ["alpha", "beta"], 1.5)
    assert set(record["activity"]) == {"rss", "manual"} and record["events"][0]["proof_warning"]
    assert rows["first"]["body"].startswith("Body text") and rows["windows"]["record"]["title"] == "First"
    assert rows["plain"]["record"]["error"] and rows["bad"]["record"]["error"]
    assert sorted((r["entity"], r["source"]) for r in frontmatter.signals(records).where("entity = 'first'").collect()) == [("first", "manual"), ("first", "rss")]


def test_calendar_feed_and_sitemap(spark):
    ics = "BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nUID:1\r\nDTSTART;VALUE=DATE:20260301\r\nDTEND;VALUE=DATE:20260303\r\nSUMMARY:A long\r\n  title\\, yes\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nSUMMARY:no date\r\nEND:VEVENT\r\nEND:VCALENDAR"
    rows = feeds.calendar_events(spark.createDataFrame([("a", ics)], "slug string, text string")).collect()
    assert [(str(r["date"]), str(r["end_date"]), r["title"]) for r in rows] == [("2026-03-01", "2026-03-02", "A long title, yes")]
    rss = "<rss><channel><item><title><![CDATA[One & two]]></title><link>https://a.org/1</link><pubDate>Tue, 06 Jan 2026 10:00:00 GMT</pubDate></item></channel></rss>"
    item = feeds.feed_items(spark.createDataFrame([("a", rss)], "slug string, text string")).first()
    assert (str(item["date"]), item["title"], item["link"]) == ("2026-01-06", "One & two", "https://a.org/1")
    xml = "<urlset><url><loc> https://a.org/ </loc><lastmod>2026-01-02T00:00:00Z</lastmod></url><url><loc>https://a.org/b</loc></url></urlset>"
    found = feeds.sitemap_urls(spark.createDataFrame([("a", xml)], "slug string, text string")).collect()
    assert [(r["loc"], str(r["lastmod"])) for r in found] == [("https://a.org/", "2026-01-02"), ("https://a.org/b", "None")]


def test_exports(spark):
    df = spark.sql("select 1 as id, 'A & <B>' as name, 'odd' as status, 10.5D as lon, 50.25D as lat, date'2026-03-01' as day union all select 2, 'B', 'active', null, 1.0D, date'2026-03-02'")
    feature = json.loads(exports.geojson_features(df, "id", "lon", "lat").first()["feature"])
    assert feature["geometry"]["coordinates"] == [10.5, 50.25]
    mark = exports.kml_placemarks(df, "id", "name", "status", "lon", "lat").collect()
    assert len(mark) == 1 and "A &amp; &lt;B&gt;" in mark[0]["placemark"] and "#inactive" in mark[0]["placemark"]
    event = exports.ics_events(df.withColumn("name", F.repeat(F.lit("é,"), 60)), "id", "day", "name").first()["vevent"]
    lines = event.split("\r\n")
    assert all(len(x.encode()) <= 75 for x in lines) and "DTEND;VALUE=DATE:20260302" in lines
    folded = "".join(x[1:] if x.startswith(" ") else "\n" + x for x in lines)
    assert "SUMMARY:" + "é\\," * 60 in folded


def test_feeds_of_all_kinds(spark):
    texts = [
        ("rss", '<?xml version="1.0"?><rss xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>x</title><item><title><![CDATA[One & two]]></title><link>https://a.org/1</link><dc:date>2026-01-06</dc:date></item><item><title>b &amp; c</title><pubDate>Wed, 07 Jan 2026 10:00:00 GMT</pubDate></item></channel></rss>'),
        ("atom", '<a:feed xmlns:a="http://www.w3.org/2005/Atom"><a:entry><a:title>t</a:title><a:link href="https://a.org/2"/><a:id>i</a:id><a:updated>2026-01-02T00:00:00.123Z</a:updated></a:entry><a:entry><a:title/><a:id>urn:3</a:id><a:published>2026-01-01T00:00:00Z</a:published></a:entry></a:feed>'),
        ("rdf", '<rdf:RDF xmlns:rdf="r" xmlns="http://purl.org/rss/1.0/"><channel/><item><title>q</title><link>l</link></item></rdf:RDF>'),
        ("broken", "<rss><channel><item><title>a</title>"), ("none", None), ("words", "no markup"),
    ]
    frame = spark.createDataFrame(texts, "slug string, text string")
    got = sorted((r["slug"], str(r["date"]), r["title"], r["link"]) for r in feeds.feed_items(frame).collect())
    assert got == sorted([("rss", "2026-01-06", "One & two", "https://a.org/1"), ("rss", "2026-01-07", "b & c", None), ("atom", "2026-01-02", "t", "https://a.org/2"), ("atom", "2026-01-01", None, "urn:3"), ("rdf", "None", "q", "l")])


def test_sitemap_index_takes_five_children(spark):
    child = lambda day: f"<sitemap><loc>u</loc><lastmod>2026-01-{day:02}</lastmod></sitemap>"
    index = '<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">' + child(3) + "<sitemap><loc>u</loc></sitemap>" + child(5) + child(1) + child(2) + child(20) + "</sitemapindex>"
    addresses = "<urlset>" + "".join(f"<url><loc>u</loc><lastmod>2026-01-{d:02}T10:00:00+01:00</lastmod></url>" for d in range(1, 12)) + "<url><lastmod>soon</lastmod></url></urlset>"
    frame = spark.createDataFrame([(1, index), (2, addresses), (3, "<urlset/>"), (4, "<html>"), (5, None)], "k int, text string")
    assert {r["k"]: str(r["d"]) for r in frame.select("k", feeds.sitemap_lastmod(F.col("text")).alias("d")).collect()} == {1: "2026-01-05", 2: "2026-01-11", 3: "None", 4: "None", 5: "None"}


def zipped(**members):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as out:
        for name, text in members.items():
            out.writestr(name.replace("__", "/").replace("_xml", ".xml"), text)
    return held.getvalue()


def test_office_files(spark, tmp_path):
    word = '<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>A</w:t><w:tab/><w:t>b &amp; c</w:t></w:r></w:p><w:p><w:r><w:t>second</w:t><w:br/></w:r></w:p></w:body></w:document>'
    open_text = '<o:c xmlns:o="o" xmlns:t="t"><t:h>Title</t:h><t:p>one<t:span>two<t:span>three</t:span></t:span></t:p></o:c>'
    files = {"a.docx": zipped(word__document_xml=word, content_xml=open_text), "b.odt": zipped(content_xml=open_text), "c.bin": zipped(other_xml="<x/>"), "d.docx": zipped(content_xml="<broken"), "e.txt": b"plain", "f.docx": zipped(content_xml=open_text)[:60]}
    (tmp_path / "deep").mkdir()
    for name, content in files.items():
        (tmp_path / "deep" / name).write_bytes(content)
    got = {r["path"].rsplit("/", 1)[1]: r["text"] for r in office.office_texts(office.read_files(spark, str(tmp_path))).collect()}
    assert got == {"a.docx": "A b & c\nsecond \n", "b.odt": "Title\nonetwothree\n", "c.bin": None, "d.docx": None, "f.docx": None}
    assert office.document_text(None) is None


def test_robots_rules(spark):
    text = "# greeting\nUser-agent: *\nDisallow: /private/ # no\nAllow: /private/open\nDisallow: /*.pdf$\nDisallow: /a/*/c\nDisallow: /same\nAllow: /same\n\nUser-Agent: EviBot\nuser-agent: other\nDisallow:\n\nuser-agent: evibot-news\ndisallow: /\nAllow: /x(1)\\E*\n"
    urls = [
        ("https://H.org/private/x", True), ("https://h.org", True), ("mailto:me", False), (None, False), ("https://none.org/private/", True), ("https://silent.org/x", True), ("https://h.org/robots.txt", True),
    ]
    files = spark.createDataFrame([("h.org", text), ("silent.org", None), ("plain.org", "User-agent: *\n" + text.split("User-Agent")[0])], "host string, text string")
    ask = lambda urls, agent: [r["allowed"] for r in robots.gate_urls(spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, url string"), files, agent).orderBy("i").collect()]
    assert ask([u for u, _ in urls], "EviBot/2.0") == [a for _, a in urls]
    plain = ["/private/x", "/private/open/1", "/p.pdf", "/p.pdf?x", "/a/b/c", "/a/c", "/same", "", "?q=/private/", "/private", "/private/#x"]
    want = [False, True, False, True, False, True, True, True, True, True, False]
    assert ask(["http://h.org" + p for p in plain], "Nobody") == want == ask(["http://plain.org" + p for p in plain], "evibot-news")
    assert ask(["http://h.org/a", "http://h.org/x(1)\\Eb", "http://h.org/x1"], "EviBot-News/1") == [False, True, False]


def test_citations_carry_forward(spark):
    items = spark.createDataFrame([("https://a.org/", "", "q2", 1), ("https://a.org/", "Later", "q1", 3), ("https://a.org/", "First", "q1", 2), ("https://b.org/", "", "q3", 4), ("ftp://c.org/", "x", "q", 5), ("https://d.org/", "x", "", 6)], "url string, title string, quote string, place int")
    known = "array<struct<quote string, status string, last_verified string, verified_by string, context string>>"
    existing = spark.createDataFrame(
        [("https://a.org/", "Old", "2026-01-01", [("q1", "MATCH", "2026-01-02", "", None), ("gone", "MATCH", None, None, None), ("q1", "MISMATCH", None, None, "near")]), ("https://b.org/", "Old b", "", None), ("https://gone.org/", "Gone", "2025-01-01", [])],
        f"url string, title string, accessed string, evidence {known}",
    )
    archive = spark.createDataFrame([("https://a.org/", "https://archive.example/1", ""), ("https://b.org/", None, "dead")], "url string, archive_url string, url_status string")
    merged = citations.merge_citations(items, existing, archive)
    got = {r["url"]: json.loads(r["citation"]) for r in exports.citation_json(merged).collect()}
    assert got == {
        "https://a.org/": {"id": hashlib.md5(b"https://a.org/").hexdigest()[:8], "type": "webpage", "URL": "https://a.org/", "title": "First", "accessed": "2026-01-01", "archive": "Internet Archive Wayback Machine", "archive_location": "https://archive.example/1",
            "evidence": [{"type": "quote-match", "quote": "q1", "status": "MISMATCH", "context": "near"}, {"type": "quote-match", "quote": "q2"}]},
        "https://b.org/": {"id": hashlib.md5(b"https://b.org/").hexdigest()[:8], "type": "webpage", "URL": "https://b.org/", "title": "Old b", "url-status": "dead", "evidence": [{"type": "quote-match", "quote": "q3"}]},
    }
    again = citations.merge_citations(items, merged.select("url", "title", "accessed", "evidence"), archive)  # its own result is an earlier list
    assert sorted(map(str, again.collect())) == sorted(map(str, merged.collect()))
    assert citations.merge_citations(items.limit(0), existing, archive).count() == 0


def test_tags_equal_brute_force(spark):
    rng = random.Random(21)
    pieces = ["open data", "Open-data", "opendata", "data", "data_set", "co-op", "co-operate", "C++", "c++x", "été", "ÉTÉ!", "l'été", "(civic) tech", "civic", "public goods", "publicgoods", "  ", "x"]
    docs = [(i, "\n".join(" ".join(rng.choices(pieces, k=rng.randint(1, 4))) for _ in range(rng.randint(0, 6)))) for i in range(80)] + [(90, None), (91, ""), (92, "public goods\r\n" * 5)]
    tags = [("data", "open data"), ("data", "data"), ("coop", "co-op"), ("coop", "Public Goods"), ("summer", "été"), ("tech", "(civic) tech"), ("tech", "c++"), ("odd", "++"), ("odd", "")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    tagged = spark.createDataFrame([("coop", 92), ("data", 3)], "tag string, doc long")

    def holds(line, keyword):
        return bool(keyword and re.search(r"\w", keyword) and re.search(r"\b" + re.escape(keyword.lower()) + r"\b", line.lower()))

    share = {k: sum(any(holds(x, k) for x in (t or "").splitlines()) for _, t in docs) / len(docs) for _, k in tags}
    want = {}
    for tag in {t for t, _ in tags}:
        kept = [k for t, k in tags if t == tag and share[k] <= 0.4]
        for doc, text in docs:
            hits = [x.strip() for x in (text or "").splitlines() if any(holds(x, k) for k in kept)]
            if len(hits) >= 1 and (tag, doc) not in {("coop", 92), ("data", 3)}:
                want[tag, doc] = (len(hits), hits[:3], max(len(hits) - 3, 0))
    keywords = spark.createDataFrame(tags, "tag string, keyword string")
    got = {(r["tag"], r["doc"]): (r["hits"], r["shown"], r["more"]) for r in tagging.suggest_tags(frame, keywords, tagged).collect()}
    assert got == want and max(share.values()) > 0.4
    parts = tagging.suggest_tags(frame, keywords, tagged, keyword_chars=8)
    assert {(r["tag"], r["doc"]): (r["hits"], r["shown"], r["more"]) for r in parts.collect()} == want
    shares = {r["keyword"]: r["share"] for r in tagging.keyword_shares(frame, keywords).collect()}
    assert shares == pytest.approx({k.lower(): v for k, v in share.items() if v})
    assert spark.sql("select 'deliberative-democracy-of' as s, 'On **Mini publics** and **the of**' as b").select(tagging.topic_keywords(F.col("s"), F.col("b")).alias("k")).first()["k"] == ["deliberative", "democracy", "mini", "publics"]


def test_state_stream_counts_each_batch_once(spark, tmp_path):
    source, folder, marks = str(tmp_path / "in"), str(tmp_path / "state"), str(tmp_path / "marks")
    spark.sql("select 1 as k, date'2026-01-01' as at, 'a' as v union all select 2, date'2026-01-01', 'a'").write.parquet(source)
    schema = spark.read.parquet(source).schema
    table = evidence_stream.StateTable(spark, folder, ["k"], "at")
    run = lambda: evidence_stream.keep_state(spark.readStream.schema(schema).parquet(source), table, marks).awaitTermination()
    run()
    spark.sql("select 1 as k, date'2026-01-02' as at, 'b' as v union all select 2, date'2025-01-01', 'b'").write.mode("append").parquet(source)
    run()
    assert {r["k"]: r["v"] for r in table.read().collect()} == {1: "b", 2: "a"}
    table.merge(spark.read.parquet(source), table.versions()[-1])
    assert {r["k"]: r["v"] for r in table.read().collect()} == {1: "b", 2: "a"}
