"""Rules on pages and documents, by cases that the tables don't hold."""

import datetime

import pytest
from pyspark.sql import functions as F

from evidara.functions import contacts, dates, edits, html, markup, passages, places, urls
from evidara.operators import footnotes, graph, links

day = datetime.date.fromisoformat


def as_of():
    return F.lit("2024-01-31").cast("date")


@pytest.fixture
def value(spark):
    def compute(column, **fields):
        return spark.createDataFrame([fields or {"x": 1}], schema=", ".join(f"{k} string" for k in fields) or "x int").select(column.alias("v")).first()["v"]

    return compute


def test_emails(value):
    page = "<a href='mailto:Ann%40Org.net?subject=1'> <span data-cfemail=\"422b2c242d02236c2d3025\"> <a href=\"mailto:x@y.org\\\">"
    text = "or ann@org.net, me@pic.png, @me@social.org; bob@a-b.co.uk."
    assert value(contacts.emails(F.col("h"), F.col("t")), h=page, t=text) == ["ann@org.net", "info@a.org", "bob@a-b.co.uk"]
    assert value(contacts.emails(F.col("h"), F.col("t")), h="", t="") == []
    assert value(contacts.hidden_address(F.lit("zz"))) is None
    assert value(contacts.best_email(F.array(F.lit("ann@a.org"), F.lit("Info@a.org")))) == "Info@a.org"
    assert value(contacts.best_email(F.array(F.lit("ann@a.org"), F.lit("bob@a.org")))) == "ann@a.org"


def test_phones(value):
    found = value(contacts.phones(F.col("h"), F.col("t")), h='<a href="tel:+61%202%209999%200000">', t="call (02) 9999 0001 or 61 2 9999 0000, not 2024 or 12345678901234567890")
    assert [(p["number"], p["confidence"]) for p in found] == [("+61 2 9999 0000", "high"), ("(02) 9999 0001", "low")]


def test_channels_and_forms(value):
    page = '<a href="https://t.me/share/url?x"><a href="//t.me/group/?utm_source=a"><a href="https://instagram.com/p/9"><a href="https://discord.com/invite/q1?ref=a">'
    assert value(contacts.channels(F.col("h")), h=page) == {"telegram": "https://t.me/group", "discord": "https://discord.com/invite/q1"}
    form = "<form><input name='email'></form>"
    assert value(contacts.has_contact_form(F.lit("https://a.org/contact"), F.lit(form)))
    assert not value(contacts.has_contact_form(F.lit("https://a.org/news"), F.lit(form)))
    assert not value(contacts.has_contact_form(F.lit("https://a.org/contact"), F.lit("<form><input name='q'></form>")))


def test_dates(value):
    text = "Feb 30, 2023; 5 March, 2022 and March 6 2022; june 2021; May 1, 2031; March 6 2022"
    assert value(dates.text_dates(F.col("t"), as_of()), t=text) == [day("2022-03-06"), day("2022-03-05"), day("2021-06-01")]
    for url, wanted in {"https://a/2023/02/03/x": "2023-02-03", "https://a/2023/2": "2023-02-01", "https://a/2023/13/01/": None, "https://a/1999/01/01/": None, "https://a/2025/01/01": None}.items():
        assert value(dates.url_date(F.lit(url), as_of())) == (day(wanted) if wanted else None)
    assert value(dates.strict_iso(F.lit("2024-01-05T10"))) is None
    assert [value(dates.strict_time(F.lit(t))) for t in ("9:30", "24:00", "09:3", "23:59")] == [570, None, None, 1439]


def test_markup_dates(value):
    page = """<script type="application/ld+json">{"@graph": [{"dateModified": "2023-05-01", "name": " A "}]}</script><script type="application/ld+json">[{"datePublished": "2023-07-01T00:00", "headline": "B"}, {"datePublished": "2030-01-01"}]</script>
    <script type="application/ld+json">broken</script><meta property="article:published_time" content="2023-07-01"><time datetime="2022-01-01">"""
    found = value(dates.markup_dates(F.col("h"), as_of()), h=page)
    assert [(str(d["date"]), d["title"]) for d in found] == [("2023-05-01", "A"), ("2023-07-01", "B"), ("2023-07-01", ""), ("2022-01-01", "")]
    assert value(dates.latest(dates.markup_dates(F.col("h"), as_of())), h=page)["title"] == "B"
    assert value(dates.latest(dates.markup_dates(F.col("h"), as_of())), h="") is None


def test_page_text(value):
    page = "<p>A <a>link</a>, &eacute;&#8211;&nbsp;b</p><div>c<script>x<p></script></div><STYLE>y</STYLE>"
    assert value(html.page_text(F.col("h")), h=page).split() == ["A", "link,", "é–", "b", "c"]
    assert "\n\n" in value(html.page_text(F.col("h")), h=page)
    assert value(html.page_text(F.col("h")), h=None) is None


def test_passages(value):
    page = "One.\n\nTwo 𝒳 (three)\n four. Five\n\nsix"
    at = value(passages.span(F.col("p"), F.col("q")), p=page, q="(three) four.")
    assert page[at["start"] : at["end"]] == "(three)\n four."
    assert value(passages.paragraph(F.col("p"), F.col("q")), p=page, q="(three) four.") == "Two 𝒳 (three)\n four. Five"
    known = value(passages.surroundings(F.col("p"), F.col("q")), p=page, q="(three) four.")
    assert (known["prefix"], known["suffix"], known["text"]) == ("One. Two 𝒳", "Five six", "Two 𝒳 (three) four. Five")
    long = value(passages.surroundings(F.col("p"), F.col("q")), p="a " * 600 + "here " + "b " * 600, q="here")
    assert long["text"] is None and len(long["prefix"]) == 149
    for column in (passages.span, passages.paragraph, passages.surroundings):
        assert value(column(F.col("p"), F.col("q")), p=page, q="seven") is None
        assert value(column(F.col("p"), F.col("q")), p=page, q=None) is None


def test_mended_spacing(value):
    mend = passages.mended_spacing(F.col("p"), F.col("q"))
    assert value(mend, p="It — with a.b\\c (x) — ends", q="It—with a.b\\c") == "It — with a.b\\c"
    assert value(mend, p="It—with all", q="It — with") == "It—with"
    assert value(mend, p="It — with all", q="It — with") is None
    assert value(mend, p="stop thief", q="stop, thief") is None
    assert value(mend, p="a b and a b", q="ab") is None


def test_closest(value):
    near = value(passages.closest()(F.col("p"), F.col("q")), p="Before. The quick brown fox leaps. After", q="The quick brown fox jumps.")
    assert "quick brown fox" in near["passage"] and near["ratio"] > 0.6
    assert set(value(passages.closest()(F.col("p"), F.col("q")), p="xyz", q="The quick brown fox")) == {None}


def test_footnotes(spark):
    body = ['[A](https://a.org/x_(y)) "said so" and "more"', '["A"](https://a.org) only', '[A](b.md) "said"', '[A](https://a) [B](https://b) "said"', "see [A](https://a) <!-- unquoted: paywalled: behind a wall of money -->", "none"]
    text = "\n".join(f"[^{i}]: {b}" for i, b in enumerate(body))
    rows = footnotes.definitions(spark.createDataFrame([("d", text), ("e", None)], "path string, text string")).select("line", "label", footnotes.citation(F.col("body")).alias("c"), footnotes.gate(F.col("body")).alias("g")).orderBy("line").collect()
    assert [r["line"] for r in rows] == [1, 2, 3, 4, 5, 6]
    assert tuple(rows[0]["c"]) == ("https://a.org/x_(y)", "A", "said so") and all(r["c"] is None for r in rows[1:])
    assert [r["g"] for r in rows] == ["quoted", "unreasoned", None, "unreasoned", "reasoned", None]


def test_links(spark):
    text = "[a](b.md) ![i](../pic%20one.png)\n```\n[x](gone.md)\n```\n[c](gone.md#s) [d](/docs/sub/) [e](sub/deep) [f](?q) [g](mailto:x)"
    docs = spark.createDataFrame([("docs/a.md", text)], "path string, text string")
    files = spark.createDataFrame([("docs/a.md",), ("docs/b.md",), ("pic one.png",), ("docs/sub/x.md",), ("other/deep.md",)], "path string")
    assert [tuple(r) for r in links.broken_links(docs, files).collect()] == [("docs/a.md", 5, "gone.md#s")]
    resolved = {r["target"]: r["strategy"] for r in links.resolved_links(docs, files.union(spark.createDataFrame([("docs/a/gone.md",)], "path string"))).collect()}
    assert resolved == {"b.md": "source-dir", "gone.md#s": "url-based"}


def test_graph(spark):
    nodes = spark.createDataFrame([("c1", "concept", None, "One"), ("c2", "concept", None, "Two"), ("o1", "organisation", "active", "Alpha"), ("o2", "organisation", None, "Beta")], "id string, type string, status string, label string")
    edges = spark.createDataFrame([("o1", "c1"), ("c1", "o1"), ("o2", "c2"), ("o1", "gone")], "source string, target string")
    known = graph.known_edges(edges, nodes)
    assert known.count() == 3
    assert {r["id"] for r in graph.visible_nodes(nodes, ["concept", "organisation"]).collect()} == {"c1", "c2", "o1"}
    found, touched = graph.search(nodes, known, "ALPHA ")
    assert [r["id"] for r in found.collect()] == ["o1"] and touched.count() == 2
    place = {r["id"]: (r["x"], r["y"]) for r in graph.layout(nodes, known).collect()}
    assert place["c1"] == pytest.approx((0, -500), abs=1e-6) and place["o1"] == pytest.approx((30, -350), abs=1e-6)


def test_places(value):
    assert value(places.unit_hash(F.lit("ab"))) == pytest.approx((97 * 31 + 98) % 3600 / 3600)
    assert value(places.unit_hash(F.lit(""))) == 0
    assert value(places.fading(F.lit(None).cast("int"))) == 1.0 and value(places.fading(F.lit(365))) == 0.5


def test_edits(value):
    text = "---\ntitle: A\nnews_page: n\n---\nBody\nlast_checked: x\n"
    assert value(edits.set_checked(F.col("t"), as_of()), t=text) == text.replace("n\n---", 'n\nlast_checked: "2024-01-31"\n---')
    assert value(edits.add_feed(F.col("t"), F.lit("u$1")), t=text) == text.replace("page: n\n", "page: n\nrss_feed: u$1\n")
    assert value(edits.add_calendar(F.col("t"), F.lit("WEBCAL://c")), t=text) == text.replace("n\n---", "n\nics_feed: https://c\n---")
    assert value(edits.set_checked(F.col("t"), as_of()), t="no front") == "no front"
    assert value(edits.add_feed(F.col("t"), F.lit(None).cast("string")), t=text) == text
    assert value(edits.set_checked(F.col("t"), as_of()), t=None) is None


def test_feed_marks(value):
    from evidara.sources import feeds

    marks = {("text/xml; charset=utf-8", "x"): True, ("text/html", "  <?xml version"): True, ("text/html", "<html>"): False, (None, '{"version": "https://jsonfeed.org/1"}'): True, (None, None): False}
    for (kind, body), wanted in marks.items():
        assert value(feeds.looks_like_feed(F.lit(kind).cast("string"), F.lit(body).cast("string"))) is wanted


def test_events_and_items(spark):
    from evidara.sources import feeds

    events = spark.createDataFrame([("a", day("2024-01-01"), None, "x", "", ""), ("a", day("2024-01-30"), day("2024-02-02"), "y", "", ""), ("a", day("2024-03-30"), None, "z", "", "")], "k string, date date, end_date date, title string, url string, uid string")
    assert [r["title"] for r in feeds.latest_past_event(events, as_of(), "k").collect()] == ["y"]
    assert [r["title"] for r in feeds.coming_events(events, as_of(), 30).collect()] == ["y"]
    items = spark.createDataFrame([("a", None, "t", "l"), ("b", day("2024-01-01"), "t", None)], "k string, date date, title string, link string")
    assert [r["k"] for r in feeds.latest_item(items, "k").collect()] == ["b"]


def test_attributes_and_references(value):
    page = "<IMG SRC='a.png' data-x = \"1 > 2\"><link rel=icon><a href='x'\nhref=\"y\">"
    assert value(markup.values(F.col("h"), "img", "src"), h=page) == ["a.png"]
    assert value(markup.values(F.col("h"), "a", "href"), h=page) == ["y"]
    assert value(markup.values(F.col("h"), "*", "rel"), h=page) == []
    assert [value(markup.largest_size(F.lit(t))) for t in ("16x16 180x180", "any", None, "x9 99999999999x1")] == [180, 0, 0, 0]
    from urllib.parse import urljoin

    bases = ["https://a.org/b/c/d.html?q=1#f", "https://a.org", "http://a.org/b/"]
    refs = ["x.png", "/x.png?y=/../z", "../x", "../../../x", "./", "..", "//cdn.org/x", "https://b.org/../y", "?p=1", "#top", "data:image/png;base64,xx", "a//b/./c"]
    for base in bases:
        for ref in refs:
            wanted = urljoin(base, ref) if not (base == "https://a.org" and ref in ("?p=1",)) else "https://a.org?p=1"
            if ref != "https://b.org/../y":  # whole URLs stay as they are
                assert value(urls.resolve(F.lit(base), F.lit(ref))) == wanted, (base, ref)
    assert value(urls.resolve(F.lit("https://a.org/b?q#f"), F.lit(""))) == "https://a.org/b?q"


def test_logo_candidates(value):
    page = """<link rel="icon" href="i16.png" sizes="16x16"><link rel='shortcut icon' href='i32.png' sizes='16x16 32x32'><link rel="icon" href="">
        <link rel="apple-touch-icon" href="t.png" sizes="57x57"><link rel="apple-touch-icon-precomposed" href="u.png" sizes="180x180"><link rel="mask-icon" type="image/svg+xml" href="/m.svg">
        <meta property="og:image" content="//cdn.org/o.jpg"><meta name="Twitter:Image" content="w.jpg"><meta property="og:image" content="">
        <img class="Site-Logo" src="blank.gif" data-src="logo.png"><img alt="partner logo" src="p.png"><img id="x" src="n.png"><img alt="logo">"""
    found = [(c["url"].removeprefix("https://a.org/s/"), c["kind"], c["confidence"]) for c in value(markup.logo_candidates(F.col("h"), F.lit("https://a.org/s/")), h=page)]
    assert found == [
        ("logo.png", "img-logo", "high"), ("https://a.org/m.svg", "svg-icon", "high"), ("u.png", "apple-touch-icon", "high"), ("t.png", "apple-touch-icon", "high"),
        ("https://cdn.org/o.jpg", "og-image", "low"), ("w.jpg", "og-image", "low"), ("i32.png", "favicon", "low"), ("i16.png", "favicon", "low"), ("https://a.org/favicon.ico", "favicon-fallback", "low"),
    ]
    assert [c["kind"] for c in value(markup.logo_candidates(F.lit(None).cast("string"), F.lit("https://a.org")))] == ["favicon-fallback"]
