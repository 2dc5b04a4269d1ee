"""Near misses, contacts of sites, pages saved by hand and mended documents, by small cases and plain rules."""

import datetime
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from evidara.functions import contacts, edits, passages, titles
from evidara.operators import footnotes, manual_imports, near_misses, site_contacts
from evidara.sources import canonical


@pytest.fixture
def value(spark):
    def compute(column, **columns):
        schema = ", ".join(f"{name} string" for name in columns)
        return spark.createDataFrame([tuple(columns.values())], schema).select(column.alias("v")).first()["v"]

    return compute


def plain_hint(page, quote, least):
    """The rule written out over whole texts."""
    block = SequenceMatcher(None, page, quote, autojunk=False).find_longest_match()
    if not page or not quote or not block.size:
        return None
    spare = max(0, len(quote) - block.size)
    start = max(0, block.a - spare // 2)
    passage = page[start : min(len(page), start + len(quote) + spare // 2)]
    ratio = SequenceMatcher(None, passage, quote, autojunk=False).ratio()
    if ratio < least:
        return None
    a, b = page[max(0, block.a - 80) : block.a + block.size + 80], quote[max(0, block.b - 80) : block.b + block.size + 80]
    changes = [(a[i:j], b[k:n]) for tag, i, j, k, n in SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if tag != "equal"]
    return passage, round(ratio, 9), quote[block.b : block.b + block.size], changes


def test_closest_equals_the_rule(spark):
    rng, rows = random.Random(7), []
    for at in range(150):
        page = "".join(rng.choice("ab ") if at % 2 else rng.choice("abcdefgh ") for _ in range(rng.randrange(0, 400)))
        start = rng.randrange(0, len(page) + 1)
        quote = page[start : start + rng.randrange(0, 200)]
        quote = "".join(c for c in quote if rng.random() > 0.05) + rng.choice(["", "x", "é b"])
        rows.append((at, " ".join(page.split()), " ".join(quote.split())))
    rows += [(900, None, "a"), (901, "a", None), (902, "", "a"), (903, "a", ""), (904, "same", "same"), (905, "ä" * 3, "ä" * 5)]
    for least in (0.0, 0.6):
        found = spark.createDataFrame(rows, "id int, page string, quote string").select("id", passages.closest(least)(F.col("page"), F.col("quote")).alias("h"))
        got = {r["id"]: None if r["h"] is None or r["h"]["passage"] is None else (r["h"]["passage"], round(r["h"]["ratio"], 9), r["h"]["shared"], [tuple(c) for c in r["h"]["changes"]]) for r in found.collect()}
        assert got == {id_: plain_hint(page or "", quote or "", least) for id_, page, quote in rows}


def test_near_misses_give_the_difference_and_leave_verdicts_alone(spark):
    pages = spark.createDataFrame([("https://a", "We act now — with everyone, for all of us."), ("https://b", "Nothing of the kind"), ("https://c", None), ("https://d", "x" * 3_000_000 + " the very last words stand here")], "url string, text string")
    claims = spark.createDataFrame(
        [(1, "https://a", "act now —with everyone"), (2, "https://a", "act  now — with everyone"), (3, "https://b", "zzz qqq"), (4, "https://none", "x"), (5, "https://c", "y"), (6, "https://d", "the very last word stands here")],
        "id int, url string, quote string",
    )
    got = {r["id"]: r for r in near_misses.near_misses(claims, pages).collect()}
    assert set(got) == {1, 3, 5, 6}
    assert got[1]["difference"].splitlines()[2:4] == ["    - ␣", "    + ∅"] or "    - ␣\n    + ∅" in got[1]["difference"]
    assert got[3]["passage"] is None and got[5]["difference"] is None
    assert got[6]["passage"].strip().endswith("stand here") and got[6]["ratio"] > 0.8
    assert near_misses.near_misses(claims.where("false"), pages).count() == 0


def plain_contacts(pages):
    """A visitor who goes from page to page and stops when nothing is left to find."""
    mail, phone, form, links = {}, None, None, {}
    for url, tier, addresses, number, sure, asks, found in pages:
        if mail and min(m[1] for m in mail.values()) == 0 and phone and phone[1] == "high" and form and len(links) == len(contacts.CHANNELS):
            break
        for address in addresses:
            if address.lower() not in mail or tier < mail[address.lower()][1]:
                mail[address.lower()] = (address, tier, url)
        if number and (phone is None or sure == "high"):
            phone = (number, sure, url)
        form = form or (url if asks else None)
        links = found | links
    pool = [m for m in mail.values() if m[1] == min(x[1] for x in mail.values())]
    best = next((m for m in pool if m[0].startswith("info@")), pool[0] if pool else (None, None, None))
    return best[0], best[2], *(phone or (None, None, None)), form, links


def test_site_contacts_equal_a_visit(spark):
    rng, rows, wanted = random.Random(3), [], {}
    for site in range(40):
        pages = []
        for turn in range(rng.randrange(1, 30)):
            names = [rng.choice(["info", "Ann", "ann", "bob", "INFO2"]) + f"@s{site}.org" for _ in range(rng.randrange(0, 3))]
            names = list({n.lower(): n for n in names}.values())
            number, sure = (str(rng.randrange(10**8, 10**9)), rng.choice(["high", "low"])) if rng.random() < 0.5 else (None, None)
            links = {kind: f"https://{kind}/{turn}" for kind in contacts.CHANNELS if rng.random() < 0.4}
            pages.append((f"https://s{site}.org/{turn}", rng.randrange(0, 3), names, number, sure, rng.random() < 0.3, links))
        wanted[str(site)] = plain_contacts(pages)
        rows += [(str(site), turn, url, tier, names, None if number is None else (number, sure), asks, links) for turn, (url, tier, names, number, sure, asks, links) in enumerate(pages)]
    rng.shuffle(rows)
    found = spark.createDataFrame(rows, "site string, turn int, url string, tier int, emails array<string>, phone struct<number:string,confidence:string>, form boolean, channels map<string,string>")
    got = {r["site"]: (r["email"], r["email_source"], r["phone"], r["phone_confidence"], r["phone_source"], r["form"], r["channels"]) for r in site_contacts.site_contacts(found).collect()}
    assert got == wanted
    assert site_contacts.site_contacts(found.where("false")).count() == 0


def block_of(spark, old, found, force):
    schema = f"old {site_contacts.BLOCK}, found struct<email:string,phone:string,form:string,channels:map<string,string>>"
    row = spark.createDataFrame([(old, found)], schema)
    return row.select(site_contacts.merged_block(F.col("old"), F.col("found"), F.lit("https://s"), F.lit(datetime.date(2024, 6, 30)), force).alias("b")).select("b", site_contacts.block_text(F.col("b")).alias("t")).first()


def test_contact_blocks(spark):
    old = ("a@a.org", None, "", [("signal", "https://old", "Main", None)], "https://before", "2020-01-01")
    kept = block_of(spark, old, ("b@b.org", "1234", None, {"signal": "https://new", "discord": "https://d"}), False)["b"]
    assert (kept["email"], kept["phone"], kept["source"], [tuple(c) for c in kept["channels"]]) == ("a@a.org", "1234", "https://s", [("signal", "https://old", "Main", None), ("discord", "https://d", None, None)])
    forced = block_of(spark, old, ("b@b.org", None, None, {"signal": "https://new"}), True)
    assert forced["t"] == "contact:\n  email: b@b.org\n  channels:\n  - type: signal\n    url: https://new\n    label: Main\n  source: https://s\n  checked: 2024-06-30\n"
    assert block_of(spark, old, ("b@b.org", None, None, {"signal": "https://new"}), False)["b"] is None
    assert block_of(spark, None, (None, None, None, None), True)["b"] is None
    assert block_of(spark, None, ("c@c.org", None, None, None), False)["t"] == "contact:\n  email: c@c.org\n  source: https://s\n  checked: 2024-06-30\n"


def test_blocks_and_logos_in_front_matter(value):
    put = lambda text: value(edits.set_block(F.col("t"), "contact", F.lit("contact:\n  email: $1\n")), t=text)
    assert put("---\ntitle: A\nwebsite: w\nx: 1\n---\nB\n") == "---\ntitle: A\nwebsite: w\ncontact:\n  email: $1\nx: 1\n---\nB\n"
    assert put("---\ncontact:\n  email: a\n  channels:\n  - type: x\nx: 1\n---\ncontact: body\n") == "---\ncontact:\n  email: $1\nx: 1\n---\ncontact: body\n"
    assert put("---\nx: 1\n---\n") == "---\nx: 1\ncontact:\n  email: $1\n---\n" and put("no front") == "no front" and put(None) is None
    logo = lambda text, force: value(edits.set_logo(F.col("t"), F.lit("/new.png"), force), t=text)
    assert logo("---\nlogo: /old.png\n---\n", False) == "---\nlogo: /old.png\n---\n" and logo("---\nlogo: /old.png\n---\n", True) == "---\nlogo: /new.png\n---\n"
    assert logo("---\nwebsite: w\nx: 1\n---\n", False) == "---\nwebsite: w\nlogo: /new.png\nx: 1\n---\n"


def test_mended_quotes(spark):
    order = "---\nevents:\n- date: '2024-01-01'\n  quote: 'it''s: so'\nlast_checked: '2024-01-02'\n---\nBody\n"
    rows = [
        ("raw", "a old b", "old", "new"), ("twice", "old old", "old", "new"), ("event", order, "it's: so", "it is: so"), ("loose", order.replace("- date", "-   date"), "it's: so", "x"), ("none", None, "old", "new"),
        ("link", "---\nshared_link: {description: 'it''s: so', url: u}\n---\n\nBody \n", "it's: so", "now"), ("broken", "---\n: [\n---\n", "it's", "x"), ("empty", "text", "", "x"), ("null", "text", None, "x"), ("list", "---\n- a\n---\n", "it's", "x"),
    ]
    got = {r["k"]: (r["place"], r["mended"]) for r in canonical.mended_quotes(spark.createDataFrame(rows, "k string, text string, old string, new string")).collect()}
    assert got.pop("raw") == ("text", "a new b")
    assert got.pop("event") == ("event", "---\nevents:\n- date: '2024-01-01'\n  quote: 'it is: so'\nlast_checked: '2024-01-02'\n---\nBody\n")
    assert got.pop("link") == ("link", "---\nshared_link:\n  description: now\n  url: u\n---\n\nBody")
    assert set(got.values()) == {(None, None)}


def test_manual_imports(spark):
    lines = [(1, "# note https://x"), (2, "my page.html   https://a.org/1 "), (3, "single"), (4, ""), (5, "my page.html\thttps://a.org/2"), (6, None), (7, "doc.odt https://d.org")]
    names = manual_imports.sidecar(spark.createDataFrame(lines, "line int, value string"))
    assert {tuple(r) for r in names.select("name", "url").collect()} == {("my page.html", "https://a.org/2"), ("doc.odt", "https://d.org")}
    stamp, link, og = "<!-- saved from url=(0042)https://s.org/x) -->", "<LINK HREF='//c.org/' REL='canonical'>", '<meta property="og:url" content="www.o.org">'
    shots = [
        ("my page.html", stamp, "we said so, twice"), ("doc.odt", None, "said"), ("other.pdf", None, "said"), ("s", stamp + link, "said so"), ("far", " " * 2048 + stamp + link + og, "so said"), ("og", og, "said so"), ("blank", og, ""), ("odd", "saved from url=(x)https://no", "said"),
    ]
    saved = spark.createDataFrame(shots, "name string, html string, text string")
    found = manual_imports.recovered(saved, names)
    evidence = spark.createDataFrame([("https://a.org/2/", "said so"), ("https://a.org/2/", "never"), ("https://a.org/2/", "never"), ("https://s.org/x)", "said so"), ("https://c.org", "said ... so"), (None, "x"), ("https://c.org", None)], "url string, quote string")
    imported = manual_imports.matched(found, evidence)
    verdicts = manual_imports.import_verdicts(saved, imported, evidence)
    got = {r["name"]: (r["status"], r["url"], r["source"], r["good"], r["mismatch"]) for r in manual_imports.manifest(imported, verdicts, F.lit("2024-06-30")).collect()}
    assert got == {
        "my page.html": ("IMPORTED", "https://a.org/2/", "url-map, trailing slash normalised", 1, 1), "doc.odt": ("NO_MATCH", "https://d.org", "url-map", 0, 0), "other.pdf": ("SKIPPED", None, "unknown", 0, 0),
        "s": ("IMPORTED", "https://s.org/x)", "stamp", 1, 0), "far": ("IMPORTED", "https://c.org", "meta tag, trailing slash normalised", 0, 1), "og": ("NO_MATCH", "https://www.o.org", "meta tag", 0, 0),
        "blank": ("EMPTY", "https://www.o.org", "meta tag", 0, 0), "odd": ("SKIPPED", None, "unknown", 0, 0),
    }
    urls = lambda *values: spark.createDataFrame([(u,) for u in values], "url string")
    assert {r["url"] for r in manual_imports.asked(urls("https://s.org/x)", "https://q"), urls("https://q", "https://r", None), imported).collect()} == {"https://q", "https://r"}
    assert manual_imports.manual_state(verdicts).count() == 4


def test_titles_and_coverage(spark, value):
    english = lambda t: value(titles.english_title(F.col("t"), F.lit("Org")), t=t)
    assert english("第12次小松活動第松") == "12th 小 Hackathon" and english("公民科技年度活動小活動") == "Civic Tech 年度活動小 Activity" and english("第次松") == "Org event"
    assert english("Meeting 大") is None and english("") is None and english(None) is None and english("ハック") is None
    text = '[^1]: [A](https://a) "said"\n[^2]: none <!-- unquoted: a: short -->\n[^3]: none\n'
    got = footnotes.coverage(footnotes.definitions(spark.createDataFrame([("x", text), ("y", "none"), ("x", None)], "folder string, text string")), "folder").collect()
    assert [tuple(r) for r in got] == [("x", 3, 1, 1, 1, 1)]
