"""Exports of the whole landscape, the site's graph, and the rules of records, by small cases."""

import glob
import json
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from evidara.operators import integrity, site_graph
from evidara.sinks import landscape
from evidara.sources import frontmatter

ALPHA = """title: 'Alpha & "Co"'
status: active
country: DE
type: network
website: https://a.org/?x=1&y=2
summary: ' "Short" '
concepts: [ring, widget]
location: {latitude: 52.5, longitude: 13.25, name: Berlin}
contact: {email: a@a.org, form: https://a.org/form, channels: [{type: chat, url: 'https://c/1'}, {type: forum}]}
activity:
  rss: {date: 2023-12-01}
  manual: {date: 2024-01-05}
  dod: odd
"""
BETA = "status: merged\nlocation: {latitude: 1.5, longitude: -2}\nsummary: 'a ]]> b'\n"


@pytest.fixture
def rows(spark):
    documents = spark.createDataFrame([("alpha", ALPHA), ("beta", BETA), ("gamma", "title: Gamma\nlocation: {longitude: 3}\n"), ("delta", None), ("index", ALPHA)], "slug string, yaml string")
    return landscape.landscape(frontmatter.parse_records(documents), F.lit("2024-01-31").cast("date"))


def whole(df, folder):
    """What the parts give when joined in the order of their names."""
    landscape.write_document(df, folder)
    return "".join(open(name, encoding="utf-8").read() for name in sorted(glob.glob(f"{folder}/part-*")))


def test_flat_rows(rows):
    flat = landscape.flat_rows(rows)
    assert flat.columns == list(landscape.FLAT) and len(flat.columns) == 21
    found = {r["slug"]: r.asDict() for r in flat.collect()}
    assert sorted(found) == ["alpha", "beta", "delta", "gamma"]
    alpha = found["alpha"]
    assert (alpha["concepts"], alpha["contact_channels"], alpha["summary"]) == ("ring,widget", "chat:https://c/1; forum:", ' "Short" '.strip().strip('"'))
    assert (alpha["activity_date"], alpha["activity_method"], alpha["latitude"], alpha["location_name"], alpha["contact_form"]) == ("2024-01-05", "manual", "52.5", "Berlin", "https://a.org/form")
    assert found["delta"] == {c: "delta" if c in ("slug", "title") else "" for c in landscape.FLAT}
    assert sorted(map(tuple, landscape.concept_edges(rows).collect())) == [("alpha", "ring"), ("alpha", "widget")]


def test_json_and_map_documents(rows, tmp_path):
    facts = landscape.metadata(rows, "2024-01-31T00:00:00Z", "https://site.example")
    assert json.loads(facts) == {"generated_at": "2024-01-31T00:00:00Z", "source": "https://site.example", "org_count": 4, "last_activity_date": "2024-01-05"}
    everything = json.loads(whole(landscape.json_document(rows, facts), str(tmp_path / "json")))
    places = {o["slug"]: o["location"] for o in everything["organisations"]}
    assert places == {"alpha": {"latitude": 52.5, "longitude": 13.25, "name": "Berlin"}, "beta": {"latitude": 1.5, "longitude": -2.0, "name": ""}, "gamma": None, "delta": None}
    mapped = json.loads(whole(landscape.geojson_document(rows, facts), str(tmp_path / "geojson")))
    assert mapped["type"] == "FeatureCollection" and [f["geometry"]["coordinates"] for f in mapped["features"]] == [[13.25, 52.5], [-2.0, 1.5]]
    told = mapped["features"][0]["properties"]
    assert told["name"] == 'Alpha & "Co"' and told["description"].endswith("<b>Concepts:</b> ring, widget<br><br>Short")
    assert "<b>Website:</b> —<br>" in mapped["features"][1]["properties"]["description"]


def test_kml_document(rows, tmp_path):
    root = ET.fromstring(whole(landscape.kml_document(rows, "A & B", "four <entities>"), str(tmp_path / "kml")).encode())
    tag = "{http://www.opengis.net/kml/2.2}"
    marks = root.findall(f"{tag}Document/{tag}Placemark")
    assert [m.find(f"{tag}styleUrl").text for m in marks] == ["#active", "#inactive"]
    assert [m.find(f"{tag}Point/{tag}coordinates").text for m in marks] == ["13.25,52.5,0", "-2.0,1.5,0"]
    assert "<b>Last activity:</b> 2024-01-05 (manual)<br>" in marks[0].find(f"{tag}description").text and marks[1].find(f"{tag}description").text.endswith("a ]]&gt; b")
    assert len(root.findall(f"{tag}Document/{tag}Style")) == 3


def test_documents_without_rows(rows, tmp_path):
    none = rows.where("false")
    facts = landscape.metadata(none, "now", "here")
    assert json.loads(facts)["last_activity_date"] == ""
    assert json.loads(whole(landscape.geojson_document(none, facts), str(tmp_path / "none")))["features"] == []


PAGE = "path string, text string, title string, type string, status string, logo string, concepts array<string>, related_orgs array<string>, activity_date string"


def test_site_graph(spark, tmp_path):
    pages = [
        ("concepts/ring.md", "## See Also (more)\n[a](widget.md#x) [b](../concepts/no.md) [c](ring.md)\n[d](gone.md)\n## Next\n[e](other.md)", "Ring", None, None, None, None, None, None),
        ("concepts/widget.md", "none", "", None, None, None, ["ring"], None, None),
        ("concepts/other.md", None, "Other", None, None, None, None, None, None),
        ("concepts/index.md", "## See also\n[a](ring.md)", "Front", None, None, None, None, None, None),
        ("organisations/a.md", "## See also\n[a](ring.md)", "A", "network", "active", "a.png", ["ring", "ring", "gone"], ["z", "gone"], "2024-01-05"),
        ("organisations/z.md", "", "Z", None, None, None, None, ["a"], None),
        ("projects/p.md", "## See also\n[z](../organisations/z.md) [ring](ring.md)", "P", None, "active", None, ["other"], None, None),
        ("projects/projects.md", "", "Projects", None, None, None, ["ring"], None, None),
        ("blog/b.md", "## See also\n[a](ring.md)", "B", None, None, None, ["ring"], None, None),
    ]
    nodes, edges = site_graph.graph(spark.createDataFrame(pages, PAGE))
    assert sorted(r["id"] for r in nodes.collect()) == ["concept:other", "concept:ring", "concept:widget", "org:a", "org:z", "project:p"]
    labels = {r["id"]: (r["label"], r["type"], r["status"], r["org_type"], r["url"]) for r in nodes.collect()}
    assert labels["concept:widget"] == ("widget", "concept", None, None, "/concepts/widget/") and labels["org:a"] == ("A", "organisation", "active", "network", "/organisations/a/")
    assert sorted((r["source"], r["target"], r["type"]) for r in edges.collect()) == [
        ("concept:ring", "concept:ring", "see_also"), ("concept:ring", "concept:widget", "see_also"), ("org:a", "concept:ring", "relates_to"), ("org:a", "org:z", "org_link"),
        ("project:p", "concept:other", "relates_to"), ("project:p", "org:z", "relates_to"),
    ]
    file = json.loads(whole(landscape.graph_document(nodes, edges), str(tmp_path / "graph")))
    assert len(file["nodes"]) == 6 and len(file["edges"]) == 6 and "status" not in file["nodes"][0]


def test_record_rules(spark):
    front = {
        "good": "status: active\nwebsite: https://a\ncountry: DE\nconcepts: [ring]\nlocation: {name: Berlin}",
        "bad": "status: active\nwebsite: https://web.archive.org/web/1/x\ncountry: Germany\nconcepts: [ring, gone, gone, lost]",
        "old": "status: inactive\nwebsite: https://live.org\nlast_checked: '2024-01-30'",
        "odd": "status: merged\nlast_checked: 2023-01-01",
        "none": "",
    }
    records = frontmatter.parse_records(spark.createDataFrame(list(front.items()), "slug string, yaml string"))
    concepts = spark.createDataFrame([("ring",)], "slug string")
    found = sorted(map(tuple, integrity.record_issues(records, concepts).collect()))
    assert found == [("bad", "concepts"), ("bad", "country"), ("bad", "location"), ("bad", "website-active"), ("odd", "status"), ("old", "website-inactive")]
    due = integrity.record_issues(records, concepts, F.lit("2024-01-31").cast("date"), days=30)
    assert sorted({r["slug"] for r in due.collect()}) == ["bad", "odd"]


def test_front_matter_rules(spark):
    docs = [("a", "x"), ("b", "---\nx: 1"), ("c", "---\nx: 1\n---\nbody\n---\nmore\n---"), ("d", "---\n---\nbody\n--- "), ("e", None), ("f", " ---\n---")]
    found = integrity.front_matter_issues(spark.createDataFrame(docs, "slug string, text string")).collect()
    assert sorted((r["slug"], r["rule"], r["line"]) for r in found) == [("a", "fm-opening", None), ("b", "fm-closing", None), ("c", "fm-stray", 5), ("c", "fm-stray", 7), ("e", "fm-opening", None), ("f", "fm-opening", None)]
