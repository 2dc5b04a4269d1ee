"""The whole landscape of entities as flat rows, JSON, GeoJSON, KML and a graph file.

A file made of many rows is written as ordered text parts: those of a folder, joined in the order of their names, are the
document. So no task holds it whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.operators.activity import select_activity
from evidara.sinks.exports import xml_escape
from evidara.sources.frontmatter import signals

# fixed values: the columns of the flat file in their order
FLAT = (
    "slug", "title", "status", "country", "type", "website", "logo", "summary", "concepts", "latitude", "longitude", "location_name", "rss_feed", "ics_feed",
    "contact_email", "contact_phone", "contact_form", "contact_channels", "activity_date", "activity_method", "last_checked",
)
# fixed values: colours of states on the map (alpha, blue, green, red) and the icon
MAP_COLOURS = {"active": "ff00bb00", "inactive": "ff888888", "deregistered": "ff0000cc"}
MAP_ICON = "http://maps.google.com/mapfiles/kml/shapes/placemark_circle.png"


def landscape(records: DataFrame, as_of: Column) -> DataFrame:
    """A row for each record (slug, record) with the columns of the flat file, not yet flattened; missing texts are empty.

    The title falls back to the slug. Activity is the best signal of each entity, joined once by slug.
    """
    text = lambda name: F.coalesce(F.col(f"record.{name}"), F.lit(""))
    best = select_activity(signals(records), as_of).select(F.col("entity").alias("slug"), F.date_format("date", "yyyy-MM-dd").alias("activity_date"), F.col("source").alias("activity_method"))
    rows = records.where("slug <> 'index'").select(
        "slug", F.coalesce("record.title", "slug").alias("title"), *(text(n).alias(n) for n in ("status", "country", "type", "website", "logo", "summary")),
        F.coalesce("record.concepts", F.array().cast("array<string>")).alias("concepts"), "record.latitude", "record.longitude", *(text(n).alias(n) for n in ("location_name", "rss_feed", "ics_feed")),
        text("email").alias("contact_email"), text("phone").alias("contact_phone"), text("contact_form").alias("contact_form"), F.col("record.channels").alias("contact_channels"), text("last_checked").alias("last_checked"),
    )
    joined = rows.join(best, "slug", "left")
    return joined.withColumns({c: F.coalesce(c, F.lit("")) for c in ("activity_date", "activity_method")}).select(*FLAT)


def flat_rows(rows: DataFrame) -> DataFrame:
    """The 21 columns as texts, in order: concepts by commas, channels as type:url by semicolons."""
    channels = F.array_join(F.transform("contact_channels", lambda c: F.concat(F.coalesce(c["type"], F.lit("")), F.lit(":"), F.coalesce(c["url"], F.lit("")))), "; ")
    flat = {"concepts": F.array_join("concepts", ","), "contact_channels": channels, "latitude": F.col("latitude").cast("string"), "longitude": F.col("longitude").cast("string")}
    return rows.select(*(F.coalesce(flat.get(c, F.col(c)), F.lit("")).alias(c) for c in FLAT))


def concept_edges(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("slug").alias("org_slug"), F.explode("concepts").alias("concept_slug"))


def metadata(rows: DataFrame, generated_at: str, source: str) -> str:
    """The envelope's facts as JSON: when and from where, how many rows, the latest activity (empty without any)."""
    facts = rows.agg(F.count("*").alias("org_count"), F.coalesce(F.max("activity_date"), F.lit("")).alias("last_activity_date"))
    return facts.select(F.to_json(F.struct(F.lit(generated_at).alias("generated_at"), F.lit(source).alias("source"), "org_count", "last_activity_date")).alias("m")).first()["m"]


def document(spark: SparkSession, pieces: Sequence[str | DataFrame], separator: str = "") -> DataFrame:
    """(part, key, line) of a document of fixed lines and rows (key, line) between them.

    Rows come by key, which is to be unique in a piece; each but the first of its piece begins with the separator.
    """
    whole = spark.createDataFrame([], "part int, key string, line string")
    for part, piece in enumerate(pieces):
        if isinstance(piece, str):
            whole = whole.unionByName(spark.range(1).select(F.lit(part).alias("part"), F.lit("").alias("key"), F.lit(piece).alias("line")))
            continue
        first = piece.agg(F.min(F.struct("key", "line")).alias("first")).first()["first"] or (None, None)  # one line
        opens = F.col("key").eqNullSafe(F.lit(first[0])) & F.col("line").eqNullSafe(F.lit(first[1]))
        whole = whole.unionByName(piece.select(F.lit(part).alias("part"), "key", F.when(opens, F.col("line")).otherwise(F.concat(F.lit(separator), "line")).alias("line")))
    return whole


def write_document(lines: DataFrame, folder: str) -> None:
    """The document as ordered text parts, by a sort into ranges."""
    lines.orderBy("part", "key", "line").select("line").write.mode("overwrite").text(folder)


def _on_map() -> Column:
    return F.col("latitude").isNotNull() & F.col("longitude").isNotNull()


def json_document(rows: DataFrame, facts: str) -> DataFrame:
    """Everything about each entity; the location is null where there is no latitude."""
    place = F.when(F.col("latitude").isNotNull(), F.struct("latitude", "longitude", F.col("location_name").alias("name")))
    others = [c for c in FLAT if c not in ("latitude", "longitude", "location_name")]
    each = rows.select(F.col("slug").alias("key"), F.to_json(F.struct(*others, place.alias("location")), {"ignoreNullFields": "false"}).alias("line"))
    return document(rows.sparkSession, [f'{{"metadata": {facts}, "organisations": [', each, "]}"], ",")


def _summary_html(value, linked: Column, with_activity: bool) -> Column:
    """What a map shows of an entity; value turns a text into what may stand in the document."""
    or_dash = lambda text: F.when(text == "", "—").otherwise(text)
    concepts = or_dash(value(F.array_join("concepts", ", ")))
    activity = or_dash(F.when(F.col("activity_date") == "", "").otherwise(F.concat("activity_date", F.lit(" ("), "activity_method", F.lit(")"))))
    facts = [("Status", value(F.col("status"))), ("Country", value(F.col("country"))), ("Type", value(F.col("type"))), ("Website", or_dash(linked))]
    facts += [("Last activity", value(activity))] if with_activity else []
    lines = [F.concat(F.lit(f"<b>{name}:</b> "), text, F.lit("<br>")) for name, text in [*facts, ("Concepts", concepts)]]
    return F.concat(*lines, F.lit("<br>"), value(F.col("summary")))


def _linked(site: Column) -> Column:
    return F.when(site == "", "").otherwise(F.concat(F.lit('<a href="'), site, F.lit('">'), site, F.lit("</a>")))


def geojson_document(rows: DataFrame, facts: str) -> DataFrame:
    """A FeatureCollection of the entities that have both coordinates, longitude first."""
    text = _summary_html(lambda c: c, _linked(F.col("website")), with_activity=False)
    others = [c for c in FLAT if c not in ("latitude", "longitude", "title", "activity_date", "activity_method")]
    feature = F.struct(
        F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array("longitude", "latitude").alias("coordinates")).alias("geometry"),
        F.struct(*others, F.col("title").alias("name"), text.alias("description")).alias("properties"),
    )
    each = rows.where(_on_map()).select(F.col("slug").alias("key"), F.to_json(feature).alias("line"))
    return document(rows.sparkSession, [f'{{"type": "FeatureCollection", "metadata": {facts}, "features": [', each, "]}"], ",")


def kml_document(rows: DataFrame, name: str, description: str) -> DataFrame:
    """Placemarks in the colour of their state, unknown states as inactive ones; texts are escaped."""
    styles = "\n".join(f'<Style id="{state}"><IconStyle><color>{colour}</color><scale>1.0</scale><Icon><href>{MAP_ICON}</href></Icon></IconStyle></Style>' for state, colour in MAP_COLOURS.items())
    state = F.when(F.col("status").isin(*MAP_COLOURS), F.col("status")).otherwise("inactive")
    told = F.replace(_summary_html(xml_escape, _linked(xml_escape(F.col("website"))), with_activity=True), F.lit("]]>"), F.lit("]]]]><![CDATA[>"))
    mark = F.concat(
        F.lit("<Placemark><name>"), xml_escape(F.col("title")), F.lit("</name><description><![CDATA["), told, F.lit("]]></description><styleUrl>#"), state,
        F.lit("</styleUrl><Point><coordinates>"), F.col("longitude").cast("string"), F.lit(","), F.col("latitude").cast("string"), F.lit(",0</coordinates></Point></Placemark>"),
    )
    escaped = lambda text: text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<kml xmlns="http://www.opengis.net/kml/2.2">\n<Document>\n<name>{escaped(name)}</name>\n<description>{escaped(description)}</description>\n{styles}'
    return document(rows.sparkSession, [head, rows.where(_on_map()).select(F.col("slug").alias("key"), mark.alias("line")), "</Document>\n</kml>"])


def graph_document(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes and edges, as ``site_graph.graph`` gives them, in one JSON document."""
    node = nodes.select(F.col("id").alias("key"), F.to_json(F.struct(*nodes.columns)).alias("line"))
    edge = edges.select(F.concat_ws("\u0000", "source", "target", "type").alias("key"), F.to_json(F.struct("source", "target", "type")).alias("line"))
    return document(nodes.sparkSession, ['{"nodes": [', node, '], "edges": [', edge, "]}"], ",")
