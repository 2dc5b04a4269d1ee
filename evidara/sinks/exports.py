"""Exports as text rows; the caller chooses where they are written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def csv_flat(df: DataFrame, separator: str = ",") -> DataFrame:
    """df with arrays joined, ready for a CSV writer; nulls become empty."""
    flat = [F.coalesce(F.array_join(c, separator) if kind.startswith("array<string") else F.col(c).cast("string"), F.lit("")).alias(c) for c, kind in df.dtypes]
    return df.select(*flat)


def xml_escape(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def geojson_features(df: DataFrame, key: str, lon: str, lat: str) -> DataFrame:
    """(key, feature): a GeoJSON Feature of each row that has both coordinates, longitude first."""
    rest = [c for c in df.columns if c not in (lon, lat)]
    feature = F.struct(
        F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array(F.col(lon), F.col(lat)).alias("coordinates")).alias("geometry"), F.struct(*rest).alias("properties")
    )
    return df.where(F.col(lon).isNotNull() & F.col(lat).isNotNull()).select(key, F.to_json(feature).alias("feature"))


def kml_placemarks(df: DataFrame, key: str, name: str, status: str, lon: str, lat: str) -> DataFrame:
    """(key, placemark): a KML Placemark of each row with both coordinates; an unknown status looks inactive."""
    style = F.when(F.col(status).isin("active", "inactive", "deregistered"), F.col(status)).otherwise("inactive")
    text = F.concat(
        F.lit("<Placemark><name>"), xml_escape(F.col(name)), F.lit("</name><styleUrl>#"), style, F.lit("</styleUrl><Point><coordinates>"),
        F.col(lon).cast("string"), F.lit(","), F.col(lat).cast("string"), F.lit(",0</coordinates></Point></Placemark>"),
    )
    return df.where(F.col(lon).isNotNull() & F.col(lat).isNotNull()).select(key, text.alias("placemark"))


def ics_escape(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for char, written in (("\\", "\\\\"), (",", "\\,"), (";", "\\;"), ("\n", "\\n")):
        out = F.replace(out, F.lit(char), F.lit(written))
    return out


def ics_fold(line: Column, limit: int = 75) -> Column:
    """The line in pieces of at most limit octets, continuations beginning with a space; characters are never cut."""
    chars = F.split(line, "")

    def add(state: Column, char: Column) -> Column:
        size = F.octet_length(char)
        full = state["used"] + size > limit
        return F.struct(
            F.concat(state["text"], F.when(full, F.lit("\r\n ")).otherwise(F.lit("")), char).alias("text"),
            F.when(full, size + 1).otherwise(state["used"] + size).cast("int").alias("used"),
        )

    return F.aggregate(chars, F.struct(F.lit("").alias("text"), F.lit(0).alias("used")), add, lambda s: s["text"])


def ics_events(df: DataFrame, key: str, date: str, title: str, end_date: str | None = None) -> DataFrame:
    """(key, vevent): an all-day VEVENT of each row, with a stable UID and an exclusive end."""
    day = lambda c: F.date_format(c, "yyyyMMdd")
    end = F.date_add(F.coalesce(F.col(end_date), F.col(date)) if end_date else F.col(date), 1)
    uid = F.sha2(F.concat_ws("|", F.col(key).cast("string"), day(F.col(date)), title), 256)
    lines = F.array(
        F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), F.left(uid, F.lit(32))), F.concat(F.lit("DTSTART;VALUE=DATE:"), day(F.col(date))),
        F.concat(F.lit("DTEND;VALUE=DATE:"), day(end)), ics_fold(F.concat(F.lit("SUMMARY:"), ics_escape(F.col(title)))), F.lit("END:VEVENT"),
    )
    return df.select(key, F.array_join(lines, "\r\n").alias("vevent"))


def citation_json(citations: DataFrame) -> DataFrame:
    """(url, citation): CSL-JSON of each row of ``citations.merge_citations``; what is missing is left out."""
    evidence = F.transform("evidence", lambda e: F.struct(e["type"].alias("type"), e["quote"].alias("quote"), e["status"].alias("status"), e["last_verified"].alias("last-verified"), e["verified_by"].alias("verified-by"), e["context"].alias("context")))
    citation = F.struct("id", "type", F.col("url").alias("URL"), "title", "accessed", "archive", "archive_location", F.col("url_status").alias("url-status"), evidence.alias("evidence"))
    return citations.select("url", F.to_json(citation).alias("citation"))


def citation_list(citations: DataFrame, folder: str) -> None:
    """Write the citations as JSON lines, sorted by URL over all files."""
    citation_json(citations).orderBy("url").select("citation").write.mode("overwrite").text(folder)
