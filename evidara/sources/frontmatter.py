"""Documents with a metadata block between two lines of three dashes."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OPEN = r"^---[ \t]*\r?\n"
_SPLIT = r"(?s)^---[ \t]*\r?\n(.*?)(?:(?<=\n)|^)---[ \t]*(?:\r?\n|$)(.*)$"

RECORD = (
    "title string, type string, status string, country string, website string, logo string, summary string, concepts array<string>, related_orgs array<string>, "
    "latitude double, longitude double, precision string, location_name string, email string, phone string, contact_form string, channels array<struct<type:string,url:string,label:string,note:string>>, "
    "news_page string, rss_feed string, ics_feed string, last_checked string, activity map<string,struct<date:string,note:string,url:string,checked:string,hint:string>>, "
    "events array<struct<date:string,title:string,url:string,source:string,quote:string,note:string,proof_level:string,end_date:string,time:string,notable:boolean,location:string,country:string,proof_warning:boolean>>, error string"
)


def split_document(content: Column) -> Column:
    """(yaml, body) of a document; both null where there is no block. The block ends at the first line of just three dashes."""
    fits = content.rlike(_SPLIT)
    return F.when(fits, F.struct(F.regexp_extract(content, _SPLIT, 1).alias("yaml"), F.regexp_extract(content, _SPLIT, 2).alias("body")))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, slug, yaml, body) for each Markdown file under path; index files are left out."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md").withColumn("path", F.col("_metadata.file_path"))
    slug = F.regexp_extract("path", r"([^/]*)\.md$", 1)
    return files.select("path", slug.alias("slug"), split_document(F.col("value")).alias("parts")).where("slug <> 'index'").select("path", "slug", "parts.yaml", "parts.body")


def _text(value: object) -> str | None:
    return None if value is None or value == "" else str(value)


def _record(meta: dict) -> dict:
    """A typed record from parsed metadata; what has the wrong shape is dropped, not an error."""
    as_dict = lambda x: x if isinstance(x, dict) else {}
    as_list = lambda x: x if isinstance(x, list) else []
    number = lambda x: float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else None
    location, contact = as_dict(meta.get("location")), as_dict(meta.get("contact"))
    names = "title type status country website logo summary news_page rss_feed ics_feed last_checked".split()
    out: dict = {k: _text(meta.get(k)) for k in names}
    if out["summary"]:
        out["summary"] = out["summary"].strip().strip('"')
    out |= {"concepts": [str(x) for x in as_list(meta.get("concepts"))], "related_orgs": [str(x) for x in as_list(meta.get("related_orgs"))]}
    out |= {"latitude": number(location.get("latitude")), "longitude": number(location.get("longitude")), "precision": _text(location.get("precision")), "location_name": _text(location.get("name"))}
    out |= {"email": _text(contact.get("email")), "phone": _text(contact.get("phone")), "contact_form": _text(contact.get("form"))}
    out["channels"] = [{k: _text(c.get(k)) for k in ("type", "url", "label", "note")} for c in as_list(contact.get("channels")) if isinstance(c, dict)]
    out["activity"] = {str(k): {f: _text(v.get(f)) for f in ("date", "note", "url", "checked", "hint")} for k, v in as_dict(meta.get("activity")).items() if isinstance(v, dict)}
    fields = "date title url source quote note proof_level end_date time location country".split()
    out["events"] = [{k: _text(e.get(k)) for k in fields} | {"notable": bool(e.get("notable")), "proof_warning": "proof_warning" in e} for e in as_list(meta.get("events")) if isinstance(e, dict)]
    out["error"] = None
    return out


def parse_records(documents: DataFrame) -> DataFrame:
    """documents with a ``record`` of the typed metadata; metadata that is no mapping gives a record of nulls with ``error``."""

    @F.pandas_udf("string")
    def parse(texts: pd.Series) -> pd.Series:
        import yaml

        rows = []
        for text in texts:
            try:
                meta = yaml.safe_load(text) if text else None
                rows.append(_record(meta) if isinstance(meta, dict) else {"error": "no metadata"})
            except yaml.YAMLError as problem:
                rows.append({"error": str(problem).splitlines()[0]})
        return pd.Series([json.dumps(row) for row in rows])

    return documents.withColumn("record", F.from_json(parse(F.coalesce("yaml", F.lit(""))), RECORD))


def signals(records: DataFrame) -> DataFrame:
    """(entity, source, date): the activity entries with a date, for the selection of the best one."""
    entries = records.select(F.col("slug").alias("entity"), F.explode("record.activity").alias("source", "entry"))
    return entries.select("entity", "source", F.expr("try_cast(left(entry.date, 10) as date)").alias("date"))
