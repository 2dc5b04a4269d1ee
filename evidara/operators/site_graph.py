"""The graph of a site's pages: concepts, organisations and projects, and what links them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidara.operators.graph import known_edges

# fixed values: folders of pages, the prefixes of their nodes, their kinds, and their front pages
KINDS = {"concepts": ("concept", "concept", "index"), "organisations": ("org", "organisation", "index"), "projects": ("project", "project", "projects")}


def see_also(text: Column) -> Column:
    """The Markdown documents linked in the first section headed "See also", up to the next heading of its level."""
    after = F.get(F.split(text, r"##\s+See\s+[Aa]lso\b[^\n]*\n", 2), F.lit(1))
    section = F.get(F.split(after, r"\n##\s", 2), F.lit(0))
    targets = F.transform(F.regexp_extract_all(section, F.lit(r"\]\(([^()\s]+)\)"), F.lit(1)), lambda t: F.split_part(t, F.lit("#"), F.lit(1)))
    return F.coalesce(F.filter(targets, lambda t: t.endswith(".md")), F.array().cast("array<string>"))


def site_pages(docs: DataFrame) -> DataFrame:
    """docs (path, ...) that are pages of the graph, with folder, slug and id; front pages and other folders are left out."""
    folder, slug = F.split_part("path", F.lit("/"), F.lit(1)), F.regexp_extract("path", r"^[^/]+/(.+)\.md$", 1)
    named = docs.withColumn("folder", folder).withColumn("slug", slug).where(F.col("folder").isin(*KINDS) & (F.col("slug") != ""))
    front = F.coalesce(*(F.when(F.col("folder") == f, F.col("slug") == kind[2]) for f, kind in KINDS.items()))
    prefix = F.coalesce(*(F.when(F.col("folder") == f, F.lit(kind[0])) for f, kind in KINDS.items()))
    return named.where(~front).withColumn("id", F.concat(prefix, F.lit(":"), "slug"))


def nodes(pages: DataFrame) -> DataFrame:
    """(id, label, type, status, org_type, activity_date, logo, url) of each page; what its kind lacks is null."""
    kind = F.coalesce(*(F.when(F.col("folder") == f, F.lit(k[1])) for f, k in KINDS.items()))
    no_concept, org = F.col("folder") != "concepts", F.col("folder") == "organisations"
    said = lambda name: F.coalesce(F.col(name), F.lit(""))
    return pages.select(
        "id", F.coalesce(F.nullif("title", F.lit("")), "slug").alias("label"), kind.alias("type"), F.when(no_concept, said("status")).alias("status"), F.when(org, said("type")).alias("org_type"),
        F.when(no_concept, said("activity_date")).alias("activity_date"), F.when(org, said("logo")).alias("logo"), F.concat(F.lit("/"), "folder", F.lit("/"), "slug", F.lit("/")).alias("url"),
    )


def edges(pages: DataFrame) -> DataFrame:
    """(source, target, type) that pages state: concepts see others, projects name organisations, both are about concepts.

    Organisations that are related stand in the order of their ids. All edges of a page come from one array, so pages are
    read once.
    """
    edge = lambda source, target, kind: F.struct(source.alias("source"), target.alias("target"), F.lit(kind).alias("type"))
    own, none = F.col("id"), F.array().cast("array<struct<source:string,target:string,type:string>>")
    bare = lambda t: F.regexp_replace(t, r"\.md$", "")
    linked = see_also(F.col("text"))
    beside = F.transform(F.filter(linked, lambda t: ~F.contains(t, F.lit("/"))), lambda t: edge(own, F.concat(F.lit("concept:"), bare(t)), "see_also"))
    hosts = F.transform(F.filter(linked, lambda t: t.startswith("../organisations/")), lambda t: edge(own, F.concat(F.lit("org:"), F.substring(bare(t), F.lit(18), F.length(t))), "relates_to"))
    about = F.transform("concepts", lambda c: edge(own, F.concat(F.lit("concept:"), c), "relates_to"))
    kin = F.transform("related_orgs", lambda r: edge(F.least(own, F.concat(F.lit("org:"), r)), F.greatest(own, F.concat(F.lit("org:"), r)), "org_link"))
    parts = {"concepts": (beside,), "organisations": (about, kin), "projects": (hosts, about)}
    stated = F.coalesce(*(F.when(F.col("folder") == f, F.concat(*(F.coalesce(p, none) for p in of_kind))) for f, of_kind in parts.items()))
    return pages.select(F.explode(stated).alias("e")).select("e.source", "e.target", "e.type")


def graph(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes, and the different edges between them; docs: path, text, title, type, status, logo, concepts, related_orgs, activity_date.

    Edges to pages that don't exist are left out. Null lists state nothing.
    """
    pages = site_pages(docs)
    known = nodes(pages)
    return known, known_edges(edges(pages), known)
