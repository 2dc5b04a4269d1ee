"""Tags and their attributes as expressions, and what they say about a page's logo."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidara.functions.text import let
from evidara.functions.urls import resolve

# fixed values: words in an image's description that make it somebody else's logo
NOT_OWN_LOGO = ("sponsor", "partner", "client", "funder", "award", "badge")
# fixed values: where lazy pages keep an image's address, best first
IMAGE_SOURCES = ("data-src", "data-lazy-src", "data-original", "src")

CANDIDATE = "struct<url:string,kind:string,confidence:string>"


def attributes(inner: Column) -> Column:
    """Structs (name, value) of the quoted attributes inside a tag, names in lower case."""
    pairs = F.regexp_extract_all(inner, F.lit(r"""[\w:.-]+\s*=\s*(?:"[^"]*"|'[^']*')"""), F.lit(0))

    def cut(pair: Column) -> Column:
        value = F.ltrim(F.regexp_replace(pair, r"^[^=]*=\s*", ""))
        return F.struct(F.lower(F.regexp_extract(pair, r"^[\w:.-]+", 0)).alias("name"), F.substring(value, F.lit(2), F.length(value) - 2).alias("value"))

    return F.transform(pairs, cut)


def attribute(found: Column, name: str) -> Column:
    """The value of the last attribute of that name, else null."""
    return F.try_element_at(F.filter(found, lambda a: a["name"] == name), F.lit(-1))["value"]


def tags(html: Column, name: str) -> Column:
    """The attributes of each tag of that name, in page order; a name of "*" means every opening tag."""
    called = r"[a-zA-Z][\w-]*" if name == "*" else name
    return F.transform(F.regexp_extract_all(html, F.lit(rf"(?i)<{called}\b([^>]*)>"), F.lit(1)), attributes)


def values(html: Column, tag: str, name: str) -> Column:
    """The values of one attribute over all tags of a name, those without it left out."""
    return F.array_compact(F.transform(tags(html, tag), lambda found: attribute(found, name)))


def values_where(html: Column, tag: str, kind: str, value: str, name: str) -> Column:
    """The values of attribute ``name`` over the tags whose attribute ``kind`` has that value, case aside."""
    mine = F.filter(tags(html, tag), lambda found: F.lower(attribute(found, kind)) == value)
    return F.array_compact(F.transform(mine, lambda found: attribute(found, name)))


def largest_size(sizes: Column) -> Column:
    """The largest width of a list like "16x16 180x180", 0 without any."""
    widths = F.transform(F.split(F.coalesce(sizes, F.lit("")), r"\s+"), lambda part: F.regexp_extract(part, r"^(\d{1,9})x\d", 1).try_cast("int"))
    return F.coalesce(F.array_max(widths), F.lit(0))


def _said(found: Column, name: str) -> Column:
    return F.coalesce(attribute(found, name), F.lit(""))


def _candidates(found: Column, base: Column, kind: str, confidence: str) -> Column:
    return F.transform(found, lambda ref: F.struct(resolve(base, ref).alias("url"), F.lit(kind).alias("kind"), F.lit(confidence).alias("confidence")))


def logo_candidates(html: Column, base: Column) -> Column:
    """Structs (url, kind, confidence) of a page's possible logos, best first.

    In turn: images that call themselves a logo and nobody else's; drawn icons; touch icons, largest first; images for
    social cards; other icons, largest first; the file that a site has by custom. Equal sizes keep page order. A null
    page has the last one only.
    """

    def image(found: Column) -> Column:
        source = F.coalesce(*(F.nullif(attribute(found, name), F.lit("")) for name in IMAGE_SOURCES))
        hint = F.lower(F.concat_ws(" ", *(_said(found, name) for name in ("class", "id", "alt"))))
        others = F.exists(F.array(*map(F.lit, NOT_OWN_LOGO)), lambda word: F.contains(hint, word))
        return F.when(F.contains(hint, F.lit("logo")) & ~others, source)

    def icon(found: Column) -> Column:
        rel = F.lower(_said(found, "rel"))
        kind = F.when(F.lower(_said(found, "type")) == "image/svg+xml", "svg").when(F.contains(rel, F.lit("apple-touch-icon")), "touch").otherwise("plain")
        ref = F.nullif(attribute(found, "href"), F.lit(""))
        return F.when(F.contains(rel, F.lit("icon")) & ref.isNotNull(), F.struct(kind.alias("kind"), (-largest_size(attribute(found, "sizes"))).alias("rank"), ref.alias("ref")))

    def card(found: Column) -> Column:
        named = F.lower(F.coalesce(F.nullif(attribute(found, "property"), F.lit("")), attribute(found, "name")))
        return F.when(named.isin("og:image", "twitter:image"), F.nullif(attribute(found, "content"), F.lit("")))

    def of_kind(icons: Column, kind: str) -> Column:
        numbered = F.transform(icons, lambda i, at: F.struct(i["rank"].alias("rank"), at.alias("at"), i["ref"].alias("ref"), i["kind"].alias("kind")))
        mine = F.filter(numbered, lambda i: i["kind"] == kind)
        return F.transform(mine if kind == "svg" else F.array_sort(mine), lambda i: i["ref"])

    page = F.coalesce(html, F.lit(""))
    icons = F.array_compact(F.transform(tags(page, "link"), icon))
    return let(icons, lambda known: F.concat(
        _candidates(F.array_compact(F.transform(tags(page, "img"), image)), base, "img-logo", "high"),
        _candidates(of_kind(known, "svg"), base, "svg-icon", "high"),
        _candidates(of_kind(known, "touch"), base, "apple-touch-icon", "high"),
        _candidates(F.array_compact(F.transform(tags(page, "meta"), card)), base, "og-image", "low"),
        _candidates(of_kind(known, "plain"), base, "favicon", "low"),
        _candidates(F.array(F.lit("/favicon.ico")), base, "favicon-fallback", "low"),
    ))
