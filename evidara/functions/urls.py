"""URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidara.functions.text import ellipsis_parts, let, normalize_ws


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def without_slash(url: Column) -> Column:
    return F.regexp_replace(url, "/+$", "")


def fragment(url: Column) -> Column:
    return F.regexp_extract(url, "#(.*)$", 1)


def _walked(place: Column) -> Column:
    """A path with its dot steps taken and empty inner steps left out; what ends in a dot step ends in a slash."""
    steps = F.split(place, "/")
    inner = F.filter(steps, lambda s, i: (s != "") | (i == 0) | (i == F.size(steps) - 1))
    walk = lambda done, s: F.when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))).when(s == ".", done).otherwise(F.concat(done, F.array(s)))
    end = F.when(F.element_at(steps, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return let(F.concat(F.aggregate(F.slice(inner, F.lit(2), F.size(inner)), F.array(F.lit("")), walk), end), lambda all_: F.when(F.size(all_) == 1, F.lit("/")).otherwise(F.array_join(all_, "/")))


def resolve(base: Column, ref: Column) -> Column:
    """The absolute URL that a reference on the page base means; null where either is."""
    origin = F.regexp_extract(base, "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", 0)
    own = F.regexp_extract(ref, "^[^?#]*", 0)
    rest = F.substring(ref, F.length(own) + 1, F.length(ref))
    return (
        F.when(ref.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), ref)
        .when(ref.startswith("//"), F.concat(F.regexp_extract(base, "^[a-zA-Z][a-zA-Z0-9+.-]*:", 0), ref))
        .when(ref == "", without_fragment(base))
        .when(ref.startswith("#"), F.concat(without_fragment(base), ref))
        .when(ref.startswith("?"), F.concat(origin, path(base), ref))
        .when(ref.startswith("/"), F.concat(origin, _walked(own), rest))
        .otherwise(F.concat(origin, _walked(F.concat(F.regexp_replace(path(base), "[^/]*$", ""), F.when(path(base) == "", "/").otherwise(""), own)), rest))
    )


def _percent(text: Column) -> Column:
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))


def fragment_directive(quote: Column, longest: int = 300, words: int = 8) -> Column:
    """What makes a browser scroll to the quote: the quote itself, or where it begins and where it ends.

    The latter for quotes with three dots between two parts, and for quotes of more than ``longest`` characters, which
    are given by their first and last words.
    """
    plain = normalize_ws(quote)
    head, tail = ellipsis_parts(quote)
    each = F.split(plain, " ")
    ends = F.concat(_percent(F.array_join(F.slice(each, 1, words), " ")), F.lit(","), _percent(F.array_join(F.slice(each, F.greatest(F.size(each) - words + 1, F.lit(1)), F.lit(words)), " ")))
    inner = F.when(head.isNotNull(), F.concat(_percent(head), F.lit(","), _percent(tail))).when(F.length(plain) <= longest, _percent(plain)).otherwise(ends)
    return F.concat(F.lit("text="), inner)


def text_fragment(url: Column, quote: Column) -> Column:
    """The URL with the directive to scroll to the quote; null without a quote, or where the URL has a fragment already."""
    free = (F.length(quote) > 0) & (F.length(url) > 0) & (fragment(url) == "")
    return F.when(free, F.concat(F.regexp_replace(url, "#$", ""), F.lit("#:~:"), fragment_directive(quote)))


# fixed values: single path segments that name a listing
LISTINGS = ("events", "event", "news", "blog", "calendar", "press", "media", "updates", "whats-on")


def is_weak(url: Column) -> Column:
    """A page that only points to a site or a listing: no fragment, and the root or one listing noun as its whole path."""
    segments = F.filter(F.split(path(F.trim(url)), "/"), lambda x: x != "")
    listing = (F.size(segments) == 1) & F.lower(F.get(segments, F.lit(0))).isin(*LISTINGS)
    return (fragment(F.trim(url)) == "") & (path(F.trim(url)).isin("", "/") | listing)


def video_id(url: Column) -> Column:
    """The video that a link of the video site names: in its path for short hosts, embeddings and shorts, else in v=; null for other links."""
    on_site, place = F.contains(host(url), F.lit("youtube.com")), path(url)
    of_watch = F.nullif(F.regexp_extract(url, r"[?&]v=([^&#]+)", 1), F.lit(""))
    return (
        F.when(host(url) == "youtu.be", F.ltrim(place, F.lit("/")))
        .when(on_site & (place == "/watch"), of_watch)
        .when(on_site & place.rlike("^/(?:embed|shorts)/"), F.substring_index(place, "/", -1))
    )


def encyclopedia_page(url: Column) -> Column:
    """Struct (lang, title) of an encyclopedia article by its URL; null for any other URL."""
    name = F.regexp_extract(path(url), "/wiki/(.+)$", 1)
    title = F.coalesce(F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), name)
    return F.when(F.contains(host(url), F.lit("wikipedia.org")) & (name != ""), F.struct(F.substring_index(host(url), ".", 1).alias("lang"), title.alias("title")))


def is_sitemap(url: Column) -> Column:
    return F.contains(F.lower(path(url)), F.lit("sitemap"))
