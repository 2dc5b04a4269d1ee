"""Tag suggestions: keywords as whole words in the lines of documents."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidara.functions.text import slug_keywords
from evidara.session import durable

#: Characters of keywords looked for in one pass; the driver and each task hold no more of them.
KEYWORD_CHARS = 4 << 20
#: A task sends on its finds when they have so many characters.
BATCH_CHARS = 16 << 20
#: Lines that are shown of a document's hits.
SHOWN = 3
# fixed values: words that are no keywords
STOP_WORDS = (
    "a", "an", "the", "and", "or", "of", "for", "in", "to", "is", "are", "was", "were", "that", "this", "it", "at", "by", "on",
    "with", "as", "from", "what", "how", "which", "who", "be", "been", "have", "has",
)

_WORD = re.compile(r"\w+")


def topic_keywords(slug: Column, body: Column, chars: int = 600) -> Column:
    """Keywords of a topic: the words of its slug, and the words in bold among the first characters of its text."""
    bold = F.regexp_extract_all(F.left(F.coalesce(body, F.lit("")), F.lit(chars)), F.lit(r"\*\*([^*]+)\*\*"), F.lit(1))
    words = F.filter(F.flatten(F.transform(bold, lambda b: F.split(F.trim(F.lower(b)), r"\s+"))), lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS))
    return F.array_distinct(F.concat(slug_keywords(slug, STOP_WORDS), words))


class Matcher:
    """Finds keywords in a line where a word begins and ends with them.

    Keywords that are one word are looked up among the line's words; others are filed under their first word and compared
    where it stands. A line is read once however many keywords there are. A keyword without a letter, digit or low
    line is never found.
    """

    def __init__(self, keywords: list[str]):
        self.plain = {k for k in keywords if _WORD.fullmatch(k)}
        self.by_word: dict[str, list[tuple[str, int]]] = defaultdict(list)
        for keyword in keywords:
            if keyword not in self.plain and (word := _WORD.search(keyword)):
                self.by_word[word[0]].append((keyword, word.start()))

    def found(self, line: str) -> set[str]:
        lower = line.lower()
        words = set(_WORD.findall(lower))
        out = words & self.plain
        if not self.by_word.keys().isdisjoint(words):
            for word in _WORD.finditer(lower):
                for keyword, lead in self.by_word.get(word[0], ()):
                    start = word.start() - lead
                    if start >= 0 and lower.startswith(keyword, start) and _edge(lower, start) and _edge(lower, start + len(keyword)):
                        out.add(keyword)
        return out


def _edge(text: str, at: int) -> bool:
    """Whether a word begins or ends at a place."""
    inside = lambda i: 0 <= i < len(text) and bool(_WORD.match(text[i]))
    return inside(at - 1) != inside(at)


def _passes(known: DataFrame, by: str, chars: int) -> Iterator[list]:
    """The (tag, keyword) rows, those of one value of ``by`` together, in as many lists as the keywords have ``chars``."""
    n = max(1, -(-(known.agg(F.sum(F.length("keyword"))).first()[0] or 0) // chars))
    for i in range(n):
        yield known.where(F.pmod(F.xxhash64(by), F.lit(n)) == i).collect()


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(text_col, F.lit("")).alias("text"))


def keyword_shares(docs: DataFrame, keywords: DataFrame, id_col: str = "doc_id", text_col: str = "text", keyword_chars: int = KEYWORD_CHARS) -> DataFrame:
    """(keyword, share): of all documents, the share that holds each ``keyword`` that any holds.

    Documents are read once for every ``keyword_chars`` of keywords, whole, in Arrow batches.
    """
    spark = docs.sparkSession
    source, total = _texts(docs, id_col, text_col), max(docs.count(), 1)
    out = spark.createDataFrame([], "keyword string, docs long")
    for rows in _passes(keywords.select(F.lower("keyword").alias("keyword")).distinct(), "keyword", keyword_chars):
        part = spark.sparkContext.broadcast([r["keyword"] for r in rows])

        def count(batches: Iterator[pd.DataFrame], part=part) -> Iterator[pd.DataFrame]:
            matcher, docs_with = Matcher(part.value), Counter()
            for batch in batches:
                for text in batch["text"]:
                    docs_with.update(set().union(*map(matcher.found, text.splitlines())))
            if docs_with:
                yield pd.DataFrame({"keyword": list(docs_with), "docs": list(docs_with.values())})

        out = out.unionByName(source.mapInPandas(count, out.schema).groupBy("keyword").agg(F.sum("docs").alias("docs")))
    return out.select("keyword", (F.col("docs") / total).alias("share"))


def suggest_tags(docs: DataFrame, tags: DataFrame, tagged: DataFrame | None = None, threshold: int = 1, max_share: float = 0.4, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, keyword_chars: int = KEYWORD_CHARS) -> DataFrame:
    """(tag, doc, hits, first, shown, more): documents with at least ``threshold`` lines that hold a keyword of the tag.

    ``tags`` are (tag, keyword). Keywords that more than ``max_share`` of the documents hold tell nothing and are dropped;
    for that the documents are read once before. Documents that ``tagged`` (tag, doc) lists are left out. A line counts once for a
    tag, whichever of its keywords it holds; ``first`` numbers the first SHOWN lines and ``shown`` has their texts
    (none unless ``with_text``), the others are counted. A document's lines
    are counted where it lies, so nothing but suggestions is shuffled. Null texts have no lines; rows that repeat an id count each.
    """
    spark = docs.sparkSession
    known = durable(tags.select("tag", F.lower("keyword").alias("keyword")).where("keyword <> ''").distinct())
    dull = keyword_shares(docs, known, id_col, text_col, keyword_chars).where(F.col("share") > max_share).select("keyword")
    telling, source, kind = durable(known.join(dull, "keyword", "left_anti")), _texts(docs, id_col, text_col), tags.schema["tag"].dataType.simpleString()
    schema = f"tag {kind}, doc long, hits int, first array<int>, shown array<string>"
    out = spark.createDataFrame([], schema)
    for rows in _passes(telling, "tag", keyword_chars):
        by_keyword = defaultdict(list)
        for row in rows:
            by_keyword[row["keyword"]].append(row["tag"])
        part = spark.sparkContext.broadcast(dict(by_keyword))

        def rows_of(found: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(found, columns=["tag", "doc", "hits", "first", "shown"]).astype({"doc": "Int64"})

        def search(batches: Iterator[pd.DataFrame], part=part) -> Iterator[pd.DataFrame]:
            tags_of = part.value
            matcher = Matcher(list(tags_of))
            for batch in batches:
                found, size = [], 0
                for doc, text in zip(batch["doc"], batch["text"]):
                    hits, first, shown = Counter(), defaultdict(list), defaultdict(list)
                    for number, line in enumerate(text.splitlines(), 1):
                        for tag in {t for keyword in matcher.found(line) for t in tags_of[keyword]}:
                            hits[tag] += 1
                            if hits[tag] <= SHOWN:
                                first[tag].append(number)
                                if with_text:
                                    shown[tag].append(line.strip())
                                    size += len(line)
                    found += [(tag, None if pd.isna(doc) else int(doc), n, first[tag], shown[tag]) for tag, n in hits.items() if n >= threshold]
                    if size + 64 * len(found) > BATCH_CHARS:
                        yield rows_of(found)
                        found, size = [], 0
                if found:
                    yield rows_of(found)

        out = out.unionByName(source.mapInPandas(search, schema))
    if tagged is not None:
        out = out.join(tagged.select("tag", "doc").distinct(), ["tag", "doc"], "left_anti")
    return out.select("tag", "doc", "hits", "first", "shown", F.greatest(F.col("hits") - SHOWN, F.lit(0)).alias("more"))
