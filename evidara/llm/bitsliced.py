"""Ranked lexical search over a bit-sliced impact index."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidara.llm.common import LOWER, UPPER, whole
from evidara.session import durable

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The same on UTF-8 bytes: ASCII letters and digits and all bytes above ASCII belong to a term, A-Z become small, the rest is space.
_TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))
#: Documents in a block of the index, a multiple of 64; a bitmap of a block has an eighth as many bytes.
BLOCK_DOCS = 16384
#: Bytes of query text searched in one pass; the driver and each task hold no more of the queries.
QUERY_BYTES = 8 << 20
#: Terms of a block whose slices a task keeps expanded.
EXPANDED_TERMS = 512

POSTINGS = "doc_id long, n long, codes array<int>, counts array<int>"
INDEX = "block long, term string, columns binary, slices binary"


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TERM), F.lit(0))


def postings(docs: DataFrame, vocabulary: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's number of terms, and which terms of the vocabulary (by their places in it) it holds how often. Checkpointed."""
    wanted = docs.sparkSession.sparkContext.broadcast({term.encode(): i for i, term in enumerate(vocabulary)})
    source = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).cast("binary").alias("text"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = wanted.value
        for batch in batches:
            sizes, codes, counts = [], [], []
            for text in batch["text"]:
                words = bytes(text).translate(_TERM_BYTES).split()
                held = Counter(filter(code.__contains__, words))
                sizes.append(len(words))
                codes.append([code[w] for w in held])
                counts.append(list(held.values()))
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "n": sizes, "codes": codes, "counts": counts})

    return durable(source.mapInPandas(read, POSTINGS))


def corpus_totals(posted: DataFrame) -> tuple[int, int]:
    """N, the documents with a term, and L, all their terms."""
    n, length = posted.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    return n, length or 0


def term_weights(posted: DataFrame, n_docs: int, n_terms: int) -> np.ndarray:
    """floor(1000 ln((2N+2) / (2df+1))) of each term of the vocabulary; 0 where no document holds it."""
    found = posted.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("df")).collect()  # at most a row for each term asked
    weights = np.zeros(n_terms, np.int64)
    for code, df in found:
        weights[code] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    return weights


def slice_impacts(places: np.ndarray, impacts: np.ndarray) -> tuple[bytes, bytes]:
    """One term's impacts as bitmaps: (columns, slices), where bit d of slices[s, c] is bit s of the impact of document 64 * columns[c] + d.

    Columns, groups of 64 documents, without the term are left out, so a rare term takes little room.
    """
    columns, at = np.unique(places >> 6, return_inverse=True)
    depth = int(impacts.max()).bit_length()
    bits = np.zeros((depth, len(columns) * 64), np.uint8)
    bits[:, at * 64 + (places & 63)] = (impacts >> np.arange(depth)[:, None]) & 1
    return columns.astype(np.int32).tobytes(), np.packbits(bits, axis=1, bitorder="little").tobytes()


def expand(columns: bytes, slices: bytes, block_docs: int) -> list[int]:
    """The slices of a term as integers of ``block_docs`` bits, least significant slice first."""
    at = np.frombuffer(columns, np.int32)
    compact = np.frombuffer(slices, np.uint64).reshape(-1, len(at))
    full = np.zeros((len(compact), block_docs // 64), np.uint64)
    full[:, at] = compact
    return [int.from_bytes(row.tobytes(), "little") for row in full]


def build_index(posted: DataFrame, vocabulary: list[str], weights: np.ndarray, n_docs: int, length: int, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """The index: a row for each block of documents and term with its bit slices, and a row without term for the block's ids. Checkpointed.

    Documents are sorted by id within their partition and numbered as they stream by, ``block_docs`` to a block, so
    building moves no postings; rows without an id come last. A term's impact is its weight times its saturated
    frequency; documents where it isn't above 0 are left out.
    """
    told = posted.sparkSession.sparkContext.broadcast((vocabulary, weights))

    def block_rows(block: int, ids: list, sizes: list, codes: list, counts: list) -> Iterator[pd.DataFrame]:
        names, weigh = told.value
        known = np.array([i for i in ids if i is not None], np.int64)
        rows = [(block, None, known.tobytes(), b"")]
        held = np.array([len(c) for c in codes])
        code, tf = np.concatenate([*codes, []]).astype(np.int64), np.concatenate([*counts, []]).astype(np.int64)
        m = 25 + (75 * np.array(sizes, np.int64) * n_docs) // max(length, 1)
        place = np.repeat(np.arange(len(ids)), held)
        impact = weigh[code] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[place]))
        order = np.argsort(code, kind="stable")
        order = order[impact[order] > 0]
        cuts = np.flatnonzero(np.diff(code[order])) + 1
        for run in np.split(order, cuts) if len(order) else []:
            rows.append((block, names[code[run[0]]], *slice_impacts(place[run], impact[run])))
            if len(rows) >= 256:
                yield pd.DataFrame(rows, columns=["block", "term", "columns", "slices"])
                rows = []
        yield pd.DataFrame(rows, columns=["block", "term", "columns", "slices"])

    def slice_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        block, held = TaskContext.get().partitionId() << 32, []
        for batch in batches:
            for row in zip(batch["id"], batch["n"], batch["codes"], batch["counts"]):
                held.append(row)
                if len(held) == block_docs:
                    yield from block_rows(block, *map(list, zip(*held)))
                    block, held = block + 1, []
        if held:
            yield from block_rows(block, *map(list, zip(*held)))

    # as text, since pandas has no whole numbers beside missing ones in a list
    ordered = posted.sortWithinPartitions(F.col("doc_id").asc_nulls_last()).select(F.col("doc_id").cast("string").alias("id"), "n", "codes", "counts")
    return durable(ordered.mapInPandas(slice_up, INDEX))


def add_slices(total: list[int], slices: list[int]) -> None:
    """Add a term's impacts to the running sums of all documents of a block at once: a full adder on each slice, its carry going to the next."""
    carry = 0
    total.extend([0] * (len(slices) - len(total)))
    for s, new in enumerate(slices):
        old = total[s]
        half = old ^ new
        total[s] = half ^ carry
        carry = (old & new) | (half & carry)
    s = len(slices)
    while carry:
        if s == len(total):
            total.append(0)
        total[s], carry = total[s] ^ carry, total[s] & carry
        s += 1


def _places(bits: int, block_docs: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(bits.to_bytes(block_docs // 8, "little"), np.uint8), bitorder="little"))


def top_places(total: list[int], k: int, block_docs: int) -> np.ndarray:
    """Places of the k largest sums above 0, equal ones by ascending place, found from the most significant slice down.

    ``sure`` are among the k for certain, ``still`` agree with the k-th sum in all slices read so far.
    """
    still, sure = 0, 0
    for bits in total:
        still |= bits
    if still.bit_count() > k:
        for bits in reversed(total):
            ones = still & bits
            if sure.bit_count() + ones.bit_count() >= k:
                still = ones
            else:
                sure, still = sure | ones, still & ~bits
    return np.concatenate([_places(sure, block_docs), _places(still, block_docs)[: k - sure.bit_count()]])


def search_index(index: DataFrame, queries: list[tuple[int, list[str]]], k: int = 10, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """(query, doc_id, score): of each block its k best documents for each query, a number and its terms with repeats."""
    asked = index.sparkSession.sparkContext.broadcast([(number, Counter(terms)) for number, terms in queries])

    def search(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        named = rows["term"].notna()
        ids = np.frombuffer(rows.loc[~named, "columns"].iloc[0], np.int64)
        held = {term: (columns, slices) for term, columns, slices in zip(rows.loc[named, "term"], rows.loc[named, "columns"], rows.loc[named, "slices"])}
        slices_of = lru_cache(EXPANDED_TERMS)(lambda term: expand(*held[term], block_docs))
        found = []
        for number, terms in asked.value:
            total: list[int] = []
            for term, times in terms.items():
                if term in held:
                    for _ in range(times):
                        add_slices(total, slices_of(term))
            for place in top_places(total, k, block_docs):
                score = sum((bits >> int(place) & 1) << s for s, bits in enumerate(total))
                found.append((number, int(ids[place]) if place < len(ids) else None, score))
        return pd.DataFrame(found, columns=["query", "doc_id", "score"]).astype({"query": "int64", "doc_id": "Int64", "score": "int64"})

    return index.groupBy("block").applyInPandas(search, T.StructType.fromDDL("query long, doc_id long, score long"))


def rank_documents(docs: DataFrame, queries: DataFrame, k: int = 10, query_id: str = "item_id", query_text: str = "text", id_col: str = "doc_id", text_col: str = "text", block_docs: int = BLOCK_DOCS, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """For each query its k documents of highest score above 0: (item_id, rank, doc_id, score); equal scores by ascending id.

    Every document is indexed, under the terms that some query asks for. Blocks of documents are searched side by side;
    each gives k candidates a query, and the best k of these are kept. A block holds at most ``block_docs``
    documents, and k rows leave it however many tie, so a large group of copies is no heavier than other rows.

    Queries are searched in as many passes as their texts have ``query_bytes``, each over all documents. Null and
    empty texts have no terms; a query of none, or only of terms that no document holds, gives no rows; rows without
    an id rank last among ties; repeated rows, of documents or queries, count each; extra columns are left out.
    """
    spark = docs.sparkSession
    worded = durable(queries.select(F.monotonically_increasing_id().alias("query"), F.col(query_id).alias("item_id"), terms_of(whole(query_text)).alias("terms"), F.octet_length(whole(query_text)).alias("bytes")))
    passes = max(1, -(-(worded.agg(F.sum("bytes")).first()[0] or 0) // query_bytes))
    found = spark.createDataFrame([], "query long, doc_id long, score long")
    for i in range(passes):
        batch = [(r["query"], r["terms"]) for r in worded.where(F.pmod(F.xxhash64("query"), F.lit(passes)) == i).select("query", "terms").collect()]
        vocabulary = sorted({term for _, terms in batch for term in terms})
        posted = postings(docs, vocabulary, id_col, text_col)
        n_docs, length = corpus_totals(posted)
        index = build_index(posted, vocabulary, term_weights(posted, n_docs, len(vocabulary)), n_docs, length, block_docs)
        found = found.unionByName(search_index(index, batch, k, block_docs))
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.join(worded.select("query", "item_id"), "query").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
