"""Packing token sequences by cutting-stock column generation."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidara.llm.common import giving_back, global_prefix, in_slices, whole

LENGTH = 2048
#: Lengths are rounded up to this many tokens for the patterns, which bounds the linear program whatever the input.
UNIT = 8
#: Columns that are generated at most; stopping early costs padding, never rows.
COLUMNS = 4000

_encoders: dict[str, object] = {}


def text_encoder(vocabulary: str):
    """text -> its ids as little-endian 32-bit words, set up once in each Python worker.

    The vocabulary is a rank file; its ids are those of the tokenizer file of the same name.
    """
    if vocabulary not in _encoders:
        import base64

        import public_tokenizers
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        encode = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_to_numpy
        _encoders[vocabulary] = lambda text: encode(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
    return _encoders[vocabulary]


def added_tokens(tokenizer_file: str) -> dict[str, int]:
    """The added tokens of a tokenizer file, which it finds in a text before anything else, and their ids."""
    with open(tokenizer_file, encoding="utf-8") as file:
        return {token["content"]: token["id"] for token in json.load(file)["added_tokens"]}


def with_added(encode, added: dict[str, int]):
    """encode, but with the literals of added tokens taken out first and their ids put in their place."""
    if not added:
        return encode
    split = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")").split
    ids = {token: np.array([number], dtype="<u4").tobytes() for token, number in added.items()}

    def encode_text(text: str) -> bytes:
        if not any(token in text for token in added):
            return encode(text)
        return b"".join(ids[part] if i % 2 else encode(part) for i, part in enumerate(split(text)) if part)

    return encode_text


def pieces(docs: DataFrame, vocabulary: str, end_id: int = 1, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", added: dict[str, int] | None = None) -> DataFrame:
    """Each document's ids and one end id, cut into pieces of ``length`` and a rest: (doc_id, start, length, ids_crc32, doc_tokens).

    Literals of ``added`` tokens get their ids; without these they are encoded as plain text.
    """

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = with_added(text_encoder(vocabulary), added or {})
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in in_slices(batches):
            rows = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids = encode(text) + end
                total = len(ids) // 4
                rows += [(doc_id, at, min(length, total - at), zlib.crc32(ids[4 * at : 4 * (at + length)]), total) for at in range(0, total, length)]
            yield pa.RecordBatch.from_arrays([pa.array(column, pa.int64()) for column in zip(*rows, strict=True)], names=names)

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text"))
    return slim.mapInArrow(lambda batches: giving_back(cut(batches)), ", ".join(f"{name} long" for name in names))


def best_pattern(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable way to fill the capacity with items of these sizes, by knapsack dynamic programming."""
    worth = np.zeros(capacity + 1)
    taken = np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        fits = sizes <= room
        options = np.where(fits, values + worth[np.maximum(room - sizes, 0)], -1.0)
        item = int(options.argmax())
        worth[room], taken[room] = (options[item], item) if options[item] > worth[room - 1] else (worth[room - 1], -1)
    pattern, room = np.zeros(len(sizes), dtype=np.int64), capacity
    while room > 0:
        if taken[room] < 0:
            room -= 1
        else:
            pattern[taken[room]] += 1
            room -= sizes[taken[room]]
    return worth[capacity], pattern


def cutting_patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int, max_columns: int = COLUMNS) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often to use each, so that every demanded item has a place.

    Solves the linear relaxation by the revised simplex method with columns priced by knapsack, uses each pattern as
    often as the rounded-down solution says, and packs what is left (fewer sequences than there are sizes) largest
    first. All of it depends on the histogram alone.
    """
    if not len(sizes):
        return []
    basis = np.diag(capacity // sizes).astype(float)
    inverse = np.diag(1.0 / (capacity // sizes))
    used = demand / (capacity // sizes)
    for _ in range(max_columns):
        prices = inverse.sum(axis=0)
        worth, column = best_pattern(np.maximum(prices, 0), sizes, capacity)
        if worth <= 1 + 1e-7:
            break
        direction = inverse @ column
        with np.errstate(divide="ignore", invalid="ignore"):
            steps = np.where(direction > 1e-9, used / direction, np.inf)
        out = int(steps.argmin())
        used = np.maximum(used - steps[out] * direction, 0)
        used[out] = steps[out]
        basis[:, out] = column
        pivot = inverse[out] / direction[out]
        inverse -= np.outer(direction, pivot)
        inverse[out] = pivot
    chosen, left = [], demand.astype(np.int64).copy()
    for pattern, times in sorted(((basis[:, i].round().astype(np.int64), int(used[i] + 1e-6)) for i in range(len(sizes))), key=lambda x: -x[1]):
        if times:
            chosen.append((pattern, times))
            left -= pattern * times
    left = np.maximum(left, 0)
    while left.any():
        pattern, room = np.zeros_like(left), capacity
        for i in np.argsort(-sizes, kind="stable"):
            n = min(left[i], room // sizes[i])
            pattern[i] = n
            room -= n * sizes[i]
        times = max(1, int(min(left[i] // pattern[i] for i in np.flatnonzero(pattern))))
        chosen.append((pattern, times))
        left -= pattern * times
    return chosen


def _places(chosen: list[tuple[np.ndarray, int]], sizes: np.ndarray, demand: np.ndarray) -> tuple[dict[int, tuple], int]:
    """For each size: where its ranks begin in each pattern, the places there, the first sequence; and all sequences.

    Patterns may hold more places than pieces; copies without any piece get no number.
    """
    left, first, found = demand.copy(), 0, {int(s): ([], [], []) for s in sizes}
    for pattern, times in chosen:
        filled = np.minimum(left, pattern * times)
        copies = int(np.max(-(-filled // np.maximum(pattern, 1))))
        for i in np.flatnonzero(filled):
            begins, places, sequences = found[int(sizes[i])]
            begins.append(int(demand[i] - left[i]))
            places.append(int(pattern[i]))
            sequences.append(first)
        left -= filled
        first += copies
    assert not left.any()
    return {k: tuple(map(np.array, v)) for k, v in found.items()}, first


def pack(docs: DataFrame, vocabulary: str, end_id: int = 1, length: int = LENGTH, unit: int = UNIT, id_col: str = "doc_id", text_col: str = "text", added: dict[str, int] | None = None) -> DataFrame:
    """Pack all ids of all documents into sequences of at most ``length``, one row for each piece.

    Documents are cut into full pieces and a rest. A histogram of the lengths in steps of ``unit`` (at most length /
    unit bins) comes to the driver, where column generation finds the patterns. Pieces of one bin are ranked by (doc_id,
    start) with one range sort of slim rows, and the rank alone says which place of which pattern copy a piece takes;
    offsets follow from a window over each sequence.

    A null text is empty and gives its end id only. Repeated rows are packed each; null ids come first; extra columns
    are left out; an empty table gives no rows. Literals of ``added`` tokens are encoded as these.
    """
    cut = pieces(docs, vocabulary, end_id, length, id_col, text_col, added).withColumn("units", F.ceil(F.col("length") / unit).cast("long"))
    placed, _, _ = global_prefix(cut, [F.col("units").desc(), F.col("doc_id").asc_nulls_first(), F.col("start"), F.col("ids_crc32")], "length")
    counts = {int(r["units"]): int(r["n"]) for r in placed.groupBy("units").agg(F.count("*").alias("n")).collect()}  # at most length / unit rows
    sizes = np.array(sorted(counts, reverse=True), dtype=np.int64)
    demand = np.array([counts[int(s)] for s in sizes], dtype=np.int64)
    capacity = length // unit
    alone = sizes == capacity
    chosen = [(np.where(sizes == s, 1, 0), int(n)) for s, n in zip(sizes[alone], demand[alone], strict=True)]
    rest = ~alone
    for pattern, times in cutting_patterns(sizes[rest], demand[rest], capacity):
        full = np.zeros(len(sizes), dtype=np.int64)
        full[rest] = pattern
        chosen.append((full, times))
    places, _ = _places(chosen, sizes, demand)
    first_rank = dict(zip(map(int, sizes), map(int, np.r_[0, np.cumsum(demand)[:-1]]), strict=True)) if len(sizes) else {}

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sequence = np.zeros(len(batch), dtype=np.int64)
            units = batch["units"].to_numpy()
            for size in np.unique(units):
                own = units == size
                rank = batch["position"].to_numpy()[own] - first_rank[int(size)]
                begins, each, firsts = places[int(size)]
                at = np.searchsorted(begins, rank, side="right") - 1
                sequence[own] = firsts[at] + (rank - begins[at]) // each[at]
            batch["sequence_id"] = sequence
            yield batch.drop(columns=["before"])

    columns = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, units long, position long"
    assigned = placed.select(*[c.split()[0] for c in columns.split(", ")], "before").mapInPandas(
        lambda batches: giving_back(assign(b.astype({"doc_id": "Int64"}) for b in batches)), columns + ", sequence_id long"
    )
    ahead = Window.partitionBy("sequence_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(ahead), F.lit(0))
    return assigned.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", offset.alias("offset"))
