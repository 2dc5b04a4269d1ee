"""SimHash near duplicates, found by a binary trie joined with itself."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidara.llm.common import LOWER, UPPER, giving_back, in_slices, whole
from evidara.llm.components import connected_components
from evidara.llm.exact_dedup import keep_rows
from evidara.llm.fingerprint import shingle_hashes
from evidara.session import durable, shuffle_partitions

BITS = 64
SEED = 42
#: Node pairs that one step of the traversal holds at most; more are worked off piece by piece.
FRONTIER = 1 << 20


def _majorities(texts: pd.Series | list[str], shingle_words: int, words: int, distinct: bool = False) -> np.ndarray:
    """For each text ``words`` 64-bit majorities over its shingles' hashes; zeros without words.

    The first takes the hashes as they are, further ones take them mixed anew, so that all bits are independent.
    Repeated shingles count each, or once if ``distinct``, so that the bits follow the similarity of sets.
    """
    import re

    import xxhash

    lower = bytes.maketrans(UPPER.encode(), LOWER.encode())  # in UTF-8 no other character has these bytes
    words_of = re.compile(rb"[^\x20\x09-\x0D]+").findall
    digest = xxhash.xxh64_intdigest
    out = np.zeros((len(texts), words), dtype=np.uint64)
    for at, text in enumerate(texts):
        found = words_of(text.encode("utf-8").translate(lower))
        if not found:
            continue
        count = max(1, len(found) - shingle_words + 1)
        shingles = map(b" ".join, zip(*(found[i:] for i in range(shingle_words)), strict=False)) if len(found) >= shingle_words else [b" ".join(found)]
        ones = np.zeros(words * BITS, dtype=np.int64)
        hashes = np.fromiter((digest(x, SEED) for x in shingles), dtype=np.uint64, count=count)
        if distinct:
            hashes = np.unique(hashes)
            count = len(hashes)
        for start in range(0, count, 255):  # so many ones fit in a byte
            part = hashes[start : start + 255]
            wide = np.stack([_mixed(part, i) if i else part for i in range(words)], axis=1).astype(">u8")
            ones += np.unpackbits(wide.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
        out[at] = np.packbits(2 * ones > count).view(">u8")
    return out


def _mixed(values: np.ndarray, number: int) -> np.ndarray:
    """Well-mixed 64-bit values, another set for each number."""
    x = values + np.uint64((number * 0x9E3779B97F4A7C15) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(docs: DataFrame, shingle_words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): each text's 64 majority bits, as a signed long."""

    @F.pandas_udf(T.LongType())
    def fingerprint(texts: pd.Series) -> pd.Series:
        return pd.Series(_majorities(texts, shingle_words, 1)[:, 0].view(np.int64))

    return docs.select(F.col(id_col).alias("doc_id"), fingerprint(whole(text_col)).alias("fp"))


def _orders(width: int, agreeing: int, blocks: int) -> list[list[int]]:
    """For each choice of agreeing blocks, the bits (0 is the highest) in the order in which that trie reads them."""
    step = width // blocks
    cut = [list(range(i * step, (i + 1) * step if i + 1 < blocks else width)) for i in range(blocks)]
    return [[b for i in chosen for b in cut[i]] + [b for i in range(blocks) if i not in chosen for b in cut[i]] for chosen in combinations(range(blocks), agreeing)]


def _reorder(values: np.ndarray, order: list[int]) -> np.ndarray:
    """Each value with its bits in the given order, by runs of neighbouring bits."""
    out, at = np.zeros_like(values), 0
    while at < len(order):
        end = at + 1
        while end < len(order) and order[end] == order[end - 1] + 1:
            end += 1
        run = end - at
        piece = (values >> np.uint64(BITS - order[end - 1] - 1)) & np.uint64((1 << run) - 1)
        out |= piece << np.uint64(BITS - end)
        at = end
    return out


def _products(al: np.ndarray, ah: np.ndarray, bl: np.ndarray, bh: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of positions of each pair of runs, some at a time; of a run with itself each pair once."""
    sizes = (ah - al) * (bh - bl)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // FRONTIER, prepend=-1))
    for start, stop in zip(cuts, [*cuts[1:], len(sizes)], strict=True):
        for lo, hi, blo, bhi in ([(al[start:stop], ah[start:stop], bl[start:stop], bh[start:stop])] if stop - start > 1 or sizes[start] <= 4 * FRONTIER else (
            (np.array([i]), np.array([min(i + 64, ah[start])]), bl[start:stop], bh[start:stop]) for i in range(al[start], ah[start], 64)
        )):
            n = (hi - lo) * (bhi - blo)
            pair = np.repeat(np.arange(len(n)), n)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            width = (bhi - blo)[pair]
            a, b = lo[pair] + at // width, blo[pair] + at % width
            once = (a < b) | (lo[pair] >= bhi[pair]) | (hi[pair] <= blo[pair])
            yield a[once], b[once]


def _unlike(a: np.ndarray, b: np.ndarray, colours: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of a position of a and one of b of unlike colours, some at a time; where both are the same run, each pair once."""
    same_run = a[0] == b[0]
    each, n = np.unique(colours[a], return_counts=True)
    large = each[n >= 64]
    for colour in large:  # a large colour never meets itself
        yield from _meshed(a[colours[a] == colour], b[colours[b] != colour], None, same_run)
    yield from _meshed(a[~np.isin(colours[a], large)], b, colours, same_run)


def _meshed(a: np.ndarray, b: np.ndarray, colours: np.ndarray | None, same_run: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    step = max(1, FRONTIER // max(len(b), 1))
    for start in range(0, len(a) if len(b) else 0, step):
        part = a[start : start + step]
        one, other = np.repeat(part, len(b)), np.tile(b, len(part))
        keep = one < other if same_run else np.ones(len(one), bool)
        if colours is not None:
            keep &= colours[one] != colours[other]
        yield one[keep], other[keep]


def trie_links(keys: np.ndarray, depth: int, budget: int, width: int = BITS, spanning: bool = True, colours: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions of sorted keys that agree in their first ``depth`` bits and differ in at most ``budget`` others.

    Keys are ``width`` bits, from the highest down. A trie node is a run of the sorted keys. Pairs of nodes are
    traversed together from the subtrees at ``depth``: a pair splits into the pairs of its children, a pair of unlike
    children spends one unit of the budget, and pairs over budget are pruned. A pair whose remaining bits cannot exceed
    the budget is taken whole. With ``spanning`` each key of one node is then linked to the first of the other only,
    which keeps them connected; otherwise all their pairs come. Keys of equal ``colours``, sorted within equal keys, are
    connected already: their pairs are left out, and pairs of nodes that hold one colour alone are pruned, so a large
    group of one colour costs no more than its nodes.
    """
    n = len(keys)
    if colours is not None:
        changes = np.r_[np.flatnonzero(colours[1:] != colours[:-1]) + 1, n]
        change = changes[np.searchsorted(changes, np.arange(n), side="right")]
    top = keys >> np.uint64(BITS - depth) if depth else np.zeros(n, np.uint64)
    starts = np.flatnonzero(np.r_[True, top[1:] != top[:-1]])
    ends = np.r_[starts[1:], n]
    many = ends - starts > 1
    work = [(depth, starts[many], ends[many], starts[many], ends[many], np.zeros(many.sum(), np.int8))]
    ones_before: dict[int, np.ndarray] = {}
    while work:
        level, al, ah, bl, bh, spent = work.pop()
        if colours is not None:
            plain = (colours[al] == colours[bl]) & (change[al] >= ah) & (change[bl] >= bh)
            al, ah, bl, bh, spent = (x[~plain] for x in (al, ah, bl, bh, spent))
        if not len(al):
            continue
        if len(al) > FRONTIER:
            half = len(al) // 2
            work += [(level, al[:half], ah[:half], bl[:half], bh[:half], spent[:half]), (level, al[half:], ah[half:], bl[half:], bh[half:], spent[half:])]
            continue
        near = spent + (width - level) <= budget
        if near.any():
            if spanning:
                yield from _products(al[near], ah[near], bl[near], bl[near] + 1)
                yield from _products(al[near], al[near] + 1, bl[near], bh[near])
            elif colours is None:
                yield from _products(al[near], ah[near], bl[near], bh[near])
            else:
                crowded = near & ((ah - al) * (bh - bl) > 4096)
                for i in np.flatnonzero(crowded):
                    yield from _unlike(np.arange(al[i], ah[i]), np.arange(bl[i], bh[i]), colours)
                few = near & ~crowded
                if few.any():
                    for a, b in _products(al[few], ah[few], bl[few], bh[few]):
                        unlike = colours[a] != colours[b]
                        yield a[unlike], b[unlike]
            al, ah, bl, bh, spent = (x[~near] for x in (al, ah, bl, bh, spent))
        single = (ah - al == 1) & (bh - bl == 1) & (al != bl)
        if single.any():
            rest = (keys[al[single]] ^ keys[bl[single]]) & np.uint64((1 << (BITS - level)) - 1)
            close = np.bitwise_count(rest) + spent[single] <= budget
            yield al[single][close], bl[single][close]
        go = ~single
        al, ah, bl, bh, spent = (x[go] for x in (al, ah, bl, bh, spent))
        if not len(al):
            continue
        if level not in ones_before:
            ones_before[level] = np.r_[0, np.cumsum((keys >> np.uint64(BITS - 1 - level)) & np.uint64(1), dtype=np.int64)]
        ones = ones_before[level]
        am, bm = ah - (ones[ah] - ones[al]), bh - (ones[bh] - ones[bl])  # where the children with a set bit begin
        same = al == bl
        children = [
            (al, am, bl, bm, spent, np.ones_like(same)),
            (am, ah, bm, bh, spent, np.ones_like(same)),
            (al, am, bm, bh, spent + 1, np.ones_like(same)),
            (am, ah, bl, bm, spent + 1, ~same),
        ]
        parts = []
        for cal, cah, cbl, cbh, cost, wanted in children:
            keep = wanted & (cah > cal) & (cbh > cbl) & (cost <= budget) & ~((cal == cbl) & (cah - cal == 1))
            parts.append([x[keep] for x in (cal, cah, cbl, cbh, cost)])
        work.append((level + 1, *(np.concatenate(x) for x in zip(*parts, strict=True))))


def _join(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """root (each position's least connected one so far) with the pairs added."""
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root


def _by_subtree(batches: Iterator[pd.DataFrame], linked) -> Iterator[pd.DataFrame]:
    """linked() of whole subtrees, where batches of rows sorted by (trie, head) may end within one."""
    rest: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        last = batch.iloc[-1]
        tail = ((batch["trie"] == last["trie"]) & (batch["head"] == last["head"])).to_numpy()
        if rest:
            first = rest[0].iloc[0]
            if tail.all() and first["trie"] == last["trie"] and first["head"] == last["head"]:
                rest.append(batch)
                continue
        ready = pd.concat([*rest, batch[~tail]], ignore_index=True)
        if len(ready):
            yield from linked(ready)
        rest = [batch[tail]]
    if rest:
        yield from linked(pd.concat(rest, ignore_index=True))


def fingerprint_links(different: DataFrame, budget: int = 2, group_limit: int = 1 << 14) -> DataFrame:
    """Edges (a, b) that connect exactly the fingerprints connected by steps of at most ``budget`` differing bits.

    Two fingerprints within the budget of 2 agree in at least two of four 16-bit blocks. Each of the six choices of two
    blocks gives a trie that reads these blocks first, so every link lies below one node of depth 32 in one of the
    tries, and these subtrees are what is dealt out. A subtree with more than group_limit fingerprints is dealt out once
    more by two of four blocks of its remaining 32 bits; then no more than 2**16 different ones can meet. Of the links
    within a batch only a spanning forest is sent on.
    """
    if budget + 2 > 4:
        raise ValueError("the block choices cover budgets up to 2")
    first = _orders(BITS, 2, 4)
    second = _orders(BITS // 2, 2, 4)

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = batch["fp"].to_numpy().view(np.uint64)
            for i, order in enumerate(first):
                key = _reorder(values, order)
                yield pd.DataFrame({"trie": i, "head": (key >> np.uint64(32)).astype(np.int64), "key": key.view(np.int64), "fp": batch["fp"], "depth": 32})

    schema = "trie int, head long, key long, fp long, depth int"
    dealt = durable(different.select("fp").mapInPandas(keyed, schema))
    sizes = dealt.groupBy("trie", "head").agg(F.count("*").alias("n")).where("n > 1")
    sized = dealt.join(sizes, ["trie", "head"])
    orders = [list(range(32)) + [32 + b for b in order] for order in second]

    def again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys = batch["key"].to_numpy().view(np.uint64)
            for i, order in enumerate(orders):
                key = _reorder(keys, order)
                yield pd.DataFrame({"trie": batch["trie"] * len(orders) + i + 6, "head": (key >> np.uint64(16)).astype(np.int64), "key": key.view(np.int64), "fp": batch["fp"], "depth": 48})

    small = sized.where(F.col("n") <= group_limit).drop("n")
    large = sized.where(F.col("n") > group_limit).drop("n").mapInPandas(again, schema)

    def linked(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for (_, depth), part in rows.groupby(["trie", "depth"], sort=False):
            fps = part["fp"].to_numpy()
            keys = part["key"].to_numpy().view(np.uint64)
            by_key = np.argsort(keys, kind="stable")
            fps, keys = fps[by_key], keys[by_key]
            root = np.arange(len(keys))
            for a, b in trie_links(keys, int(depth), budget):
                root = _join(root, a, b)
            own = np.flatnonzero(root != np.arange(len(keys)))
            if len(own):
                yield pd.DataFrame({"a": fps[own], "b": fps[root[own]]})

    wide = small.unionByName(large).repartition(shuffle_partitions(different.sparkSession), "trie", "head")
    return wide.sortWithinPartitions("trie", "head").mapInPandas(lambda batches: _by_subtree(batches, linked), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle_words: int = 3, budget: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row: the smallest id reachable by links of at most budget bits.

    Null texts count as empty; texts without words have fingerprint zero, which is linked like any other. Equal
    fingerprints are merged before any search, so copies cost one row each; between different fingerprints no link is
    lost. A null id is never a component's name unless all ids of the component are null. Repeated rows each get a row;
    an empty table gives none; extra columns are left out.
    """
    own = durable(fingerprints(docs, shingle_words, id_col, text_col))
    different = own.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    edges = fingerprint_links(different, budget)
    parts = connected_components(edges)
    grouped = different.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    names = grouped.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = grouped.join(names, "component").select("fp", "component_id")
    return own.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: The wider fingerprint: so many tries of 32 bits each, and so many more bits that judge what a trie finds.
TABLES, TABLE_BITS, CHECK_BITS, TABLE_BUDGET = 16, 32, 256, 3
#: Fingerprints that share a trie key are compared with the first of them beforehand if there are more of them than this.
HOT_GROUP = 1 << 10
#: Up to so many of these first ones (with their bits, 128 bytes each) are broadcast; beyond, they are joined by a shuffle.
BROADCAST_LEADERS = 1 << 18
#: Doubtful pairs take one pass without a bound; nothing reads this any more, but a test of the several passes sets it.
PASSES = (None,)
#: Pairs whose bits are compared at once.
COMPARED = 1 << 18
#: Families with more fingerprints or shingles than this are compared in blocks of about that size.
BLOCK_NODES, BLOCK_SHINGLES = 512, 1 << 20


def expected_share(similarity: float) -> float:
    """The share of differing bits of two texts whose shingle sets have this Jaccard similarity, by the angle between them."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def similar_documents(docs: DataFrame, similarity: float = 0.8, shingle_words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id) for every row, by links of at least the given similarity of shingle sets.

    At a similarity of 0.8 about 15 % of SimHash bits differ, too many for one trie. The fingerprint is therefore 768
    bits wide: 16 tries of 32 bits, each joined with itself at a budget of 3 differing bits, and 256 bits that judge a
    pair. By the binomial law a pair at 0.8 meets in one of the tries with probability 0.993 and passes the judgement
    with 0.994. A pair is sure where so few of the 256 bits differ that one in 400 pairs just below the similarity would
    do that; a pair that passes but is not sure is confirmed by the exact similarity of its shingle sets, in a join.

    In each trie a pair within the budget agrees in one of four 8-bit blocks, so each document goes to four subtrees,
    and large subtrees are dealt out once more. A batch sends on a spanning forest of its sure pairs and one of its
    doubtful pairs, at most two rows for each node, however many pairs a crowded subtree has. Fingerprints connected by
    doubtful pairs are a family, and all pairs of a family that sure pairs don't connect are confirmed exactly, in
    blocks: pairs are never rows. A family's square is in counting what its shingle sets share; of rows, a node
    comes once for each block of its family. Equal fingerprints are merged before. Where very many fingerprints share a trie key,
    those surely like the first of them are linked to it beforehand; the groups so linked are colours. All stay in
    the tries, but pairs of one colour are not met again, which loses no link and spares a hot group its square. Nulls, repeated rows, empty tables and extra columns are as in near_duplicates;
    texts without words form one group.
    """
    rows = _similar_rows(docs, similarity, shingle_words, id_col, text_col)
    names = rows.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return rows.join(names, "component").select("doc_id", "component_id")


def _tables(fps: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """The trie keys (in the upper halves of 64 bits) and the judging words of fingerprints."""
    raw = np.frombuffer(b"".join(fps), dtype=np.uint8).reshape(len(fps), -1)
    cut = TABLES * TABLE_BITS // 8
    return raw[:, :cut].copy().view(">u4").astype(np.uint64) << np.uint64(32), raw[:, cut:].copy().view(np.uint64)


def _limits(similarity: float) -> tuple[int, int]:
    """Of the judging bits, how many may differ in a pair that is looked at, and in one that is surely similar."""
    share = expected_share(similarity)
    spread = (CHECK_BITS * share * (1 - share)) ** 0.5
    return int(CHECK_BITS * share + 2.5 * spread), int(CHECK_BITS * share - 2.8 * spread)


def _forest(nodes: np.ndarray, root: np.ndarray, kind: str) -> pd.DataFrame:
    """Each node linked to the least one of its tree, which is mostly the same one in all subtrees where the tree is met."""
    least = nodes.copy()
    np.minimum.at(least, root, nodes)
    own = nodes != least[root]
    return pd.DataFrame({"a": nodes[own], "b": least[root[own]], "kind": kind})


def hot_links(different: DataFrame, similarity: float, hot_group: int | None = None) -> DataFrame:
    """(a, b): fingerprints that share a trie key with more than ``hot_group`` others and are surely like the first of these."""
    _, sure = _limits(similarity)

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                tables, _ = _tables(batch["fp"])
                for t in range(TABLES):
                    yield pd.DataFrame({"trie": t, "key": tables[:, t].view(np.int64), "node": batch["node"]})

    keyed = different.mapInPandas(lambda batches: giving_back(keys(batches)), "trie int, key long, node long")
    hot = durable(keyed.groupBy("trie", "key").agg(F.count("*").alias("n"), F.min("node").alias("b")).where(F.col("n") > (HOT_GROUP if hot_group is None else hot_group)).drop("n"))
    few = hot.count() <= BROADCAST_LEADERS
    small = lambda df: F.broadcast(df) if few else df

    @F.pandas_udf(T.BooleanType())
    def alike(one: pd.Series, other: pd.Series) -> pd.Series:
        if not len(one):
            return pd.Series([], dtype=bool)
        return pd.Series(np.bitwise_count(_tables(one)[1] ^ _tables(other)[1]).sum(axis=1) <= sure)

    members = keyed.join(small(hot), ["trie", "key"]).where("node <> b").select(F.col("node").alias("a"), "b").distinct()
    leaders = different.join(small(hot.select(F.col("b").alias("node")).distinct()), "node", "left_semi").select(F.col("node").alias("b"), F.col("fp").alias("other"))
    return members.join(different.select(F.col("node").alias("a"), F.col("fp").alias("one")), "a").join(small(leaders), "b").where(alike("one", "other")).select("a", "b")


def similar_links(coloured: DataFrame, similarity: float, compared: int | None = None, group_limit: int = 1 << 14) -> DataFrame:
    """(a, b, kind): nodes of (fp, node, colour) connected by pairs that are surely similar (``sure``), or may be (``doubtful``).

    Both kinds are spanning forests of a subtree's pairs; pairs of one colour are left out. ``compared`` pairs are worked off at once.
    """
    at_once = compared or COMPARED
    most, sure = _limits(similarity)
    first, second = _orders(TABLE_BITS, 1, 4), [list(range(8)) + [8 + b for b in order] for order in _orders(24, 1, 4)]
    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            tables, words = _tables(batch["fp"])
            check = [x.tobytes() for x in words]
            for t in range(TABLES):
                for i, order in enumerate(first):
                    key = _reorder(tables[:, t], order)
                    yield pd.DataFrame({"trie": t * len(first) + i, "head": (key >> np.uint64(56)).astype(np.int64), "key": key.view(np.int64), "node": batch["node"], "colour": batch["colour"], "check": check, "depth": 8})

    def again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys = batch["key"].to_numpy().view(np.uint64)
            for i, order in enumerate(second):
                key = _reorder(keys, order)
                yield batch[["node", "colour", "check"]].assign(trie=batch["trie"] * len(second) + i + TABLES * len(first), head=(key >> np.uint64(50)).astype(np.int64), key=key.view(np.int64), depth=14)[["trie", "head", "key", "node", "colour", "check", "depth"]]

    def linked(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for (_, depth), part in rows.groupby(["trie", "depth"], sort=False):
            keys, colour = part["key"].to_numpy().view(np.uint64), part["colour"].to_numpy()
            by_key = np.lexsort((colour, keys))
            keys, nodes, colour = keys[by_key], part["node"].to_numpy()[by_key], colour[by_key]
            check = np.frombuffer(b"".join(part["check"]), dtype=np.uint64).reshape(len(part), -1)[by_key]
            root, family = np.arange(len(keys)), np.arange(len(keys))
            for found_a, found_b in trie_links(keys, int(depth), TABLE_BUDGET, TABLE_BITS, spanning=False, colours=colour):
                for start in range(0, len(found_a), at_once):
                    a, b = found_a[start : start + at_once], found_b[start : start + at_once]
                    apart = root[a] != root[b]
                    a, b = a[apart], b[apart]
                    differing = np.bitwise_count(check[a] ^ check[b]).sum(axis=1)
                    root = _join(root, a[differing <= sure], b[differing <= sure])
                    maybe = (differing > sure) & (differing <= most) & (root[a] != root[b]) & (family[a] != family[b])
                    family = _join(family, a[maybe], b[maybe])
            yield _forest(nodes, root, "sure")
            yield _forest(nodes, family, "doubtful")

    schema = "trie int, head long, key long, node long, colour long, check binary, depth int"
    dealt = coloured.mapInPandas(lambda batches: giving_back(deal(batches)), schema)
    sizes = dealt.groupBy("trie", "head").agg(F.count("*").alias("n")).where(F.col("n") > group_limit)
    large = {(r["trie"], r["head"]) for r in sizes.select("trie", "head").collect()}  # of TABLES * 4 * 256 heads

    def parted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            split = np.fromiter(((t, h) in large for t, h in zip(batch["trie"], batch["head"], strict=True)), dtype=bool, count=len(batch)) if large else np.zeros(len(batch), dtype=bool)
            yield batch[~split]
            if split.any():
                yield from again(iter([batch[split]]))

    # dealt anew and parted in one step: two steps in a row would take two Python workers for each task, which all stay
    wide = coloured.mapInPandas(lambda batches: giving_back(parted(deal(batches))), schema).repartition(shuffle_partitions(coloured.sparkSession), "trie", "head").sortWithinPartitions("trie", "head")
    edges = wide.mapInPandas(lambda batches: giving_back(_by_subtree(batches, linked)), "a long, b long, kind string")
    return edges.where("a <> b").distinct()


def confirmed_links(members: DataFrame, similarity: float) -> DataFrame:
    """(a, b): edges that connect exactly the colours of which two nodes in one family have so similar shingle sets.

    Of (family, node, colour, shingles). A family is cut into blocks by a hash of the node, and each pair of blocks is a
    group of its own, bounded however large the family is. There an inverted list counts what each node of the one block
    shares with all nodes of the other; only a spanning forest of the colours is sent on.
    """

    def confirm(rows: pd.DataFrame) -> pd.DataFrame:
        nodes, part = rows["node"].to_numpy(), rows["own"].to_numpy()
        sets = [np.asarray(x, dtype=np.int64) for x in rows["shingles"]]
        sizes = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
        _, first, colour = np.unique(rows["colour"].to_numpy(), return_index=True, return_inverse=True)
        root = np.arange(len(first))  # over the colours
        left, right = np.flatnonzero(part == rows["one"].iloc[0]), np.flatnonzero(part == rows["two"].iloc[0])
        if not len(left) or not len(right):
            return pd.DataFrame({"a": nodes[:0], "b": nodes[:0]})
        shingles = np.concatenate([sets[j] for j in right])
        order = np.argsort(shingles, kind="stable")
        shingles, holders = shingles[order], np.repeat(np.arange(len(right)), sizes[right])[order]
        for i in left:
            if not (root[colour[right]] != root[colour[i]]).any():
                continue
            begins, ends = np.searchsorted(shingles, sets[i]), np.searchsorted(shingles, sets[i], side="right")
            common = np.zeros(len(right), dtype=np.int64)
            for lists in np.split(np.arange(len(begins)), np.flatnonzero(np.diff(np.cumsum(ends - begins) // FRONTIER)) + 1):
                n = (ends - begins)[lists]
                at = np.arange(n.sum()) + np.repeat(begins[lists] - np.cumsum(n) + n, n)
                common += np.bincount(holders[at], minlength=len(right))
            alike = right[common >= similarity * (sizes[i] + sizes[right] - common)]
            alike = alike[root[colour[alike]] != root[colour[i]]]
            root = _join(root, np.repeat(colour[i], len(alike)), colour[alike])
        own = np.flatnonzero(root != np.arange(len(root)))
        return pd.DataFrame({"a": nodes[first[own]], "b": nodes[first[root[own]]]})

    blocks = F.ceil(F.greatest(F.count("*") / BLOCK_NODES, F.sum(F.size("shingles")) / BLOCK_SHINGLES)).alias("blocks")
    families = members.groupBy("family").agg(blocks, F.min("colour").alias("low"), F.max("colour").alias("high")).where("low <> high").select("family", "blocks")
    placed = members.join(families, "family").withColumn("own", F.pmod(F.xxhash64("node", F.lit(SEED)), "blocks"))
    each = placed.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    pairs = each.select("family", "node", "colour", "shingles", "own", F.least("own", "with").alias("one"), F.greatest("own", "with").alias("two"))
    return pairs.groupBy("family", "one", "two").applyInPandas(confirm, "a long, b long").distinct()


def _joined(parts: DataFrame | None, edges: DataFrame) -> DataFrame:
    """(node, component) of the parts found so far, which stand for all edges before, joined by the edges; checkpointed."""
    edges = edges.select("a", "b")
    if edges.isEmpty():
        return edges.toDF("node", "component") if parts is None else parts
    if parts is not None:
        edges = edges.unionByName(parts.select(F.col("node").alias("a"), F.col("component").alias("b")))
    return durable(connected_components(edges))


def _similar_rows(docs: DataFrame, similarity: float, shingle_words: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, sha, component) for every row; the hash of the text tells rows without id, or of one id, apart."""
    words = (TABLES * TABLE_BITS + CHECK_BITS) // BITS

    @F.arrow_udf(T.BinaryType())
    def fingerprint(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in giving_back(parts):
            out = [row.astype(">u8").tobytes() for part in in_slices([texts]) for row in _majorities(part.to_pylist(), shingle_words, words, distinct=True)]
            del texts
            yield pa.array(out, pa.binary())

    text = whole(text_col)
    own = durable(docs.select(F.col(id_col).alias("doc_id"), F.sha2(text.cast("binary"), 256).alias("sha"), fingerprint(text).alias("fp")).withColumn("node", F.xxhash64("fp")))
    different = durable(own.groupBy("node").agg(F.first("fp").alias("fp"), F.min("sha").alias("sha")))
    hashes = F.array_distinct(shingle_hashes(F.translate(text, UPPER, LOWER), shingle_words))
    hot = _joined(None, durable(hot_links(different, similarity)))
    coloured = durable(different.select("fp", "node").join(hot, "node", "left").select("fp", "node", F.coalesce("component", "node").alias("colour")))
    links = durable(similar_links(coloured, similarity))
    trees = _joined(hot, links.where("kind = 'sure'"))
    families = _joined(None, links.where("kind = 'doubtful'")).withColumnRenamed("component", "family")

    # the shingle sets of families, one text for each node
    asked = durable(families.join(trees, "node", "left").select("family", "node", F.coalesce("component", "node").alias("colour")).join(different.select("node", "sha"), "node"))
    texts = docs.select(F.sha2(text.cast("binary"), 256).alias("sha"), text.alias("text")).join(asked, "sha").dropDuplicates(["node"])
    members = durable(texts.select("family", "node", "colour", hashes.alias("shingles")))
    groups = _joined(trees, durable(confirmed_links(members, similarity)))
    by_group = different.select("node").join(groups, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    return own.join(by_group, "node").select("doc_id", "sha", "component")


def drop_near_duplicates(docs: DataFrame, similarity: float = 0.8, shingle_words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group of similar ones, the one with the smallest id, with all its columns.

    A row without id stays only where no row of its group has one. Rows of one id, or without id, are told apart by
    their texts; of rows with the same id and text one stays. Null texts count as empty; texts without words are one
    group; very long texts are read whole. Extra columns stay, whatever their names; an empty table stays empty.
    """
    rows = _similar_rows(docs, similarity, shingle_words, id_col, text_col)
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "sha")).alias("first"))
    return keep_rows(docs, first.select("first.doc_id", F.col("first.sha").alias("text_sha256")), id_col, text_col)
