"""Language-model scoring by Katz backoff: Good-Turing discounted trigrams over bigrams over words over unknown words.

Documents are coded once into blocks of some million tokens. Each order of the model then is one exchange: every block
asks for its different n-grams, once each and with how often its training documents hold them; the questions are dealt
into the buckets of a partitioned table, in which an n-gram's count and all it takes to normalise its history meet; and
the answers go back to the block that asked. So a frequent word, pair or mark costs one entry a block, not one a token.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidara.llm.common import LOWER, UPPER, whole
from evidara.session import durable_by, shuffle_partitions

#: Counts above this are trusted and keep their full weight.
TRUSTED = 5
#: Additive constant of the base score.
BASE = 0.1
#: Tokens of a block, and the tokens for which the table gets one more bucket.
BLOCK_TOKENS, BUCKET_TOKENS = 2_000_000, 2_000_000
#: A history is dealt over all buckets if it holds more than one in so many of the training tokens; there are fewer of them than this.
MOST_HOT = 200_000
#: Marks that no word can be, since words hold no white space.
START, END = b"\n", b"\t"


def training_row(id_col: Column) -> Column:
    """Documents the model learns from; the others are held out."""
    return F.coalesce(F.crc32(F.encode(id_col.cast("string"), "utf-8")) % 10 != 0, F.lit(False))


def good_turing(counts_of_counts: dict[int, int], trusted: int = TRUSTED) -> dict[int, float]:
    """Katz' discount ratios for counts 1 to trusted, from how many n-grams were seen so often.

    Where the figures don't support a Good-Turing ratio (it would leave 0 to 1, as with few or odd counts) absolute
    discounting by n1 / (n1 + 2 n2) stands in for it, so that some mass is always left for unseen events.
    """
    n = [0, *(counts_of_counts.get(r, 0) for r in range(1, trusted + 2))]
    step = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
    step = min(max(step, 0.05), 0.95)
    tail = (trusted + 1) * n[trusted + 1] / n[1] if n[1] else 1.0
    ratios = {}
    for r in range(1, trusted + 1):
        ratio = None
        if n[r] and n[r + 1] and tail < 1:
            ratio = ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail)
        ratios[r] = ratio if ratio is not None and 0.01 < ratio < 1 else (r - step) / r
    return ratios


# --- how arrays travel ---------------------------------------------------------------------------------------------


def to_bytes(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed string; integers by planes of bytes, as their high bytes are mostly alike, and only the planes in use."""
    import zstandard

    parts = []
    for array in arrays:
        if array.dtype.kind == "f":
            width, raw = 9, array.astype("<f8").tobytes()
        else:
            array = array.astype("<i8")
            width = 8 if len(array) and array.min() < 0 else (int(array.max()).bit_length() + 7) // 8 if len(array) else 0
            raw = b"".join(plane.tobytes() for plane in array.view(np.uint8).reshape(-1, 8).T[:width])
        parts += [bytes([width]), len(array).to_bytes(8, "little"), raw]
    return zstandard.compress(b"".join(parts), 3)


def from_bytes(packed: bytes) -> list[np.ndarray]:
    import zstandard

    raw, at, out = zstandard.decompress(bytes(packed)), 0, []
    while at < len(raw):
        width, n = raw[at], int.from_bytes(raw[at + 1 : at + 9], "little")
        at += 9
        if width == 9:
            out.append(np.frombuffer(raw, dtype="<f8", count=n, offset=at))
            at += 8 * n
            continue
        wide = np.zeros((n, 8), dtype=np.uint8)
        for i in range(width):
            wide[:, i] = np.frombuffer(raw, dtype=np.uint8, count=n, offset=at + i * n)
        out.append(wide.view("<i8")[:, 0])
        at += width * n
    return out


def _steps(ascending: np.ndarray) -> np.ndarray:
    """First the smallest, then the distances (sums wrap around as they do)."""
    return np.diff(ascending, prepend=np.int64(0))


def _mixed(*values: np.ndarray) -> np.ndarray:
    """One well-mixed number below 2**63 for each tuple of numbers."""
    out = np.zeros(len(values[0]), dtype=np.uint64)
    for value in values:
        out ^= np.asarray(value, dtype=np.int64).view(np.uint64)
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    out >>= np.uint64(1)
    return out.view(np.int64)


def _groups(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts the tuples, and where in it each different one begins."""
    order = np.lexsort(columns[::-1])
    if not len(order):
        return order, order
    new = np.zeros(len(order), dtype=bool)
    for column in columns:
        ranked = column[order]
        new[1:] |= ranked[1:] != ranked[:-1]
    new[0] = True
    return order, np.flatnonzero(new)


def _spread(order: np.ndarray, starts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """One value for each group back on the group's members."""
    out = np.empty(len(order), dtype=values.dtype)
    out[order] = np.repeat(values, np.diff(np.r_[starts, len(order)]))
    return out


# --- blocks --------------------------------------------------------------------------------------------------------

BLOCKS = "block long, doc_ids array<bigint>, held array<boolean>, body binary"


def code_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks of whole documents: ids, which are held out, and the tokens as places in the block's own sorted list of 64-bit word hashes.

    Checkpointed where they are dealt by their number, so every later pass sees the same blocks and moves only what the
    tables answer to them; they take less room than the texts.
    """

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash
        from pyspark import TaskContext

        lower = bytes.maketrans(UPPER.encode(), LOWER.encode())  # in UTF-8 no other character has these bytes
        number = TaskContext.get().partitionId() << 32
        start, end = START, END

        def block() -> pd.DataFrame:
            keys = np.fromiter((xxhash.xxh64_intdigest(w) for w in known), dtype=np.uint64, count=len(known)).view(np.int64)
            codes = np.concatenate(tokens)
            # the most frequent words first, so that codes are small, and the many words of one count in the order of their keys
            order = np.lexsort((keys, -np.bincount(codes, minlength=len(keys))))
            place = np.empty_like(order)
            place[order] = np.arange(len(order))
            return pd.DataFrame({"block": [number], "doc_ids": [ids], "held": [held], "body": [to_bytes(_steps(keys[order]), place[codes], np.array(lengths))]})

        def fresh() -> tuple:
            numbers: dict[bytes, int] = defaultdict()
            numbers.default_factory = numbers.__len__
            numbers[start], numbers[end] = 0, 1
            return numbers, [], [], [], []

        known, tokens, lengths, ids, held = fresh()
        total = 0
        for batch in batches:
            for doc_id, out, text in zip(batch["doc_id"], batch["held"], batch["text"], strict=True):
                own = text.encode("utf-8").translate(lower).split()  # at the six ASCII white-space characters
                codes = np.fromiter(map(known.__getitem__, own), dtype=np.int64, count=len(own))
                tokens += [codes, np.ones(1, np.int64)]
                lengths.append(len(own) + 1)
                ids.append(None if pd.isna(doc_id) else int(doc_id))
                held.append(bool(out))
                total += len(own) + 1
                if total >= block_tokens:
                    yield block()
                    (known, tokens, lengths, ids, held), total, number = fresh(), 0, number + 1
        if lengths:
            yield block()

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), (~training_row(F.col(id_col))).alias("held"), whole(text_col).alias("text"))
    coded = slim.mapInPandas(lambda batches: code(b.astype({"doc_id": "Int64"}) for b in batches), BLOCKS)
    return durable_by(coded, "block")


@dataclass
class Block:
    """A block's tokens with the two before each, its different bigrams and trigrams, and what the tables answered."""

    keys: np.ndarray
    w: np.ndarray
    lengths: np.ndarray
    held: np.ndarray
    v: np.ndarray = field(init=False)
    u: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        start = self.start = int(np.flatnonzero(self.keys == _key(START))[0])
        first = np.r_[0, np.cumsum(self.lengths)[:-1]]
        self.v = np.roll(self.w, 1)
        self.v[first] = start
        self.u = np.roll(self.v, 1)
        self.u[first] = start
        self.learnt = np.repeat(~self.held, self.lengths)

    def in_order(self, ids: np.ndarray) -> np.ndarray:
        """Number the words anew in the order of their ids, so that ids ascend where codes do; returns that order."""
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(order), dtype=np.int32)
        place[order] = np.arange(len(order))
        self.keys, self.w, self.v, self.u, self.start = self.keys[order], place[self.w], place[self.v], place[self.u], int(place[self.start])
        return order

    def words(self) -> np.ndarray:
        """How often training documents hold each word; the start mark as often as it is a history."""
        n = np.bincount(self.w[self.learnt], minlength=len(self.keys))
        n[self.start] = (~self.held).sum()
        return n

    def bigrams(self) -> tuple[np.ndarray, ...]:
        """The different bigrams (v, w) in the order of w, how often training documents hold them, whether held-out ones do, and which one each token ends."""
        both, which = _unique_pairs(self.w, self.v)
        n, out = (np.bincount(which[rows], minlength=len(both)).astype(np.int32) for rows in (self.learnt, ~self.learnt))
        return (both & ((1 << 31) - 1)).astype(np.int32), (both >> 31).astype(np.int32), n, np.minimum(out, 1).astype(np.int8), which

    def trigrams(self, history: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of each different trigram a token that ends it, how often training documents hold it, and which one each token ends."""
        both, which = _unique_pairs(history, self.w)
        at = np.empty(len(both), dtype=np.int32)
        at[which[::-1]] = np.arange(len(which) - 1, -1, -1, dtype=np.int32)  # the first token of each
        return at, np.bincount(which[self.learnt], minlength=len(at)).astype(np.int32), which


def _unique_pairs(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different pairs as one number each, ascending, and which of them each row is, in half the room of np.unique's answer."""
    both = high.astype(np.int64)
    both <<= 31
    both |= low
    order = np.argsort(both).astype(np.int32)
    both = both[order]
    new = np.empty(len(both), dtype=bool)
    new[:1] = True
    np.not_equal(both[1:], both[:-1], out=new[1:])
    which = np.empty(len(both), dtype=np.int32)
    which[order] = np.cumsum(new, dtype=np.int32) - 1
    return both[new], which


def _key(word: bytes) -> np.int64:
    import xxhash

    return np.uint64(xxhash.xxh64_intdigest(word)).view(np.int64)


def _block(row) -> Block:
    steps, codes, lengths = from_bytes(row["body"])
    return Block(np.cumsum(steps), codes.astype(np.int32), lengths, np.array(row["held"], dtype=bool))


# --- the tables of one order ---------------------------------------------------------------------------------------

#: kind 'answer': to a block, as the answer to its question; 'sizes': a bucket's counts of counts; 'hot': a hot history's part.
ANSWERS = "kind string, level int, block long, bucket int, body binary"
QUESTIONS = "bucket int, block long, body binary"


def _discounts(ratios: dict[int, float]) -> np.ndarray:
    """Discounted counts by count, for 0 to the trusted ones."""
    return np.array([0.0, *(r * ratios[r] for r in sorted(ratios))])


def _discounted(count: np.ndarray, discounts: np.ndarray) -> np.ndarray:
    return np.where(count < len(discounts), discounts[np.minimum(count, len(discounts) - 1)], count)


def _sizes(counts: np.ndarray) -> np.ndarray:
    """How many counts are 0, 1 and so on up to TRUSTED + 1, and larger."""
    return np.bincount(np.minimum(counts, TRUSTED + 2), minlength=TRUSTED + 3)


def _count_words(asked: list[tuple[int, list[np.ndarray]]], bucket: int, buckets: int) -> Iterator[tuple]:
    """Words: their counts, and numbers of their own, the more frequent ones first."""
    keys = np.concatenate([np.cumsum(arrays[0]) for _, arrays in asked])
    n = np.concatenate([arrays[1] for _, arrays in asked])
    order, starts = _groups(keys)
    total, different = np.add.reduceat(n[order], starts), keys[order][starts]
    rank = np.empty(len(different), dtype=np.int64)
    rank[np.lexsort((different, -total))] = np.arange(len(different))
    ids, counts = _spread(order, starts, rank * buckets + bucket), _spread(order, starts, total)
    words = different != _key(START)
    seen = total[words]
    yield "sizes", -1, to_bytes(_sizes(seen), np.array([seen.sum(), (seen > 0).sum()]))
    at = 0
    for block, arrays in asked:
        upto = at + len(arrays[0])
        yield "answer", block, to_bytes(ids[at:upto], counts[at:upto])
        at = upto


def _count_histories(asked: list[tuple[int, list[np.ndarray]]], discounts: np.ndarray) -> Iterator[tuple]:
    """N-grams as (histories' words ..., word): their counts, and what is left to learn of their histories.

    A question holds the words of each n-gram, how often it is seen, the count and the total of which its lower
    probability is made, whether its history is seen and whether it is hot, whether a held-out document asks, and apart
    from these the number of n-grams of count 1 that are known without asking.
    Answered are the count, whether all counts of the history are trusted, whether held-out documents ask for the n-gram,
    and for unseen n-grams with a seen history how many of its n-grams have counts 1 to TRUSTED and the lower
    probabilities of all its n-grams. Of a hot history each bucket has a part, whose sums come apart.
    """
    asked = [(block, [arrays[0], np.cumsum(arrays[1]), *arrays[2:]]) for block, arrays in asked]  # the second word's ids ascend and come as steps
    *words, n, lower_count, lower_total, history_seen, hot, out, _ = (np.concatenate(x) for x in zip(*(arrays for _, arrays in asked), strict=True))
    lower = np.where(n > 0, _discounted(lower_count, discounts) / lower_total, 0.0)
    order, starts = _groups(*words)
    each = np.add.reduceat(n[order], starts)
    lower = np.maximum.reduceat(lower[order], starts)  # blocks that only ask for an n-gram leave it 0
    first = order[starts]
    count = _spread(order, starts, each)
    over, begins = _groups(*(w[first] for w in words[:-1]))  # histories over the different n-grams
    own, seen = each[over], each[over] > 0
    sums = np.stack([np.add.reduceat(np.where(own == r, 1, 0), begins) for r in range(1, TRUSTED + 1)], axis=1)
    mass = np.add.reduceat(np.where(seen, lower[over], 0.0), begins)
    of_ngram = _spread(over, begins, np.arange(len(begins)))
    of_row = _spread(order, starts, of_ngram)
    sizes = _sizes(each)
    sizes[1] += sum(int(arrays[-1].sum()) for _, arrays in asked)
    yield "sizes", -1, to_bytes(sizes)
    parts = np.flatnonzero(hot[first][over][begins] > 0)
    if len(parts):
        heads = [w[first][over][begins][parts] for w in words[:-1]]
        yield "hot", -1, to_bytes(*heads, *sums[parts].T, mass[parts])
    trusted = sums.sum(axis=1) == 0
    wanted = _spread(order, starts, np.maximum.reduceat(out[order], starts))
    at = 0
    for block, arrays in asked:
        upto = at + len(arrays[0])
        rows, number = of_row[at:upto], count[at:upto]
        ask = rows[(number == 0) & (history_seen[at:upto] > 0) & (hot[at:upto] == 0)]
        yield "answer", block, to_bytes(number, trusted[rows].astype(np.int64) * 2 + wanted[at:upto], *sums[ask].T, mass[ask])
        at = upto


def _exchange(blocks: DataFrame, answers: list[DataFrame], ask: Callable, count: Callable, level: int, buckets: int) -> DataFrame:
    """Ask for all blocks, count in the buckets of the table, and answer; see ANSWERS."""

    def questions(key: tuple, own: pd.DataFrame, had: pd.DataFrame) -> pd.DataFrame:
        found = [(bucket, int(key[0]), to_bytes(*arrays)) for bucket, arrays in ask(own.iloc[0], had)] if len(own) else []
        return pd.DataFrame(found, columns=["bucket", "block", "body"])

    def answer(key: tuple, asked: pd.DataFrame) -> pd.DataFrame:
        bucket = int(key[0])
        given = [(int(b), from_bytes(body)) for b, body in sorted(zip(asked["block"], asked["body"], strict=True), key=lambda x: x[0])]
        return pd.DataFrame([(kind, level, block, bucket, body) for kind, block, body in count(given, bucket)], columns=["kind", "level", "block", "bucket", "body"])

    asked = _with_answers(blocks, answers).applyInPandas(questions, QUESTIONS)
    return durable_by(asked.groupBy("bucket").applyInPandas(answer, ANSWERS), "block")


def _with_answers(blocks: DataFrame, answers: list[DataFrame]):
    """Each block together with what the tables have answered it so far."""
    own = [one.where("kind = 'answer'") for one in answers] or [blocks.sparkSession.createDataFrame([], ANSWERS)]
    had = own[0]
    for one in own[1:]:
        had = had.unionByName(one)
    return blocks.groupBy("block").cogroup(had.groupBy("block"))


def _answers(had: pd.DataFrame, level: int, bucket_of: np.ndarray) -> list[list[np.ndarray]]:
    """The answers of one level with the places of the block's n-grams that each of them is about."""
    own = had[had["level"] == level]
    order = np.argsort(bucket_of, kind="stable")
    cuts = np.searchsorted(bucket_of[order], own["bucket"].to_numpy()), np.searchsorted(bucket_of[order], own["bucket"].to_numpy(), side="right")
    return [[order[a:b], *from_bytes(body)] for a, b, body in zip(*cuts, own["body"], strict=True)]


def _dealt(bucket_of: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    order = np.argsort(bucket_of, kind="stable")
    ranked = bucket_of[order]
    starts = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]) if len(ranked) else []
    for a, b in zip(starts, [*starts[1:], len(ranked)], strict=True):
        yield int(ranked[a]), [array[order[a:b]] for array in arrays]


@dataclass
class Model:
    """What is known of the whole corpus: a few numbers for each order, and the sums of the few hot histories."""

    buckets: int
    hot_from: float = float("inf")
    tokens: int = 0
    distinct: int = 0
    discounts: dict[int, np.ndarray] = field(default_factory=dict)
    left_words: float = 1.0  # added to the number of tokens where no word is discounted
    unknown: float = 1.0
    hot: dict[int, dict[tuple, np.ndarray]] = field(default_factory=lambda: {2: {}, 3: {}})

    # words

    def word(self, count: np.ndarray) -> np.ndarray:
        """p(w) by count; the unknown word's where that is 0."""
        if not self.tokens:
            return np.ones(len(count))
        return np.where(count > 0, _discounted(count, self.discounts[1]) / (self.tokens + self.left_words), self.unknown)

    def words_of(self, block: Block, had: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """The ids and counts of the block's words, which are numbered anew in the order of the ids."""
        ids, counts = np.zeros(len(block.keys), dtype=np.int64), np.zeros(len(block.keys), dtype=np.int64)
        for at, number, count in _answers(had, 1, _mixed(block.keys) % self.buckets):
            ids[at], counts[at] = number, count
        order = block.in_order(ids)
        return ids[order], counts[order]

    # longer ones

    def bucket_of(self, words: list[np.ndarray], history_count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bucket of an n-gram is that of its history; a hot history's n-grams are dealt by their last word too."""
        hot = history_count > self.hot_from
        bucket = _mixed(*words[:-1])
        bucket[hot] = _mixed(*(w[hot] for w in words))
        return (bucket % self.buckets).astype(np.int32), hot.astype(np.int8)

    def probability(self, level: int, had: pd.DataFrame, words: list[np.ndarray], history_count: np.ndarray, lower: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, ...]:
        """Counts and probabilities of n-grams, their histories' totals, and which of them held-out documents hold.

        From the table's answers and the probabilities of the next lower order; those ``known`` are the only ones of their history.
        """
        bucket, hot = self.bucket_of(words, history_count)
        discounts = self.discounts[level]
        counts, out = known.astype(np.int64), np.where(known, discounts[1], lower)
        totals, wanted = history_count.astype(float), np.zeros(len(lower), dtype=np.int8)
        asked = np.flatnonzero(~known)
        for place, count, flags, *sums, mass in _answers(had, level, bucket[asked]):
            at = asked[place]
            counts[at], wanted[at] = count, flags & 1
            extra = (flags >> 1).astype(float)
            few = np.zeros((len(at), TRUSTED + 1))
            unseen = (count == 0) & (history_count[at] > 0)
            few[unseen & (hot[at] == 0)] = np.stack([*sums, mass], axis=1)
            for i in np.flatnonzero(hot[at]):
                few[i] = self.hot[level][tuple(int(w[at[i]]) for w in words[:-1])]
                extra[i] = float(few[i, :TRUSTED].sum() == 0)
            total = totals[at] = history_count[at] + extra
            with np.errstate(divide="ignore", invalid="ignore"):
                seen_p = _discounted(count, discounts) / total
                # what the counts 1 to TRUSTED lose by their discount, and what all of them take of the lower order
                lost = extra + few[:, :TRUSTED] @ (np.arange(1, TRUSTED + 1) - discounts[1:])
                rest = lost / total / (1 - few[:, TRUSTED]) * lower[at]
            out[at] = np.where(count > 0, seen_p, np.where(unseen, rest, lower[at]))
        return counts, out, totals, wanted


def fit(blocks: DataFrame, buckets: int | None = None, most_hot: int = MOST_HOT, least_hot: int = BUCKET_TOKENS) -> tuple[Model, list[DataFrame]]:
    """The model's numbers and, order by order, the tables' answers to the blocks.

    p(w | u v) = discounted count / count of (u v) where the trigram was seen, and else the mass that the discounts of
    (u v)'s trigrams leave times p(w | v), over what p(. | v) gives to words not seen after (u v); p(w | v) in the same
    way over p(w), and p(w) over one unknown word. A history all of whose counts are trusted loses nothing by
    discounts; its total is raised by one, so that mass is left there too. For every history, the probabilities of all
    words and the unknown one sum to 1.

    A history with more than least_hot tokens and more than one in most_hot of all is hot: its n-grams are dealt over
    all buckets, and the sums of its parts, at most most_hot small rows, go to all tasks.
    """
    if buckets is None:
        size = blocks.select(F.sum(F.octet_length("body"))).first()[0] or 0  # about two bytes a token
        buckets = max(shuffle_partitions(blocks.sparkSession), size // (2 * BUCKET_TOKENS))
    model = Model(int(buckets))

    def ask_words(row, had: pd.DataFrame):
        block = _block(row)
        return ((bucket, [_steps(keys), n]) for bucket, (keys, n) in _dealt(_mixed(block.keys) % buckets, block.keys, block.words()))

    words = _exchange(blocks, [], ask_words, lambda asked, bucket: _count_words(asked, bucket, buckets), 1, buckets)
    sizes, sums = _sizes(np.zeros(0, dtype=np.int64)), np.zeros(2, dtype=np.int64)
    for r in words.where("kind = 'sizes'").select("body").collect():  # one small row for each bucket
        own, known = from_bytes(r["body"])
        sizes, sums = sizes + own, sums + known
    model.tokens, model.distinct = int(sums[0]), int(sums[1])
    model.hot_from = max(least_hot, model.tokens / most_hot)
    model.discounts[1] = _discounts(good_turing(dict(enumerate(sizes))))
    lost = float(sizes[1 : TRUSTED + 1] @ (np.arange(1, TRUSTED + 1) - model.discounts[1][1:]))
    model.left_words = 0.0 if lost > 0 else 1.0
    if model.tokens:
        model.unknown = (lost or 1.0) / (model.tokens + model.left_words)

    def ask_bigrams(row, had: pd.DataFrame):
        block = _block(row)
        ids, counts = model.words_of(block, had)
        v, w, n, out, _ = block.bigrams()
        bucket, hot = model.bucket_of([ids[v], ids[w]], counts[v])
        total = np.full(len(v), model.tokens + int(model.left_words))
        columns = [ids[v], ids[w], n, np.where(n > 0, counts[w], 0), total, np.minimum(counts[v], 1).astype(np.int8), hot, out]
        return ((b, [part[0], _steps(part[1]), *part[2:], np.zeros(1, dtype=np.int64)]) for b, part in _dealt(bucket, *columns))

    bigrams = _exchange(blocks, [words], ask_bigrams, lambda asked, _: _count_histories(asked, model.discounts[1]), 2, buckets)
    _learn(model, 2, bigrams)

    def ask_trigrams(row, had: pd.DataFrame):
        grams = trigrams_of(model, _block(row), had)
        bucket, hot = model.bucket_of(grams.words, grams.history_count)
        seen = grams.n > 0
        out = np.zeros(len(seen), dtype=np.int8)
        columns = [*grams.words, grams.n, np.where(seen, grams.lower_count, 0), np.where(seen, grams.lower_total, 1).astype(np.int64), np.minimum(grams.history_count, 1).astype(np.int8), hot, out, grams.known]
        del grams, seen, hot, out
        for b, part in _dealt(bucket, *columns):
            asked = ~part[-1]
            first, second, *rest = (x[asked] for x in part[:-1])
            yield b, [first, _steps(second), *rest, np.array([(~asked).sum()])]

    trigrams = _exchange(blocks, [words, bigrams], ask_trigrams, lambda asked, _: _count_histories(asked, model.discounts[2]), 3, buckets)
    _learn(model, 3, trigrams)
    return model, [words, bigrams, trigrams]


@dataclass
class Trigrams:
    """A block's different trigrams."""

    words: list[np.ndarray]
    n: np.ndarray  # how often training documents of the block hold it
    history_count: np.ndarray
    lower: np.ndarray  # p(w | v), of which count and total are
    lower_count: np.ndarray
    lower_total: np.ndarray
    known: np.ndarray  # its history is seen once, here, and no held-out document asks for it: the count is 1
    which: np.ndarray  # each token's trigram
    word_counts: np.ndarray  # of the block's words, as they are numbered now


def trigrams_of(model: Model, block: Block, had: pd.DataFrame) -> Trigrams:
    ids, counts = model.words_of(block, had)
    v, w, _, _, which = block.bigrams()
    pair_counts, lower, totals, wanted = model.probability(2, had, [ids[v], ids[w]], counts[v], model.word(counts[w]), np.zeros(len(v), dtype=bool))
    # the bigram that ends one token earlier is the history; at the first token it is the start mark twice
    first = np.r_[0, np.cumsum(block.lengths)[:-1]]
    history = np.roll(which, 1)
    history[first] = len(v)
    at, n, token_trigram = block.trigrams(history)
    pair, before = which[at], history[at]
    del history, which, v, w
    history_count, asked = np.append(pair_counts, counts[block.start])[before], np.append(wanted, 1)[before]
    return Trigrams(
        [ids[block.u[at]], ids[block.v[at]], ids[block.w[at]]], n, history_count, lower[pair], pair_counts[pair], totals[pair],
        (n > 0) & (history_count == 1) & (asked == 0), token_trigram, counts,
    )


def _learn(model: Model, level: int, answers: DataFrame) -> None:
    """Take an order's counts of counts, and the sums of its hot histories, from what the buckets tell."""
    sizes = _sizes(np.zeros(0, dtype=np.int64))
    for r in answers.where("kind = 'sizes'").select("body").collect():  # one small row for each bucket
        sizes += from_bytes(r["body"])[0]
    model.discounts[level] = _discounts(good_turing(dict(enumerate(sizes))))

    def open_parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for body in batch["body"]:
                *rest, mass = from_bytes(body)
                heads, sums = rest[: level - 1], rest[level - 1 :]
                yield pd.DataFrame({"head": [",".join(map(str, h)) for h in zip(*(x.tolist() for x in heads), strict=True)], **{f"n{i}": x for i, x in enumerate(sums)}, "mass": mass})

    columns = [*(f"n{i}" for i in range(TRUSTED)), "mass"]
    schema = "head string, " + ", ".join(f"n{i} long" for i in range(TRUSTED)) + ", mass double"
    parts = answers.where("kind = 'hot'").select("body").mapInPandas(open_parts, schema)
    for r in parts.groupBy("head").agg(*(F.sum(c).alias(c) for c in columns)).collect():  # at most most_hot rows
        model.hot[level][tuple(map(int, r["head"].split(",")))] = np.array([float(r[c]) for c in columns])


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_blocks(blocks: DataFrame, model: Model, answers: list[DataFrame], base: float = BASE) -> DataFrame:
    """Every document's sums over its tokens."""

    def score(key: tuple, own: pd.DataFrame, had: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return pd.DataFrame({c.split()[0]: [] for c in SCORES.split(", ")})
        row = own.iloc[0]
        block = _block(row)
        grams = trigrams_of(model, block, had)
        counts = grams.word_counts
        _, p, _, _ = model.probability(3, had, grams.words, grams.history_count, grams.lower, grams.known)
        simple = np.log10((counts + base) / (model.tokens + base * (model.distinct + 1)))
        ends = np.r_[0, np.cumsum(block.lengths)[:-1]]
        count = counts[block.w]
        return pd.DataFrame({
            "doc_id": pd.array([None if x is None or pd.isna(x) else int(x) for x in row["doc_ids"]], dtype="Int64"), "held_out": block.held, "n_tokens": block.lengths,
            "n_known": np.add.reduceat((count > 0).astype(np.int64), ends), "train_tokens": model.tokens,
            "base_score": np.add.reduceat(simple[block.w], ends), "score": np.add.reduceat(np.log10(p)[grams.which], ends),
        })

    return _with_answers(blocks, answers).applyInPandas(score, SCORES)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS, **parameters) -> DataFrame:
    """Every document's log10 probability under the model learnt from the training documents.

    Null texts are empty: their only token is the end. Null ids are held out, as their remainder is null. Repeated rows
    count and are scored each; with no training document only the unknown word has probability, which is 1. A very long
    text is a block of its own. Extra columns, whatever their names, are left out; an empty table gives no rows. Words
    stand for their 64-bit hashes.
    """
    blocks = code_blocks(docs, id_col, text_col, block_tokens)
    model, answers = fit(blocks, **parameters)
    return score_blocks(blocks, model, answers)
