"""Language identification by interpolated Kneser-Ney character models."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidara.llm.common import whole
from evidara.session import durable

#: Code points in the longest n-gram.
ORDER = 5
#: About so many labelled documents of each language are learnt from, and about FIT_ALL of all languages together.
FIT_DOCS, FIT_ALL = 400, 8_000
#: One in so many of these is kept from the counts, to calibrate scores and rejection; languages of fewer than FEW rows use all for both.
CALIBRATE, FEW = 5, 50
#: Share of a language's calibration rows that may be rejected.
REJECTED = 0.005
#: Code points that are worked on at once; a longer text is worked on in several pieces.
CHUNK = 4_000_000
#: Stands before and after each word.
EDGE = "\x02"
UNDETERMINED = "und"
_WORD = re.compile(r"[^\W\d_]+")
_POWER = np.uint64(0x9E3779B97F4A7C15)

COUNTS = "order int, lang int, gram long, context long, rest long, starts boolean, n long"


def learning_row(doc_id: Column) -> Column:
    """Rows with an id whose CRC-32 as text leaves a remainder by 5 are learnt from; the others are held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0, F.lit(False))


def gram_hashes(words: list[str], order: int = ORDER) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Of ``EDGE word EDGE word ... EDGE``: the hashes of the n-grams that end at each place, by n from 0; the places since the edge before; and the places of edges.

    An n-gram that ends at a place lies within its word, edges included, if n - 1 is not above the places since the edge.
    """
    codes = np.frombuffer((EDGE + EDGE.join(words) + EDGE).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    edges = np.flatnonzero(codes == ord(EDGE))
    since = np.zeros(len(codes), np.int64)
    since[1:] = np.arange(1, len(codes)) - np.repeat(edges[:-1], np.diff(edges))
    hashes, power = [np.zeros(len(codes), np.uint64)], np.uint64(1)
    with np.errstate(over="ignore"):
        for k in range(order):
            shifted = np.zeros_like(codes)
            shifted[k:] = codes[: len(codes) - k]
            hashes.append(hashes[-1] + (shifted + np.uint64(1)) * power)
            power = power * _POWER
    return hashes, since, edges


def words_of(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """The words of texts, runs of letters in small ones, with the number of the text of each, in pieces of about CHUNK code points."""
    owners, words, size = [], [], 0
    for i, text in enumerate(texts):
        for found in _WORD.findall(text) if len(text) <= CHUNK else (m[0] for m in _WORD.finditer(text)):
            if found.isalpha() or any(map(str.isalpha, found)):
                owners.append(i)
                words.append(found.lower())
                size += len(found) + 1
                if size >= CHUNK:
                    yield owners, words
                    owners, words, size = [], [], 0
    if words:
        yield owners, words


def count_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of (lang, text) rows the n-grams of all orders with their contexts (without the last code point) and rests (without the first)."""
    for batch in batches:
        for lang, rows in batch.groupby("lang"):
            for _, words in words_of(list(rows["text"])):
                hashes, since, _ = gram_hashes(words)
                for k in range(1, ORDER + 1):
                    ends = np.flatnonzero((since > 0) & (since >= k - 1))
                    grams, at, n = np.unique(hashes[k][ends], return_index=True, return_counts=True)
                    ends = ends[at]
                    signed = [h.astype(np.int64) for h in (grams, hashes[k - 1][ends - 1], hashes[k - 1][ends])]
                    yield pd.DataFrame({"order": k, "lang": lang, "gram": signed[0], "context": signed[1], "rest": signed[2], "starts": (since[ends] == k - 1), "n": n})


@dataclass
class Model:
    """For each order sorted hashes; beside each, in every language, the log probability of its last code point and the log weight of backing off from it as a context."""

    grams: list[np.ndarray]
    log_p: list[np.ndarray]
    log_back: list[np.ndarray]
    #: Log probability of a code point that no language has shown.
    log_new: np.ndarray

    def score_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each word with its end in each language, and over how many code points that is."""
        order = len(self.grams)
        hashes, since, edges = gram_hashes(words, order)
        total = np.zeros((len(since), len(self.log_new)))
        missing = np.arange(1, len(since))
        for k in range(order, 0, -1):
            fits = since[missing] >= k - 1
            ends = missing[fits]
            row, found = self._find(k, hashes[k][ends])
            total[ends[found]] += self.log_p[k - 1][row[found]]
            ends = ends[~found]
            if k > 1:
                row, known = self._find(k - 1, hashes[k - 1][ends - 1])
                total[ends[known]] += self.log_back[k - 2][row[known]]
            missing = np.concatenate([missing[~fits], ends])
        total[missing] += self.log_new
        return np.add.reduceat(total[1:], edges[:-1]), np.diff(edges)

    def _find(self, k: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known = self.grams[k - 1]
        row = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        return row, known[row] == hashes

    def cross_entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy of each text in each language, in nats a code point, and over how many code points (0: no letter)."""
        sums, lengths = np.zeros((len(texts), len(self.log_new))), np.zeros(len(texts), np.int64)
        for owners, words in words_of(texts):
            code, different = pd.factorize(np.array(words, object))
            score, length = self.score_words(list(different))
            for lang in range(sums.shape[1]):
                sums[:, lang] += np.bincount(owners, score[code, lang], len(texts))
            lengths += np.bincount(owners, length[code], len(texts)).astype(np.int64)
        return -sums / np.maximum(lengths, 1)[:, None], lengths

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, log_new=self.log_new, **{f"{f.name}{k}": a for f in fields(self)[:3] for k, a in enumerate(getattr(self, f.name))})
        return out.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Model:
        with np.load(io.BytesIO(raw)) as held:
            lists = [[held[f"{f.name}{k}"] for k in range(sum(n.startswith(f.name) and n[len(f.name) :].isdigit() for n in held.files))] for f in fields(cls)[:3]]
            return cls(*lists, held["log_new"])


def kneser_ney(counts: pd.DataFrame, n_langs: int) -> Model:
    """The models of all languages from counts of their n-grams (columns of COUNTS).

    Shorter n-grams count the different code points they follow, or, at the start of a word, their occurrences. From each
    count a discount is taken, n1 / (n1 + 2 n2) by order and language, and its mass goes to the n-gram without its first
    code point, in the end to all code points alike, one unseen included. Every n-gram that any language has shown gets its
    interpolated probability in all languages, so one look-up serves all.
    """
    order = int(counts["order"].max())
    by_order = [counts[counts["order"] == k] for k in range(1, order + 1)]
    rows = [{c: part[c].to_numpy(np.int64).view(np.uint64) for c in ("gram", "context", "rest")} | {"lang": part["lang"].to_numpy(), "starts": part["starts"].to_numpy(bool), "n": part["n"].to_numpy(np.float64)} for part in by_order]
    grams = [np.unique(r["gram"]) for r in rows]
    below = np.full((1, n_langs), 1 / (len(grams[0]) + 1))
    log_p, log_back, log_new = [], [np.zeros((len(g), n_langs), np.float32) for g in grams], None
    for k, own in enumerate(rows):
        table = np.zeros((len(grams[k]), n_langs))
        raw = own["starts"] if k + 1 < order else np.ones(len(own["gram"]), bool)
        np.add.at(table, (np.searchsorted(grams[k], own["gram"][raw]), own["lang"][raw]), own["n"][raw])
        if k + 1 < order:
            longer = rows[k + 1]
            at = np.searchsorted(grams[k], longer["rest"])
            starts = np.zeros(len(grams[k]), bool)
            starts[np.searchsorted(grams[k], own["gram"][raw])] = True
            follows = ~starts[at]
            np.add.at(table, (at[follows], longer["lang"][follows]), 1)
        ones, twos = (table == 1).sum(0), (table == 2).sum(0)
        discount = np.where((ones > 0) & (twos > 0), ones / np.maximum(ones + 2 * twos, 1), 0.5)
        _, first = np.unique(own["gram"], return_index=True)  # context and rest of each n-gram, in the order of grams
        contexts, of = np.unique(own["context"][first], return_inverse=True)
        total, types = np.zeros((len(contexts), n_langs)), np.zeros((len(contexts), n_langs))
        np.add.at(total, of, table)
        np.add.at(types, of, table > 0)
        back = np.where(total > 0, discount * types / np.maximum(total, 1), 1.0)
        rest = below[np.searchsorted(grams[k - 1], own["rest"][first])] if k else below
        p = np.maximum(table - discount, 0) / np.maximum(total, 1)[of] + back[of] * rest
        log_p.append(np.log(p).astype(np.float32))
        if k:
            log_back[k - 1][np.searchsorted(grams[k - 1], contexts)] = np.log(back)
        else:
            log_new = np.log(back[0] * below[0])
        below = p
    return Model(grams, log_p, log_back, log_new)


@dataclass
class Identifier:
    """A model with its languages, the sharpness that turns cross-entropies into scores, and the cross-entropy above which a language is rejected."""

    languages: list[str]
    model: Model
    sharpness: float
    limits: np.ndarray

    def identify(self, texts: list[str]) -> pd.DataFrame:
        entropies, lengths = self.model.cross_entropies(texts)
        best = entropies.argmin(1)
        score = _posterior(entropies, lengths, self.sharpness)[np.arange(len(texts)), best]
        none, lowest = lengths == 0, entropies.min(1)
        return pd.DataFrame(
            {
                "lang_pred": np.where(none, UNDETERMINED, np.array(self.languages, object)[best]),
                "score": np.where(none, 0.0, score),
                "cross_entropy": np.where(none, np.nan, lowest),
                "rejected": none | (lowest > self.limits[best]),
            }
        )


def _posterior(entropies: np.ndarray, lengths: np.ndarray, sharpness: float) -> np.ndarray:
    logits = -sharpness * np.sqrt(lengths)[:, None] * entropies
    weights = np.exp(logits - logits.max(1, keepdims=True))
    return weights / weights.sum(1, keepdims=True)


def _calibrate(languages: list[str], model: Model, entropies: np.ndarray, lengths: np.ndarray, lang: np.ndarray) -> Identifier:
    """The sharpness of least log loss on the calibration rows, and each language's limit, which its own rows pass but for a share of REJECTED."""
    worded = lengths > 0
    entropies, lengths, lang = entropies[worded], lengths[worded], lang[worded]
    losses = {s: -np.log(np.maximum(_posterior(entropies, lengths, s)[np.arange(len(lang)), lang], 1e-12)).sum() for s in 2.0 ** np.arange(-4, 7)}
    own = entropies[np.arange(len(lang)), lang]
    limits = np.array([np.quantile(own[lang == i], 1 - REJECTED, method="higher") if (lang == i).any() else np.inf for i in range(len(languages))])
    return Identifier(languages, model, min(losses, key=losses.get), limits)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_docs: int = FIT_DOCS, fit_all: int = FIT_ALL, seed: int = 11) -> Identifier | None:
    """Learn from a sample of ``docs`` by a hash of the id: about ``fit_docs`` rows a language, or all it has; None without any language.

    N-grams are counted where the sampled texts lie and summed by a shuffle; the counts, bounded by the sample, become the model in
    one task.
    """
    spark = docs.sparkSession
    sizes = {r[0]: r[1] for r in docs.where(F.col(lang_col).isNotNull()).groupBy(lang_col).agg(F.count("*")).collect()}  # a row for each language
    languages = sorted(sizes)
    if not languages:
        return None
    per_lang = min(fit_docs, max(1, fit_all // len(languages)))
    told = spark.createDataFrame([(name, i, min(1.0, per_lang / sizes[name]), sizes[name] < FEW) for i, name in enumerate(languages)], "_name string, _lang int, _rate double, _few boolean")
    source = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_name"), whole(text_col).alias("text"))
    draw = F.pmod(F.xxhash64(F.lit(seed), "_id"), F.lit(1 << 30)) / (1 << 30)
    sample = durable(source.join(F.broadcast(told), "_name").where(draw < F.col("_rate")).select(F.col("_lang").alias("lang"), "text", "_few", (F.pmod(F.xxhash64(F.lit(seed + 1), "_id"), F.lit(CALIBRATE)) == 0).alias("calibrate")))
    counts = sample.where(~F.col("calibrate") | F.col("_few")).select("lang", "text").mapInPandas(count_grams, COUNTS)
    counts = counts.groupBy("order", "lang", "gram").agg(F.any_value("context").alias("context"), F.any_value("rest").alias("rest"), F.any_value("starts").alias("starts"), F.sum("n").alias("n"))

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = list(batches)
        if rows:
            yield pd.DataFrame({"model": [kneser_ney(pd.concat(rows), len(languages)).to_bytes()]})

    fitted = counts.repartition(1).mapInPandas(one, "model binary").collect()
    if not fitted:
        return None
    shared = spark.sparkContext.broadcast(fitted[0]["model"])

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Model.from_bytes(shared.value)
        for batch in batches:
            entropies, lengths = model.cross_entropies(list(batch["text"]))
            yield pd.DataFrame({"lang": batch["lang"].to_numpy(), "entropies": list(entropies), "length": lengths})

    rows = sample.where(F.col("calibrate") | F.col("_few")).select("lang", "text").mapInPandas(measure, "lang int, entropies array<double>, length long").collect()
    entropies = np.array([r["entropies"] for r in rows]).reshape(-1, len(languages))
    return _calibrate(languages, Model.from_bytes(fitted[0]["model"]), entropies, np.array([r["length"] for r in rows], np.int64), np.array([r["lang"] for r in rows], np.int64))


def identify_documents(docs: DataFrame, identifier: Identifier | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, cross_entropy, rejected) of every row.

    The language is that of the lowest cross-entropy a code point over the words of the whole text, ties going to the
    first by code point. Null texts and texts without a letter are ``und`` with score 0, and so is every row where no
    language was learnt. ``rejected`` says that the text fits its language worse than all but REJECTED of that
    language's calibration rows, as texts in languages not learnt do. Repeated rows count each, extra columns are left out, an empty
    table gives no rows.
    """
    schema = "doc_id long, lang_pred string, score double, cross_entropy double, rejected boolean"
    source = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text"))
    if identifier is None:
        return source.select("doc_id", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("cross_entropy"), F.lit(True).alias("rejected"))
    shared = docs.sparkSession.sparkContext.broadcast((identifier.languages, identifier.model.to_bytes(), identifier.sharpness, identifier.limits))

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        languages, raw, sharpness, limits = shared.value
        own = Identifier(languages, Model.from_bytes(raw), sharpness, limits)
        for batch in batches:
            told = own.identify(list(batch["text"]))
            told.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy(object, na_value=None))
            yield told

    return source.mapInPandas(predict, schema).withColumn("cross_entropy", F.nanvl("cross_entropy", F.lit(None).cast("double")))
