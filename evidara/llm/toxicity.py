"""Toxicity by a support vector machine over a gapped string kernel with Nyström landmarks."""

from __future__ import annotations

import heapq
import pickle
import re
import unicodedata
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidara.llm.common import giving_back, in_slices, whole

#: Labelled documents the classifier is fitted on at most, for each label.
FIT_TOXIC, FIT_CLEAN = 1500, 3000
#: Bytes of their texts at most.
FIT_BYTES = 64 << 20
LANDMARKS, CANDIDATES = 96, 1500
#: Log likelihood ratio from which a trait is taken for more than chance.
EVIDENCE = 14.0
#: A trait is looked at as standing once, twice, three or more times in a document; traits looked at closely at most, and those kept of them.
LEVELS, TRAITS, MARKS = 3, 1200, 120
#: Places of the second and third letter after the first, and the kernel's decay for each letter of the span beyond three.
GAPS = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))
DECAY = 0.6
#: Below this likeness to every landmark a word says nothing.
ACTIVE = 0.45
UNIT_LETTERS, UNIT_OVERLAP = 40, 8
CACHE = 400_000
#: Words whose likeness is worked out together; each has some kilobytes of letter triples meanwhile.
LEARNT_AT_ONCE = 1024
THRESHOLD = 0.3

# fixed values: digits and signs that stand for letters
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a"}
_ENDS = "\n.!?"


class _Letters(dict):
    """Translation of characters: letters to their base letter, look-alikes to letters, sentence ends to line breaks, other signs to nothing."""

    def __missing__(self, code: int):
        char = chr(code)
        if char in _ENDS:
            out = "\n"
        elif char.isspace():
            out = " "
        elif char in LOOKALIKES:
            out = LOOKALIKES[char]
        else:
            base = unicodedata.normalize("NFKD", char)[0]
            out = base if base.isalpha() else None
        self[code] = out
        return out


_LETTERS = _Letters()


class Parsed:
    """A text's units, and its sentences as lists of units when asked for.

    Units are words of bare letters and words spelled out letter by letter; very long ones are taken in overlapping
    stretches.
    """

    def __init__(self, text: str):
        self.plain = text.lower().translate(_LETTERS)
        units = self.plain.split()
        self.long = bool(units) and len(max(units, key=len)) > UNIT_LETTERS
        lengths = bytes(map(len, units)) if not self.long else bytes(min(len(u), UNIT_LETTERS) for u in units)
        self.spelled = []
        if b"\1\1\1\1" in lengths:
            self.spelled = [s for run in re.finditer(b"\1{4,}", lengths) for s in _stretches("".join(units[run.start() : run.end()]))]
        self.units = {s for unit in units for s in _stretches(unit)} if self.long else set(units)
        self.units.update(self.spelled)

    def counts(self) -> Counter:
        """How often each unit stands in the text."""
        return Counter(unit for line in self.sentences() for unit in line)

    def sentences(self) -> list[list[str]]:
        lines = (line.split() for line in self.plain.split("\n"))
        found = [[s for unit in line for s in _stretches(unit)] if self.long else line for line in lines if line]
        return found + [[s] for s in self.spelled]


def _stretches(word: str) -> list[str]:
    step = UNIT_LETTERS - UNIT_OVERLAP
    return [word[i : i + UNIT_LETTERS] for i in range(0, max(len(word) - UNIT_OVERLAP, 1), step)]


def _codes(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each unit the codes of its gapped letter triples (-1: none) and, by column, their weights."""
    width = max(map(len, units), default=0) + max(b for _, b in GAPS)
    raw = np.array(units, dtype=f"U{width}").view(np.uint32).reshape(len(units), width).astype(np.int64)
    last = width - max(b for _, b in GAPS)
    found, weights = [], []
    for second, third in GAPS:
        a, b, c = raw[:, :last], raw[:, second : last + second], raw[:, third : last + third]
        found.append(np.where((a > 0) & (b > 0) & (c > 0), (a << 42) | (b << 21) | c, -1))  # 21 bits hold any character
        weights += [DECAY ** (third - 2)] * last
    return np.concatenate(found, axis=1) if last else np.zeros((len(units), 0), np.int64), np.array(weights)


def _norms(codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Length of each unit's feature vector, where equal triples of a unit add up."""
    if not codes.size:
        return np.ones(len(codes))
    order = np.argsort(codes, axis=1, kind="stable")
    ranked = np.take_along_axis(codes, order, axis=1)
    weight = np.where(ranked >= 0, weights[order], 0.0)
    new = np.ones_like(ranked, dtype=bool)
    new[:, 1:] = ranked[:, 1:] != ranked[:, :-1]
    group = np.cumsum(new.ravel()) - 1
    sums = np.bincount(group, weights=weight.ravel())
    rows = np.repeat(np.arange(len(codes)), codes.shape[1])[new.ravel()]
    return np.sqrt(np.maximum(np.bincount(rows, weights=sums**2, minlength=len(codes)), 1e-12))


def _vectors(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Normalised feature vectors over the triples that occur, and which triples these are; for bounded lists of units only."""
    codes, weights = _codes(units)
    used = np.unique(codes[codes >= 0])
    out = np.zeros((len(units), len(used)), dtype=np.float32)
    rows, columns = np.nonzero(codes >= 0)
    np.add.at(out, (rows, np.searchsorted(used, codes[rows, columns])), weights[columns].astype(np.float32))
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-6), used


def _alike(units: list[str], block: int = 4096) -> np.ndarray:
    """The kernel of all pairs of units; so many triples at a time, since all of them may be hundreds of thousands."""
    codes, weights = _codes(units)
    used = np.unique(codes[codes >= 0])
    rows, columns = np.nonzero(codes >= 0)
    at = np.searchsorted(used, codes[rows, columns])

    def parts() -> Iterator[np.ndarray]:
        for start in range(0, len(used), block):
            own = np.flatnonzero((at >= start) & (at < start + block))
            out = np.zeros((len(units), min(block, len(used) - start)), dtype=np.float32)
            np.add.at(out, (rows[own], at[own] - start), weights[columns[own]].astype(np.float32))
            yield out

    length, out = np.zeros((len(units), 1), dtype=np.float32), np.zeros((len(units), len(units)), dtype=np.float32)
    for part in parts():
        length += (part * part).sum(axis=1, keepdims=True)
    length = np.maximum(np.sqrt(length), 1e-6)
    for part in parts():
        part /= length
        out += part @ part.T
    return out


def _sieve(codes: np.ndarray) -> np.ndarray:
    """Each code's place among 2**20."""
    return ((codes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int32)


class Kernel:
    """Likeness of units to the landmarks: the normalised gapped-triple kernel. Of units like one also which marks they hold."""

    def __init__(self, landmarks: list[str], marks: list[int]):
        self.landmarks, self.marks = landmarks, marks
        self.mark_at = {slot: i for i, slot in enumerate(marks)}
        dense, self.used = _vectors(landmarks)
        self.sieve = np.zeros(1 << 20, dtype=bool)
        self.sieve[_sieve(self.used)] = True
        self.table = dense.T.copy()
        self.seen: dict[str, int] = {}
        self.alarming: set[str] = set()
        self.active = np.zeros((0, len(landmarks)), dtype=np.float32)
        self.marked: list[list[int]] = []  # by the number of the active unit

    def __getstate__(self) -> dict:
        return {"landmarks": self.landmarks, "marks": self.marks}

    def __setstate__(self, state: dict) -> None:
        self.__init__(state["landmarks"], state["marks"])

    def likeness(self, units: list[str]) -> np.ndarray:
        codes, weights = _codes(units)
        out = np.zeros((len(units), len(self.landmarks)), dtype=np.float32)
        if not codes.size:
            return out
        if not len(self.used):
            return out
        places = np.full(codes.shape, -1, dtype=np.int32)
        maybe = np.nonzero((codes >= 0) & self.sieve[_sieve(codes)])
        asked = codes[maybe]
        at = np.minimum(np.searchsorted(self.used, asked), len(self.used) - 1)
        places[maybe] = np.where(self.used[at] == asked, at, -1)
        # two triples in common, or the only one that a unit of three letters has
        hits = np.flatnonzero((places >= 0).sum(axis=1) >= np.clip((codes >= 0).sum(axis=1), 1, 2))
        if not len(hits):
            return out
        rows, columns = np.nonzero(places[hits] >= 0)
        parts = self.table[places[hits][rows, columns]] * weights[columns, None].astype(np.float32)
        starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        out[hits] = np.add.reduceat(parts, starts, axis=0) / _norms(codes[hits], weights)[:, None]
        return out

    def trim(self) -> None:
        """Forget everything once the memory is full; called between batches only."""
        if len(self.seen) > CACHE:
            self.seen, self.alarming, self.active, self.marked = {}, set(), self.active[:0], []

    def learn(self, units: list[str]) -> None:
        """Remember each unit's row of likeness, or -1 if it is like no landmark."""
        units = sorted(units, key=len)  # like lengths share narrow arrays
        for start in range(0, len(units), LEARNT_AT_ONCE):
            part = units[start : start + LEARNT_AT_ONCE]
            rows = self.likeness(part)
            rows[rows < ACTIVE] = 0
            is_active = rows.any(axis=1)
            numbers = np.where(is_active, len(self.active) + np.cumsum(is_active) - 1, -1)
            if is_active.any():
                self.active = np.concatenate([self.active, rows[is_active]])
                found = [u for u, yes in zip(part, is_active, strict=True) if yes]
                self.alarming.update(found)
                self.marked += [[self.mark_at[x] for x in _traits(u).tolist() if x in self.mark_at] for u in found]
            self.seen.update(zip(part, numbers.tolist(), strict=True))

    def pooled(self, sentence: list[str]) -> np.ndarray | None:
        """For each landmark the greatest likeness in the sentence; None if no unit is active. Units must be learnt."""
        numbers = [n for n in map(self.seen.__getitem__, sentence) if n >= 0]
        return self.active[numbers].max(axis=0) if numbers else None

    def amount(self, text: Parsed) -> np.ndarray:
        """For each mark the logarithm of the number of active units that hold it, and one more."""
        held = [i for line in text.sentences() for n in map(self.seen.__getitem__, line) if n >= 0 for i in self.marked[n]]
        return np.log1p(np.bincount(held, minlength=len(self.marks)))


def _beyond_doubt(margin):
    """0 for a sentence that is clean by the full margin, 2 for one that is toxic by it."""
    return np.clip(margin, -1.0, 1.0) + 1.0


@dataclass
class Model:
    kernel: Kernel
    weights: np.ndarray  # over the likeness to the landmarks, the Nyström map folded in
    bias: float
    totals: np.ndarray  # over a document's amounts of the marks
    worst: float  # over its largest sentence margin
    base: float  # of a document without any active unit
    slope: float
    shift: float

    def margins(self, texts: list[str]) -> np.ndarray:
        """Each text's margin, by its most suspicious sentence and by how often it holds each mark."""
        kernel = self.kernel
        kernel.trim()
        out = np.full(len(texts), self.base)
        parsed = [Parsed(t) for t in texts]
        kernel.learn(list(set().union(*(p.units for p in parsed)).difference(kernel.seen)))
        for at, text in enumerate(parsed):
            if kernel.alarming.isdisjoint(text.units):
                continue
            pooled = [found for found in map(kernel.pooled, text.sentences()) if found is not None]
            most = max(float(found @ self.weights) + self.bias for found in pooled)
            out[at] = self.base + self.worst * float(_beyond_doubt(most)) + float(kernel.amount(text) @ self.totals)
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(texts) + self.shift, -40, 40)))


#: Traits are counted in so many slots; where two share one, both lose a little of their weight.
SLOTS = 1 << 22


def _traits(unit: str) -> np.ndarray:
    """What may mark a unit: itself, its beginnings and its runs of three and four letters, as slot numbers."""
    names = {f"={unit}", *(f"^{unit[:n]}" for n in (3, 4, 5, 6)), *(unit[i : i + 3] for i in range(len(unit) - 2)), *(unit[i : i + 4] for i in range(len(unit) - 3))}
    return np.array([zlib.crc32(name.encode("utf-8", "surrogatepass")) % SLOTS for name in names], dtype=np.int32)


class _UnitTraits:
    """The traits of all units of some texts, end to end in one array, as places among the slots that occur."""

    def __init__(self, parsed: list[Parsed]):
        self.row: dict[str, int] = {}
        flat, ends = array("i"), array("q", [0])
        for text in parsed:
            for unit in text.units:
                if unit not in self.row:
                    self.row[unit] = len(self.row)
                    flat.frombytes(_traits(unit).tobytes())
                    ends.append(len(flat))
        self.flat, self.ends = np.frombuffer(flat, dtype=np.int32), ends
        present = np.zeros(SLOTS, dtype=bool)
        present[self.flat] = True
        self.slots = np.flatnonzero(present)
        place = np.cumsum(present, dtype=np.int32)
        for start in range(0, len(flat), 1 << 18):
            self.flat[start : start + (1 << 18)] = place[self.flat[start : start + (1 << 18)]] - 1

    def of(self, unit: str) -> np.ndarray:
        row = self.row[unit]
        return self.flat[self.ends[row] : self.ends[row + 1]]

    def among(self, chosen: np.ndarray) -> dict[str, np.ndarray]:
        """For each unit with a chosen trait the positions of its traits in ``chosen``."""
        column = np.full(len(self.slots), -1, dtype=np.int16)
        column[chosen] = np.arange(len(chosen))
        hit = column[self.flat]
        own = ((unit, hit[self.ends[row] : self.ends[row + 1]]) for unit, row in self.row.items())
        return {unit: found for unit, columns in own if len(found := columns[columns >= 0].astype(np.int64))}


def _evidence(toxic: np.ndarray, clean: np.ndarray, share: float) -> np.ndarray:
    """Log likelihood ratio of a trait's documents against the share of toxic ones; 0 where the trait goes with clean ones."""
    toxic, clean = toxic.astype(float), clean.astype(float)
    total = toxic + clean
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.where(toxic > 0, toxic * np.log(toxic / total / share), 0.0) + np.where(clean > 0, clean * np.log(clean / total / (1 - share)), 0.0)
    return np.where(toxic > share * total, ratio, 0.0)


def _suspects(parsed: list[Parsed], labels: np.ndarray) -> tuple[list[str], list[int]]:
    """Units of toxic documents with a trait that goes with toxic documents more than chance explains, strongest first, and these traits, the marks.

    A trait counts as standing in a document at least once, twice or three times, whatever its evidence is strongest
    for. The strongest trait's units are put aside before the next is chosen, so that a run of letters does not seem
    telling, and make ordinary words suspect, just because a telling word holds it.
    """
    share = labels.mean()
    traits = _UnitTraits(parsed)
    counts = np.zeros((LEVELS, 2, len(traits.slots)), dtype=np.uint16)  # clean, toxic; at most as many as documents are fitted on
    for text, label in zip(parsed, labels, strict=True):
        own = text.counts()
        if not own:
            continue
        places = [traits.of(u) for u in own]
        slots, inverse = np.unique(np.concatenate(places), return_inverse=True)
        often = np.bincount(inverse, weights=np.repeat(list(own.values()), list(map(len, places))))
        for level in range(LEVELS):
            counts[level, int(label), slots[often > level]] += 1
    some = np.flatnonzero(counts[0, 1])
    strength = np.max([_evidence(counts[level, 1, some], counts[level, 0, some], share) for level in range(LEVELS)], axis=0)
    del counts
    ranked = np.lexsort((some, -strength))[:TRAITS]
    chosen = some[ranked[strength[ranked] >= EVIDENCE]]
    if not len(chosen):
        return [], []
    marked = traits.among(chosen)
    chosen = traits.slots[chosen]
    del traits
    held = np.zeros((len(parsed), len(chosen)), dtype=np.int32)
    places: dict[str, array] = {}  # a document and how often, again and again
    for at, text in enumerate(parsed):
        for unit, n in text.counts().items():
            if unit in marked:
                places.setdefault(unit, array("i")).extend((at, n))
                held[at, marked[unit]] += n
    owners: dict[int, list[str]] = {}
    for unit in sorted(places):
        for i in marked[unit]:
            owners.setdefault(int(i), []).append(unit)
    toxic = labels == 1
    value: dict[str, float] = {}
    marks: list[int] = []

    def evidence(columns: np.ndarray) -> np.ndarray:
        part = held[:, columns]
        return np.max([_evidence((part[toxic] > level).sum(axis=0), (part[~toxic] > level).sum(axis=0), share) for level in range(LEVELS)], axis=0)

    width = np.array([len(owners.get(i, ())) for i in range(len(chosen))])
    now = np.concatenate([evidence(np.arange(i, min(i + 100, len(chosen)))) for i in range(0, len(chosen), 100)])
    for _ in range(MARKS):
        if now.max() < EVIDENCE:
            break
        alike = np.flatnonzero(now >= max(EVIDENCE, 0.98 * now.max()))
        pick = int(alike[width[alike].argmin()])  # of traits that say the same the one that fewest different units have
        marks.append(int(chosen[pick]))
        gone = [u for u in owners[pick] if u not in value]
        touched: set[int] = {pick}
        for unit in gone:
            value[unit] = float(now[pick])
            touched.update(marked[unit].tolist())
            for at, n in zip(places[unit][::2], places[unit][1::2], strict=True):
                held[at, marked[unit]] -= n
        columns = np.array(sorted(touched))
        now[columns] = evidence(columns)
    bad = {u for u in value if any(toxic[at] for at in places[u][::2])}
    return sorted(bad, key=lambda u: (-value[u], u))[:CANDIDATES], marks


def _originals(parsed: list[Parsed], sketch: int = 16, shared: int = 6) -> list[int]:
    """Positions of texts that are no near copy of an earlier one; else a group of copies would make all its words look telling.

    A text's sketch is the least hashes of its runs of three words; copies share many of them.
    """
    owners: dict[int, list[int]] = {}
    kept = []
    for at, text in enumerate(parsed):
        words = text.plain.split()
        runs = {zlib.crc32(" ".join(words[i : i + 3]).encode("utf-8", "surrogatepass")) for i in range(max(1, len(words) - 2))}
        least = heapq.nsmallest(sketch, runs)
        meets = Counter(o for h in least for o in owners.get(h, ()))
        if meets and max(meets.values()) >= min(shared, max(len(least) // 2, 1)):
            continue
        kept.append(at)
        for h in least:
            owners.setdefault(h, []).append(at)
    return kept


def _landmarks(parsed: list[Parsed], labels: np.ndarray) -> tuple[list[str], list[int]]:
    """Suspects that together resemble all suspects as closely as possible, chosen one by one, and the marks."""
    suspects, marks = _suspects(parsed, labels)
    if not suspects:
        return [], []
    alike = _alike(suspects)
    held = Counter(u for text, label in zip(parsed, labels, strict=True) if label for u in text.units)
    weight = np.log1p([held[u] for u in suspects])
    best, chosen = np.zeros(len(suspects)), []
    while len(chosen) < min(LANDMARKS, len(suspects)):
        gain = weight @ np.maximum(alike - best[:, None], 0)
        pick = int(gain.argmax())
        if gain[pick] <= 0.05:
            break
        chosen.append(pick)
        best = np.maximum(best, alike[:, pick])
    return [suspects[i] for i in chosen], marks


def _features(chosen: list[str], marks: list[int], parsed: list[Parsed]) -> tuple[Kernel, np.ndarray, np.ndarray, np.ndarray]:
    """The sentences with an active unit, by their likeness to the landmarks, whose document each belongs to, and the documents' amounts."""
    kernel, rows, owner = Kernel(chosen, marks), [], []
    amounts = np.zeros((len(parsed), len(marks)))
    kernel.learn(sorted(set().union(*(p.units for p in parsed))))
    for at, text in enumerate(parsed):
        if kernel.alarming.isdisjoint(text.units):
            continue
        amounts[at] = kernel.amount(text)
        for sentence in text.sentences():
            found = kernel.pooled(sentence)
            if found is not None:
                rows.append(found)
                owner.append(at)
    return kernel, np.array(rows, dtype=float).reshape(-1, len(chosen)), np.array(owner, dtype=np.int64), amounts


def _telling_alone(features: np.ndarray, owner: np.ndarray, y: np.ndarray, originals: list[int], close: float = 0.75, purity: float = 0.8) -> np.ndarray:
    """For each landmark the toxic documents with something close to it, 0 if these are less than this share of all such documents."""
    near = np.zeros((len(y), features.shape[1]), dtype=bool)
    np.logical_or.at(near, owner, features >= close)
    near = near[originals]
    toxic = near[y[originals] == 1].sum(axis=0)
    return np.where(toxic >= purity * near.sum(axis=0), toxic, 0)


def fit(texts: list[str], labels: list[int], share: float | None = None) -> Model:
    """Fit the model on labelled documents, of which ``share`` are toxic where they come from; None: as many as here.

    A document's label is that of its sentences to begin with; after each round a toxic document answers only for the
    sentences that the machine itself finds toxic, or for the most suspicious one. Landmarks whose mere presence tells are
    toxic sentences of their own, with half the weight, so that none leans on the words it usually stands with. Sentences are mapped by the landmarks
    (Nyström) and separated by a linear machine with hinge loss. A second one separates documents, by the largest
    margin of their sentences and by how often they hold each mark in all, since a stem that stands in ordinary
    words too may be telling by its number alone. Its margins become probabilities by a logistic fit.
    """
    y = np.array(labels, dtype=np.int64)
    prior = (y.sum() + 0.5) / (len(y) + 1) if share is None else min(max(share, 1e-6), 1 - 1e-6)
    flat = Model(Kernel([], []), np.zeros(0), 0.0, np.zeros(0), 0.0, 0.0, 0.0, float(np.log(prior / (1 - prior))))
    if not len(y) or y.min() == y.max():
        return flat
    parsed, known = [], {}
    for text in texts:
        one = Parsed(text)
        one.units = tuple(known.setdefault(u, u) for u in one.units)  # one object for each different word; a set takes ten times a tuple's room
        parsed.append(one)
    del known
    originals = _originals(parsed)
    chosen, marks = _landmarks([parsed[i] for i in originals], y[originals])
    if not chosen:
        return flat
    kernel, features, owner, amounts = _features(chosen, marks, parsed)
    if not len(features):
        return flat
    gram = kernel.likeness(chosen).astype(float)
    values, basis = np.linalg.eigh((gram + gram.T) / 2)
    root = basis @ np.diag(1 / np.sqrt(np.maximum(values, 0.05))) @ basis.T
    mapped = features @ root
    alone = _telling_alone(features, owner, y, originals)
    single = np.where(gram >= ACTIVE, gram, 0)[alone > 0] @ root
    alone = alone[alone > 0] / max(alone.sum(), 1)
    toxic = y[owner] == 1
    positive = toxic.copy()
    weight, bias = np.zeros(mapped.shape[1]), 0.0
    for _ in range(4):
        use = positive | ~toxic
        x, sign = mapped[use], np.where(positive[use], 1.0, -1.0)
        even = np.where(sign > 0, 0.5 / max((sign > 0).sum(), 1), 0.4 / max((sign < 0).sum(), 1))
        if len(single):
            even = np.r_[np.where(sign > 0, even / 2, even), alone / 4]
            x, sign = np.concatenate([x, single]), np.r_[sign, np.ones(len(single))]
        weight, bias = _hinge(x, sign, even)
        margin = mapped @ weight + bias
        positive = toxic & (margin > 0)
        for document in np.setdiff1d(owner[toxic], owner[positive]):
            own = np.flatnonzero(owner == document)
            positive[own[margin[own].argmax()]] = True
    most = np.full(len(y), -1.0)
    np.maximum.at(most, owner, mapped @ weight + bias)
    design = np.column_stack([amounts, _beyond_doubt(most)])
    sign = np.where(y == 1, 1.0, -1.0)
    whole_weight, base = _hinge(design, sign, np.where(sign > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum())))
    model = Model(kernel, root @ weight, float(bias), whole_weight[:-1], float(whole_weight[-1]), float(base), 1.0, 0.0)
    model.slope, model.shift = _logistic(design @ whole_weight + base, y, y.mean() if share is None else share)
    return model


def _hinge(x: np.ndarray, sign: np.ndarray, share: np.ndarray, penalty: float = 1e-3, rounds: int = 600) -> tuple[np.ndarray, float]:
    """Weighted hinge loss with a quadratic penalty, by averaged subgradient steps. The empty sentence counts as clean."""
    weight, bias = np.zeros(x.shape[1]), 0.0
    sum_w, sum_b = np.zeros_like(weight), 0.0
    for t in range(rounds):
        step = 2.0 / (1 + 0.02 * t)
        open_ = sign * (x @ weight + bias) < 1
        slope = share * sign * open_
        weight = weight + step * (slope @ x - penalty * weight)
        bias = bias + step * (slope.sum() - 0.1 * (bias > -1))
        if t >= rounds // 2:
            sum_w, sum_b = sum_w + weight, sum_b + bias
    n = rounds - rounds // 2
    return sum_w / n, sum_b / n


def _logistic(margin: np.ndarray, y: np.ndarray, share: float, rounds: int = 200) -> tuple[float, float]:
    """Slope and shift of a logistic curve through the margins, by Newton steps; a light penalty keeps separable data finite.

    Toxic and clean documents are weighted back to the share of toxic ones where they come from.
    """
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    a, b = 1.0, 0.0
    design = np.stack([margin, np.ones_like(margin)], axis=1)
    soft = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        gradient = design.T @ (weight * (p - soft)) + np.array([0.01 * a, 0.0])
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + np.eye(2) * 1e-2
        step = np.linalg.solve(hessian, gradient)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(min(max(a, 1e-3), 20.0)), float(b)


def learning_row(id_col: Column) -> Column:
    """Rows that may be learnt from; the others are held out."""
    return F.crc32(F.encode(id_col.cast("string"), "utf-8")) % 4 != 2


def fit_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_toxic: int = FIT_TOXIC, most_clean: int = FIT_CLEAN, most_bytes: int = FIT_BYTES) -> Model:
    """Fit on labelled documents that are not held out: of each label those that come first in the order of a hash of the id, up to a bound.

    At most most_toxic and most_clean rows, whose texts have together no more than most_bytes, are learnt from, also
    where ids are repeated. They meet in one task, never in the driver, to which only the fitted model comes. The bounds
    change the mix of labels, so scores are weighted back to that of all learning rows, and mean the same whatever the
    size of the input.
    """
    marked = labels.where(F.col(label_col).isNotNull() & F.coalesce(learning_row(F.col(id_col)), F.lit(False))).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    sums = marked.agg(F.sum((F.col("label") == 1).cast("long")).alias("toxic"), F.sum((F.col("label") == 0).cast("long")).alias("clean")).first()
    toxic, clean = sums["toxic"] or 0, sums["clean"] or 0
    order = [F.xxhash64("id"), F.col("id")]
    first = lambda rows: rows.where("label = 1").orderBy(*order).limit(most_toxic).unionByName(rows.where("label = 0").orderBy(*order).limit(most_clean))
    texts = docs.select(F.col(id_col).alias("own_id"), whole(text_col).alias("text"))
    chosen = texts.join(F.broadcast(first(marked)), F.col("own_id") == F.col("id")).select("id", "label", "text")  # at most most_toxic + most_clean ids
    slim = first(chosen.select("id", "label", F.octet_length("text").cast("long").alias("bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha")))
    ahead = Window.partitionBy(F.lit(0)).orderBy(*order, "label", "sha")  # over at most most_toxic + most_clean rows
    fits = slim.withColumn("upto", F.sum("bytes").over(ahead)).where(F.col("upto") <= most_bytes).select("id", "label", "sha", F.row_number().over(ahead).alias("at"))
    keyed = chosen.withColumn("sha", F.sha2(F.col("text").cast("binary"), 256))
    rows = keyed.dropDuplicates(["id", "label", "sha"]).join(F.broadcast(fits), ["id", "label", "sha"])
    share = (toxic + 0.5) / (toxic + clean + 1)

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        rows = pd.concat(parts).sort_values("at") if parts else pd.DataFrame({"text": [], "label": []})
        yield pd.DataFrame({"model": [pickle.dumps(fit(rows["text"].tolist(), rows["label"].tolist(), share))]})

    learnt = rows.select("text", "label", "at").coalesce(1).mapInPandas(lambda batches: giving_back(learn(batches)), "model binary").collect()  # one row, a few hundred kilobytes
    return pickle.loads(bytes(learnt[0]["model"])) if learnt else fit([], [], share)


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """docs with ``score`` and ``predicted``, learnt from ``labels``.

    The kernel compares words by their letter triples, gaps allowed, so inserted letters, inflections and words spelled
    out letter by letter stay close to a landmark. Only the text enters a score. Null texts count as empty; an empty
    text gets the score of a sentence without any suspicion. Repeated rows are scored each; without usable labels every
    score is the share of toxic labels; an empty table gives no rows. Very long texts are read whole, sentence by
    sentence. Extra columns stay; only columns named score or predicted are replaced by the operator's own.
    """
    model = fit_documents(docs, labels, id_col, text_col, label_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")  # by Arrow, so that a few texts are Python strings at a time
    def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value  # kept by the Python worker, with the words it has learnt
        for texts in giving_back(parts):
            out = [own.scores(part.to_pylist()) for part in in_slices([texts])]
            del texts
            yield pa.array(np.concatenate(out) if out else np.zeros(0))

    scored = docs.withColumn("score", score(whole(text_col)))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are not predicted toxic, with all their columns, whatever their names.

    Nulls, empty and very long texts, repeated rows and empty tables are as in score_documents.
    """
    aside = {c: f"own_{i}_{c}" for i, c in enumerate(docs.columns) if c.lower() in ("score", "predicted")}
    scored = score_documents(docs.withColumnsRenamed(aside), labels, id_col, text_col, threshold=threshold)
    return scored.where("predicted = 0").select(*(F.col(aside.get(c, c)).alias(c) for c in docs.columns))
