"""Language identification, bit-sliced search and the filter audit against plain definitions, with odd rows."""

import math
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from evidara.llm import bitsliced, filter_audit, langid

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, n long, key long, id long, part string, terms string, query long, label string"
EXTRA = (7, 7, 7, "p", "t", 7, "l")


def frame(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], COLUMNS).repartition(3)


# --- language identification


def sound(rng, syllables, n):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


TONGUES = {"xa": ["ka", "lo", "mi", "tan", "res"], "xb": ["sch", "ung", "ein", "ö", "mi"], "xc": ["que", "ère", "on", "tan", "é"]}


def plain_kneser_ney(texts, order):
    """p(code point | context) of one language, from the definition, with dictionaries."""
    raw = [Counter() for _ in range(order + 1)]
    for text in texts:
        for word in re.findall(r"[^\W\d_]+", text.lower()):
            line = langid.EDGE + word + langid.EDGE
            for end in range(1, len(line)):
                for k in range(1, order + 1):
                    if end - k + 1 >= 0:
                        raw[k][line[end - k + 1 : end + 1]] += 1
    adjusted = [None] * (order + 1)
    adjusted[order] = raw[order]
    for k in range(1, order):
        left = Counter(g[1:] for g in raw[k + 1])
        adjusted[k] = Counter({g: n if k > 1 and g[0] == langid.EDGE else left[g] for g, n in raw[k].items()})
    discount, totals, types = {}, {}, {}
    for k in range(1, order + 1):
        ones, twos = sum(v == 1 for v in adjusted[k].values()), sum(v == 2 for v in adjusted[k].values())
        discount[k] = ones / (ones + 2 * twos) if ones and twos else 0.5
        totals[k], types[k] = Counter(), Counter()
        for g, n in adjusted[k].items():
            totals[k][g[:-1]] += n
            types[k][g[:-1]] += 1

    def p(char, context, alphabet):
        k = len(context) + 1
        below = p(char, context[1:], alphabet) if context else 1 / (alphabet + 1)
        if not totals[k][context]:
            return below
        return max(adjusted[k][context + char] - discount[k], 0) / totals[k][context] + discount[k] * types[k][context] / totals[k][context] * below

    return p, set("".join(raw[1]))


def test_models_equal_plain_kneser_ney(spark):
    rng = random.Random(3)
    texts = {name: [sound(rng, parts, 40) for _ in range(5)] for name, parts in TONGUES.items()}
    rows = pd.DataFrame([(i, t) for i, name in enumerate(texts) for t in texts[name]], columns=["lang", "text"])
    counts = pd.concat(langid.count_grams(iter([rows.iloc[:8], rows.iloc[8:]])))
    counts = counts.groupby(["order", "lang", "gram"], as_index=False).agg({"context": "first", "rest": "first", "starts": "first", "n": "sum"})
    model = langid.kneser_ney(counts, 3)
    model = langid.Model.from_bytes(model.to_bytes())
    plain = [plain_kneser_ney(texts[name], langid.ORDER) for name in texts]
    alphabet = set().union(*(letters for _, letters in plain))
    words = ["kalomi", "schungein", "queère", "zzz", "tanzzres", "a", "misch"] + texts["xa"][0].split()
    got, lengths = model.score_words(words)
    for word, row, length in zip(words, got, lengths):
        line = langid.EDGE + word + langid.EDGE
        for lang, (p, _) in enumerate(plain):
            want = sum(math.log(p(line[e], line[max(0, e - langid.ORDER + 1) : e], len(alphabet))) for e in range(1, len(line)))
            assert row[lang] == pytest.approx(want, rel=1e-4), (word, lang)
        assert length == len(word) + 1
    for p, _ in plain:  # each history's probabilities sum to one, a code point not seen included
        for history in ("", langid.EDGE, "ka", langid.EDGE + "sch", "zzzz"):
            assert sum(p(c, history, len(alphabet)) for c in [*alphabet, "\0"]) == pytest.approx(1)


def test_identify_documents(spark):
    rng = random.Random(4)
    rows = [(i, sound(rng, TONGUES[name], rng.choice([8, 30, 90])), name, "s", 0) for i, name in enumerate(sorted(TONGUES) * 80)]
    odd = [(900, None, "xa", "s", 0), (901, "", "xb", "s", 0), (902, "12 ²² --_ 7", "xa", "s", 0), (903, "Γειά σου κόσμε " * 30, None, "s", 0), (None, "kalo mitan", "xa", None, None), rows[0], (904, sound(rng, TONGUES["xc"], 40_000), None, "s", 0), (905, "ö", None, "s", 0)]
    docs = frame(spark, rows + odd)
    learnt = langid.fit(docs.where(langid.learning_row(F.col("doc_id"))))
    out = langid.identify_documents(docs, learnt)
    assert out.columns == ["doc_id", "lang_pred", "score", "cross_entropy", "rejected"]
    got = out.collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows + odd)
    told = {r["doc_id"]: r for r in got}
    truth = {r[0]: r[2] for r in rows}
    held_out = [i for i in truth if __import__("zlib").crc32(str(i).encode()) % 5 == 0]
    assert len(held_out) > 20 and sum(told[i]["lang_pred"] == truth[i] for i in held_out) / len(held_out) >= 0.97
    assert all(told[i]["lang_pred"] == "und" and told[i]["score"] == 0 and told[i]["rejected"] and told[i]["cross_entropy"] is None for i in (900, 901, 902))
    assert told[903]["rejected"] and told[903]["lang_pred"] in TONGUES
    assert told[904]["lang_pred"] == "xc" and not told[904]["rejected"] and told[905]["lang_pred"] == "xb"
    assert all(0 <= r["score"] <= 1 for r in got)
    again = {r["doc_id"]: tuple(r) for r in langid.identify_documents(docs, langid.fit(docs.where(langid.learning_row(F.col("doc_id"))))).collect()}
    assert again == {k: tuple(v) for k, v in told.items()}


def test_no_language_and_no_rows(spark):
    nothing = frame(spark, [(1, "a b", None, "s", 0)])
    assert langid.fit(nothing) is None and langid.fit(nothing.limit(0)) is None
    assert [tuple(r) for r in langid.identify_documents(nothing, None).collect()] == [(1, "und", 0.0, None, True)]
    assert langid.identify_documents(nothing.limit(0), None).count() == 0
    wordless = frame(spark, [(i, t, "xa", "s", 0) for i, t in enumerate([None, "", "1 2"])])
    assert langid.fit(wordless) is None


def test_long_text_in_pieces(monkeypatch):
    rows = pd.DataFrame({"lang": [0, 0], "text": ["ka lo mi " * 50, "mi ka"]})
    total = lambda: pd.concat(langid.count_grams(iter([rows]))).groupby(["order", "gram"])["n"].sum()
    whole = total()
    monkeypatch.setattr(langid, "CHUNK", 20)
    assert total().equals(whole)


# --- ranked search


def plain_ranking(docs, items, k):
    def terms(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    held = [(i, terms(t)) for i, t in docs]
    n_docs, length = sum(bool(t) for _, t in held), sum(len(t) for _, t in held)
    df = Counter(w for _, t in held for w in set(t))
    out = []
    for item, text in items:
        scored = []
        for doc, words in held:
            tf, m = Counter(words), 25 + (75 * len(words) * n_docs) // max(length, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * tf[w]) // (1000 * tf[w] + 8 * m)) for w in terms(text) if tf[w])
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(item, rank, None if null else doc, -score) for rank, (score, null, doc) in enumerate(sorted(scored)[:k], 1)]
    return out


def test_ranking_equals_plain_ranking(spark):
    rng = random.Random(5)
    vocabulary = [f"{a}{b}" for a in "abcdefgh" for b in ("x", "é", "7", "Yz")]
    texts = [" ".join(rng.choices(vocabulary, range(1, len(vocabulary) + 1), k=rng.choice([1, 5, 40, 300]))) for _ in range(230)]
    docs = [(i * 3, t) for i, t in enumerate(texts)]
    docs += [(1000 - i, "hx hx, GX_fé") for i in range(90)]  # many ties over several blocks
    docs += [(None, "hx hx, GX_fé"), (None, "ax only"), (5, None), (7, ""), (8, "!? --"), docs[3], docs[3], (9, "hx " * 50_000), (-4, "zé İ zé")]
    items = [(1, "hx gx FÉ Fé hx"), (2, None), (2, "absent words"), (3, "ax ax ax"), (4, texts[5]), (4, texts[6]), (5, "zé"), (5, "zé"), (None, "h7"), (6, " ".join(vocabulary) * 2)]
    own = frame(spark, [(i, t, "en", "s", 0) for i, t in docs])
    asked = spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id long, text string, doc_id long, terms string")
    want = Counter(plain_ranking(docs, items, 10))
    for settings in ({"block_docs": 64}, {"block_docs": 16384}, {"block_docs": 64, "query_bytes": 40}):
        out = bitsliced.rank_documents(own, asked, **settings)
        assert out.columns == ["item_id", "rank", "doc_id", "score"]
        assert Counter(map(tuple, out.collect())) == want, settings
    assert bitsliced.rank_documents(own.limit(0), asked).count() == 0
    assert bitsliced.rank_documents(own, asked.limit(0)).count() == 0


def test_slices_add_and_rank_as_integers():
    rng = np.random.default_rng(6)
    for _ in range(20):
        sums, total = np.zeros(128, np.int64), []
        for _ in range(rng.integers(1, 9)):
            places = np.sort(rng.choice(128, rng.integers(1, 128), replace=False))
            impacts = rng.integers(1, 1 << rng.integers(1, 40), len(places))
            sums[places] += impacts
            bitsliced.add_slices(total, bitsliced.expand(*bitsliced.slice_impacts(places, impacts), 128))
        assert [sum((bits >> d & 1) << s for s, bits in enumerate(total)) for d in range(128)] == list(sums)
        best = sorted((-v, d) for d, v in enumerate(sums) if v > 0)[:10]
        assert sorted(bitsliced.top_places(total, 10, 128)) == sorted(d for _, d in best)


# --- filter audit


def plain_audit(docs, labels):
    first, known = {}, defaultdict(lambda: (0, 0))
    for doc, text, _ in docs:
        if doc is not None:
            first[text or ""] = min(first.get(text or "", doc), doc)
    for doc, quality, toxic in labels:
        if doc is not None:
            known[doc] = max(known[doc][0], quality or 0), max(known[doc][1], toxic or 0)
    failed = defaultdict(list)
    for doc, text, part in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": doc is not None and first[t] < doc}
        failed[part or ""].append(({f for f in fails if fails[f]}, known[doc] if doc is not None else (0, 0)))
    out = {}
    for part, rows in failed.items():
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                early = set(order[: step - 1])
                here = [known_as for fails, known_as in rows if f in fails and not fails & early]
                shapley[f] += len(here)
                out[part, order, step] = [sum(not fails & (early | {f}) for fails, _ in rows), len(here), sum(f in fails and bool(fails & early) for fails, _ in rows), sum(fails == {f} for fails, _ in rows), sum(q == 1 for q, _ in here), sum(t == 1 for _, t in here)]
        for (own, order, step), row in out.items():
            if own == part:
                row.append(shapley[order[step - 1]])
    return {key: tuple(row) for key, row in out.items()}


def audit_rows():
    rng = random.Random(8)
    plain = [" ".join(rng.choice(["one", "two", "Three", "FOUR", "five%"]) + rng.choice(["", str(rng.randint(0, 99))]) for _ in range(rng.choice([3, 150, 220, 400]))) for _ in range(60)]
    long = "ab c " * 40_000
    texts = plain + plain[:20] + [plain[0]] * 15 + [None, "", None, "same length 1", "same length 2", long, long, long[:-2] + "d ", "é" * 300, "é" * 300]
    docs = [(i * 7 % 211, t, rng.choice(["a", "b", None, ""])) for i, t in enumerate(texts)]
    docs += [docs[4], docs[4], (None, plain[3], "a"), (None, "alone", "a"), (None, "alone", "b"), (docs[5][0], "used id", "b")]
    labels = [(i, rng.randint(0, 1), rng.randint(0, 1)) for i in range(0, 200, 2)] + [(4, 1, None), (None, 1, 1), (6, None, 1)]
    return docs, labels


@pytest.mark.parametrize("weak", [False, True])
def test_audit_equals_plain_audit(spark, monkeypatch, weak):
    docs, labels = audit_rows()
    if weak:  # all texts of some lengths collide, and every class is joined by a shuffle
        monkeypatch.setattr(filter_audit, "class_key", lambda length, blocks: F.pmod(length, F.lit(3)).cast("long"))
        monkeypatch.setattr(filter_audit, "BROADCAST_KEYS", 0)
        monkeypatch.setattr(filter_audit, "LARGE_CLASSES", 3)
    own = frame(spark, [(i, t, "en", s, 0) for i, t, s in docs])
    out = filter_audit.audit_filters(own, spark.createDataFrame([(*r, 1) for r in labels], "doc_id long, quality int, toxic int, n long"))
    got = {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in out.collect()}
    assert got == plain_audit(docs, labels)
    assert [t for _, t in out.dtypes] == ["string", "string", "int"] + ["bigint"] * 7


def test_audit_of_nothing(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = frame(spark, [(1, "x", "en", "s", 0)])
    assert filter_audit.audit_filters(docs.limit(0), labels).count() == 0
    assert {r["good_lost"] for r in filter_audit.audit_filters(docs, labels).collect()} == {0}


def test_blocks_cover_texts(spark):
    texts = ["", "a", "x" * 256, "x" * 257, "x" * 4096, "x" * 4097, "x" * 70_000, "x" * 69_999 + "y"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(filter_audit.block_hashes(F.col("text")).alias("b")).collect()
    assert [len(r["b"]) for r in rows] == [1, 1, 1, 2, 2, 3, 4, 4]
    assert len({tuple(r["b"]) for r in rows}) == len(texts) and rows[6]["b"][:3] == rows[7]["b"][:3]
