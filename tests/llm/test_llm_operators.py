"""The ten operators against brute force on a small table with nulls, copies, ties, odd rows and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from evidara.llm import exact_dedup, fingerprint, html_extract, katz, mixing, packing, sharding, simhash, toxicity, url_filter
from evidara.llm.queries import vocabulary_path

WORDS = "the of and to in is that for it was on are as with they be at one have this from or had by hot word but what some we can out other were all there when up use your how said an each she".split()
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, size long, row long, name string, bucket long"


def make_rows():
    rng = random.Random(7)
    texts = [" ".join(rng.choice(WORDS) for _ in range(rng.choice([3, 8, 40, 120, 700]))) for _ in range(70)]
    texts += [texts[0], texts[0], texts[3], texts[4] + " tail", "", None, " \t\n", "a", "Ä" * 5000, "x" * 4096, "x" * 4097, "x y " * 30000, "<|endoftext|> 'tis  two   three\n\n four"]
    rows = [(i, t, "en", rng.choice(["a", "b", "c", "c", "c", None]), None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[1], (5, "another text under a used id", "en", "a", 1), (None, "no id here", None, None, None), (None, None, None, None, None)]
    return [(*r, 1, 2, "n", 3) for r in rows]


ROWS = make_rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, COLUMNS).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_sharding(docs, nothing):
    rows = sharding.assign_shards(docs, 7).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in ROWS)
    sizes, slots = Counter(), defaultdict(list)
    for r in rows:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    share, largest = sum(sizes.values()) / 7, max(r["size"] for r in rows)
    assert all(abs(s - share) <= largest for s in sizes.values())
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    by_id = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["shard"]) for r in rows)
    assert [s for _, s in by_id] == sorted(s for _, s in by_id)
    assert sharding.assign_shards(nothing, 7).count() == 0


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(docs, nothing, monkeypatch, weak):
    if weak:  # a hash of two values crowds the buckets, so names must come from the ranks
        monkeypatch.setattr(exact_dedup, "_bucket", lambda value: F.pmod(F.xxhash64(value), F.lit(2)) * 256)
    rows = exact_dedup.exact_duplicates(docs, block_bytes=4096 if not weak else 40_000).collect()
    groups = defaultdict(list)
    for r in ROWS:
        groups[r[1] or ""].append(r[0])
    wanted = Counter()
    for text, ids in groups.items():
        best = max((i for i in ids if i is not None), default=None)
        wanted.update((i, best, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in rows) == wanted
    kept = Counter(r["text_sha256"] for r in rows if r["kept"])
    assert len(kept) == len(groups) and set(kept.values()) == {1}
    assert all(r["doc_id"] == r["keep_id"] for r in rows if r["kept"])
    if not weak:
        stay = exact_dedup.drop_exact_duplicates(docs)
        assert sorted(r["text"] or "" for r in stay.collect()) == sorted(groups) and stay.columns == docs.columns
        assert exact_dedup.exact_duplicates(nothing).count() == 0


def components(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    return {n: find(n) for n in nodes}


def simhash_of(text, shingle):
    found = words(lower(text))
    if not found:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(found[i : i + shingle]).encode(), 42) for i in range(max(1, len(found) - shingle + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(docs, nothing):
    got = Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    fps = [simhash_of(r[1], 3) for r in ROWS]
    different = sorted(set(fps))
    parts = components([(a, b) for i, a in enumerate(different) for b in different[:i] if bin(a ^ b).count("1") <= 2], different)
    least = defaultdict(list)
    for r, fp in zip(ROWS, fps, strict=True):
        if r[0] is not None:
            least[parts[fp]].append(r[0])
    assert got == Counter((r[0], f"{fp:016x}", min(least[parts[fp]], default=None)) for r, fp in zip(ROWS, fps, strict=True))
    assert simhash.near_duplicates(nothing).count() == 0


def test_trie_finds_every_close_pair():
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = [c ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False))) for c in centres for _ in range(12)]
    keys = np.unique(np.array(flips, dtype=np.uint64))
    pairs = {(i, j) for i in range(len(keys)) for j in range(i) if np.bitwise_count(keys[i] ^ keys[j]) <= 2}
    got = set()
    for a, b in simhash.trie_links(keys, 0, 2, spanning=False):
        got |= {(max(x, y), min(x, y)) for x, y in zip(a.tolist(), b.tolist(), strict=True)}
    assert got == pairs
    root = np.arange(len(keys))
    for a, b in simhash.trie_links(keys, 0, 2):
        root = simhash._join(root, a, b)
    parts = components(pairs, range(len(keys)))
    assert len(set(root)) == len(set(parts.values()))


def test_large_subtrees_are_dealt_again(spark):
    rng = random.Random(5)
    base = rng.getrandbits(64)
    fps = sorted({base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for _ in range(150)})
    signed = [(x - (1 << 64) if x >= 1 << 63 else x,) for x in fps]
    pairs = [(a, b) for i, a in enumerate(fps) for b in fps[:i] if bin(a ^ b).count("1") <= 2]
    wanted = components(pairs, fps)
    for limit in (3, 1 << 14):
        edges = simhash.fingerprint_links(spark.createDataFrame(signed, "fp long"), group_limit=limit).collect()
        got = components([(e["a"] % (1 << 64), e["b"] % (1 << 64)) for e in edges], fps)
        assert Counter(Counter(got.values()).values()) == Counter(Counter(wanted.values()).values())


def test_similar_documents(spark, nothing):
    rng = random.Random(1)
    originals = [[rng.choice(WORDS) + str(rng.randint(0, 300)) for _ in range(200)] for _ in range(30)]
    texts = [" ".join(t) for t in originals]
    for t in originals[:15]:
        changed = list(t)
        changed[rng.randint(0, 199)] = "other"
        texts.append(" ".join(changed))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(docs).collect()}
    assert all(got[30 + i] == i for i in range(15)) and all(got[i] == i for i in range(30))
    assert simhash.drop_near_duplicates(docs).count() == 30
    assert simhash.similar_documents(nothing).count() == 0


def test_similar_documents_around_the_threshold(spark):
    rng = random.Random(3)
    docs, wanted, other = [], [], []
    for similarity in (0.5, 0.6, 0.7, 0.75, 0.8, 0.83, 0.86, 0.9):
        for _ in range(25):
            base = [rng.choice(WORDS) + str(rng.randint(0, 999)) for _ in range(400)]
            n, changed = 396, list(base)
            tail = round(n * (1 - similarity) / (1 + similarity))  # so many shingles of either text are its own
            changed[400 - max(tail, 1) :] = [rng.choice(WORDS) + str(rng.randint(1000, 1999)) for _ in range(max(tail, 1))]
            sets = [{tuple(t[i : i + 5]) for i in range(n)} for t in (base, changed)]
            exact = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
            (wanted if exact >= 0.8 else other).append(len(docs))
            docs += [" ".join(base), " ".join(changed)]
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(frame).collect()}
    assert sum(got[i + 1] == i for i in wanted) >= 0.95 * len(wanted)
    assert all(got[i + 1] == i + 1 for i in other)


def test_hot_groups_and_large_subtrees_of_near_copies(spark, monkeypatch):
    rng = random.Random(8)
    base = [rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(300)]
    texts = []
    for i in range(120):
        own = list(base)
        own[rng.randint(0, 299)] = f"changed{i}"
        texts.append(" ".join(own))
    texts += [" ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(300)) for _ in range(20)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(simhash, "HOT_GROUP", 10)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(frame).collect()}
    assert [got[i] for i in range(140)] == [0] * 120 + list(range(120, 140))
    monkeypatch.setattr(simhash.similar_links, "__defaults__", (None, 5))
    monkeypatch.setattr(simhash, "HOT_GROUP", 1 << 10)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(frame).collect()}
    assert [got[i] for i in range(140)] == [0] * 120 + list(range(120, 140))


def test_near_dedup_keeps_one_row_of_each_group_whatever_the_ids(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(WORDS) + str(rng.randint(0, 300)) for _ in range(200)) for _ in range(7)]
    close = texts[4] + " other"
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (8, texts[4]), (None, close), (9, close), (3, texts[5]), (9, texts[6])]
    got = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter({rows[i] for i in (0, 1, 3, 4, 5, 8, 9)})


def test_mixing(docs, nothing):
    rows = mixing.mix(docs).collect()
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    size, taken, target = Counter(), Counter(), {}
    for r in rows:
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] <= 2 * r["size"] and r["source_size"] >= r["size"]
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((r[0], len(words(r[1]))) for r in ROWS)
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, goal, capped = 1.5 * sum(size.values()), {}, set()
    while True:
        left = total - sum(2 * size[s] for s in capped)
        share = left / max(sum(weight[s] for s in size if s not in capped), 1)
        goal = {s: 2 * size[s] if s in capped else weight[s] * share for s in size}
        above = {s for s in size if goal[s] > 2 * size[s]}
        if not above:
            break
        capped |= above
    for s in size:
        assert math.isclose(target[s], goal[s], rel_tol=1e-9) and abs(taken[s] - goal[s]) <= 1
    assert mixing.mix(nothing).count() == 0
    repeated = mixing.repeat_documents(docs)
    counts = Counter()
    for r in repeated.collect():
        counts[r["source"]] += len(words(r["text"]))
    assert repeated.columns == docs.columns and all(abs(counts[s] - taken[s]) <= len(rows) for s in size)


def test_packing(docs, nothing):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    ids = Counter()
    for r in ROWS:
        ids[(r[0], tuple(tokenizer.encode(r[1] or "", add_special_tokens=False).ids) + (1,))] += 1
    rows = packing.pack(docs, vocabulary_path()).collect()
    wanted = Counter()
    for (doc_id, own), n in ids.items():
        for at in range(0, len(own), 2048):
            part = own[at : at + 2048]
            wanted[(doc_id, at, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes()), len(own))] += n
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == wanted
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted(sequences) == list(range(len(sequences)))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(nothing, vocabulary_path()).count() == 0


def test_packing_query_encodes_as_the_tokenizer_file_does(spark, tmp_path):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    from evidara.llm.queries import op7_packing

    tokenizer = Tokenizer.from_file(path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "a<|endoftext|>b", "<|endoftext|>", "  <|endoftext|>\n\n x", "<|endoftext|><|endoftext|> y", "x <|endoftext| z", "none here", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["ids_crc32"], r["doc_tokens"]) for r in op7_packing(spark, str(tmp_path)).collect()}
    for i, text in enumerate(texts):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        assert got[i] == (zlib.crc32(np.array(ids, dtype="<u4").tobytes()), len(ids))


def test_cutting_patterns_cover_demand_with_little_waste():
    rng = np.random.default_rng(2)
    sizes = np.array(sorted(rng.choice(np.arange(3, 255), 80, replace=False), reverse=True))
    demand = rng.integers(1, 400, 80)
    chosen = packing.cutting_patterns(sizes, demand, 256)
    assert (sum(p * n for p, n in chosen) >= demand).all() and all(p @ sizes <= 256 for p, _ in chosen)
    least = max((demand @ sizes) / 256, demand[sizes > 128].sum())  # items over half a sequence can't meet
    assert sum(n for _, n in chosen) <= 1.02 * least + 40
    assert packing.cutting_patterns(sizes[:0], demand[:0], 256) == []


def test_fingerprints(docs, nothing):
    rows = fingerprint.fingerprint_documents(docs).collect()
    by_text = defaultdict(set)
    texts = {r[0]: r[1] or "" for r in ROWS}
    order = sorted(((r[0], r[1] or "") for r in ROWS if r[0] is not None), reverse=True)
    follows = {a[0]: b[1] for a, b in zip(order, order[1:], strict=False)}
    errors = []

    def shingles(text):
        found = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        return {tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))} if found else set()

    def jaccard(a, b):
        return len(a & b) / len(a | b) if a | b else 1.0

    assert len(rows) == len(ROWS)
    repeated = Counter(r[0] for r in ROWS)
    for r in rows:
        if r["doc_id"] is None or repeated[r["doc_id"]] > 1 or repeated[r["doc_id"] - 1] > 1 or r["doc_id"] == 0:
            continue
        text = texts[r["doc_id"]]
        by_text[text].add(r["fingerprint"])
        other = follows[r["doc_id"]]
        edited = text[: len(text) - len(text) // 2] + other[: len(text) // 2]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        errors += [abs(r["near_edited"] - jaccard(shingles(text), shingles(edited))), abs(r["near_next"] - jaccard(shingles(text), shingles(other)))]
    assert all(len(v) == 1 for v in by_text.values())
    assert max(errors) < 0.15 and sum(errors) / len(errors) < 0.03
    assert fingerprint.fingerprint_documents(nothing).count() == 0
    one = docs.where("doc_id = 2")
    assert fingerprint.fingerprint_documents(one).first()["near_next"] == 1.0


class PlainKatz:
    """Katz' model from its definition, over lists of tokens."""

    def __init__(self, training):
        self.n = {1: Counter(), 2: Counter(), 3: Counter()}
        for tokens in training:
            padded = ["\n", "\n", *tokens]
            for i in range(2, len(padded)):
                for order in (1, 2, 3):
                    self.n[order][tuple(padded[i - order + 1 : i + 1])] += 1
        self.d = {order: katz.good_turing(Counter(c.values())) for order, c in self.n.items()}
        self.after = {order: defaultdict(dict) for order in (1, 2, 3)}
        for order, counts in self.n.items():
            for gram, n in counts.items():
                self.after[order][gram[:-1]][gram[-1]] = n

    def p(self, gram):
        order = len(gram)
        seen = self.after[order].get(gram[:-1])
        if not seen:
            return self.p(gram[1:]) if order > 1 else 1.0
        total = sum(seen.values())
        kept = {w: n * self.d[order].get(n, 1.0) for w, n in seen.items()}
        if all(n > katz.TRUSTED for n in seen.values()):
            total += 1
        if gram[-1] in seen:
            return kept[gram[-1]] / total
        left = 1 - sum(kept.values()) / total
        if order == 1:
            return left
        return left * self.p(gram[1:]) / (1 - sum(self.p((*gram[1:-1], w)) for w in seen))


@pytest.mark.parametrize("parameters", [{}, {"block_tokens": 900, "buckets": 5, "least_hot": 6, "most_hot": 10**9}])
def test_katz_equals_its_definition(docs, nothing, parameters):
    tokens = lambda text: [*words(lower(text)), "\t"]
    train = [tokens(r[1]) for r in ROWS if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 10 != 0]
    counts = Counter(t for own in train for t in own)
    n, v = sum(counts.values()), len(counts)
    plain = PlainKatz(train)
    wanted = []
    for r in ROWS:
        own = tokens(r[1])
        padded = ["\n", "\n", *own]
        score = sum(math.log10(plain.p(tuple(padded[i - 2 : i + 1]))) for i in range(2, len(padded)))
        base = sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in own)
        held = r[0] is None or zlib.crc32(str(r[0]).encode()) % 10 == 0
        wanted.append((-1 if r[0] is None else r[0], held, len(own), sum(counts[t] > 0 for t in own), n, base, score))
    got = [(-1 if r["doc_id"] is None else r["doc_id"], *r[1:]) for r in katz.score_documents(docs, **parameters).collect()]
    assert len(got) == len(wanted)
    for one, other in zip(sorted(got), sorted(wanted), strict=True):
        assert one[:5] == other[:5]
        assert math.isclose(one[5], other[5], rel_tol=1e-9) and math.isclose(one[6], other[6], rel_tol=1e-9)
    assert sum(r[6] for r in got) > sum(r[5] for r in got)  # better than the base
    # every history's probabilities sum to 1
    for history in [("\n", "\n"), ("the", "of"), ("x", "y"), ("never", "seen"), ("\n", "the")]:
        assert math.isclose(sum(plain.p((*history, w)) for w in counts) + plain.p((*history, "never seen")), 1, rel_tol=1e-9)
    assert katz.score_documents(nothing).count() == 0


def test_toxicity(spark, nothing):
    rng = random.Random(4)
    insults = ["blockhead", "nitwit", "dunderpate"]

    def text(bad):
        parts = [" ".join(rng.choice(WORDS) for _ in range(9)) for _ in range(6)]
        if bad:
            parts[rng.randint(0, 5)] += " you " + rng.choice(insults)
        return ". ".join(parts)

    labelled = [(i, text(i % 4 == 0), int(i % 4 == 0)) for i in range(400)]
    odd = [(1000, "What a block-h3ad!"), (1001, "a n i t w i t indeed"), (1002, "such a dundxerpate here"), (1003, "all there when up"), (1004, None), (1005, "")]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in labelled] + [(i, t, "x") for i, t in odd], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in labelled] + [(None, 1), (7, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_documents(docs.drop("score"), labels).collect()}
    held = [(i, y) for i, _, y in labelled if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i]["predicted"] == y for i, y in held) >= 0.95 * len(held)
    assert [got[i]["predicted"] for i in (1000, 1001, 1002, 1003, 1004, 1005)] == [1, 1, 1, 0, 0, 0]
    assert all(0 <= r["score"] <= 1 for r in got.values()) and len(got) == len(labelled) + len(odd)
    assert toxicity.score_documents(nothing.drop("size"), labels).count() == 0
    flat = toxicity.score_documents(docs.drop("score"), labels.limit(0)).select("score").distinct().collect()
    assert len(flat) == 1


PAGES = [
    ("http://a.example/1", "<html><body class='has-sidebar'><header><h1>Site</h1></header><nav><a href=x>menu</a></nav><article><h1>T &amp; x</h1><p>Foo<b>bar</b>  baz<br>next &lt;i&gt; a < b<div class=\"ad\">Buy</div>"
     "<p>Two<script>var x='</p>';</script> end<ul><li>one<li>two</ul><section class='comments'><article class='comment'>bad</article></section></article><aside>side</aside><footer>&copy;</footer>", "T & x Foobar baz next <i> a < b Two end one two"),
    ("http://a.example/2", "<div class='with-sidebar'><main><p>Only main</main></div><p>outside", "Only main"),
    ("http://a.example/3", "", ""), (None, None, ""), ("no url", "plain &amp text", "plain & text"),
    ("http://a.example/4", "<p>cut off here <b>and <a href='", "cut off here and"),
]


def test_toxicity_by_number_of_weak_marks():
    rng = np.random.default_rng(5)
    syllables = ["ka", "lo", "mi", "ru", "te", "so", "vu", "ne", "pa", "di"]
    texts, labels = [], []
    for i in range(900):
        toxic = i % 9 == 0
        words = ["".join(rng.choice(syllables, 3)) for _ in range(60)]
        stems = rng.integers(3, 6) if toxic else rng.integers(0, 2)  # clean texts hold the stem too, but seldom more than once
        for _ in range(stems):
            words[rng.integers(60)] = "zorbel" + "".join(rng.choice(syllables, 2))
        texts.append(" ".join(words))
        labels.append(int(toxic))
    model = toxicity.fit(texts[:600], labels[:600])
    found = model.scores(texts[600:]) >= toxicity.THRESHOLD
    truth = np.array(labels[600:]) == 1
    assert found[truth].mean() >= 0.9
    assert found[~truth].mean() <= 0.02


def test_scores_keep_their_meaning_when_the_sample_is_bounded(spark):
    docs = spark.range(2000).selectExpr("id AS doc_id", "concat('plain words number ', id) AS text")
    labels = spark.range(2000).selectExpr("id AS doc_id", "cast(id % 10 = 0 AS int) AS toxic")
    rows = [r for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2]
    share = sum(r["toxic"] for r in rows) / len(rows)
    model = toxicity.fit_documents(docs, labels, most_toxic=100, most_clean=200)
    assert abs(float(model.scores(["plain words"])[0]) - share) < 0.01
    texts = [("grimwit here" if i % 3 == 0 else "fine day") if i < 280 else "grimwit here" for i in range(300)]
    y = [int(i % 3 == 0) for i in range(300)]
    same, true = toxicity.fit(texts, y), toxicity.fit(texts, y, 0.1)
    assert true.scores(["fine day"])[0] < same.scores(["fine day"])[0]


def test_short_and_non_latin_units_have_likeness():
    kernel = toxicity.Kernel(["zqx", "дурак"], [])
    other = "".join(chr(ord(c) + 6) for c in "дурак")  # the same letters by their codes modulo 6
    like = kernel.likeness(["zqx", "дурак", other])
    assert like[0, 0] > 0.99
    assert like[1, 1] > 0.99
    assert like[2, 1] == 0


def test_html_extraction(spark):
    pages = spark.createDataFrame([(i, u, h, "x") for i, (u, h, _) in enumerate(PAGES)], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in html_extract.extract_pages(pages).collect()}
    for i, (url, _, text) in enumerate(PAGES):
        assert (got[i]["url"], got[i]["text"], got[i]["n_chars"]) == (url, text, len(text))
    assert html_extract.extract_pages(pages.limit(0)).count() == 0
    # hosts without marks: the template tells what stands on every page, whatever the order of the cases
    for limit in (32 << 20, 0):
        frame = spark.createDataFrame([(i, f"http://b.example/{i}", bare_page(i)) for i in range(8)], "page_id long, url string, html string")
        got = {r["page_id"]: r["text"] for r in html_extract.extract_pages(frame, broadcast_bytes=limit).collect()}
        assert got == {i: bare_text(i) for i in range(8)}


SHARED = "A passage that authors like to repeat."


def bare_text(i):
    return f"Title {i} Article number {i} with many words of its own and no link. " + (f"{SHARED} " if i % 4 else f"Another one {i}. ") + " ".join(f"Part {k} of {i}." for k in range(i % 3 + 1))


def bare_page(i):
    parts = "".join(f"<div>Part {k} of {i}.</div>" for k in range(i % 3 + 1))
    shared = SHARED if i % 4 else f"Another one {i}."
    return (
        f"<div><div>Welcome to this place</div><div><a href=a>one {i}</a> <a href=b>two</a></div><div>By the way {i}</div>"
        f"<div><h1>Title {i}</h1><div>Article number {i} with many words of its own and no link.</div><div>{shared}</div>{parts}</div><div>Read on {i}</div></div>"
    )


def test_classes_decide_what_is_template(spark, monkeypatch):
    frame = spark.createDataFrame([(i, f"http://b.example/{i}", bare_page(i)) for i in range(8)], "row long, host string, html string").withColumn("host", F.lit("b"))
    rows = [r.asDict() for r in html_extract.equivalence_classes(frame).collect()]
    template = html_extract.nest(rows)
    shared = [b for b in html_extract.parse(bare_page(1))[1] if b.text() == SHARED][0]
    # on three of four pages, yet no part of the template: its vector is that of no element around it
    assert html_extract.text_token(shared.token, SHARED) not in template.texts and len(template.texts) >= 1
    assert html_extract.main_text(bare_page(3), template) == bare_text(3)
    # without its classes the same page comes out with all that stands beside the article
    assert "By the way" in html_extract.main_text(bare_page(3), html_extract.nest([]))
    assert "By the way" in html_extract.main_text(bare_page(3), html_extract.nest([r | {"class_id": i} for i, r in enumerate(rows) if r["kind"] == "tag" and r["token"]]))


def test_html_marks_can_be_stripped(spark):
    def page(i, marked):
        names = ("nav", "article", "footer", ' class="ad"') if marked else ("div", "div", "div", "")
        body = "".join(f"<p>Paragraph {k} of article {i} says something.</p>" for k in range(2 + i % 4))
        return f"<html><body><{names[0]}><ul><li><a href=x>go {i}</a></li></ul></{names[0]}><div{names[3]}>Buy {i} now</div><{names[1]}><h1>Head {i}</h1>{body}</{names[1]}><{names[2]}>Foot {i}</{names[2]}></body></html>"

    texts = []
    for marked in (True, False):
        frame = spark.createDataFrame([(i, f"http://c.example/{i}", page(i, marked)) for i in range(10)], "page_id long, url string, html string")
        texts.append({r["page_id"]: r["text"] for r in html_extract.extract_pages(frame).collect()})
    assert texts[0] == texts[1] and texts[0][1] == "Head 1 " + " ".join(f"Paragraph {k} of article 1 says something." for k in range(3))
    assert html_extract.main_text("<div>" * 20000 + "deep <noscript> open" + "</div>" * 20000, html_extract.Template()) == "deep open"


def test_url_filter(spark):
    urls = ["http://www.example.com/en/x", "http://EXAMPLE.com/en/x", "http://a.com/x", "http://a.net/es/1", "http://a.net/fr/", "http://a.net/de/", "http://a.org/fr/9?q=1#f", "ftp://x.example.com?u=/en/", "nothing", "", None, "http://badexample.com/en/", "http://www.example.com/enx/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate([*urls, urls[0]])], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in url_filter.judge_urls(pages, min_support=0.1, min_confidence=0.6).collect()}

    def brute(url):
        url = url or ""
        if "://" not in url:
            return "", ""
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        return lower(host), re.match(r"[^?#]*", rest[len(host) :])[0]

    for i, url in enumerate(urls):
        host, path = brute(url)
        fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, best and best[1])
        assert got[i]["verdict"] == best[2] if best else got[i]["verdict"] in ("allow", "block")
    assert got[6]["verdict"] == "block" and got[8]["verdict"] == "allow" and len(got) == len(urls) + 1
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


def test_mined_verdicts_equal_brute_force(spark):
    rng = random.Random(6)
    tokens = ["a", "b", "c", "d", "e"]
    labelled = []
    for _ in range(120):
        own = sorted(t for t in tokens if rng.random() < 0.5)
        labelled.append((own, "block" if "a" in own and rng.random() < 0.9 or {"b", "c"} <= set(own) else "allow"))
    frame = spark.createDataFrame(labelled, "tokens array<string>, label string")
    support, confidence = 0.05, 0.7

    def subsets(items):
        return [tuple(x for i, x in enumerate(items) if k >> i & 1) for k in range(1, 1 << len(items))]

    rules = {}
    for left in subsets(tokens):
        having = [y for own, y in labelled if set(left) <= set(own)]
        for y in ("allow", "block"):
            n = having.count(y)
            if n and n / len(labelled) >= support and n / len(having) >= confidence:
                rules[(left, y)] = (n / len(having), n / len(labelled))
    mined = url_filter.mine_rules(frame, support, confidence)
    assert {(tuple(r["antecedent"]), r["label"]) for r in mined.collect()} == set(rules)
    kept = {(a, y): v for (a, y), v in rules.items() if not any(y == z and set(b) < set(a) and w[0] >= v[0] for (b, z), w in rules.items())}
    pruned = url_filter.prune(mined)
    assert {(tuple(r["antecedent"]), r["label"]) for r in pruned.collect()} == set(kept) and len(kept) < len(rules)
    different = [list(x) for x in subsets(tokens)]
    got = {tuple(r["tokens"]): r["mined"] for r in url_filter.set_verdicts(spark.createDataFrame([(x, 1) for x in different], "tokens array<string>, n long"), pruned).collect()}
    for own in map(tuple, different):
        fits = [(-c, -s, -len(a), y) for (a, y), (c, s) in kept.items() if set(a) <= set(own)]
        assert got.get(own) == (min(fits)[3] if fits else None)
