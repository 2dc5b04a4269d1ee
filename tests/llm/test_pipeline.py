"""The pipeline's stages on a small corpus: what goes, what stays, and in which shape."""

import random
import re
from collections import Counter

import numpy as np

import corpus_pipeline
from evidara.llm import mixing, simhash


def test_stages(spark, tmp_path):
    rng = random.Random(9)
    vocabulary = [f"{a}{b}" for a in ("ka", "lo", "mi", "tu", "re", "so") for b in ("na", "pe", "ri", "do", "vu", "xe", "za")]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(120)) for _ in range(200)]
    toxic = {i for i in range(200) if i % 5 == 0}
    texts = [t + " blockhead" * 2 if i in toxic else t for i, t in enumerate(texts)]
    texts += [texts[1], texts[1], texts[2].replace(" ", "  ", 1), texts[3] + " extra"]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    folder = str(tmp_path / "sf")
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    documents.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != "packing":
            assert out.columns == documents.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = [r["doc_id"] for r in docs.select("doc_id").collect()]
    assert set(kept["toxicity"]) == set(range(204)) - toxic
    assert set(kept["exact_dedup"]) == set(kept["toxicity"]) - {1, 200}
    assert set(kept["simhash_dedup"]) == set(kept["exact_dedup"]) - {202, 203} and len(kept["simhash_dedup"]) == len(set(kept["simhash_dedup"]))
    assert set(kept["mixing"]) <= set(kept["simhash_dedup"]) and set(kept["packing"]) == set(kept["mixing"])
    assert corpus_pipeline.run(spark, folder).count() == len(kept["packing"])


def similar_sets(texts, similarity=0.8, words=5):
    """Components by brute force over all pairs of shingle sets."""
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = 0
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if (not a and not b) or len(a & b) >= similarity * len(a | b) > 0:
                links += 1
                high, low = sorted((root(i), root(j)), reverse=True)
                parent[high] = low
    return [root(i) for i in range(len(texts))], links


def prose(rng, n):
    return [rng.choice("karo lume tesi vona dule pira".split()) + str(rng.randint(0, 400)) for _ in range(n)]


def test_repeated_lines_hide_no_near_copy(spark):
    """Similarity is of sets: a line that stands a hundred times more often changes nothing."""
    rng = random.Random(12)
    texts = []
    for i in range(20):
        words, line = prose(rng, 300), prose(rng, 12)
        texts += [" ".join(words + line), " ".join(words + line * rng.choice([10, 30, 100]))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(docs).collect()}
    assert sum(got[2 * i + 1] == 2 * i for i in range(20)) >= 19
    assert similar_sets(texts)[0] == [i - i % 2 for i in range(40)]


def test_a_hot_group_loses_no_link_to_its_neighbours(spark, monkeypatch):
    """Near copies of one text, and with many of them a partner that is like that copy only."""
    rng = random.Random(13)
    base, texts = prose(rng, 400), []
    for i in range(120):
        copy = list(base)
        copy[rng.randint(0, 399)] = f"w{i}"
        texts.append(" ".join(copy))
    for i in range(40):  # like a copy at about 0.84, and thus like the others or not by a word
        copy = texts[i].split()
        at = 20 + 5 * i
        copy[at : at + 30] = [f"n{i}x{j}" for j in range(30)]
        texts.append(" ".join(copy))
    texts += [" ".join(prose(rng, 200)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want, _ = similar_sets(texts)
    found = []
    for limit, passes in ((1 << 10, (None,)), (10, (1, 2, None)), (1 << 10, (1, None))):
        monkeypatch.setattr(simhash, "HOT_GROUP", limit)
        monkeypatch.setattr(simhash, "PASSES", passes)
        found.append({r["doc_id"]: r["component_id"] for r in simhash.similar_documents(docs).collect()})
    assert found[0] == found[1] == found[2]
    assert sum(found[0][i] == want[i] for i in range(len(texts))) >= 0.98 * len(texts)


def test_a_doubtful_group_makes_rows_in_proportion(spark):
    """Fingerprints that all may be alike, but none surely: a row for each, not for each pair."""
    rng = np.random.default_rng(16)
    base = rng.integers(0, 256, 96, dtype=np.uint8)
    rows = []
    for node in range(300):
        bits = np.unpackbits(base)
        bits[512 + rng.choice(256, 18, replace=False)] ^= 1
        rows.append((bytearray(np.packbits(bits).tobytes()), node, node))
    links = simhash.similar_links(spark.createDataFrame(rows, "fp binary, node long, colour long"), 0.8).collect()
    assert len(links) <= 2 * len(rows)
    ends = {r["a"] for r in links} | {r["b"] for r in links}
    assert ends == set(range(300)) and {"doubtful"} <= {r["kind"] for r in links} <= {"doubtful", "sure"}


def test_families_are_confirmed_in_blocks_as_by_brute_force(spark, monkeypatch):
    rng = random.Random(17)
    rows = []
    for family in (1, 2, 3):
        for i in range(1 if family == 3 else 60):
            whole = set(range(100 * family, 100 * family + 40))
            own = whole - set(rng.sample(sorted(whole), rng.choice([2, 4, 6]))) | {1000 * family + 10 * i + j for j in range(rng.choice([0, 2, 4]))}
            node = 500 * family + i
            rows.append((family, node, node - node % 2 if i < 10 else node, sorted(own)))
    members = spark.createDataFrame(rows, "family long, node long, colour long, shingles array<long>")

    def grouped(pairs):
        root = {n: c for _, n, c, _ in rows} | {c: c for _, _, c, _ in rows}
        for a, b in pairs:
            a, b = root[a], root[b]
            root = {n: min(a, b) if c in (a, b) else c for n, c in root.items()}
        return root

    want = grouped((a, b) for f, a, _, x in rows for g, b, _, y in rows if f == g and len({*x} & {*y}) >= 0.8 * len({*x} | {*y}))
    assert 3 < len(set(want.values())) < 110
    for block in (1 << 10, 7):
        monkeypatch.setattr(simhash, "BLOCK_NODES", block)
        assert grouped((r["a"], r["b"]) for r in simhash.confirmed_links(members, 0.8).collect()) == want


def test_trie_links_leave_out_equal_colours_only():
    rng = np.random.default_rng(14)
    for size, colours in ((300, 5), (3000, 2)):
        keys = (rng.integers(0, 1 << 7, size).astype(np.uint64) << np.uint64(57)) | np.uint64(0)
        colour = np.where(rng.random(size) < 0.6, 0, rng.integers(0, colours * 20, size))
        order = np.lexsort((colour, keys))
        keys, colour = keys[order], colour[order]
        want = {(min(a, b), max(a, b)) for pairs in [simhash.trie_links(keys, 2, 1, 8, spanning=False)] for x, y in pairs for a, b in zip(x.tolist(), y.tolist()) if colour[a] != colour[b]}
        got = [(min(a, b), max(a, b)) for x, y in simhash.trie_links(keys, 2, 1, 8, spanning=False, colours=colour) for a, b in zip(x.tolist(), y.tolist())]
        assert len(got) == len(set(got)) and set(got) == want


ODD_COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, size long, row long, key long, score double, mix_hash long, _words long, component string, keep_id long"


def odd_rows(rng):
    texts = [" ".join(prose(rng, rng.choice([5, 60, 200]))) for _ in range(40)]
    rows = [(i, t, "en", rng.choice(["a", "b", None]), len(t)) for i, t in enumerate(texts)]
    rows += [(50, None, "en", "a", None), (51, "", None, None, 0), (52, " \t ", "en", "b", 3), rows[3], rows[3], rows[3], (None, texts[5], "de", "a", 1), (None, "no id here", None, None, 10), (None, None, None, None, None), (4, "another text under a used id", "en", "a", 28), (60, "ka " * 700_000, "en", "b", 2_100_000)]
    return [(*r, 1, 2, 3, 0.5, 4, 5, "c", 6) for r in rows]


def test_stages_take_odd_rows_and_clashing_columns(spark, tmp_path):
    rng = random.Random(15)
    rows = odd_rows(rng)
    docs = spark.createDataFrame(rows, ODD_COLUMNS)
    spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns, name
            left = Counter((r["doc_id"], r["text"]) for r in out.collect())
            if name == "toxicity":
                assert left == Counter((r[0], r[1]) for r in rows)
            if name == "exact_dedup":
                best = {}
                for r in rows:
                    best[r[1] or ""] = max(best.get(r[1] or "", -1), -1 if r[0] is None else r[0])
                assert Counter((i if i is not None else -1, t or "") for i, t in left.elements()) == Counter((i, t) for t, i in best.items())
            if name == "simhash_dedup":
                first = {}
                for r, group in zip(rows, similar_sets([r[1] for r in rows])[0]):
                    first[group] = min(first.get(group, (True, 0)), (r[0] is None, r[0] or 0))
                assert Counter((i is None, i or 0) for i, _ in left.elements()) == Counter(first.values())
        else:
            assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} == {r[0] for r in rows}


def test_mixed_documents_equal_what_the_mix_takes(spark):
    """Against the mix row by row: words by source and text, with rows that repeat id, source and text."""
    rng = random.Random(16)
    docs = spark.createDataFrame(odd_rows(rng)[:-1], ODD_COLUMNS)
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want, source_words = Counter(), Counter()
    for r in mixing.mix(docs).collect():
        want[r["doc_id"], r["source"], r["size"]] += r["taken"]
        source_words[r["source"]] += r["taken"]
    out = mixing.repeat_documents(docs)
    assert out.columns == docs.columns
    rows, sizes = out.collect(), {(r["doc_id"], r["source"], r["text"]): count(r["text"]) for r in docs.collect()}
    got = Counter()
    for r in rows:
        got[r["source"]] += count(r["text"])
        assert (r["mix_hash"], r["_words"], r["size"]) == (4, 5, 1)
        assert (r["doc_id"], r["source"], r["text"]) in sizes or r["n_chars"] == len(r["text"])
    assert got == +source_words
    whole = Counter((r["doc_id"], r["source"], count(r["text"])) for r in rows)
    assert all(whole[key] >= n // key[2] for key, n in want.items() if n)
