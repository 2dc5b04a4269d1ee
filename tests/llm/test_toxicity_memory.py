"""What the toxicity classifier holds at once."""

import random
import tracemalloc

import numpy as np

from evidara.llm import toxicity


def test_a_fit_takes_little_room_beside_its_texts():
    rng = random.Random(19)
    syllables = [a + b for a in "bdfgklmnprstvz" for b in "aeiou"]
    stems = ["".join(rng.choice(syllables) for _ in range(3)) for _ in range(6000)]
    texts = [" ".join(rng.choice(stems) for _ in range(150)) for _ in range(800)]
    labels = [int(i % 8 == 0) for i in range(800)]
    texts = [t + " quxzorb" * 2 if y else t for t, y in zip(texts, labels, strict=True)]
    tracemalloc.start()
    model = toxicity.fit(texts, labels)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 52_000_000  # 63 million with an array for each word and a set of words for each text
    assert (model.scores(["a quxzorb here", "all is well"]) >= toxicity.THRESHOLD).tolist() == [True, False]


def test_the_likeness_of_suspects_needs_no_row_for_all_their_triples():
    rng = random.Random(20)
    units = ["".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(30)) for _ in range(300)]
    units[1:3] = [units[0][1:], units[0][:15] + units[3][15:]]
    vectors, used = toxicity._vectors(units)
    assert len(used) > 40_000
    tracemalloc.start()
    got = toxicity._alike(units)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.abs(got - vectors @ vectors.T).max() < 1e-5 and got[0, 1] > 0.9
    assert peak < vectors.nbytes
