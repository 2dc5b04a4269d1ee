"""What a block of the Katz model holds at once."""

import tracemalloc

import numpy as np

from evidara.llm import katz


def test_a_block_counts_its_ngrams_in_few_bytes_a_token():
    rng, tokens = np.random.default_rng(18), 400_000
    keys = np.sort(np.r_[katz._key(katz.START), rng.integers(-1 << 60, 1 << 60, 5000)])
    codes, lengths = rng.zipf(1.3, tokens) % 5001, np.full(400, 1000)
    row = {"body": katz.to_bytes(katz._steps(keys), codes, lengths), "held": [i % 10 == 0 for i in range(400)]}
    tracemalloc.start()
    block = katz._block(row)
    v, w, n, out, which = block.bigrams()
    at, seen, of_token = block.trigrams(np.roll(which, 1))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 70 * tokens  # 107 bytes a token with 64-bit codes

    learnt = np.repeat(np.arange(400) % 10 != 0, 1000)
    pairs = np.unique(np.stack([block.w, block.v]), axis=1)
    assert (pairs == np.stack([w, v])).all() and (w[which] == block.w).all() and (v[which] == block.v).all()
    assert (n == np.bincount(which[learnt], minlength=len(v))).all()
    assert (out == np.minimum(np.bincount(which[~learnt], minlength=len(v)), 1)).all()
    assert (block.w[at][of_token] == block.w).all() and (at[of_token] <= np.arange(tokens)).all() and seen.sum() == learnt.sum()
