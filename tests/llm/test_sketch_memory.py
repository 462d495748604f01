"""What the frequency sketch of the shingles holds at once."""

import tracemalloc

import numpy as np
from corpusforge.llm import jaccard


def test_only_frequent_shingles_take_room():
    rng = np.random.default_rng(5)
    for size in (0, 1, 3, 4, 50, 5_000):
        grams = rng.integers(0, max(size // 3, 1), size).astype(np.uint64)
        u, c = np.unique(grams, return_counts=True)
        got = jaccard._often(grams)
        assert (got[0] == u[c >= jaccard.REPEATED]).all() and (got[1] == c[c >= jaccard.REPEATED]).all()
    grams = rng.integers(0, 1 << 63, jaccard._FLUSH, dtype=np.uint64)
    grams[:1000] = 7
    tracemalloc.start()
    got = jaccard._often(grams)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [x.tolist() for x in got] == [[7], [1000]] and peak < grams.nbytes / 2
