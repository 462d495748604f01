"""What the suffix arrays of one large anchor group hold at once."""

import random
import tracemalloc

import numpy as np
from corpusforge.llm import suffix_array


def arranged(contexts, size):
    data = np.frombuffer(b"".join(contexts), np.uint8)
    lengths = np.array([len(c) for c in contexts], np.int64)
    stop = np.cumsum(lengths)
    n = lengths - size + 1
    owner = np.repeat(np.arange(n.size), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + (stop - lengths)[owner]
    return data, at, stop[owner]


def test_stretches_give_the_whole_order(monkeypatch):
    rng = random.Random(4)
    base = ["".join(rng.choice("abc") for _ in range(80)).encode() for _ in range(5)]
    contexts = [rng.choice(base)[rng.randrange(20):] for _ in range(150)] + [b"a" * 70, b"\0" * 50 + b"a", b"\0" * 51]
    data, at, end = arranged(contexts, 30)
    want = suffix_array.suffix_order(data, at, end, 30)
    tails = [data[a:e].tobytes() for a, e in zip(at, end)]
    for k in range(1, want[0].size):  # common prefixes by definition
        x, y = tails[want[0][k - 1]], tails[want[0][k]]
        same = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
        assert want[1][k] == (same if same >= 30 else 0)
    for spelled, piece, step in ((1, 1, 1), (3_000, 100, 500), (20_000, 5_000, 50)):
        monkeypatch.setattr(suffix_array, "SPELLED", spelled)
        monkeypatch.setattr(suffix_array, "SLICE", piece)
        monkeypatch.setattr(suffix_array, "STEP", step)
        got = suffix_array.suffix_order(data, at, end, 30)
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def test_large_group_is_spelled_out_by_parts():
    rng = np.random.default_rng(2)
    pairs = [rng.integers(97, 123, 360).astype(np.uint8).tobytes() for _ in range(2_000)]
    contexts = pairs + [p[:330] + b"!" * 30 for p in pairs]
    data, at, end = arranged(contexts, 200)
    tracemalloc.start()
    order, common = suffix_array.suffix_order(data, at, end, 200)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert order.size == 2 * 2_000 * 131 and (common[1::2] >= 200).all()
    assert peak < 110e6
