"""Jaccard join and components against plain versions."""

import random

import numpy as np
from corpusforge.llm import jaccard
from corpusforge.llm.components import components
from corpusforge.llm.queries import QUERIES

from . import brute
from .test_filters import SF, docs_of


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(500 + i, 501 + i) for i in range(60)] + [(7, 7)]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {}
    for a, b in edges:
        label.setdefault(a, a)
        label.setdefault(b, b)
    for _ in range(400):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {n: label[n] for n in linked}


def test_prefix_is_long_enough():
    rng = np.random.default_rng(1)
    for n in range(1, 60):
        size, asked = jaccard.prefix(np.sort(rng.integers(0, 50, n)), 90)
        t = -(-90 * n // 100)
        assert 1 <= asked <= t and size == n - t + asked


def test_parity_bounds_the_difference():
    rng = np.random.default_rng(4)
    for n in (1, 5, 100, 3000):
        x = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        for new in (0, 1, n // 10, n):
            y = np.concatenate([x[new:], rng.integers(0, 1 << 63, new, dtype=np.uint64)])
            d = np.repeat([0, 2], [x.size, y.size])
            bits = jaccard._parity(d, np.concatenate([x, y]), 3)
            apart = int(np.bitwise_count(bits[0] ^ bits[2]).sum())
            assert apart <= np.setxor1d(x, y).size and not bits[1].any()
            assert new * 20 > n or apart >= new  # few differences seldom meet in a bit


def test_query(spark):
    got = sorted(tuple(r) for r in QUERIES["op3_jaccard_join"](spark, SF).collect())
    assert got == sorted(brute.components(docs_of(spark)))


def near_copies(n, seed=11):
    """Groups of copies with growing differences, in several sizes."""
    rng = random.Random(seed)
    out = []
    for group in range(4):
        words = [f"w{rng.randrange(4000)}" for _ in range(40 + 60 * group)]
        for _ in range(n):
            own = list(words)
            for _ in range(rng.randrange(0, 6)):
                own[rng.randrange(len(own))] = f"x{rng.randrange(9)}"
            out.append(" ".join(own))
    return out


def test_dense_groups(spark):
    common = " ".join(f"c{i}" for i in range(30))
    texts = near_copies(60) + [f"{common} " + " ".join(f"u{i}_{j}" for j in range(40)) for i in range(80)]
    docs = list(enumerate(texts))
    random.Random(2).shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for k, percent, leaders in ((3, 90, (1, 1)), (2, 60, (1,)), (5, 80, (1, 8, 8))):
        got = sorted(tuple(r)[:3] for r in jaccard.cluster(df, k=k, percent=percent, leaders=leaders).collect())
        want = []
        sets = brute.shingle_set
        brute.shingle_set = lambda t, n=3, k=k: sets(t, k)
        want = sorted(brute.components(docs, percent))
        brute.shingle_set = sets
        assert got == want


def test_edges(spark):
    docs = [(5, "a b c d"), (3, "A B c\td"), (9, None), (8, ""), (7, "  "), (2, "one two"), (1, "ONE  two"), (4, "two one"), (6, "x"),
            (10, "y " * 20_000), (11, "y " * 15_000), (12, "a b c d"), (12, "a b c d"), (3, "z1 z2 z3 z4")]
    df = spark.createDataFrame([(*d, 0, "q") for d in docs], "doc_id long, text string, row int, token string")
    rows = jaccard.cluster(df, k=3, percent=90).collect()
    got = sorted(tuple(r)[:3] for r in rows)
    kept = [r["component_id"] for r in rows if r["keep"] and r["n_shingles"]]
    assert sorted(kept) == [1, 3, 3, 4, 6, 10]
    assert got == sorted(brute.components(docs))
    alone = jaccard.cluster(spark.createDataFrame([(None, "a b c d"), (None, "q r s"), (1, "a b c d")], "doc_id long, text string"), k=3, percent=90)
    assert sorted((tuple(r)[:3] for r in alone.collect()), key=repr) == [(1, 2, 1), (None, 1, None), (None, 2, 1)]
    assert jaccard.cluster(df.where("false")).count() == 0
