"""Ranked search against a plain scoring of all pairs."""

import math
import re
from collections import Counter

from corpusforge.llm import lexical
from corpusforge.llm.queries import QUERIES

from . import brute
from .test_filters import SF, docs_of

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(t):
    return TERM.findall(brute.lower(t or ""))


def plain(docs, items, k):
    bags = [(d, Counter(terms(t))) for d, t in docs]
    whole = sum(1 for _, b in bags if b)
    total = sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    weight = {t: math.floor(1000 * math.log((2 * whole + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for item, text in set(items):
        asked, scores = Counter(terms(text)), []
        for d, b in bags:
            n = sum(b.values())
            m = 100 - 25 + (25 * n * whole) // total if total else 0
            s = sum(c * weight[t] * ((10**9 * b[t]) // (1000 * b[t] + 12 * m)) for t, c in asked.items() if b[t])
            if s > 0:
                scores.append((-s, d is not None, d or 0, d))
        out += [(item, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_query(spark):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert got(QUERIES["op13_lexical_search"](spark, SF)) == plain(docs_of(spark), items, 20)


def rows():
    docs = [(i, f"the Cat{i % 7} sat_on {'mat ' * (i % 5)}ÉTÉ été x{i}") for i in range(60)]
    docs += [(100, None), (101, ""), (102, " .,!"), (103, "cat0 " * 30_000), (104, "\x00cat1\x7f\nCAT1"), (None, "the cat2"), (5, "cat3 cat3"), (5, "cat3 cat3")]
    docs += [(200 + i, "same words here") for i in range(50)]
    items = [(1, "cat1 CAT1 mat"), (2, "the"), (3, None), (4, ""), (5, "nowhere"), (6, "same here"), (6, "été"), (7, "cat3 cat2 cat1 the"), (7, "cat3 cat2 cat1 the"),
             (None, "sat on"), (8, "ca at cat"), (9, "ÉTÉ")]
    return docs, items


def test_edge_rows(spark, monkeypatch):
    docs, items = rows()
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, n int, rank string").repartition(4)
    q = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, score int")
    for k in (1, 3, 1000):
        assert got(lexical.search(d, q, k)) == plain(docs, items, k)
    monkeypatch.setattr(lexical, "CELLS", 4)  # nearly every item in a block of its own
    assert got(lexical.search(d, q, 20)) == plain(docs, items, 20)
    assert lexical.search(d.where("false"), q, 3).count() == 0 and lexical.search(d, q.where("false"), 3).count() == 0
    assert got(lexical.search(d.where("doc_id in (100, 102)"), q, 3)) == []


def test_large_weights_stay_exact():
    items = lexical.Items()
    items.add(1, "a " * 50 + "b")
    items.add(2, "b")
    matrix = items.matrix(lexical.np.array([3, 5]))
    assert matrix.tolist() == [[150.0, 0.0], [5.0, 5.0]]
    best = lexical.Best(1, 3)
    for part in ([9, 4, 7], [1, 3], [8, 2, 6, 5]):
        best.add(lexical.np.array(part), lexical.np.array([[10]] * len(part)))
    assert best.rows[0][0].tolist() == [1, 2, 3] and best.bar.tolist() == [10]
