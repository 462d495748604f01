"""Exact top-k against full inner products."""

import math

import numpy as np
from corpusforge.llm import maxscore
from corpusforge.llm.queries import QUERIES

from .test_filters import SF


def plain(rows, queries, k, scale=1024):
    def ints(v):
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            return None
        return [math.floor(scale * x) for x in v]

    rows = [(i, ints(v)) for i, v in rows]
    rows = [(i, v) for i, v in rows if i is not None and v is not None]
    best = {}
    for q, v in {(i, tuple(ints(v))) for i, v in queries if i is not None and ints(v) is not None}:
        best.setdefault(q, []).extend((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q)
    return sorted((q, r + 1, i, -s) for q, found in best.items() for r, (s, i) in enumerate(sorted(found)[:k]))


def test_query(spark):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = sorted(tuple(r) for r in QUERIES["op5_maxscore_topk"](spark, SF).collect())
    assert got == plain(rows, [r for r in rows if r[0] % 100 == 0], 10)


def test_edges(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=5)]) for i in range(300)]
    rows += [(400 + i, [1.0, 0.5, 0.0, -0.25, 0.125]) for i in range(60)] + [(7, [9.0] * 5)] * 3 + [(10, [0.1, 0.2])]
    rows += [(500, None), (501, [None, 1.0]), (502, [float("nan")] * 5), (503, [float("inf")] * 5), (504, []), (None, [5.0] * 5), (505, [0.0] * 9)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int").repartition(4)
    some = df.where("vec_id % 10 = 0 OR vec_id = 7 OR vec_id > 499")
    asked = [r for r in rows if r[0] is not None and (r[0] % 10 == 0 or r[0] == 7 or r[0] > 499)]
    for k in (1, 10, 1000):
        assert sorted(tuple(r) for r in maxscore.search(df, some, k).collect()) == plain(rows, asked, k)
    monkeypatch.setattr(maxscore, "QUERIES_AT_ONCE", 9)
    assert sorted(tuple(r) for r in maxscore.search(df, some, 4).collect()) == plain(rows, asked, 4)
    assert maxscore.search(df.where("false"), some).count() == 0 and maxscore.search(df, some.where("false")).count() == 0
    huge = [(i, [float(x) for x in rng.integers(-2**20, 2**20, 3)]) for i in range(20)]
    big = spark.createDataFrame(huge, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in maxscore.search(big, big, 3).collect()) == plain(huge, huge, 3)


def test_shards_prune_and_agree():
    rng = np.random.default_rng(8)
    data = np.floor(rng.normal(size=(4000, 32)) * 300)
    ids = np.arange(4000)
    best = maxscore.Best(ids[:40], data[:40], 5)
    for s in range(0, 4000, 250):
        best.add(ids[s:s + 250], data[s:s + 250])
    full = data[:40] @ data.T
    for i in range(40):
        order = [j for j in np.lexsort((ids, -full[i])) if j != i][:5]
        assert best.rows[i].tolist() == order and best.scores[i].tolist() == full[i][order].tolist()
