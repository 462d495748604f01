"""Removal of repeated words and bytes against plain versions; suffix structures against definitions."""

import random
from collections import defaultdict

import numpy as np
import pytest
from corpusforge.llm import suffix_array, suffix_tree
from corpusforge.llm.queries import QUERIES

from . import brute
from .test_filters import SF, docs_of


def test_queries(spark):
    docs = docs_of(spark)
    assert sorted(tuple(r) for r in QUERIES["op8_suffix_tree_dedup"](spark, SF).collect()) == sorted(brute.repeated_words(docs))
    assert sorted(tuple(r) for r in QUERIES["op10_suffix_array_dedup"](spark, SF).collect()) == sorted(brute.repeated_bytes(docs))


def made(seed, n=120):
    """Texts that share passages of many lengths, whole copies, and periodic stretches."""
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "abcdeé" for b in ("x", "yy", "zzz", "€")]
    shared = [[rng.choice(words) for _ in range(rng.randrange(3, 90))] for _ in range(12)]
    out = []
    for i in range(n):
        t = []
        for _ in range(rng.randrange(0, 6)):
            t += rng.choice(shared)[rng.randrange(0, 5):] if rng.random() < 0.6 else [rng.choice(words) for _ in range(rng.randrange(0, 40))]
        out.append((i, (" " if rng.random() < 0.5 else "\n ").join(t)))
    return out + [(n + 1, out[3][1]), (n + 2, "ab " * 300), (n + 3, "ab " * 200 + "q"), (n + 4, "z" * 900), (n + 5, None), (n + 6, ""), (n + 7, "a b")]


@pytest.mark.parametrize("hot", [2_000, 3])
def test_made_texts(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_array, "HOT", hot)
    monkeypatch.setattr(suffix_tree, "HOT", hot)
    monkeypatch.setattr(suffix_array, "GROUP", 50)
    monkeypatch.setattr(suffix_tree, "GROUP", 50)
    docs = made(hot)
    df = spark.createDataFrame([(*d, 1, "q") for d in docs], "doc_id long, text string, start int, ctx string").repartition(5)
    for size in (13, 4):
        assert sorted(tuple(r) for r in suffix_tree.remove_repeats(df, size).collect()) == sorted(brute.repeated_words(docs, size))
    for size in (200, 30):
        assert sorted(tuple(r) for r in suffix_array.remove_repeats(df, size).collect()) == sorted(brute.repeated_bytes(docs, size))


def test_edges(spark):
    long = " ".join(f"w{i % 7000}" for i in range(60_000))
    docs = [(4, long), (2, "p q " + " ".join(f"w{i}" for i in range(500, 530)) + " r"), (9, "x" * 400), (9, "x" * 400), (None, "tail " * 50), (None, "tail " * 50)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["doc_id"], r["n_words"], r["n_removed"]) for r in suffix_tree.remove_repeats(df).collect()}
    want = {x[:3] for x in brute.repeated_words([d for d in docs if d[0] is not None])}
    assert got == want | {(None, 50, 0)}
    got = sorted((tuple(r) for r in suffix_array.remove_repeats(df).collect()), key=repr)
    assert got == sorted(brute.repeated_bytes(docs), key=repr)
    kept = suffix_tree.remove_repeats(df, keep_text=True).where("doc_id = 4").first()["kept"]
    assert kept == " ".join(w for i, w in enumerate(long.split()) if not 500 <= i % 7000 < 530)
    none = df.where("false")
    assert suffix_tree.remove_repeats(none).count() == 0 and suffix_array.remove_repeats(none).count() == 0


def test_intervals_are_maximal_repeats():
    rng = random.Random(1)
    texts = [bytes(rng.choice(b"ab") for _ in range(60)) for _ in range(5)]
    at, owner, begin, _, found = suffix_array._scan(texts, 5)
    got = {}
    for length, a, b in found:
        s = texts[owner[a]][at[a] - begin[owner[a]]:][:length]
        got[s] = {(int(owner[i]), int(at[i] - begin[owner[i]])) for i in range(a, b + 1)}
    where = defaultdict(set)
    for k, t in enumerate(texts):
        for i in range(len(t)):
            for j in range(i + 5, len(t) + 1):
                where[t[i:j]].add((k, i))
    want = {}
    for s, places in where.items():
        left = {texts[k][i - 1] if i else (k, i) for k, i in places}
        right = {texts[k][i + len(s)] if i + len(s) < len(texts[k]) else (k, i) for k, i in places}
        if len(places) > 1 and len(left) > 1 and len(right) > 1:
            want[s] = places
    assert got == want


def test_deep_nodes():
    rng = np.random.default_rng(3)
    contexts = [b" ".join(bytes([97 + int(x)]) for x in rng.integers(0, 2, 30)) for _ in range(4)]
    owner, place, left, common = suffix_tree.suffixes(contexts, 3)
    words = [c.split(b" ") for c in contexts]
    rows = [tuple(words[o][p:]) for o, p in zip(owner, place)]
    nodes = {(d, a): b for d, a, b, _ in suffix_tree.deep_nodes(common, 3)}
    for (depth, a), b in nodes.items():
        assert len({r[:depth] for r in rows[a:b + 1]}) == 1 and len({r[:depth + 1] for r in rows[a:b + 1]}) > 1
    tops = [(a, b) for d, a, b, top in suffix_tree.deep_nodes(common, 3) if top]
    groups = defaultdict(int)
    for r in rows:
        groups[r[:3]] += 1
    assert sorted(b - a + 1 for a, b in tops) == sorted(n for n in groups.values() if n > 1)


def test_repeat_groups(spark):
    docs = made(5, 40)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    raw = {d: (t or "").encode() for d, t in docs}
    groups = defaultdict(set)
    for r in suffix_array.maximal_repeats(df, 60).collect():
        groups[r["repeat"]].add(raw[r["doc_id"]][r["start"]:r["start"] + r["length"]])
    assert groups and all(len(g) == 1 for g in groups.values())
    words = {d: (t or "").split() for d, t in docs}
    groups = defaultdict(set)
    for r in suffix_tree.repeats(df, 6).collect():
        groups[r["repeat"]].add(tuple(words[r["doc_id"]][r["start"]:r["start"] + r["length"]]))
    assert groups and all(len(g) == 1 for g in groups.values())


def grouped(rows):
    groups = defaultdict(set)
    for r in rows:
        groups[r["repeat"], r["length"]].add((r["doc_id"], r["start"]))
    return sorted((n, sorted(g)) for (_, n), g in groups.items())


def test_hot_repeats(spark, monkeypatch):
    df = spark.createDataFrame(made(5, 40), "doc_id long, text string")
    want = grouped(suffix_tree.repeats(df, 6).collect())
    taken, hot = [], suffix_tree._hot_suffixes
    monkeypatch.setattr(suffix_tree, "_hot_suffixes", lambda ctx, size: taken.append(ctx.count()) or hot(ctx, size))
    for group in (8_000, 20):
        monkeypatch.setattr(suffix_tree, "HOT", 3)
        monkeypatch.setattr(suffix_tree, "GROUP", group)
        assert grouped(suffix_tree.repeats(df, 6).collect()) == want
    assert len(want) > 20 and max(n for n, _ in want) > 6 and min(taken) > 3


def test_hot_maximal_repeats(spark, monkeypatch):
    df = spark.createDataFrame(made(5, 40), "doc_id long, text string")
    want = grouped(suffix_array.maximal_repeats(df, 60).collect())
    taken, hot = [], suffix_array._hot_suffixes
    monkeypatch.setattr(suffix_array, "_hot_suffixes", lambda ctx, size: taken.append(ctx.count()) or hot(ctx, size))
    for group in (4_000, 20):
        monkeypatch.setattr(suffix_array, "HOT", 3)
        monkeypatch.setattr(suffix_array, "GROUP", group)
        assert grouped(suffix_array.maximal_repeats(df, 60).collect()) == want
    assert len(want) > 20 and max(n for n, _ in want) > 60 and min(taken) > 3
