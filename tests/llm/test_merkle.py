"""The manifest against plain trees, and the layout's address arithmetic."""

import hashlib
import random
import zlib
from itertools import groupby

import pytest
from corpusforge.llm import merkle
from corpusforge.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
NAMES = ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def climb(nodes):
    """Root, and per node its siblings on the way up, as (before, after)."""
    ways = [[] for _ in nodes]
    place = list(range(len(nodes)))
    while len(nodes) > 1:
        for way, i in zip(ways, place):
            run = i // 8 * 8
            way.append((nodes[run:i], nodes[i + 1:run + 8]))
        nodes = [h(*nodes[i:i + 8]) for i in range(0, len(nodes), 8)]
        place = [i // 8 for i in place]
    return nodes[0], ways


def plain(rows):
    """rows: (group, id, digest, claim)."""
    key = lambda g: (g is not None, (g or "").encode() if isinstance(g, str) or g is None else g)
    rows = sorted(rows, key=lambda r: (key(r[0]), r[1] is not None, r[1] or 0, r[2]))
    parts = [list(x) for _, x in groupby(rows, key=lambda r: r[0])]
    trees = [climb([r[2] for r in part]) for part in parts]
    if not trees:
        return []
    root, over = climb([t[0] for t in trees])
    out = []
    for part, (subroot, ways), above in zip(parts, trees, over):
        for (_, i, digest, claim), way in zip(part, ways):
            proof = h(*[x for a, b in way + above for x in a + b])
            own = claim or digest
            for a, b in way + above:
                own = h(*a, own, *b)
            out.append((i, digest, subroot, root, proof, own, own == root))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select(df.columns[0], *NAMES[1:]).collect()), key=repr)


@pytest.mark.parametrize("levels", [1, 2, 3, 4, 5])
def test_layout_is_a_permutation_of_aligned_subtrees(levels):
    places = [int(p) for d in range(levels) for p in merkle._places(levels, d)]
    assert sorted(places) == list(range(merkle.nodes_of(levels)))
    top = levels // 2
    if top:
        assert {int(p) for d in range(top) for p in merkle._places(levels, d)} == set(range(merkle.nodes_of(top)))  # the top half lies in front
        below = merkle.nodes_of(levels - top)
        for s in range(8**top):  # then one stretch per subtree
            own = {int(p) for d in range(top, levels) for p in merkle._places(levels, d)[s * 8 ** (d - top):(s + 1) * 8 ** (d - top)]}
            assert own == set(range(merkle.nodes_of(top) + s * below, merkle.nodes_of(top) + (s + 1) * below))


@pytest.mark.parametrize("height", [1, 2, 4])
def test_trees_of_all_sizes(spark, monkeypatch, height):
    monkeypatch.setattr(merkle, "HEIGHT", height)
    monkeypatch.setattr(merkle, "LEAVES", 8**height)
    rnd = random.Random(height)
    rows = []
    for g, n in [(None, 3), ("a", 1), ("b", 8), ("c", 9), ("d", 65), ("é", 64), ("z", 600), ("", 2)]:
        for i in range(n):
            digest = h(str(rnd.random()))
            rows.append((g, rnd.choice([i, i, i // 2, None]) if g in ("c", "d") else i, digest, h("x") if rnd.random() < 0.3 else None))
    rows += [rows[-1]] * 3 + [("d", 5, h("tie"), h("tie"))] * 20
    df = spark.createDataFrame(rows, "by string, id long, d string, c string").selectExpr("by", "id", "unhex(d) AS digest", "unhex(c) AS claim", "1 AS root").repartition(5)
    # the claims of rows that are equal in group, id and digest must be equal for one defined result: here they are
    assert got(merkle.manifest(df)) == plain([(g, i, d, c) for g, i, d, c in rows])


def test_many_groups(spark):
    rows = [(g, g, h(str(g)), None) for g in range(700)]
    df = spark.createDataFrame(rows, "by long, id long, d string, c string").selectExpr("by", "id", "unhex(d) AS digest", "unhex(c) AS claim")
    assert got(merkle.manifest(df)) == plain([(g, i, d, c) for g, i, d, c in rows])


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def document_rows(docs):
    low = lambda t: None if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    out = []
    for d, source, lang, n, text in docs:
        leaf = lambda t: h(*map(field, (d, source, lang, n, t)))
        out.append((lang, d, leaf(text), leaf(low(text)) if d is not None and zlib.crc32(str(d).encode()) % 3 == 0 else None))
    return out


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    df = QUERIES["op12_merkle_manifest"](spark, SF)
    assert got(df) == plain(document_rows(docs))


def test_edge_rows(spark):
    docs = [(1, "s", "en", 3, "AbC"), (2, None, None, None, None), (None, "s", "en", 0, ""), (3, "s", "en", 5, "A" * 200_000), (3, "s", "en", 5, "A" * 200_000),
            (3, "s", "en", 1, "other"), (9, "ß", "日本", 1, "É A"), (-4, "s", "en", 2, "x")]
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    df = spark.createDataFrame([(*d, "z", "z") for d in docs], schema + ", leaf string, rank string")
    assert got(merkle.document_manifest(df)) == plain(document_rows(docs))
    assert merkle.document_manifest(df.where("false")).count() == 0
    assert got(merkle.document_manifest(df.where("doc_id = 1"))) == plain(document_rows(docs[:1]))
