"""SentencePiece dropout: plain segmentation without dropout, exact round trip with it."""

import hashlib
import zlib

import numpy as np
import sentencepiece
from corpusforge.llm import sentpiece
from corpusforge.llm.queries import QUERIES

from .test_filters import SF, docs_of

TEXTS = ["", " a  b\nc\td é ", "日本語 テキスト 😀 ▁ ▁▁x▁", "▁", "a" * 300 + " " * 70, "<s> </s> <0x41>", "x\x00y​", "Zeile\r\nZwei  ", "5 m². ½, x²., don't (a.b) »c», e.g. !?"]


def test_no_dropout_is_plain_bpe(spark):
    v = sentpiece.load(sentpiece.model_path())
    sp = sentencepiece.SentencePieceProcessor(model_file=sentpiece.model_path())
    for t in [t for _, t in docs_of(spark)] + [x for x in TEXTS if "▁" not in x]:
        assert sentpiece.encode(t, v, dummy_prefix=True) == (sp.encode(t) if t else [])


def test_short_and_long_agenda_agree():
    v = sentpiece.load(sentpiece.model_path())
    unit = "▁internationalizationoftheworldwide"
    for limit in (0, 1 << 29, 1 << 31):
        for key in range(20):
            for n in (2, 5, 17, 32):
                part = unit[:n]
                want = sentpiece._merge(part + "\n" * 40, v, 0, key)[:-40] if not limit else None
                assert want is None or want == sentpiece._merge(part, v, 0, key)
                assert sentpiece.decode(sentpiece._merge(part, v, limit, key), v) == part.replace("▁", " ")


def test_side_by_side_is_the_same(spark):
    v = sentpiece.load(sentpiece.model_path())
    texts = [t for _, t in docs_of(spark)][:40] + [t for t in TEXTS if "▁" not in t]
    units = list({u for t in texts for u in v.split.findall(t.replace(" ", "▁"))}) + ["日本語", "é" * 33, "x😀y", "q" * 32]
    for limit in (0, 1 << 29, 1 << 31, 1 << 32):
        assert sentpiece._merge_many(units, v, limit, 5) == [sentpiece._merge(u, v, limit, 5) for u in units]
    assert sentpiece.encode_many(texts, v, 0.2, 9) == [sentpiece.encode(t, v, 0.2, 9) for t in texts]


def test_round_trip_and_seeds(spark):
    v = sentpiece.load(sentpiece.model_path())
    texts = [t for _, t in docs_of(spark)][:60] + TEXTS
    plain = [sentpiece.encode(t, v) for t in texts]
    seeds = [[sentpiece.encode(t, v, 0.2, s) for t in texts] for s in (1, 1, 2)]
    assert seeds[0] == seeds[1] != seeds[2] != plain
    for ids in (plain, *seeds):
        assert [sentpiece.decode(i, v) for i in ids] == texts
    assert sum(map(len, seeds[0])) > sum(map(len, plain))
    assert [sentpiece.decode(sentpiece.encode(t, v, 1.0, 3), v) for t in texts] == texts


def test_query(spark):
    texts = dict(docs_of(spark))
    got = QUERIES["op6_sentencepiece_dropout"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    assert all(r["lossless"] and r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest() for r in got)


def test_edges(spark):
    rows = [(1, t, "x") for t in TEXTS] + [(None, None, "y"), (None, "abc", "y"), (3, "w " * 60_000, "z"), (3, "w " * 60_000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = sentpiece.encode_table(df, sentpiece.model_path(), 0.3, 5)
    back = sentpiece.decode_table(out, sentpiece.model_path()).collect()
    assert sorted(r["decoded"] for r in back) == sorted(r[1] or "" for r in rows)
    for r in back:
        assert r["n_tokens"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    assert sentpiece.encode_table(df.where("false"), sentpiece.model_path()).count() == 0


def test_every_occurrence_draws_anew(spark):
    v = sentpiece.load(sentpiece.model_path())
    word, n = " internationalization", 300
    df = spark.createDataFrame([(d, word * n) for d in range(40)], "doc_id long, text string").repartition(4)
    rows = sentpiece.encode_table(df, sentpiece.model_path(), 0.1, 17).collect()
    assert len({tuple(r["ids"]) for r in rows}) == 40
    seen = [set() for _ in rows]
    for r, s in zip(rows, seen):
        one, left = [], word
        for i in r["ids"]:
            one.append(i)
            left = left[len(v.pieces[i].decode()):]
            if not left:
                s.add(tuple(one))
                one, left = [], word
        assert not one
    assert min(map(len, seen)) > 10 and len(set.union(*seen)) > 2 * max(map(len, seen))


def test_remembered_draws_are_the_same(spark, monkeypatch):
    v = sentpiece.load(sentpiece.model_path())
    texts = [t for _, t in docs_of(spark)][:40] * 2 + TEXTS
    seeds = [7 + i // 3 for i in range(len(texts))]
    for dropout in (0.1, 0.5, 1.0):
        limit = int(dropout * (1 << 32))
        want = []
        for t, s in zip(texts, seeds):
            units = sentpiece._units(t, v)
            keys = sentpiece._keys(np.uint64(s), np.arange(len(units)))
            want.append([i for u, k in zip(units, keys.tolist()) for i in (sentpiece._merge(u, v, limit, k) if u else sentpiece._literal(v))])
        for cache in (80_000, 50):
            monkeypatch.setattr(sentpiece, "CACHE", cache)
            v.known.clear()
            assert sentpiece.encode_many(texts, v, dropout, seeds) == want
            assert sentpiece.encode_many(texts[::-1], v, dropout, seeds[::-1]) == want[::-1]
