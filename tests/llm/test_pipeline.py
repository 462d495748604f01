"""The pipeline, stage by stage, against plain versions."""

import corpus_pipeline
from corpusforge.llm import secret_scan, sentpiece
from corpusforge.session import materialize
from pyspark.sql import functions as F

from . import brute
from .test_filters import SF


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages(spark, monkeypatch):
    docs = materialize(spark.read.parquet(f"{SF}/documents.parquet"))
    before, columns = rows(docs), docs.columns
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF))
        out[name] = (before, rows(docs))
        if name != "encode":
            assert docs.columns == columns
        before = out[name][1]

    old, new = out["language_id"]
    assert set(old) - set(new) == {d for d, r in old.items() if not any(c.isalpha() for c in r["text"] or "")}

    old, new = out["near_copies"]
    sets = brute.shingle_set
    monkeypatch.setattr(brute, "shingle_set", lambda t, n=3: sets(t, 5))
    assert set(new) == {d for d, _, c in brute.components([(d, r["text"]) for d, r in old.items()], 80) if d == c}
    assert all(new[d] == old[d] for d in new)

    old, new = out["decontamination"]
    items = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert set(new) == {x[0] for x in brute.decontaminate([(d, r["text"]) for d, r in old.items()], items) if not x[5]}

    old, new = out["secrets"]
    assert set(new) == set(old)
    for d, r in new.items():
        assert r["n_chars"] == len(r["text"])
        assert not secret_scan.base_spans(r["text"])
        if not secret_scan.base_spans(old[d]["text"]) and "[SECRET]" not in r["text"]:
            assert r["text"] == old[d]["text"]

    old, new = out["encode"]
    v = sentpiece.load(sentpiece.model_path())
    assert set(new) == set(old) and all(r["lossless"] and sentpiece.decode(r["ids"], v) == old[d]["text"] for d, r in new.items())


def test_odd_tables(spark):
    ddl = "doc_id long, text string, lang string, source string, n_chars long, _lang string, runs int, _key string, _spans string, lang_pred string, SCORE int, text_key string"
    odd = [(None, None, None, None, None, "x", 1), (1, "", "en", "s", 0, "x", 1), (2, "the cat sat on the mat again " * 30, "en", None, 5, None, 1),
           (2, "the cat sat on the mat again " * 30, "en", None, 5, None, 1), (3, "the cat sat on the mat again " * 30 + "x", "en", None, 5, None, 1),
           (None, "a quiet text of its own that nobody copied today", None, None, 1, None, None)]
    mine = ("mine", "spans", "tongue", 7, "keyed")
    df = spark.createDataFrame([(*r, *mine) for r in odd], ddl)
    for docs in (df, df.where("false")):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            columns = docs.columns
            docs = materialize(stage(spark, docs, SF))
            if name != "encode":
                assert docs.columns == columns
                assert {tuple(r) for r in docs.select("_key", "_spans", "lang_pred", "SCORE", "text_key").collect()} <= {mine}
                assert {tuple(r) for r in docs.select("doc_id", "_lang", "runs").collect()} <= {(r[0], r[5], r[6]) for r in odd}
        assert docs.count() == (2 if n else 0)
        assert docs.where(F.col("lossless")).count() == docs.count()
