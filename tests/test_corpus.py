"""BLEU, sampling and length metrics on small inputs with known answers."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusforge.operators import bleu, lengths, sampling, vocabulary


def sentence_bleu(refs, hyp):
    logs = 0.0
    for n in (1, 2, 3, 4):
        count = Counter(tuple(hyp[i:i + n]) for i in range(len(hyp) - n + 1))
        cap = Counter()
        for r in refs:
            for g, c in Counter(tuple(r[i:i + n]) for i in range(len(r) - n + 1)).items():
                cap[g] = max(cap[g], c)
        hit = sum(min(c, cap[g]) for g, c in count.items())
        if n == 1 and hit == 0:
            return 0.0
        logs += 0.25 * math.log((hit or 0.1) / max(1, sum(count.values())))
    near = min((len(r) for r in refs), key=lambda x: (abs(x - len(hyp)), x))
    return (1.0 if len(hyp) > near else math.exp(1 - near / len(hyp))) * math.exp(logs)


def test_bleu_against_brute_force(spark):
    rnd = random.Random(5)
    make = lambda n: " ".join(f"t{int(rnd.paretovariate(0.9)) % 9}" for _ in range(n))
    rows = [(i, "x", ("negative", "neutral")[i % 2], "syn" if i % 3 else "seed", make(rnd.randrange(1, 12))) for i in range(60)]
    rows += [(100, "x", "positive", "syn", "only one text here"), (101, "x", "neutral", "syn", ""), (102, "x", "neutral", "syn", make(5))]
    df = spark.createDataFrame(rows, "id long, lang string, label string, corpus string, text string")
    syn, seed = df.where("corpus = 'syn'"), df.where("corpus = 'seed'")
    own = {r["label"]: r["self_bleu"] for r in bleu.self_bleu(syn, ["lang", "label"]).collect()}
    ref = {r["label"]: r["bleu_vs_ref"] for r in bleu.bleu_vs_ref(syn, seed, ["lang", "label"]).collect()}
    for label in ("negative", "neutral", "positive"):
        h = [r[4].split() for r in rows if r[2] == label and r[3] == "syn"]
        s = [r[4].split() for r in rows if r[2] == label and r[3] == "seed"]
        want = [sentence_bleu(h[:i] + h[i + 1:], x) if len(h) > 1 else 0.0 for i, x in enumerate(h)]
        assert own[label] == pytest.approx(sum(want) / len(want))
        want = [sentence_bleu(s, x) if s else 0.0 for x in h]
        assert ref[label] == pytest.approx(sum(want) / len(want))


def corpus(spark, n, label="neutral", words=3, corpus="syn", start=0):
    rows = [(start + i, "x", label, corpus, " ".join(["w"] * words)) for i in range(n)]
    return spark.createDataFrame(rows, "id long, lang string, label string, corpus string, text string")


def test_half_even_quota_and_ids(spark):
    syn, seed = corpus(spark, 5), corpus(spark, 3, corpus="seed", start=40)
    assert sampling.thin(syn, 0.5).count() == 2
    out = sampling.ratio_variant(seed, syn, 0.5).orderBy("id").collect()
    assert [r["id"] for r in out] == [40, 41, 42, 43, 44]
    assert sampling.sample_seeds(syn, 0.1).count() == 1
    assert sampling.sample_seeds(syn, None).count() == 5


def test_null_groups_survive(spark):
    df = corpus(spark, 4).withColumn("label", F.when(F.col("id") > 1, F.col("label")))
    assert sampling.sample_n(df, 3, by=("label",)).count() == 4


def test_stratified_shortfall(spark):
    syn = corpus(spark, 4, words=3).unionByName(corpus(spark, 1, words=12, start=10))
    ref = corpus(spark, 2, words=3, corpus="test").unionByName(corpus(spark, 2, words=12, corpus="test", start=10)).unionByName(
        corpus(spark, 1, words=25, corpus="test", start=20))
    picked, short = sampling.stratified_sample(syn, sampling.target_dist(ref, ["lang", "label"]), total=5)
    assert picked.count() == 3
    got = {r["bucket"]: (r["quota"], r["available"], r["shortfall"]) for r in short.collect()}
    assert got == {1: (2, 1, 1), 2: (1, 0, 1)}


def test_single_row_std_and_nulls(spark):
    df = corpus(spark, 1).unionByName(corpus(spark, 1, label="positive").withColumn("text", F.lit(None).cast("string")))
    out = lengths.length_profile(df, ["label"]).collect()
    assert len(out) == 1 and out[0]["std"] is None and out[0]["mean"] == 3
    assert lengths.length_match(df).count() == 0


def test_distinct_n_of_short_texts(spark):
    r = vocabulary.distinct_n(corpus(spark, 2, words=1), 2, ["lang"]).first()
    assert (r["unique"], r["total"], r["distinct_2"]) == (0, 0, 0.0)


def test_novelty_counts_zero(spark):
    known = vocabulary.vocabulary(corpus(spark, 1, corpus="seed"), ["lang"])
    r = vocabulary.novelty(corpus(spark, 3), known, ["lang"]).first()
    assert (r["n"], r["mean"], r["below_1"], r["below_0"]) == (3, 0.0, 3, 0)


def test_bleu_counts_ngrams_per_key_by_hash(spark, monkeypatch):
    """Only numbers leave the counting tasks; n-grams of a key's texts are counted together and cross neither texts nor slices."""
    rows = [(1, "a b a b"), (1, "a b"), (2, "a b"), (3, ""), (4, "c"), (None, "a b c d e")]
    df = spark.createDataFrame([("x", i, t) for i, t in rows], "lang string, id long, text string")
    want = {}
    for i, t in rows:
        w = t.split()
        for n in bleu.ORDERS:
            for j in range(len(w) - n + 1):
                key = (i, n, tuple(w[j:j + n]))
                want[key] = want.get(key, 0) + 1
    for words in (1, 1 << 18):
        monkeypatch.setattr(bleu, "_WORDS", words)
        got = bleu._grams(bleu._worded(df, ["lang"], "id"), ["lang"])
        assert dict(got.dtypes) == {"g": "bigint", "row": "bigint", "nc": "int"}
        got = got.collect()
        assert sorted((r.nc % 4 + 1, r.nc // 4) for r in got) == sorted((n, c) for (_, n, _), c in want.items())
        assert len({r.g for r in got}) == len({k[1:] for k in want}) and len({r.row for r in got}) == 4
    report = bleu.bleu_report(df.selectExpr("id", "lang", "'positive' AS label", "text", "CASE WHEN id = 2 THEN 'seed' ELSE 'syn' END AS corpus"))
    assert "g:string" not in report._jdf.queryExecution().toString() and report.count() == 1


def test_counted_ngrams_leave_rows_as_hashes(spark, tmp_path):
    """Reports that only count n-grams shuffle numbers, and tokens are made once a row."""
    from corpusforge.catalog.texts import token_ngrams
    d = str(tmp_path)
    texts = ["A b a b", "a b", "", None, "one", "c d e c d e"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("lang", F.lit("en")).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    grams = {n: Counter(tuple(w[i:i + n]) for w in ((t or "").lower().split() for t in texts) for i in range(len(w) - n + 1)) for n in (1, 2, 3)}
    got = token_ngrams(spark, d)
    assert {r.n: (r.grams, r.distinct_grams) for r in got.collect()} == {n: (sum(c.values()), len(c)) for n, c in grams.items()}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    rows = spark.createDataFrame([("x", t) for t in texts], "lang string, text string")
    counts = vocabulary.gram_counts(rows, 2, ["lang"], hashed=True)
    assert dict(counts.dtypes)["gram"] == "bigint" and sorted(r.n for r in counts.collect()) == sorted(grams[2].values())
    report = vocabulary.distinct_n(rows, 2, ["lang"])
    assert (report.first().unique, report.first().total) == (len(grams[2]), sum(grams[2].values()))
