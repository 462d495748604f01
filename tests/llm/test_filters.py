"""Language ID, secret scan and decontamination against plain versions."""

import hashlib
import re

from corpusforge.llm import decontam, langid, secret_scan
from corpusforge.llm.queries import QUERIES
from pyspark.sql import functions as F

from . import brute

SF = "/root/testdata/sf0.001"


def docs_of(spark, sf=SF):
    return [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def test_language_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in QUERIES["op9_language_id"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    held = [d for d in docs if got[d["doc_id"]]["held_out"]]
    assert {d["doc_id"] for d in held} == {d["doc_id"] for d in docs if brute.fold(d["doc_id"]) == 2}
    named = [d for d in held if d["lang"] and any(c.isalpha() for c in d["text"] or "")]
    assert sum(got[d["doc_id"]]["lang_pred"] == d["lang"] for d in named) / len(named) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_edge_rows(spark):
    rows = [(1, "der hund und die katze", "de", 1), (2, "the dog and the cat", "en", 2), (2, "the dog and the cat", "en", 2),
            (None, None, "en", 3), (4, "", "en", 4), (5, "123 !?", None, 5), (6, "the " * 100_000, "en", 6), (7, "und die", None, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score long")
    model = langid.train(df)
    got = [(r["doc_id"], r["lang_pred"]) for r in langid.predict(df, model).collect()]
    assert sorted(got, key=repr) == sorted([(1, "de"), (2, "en"), (2, "en"), (None, "und"), (4, "und"), (5, "und"), (6, "en"), (7, "de")], key=repr)
    none = langid.train(df.where("false"))
    assert {(r["lang_pred"], r["score"]) for r in langid.predict(df, none).collect()} == {("und", 0.0)}
    assert langid.predict(df.where("false"), model).count() == 0


def test_secret_base_spans(spark):
    pats = [("assign", r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 12),
            ("access", r"AKIA[A-Z0-9]+", 18), ("hex", r"[0-9a-f]+", 16)]

    def plain(t):
        out = []
        for k, (kind, p, n) in enumerate(pats):
            for m in re.finditer(p, t):
                if len(m[1] if kind == "assign" else m[0]) >= n:
                    out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
        return [x[2] for x in sorted(out)]

    for sf in (SF, "/root/testdata/sf0.01"):
        texts = dict(docs_of(spark, sf))
        for r in QUERIES["op2_secret_scan"](spark, sf).collect():
            want = plain(texts[r["doc_id"]] or "")
            assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
            assert [s for s in r["spans"].split(",") if s and not s.startswith("markov")] == want
            assert r["n_assign"] == sum(w.startswith("assign") for w in want)


def test_secret_models_and_edges(spark):
    rng = __import__("random").Random(5)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    rand = ["".join(rng.choices(alphabet, k=24)) for _ in range(300)]
    words = ["configuration_value_loader", "initialize_database_connection", "userAccountSettings", "remove-old-entries"] * 80
    model = secret_scan.fit(spark.createDataFrame([(True, t) for t in rand[:200]] + [(False, t) for t in words] + [(None, "x"), (True, None)],
                                                  "random boolean, token string"))
    assert sum(model.random_like(t) for t in rand[200:]) >= 97
    assert not any(model.random_like(t) for t in words)
    rows = [(1, None, 0), (1, None, 0), (2, "", 0), (3, "a " * 50_000 + "password = abcdefghijkl " + rand[250], 0), (None, "é Token:'abc.def-ghi=jk'", 0),
            (4, "password: token: abcdefghijklmnop", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, secret_spans int")
    got = {r["doc_id"]: r["secret_spans"] for r in secret_scan.scan(df, model).collect()}
    assert got[1] == [] and got[2] == [] and all(s["kind"] == "markov" for s in got[4])
    assert [s["kind"] for s in got[3]] == ["assign", "markov"] and got[3][0]["start"] == 100_000
    assert [tuple(s) for s in got[None]] == [("assign", 2, 23)]
    safe = secret_scan.scan(df, model).withColumn("safe", secret_scan.redact(F.col("text"), F.col("secret_spans")))
    safe = {r["doc_id"]: r["safe"] for r in safe.collect()}
    assert safe[None] == "é [SECRET]'" and safe[1] is None and safe[3].endswith("a [SECRET] [SECRET]")
    assert secret_scan.fit(df.where("false").selectExpr("true random", "text token")).ratio is None


def test_decontaminate(spark):
    items = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    got = [tuple(r) for r in QUERIES["op4_decontaminate"](spark, SF).collect()]
    assert sorted(got) == sorted(brute.decontaminate(docs_of(spark), items))


def test_decontaminate_edges(spark):
    items = [(1, "Alpha beta"), (2, "x"), (3, None), (4, ""), (5, " ".join(f"w{i}" for i in range(25))), (6, "a b a b a b a b a b a b a b"),
             (5, " ".join(f"w{i}" for i in range(25))), (7, "p q r"), (None, "zeta eta theta"), (9, " ".join(f"w{i}" for i in range(12)))]
    docs = [(1, "the alpha BETA, gamma"), (2, None), (3, ""), (4, " ".join(f"w{i}" for i in range(3, 14)) + " x x"), (4, "Alpha beta alpha-beta"),
            (5, "b a " * 20), (5, "b a " * 20), (6, "q r p q r p q"), (None, "alpha beta"), (8, "zeta eta theta"), (9, "é " * 30_000 + "p q r"), (10, "..")]
    d = spark.createDataFrame([(*r, "z") for r in docs], "doc_id long, text string, runs string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.decontaminate(d, b).collect()
    got = [(r["doc_id"], r["n_words"], r["n_hit"], len(r["items"])) for r in got]
    want = [x[:4] for x in brute.decontaminate(docs, [i for i in items if i[0] is not None])]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert decontam.decontaminate(d.where("false"), b).count() == 0
    assert {r["n_hit"] for r in decontam.decontaminate(d, b.where("false")).collect()} == {0}


def test_rare_secrets_are_samples(spark):
    texts = [f"ordinary_words number{i} and configuration_values" for i in range(400)]
    for i in (7, 99, 250):
        texts[i] += f" password = Xk{i}vQ81zLmT0pRw9aBc"
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = secret_scan.samples(df, max_rows=20)
    assert sorted(r["token"] for r in got.where("random").collect()) == sorted(f"Xk{i}vQ81zLmT0pRw9aBc" for i in (7, 99, 250))
    assert 0 < got.where("NOT random").count() < 400
    assert secret_scan.fit(got).ratio is not None
    many = spark.createDataFrame([(f"password = Xk{i}vQ81zLmT0pRw9aBc",) for i in range(1000)], "text string")
    assert 20 < secret_scan.samples(many, max_random=100).where("random").count() < 300
