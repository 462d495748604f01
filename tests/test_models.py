"""Model stages and the response contract."""

import json
import os

from corpusforge.operators import generation, scoring
from corpusforge.schemas import LANGUAGE_RESPONSE, PLAN_RESPONSE, SENTENCE_RESPONSE
from pyspark.sql import functions as F


def test_one_bad_payload_spoils_no_other(spark):
    def answer(payloads):
        if any("bad" in p for p in payloads):
            raise ValueError("bad payload")
        return [json.dumps({"n": len(p)}) for p in payloads]

    rows = spark.createDataFrame([(i, "bad" if i == 137 else f"p{i}") for i in range(1000)], "id long, payload string").coalesce(1)
    got = {r["id"]: r for r in scoring.call_model(rows, answer).collect()}
    assert [i for i, r in got.items() if r["response"] is None] == [137]
    assert got[137]["error"] == "ValueError: bad payload" and got[1]["error"] is None


def test_one_model_per_worker(spark, tmp_path):
    log = str(tmp_path)

    def make():
        open(os.path.join(log, f"{os.getpid()}-{os.urandom(4).hex()}"), "w").close()
        return lambda texts, langs: (["Neutral"] * len(texts), [0.5] * len(texts))

    rows = spark.range(160).selectExpr("id", "'t' AS text", "'en' AS lang").repartition(16)
    assert scoring.score_sentiment(rows, make).where("sentiment_label = 'neutral'").count() == 160
    built = [n.split("-")[0] for n in os.listdir(log)]
    assert len(built) == len(set(built)) <= 8


def parsed(spark, body, schema, field):
    rows = spark.createDataFrame([(json.dumps(b) if not isinstance(b, str) else b,) for b in body], "response string")
    return [r["parsed"] is not None for r in generation.parse(rows, schema, field).collect()]


def test_required_fields(spark):
    v = {"strategy": "s", "preserve": "p"}
    seed = {"seed_id": 1, "domain": "d", "style": "s", "sentiment_expression": "e", "variations": [v] * 5}
    bodies = [{"seed_analyses": [x]} for x in (seed, seed | {"variations": [v] * 4}, seed | {"variations": [v] * 4 + [{"strategy": "s"}]}, {k: seed[k] for k in seed if k != "domain"})]
    assert parsed(spark, bodies + ["{broken"], PLAN_RESPONSE, "seed_analyses") == [True, False, False, False, False]
    bodies = [{"sentences": x} for x in ([{"plan_id": 0, "text": "a"}], [{"plan_id": 0, "text": "a"}, {"plan_id": 1}], [{"text": "a"}])]
    assert parsed(spark, bodies, SENTENCE_RESPONSE, "sentences") == [True, False, False]
    bodies = [{"evaluations": [{"idx": 0, "verdict": x}]} for x in ("PASS", "reject", "maybe", None)]
    assert parsed(spark, bodies, LANGUAGE_RESPONSE, "evaluations") == [True, True, False, False]


def test_arms_are_compared_seed_by_seed(spark):
    from corpusforge.operators.runs import compare_arms
    rows = [("base", 1, "x", .80), ("base", 2, "x", .60), ("aug", 1, "x", .70), ("aug", 2, "x", .75)]
    got = compare_arms(spark.createDataFrame(rows, "config string, seed int, lang string, test_f1 double"), "base", "aug").where(F.col("lang") == "x")
    assert sorted((r["seed"], r["baseline"], r["augmented"], r["delta"]) for r in got.collect()) == [(1, 80.0, 70.0, -10.0), (2, 60.0, 75.0, 15.0)]
