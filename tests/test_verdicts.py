"""Verdicts of seed groups: an answer is parsed once."""

from corpusforge.operators import generation as G


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def indexed(spark, groups):
    rows = [("en", "neutral", 0, s, i, f"text {i}") for s, n in groups.items() for i in range(n)]
    return spark.createDataFrame(rows, "lang string, label string, batch_idx long, seed_id long, idx int, text string")


def test_verdicts_parse_an_answer_once(spark):
    rows = indexed(spark, {1: 2, 2: 2, 3: 2, 4: 1})
    said = lambda *idx: '{"evaluations": [' + ", ".join(f'{{"idx": {i}, "verdict": "{"reject" if i else "pass"}", "reason": "why"}}' for i in idx) + "]}"
    answers = spark.createDataFrame([("en", "neutral", 0, s, r) for s, r in ((1, said(1, 0)), (2, said(0, 0)), (3, "{broken"))],
                                    "lang string, label string, batch_idx long, seed_id long, response string")
    got = G.apply_verdicts(rows, answers, "sv")
    assert plan_of(got).count("from_json(") == 1
    assert sorted((r["seed_id"], r["idx"], r["sv_verdict"], r["sv_feedback"], r["sv_cot"]) for r in got.collect()) == [
        (1, 0, "PASS", None, "Classifier: None | Semantic: None"), (1, 1, "REJECT", "why", "Classifier: None | Semantic: None"),
        (2, 0, "VALIDATION_FAILED", "sv_bijection_failure", None), (2, 1, "VALIDATION_FAILED", "sv_bijection_failure", None),
        (3, 0, "VALIDATION_FAILED", "sv_parse_failure", None), (3, 1, "VALIDATION_FAILED", "sv_parse_failure", None),
        (4, 0, "VALIDATION_FAILED", "sv_parse_failure", None)]
    assert [r["seed_id"] for r in G.answered_groups(rows, answers, "sv").collect()] == [1]
