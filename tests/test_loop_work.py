"""Answers of the loop: written without their requests, parsed once."""

from corpusforge import testbed
from corpusforge.operators import generation as G
from corpusforge.plans import generation as P


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_answers_are_written_without_their_requests(spark):
    rows = [("en", "neutral", b, b * 5 + i, f"some words of text {i}") for b in range(14) for i in range(5)]
    seeds = spark.createDataFrame(rows, "lang string, label string, batch_idx long, id long, text string")
    asked = G.with_context(G.plan_requests(seeds), G.batch_context(seeds, spark.createDataFrame([("en", "neutral", 4.0, 1.0)], "lang string, label string, mean double, std double"), {}))
    got = P._twice(asked, testbed.plan_model, lambda r: G.planned_batches(r, seeds))
    assert got.columns == [*G.BATCH, "response"]
    plans = G.flatten_plans(got, seeds)
    assert plan_of(plans).count("from_json(") == 2  # once in first and once in second answers
    # batch 6 of 7 recovers when asked again, 3 and 5 never do; ids count over the batch in response order
    assert {r["batch_idx"] for r in plans.collect()} == {b for b in range(14) if b % 7 not in (3, 5)}
    one = plans.where("batch_idx = 6").orderBy("plan_id").collect()
    assert [(r["plan_id"], r["seed_id"], r["strategy"]) for r in one] == [(p, 30 + p // 5, f"strategy {p % 5}") for p in range(25)]
    assert one[7]["original_text"] == "some words of text 1"
