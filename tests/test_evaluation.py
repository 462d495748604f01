"""Scores, run tables and selection rules."""

import math

import pytest
from pyspark.sql import functions as F

from corpusforge import testbed
from corpusforge.operators import classification as C
from corpusforge.operators import outcomes, runs

SF = "/root/testdata/sf0.001"


def test_class_never_predicted(spark):
    rows = [("m", "neutral", "negative"), ("m", "negative", "negative"), ("m", "positive", "positive")]
    df = spark.createDataFrame(rows, "model string, true_label string, pred_label string")
    rep = {r["label"]: r for r in C.class_report(df, ["model"]).collect()}
    assert rep["neutral"]["precision"] == 0.0 and rep["neutral"]["recall"] == 0.0 and rep["neutral"]["support"] == 1
    assert C.macro_f1(df, ["model"]).first()["f1"] == pytest.approx((2 / 3 + 0 + 1) / 3)
    assert C.confusion(df, ["model"]).count() == 3


def test_absent_class_is_left_out(spark):
    df = spark.createDataFrame([("m", "neutral", "neutral"), ("m", "negative", "negative")], "model string, true_label string, pred_label string")
    assert C.macro_f1(df, ["model"]).first()["f1"] == 1.0


def test_chi_square_and_p(spark):
    a, b, c, d = 10, 20, 30, 15
    n = a + b + c + d
    want = n * (abs(a * d - b * c) - n / 2) ** 2 / ((a + b) * (c + d) * (a + c) * (b + d))
    got = spark.range(1).select(C.chi_square(*[F.lit(x) for x in (a, b, c, d)]), C.erfc(F.sqrt(F.lit(want / 2)))).first()
    assert got[0] == pytest.approx(want)
    assert got[1] == pytest.approx(math.erfc(math.sqrt(want / 2)), rel=1e-6)


def test_mann_whitney(spark):
    wrong, right = [5, 9, 9, 30, 40], [3, 4, 9, 10, 2, 2, 7]
    rows = [("neutral", "negative", " ".join(["w"] * n)) for n in wrong] + [("neutral", "neutral", " ".join(["w"] * n)) for n in right]
    r = C.mann_whitney(spark.createDataFrame(rows, "true_label string, pred_label string, text string"), by=()).first()
    u = sum((x > y) + 0.5 * (x == y) for x in wrong for y in right)
    both = wrong + right
    n, n1, n2 = len(both), len(wrong), len(right)
    ties = sum(both.count(v) ** 3 - both.count(v) for v in set(both))
    z = (max(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / math.sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1))))
    assert r["u"] == u and r["z"] == pytest.approx(z) and r["p_value"] == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-6)


def test_greedy_ensemble_is_sequential(spark):
    p = testbed.predictions(spark, SF).where("split = 'valid'").cache()
    got = {}
    for r in C.greedy_ensemble(p).orderBy("step").collect():
        got.setdefault((r["model"], r["lang"]), []).append((r["seed"], r["action"]))
    rows = p.collect()

    def f1(members, key):
        probs, truth = {}, {}
        for r in rows:
            if (r["model"], r["lang"]) == key and r["seed"] in members:
                e = [math.exp(z) for z in r["logits"]]
                acc = probs.setdefault(r["example_id"], [0, 0, 0])
                for i in range(3):
                    acc[i] += e[i] / sum(e)
                truth[r["example_id"]] = ["negative", "neutral", "positive"].index(r["true_label"])
        total, seen = 0.0, 0
        for c in range(3):
            tp = sum(1 for k, v in probs.items() if v.index(max(v)) == c == truth[k])
            both = sum(1 for v in probs.values() if v.index(max(v)) == c) + sum(1 for t in truth.values() if t == c)
            total, seen = total + (2 * tp / both if both else 0), seen + (both > 0)
        return total / seen

    for key, log in got.items():
        seeds = sorted({r["seed"] for r in rows if (r["model"], r["lang"]) == key})
        order = sorted(seeds, key=lambda s: (-round(f1({s}, key), 12), s))
        chosen, best, want = {order[0]}, f1({order[0]}, key), [(order[0], "start")]
        for s in order[1:]:
            v = f1(chosen | {s}, key)
            want.append((s, "ADD" if v >= best - 1e-12 else "skip"))
            if v >= best - 1e-12:
                chosen, best = chosen | {s}, v
        assert log == want


def test_history_rules(spark):
    rows = [("r", 0, 1.0, 0.9, None, None), ("r", 1, 1.0, None, 0.8, 0.5), ("r", 2, 1.0, None, 0.7, 0.6), ("r", 3, 2.0, None, 0.6, 0.6), ("r", 4, 3.0, None, 0.6, 0.1)]
    h = spark.createDataFrame(rows, "run string, pos int, epoch double, loss double, eval_loss double, eval_f1 double")
    b = runs.best_epoch(h, ["run"]).first()
    assert (b["best_epoch"], b["stop_epoch"]) == (1.0, 3.0)
    assert {r["epoch"]: r["eval_loss"] for r in runs.dedupe_epoch(h, ["run"]).collect()} == {1.0: 0.7, 2.0: 0.6, 3.0: 0.6}
    assert runs.loss_curves(h, ["run"]).count() == 3


def test_run_tables(spark):
    rows = [("a", 0, "x", .9, .8, .7), ("a", 1, "x", .9, .7, .72), ("b", 0, "x", .95, .8, .65), ("b", 0, "y", .9, .5, .5)]
    r = spark.createDataFrame(rows, "config string, seed int, lang string, train_f1 double, val_f1 double, test_f1 double").withColumn("gap", F.expr("train_f1 - test_f1"))
    stats = {(s["config"], s["lang"]): s for s in runs.seed_stats(r, ("test_f1",)).collect()}
    assert stats[("b", "x")]["std"] is None and stats[("a", "x")]["n"] == 2
    v = {x["lang"]: x["verdict"] for x in runs.verdict(r, "b", "a").collect()}
    assert v == {"x": "regression", "y": "?"}
    grid = r.select("config", "seed", "lang")
    assert runs.pending_units(grid, r.where("config = 'a'")).count() == 2


def test_chain_over_correction(spark):
    log = testbed.outcome_log(spark, SF)
    r = outcomes.retry_chains(log).agg(F.sum("attempts_1"), F.sum("attempts_2"), F.sum("attempts_3"), F.sum("chains")).first()
    assert r[0] + r[1] + r[2] == r[3] == log.select("target_lang", "seed_id", "plan_id").distinct().count()


def test_training_queries_are_whole(spark, monkeypatch):
    from corpusforge.catalog import QUERIES
    from corpusforge.operators import training

    used, sizes, fit, featured = [], [], training.fit, training.featured
    monkeypatch.setattr(training, "fit", lambda rows, seed, params, on: used.append(params) or fit(rows, seed, {**params, "iterations": 1}, on))
    monkeypatch.setattr(training, "featured", lambda c, n, *splits: sizes.append(n) or featured(c, 64, *splits))
    langs = {"de", "en", "es", "fr"}
    got = QUERIES["sweep"](spark, SF).select("config", "seed", "lang").collect()
    assert len(got) == len(set(got)) == len(used) == 2 * 5 * 4
    assert {r["lang"] for r in got} == langs and {r["seed"] for r in got} == {r[0] for r in testbed.predictions(spark, SF).select("seed").distinct().collect()}
    for name in ("train_per_language", "train_pooled"):
        assert {r["lang"] for r in QUERIES[name](spark, SF).select("lang").collect()} == langs
    assert {u["iterations"] for u in used} == {training.DEFAULTS["iterations"]} and set(sizes) == {training.DEFAULTS["features"]}


def test_logits_follow_coefficients_and_weights(spark):
    from corpusforge.operators import training

    rows = training.featured(testbed.corpus(spark, SF).where("lang = 'en'"), 32, ("seed",), ("test",))
    params = {**training.DEFAULTS, "iterations": 5}
    model = training.fit(rows, 3, params, ("seed",))
    matrix, bias = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    logits = {r["example_id"]: r["logits"] for r in training.predict(model, rows.where("corpus = 'test'"), "m", 3).collect()}
    for r in rows.where("corpus = 'test'").select("id", "features").collect():
        assert logits[r["id"]] == pytest.approx(list(matrix @ r["features"].toArray() + bias))
    weights = {w for (w,) in rows.select(training.draw_weight(3)).distinct().collect()}
    assert weights == {1.0, 2.0}
    other = training.fit(rows, 4, params, ("seed",)).coefficientMatrix.toArray()
    assert abs(matrix - other).max() > 0  # another seed weighs the rows otherwise
