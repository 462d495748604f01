"""Evaluation of per-example predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import LABELS
from ..functions.numeric import argmax, erfc, pct, py_round, softmax
from ..functions.text import tokens, word_count
from ..session import join_on, materialize
from .ranking import top_k
from .vocabulary import label_markers, vocabulary

SIDE = ["model", "seed", "lang", "split"]


def encode_label(corpus: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``label_id``: position of the label among the sorted distinct labels of its group."""
    by = by or []
    names = corpus.select(*by, "label").where(F.col("label").isNotNull()).distinct()
    order = names.groupBy(*by).agg(F.sort_array(F.collect_list("label")).alias("_all"))  # one entry per class
    if not by:
        return corpus.crossJoin(order).withColumn("label_id", F.array_position("_all", F.col("label")) - 1).drop("_all")
    return join_on(corpus, order, by, "left").withColumn("label_id", F.array_position("_all", F.col("label")) - 1).drop("_all")


def with_pred(predictions: DataFrame, labels: list[str] = LABELS) -> DataFrame:
    """Adds pred_label (first maximum of the logits) and conf (its softmax probability)."""
    names = F.array(*[F.lit(x) for x in labels])
    return predictions.withColumns({
        "pred_label": F.element_at(names, argmax("logits") + 1), "conf": F.array_max(softmax("logits"))})


def _cells(by: list[str], rows: DataFrame, labels: list[str]) -> DataFrame:
    """All cells of the confusion matrix of each group in one aggregation."""
    cell = lambda t, p: F.count_if((F.col("true_label") == t) & (F.col("pred_label") == p)).alias(f"c_{t}_{p}")
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[cell(t, p) for t in labels for p in labels])


def confusion(rows: DataFrame, by: list[str], labels: list[str] = LABELS) -> DataFrame:
    """One row per true label with a count column ``pred_<label>``; absent classes are zero rows."""
    lines = F.array(*[
        F.struct(F.lit(t).alias("true_label"), *[F.col(f"c_{t}_{p}").alias(f"pred_{p}") for p in labels]) for t in labels])
    return _cells(by, rows, labels).select(*by, F.explode(lines).alias("_r")).select(*by, "_r.*")


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def class_report(rows: DataFrame, by: list[str], labels: list[str] = LABELS) -> DataFrame:
    """Precision, recall, F1 and support per class; a zero denominator gives 0.0."""
    entries = []
    for t in labels:
        tp = F.col(f"c_{t}_{t}")
        support = sum((F.col(f"c_{t}_{p}") for p in labels), F.lit(0))
        predicted = sum((F.col(f"c_{p}_{t}") for p in labels), F.lit(0))
        entries.append(F.struct(
            F.lit(t).alias("label"), _ratio(tp, predicted).alias("precision"), _ratio(tp, support).alias("recall"),
            _ratio(2 * tp, predicted + support).alias("f1"), support.alias("support"), predicted.alias("predicted")))
    return _cells(by, rows, labels).select(*by, F.explode(F.array(*entries)).alias("_r")).select(*by, "_r.*")


def macro_f1(rows: DataFrame, by: list[str], labels: list[str] = LABELS) -> DataFrame:
    """Macro F1 over the classes seen in truth or prediction, and accuracy."""
    cells = _cells(by, rows, labels)
    hits, scores, present = F.lit(0), F.lit(0.0), F.lit(0)
    for t in labels:
        both = sum((F.col(f"c_{t}_{p}") + F.col(f"c_{p}_{t}") for p in labels), F.lit(0))
        hits = hits + F.col(f"c_{t}_{t}")
        scores = scores + _ratio(2 * F.col(f"c_{t}_{t}"), both)
        present = present + F.when(both > 0, 1).otherwise(0)
    return cells.select(*by, F.col("n"), F.try_divide(scores, present).alias("f1"), (hits / F.col("n")).alias("accuracy"))


def results(predictions: DataFrame) -> DataFrame:
    """One row per (config, seed, lang) with train, validation and test scores and the gap."""
    scored = macro_f1(with_pred(predictions), SIDE)
    pick = lambda c, s, name: F.max(F.when(F.col("split") == s, F.col(c))).alias(name)
    names = {"train": "seed", "val": "valid", "test": "test"}
    return scored.groupBy(F.col("model").alias("config"), "seed", "lang").agg(*[
        pick(c, s, f"{n}_{m}") for n, s in names.items() for c, m in (("f1", "f1"), ("accuracy", "accuracy"))
    ]).withColumn("gap", F.col("train_f1") - F.col("test_f1"))


def class_delta(rows: DataFrame, base: str, aug: str, by: tuple[str, ...] = ("lang",)) -> DataFrame:
    """F1 per class of two models and the difference, in points."""
    rep = class_report(rows.where(F.col("model").isin(base, aug)), ["model", *by])
    side = lambda m, n: F.max(F.when(F.col("model") == m, F.col("f1") * 100)).alias(n)
    return rep.groupBy(*by, "label").agg(side(base, "base_f1"), side(aug, "aug_f1")).withColumn(
        "delta", F.col("aug_f1") - F.col("base_f1"))


def class_delta_wide(delta: DataFrame, by: tuple[str, ...] = ("lang",)) -> DataFrame:
    return delta.groupBy(*by).agg(*[
        F.max(F.when(F.col("label") == x, F.col("delta"))).alias(x) for x in LABELS])


def class_delta_mean(delta: DataFrame) -> DataFrame:
    return delta.groupBy("label").agg(F.avg("delta").alias("mean_delta"))


def confident_errors(rows: DataFrame, by: list[str], k: int = 15, key: str = "example_id") -> DataFrame:
    """The k most confident wrong predictions of each group."""
    return top_k(rows.where(F.col("true_label") != F.col("pred_label")), by, [F.desc("conf"), key], k, key)


def with_implicit(rows: DataFrame, texts: DataFrame, seeds: DataFrame, key: str = "example_id") -> DataFrame:
    """Adds ``implicit`` (no token marks the true label) and token/word facts of the example.

    ``texts`` has (lang, id, text); ``seeds`` supplies the label markers per language.
    """
    return join_on(rows, implicit_flags(texts, seeds).withColumnRenamed("id", key), ["lang", key])


def implicit_flags(texts: DataFrame, seeds: DataFrame) -> DataFrame:
    """(lang, id, implicit) of labelled texts."""
    marks = label_markers(seeds, ["lang"]).select("lang", "token", "label")
    exploded = texts.where(F.col("text").isNotNull()).select(
        "lang", "id", "label", F.explode(F.array_distinct(tokens("text"))).alias("token"))
    explicit = join_on(exploded, marks, ["lang", "token", "label"], "left_semi").select("lang", "id").distinct()
    flagged = join_on(texts, explicit.withColumn("_x", F.lit(True)), ["lang", "id"], "left")
    return flagged.select("lang", "id", F.col("_x").isNull().alias("implicit"))


def chi_square(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Statistic of a 2x2 table with continuity correction; null when a margin is empty."""
    n = a + b + c + d
    cross = F.abs((a * d - b * c).cast("double"))
    corrected = F.greatest(F.lit(0.0), cross - n / 2)
    margins = (a + b).cast("double") * (c + d) * (a + c) * (b + d)
    return F.try_divide(n * corrected * corrected, margins)


def implicit_errors(rows: DataFrame, by: list[str]) -> DataFrame:
    """Error rates of implicit and explicit examples with lift, chi-square and error make-up.

    ``rows`` carries true_label, pred_label, conf and implicit.
    """
    ok, imp = F.col("true_label") == F.col("pred_label"), F.col("implicit")
    neutral = (F.col("true_label") == "neutral") | (F.col("pred_label") == "neutral")
    n = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~ok).alias("errors"),
        F.count_if(imp & ~ok).alias("imp_wrong"), F.count_if(imp & ok).alias("imp_right"),
        F.count_if(~imp & ~ok).alias("exp_wrong"), F.count_if(~imp & ok).alias("exp_right"),
        F.count_if(~ok & neutral).alias("neutral_wrong"), F.count_if(~ok & (py_round("conf", 3) > 0.9)).alias("sure_wrong"))
    iw, ir, ew, er = (F.col(c) for c in ("imp_wrong", "imp_right", "exp_wrong", "exp_right"))
    out = n.withColumns({
        "err_implicit": F.try_divide(iw.cast("double"), iw + ir), "err_explicit": F.try_divide(ew.cast("double"), ew + er),
        "chi2": chi_square(er, ew, ir, iw),
        "implicit_share": F.try_divide(iw.cast("double"), F.col("errors")),
        "neutral_share": F.try_divide(F.col("neutral_wrong").cast("double"), F.col("errors")),
        "confident_share": F.try_divide(F.col("sure_wrong").cast("double"), F.col("errors")),
    })
    return out.withColumn("lift", F.try_divide("err_implicit", "err_explicit")).withColumn(
        "p_value", erfc(F.sqrt(F.col("chi2") / 2)))


def length_errors(rows: DataFrame, label: str = "neutral", by: tuple[str, ...] = ("model", "seed", "lang")) -> DataFrame:
    """Words of wrong and right texts of one class per run and language (rows carry ``text``)."""
    worded = rows.where(F.col("true_label") == label).withColumns({
        "wc": word_count("text"), "wrong": F.col("pred_label") != label})
    return worded.groupBy(*by).agg(
        F.count_if("wrong").alias("wrong_n"), F.coalesce(F.avg(F.when(F.col("wrong"), F.col("wc"))), F.lit(0.0)).alias("wrong_mean"),
        F.count_if(~F.col("wrong")).alias("right_n"), F.coalesce(F.avg(F.when(~F.col("wrong"), F.col("wc"))), F.lit(0.0)).alias("right_mean"))


def mann_whitney(rows: DataFrame, label: str = "neutral", by: tuple[str, ...] = ("model", "seed")) -> DataFrame:
    """Two-sided Mann-Whitney test of word counts per run, wrong against right, with tie and continuity correction.

    Only the counts per length enter the rank sums, so ranks are taken over distinct lengths.
    """
    worded = rows.where(F.col("true_label") == label).withColumns({
        "wc": word_count("text"), "wrong": F.col("pred_label") != label})
    hist = worded.groupBy(*by, "wc").agg(F.count_if("wrong").alias("w"), F.count_if(~F.col("wrong")).alias("r"), F.count(F.lit(1)).alias("t"))
    order = Window.partitionBy(*by).orderBy("wc").rowsBetween(Window.unboundedPreceding, -1)
    ranked = hist.withColumn("rank", F.coalesce(F.sum("t").over(order), F.lit(0)) + (F.col("t") + 1) / 2)
    t = F.col("t").cast("double")
    s = ranked.groupBy(*by).agg(
        F.sum("w").cast("double").alias("n1"), F.sum("r").cast("double").alias("n2"), F.sum(F.col("rank") * F.col("w")).alias("r1"),
        F.sum(t * t * t - t).alias("ties"), F.sum(F.col("wc") * F.col("w")).alias("s1"), F.sum(F.col("wc") * F.col("r")).alias("s2"),
        F.sum(F.when(F.col("wc") > 30, F.col("w")).otherwise(0)).alias("w30"), F.sum(F.when(F.col("wc") > 30, F.col("r")).otherwise(0)).alias("r30"))
    n1, n2 = F.col("n1"), F.col("n2")
    n = n1 + n2
    u1 = F.col("r1") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.try_divide(F.col("ties"), n * (n - 1))))
    z = F.try_divide(F.greatest(u1, n1 * n2 - u1) - n1 * n2 / 2 - 0.5, sd)
    return s.select(
        *by, n1.alias("wrong_n"), n2.alias("right_n"), F.try_divide("s1", n1).alias("wrong_mean"), F.try_divide("s2", n2).alias("right_mean"),
        pct(F.col("w30"), n1).alias("wrong_over30"), pct(F.col("r30"), n2).alias("right_over30"), u1.alias("u"), z.alias("z"),
        F.least(F.lit(1.0), erfc(F.greatest(z, F.lit(0.0)) / F.sqrt(F.lit(2.0)))).alias("p_value"))


def align_parallel(corpus: DataFrame, ref_lang: str, key: str) -> DataFrame:
    """Rows with the text of the same example in ``ref_lang``, empty when there is none."""
    ref = corpus.where(F.col("lang") == ref_lang).select(key, F.col("text").alias("ref_text"))
    return join_on(corpus, ref, [key], "left").withColumn("ref_text", F.coalesce("ref_text", F.lit("")))


def flip_table(rows: DataFrame, base: str, aug: str, by: tuple[str, ...] = ("seed", "lang", "split", "example_id")) -> DataFrame:
    """FIXED, BROKEN, both_ok or both_wrong per example of two models."""
    right = F.col("true_label") == F.col("pred_label")
    pair = rows.where(F.col("model").isin(base, aug)).groupBy(*by, "true_label").agg(
        F.bool_or(F.when(F.col("model") == base, right)).alias("base_ok"),
        F.bool_or(F.when(F.col("model") == aug, right)).alias("aug_ok")).where("base_ok IS NOT NULL AND aug_ok IS NOT NULL")
    b, a = F.col("base_ok"), F.col("aug_ok")
    return pair.withColumn("flip", F.when(~b & a, "FIXED").when(b & ~a, "BROKEN").when(b, "both_ok").otherwise("both_wrong"))


def flip_net(flips: DataFrame, by: list[str]) -> DataFrame:
    """FIXED, BROKEN, their difference and both accuracies per group."""
    return flips.groupBy(*by).agg(
        F.count_if(F.col("flip") == "FIXED").alias("fixed"), F.count_if(F.col("flip") == "BROKEN").alias("broken"),
        F.avg(F.col("base_ok").cast("int")).alias("base_acc"), F.avg(F.col("aug_ok").cast("int")).alias("aug_acc"),
    ).withColumn("net", F.col("fixed") - F.col("broken"))


def coverage_facts(texts: DataFrame, seeds: DataFrame, synthetic: DataFrame) -> DataFrame:
    """(lang, id, ncov, oov_seed): tokens newly covered by synthetic rows, and share unknown to the seeds."""
    seen = vocabulary(seeds, ["lang"]).withColumn("in_seed", F.lit(True))
    new = vocabulary(synthetic, ["lang"]).withColumn("in_syn", F.lit(True))
    words = texts.where(F.col("text").isNotNull()).select("lang", "id", F.explode(F.array_distinct(tokens("text"))).alias("token"))
    tagged = join_on(join_on(words, seen, ["lang", "token"], "left"), new, ["lang", "token"], "left")
    facts = tagged.groupBy("lang", "id").agg(
        F.count_if(F.col("in_seed").isNull() & F.col("in_syn").isNotNull()).alias("ncov"),
        (F.count_if(F.col("in_seed").isNull()) / F.count(F.lit(1))).alias("oov_seed"))
    return join_on(texts.select("lang", "id"), facts, ["lang", "id"], "left").na.fill({"ncov": 0, "oov_seed": 0.0})


def fix_rate_by_coverage(flips: DataFrame) -> DataFrame:
    """Fix rate of examples the base model got wrong, with and without newly covered words."""
    return flips.where(~F.col("base_ok")).groupBy((F.col("ncov") > 0).alias("has_new_words")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("aug_ok").cast("int")).alias("fix_rate"))


def flip_profile(flips: DataFrame) -> DataFrame:
    """What FIXED and BROKEN examples look like."""
    return flips.where(F.col("flip").isin("FIXED", "BROKEN")).groupBy("flip").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("implicit").cast("int")).alias("implicit"),
        F.avg((F.col("true_label") == "neutral").cast("int")).alias("neutral"),
        F.avg("ncov").alias("mean_new_words"), F.avg("oov_seed").alias("mean_oov"))


def _class_sums(probs: DataFrame, by: list[str], k: int = len(LABELS)) -> DataFrame:
    """Summed class probabilities per example, without listing the runs."""
    return probs.groupBy(*by, "example_id", "true_label").agg(*[
        F.sum(F.element_at("logits", i + 1)).alias(f"_s{i}") for i in range(k)]).select(
        *by, "example_id", "true_label", F.array(*[f"_s{i}" for i in range(k)]).alias("logits"))


def ensemble(predictions: DataFrame, by: tuple[str, ...] = ("model", "lang", "split")) -> DataFrame:
    """Macro F1 of the mean softmax over seeds."""
    by = list(by)
    return macro_f1(with_pred(_class_sums(predictions.withColumn("logits", softmax("logits")), by)), by)


def greedy_ensemble(predictions: DataFrame, split: str = "valid", by: tuple[str, ...] = ("model", "lang")) -> DataFrame:
    """Seeds added in order of validation F1 while the ensemble's validation F1 does not fall.

    Returns (by, step, seed, action, val_f1). The loop runs once per seed, over all groups at a time. The chosen seeds' class sums are a
    running table, so a step adds one seed's rows to it and reads no other.
    """
    by = list(by)
    rows = materialize(predictions.where(F.col("split") == split).select(*by, "seed", "example_id", "true_label", "logits"))
    single = macro_f1(with_pred(rows), by + ["seed"]).select(*by, "seed", "f1")
    order = Window.partitionBy(*by).orderBy(F.desc("f1"), "seed")  # one row per seed
    ranked = materialize(single.withColumn("step", F.row_number().over(order)))
    probs = materialize(join_on(rows.withColumn("logits", softmax("logits")), ranked.select(*by, "seed", "step"), by + ["seed"]).drop("seed"))
    log = ranked.where("step = 1").select(*by, "step", "seed", F.lit("start").alias("action"), F.col("f1").alias("val_f1"))
    best = log.select(*by, F.col("val_f1").alias("best"))
    sums = materialize(_class_sums(probs.where("step = 1"), by))
    for step in range(2, (ranked.agg(F.max("step")).first()[0] or 0) + 1):
        member = ranked.where(F.col("step") == step).select(*by, "seed")
        running = join_on(sums, member, by, "left_semi")
        trial = materialize(_class_sums(running.unionByName(probs.where(F.col("step") == step).drop("step")), by))
        score = macro_f1(with_pred(trial), by).select(*by, "f1")
        judged = materialize(join_on(join_on(member, score, by), best, by).select(
            *by, F.lit(step).alias("step"), "seed",
            F.when(F.col("f1") >= F.col("best"), "ADD").otherwise("skip").alias("action"), F.col("f1").alias("val_f1")))
        added = judged.where("action = 'ADD'").select(*by)
        sums = materialize(join_on(trial, added, by, "left_semi").unionByName(join_on(sums, added, by, "left_anti")))
        log = log.unionByName(judged)
        best = log.where(F.col("action") != "skip").groupBy(*by).agg(F.max_by("val_f1", "step").alias("best"))
    return log


def transfer_report(rows: DataFrame, by: list[str], gate_f1: float = 80.0) -> DataFrame:
    """Test F1 of one model on every language, with the mean over languages (lang MEAN) and a gate flag."""
    scores = macro_f1(rows, [*by, "lang"]).select(*by, "lang", (F.col("f1") * 100).alias("f1"))
    mean = scores.groupBy(*by).agg(F.lit("MEAN").alias("lang"), F.avg("f1").alias("f1"))
    return scores.unionByName(mean.select(*by, "lang", "f1")).withColumn("gate", F.col("f1") >= gate_f1)
