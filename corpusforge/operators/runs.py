"""Aggregation of scores over configurations, seeds and languages.

A results row is (config, seed, lang, train_f1, val_f1, test_f1, gap ...). There is one row per
trained run, so windows over a configuration or a run see a handful of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import GATE_F1, GATE_GAP
from ..functions.numeric import py_round
from ..functions.rules import reference_flag
from ..session import join_on

NOISE_STD = 1.3


def pending_units(grid: DataFrame, done: DataFrame, keys: tuple[str, ...] = ("config", "seed", "lang")) -> DataFrame:
    """Units of the grid without a result."""
    return join_on(grid, done.select(*keys).distinct(), list(keys), "left_anti")


def complete_runs(done: DataFrame, n: int, keys: tuple[str, ...] = ("config", "seed")) -> DataFrame:
    """Runs with results for at least n languages."""
    return done.groupBy(*keys).agg(F.count_distinct("lang").alias("langs")).where(F.col("langs") >= n)


def compare_arms(results: DataFrame, base: str, aug: str, by: tuple[str, ...] = ("seed",)) -> DataFrame:
    """Test F1 of two arms per run (``by``) and language, the difference, and a MEAN row of the rounded values per run.

    Runs are compared like with like: each seed of one arm with the same seed of the other.
    """
    by = list(by)
    pick = lambda c: F.max(F.when(F.col("config") == c, F.col("test_f1")))
    wide = results.groupBy(*by, "lang").agg(pick(base).alias("b"), pick(aug).alias("a")).where("a IS NOT NULL AND b IS NOT NULL")
    rows = wide.select(*by, "lang", py_round(F.col("b") * 100, 2).alias("baseline"), py_round(F.col("a") * 100, 2).alias("augmented"),
                       py_round((F.col("a") - F.col("b")) * 100, 2).alias("delta"))
    # two-decimal values: nine decimals free the mean of summation noise before it is rounded
    mean = rows.groupBy(*by).agg(*[py_round(F.round(F.avg(c), 9), 2).alias(c) for c in ("baseline", "augmented", "delta")])
    return rows.unionByName(mean.select(*by, F.lit("MEAN").alias("lang"), "baseline", "augmented", "delta").where("delta IS NOT NULL"))


def winners_losers(compared: DataFrame, by: tuple[str, ...] = ("seed",)) -> DataFrame:
    """Languages that gained and lost, per run."""
    rows = compared.where(F.col("lang") != "MEAN")
    return rows.groupBy(*by).agg(F.count_if(F.col("delta") > 0).alias("winners"), F.count_if(F.col("delta") < 0).alias("losers"),
                    F.count(F.lit(1)).alias("langs"))


def vs_reference(results: DataFrame, reference: DataFrame) -> DataFrame:
    """Scores against published ones (lang, ref_f1): deviation and flag; missing references stay."""
    joined = join_on(results, reference, ["lang"], "left")
    dev = F.col("test_f1") * 100 - F.col("ref_f1")
    return joined.select(*[c for c in ("config", "seed") if c in results.columns], "lang", (F.col("test_f1") * 100).alias("our_f1"), "ref_f1",
                         dev.alias("deviation"), reference_flag(dev).alias("flag"))


def seed_stats(results: DataFrame, metrics: tuple[str, ...] = ("train_f1", "val_f1", "test_f1", "gap")) -> DataFrame:
    """Mean, sample std and count over seeds, times 100; one run has no std."""
    long = results.unpivot(["config", "seed", "lang"], list(metrics), "metric", "value").where(F.col("value").isNotNull())
    return long.groupBy("config", "lang", "metric").agg(
        (F.avg("value") * 100).alias("mean"), (F.stddev_samp("value") * 100).alias("std"), F.count(F.lit(1)).alias("n"))


def verdict(results: DataFrame, champion: str, baseline: str) -> DataFrame:
    """Champion against baseline per language: at least equal, within noise, or a real regression."""
    stats = results.where(F.col("config").isin(champion, baseline)).groupBy("lang").agg(*[
        f(F.when(F.col("config") == c, F.col("test_f1") * 100)).alias(f"{p}_{n}")
        for c, p in ((champion, "ch"), (baseline, "ft"))
        for f, n in ((F.avg, "mean"), (F.stddev_samp, "std"), (F.count, "n"))])
    part = lambda p: F.pow(F.when(F.col(f"{p}_n") >= 2, F.col(f"{p}_std")).otherwise(NOISE_STD), 2) / F.greatest(F.col(f"{p}_n"), F.lit(1))
    delta = F.col("ch_mean") - F.col("ft_mean")
    label = (
        F.when((F.col("ch_n") == 0) | (F.col("ft_n") == 0), "?")
        .when(F.col("delta") >= 0, "OK")
        .when(F.abs("delta") <= F.greatest(F.lit(1.0), 2 * F.col("se")), "within-noise")
        .otherwise("regression")
    )
    return stats.withColumns({"delta": delta, "se": F.sqrt(part("ch") + part("ft"))}).withColumn("verdict", label)


def run_means(results: DataFrame, metric: str = "val_f1") -> DataFrame:
    """Mean of a metric over languages per run, times 100."""
    return results.where(F.col(metric).isNotNull()).groupBy("config", "seed").agg((F.avg(metric) * 100).alias("score"))


def median_run(results: DataFrame, metric: str = "val_f1") -> DataFrame:
    """Per configuration: the run closest to the median score, and the middle run of the sorted scores."""
    scores = run_means(results, metric)
    per = Window.partitionBy("config")
    ranked = scores.withColumns({
        "median": F.percentile("score", 0.5).over(per), "n": F.count(F.lit(1)).over(per),
        "pos": F.row_number().over(per.orderBy("score", "seed"))})
    return ranked.groupBy("config").agg(
        F.first("median").alias("median"),
        F.min_by("seed", F.struct(F.abs(F.col("score") - F.col("median")), F.col("seed"))).alias("closest_seed"),
        F.max(F.when(F.col("pos") == F.floor(F.col("n") / 2) + 1, F.col("seed"))).alias("middle_seed"))


def maximin_run(results: DataFrame, base_seed: int, gate_lang: str, margin: float, metric: str = "val_f1") -> DataFrame:
    """Run with the best worst-language score, and whether it beats the base run on one language by a margin.

    Scores equal to nine decimals tie; the first language and the lowest seed win.
    """
    value = F.col(metric) * 100
    tie = lambda c: F.round(c, 9)
    worst = results.groupBy("config", "seed").agg(
        F.min(value).alias("worst"), F.min_by("lang", F.when(value.isNotNull(), F.struct(tie(value), F.col("lang")))).alias("worst_lang"),
        F.max(F.when(F.col("lang") == gate_lang, value)).alias("gate_score"))
    win = worst.groupBy("config").agg(
        F.max_by(F.struct("seed", "worst", "worst_lang", "gate_score"), F.struct(tie(F.col("worst")), -F.col("seed"))).alias("w"),
        F.max(F.when(F.col("seed") == base_seed, F.col("gate_score"))).alias("base_score"))
    return win.select("config", "w.*", "base_score").withColumn(
        "gate_pass", (F.col("seed") != base_seed) & (F.col("gate_score") >= F.col("base_score") + margin))


def _mean_of(cols: list[Column]) -> Column:
    """Mean of the non-null columns."""
    known = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in cols), F.lit(0))
    return F.try_divide(sum((F.coalesce(c, F.lit(0.0)) for c in cols), F.lit(0.0)), known)


def leaderboard(results: DataFrame, baseline: str, targets: list[str], winners: list[str], scope: list[str]) -> DataFrame:
    """Per configuration: target means with deltas, winner, scope and gap means, and whether all targets hold."""
    f1 = {l: F.avg(F.when(F.col("lang") == l, F.col("test_f1") * 100)).alias(f"f1_{l}") for l in scope}
    gap = {l: F.avg(F.when(F.col("lang") == l, F.col("gap") * 100)).alias(f"gap_{l}") for l in scope}
    wide = results.groupBy("config").agg(*f1.values(), *gap.values())
    base = wide.where(F.col("config") == baseline).select(*[F.col(f"f1_{l}").alias(f"_b_{l}") for l in targets])
    joined = wide.join(base, F.lit(True), "left")  # one baseline row
    holds = F.lit(True)
    for l in targets:
        holds = holds & F.coalesce(F.round(f"f1_{l}", 9) >= F.round(f"_b_{l}", 9), F.lit(False))
    return joined.select(
        "config", *[F.col(f"f1_{l}") for l in targets], *[(F.col(f"f1_{l}") - F.col(f"_b_{l}")).alias(f"delta_{l}") for l in targets],
        _mean_of([F.col(f"f1_{l}") for l in winners]).alias("winners_mean"), _mean_of([F.col(f"f1_{l}") for l in scope]).alias("scope_mean"),
        _mean_of([F.col(f"gap_{l}") for l in scope]).alias("gap_mean"), holds.alias("candidate"))


def gated_cells(results: DataFrame) -> DataFrame:
    """Mean and std of F1 and mean gap per configuration and language, starred when both gates hold."""
    s = results.groupBy("config", "lang").agg(
        (F.avg("test_f1") * 100).alias("f1"), (F.stddev_samp("test_f1") * 100).alias("std"), (F.avg("gap") * 100).alias("gap"))
    return s.withColumn("star", (F.col("f1") >= GATE_F1) & (F.col("gap") < GATE_GAP))


def three_arm(results: DataFrame, arms: tuple[str, str, str]) -> DataFrame:
    """F1 and gap of three arms per language with a MEAN row, and the third against the others."""
    a, b, c = arms
    val = lambda arm, m: F.avg(F.when(F.col("config") == arm, F.col(m) * 100))
    cols = [val(x, m).alias(f"{n}_{k}") for x, n in ((a, "a"), (b, "b"), (c, "c")) for m, k in (("test_f1", "f1"), ("gap", "gap"))]
    rows = results.where(F.col("config").isin(*arms)).groupBy("lang").agg(*cols)
    names = [x for x in rows.columns if x != "lang"]
    mean = rows.agg(*[F.avg(x).alias(x) for x in names]).select(F.lit("MEAN").alias("lang"), *names)
    return rows.unionByName(mean).withColumns({"c_minus_b": F.col("c_f1") - F.col("b_f1"), "c_minus_a": F.col("c_f1") - F.col("a_f1")})


def gate_runs(results: DataFrame, scope: list[str]) -> DataFrame:
    """Gates per complete run: languages with enough F1, with a small gap, the failing ones, and the mean validation score."""
    rows = results.where(F.col("lang").isin(*scope)).withColumns({"f1": F.col("test_f1") * 100, "g": F.col("gap") * 100})
    low, wide = F.col("f1") < GATE_F1, F.col("g") >= GATE_GAP
    runs = rows.groupBy("config", "seed").agg(
        F.count_distinct("lang").alias("langs"), F.count_if(~low).alias("n_f1"), F.count_if(~wide).alias("n_gap"),
        (F.avg("val_f1") * 100).alias("val"),
        F.concat_ws(",", F.sort_array(F.collect_list(F.when(low, F.col("lang"))))).alias("failing_f1"),
        F.concat_ws(",", F.sort_array(F.collect_list(F.when(wide, F.col("lang"))))).alias("failing_gap"))
    n = len(scope)
    return runs.where(F.col("langs") == n).drop("langs").withColumn("all_pass", (F.col("n_f1") == n) & (F.col("n_gap") == n))


def pass_rate(gated: DataFrame) -> DataFrame:
    """Passing and total runs per configuration, and the middle run by validation score with its result."""
    per = Window.partitionBy("config")
    ranked = gated.withColumns({"pos": F.row_number().over(per.orderBy("val", "seed")), "n": F.count(F.lit(1)).over(per)})
    middle = F.col("pos") == F.floor(F.col("n") / 2) + 1
    return ranked.groupBy("config").agg(
        F.count_if("all_pass").alias("passing"), F.count(F.lit(1)).alias("runs"),
        F.max(F.when(middle, F.col("seed"))).alias("middle_seed"), F.bool_or(F.when(middle, F.col("all_pass"))).alias("middle_pass"))


# ---- training histories ------------------------------------------------------------------

def dedupe_epoch(history: DataFrame, run: list[str]) -> DataFrame:
    """Last evaluation record of each epoch of a run."""
    evals = history.where(F.col("eval_loss").isNotNull())
    return evals.groupBy(*run, "epoch").agg(
        F.max_by(F.struct("pos", "eval_loss", "eval_f1"), "pos").alias("e")).select(*run, "epoch", "e.*")


def best_epoch(history: DataFrame, run: list[str]) -> DataFrame:
    """First epoch with the best validation F1, and the last evaluated epoch."""
    evals = history.where(F.col("eval_f1").isNotNull())
    return evals.groupBy(*run).agg(
        F.max_by("epoch", F.struct(F.col("eval_f1"), -F.col("pos"))).alias("best_epoch"), F.max("eval_f1").alias("best_f1"),
        F.max_by("epoch", "pos").alias("stop_epoch"))


def loss_curves(history: DataFrame, run: list[str]) -> DataFrame:
    """Train loss, validation loss and validation F1 (per cent) per epoch."""
    train = history.where(F.col("loss").isNotNull() & F.col("eval_loss").isNull()).groupBy(*run, "epoch").agg(
        F.max_by("loss", "pos").alias("train_loss"))
    evals = dedupe_epoch(history, run).select(*run, "epoch", F.col("eval_loss").alias("val_loss"), (F.col("eval_f1") * 100).alias("val_f1"))
    return train.join(evals, run + ["epoch"], "full")
