"""Analytics over the outcome log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import BASELINE_PURITY, LABELS, SENTENCES_PER_SEED
from ..functions.numeric import pct
from ..functions.rules import reject_reason, retry_trigger, suggestion
from ..functions.text import reason_prefix
from ..session import join_on
from .ranking import top_k


def by_outcome(log: DataFrame, *outcomes: str) -> DataFrame:
    return log.where(F.col("outcome").isin(*outcomes))


def split_pass(rows: DataFrame, verdict: str) -> tuple[DataFrame, DataFrame]:
    """(passed, other) rows; a missing verdict belongs to the other rows."""
    ok = F.coalesce(F.col(verdict) == "PASS", F.lit(False))
    return rows.where(ok), rows.where(~ok)


def _n(outcome: str):
    return F.count_if(F.col("outcome") == outcome)


def outcome_breakdown(log: DataFrame) -> DataFrame:
    """Accepted by attempt, discarded and dedup-filtered rows per language, with the filter rate."""
    acc = F.col("outcome") == "accepted"
    counts = log.groupBy(F.col("target_lang").alias("lang")).agg(
        *[F.count_if(acc & (F.col("retry_count") == a)).alias(f"att_{a}") for a in (0, 1, 2)],
        _n("discarded").alias("discard"), _n("dedup_filtered").alias("dedup"))
    good = F.col("att_0") + F.col("att_1") + F.col("att_2")
    total = good + F.col("discard") + F.col("dedup")
    return counts.withColumn("total", total).withColumn("filter_rate", pct(good, F.col("total")))


def outcome_by_label(log: DataFrame, terminal_only: bool = False) -> DataFrame:
    """Discard, dedup and accept shares per language and label.

    The denominator is every log row of the label, retried and batch_failed rows included;
    ``terminal_only`` counts final outcomes instead.
    """
    rows = by_outcome(log, "accepted", "discarded", "dedup_filtered") if terminal_only else log
    return rows.groupBy(F.col("target_lang").alias("lang"), F.col("target_label").alias("label")).agg(
        F.count(F.lit(1)).alias("total"), _n("discarded").alias("discard"), _n("dedup_filtered").alias("dedup"),
        _n("accepted").alias("accept"),
    ).withColumns({f"{c}_pct": pct(F.col(c), F.col("total")) for c in ("discard", "dedup", "accept")})


def outcome_by_label_wide(log: DataFrame) -> DataFrame:
    """The same shares with one column per label and outcome."""
    long = outcome_by_label(log)
    return long.groupBy("lang").agg(*[
        F.max(F.when(F.col("label") == x, F.col(f"{c}_pct"))).alias(f"{x}_{c}_pct")
        for x in LABELS for c in ("discard", "dedup", "accept")])


def retry_triggers(log: DataFrame) -> DataFrame:
    """What caused each retry, per language and in total (lang TOTAL)."""
    rows = by_outcome(log, "retried").select(
        F.col("target_lang").alias("lang"), retry_trigger("prev_feedback", "sv_verdict", "lv_verdict").alias("t"))
    counts = rows.rollup("lang").agg(
        F.grouping("lang").alias("_all"), *[F.count_if(F.col("t") == x).alias(f"n_{x.lower()}") for x in ("SV", "LV", "PSLM")])
    counts = counts.select(F.when(F.col("_all") == 1, "TOTAL").otherwise(F.col("lang")).alias("lang"), "n_sv", "n_lv", "n_pslm")
    counts = counts.withColumn("n_retry", F.col("n_sv") + F.col("n_lv") + F.col("n_pslm"))
    return counts.withColumns({f"{x}_pct": pct(F.col(f"n_{x}"), F.col("n_retry")) for x in ("sv", "lv", "pslm")})


def tuning_signal(log: DataFrame) -> DataFrame:
    """Reject-reason shares, dedup rate and advice per language that has rejects."""
    rejected = F.col("outcome").isin("retried", "discarded")
    tagged = log.withColumn("_why", F.when(rejected, reject_reason("sv_verdict", "lv_verdict")))
    counts = tagged.groupBy(F.col("target_lang").alias("lang")).agg(
        F.count_if(rejected).alias("rejects"),
        *[F.count_if(F.col("_why") == x).alias(f"n_{x.lower()}") for x in ("SV", "LV", "PSLM")],
        _n("accepted").alias("acc"), _n("dedup_filtered").alias("dup"))
    shares = counts.where("rejects > 0").select(
        "lang", *[pct(F.col(f"n_{x}"), F.col("rejects")).alias(f"{x}_pct") for x in ("sv", "lv", "pslm")],
        pct(F.col("dup"), F.col("acc") + F.col("dup")).alias("dedup_rate"))
    return shares.withColumn("suggestion", suggestion("sv_pct", "lv_pct", "pslm_pct", "dedup_rate"))


def conflict_rate(log: DataFrame, predicted: str, target: str) -> DataFrame:
    """Share of accepted rows whose predicted value differs from the target."""
    rows = by_outcome(log, "accepted").na.drop(subset=[predicted, target])
    return rows.groupBy(F.col("target_lang").alias("lang")).agg(
        F.count(F.lit(1)).alias("n_accepted"), F.count_if(F.col(predicted) != F.col(target)).alias("conflict"),
    ).withColumn("conflict_rate", pct(F.col("conflict"), F.col("n_accepted")))


def top_reasons(log: DataFrame, verdict: str, feedback: str, k: int = 5) -> DataFrame:
    """Most frequent reject reasons per language, by their first 120 characters."""
    rows = by_outcome(log, "retried", "discarded").where((F.col(verdict) == "REJECT") & F.col(feedback).isNotNull())
    counts = rows.groupBy(F.col("target_lang").alias("lang"), reason_prefix(feedback).alias("reason")).agg(
        F.count(F.lit(1)).alias("n"))
    return top_k(counts, ["lang"], [F.desc("n"), "reason"], k, "reason")


def integrity(corpus: DataFrame, log: DataFrame, per_seed: int = SENTENCES_PER_SEED) -> DataFrame:
    """Stored synthetic rows against accepted log rows, and the yield against the seeds."""
    rows = corpus.groupBy("lang").agg(
        F.count_if(F.col("corpus") == "syn").alias("corpus_rows"), F.count_if(F.col("corpus") == "seed").alias("seeds"))
    logged = log.groupBy(F.col("target_lang").alias("lang")).agg(
        _n("accepted").alias("accepted"), _n("discarded").alias("discarded"), _n("dedup_filtered").alias("dedup_filtered"),
        _n("retried").alias("retried_events"), _n("batch_failed").alias("batch_failed"))
    both = rows.join(logged, "lang", "full").na.fill(0)
    return both.select(
        "lang", "corpus_rows", "accepted",
        F.when(F.col("corpus_rows") == F.col("accepted"), "OK").otherwise("MISMATCH").alias("match"),
        (F.col("seeds") * per_seed).alias("expected"), pct(F.col("accepted"), F.col("seeds") * per_seed).alias("yield_pct"),
        "discarded", "dedup_filtered", "retried_events", "batch_failed")


def purity(log: DataFrame, baseline: dict[str, float] | None = None) -> DataFrame:
    """Share of accepted rows identified as the target language, mean confidence, gap to the baseline."""
    base = BASELINE_PURITY if baseline is None else baseline
    lookup = F.create_map(*[F.lit(x) for kv in base.items() for x in kv]) if base else None
    rows = by_outcome(log, "accepted").where(F.col("lid_lang").isNotNull())
    out = rows.groupBy(F.col("target_lang").alias("lang")).agg(
        F.count(F.lit(1)).alias("n_accepted"),
        (F.avg(F.when(F.col("lid_lang") == F.col("target_lang"), 1.0).otherwise(0.0)) * 100).alias("purity_pct"),
        F.avg("lid_conf").alias("avg_conf"))
    known = F.coalesce(F.try_element_at(lookup, F.col("lang")), F.lit(0.0)) if base else F.lit(0.0)
    return out.withColumn("baseline_pct", known).withColumn("gap_pp", F.col("purity_pct") - F.col("baseline_pct"))


def chain_lengths(log: DataFrame) -> DataFrame:
    """Attempts logged per (lang, seed, plan)."""
    return log.na.drop(subset=["seed_id", "plan_id"]).groupBy(
        F.col("target_lang").alias("lang"), "seed_id", "plan_id").agg(F.count(F.lit(1)).alias("attempts"))


def retry_chains(log: DataFrame) -> DataFrame:
    """How many chains took 1, 2 or 3 attempts, and the share that took exactly 3."""
    return chain_lengths(log).groupBy("lang").agg(
        *[F.count_if(F.col("attempts") == a).alias(f"attempts_{a}") for a in (1, 2, 3)],
        F.count(F.lit(1)).alias("chains"),
    ).withColumn("over_correction_pct", pct(F.col("attempts_3"), F.col("chains")))


def long_chain_listing(log: DataFrame, at_least: int = 3) -> DataFrame:
    """Log rows of the first long chain of each language, in attempt order."""
    first = chain_lengths(log).where(F.col("attempts") >= at_least).groupBy("lang").agg(
        F.min(F.struct("seed_id", "plan_id")).alias("c")).select("lang", "c.*")
    rows = log.withColumn("lang", F.col("target_lang"))
    return join_on(rows, first, ["lang", "seed_id", "plan_id"], "left_semi").select(
        "lang", "seed_id", "plan_id", "retry_count", "sid", "outcome", "sv_verdict", "lv_verdict", "prev_feedback")
