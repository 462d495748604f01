"""Outcome log analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import outcomes as O
from ..testbed import corpus, outcome_log
from .registry import query, sql

_PCT = lambda a, b: f"coalesce(100.0 * ({a}) / nullif({b}, 0), 0)"
_TRIGGER = """CASE WHEN coalesce(prev_feedback, '') LIKE '%Length drift%' THEN 'PSLM' WHEN sv_verdict = 'REJECT' THEN 'SV' WHEN lv_verdict = 'REJECT' THEN 'LV' ELSE 'PSLM' END"""
_REASON = """CASE WHEN sv_verdict = 'VALIDATION_FAILED' OR lv_verdict = 'VALIDATION_FAILED' THEN 'VALIDATION_FAILED' WHEN sv_verdict = 'REJECT' THEN 'SV' WHEN lv_verdict = 'REJECT' THEN 'LV' ELSE 'PSLM' END"""


@query("log_rules", sql("log", f"""SELECT sid, outcome, {_REASON} AS reason, {_TRIGGER} AS trigger,
  coalesce(lv_verdict = 'PASS', false) AS lv_ok, coalesce(nullif(prev_feedback, ''), 'Rejected without specific feedback') AS feedback FROM log"""))
def log_rules(spark, d):
    return outcome_log(spark, d).select(
        "sid", "outcome", R.reject_reason("sv_verdict", "lv_verdict").alias("reason"),
        R.retry_trigger("prev_feedback", "sv_verdict", "lv_verdict").alias("trigger"), R.passed("lv_verdict").alias("lv_ok"),
        R.feedback_or_default("prev_feedback").alias("feedback"))


@query("split_pass", sql("log", """SELECT CASE WHEN coalesce(lv_verdict, '') = 'PASS' THEN 'pass' ELSE 'other' END AS side, count(*) AS n, CAST(sum(sid) AS BIGINT) AS sids FROM log GROUP BY ALL"""))
def split_pass(spark, d):
    ok, other = O.split_pass(outcome_log(spark, d), "lv_verdict")
    both = ok.withColumn("side", F.lit("pass")).unionByName(other.withColumn("side", F.lit("other")))
    return both.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.sum("sid").alias("sids"))


@query("by_outcome", sql("log", "SELECT sid, outcome FROM log WHERE outcome IN ('retried', 'discarded')"))
def by_outcome(spark, d):
    return O.by_outcome(outcome_log(spark, d), "retried", "discarded").select("sid", "outcome")


@query("outcome_breakdown", sql("log", f"""SELECT *, {_PCT('att_0 + att_1 + att_2', 'total')} AS filter_rate FROM (SELECT *, att_0 + att_1 + att_2 + discard + dedup AS total FROM (
  SELECT target_lang AS lang, """ + ", ".join(f"count(*) FILTER (outcome = 'accepted' AND retry_count = {a}) AS att_{a}" for a in (0, 1, 2)) + """,
  count(*) FILTER (outcome = 'discarded') AS discard, count(*) FILTER (outcome = 'dedup_filtered') AS dedup FROM log GROUP BY ALL))""", "filter_rate"))
def outcome_breakdown(spark, d):
    return O.outcome_breakdown(outcome_log(spark, d))


def _by_label(where: str) -> str:
    return f"""SELECT *, {_PCT('discard', 'total')} AS discard_pct, {_PCT('dedup', 'total')} AS dedup_pct, {_PCT('accept', 'total')} AS accept_pct FROM (
      SELECT target_lang AS lang, target_label AS label, count(*) AS total, count(*) FILTER (outcome = 'discarded') AS discard,
      count(*) FILTER (outcome = 'dedup_filtered') AS dedup, count(*) FILTER (outcome = 'accepted') AS accept FROM log {where} GROUP BY ALL)"""


@query("outcome_by_label", sql("log", _by_label(""), "discard_pct dedup_pct accept_pct"))
def outcome_by_label(spark, d):
    return O.outcome_by_label(outcome_log(spark, d))


@query("outcome_by_label_terminal", sql("log", _by_label("WHERE outcome <> 'retried'"), "discard_pct dedup_pct accept_pct"))
def outcome_by_label_terminal(spark, d):
    return O.outcome_by_label(outcome_log(spark, d), terminal_only=True)


_WIDE = [f"{x}_{c}_pct" for x in ("negative", "neutral", "positive") for c in ("discard", "dedup", "accept")]


@query("outcome_by_label_wide", sql("log", "SELECT lang, " + ", ".join(
    f"max({n.split('_')[1]}_pct) FILTER (label = '{n.split('_')[0]}') AS {n}" for n in _WIDE) + f" FROM ({_by_label('')}) GROUP BY ALL", " ".join(_WIDE)))
def outcome_by_label_wide(spark, d):
    return O.outcome_by_label_wide(outcome_log(spark, d))


@query("retry_triggers", sql("log", f"""SELECT *, {_PCT('n_sv', 'n_retry')} AS sv_pct, {_PCT('n_lv', 'n_retry')} AS lv_pct, {_PCT('n_pslm', 'n_retry')} AS pslm_pct FROM (
  SELECT coalesce(target_lang, 'TOTAL') AS lang, count(*) FILTER (t = 'SV') AS n_sv, count(*) FILTER (t = 'LV') AS n_lv, count(*) FILTER (t = 'PSLM') AS n_pslm, count(*) AS n_retry
  FROM (SELECT target_lang, {_TRIGGER} AS t FROM log WHERE outcome = 'retried') GROUP BY ROLLUP (target_lang))""", "sv_pct lv_pct pslm_pct"))
def retry_triggers(spark, d):
    return O.retry_triggers(outcome_log(spark, d))


@query("tuning_signal", sql("log", f"""SELECT *, CASE WHEN s = '' THEN 'OK as-is' ELSE s END AS suggestion FROM (SELECT *, concat_ws('; ',
    CASE WHEN lv_pct > 30 THEN 'strengthen lang constraint in Generator prompt' END, CASE WHEN pslm_pct > 50 THEN 'tighten target length / lower temperature' END,
    CASE WHEN sv_pct > 40 THEN 'verify classifier validation F1 first' END, CASE WHEN dedup_rate > 2 THEN 'Contextualizer needs more variation diversity' END) AS s FROM (
  SELECT target_lang AS lang, {', '.join(f"100.0 * count(*) FILTER (r = '{x.upper()}') / count(r) AS {x}_pct" for x in ('sv', 'lv', 'pslm'))},
  {_PCT("count(*) FILTER (outcome = 'dedup_filtered')", "count(*) FILTER (outcome IN ('accepted', 'dedup_filtered'))")} AS dedup_rate
  FROM (SELECT *, CASE WHEN outcome IN ('retried', 'discarded') THEN {_REASON} END AS r FROM log) GROUP BY ALL HAVING count(r) > 0))""".replace(
      "SELECT *, CASE WHEN s = ''", "SELECT * EXCLUDE (s), CASE WHEN s = ''"), "sv_pct lv_pct pslm_pct dedup_rate"))
def tuning_signal(spark, d):
    return O.tuning_signal(outcome_log(spark, d))


def _conflict(a: str, b: str) -> str:
    return f"""SELECT target_lang AS lang, count(*) AS n_accepted, count(*) FILTER ({a} <> {b}) AS conflict, 100.0 * count(*) FILTER ({a} <> {b}) / count(*) AS conflict_rate
      FROM log WHERE outcome = 'accepted' AND {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY ALL"""


@query("sentiment_conflict", sql("log", _conflict("sentiment_label", "target_label"), "conflict_rate"))
def sentiment_conflict(spark, d):
    return O.conflict_rate(outcome_log(spark, d), "sentiment_label", "target_label")


@query("language_conflict", sql("log", _conflict("lid_lang", "target_lang"), "conflict_rate"))
def language_conflict(spark, d):
    return O.conflict_rate(outcome_log(spark, d), "lid_lang", "target_lang")


def _reasons(verdict: str) -> str:
    return f"""SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang ORDER BY n DESC, reason) AS INTEGER) AS rank FROM (
      SELECT target_lang AS lang, left(prev_feedback, 120) AS reason, count(*) AS n FROM log
      WHERE outcome IN ('retried', 'discarded') AND {verdict} = 'REJECT' AND prev_feedback IS NOT NULL GROUP BY ALL)) WHERE rank <= 5"""


@query("top_reasons_sentiment", sql("log", _reasons("sv_verdict")))
def top_reasons_sentiment(spark, d):
    return O.top_reasons(outcome_log(spark, d), "sv_verdict", "prev_feedback")


@query("top_reasons_language", sql("log", _reasons("lv_verdict")))
def top_reasons_language(spark, d):
    return O.top_reasons(outcome_log(spark, d), "lv_verdict", "prev_feedback")


@query("integrity", sql("log", f"""SELECT lang, corpus_rows, accepted, CASE WHEN corpus_rows = accepted THEN 'OK' ELSE 'MISMATCH' END AS match, expected,
  {_PCT('accepted', 'expected')} AS yield_pct, discarded, dedup_filtered, retried_events, batch_failed FROM (
  SELECT lang, count(*) FILTER (corpus = 'syn') AS corpus_rows, 5 * count(*) FILTER (corpus = 'seed') AS expected FROM corpus GROUP BY ALL) JOIN (
  SELECT target_lang AS lang, count(*) FILTER (outcome = 'accepted') AS accepted, count(*) FILTER (outcome = 'discarded') AS discarded,
  count(*) FILTER (outcome = 'dedup_filtered') AS dedup_filtered, count(*) FILTER (outcome = 'retried') AS retried_events,
  count(*) FILTER (outcome = 'batch_failed') AS batch_failed FROM log GROUP BY ALL) USING (lang)""", "yield_pct"))
def integrity(spark, d):
    return O.integrity(corpus(spark, d), outcome_log(spark, d))


@query("purity", sql("log", """SELECT *, purity_pct - baseline_pct AS gap_pp FROM (SELECT target_lang AS lang, count(*) AS n_accepted,
  100 * avg(CASE WHEN lid_lang = target_lang THEN 1.0 ELSE 0.0 END) AS purity_pct, avg(lid_conf) AS avg_conf,
  CASE target_lang WHEN 'de' THEN 93.4 WHEN 'en' THEN 95.4 ELSE 0.0 END AS baseline_pct FROM log WHERE outcome = 'accepted' AND lid_lang IS NOT NULL GROUP BY ALL)""",
  "purity_pct avg_conf baseline_pct gap_pp"))
def purity(spark, d):
    return O.purity(outcome_log(spark, d), {"de": 93.4, "en": 95.4})


_CHAINS = "(SELECT target_lang AS lang, seed_id, plan_id, count(*) AS attempts FROM log GROUP BY ALL)"


@query("retry_chains", sql("log", f"""SELECT *, 100.0 * attempts_3 / chains AS over_correction_pct FROM (SELECT lang, """ + ", ".join(
    f"count(*) FILTER (attempts = {a}) AS attempts_{a}" for a in (1, 2, 3)) + f", count(*) AS chains FROM {_CHAINS} GROUP BY ALL)", "over_correction_pct"))
def retry_chains(spark, d):
    return O.retry_chains(outcome_log(spark, d))


@query("long_chain_listing", sql("log", f"""SELECT target_lang AS lang, l.seed_id, CAST(l.plan_id AS BIGINT) AS plan_id, retry_count, sid, outcome, sv_verdict, lv_verdict, prev_feedback FROM log l JOIN (
  SELECT lang, seed_id, plan_id FROM {_CHAINS} WHERE attempts >= 3 QUALIFY row_number() OVER (PARTITION BY lang ORDER BY seed_id, plan_id) = 1) c
  ON c.lang = l.target_lang AND c.seed_id = l.seed_id AND c.plan_id = l.plan_id"""))
def long_chain_listing(spark, d):
    return O.long_chain_listing(outcome_log(spark, d))
