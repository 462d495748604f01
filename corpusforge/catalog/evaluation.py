"""Classification results, run comparison, language identification and training."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import LABELS
from ..operators import classification as C
from ..operators import runs as R
from ..operators import scoring as M
from ..operators import training as N
from ..session import scratch_path
from ..testbed import corpus, history, letter_sentiment, marker_language, predictions, table
from .registry import query, sql

SIDE = ["model", "seed", "lang", "split"]
SCOPE = ["de", "en", "es", "fr"]
#: Seeds of a sweep: those of the predictions.
SEEDS = [0, 1, 2, 3, 42]


def _pred(spark, d):
    return C.with_pred(predictions(spark, d))


def _res(spark, d):
    return C.results(predictions(spark, d))


def _texts(spark, d):
    return corpus(spark, d).select("lang", "id", "text", "label", "corpus")


@query("encode_label", sql("corpus", "SELECT id, label, dense_rank() OVER (ORDER BY label) - 1 AS label_id FROM corpus"))
def encode_label(spark, d):
    return C.encode_label(corpus(spark, d)).select("id", "label", "label_id")


@query("confusion", sql("pred", "SELECT model, seed, lang, split, x AS true_label, " + ", ".join(
    f"count(*) FILTER (true_label = x AND pred_label = '{p}') AS pred_{p}" for p in LABELS)
    + " FROM pred CROSS JOIN (SELECT unnest(['negative', 'neutral', 'positive']) AS x) GROUP BY ALL"))
def confusion(spark, d):
    return C.confusion(_pred(spark, d), SIDE)


_REPORT = """SELECT model, seed, lang, split, label, CASE WHEN predicted = 0 THEN 0.0 ELSE tp * 1.0 / predicted END AS precision,
  CASE WHEN support = 0 THEN 0.0 ELSE tp * 1.0 / support END AS recall,
  CASE WHEN predicted + support = 0 THEN 0.0 ELSE 2.0 * tp / (predicted + support) END AS f1, support, predicted FROM cls"""


@query("class_report", sql("cls", _REPORT, "precision recall f1"))
def class_report(spark, d):
    return C.class_report(_pred(spark, d), SIDE)


@query("macro_f1", sql("f1s", "SELECT model, seed, lang, split, CAST(n AS BIGINT) AS n, f1, accuracy FROM f1s", "f1 accuracy"))
def macro_f1(spark, d):
    return C.macro_f1(_pred(spark, d), SIDE)


@query("results", sql("res", "SELECT * FROM res", "train_f1 train_accuracy val_f1 val_accuracy test_f1 test_accuracy gap"))
def results(spark, d):
    return _res(spark, d)


_DELTA = """SELECT seed, lang, label, max(f1) FILTER (model = 'base') AS base_f1, max(f1) FILTER (model = 'aug') AS aug_f1,
  max(f1) FILTER (model = 'aug') - max(f1) FILTER (model = 'base') AS delta FROM (
  SELECT model, seed, lang, label, CASE WHEN sum(predicted + support) = 0 THEN 0.0 ELSE 200.0 * sum(tp) / sum(predicted + support) END AS f1
  FROM cls WHERE split = 'test' GROUP BY ALL) GROUP BY ALL"""


def _delta(spark, d):
    return C.class_delta(_pred(spark, d).where("split = 'test'"), "base", "aug", ("seed", "lang"))


@query("class_delta", sql("cls", _DELTA, "base_f1 aug_f1 delta"))
def class_delta(spark, d):
    return _delta(spark, d)


@query("class_delta_wide", sql("cls", "SELECT seed, lang, " + ", ".join(f"max(delta) FILTER (label = '{x}') AS {x}" for x in LABELS) + f" FROM ({_DELTA}) GROUP BY ALL", " ".join(LABELS)))
def class_delta_wide(spark, d):
    return C.class_delta_wide(_delta(spark, d), ("seed", "lang"))


@query("class_delta_mean", sql("cls", f"SELECT label, avg(delta) AS mean_delta FROM ({_DELTA}) GROUP BY ALL", "mean_delta"))
def class_delta_mean(spark, d):
    return C.class_delta_mean(_delta(spark, d))


@query("confident_errors", sql("pred", """SELECT model, seed, lang, example_id, true_label, pred_label, conf, CAST(r AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY model, seed, lang ORDER BY conf DESC, example_id) AS r FROM pred WHERE split = 'test' AND true_label <> pred_label) WHERE r <= 15""", "conf"))
def confident_errors(spark, d):
    rows = _pred(spark, d).where("split = 'test'")
    return C.confident_errors(rows, ["model", "seed", "lang"]).select(
        "model", "seed", "lang", "example_id", "true_label", "pred_label", "conf", "rank")


_MARKS = """(SELECT lang, token, arg_max(label, n) AS label FROM (
  SELECT lang, token, label, count(*) AS n FROM (SELECT lang, label, unnest(list_distinct(t)) AS token FROM tok WHERE corpus = 'seed') GROUP BY ALL)
  GROUP BY lang, token HAVING sum(n) >= 2 AND max(n) * 1.0 / sum(n) >= 0.66)"""
_IMPLICIT = f"""(SELECT c.lang, c.id, c.label, c.text, c.id NOT IN (SELECT w.id FROM (SELECT id, lang, label, unnest(list_distinct(t)) AS token FROM tok) w
  JOIN {_MARKS} m ON m.lang = w.lang AND m.token = w.token AND m.label = w.label) AS implicit FROM corpus c)"""


def _with_implicit(spark, d):
    t = _texts(spark, d)
    rows = _pred(spark, d).where("split = 'test'")
    return C.with_implicit(rows, t.where("corpus = 'test'"), t.where("corpus = 'seed'"))


@query("implicit_flags", sql("tok", f"SELECT lang, id, implicit FROM {_IMPLICIT}"))
def implicit_flags(spark, d):
    t = _texts(spark, d)
    return C.implicit_flags(t, t.where("corpus = 'seed'"))


@query("implicit_errors", sql("tok pred", f"""SELECT * EXCLUDE (x), n * x * x / nullif((er + ew) * 1.0 * (ir + iw) * (er + ir) * (ew + iw), 0) AS chi2 FROM (
  SELECT *, greatest(0, abs(er * iw - ew * ir) - n / 2.0) AS x FROM (SELECT model, seed, lang, count(*) AS n, count(*) FILTER (NOT ok) AS errors,
    count(*) FILTER (implicit AND NOT ok) AS iw, count(*) FILTER (implicit AND ok) AS ir, count(*) FILTER (NOT implicit AND NOT ok) AS ew,
    count(*) FILTER (NOT implicit AND ok) AS er, count(*) FILTER (NOT ok AND (true_label = 'neutral' OR pred_label = 'neutral')) AS neutral_wrong,
    count(*) FILTER (NOT ok AND round(conf, 3) > 0.9) AS sure_wrong
  FROM (SELECT p.*, p.true_label = p.pred_label AS ok, i.implicit FROM pred p JOIN {_IMPLICIT} i ON i.id = p.example_id WHERE p.split = 'test') GROUP BY ALL))""".replace(
    "SELECT * EXCLUDE (x),", "SELECT model, seed, lang, n, errors, iw AS imp_wrong, ir AS imp_right, ew AS exp_wrong, er AS exp_right, neutral_wrong, sure_wrong, "
    "iw * 1.0 / nullif(iw + ir, 0) AS err_implicit, ew * 1.0 / nullif(ew + er, 0) AS err_explicit, "
    "iw * 1.0 / nullif(errors, 0) AS implicit_share, neutral_wrong * 1.0 / nullif(errors, 0) AS neutral_share, sure_wrong * 1.0 / nullif(errors, 0) AS confident_share, "
    "(iw * 1.0 / nullif(iw + ir, 0)) / nullif(ew * 1.0 / nullif(ew + er, 0), 0) AS lift,"), "err_implicit err_explicit lift chi2 implicit_share neutral_share confident_share"))
def implicit_errors(spark, d):
    """Without the p value, which needs the error function that the comparison SQL lacks."""
    return C.implicit_errors(_with_implicit(spark, d), ["model", "seed", "lang"]).drop("p_value")


def _with_text(spark, d):
    t = _texts(spark, d).select(F.col("id").alias("example_id"), "text")
    return _pred(spark, d).where("split = 'test'").join(t, "example_id")


_LEN = "(SELECT p.model, p.seed, p.lang, w.wc, p.pred_label <> 'neutral' AS wrong FROM pred p JOIN wlen w ON w.id = p.example_id WHERE p.split = 'test' AND p.true_label = 'neutral')"


@query("length_errors", sql("pred wlen", f"""SELECT model, seed, lang, count(*) FILTER (wrong) AS wrong_n, coalesce(avg(wc) FILTER (wrong), 0) AS wrong_mean,
  count(*) FILTER (NOT wrong) AS right_n, coalesce(avg(wc) FILTER (NOT wrong), 0) AS right_mean FROM {_LEN} GROUP BY ALL""", "wrong_mean right_mean"))
def length_errors(spark, d):
    return C.length_errors(_with_text(spark, d))


@query("mann_whitney", sql("pred wlen", f"""SELECT model, seed, n1 AS wrong_n, n2 AS right_n, wrong_mean, right_mean, wrong_over30, right_over30, u,
  (greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS z FROM (
  SELECT model, seed, CAST(count(*) FILTER (wrong) AS DOUBLE) AS n1, CAST(count(*) FILTER (NOT wrong) AS DOUBLE) AS n2, avg(wc) FILTER (wrong) AS wrong_mean, avg(wc) FILTER (NOT wrong) AS right_mean,
    100.0 * count(*) FILTER (wrong AND wc > 30) / count(*) FILTER (wrong) AS wrong_over30, 100.0 * count(*) FILTER (NOT wrong AND wc > 30) / count(*) FILTER (NOT wrong) AS right_over30,
    CAST(sum(r) FILTER (wrong) - count(*) FILTER (wrong) * (count(*) FILTER (wrong) + 1) / 2.0 AS DOUBLE) AS u,
    CAST(sum((t * t * t - t) * 1.0 / t) AS DOUBLE) AS ties
  FROM (SELECT model, seed, wc, wrong, rank() OVER (PARTITION BY model, seed ORDER BY wc) + (count(*) OVER (PARTITION BY model, seed, wc) - 1) / 2.0 AS r,
    CAST(count(*) OVER (PARTITION BY model, seed, wc) AS DOUBLE) AS t FROM {_LEN}) GROUP BY model, seed)""",
  "wrong_n right_n wrong_mean right_mean wrong_over30 right_over30 u z"))
def mann_whitney(spark, d):
    return C.mann_whitney(_with_text(spark, d)).drop("p_value")


@query("align_parallel", sql("", """SELECT a.conv_id, a.turn, a.role, md5(coalesce(b.text, '')) AS ref_md5 FROM conversations a
  LEFT JOIN conversations b ON b.role = 'user' AND b.conv_id = a.conv_id AND b.turn = a.turn"""))
def align_parallel(spark, d):
    c = table(spark, d, "conversations").select(
        "conv_id", "turn", "role", "text", F.col("role").alias("lang"), F.struct("conv_id", "turn").alias("example"))
    return C.align_parallel(c, "user", "example").select("conv_id", "turn", "role", F.md5("ref_text").alias("ref_md5"))


_FLIPS = """(SELECT *, CASE WHEN NOT base_ok AND aug_ok THEN 'FIXED' WHEN base_ok AND NOT aug_ok THEN 'BROKEN' WHEN base_ok THEN 'both_ok' ELSE 'both_wrong' END AS flip FROM (
  SELECT seed, lang, split, example_id, true_label, bool_or(true_label = pred_label) FILTER (model = 'base') AS base_ok,
  bool_or(true_label = pred_label) FILTER (model = 'aug') AS aug_ok FROM pred GROUP BY ALL))"""


def _flips(spark, d):
    return C.flip_table(_pred(spark, d), "base", "aug")


@query("flip_table", sql("pred", f"SELECT * FROM {_FLIPS}"))
def flip_table(spark, d):
    return _flips(spark, d)


@query("flip_net", sql("pred", f"""SELECT seed, lang, split, count(*) FILTER (flip = 'FIXED') AS fixed, count(*) FILTER (flip = 'BROKEN') AS broken,
  avg(CAST(base_ok AS INTEGER)) AS base_acc, avg(CAST(aug_ok AS INTEGER)) AS aug_acc, count(*) FILTER (flip = 'FIXED') - count(*) FILTER (flip = 'BROKEN') AS net
  FROM {_FLIPS} GROUP BY ALL""", "base_acc aug_acc"))
def flip_net(spark, d):
    return C.flip_net(_flips(spark, d), ["seed", "lang", "split"])


_FACTS = """(SELECT c.lang, c.id, count(*) FILTER (w.token IS NOT NULL AND s.token IS NULL AND y.token IS NOT NULL) AS ncov,
  count(*) FILTER (w.token IS NOT NULL AND s.token IS NULL) * 1.0 / greatest(count(w.token), 1) AS oov_seed
  FROM corpus c LEFT JOIN (SELECT id, lang, unnest(list_distinct(t)) AS token FROM tok) w ON w.id = c.id
  LEFT JOIN (SELECT lang, token FROM voc WHERE corpus = 'seed') s ON s.lang = w.lang AND s.token = w.token
  LEFT JOIN (SELECT lang, token FROM voc WHERE corpus = 'syn') y ON y.lang = w.lang AND y.token = w.token WHERE c.corpus = 'test' GROUP BY ALL)"""


def _flip_facts(spark, d):
    t = _texts(spark, d)
    flips = _flips(spark, d).where("split = 'test'")
    test, seed, syn = (t.where(f"corpus = '{x}'") for x in ("test", "seed", "syn"))
    facts = C.coverage_facts(test, seed, syn).join(C.implicit_flags(test, seed), ["lang", "id"])
    return flips.join(facts.withColumnRenamed("id", "example_id"), ["lang", "example_id"])


@query("coverage_facts", sql("tok voc", f"SELECT * FROM {_FACTS}", "oov_seed"))
def coverage_facts(spark, d):
    t = _texts(spark, d)
    return C.coverage_facts(t.where("corpus = 'test'"), t.where("corpus = 'seed'"), t.where("corpus = 'syn'"))


_FF = f"(SELECT f.*, k.ncov, k.oov_seed, i.implicit FROM {_FLIPS} f JOIN {_FACTS} k ON k.id = f.example_id JOIN {_IMPLICIT} i ON i.id = f.example_id WHERE f.split = 'test')"


@query("fix_rate_by_coverage", sql("tok voc pred", f"""SELECT ncov > 0 AS has_new_words, count(*) AS n, avg(CAST(aug_ok AS INTEGER)) AS fix_rate FROM {_FF} WHERE NOT base_ok GROUP BY ALL""", "fix_rate"))
def fix_rate_by_coverage(spark, d):
    return C.fix_rate_by_coverage(_flip_facts(spark, d))


@query("flip_profile", sql("tok voc pred", f"""SELECT flip, count(*) AS n, avg(CAST(implicit AS INTEGER)) AS implicit, avg(CASE WHEN true_label = 'neutral' THEN 1.0 ELSE 0.0 END) AS neutral,
  avg(ncov) AS mean_new_words, avg(oov_seed) AS mean_oov FROM {_FF} WHERE flip IN ('FIXED', 'BROKEN') GROUP BY ALL""", "implicit neutral mean_new_words mean_oov"))
def flip_profile(spark, d):
    return C.flip_profile(_flip_facts(spark, d))


def _ensemble_sql(filter_: str = "", by: str = "model, lang, split") -> str:
    soft = """SELECT *, exp(z0 - m) / (exp(z0 - m) + exp(z1 - m) + exp(z2 - m)) AS q0, exp(z1 - m) / (exp(z0 - m) + exp(z1 - m) + exp(z2 - m)) AS q1,
      exp(z2 - m) / (exp(z0 - m) + exp(z1 - m) + exp(z2 - m)) AS q2 FROM (SELECT *, greatest(z0, z1, z2) AS m FROM predictions)"""
    summed = f"SELECT model, lang, split, example_id, true_label, sum(q0) AS s0, sum(q1) AS s1, sum(q2) AS s2 FROM ({soft}) {filter_} GROUP BY ALL"
    picked = f"SELECT *, CASE WHEN s0 >= s1 AND s0 >= s2 THEN 'negative' WHEN s1 >= s2 THEN 'neutral' ELSE 'positive' END AS p FROM ({summed})"
    cells = f"""SELECT {by}, x, count(*) FILTER (true_label = x AND p = x) AS tp, count(*) FILTER (true_label = x) AS su, count(*) FILTER (p = x) AS pr
      FROM ({picked}) CROSS JOIN (SELECT unnest(['negative', 'neutral', 'positive']) AS x) GROUP BY ALL"""
    return f"""SELECT {by}, CAST(sum(su) AS BIGINT) AS n, sum(CASE WHEN su + pr > 0 THEN 2.0 * tp / (su + pr) ELSE 0 END) / count(*) FILTER (su + pr > 0) AS f1,
      CAST(sum(tp) AS DOUBLE) / sum(su) AS accuracy FROM ({cells}) GROUP BY ALL"""


@query("ensemble", sql("predictions", _ensemble_sql(), "f1 accuracy"))
def ensemble(spark, d):
    return C.ensemble(predictions(spark, d))


def _greedy_sql() -> str:
    """One step per seed; r: running class sums, t: those with the step's seed, b: the decision."""
    def f1(src: str, by: str) -> str:
        cells = ", ".join(f"count(*) FILTER (true_label = '{x}' AND p = '{x}') AS h{i}, count(*) FILTER (true_label = '{x}') + count(*) FILTER (p = '{x}') AS c{i}"
                          for i, x in enumerate(LABELS))
        scores = " + ".join(f"coalesce(CAST(2 * h{i} AS DOUBLE) / nullif(c{i}, 0), 0)" for i in range(3))
        return f"(SELECT {by}, ({scores}) / ((c0 > 0)::INT + (c1 > 0)::INT + (c2 > 0)::INT) AS f1 FROM (SELECT {by}, {cells} FROM {src} GROUP BY ALL))"

    pick = lambda x: f"CASE WHEN {x}0 >= {x}1 AND {x}0 >= {x}2 THEN 'negative' WHEN {x}1 >= {x}2 THEN 'neutral' ELSE 'positive' END AS p"
    total = "(exp(z0 - m) + exp(z1 - m) + exp(z2 - m))"
    key = "model, lang, example_id, true_label"
    parts = [f"""soft AS MATERIALIZED (SELECT *, exp(z0 - m) / {total} AS s0, exp(z1 - m) / {total} AS s1, exp(z2 - m) / {total} AS s2, {pick('z')}
      FROM (SELECT *, greatest(z0, z1, z2) AS m FROM predictions WHERE split = 'valid'))""",
             f"ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY model, lang ORDER BY f1 DESC, seed) AS step FROM {f1('soft', 'model, lang, seed')})",
             f"r1 AS MATERIALIZED (SELECT {key}, s0, s1, s2 FROM soft JOIN ranked USING (model, lang, seed) WHERE step = 1)",
             "b1 AS MATERIALIZED (SELECT model, lang, seed, 1 AS step, 'start' AS action, f1 AS val_f1, f1 AS best FROM ranked WHERE step = 1)"]
    for i in range(2, len(SEEDS) + 1):
        parts += [f"""t{i} AS MATERIALIZED (SELECT {key}, sum(s0) AS s0, sum(s1) AS s1, sum(s2) AS s2 FROM (SELECT * FROM r{i - 1} UNION ALL
          SELECT {key}, s0, s1, s2 FROM soft JOIN ranked USING (model, lang, seed) WHERE step = {i}) GROUP BY ALL)""",
                  f"""b{i} AS MATERIALIZED (SELECT model, lang, ranked.seed, {i} AS step, CASE WHEN f.f1 >= best THEN 'ADD' ELSE 'skip' END AS action, f.f1 AS val_f1, greatest(f.f1, best) AS best
          FROM ranked JOIN {f1(f"(SELECT *, {pick('s')} FROM t{i})", 'model, lang')} f USING (model, lang) JOIN b{i - 1} USING (model, lang) WHERE ranked.step = {i})""",
                  f"""r{i} AS MATERIALIZED (SELECT {key}, s0, s1, s2 FROM t{i} JOIN b{i} USING (model, lang) WHERE action = 'ADD' UNION ALL
          SELECT {key}, s0, s1, s2 FROM r{i - 1} JOIN b{i} USING (model, lang) WHERE action = 'skip')"""]
    rows = " UNION ALL ".join(f"SELECT model, lang, step, seed, action, val_f1 FROM b{i}" for i in range(1, len(SEEDS) + 1))
    return f"WITH {', '.join(parts)} {rows}"


@query("greedy_ensemble", sql("predictions", _greedy_sql(), "val_f1"))
def greedy_ensemble(spark, d):
    """Order-dependent selection; also compared with a sequential copy in the tests."""
    return C.greedy_ensemble(predictions(spark, d))


@query("transfer_report", sql("f1s", """SELECT *, f1 >= 80 AS gate FROM (SELECT model, seed, lang, 100 * f1 AS f1 FROM f1s WHERE split = 'test'
  UNION ALL SELECT model, seed, 'MEAN', avg(100 * f1) FROM f1s WHERE split = 'test' GROUP BY ALL)""", "f1"))
def transfer_report(spark, d):
    return C.transfer_report(_pred(spark, d).where("split = 'test'"), ["model", "seed"])


# ---- runs -------------------------------------------------------------------------------

_R = "train_f1 val_f1 test_f1 gap"


_ARMS = """SELECT seed, lang, CAST(printf('%.2f', 100 * max(test_f1) FILTER (config = 'base')) AS DOUBLE) AS baseline,
  CAST(printf('%.2f', 100 * max(test_f1) FILTER (config = 'aug')) AS DOUBLE) AS augmented,
  CAST(printf('%.2f', 100 * (max(test_f1) FILTER (config = 'aug') - max(test_f1) FILTER (config = 'base'))) AS DOUBLE) AS delta FROM res GROUP BY ALL"""


@query("compare_arms", sql("res", f"""SELECT * FROM (WITH r AS ({_ARMS}) SELECT * FROM r UNION ALL SELECT seed, 'MEAN', CAST(printf('%.2f', round(avg(baseline), 9)) AS DOUBLE),
  CAST(printf('%.2f', round(avg(augmented), 9)) AS DOUBLE), CAST(printf('%.2f', round(avg(delta), 9)) AS DOUBLE) FROM r GROUP BY seed)""", "baseline augmented delta"))
def compare_arms(spark, d):
    return R.compare_arms(_res(spark, d), "base", "aug")


@query("winners_losers", sql("res", f"""SELECT seed, count(*) FILTER (delta > 0) AS winners, count(*) FILTER (delta < 0) AS losers, count(*) AS langs FROM ({_ARMS}) GROUP BY seed"""))
def winners_losers(spark, d):
    return R.winners_losers(R.compare_arms(_res(spark, d), "base", "aug"))


def _reference(spark, d):
    """Published scores stand-in: seed 0 of the baseline, one language missing."""
    return _res(spark, d).where("seed = 0 AND config = 'base' AND lang <> 'es'").select("lang", (F.col("test_f1") * 100).alias("ref_f1"))


@query("vs_reference", sql("res", """SELECT *, CASE WHEN deviation IS NULL THEN '' WHEN abs(deviation) <= 2 THEN 'OK' ELSE 'CHECK' END AS flag FROM (
  SELECT a.config, a.seed, a.lang, 100 * a.test_f1 AS our_f1, b.ref_f1, 100 * a.test_f1 - b.ref_f1 AS deviation FROM res a LEFT JOIN (
  SELECT lang, 100 * test_f1 AS ref_f1 FROM res WHERE seed = 0 AND config = 'base' AND lang <> 'es') b USING (lang))""", "our_f1 ref_f1 deviation"))
def vs_reference(spark, d):
    return R.vs_reference(_res(spark, d), _reference(spark, d))


@query("seed_stats", sql("res", """SELECT config, lang, metric, 100 * avg(value) AS mean, 100 * stddev_samp(value) AS std, count(*) AS n FROM (
  UNPIVOT (SELECT config, seed, lang, train_f1, val_f1, test_f1, gap FROM res) ON train_f1, val_f1, test_f1, gap INTO NAME metric VALUE value) GROUP BY ALL""", "mean std"))
def seed_stats(spark, d):
    return R.seed_stats(_res(spark, d))


@query("verdict", sql("res", """SELECT *, CASE WHEN ch_n = 0 OR ft_n = 0 THEN '?' WHEN delta >= 0 THEN 'OK' WHEN abs(delta) <= greatest(1.0, 2 * se) THEN 'within-noise' ELSE 'regression' END AS verdict
  FROM (SELECT *, ch_mean - ft_mean AS delta, sqrt(pow(CASE WHEN ch_n >= 2 THEN ch_std ELSE 1.3 END, 2) / greatest(ch_n, 1) + pow(CASE WHEN ft_n >= 2 THEN ft_std ELSE 1.3 END, 2) / greatest(ft_n, 1)) AS se FROM (
  SELECT lang, 100 * avg(test_f1) FILTER (config = 'aug') AS ch_mean, 100 * stddev_samp(test_f1) FILTER (config = 'aug') AS ch_std, count(*) FILTER (config = 'aug') AS ch_n,
  100 * avg(test_f1) FILTER (config = 'base') AS ft_mean, 100 * stddev_samp(test_f1) FILTER (config = 'base') AS ft_std, count(*) FILTER (config = 'base') AS ft_n FROM res GROUP BY ALL))""",
  "ch_mean ch_std ft_mean ft_std delta se"))
def verdict(spark, d):
    return R.verdict(_res(spark, d), "aug", "base")


_SCORES = "(SELECT config, seed, 100 * avg(val_f1) AS score FROM res GROUP BY ALL)"


@query("median_run", sql("res", f"""SELECT config, max(md) AS median, arg_min(seed, abs(score - md) * 1000000 + seed / 1000000.0) AS closest_seed, max(seed) FILTER (pos = n // 2 + 1) AS middle_seed FROM (
  SELECT *, row_number() OVER (PARTITION BY config ORDER BY score, seed) AS pos, count(*) OVER (PARTITION BY config) AS n, median(score) OVER (PARTITION BY config) AS md FROM {_SCORES}) GROUP BY ALL""", "median"))
def median_run(spark, d):
    return R.median_run(_res(spark, d))


@query("maximin_run", sql("res", """SELECT *, seed <> 42 AND gate_score >= base_score + 0.5 AS gate_pass FROM (
  SELECT w.config, w.seed, w.worst, w.worst_lang, w.gate_score, b.gate_score AS base_score FROM (
    SELECT * FROM (SELECT config, seed, 100 * min(val_f1) AS worst, (array_agg(lang ORDER BY round(100 * val_f1, 9), lang))[1] AS worst_lang, 100 * max(val_f1) FILTER (lang = 'en') AS gate_score FROM res GROUP BY ALL)
    QUALIFY row_number() OVER (PARTITION BY config ORDER BY round(worst, 9) DESC, seed) = 1) w
  JOIN (SELECT config, 100 * max(val_f1) AS gate_score FROM res WHERE seed = 42 AND lang = 'en' GROUP BY ALL) b USING (config))""", "worst gate_score base_score"))
def maximin_run(spark, d):
    return R.maximin_run(_res(spark, d), 42, "en", 0.5)


@query("leaderboard", sql("res", """SELECT c.config, c.f1_en, c.f1_fr, c.f1_en - b.f1_en AS delta_en, c.f1_fr - b.f1_fr AS delta_fr, (c.f1_de + c.f1_es) / 2 AS winners_mean,
  (c.f1_de + c.f1_en + c.f1_es + c.f1_fr) / 4 AS scope_mean, c.gap AS gap_mean, round(c.f1_en, 9) >= round(b.f1_en, 9) AND round(c.f1_fr, 9) >= round(b.f1_fr, 9) AS candidate FROM (
  SELECT config, """ + ", ".join(f"100 * avg(test_f1) FILTER (lang = '{l}') AS f1_{l}" for l in SCOPE) + ", (" + " + ".join(f"100 * avg(gap) FILTER (lang = '{l}')" for l in SCOPE) + """) / 4 AS gap FROM res GROUP BY ALL) c
  CROSS JOIN (SELECT """ + ", ".join(f"100 * avg(test_f1) FILTER (lang = '{l}') AS f1_{l}" for l in SCOPE) + " FROM res WHERE config = 'base') b", "f1_en f1_fr delta_en delta_fr winners_mean scope_mean gap_mean"))
def leaderboard(spark, d):
    return R.leaderboard(_res(spark, d), "base", ["en", "fr"], ["de", "es"], SCOPE)


@query("gated_cells", sql("res", """SELECT *, f1 >= 80 AND gap < 10 AS star FROM (SELECT config, lang, 100 * avg(test_f1) AS f1, 100 * stddev_samp(test_f1) AS std, 100 * avg(gap) AS gap FROM res GROUP BY ALL)""", "f1 std gap"))
def gated_cells(spark, d):
    return R.gated_cells(_res(spark, d))


_ARMS = ("base", "aug", "aug0")


def _three(spark, d):
    r = _res(spark, d)
    return r.unionByName(r.where("config = 'aug' AND seed = 0").withColumn("config", F.lit("aug0")))


@query("three_arm", sql("res", """SELECT *, c_f1 - b_f1 AS c_minus_b, c_f1 - a_f1 AS c_minus_a FROM (WITH w AS (SELECT lang,
  100 * avg(test_f1) FILTER (config = 'base') AS a_f1, 100 * avg(gap) FILTER (config = 'base') AS a_gap, 100 * avg(test_f1) FILTER (config = 'aug') AS b_f1, 100 * avg(gap) FILTER (config = 'aug') AS b_gap,
  100 * avg(test_f1) FILTER (config = 'aug' AND seed = 0) AS c_f1, 100 * avg(gap) FILTER (config = 'aug' AND seed = 0) AS c_gap FROM res GROUP BY ALL)
  SELECT * FROM w UNION ALL SELECT 'MEAN', avg(a_f1), avg(a_gap), avg(b_f1), avg(b_gap), avg(c_f1), avg(c_gap) FROM w)""", "a_f1 a_gap b_f1 b_gap c_f1 c_gap c_minus_b c_minus_a"))
def three_arm(spark, d):
    return R.three_arm(_three(spark, d), _ARMS)


_GATES = """(SELECT *, n_f1 = 4 AND n_gap = 4 AS all_pass FROM (SELECT config, seed, count(*) FILTER (100 * test_f1 >= 80) AS n_f1, count(*) FILTER (100 * gap < 10) AS n_gap, 100 * avg(val_f1) AS val,
  coalesce(string_agg(CASE WHEN 100 * test_f1 < 80 THEN lang END, ',' ORDER BY lang), '') AS failing_f1, coalesce(string_agg(CASE WHEN 100 * gap >= 10 THEN lang END, ',' ORDER BY lang), '') AS failing_gap
  FROM res GROUP BY ALL HAVING count(DISTINCT lang) = 4))"""


@query("gate_runs", sql("res", f"SELECT * FROM {_GATES}", "val"))
def gate_runs(spark, d):
    return R.gate_runs(_res(spark, d), SCOPE)


@query("pass_rate", sql("res", f"""SELECT config, count(*) FILTER (all_pass) AS passing, count(*) AS runs, max(seed) FILTER (pos = n // 2 + 1) AS middle_seed, bool_or(all_pass) FILTER (pos = n // 2 + 1) AS middle_pass FROM (
  SELECT *, row_number() OVER (PARTITION BY config ORDER BY val, seed) AS pos, count(*) OVER (PARTITION BY config) AS n FROM {_GATES}) GROUP BY ALL"""))
def pass_rate(spark, d):
    return R.pass_rate(R.gate_runs(_res(spark, d), SCOPE))


@query("pending_units", sql("res", "SELECT config, seed, lang FROM res WHERE NOT (config = 'base' OR seed IN (0, 1))"))
def pending_units(spark, d):
    r = _res(spark, d)
    return R.pending_units(r.select("config", "seed", "lang"), r.where("config = 'base' OR seed IN (0, 1)"))


@query("complete_runs", sql("res", "SELECT config, seed, count(DISTINCT lang) AS langs FROM res GROUP BY ALL HAVING count(DISTINCT lang) >= 4"))
def complete_runs(spark, d):
    return R.complete_runs(_res(spark, d), 4)


_HIST = """(WITH b AS (SELECT lang, batch_idx, CAST(sum(id) AS BIGINT) AS s, count(*) AS n FROM corpus GROUP BY ALL)
  SELECT lang, batch_idx * 2 AS pos, CAST(batch_idx % 7 AS DOUBLE) AS epoch, n / (batch_idx % 7 + 1.0) AS loss, NULL AS eval_loss, NULL AS eval_f1 FROM b
  UNION ALL SELECT lang, batch_idx * 2 + 1, CAST(batch_idx % 7 AS DOUBLE), NULL, s % 97 / 97.0, s % 13 / 13.0 FROM b)"""


@query("dedupe_epoch", sql("corpus", f"SELECT lang, epoch, arg_max(pos, pos) AS pos, arg_max(eval_loss, pos) AS eval_loss, arg_max(eval_f1, pos) AS eval_f1 FROM {_HIST} WHERE eval_loss IS NOT NULL GROUP BY ALL", "epoch eval_loss eval_f1"))
def dedupe_epoch(spark, d):
    return R.dedupe_epoch(history(spark, d), ["lang"])


@query("best_epoch", sql("corpus", f"""SELECT lang, max(epoch) FILTER (r = 1) AS best_epoch, max(eval_f1) AS best_f1, arg_max(epoch, pos) AS stop_epoch FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY eval_f1 DESC, pos) AS r FROM {_HIST} WHERE eval_f1 IS NOT NULL) GROUP BY ALL""", "best_epoch best_f1 stop_epoch"))
def best_epoch(spark, d):
    return R.best_epoch(history(spark, d), ["lang"])


@query("loss_curves", sql("corpus", f"""SELECT lang, epoch, arg_max(loss, pos) FILTER (loss IS NOT NULL) AS train_loss, arg_max(eval_loss, pos) FILTER (eval_loss IS NOT NULL) AS val_loss,
  100 * arg_max(eval_f1, pos) FILTER (eval_f1 IS NOT NULL) AS val_f1 FROM {_HIST} GROUP BY ALL""", "epoch train_loss val_loss val_f1"))
def loss_curves(spark, d):
    return R.loss_curves(history(spark, d), ["lang"])


# ---- model stages -----------------------------------------------------------------------

_LETTERS = "length(text) - length(replace(text, '{}', ''))"
_SENT = f"""SELECT id, CASE WHEN a >= e AND a >= o THEN 'negative' WHEN e >= o THEN 'neutral' ELSE 'positive' END AS sentiment_label,
  CAST(printf('%.4f', CAST(CAST(greatest(a, e, o) AS DOUBLE) / greatest(a + e + o, 1) AS DOUBLE)) AS DOUBLE) AS sentiment_conf FROM (
  SELECT id, {_LETTERS.format('a')} AS a, {_LETTERS.format('e')} AS e, {_LETTERS.format('o')} AS o FROM corpus)"""


@query("score_sentiment", sql("corpus", _SENT, "sentiment_conf"))
def score_sentiment(spark, d):
    return M.score_sentiment(corpus(spark, d), letter_sentiment).select("id", "sentiment_label", "sentiment_conf")


_MARK_A = {"de": "sch", "en": "th", "es": "ci", "fr": "eau"}
_MARK_B = {"de": "ein", "en": "er", "es": "do", "fr": "re"}


def _lid_sql(markers: dict, model: str) -> str:
    clean = "regexp_replace(regexp_replace(text, chr(10), ' ', 'g'), '^[\\t-\\r\\x1c-\\x20\\x85\\p{Z}]+|[\\t-\\r\\x1c-\\x20\\x85\\p{Z}]+$', '', 'g')"
    counts = " UNION ALL ".join(
        f"SELECT id, lang, corpus, '{l}' AS l, (length(c) - length(replace(c, '{m}', ''))) // {len(m)} + 1 AS n FROM (SELECT id, lang, corpus, {clean} AS c FROM corpus)" for l, m in markers.items())
    return f"""SELECT '{model}' AS model, id, lang, corpus, l, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY id) AS score, row_number() OVER (PARTITION BY id ORDER BY n DESC, l) AS r FROM ({counts})"""


def _lid(spark, d, model, markers):
    rows = M.identify_language(corpus(spark, d), marker_language(markers), 3)
    return rows.withColumns({"model": F.lit(model), "expected": F.concat(F.lit("__label__"), F.col("lang"), F.lit("_Latn"))})


def _both(spark, d):
    return _lid(spark, d, "a", _MARK_A).unionByName(_lid(spark, d, "b", _MARK_B))


@query("identify_language", sql("corpus", f"SELECT id, l AS lid_lang, CAST(printf('%.4f', CAST(score AS DOUBLE)) AS DOUBLE) AS lid_conf FROM ({_lid_sql(_MARK_A, 'a')}) WHERE r = 1", "lid_conf"))
def identify_language(spark, d):
    return _lid(spark, d, "a", _MARK_A).select("id", "lid_lang", "lid_conf")


_LID = f"""(SELECT *, 100.0 * top1_correct / total AS top1_accuracy, 100.0 * top3_correct / total AS top3_accuracy FROM (
  SELECT model, lang, corpus, count(DISTINCT id) AS total, count(*) FILTER (r = 1 AND l = lang) AS top1_correct, count(*) FILTER (r <= 3 AND l = lang) AS top3_correct,
  avg(CAST(printf('%.4f', CAST(score AS DOUBLE)) AS DOUBLE)) FILTER (r = 1) AS avg_confidence FROM ({_lid_sql(_MARK_A, 'a')} UNION ALL {_lid_sql(_MARK_B, 'b')}) GROUP BY ALL))"""


def _report(spark, d):
    return M.lid_report(_both(spark, d), ["model", "lang", "corpus"])


@query("lid_report", sql("corpus", f"SELECT * FROM {_LID}", "top1_accuracy top3_accuracy avg_confidence"))
def lid_report(spark, d):
    return _report(spark, d)


_LIDR = f"(SELECT model, lang, total, top1_correct, CAST(printf('%.2f', CAST(top1_accuracy AS DOUBLE)) AS DOUBLE) AS a1, CAST(printf('%.2f', CAST(top3_accuracy AS DOUBLE)) AS DOUBLE) AS a3, CAST(printf('%.4f', CAST(avg_confidence AS DOUBLE)) AS DOUBLE) AS c FROM {_LID})"


@query("lid_by_lang", sql("corpus", f"SELECT model, lang, CAST(sum(total) AS BIGINT) AS total, CAST(sum(top1_correct) AS BIGINT) AS top1_correct, avg(a1) AS top1_accuracy, avg(a3) AS top3_accuracy, avg(c) AS avg_confidence FROM {_LIDR} GROUP BY ALL", "top1_accuracy top3_accuracy avg_confidence"))
def lid_by_lang(spark, d):
    return M.lid_by_lang(_report(spark, d))


@query("lid_compare", sql("corpus", f"""SELECT *, round_even(round(a - b, 9) * 100, 0) / 100 AS a_minus_b FROM (SELECT lang,
  round_even(round(avg(a1) FILTER (model = 'a'), 9) * 100, 0) / 100 AS a, round_even(round(avg(a1) FILTER (model = 'b'), 9) * 100, 0) / 100 AS b
  FROM {_LIDR} GROUP BY ALL)""", "a b a_minus_b"))
def lid_compare(spark, d):
    return M.lid_compare(_report(spark, d), ["a", "b"], [("a", "b")])


@query("lid_macro", sql("corpus", f"SELECT model, avg(a1) AS top1_accuracy, avg(a3) AS top3_accuracy, avg(c) AS avg_confidence FROM {_LIDR} GROUP BY ALL", "top1_accuracy top3_accuracy avg_confidence"))
def lid_macro(spark, d):
    return M.lid_macro(_report(spark, d))


@query("top_confusions", sql("corpus", f"""SELECT lang, l AS lid_lang, n, CAST(r AS INTEGER) AS rank, wrong, n * 1.0 / wrong AS share FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, l) AS r, CAST(sum(n) OVER (PARTITION BY lang) AS BIGINT) AS wrong FROM (
  SELECT lang, l, count(*) AS n FROM ({_lid_sql(_MARK_A, 'a')}) WHERE r = 1 AND l <> lang GROUP BY ALL)) WHERE r <= 2""", "share"))
def top_confusions(spark, d):
    wrong = _lid(spark, d, "a", _MARK_A).where(F.col("lid_lang") != F.col("lang"))
    return M.top_confusions(wrong, ["lang"], "lid_lang", 2)


@query("confidence_hist", sql("pred", """SELECT model, lang, ok, CAST(least(floor((conf - lo) / (hi - lo) * 20), 19) AS INTEGER) AS bin, count(*) AS n FROM (
  SELECT *, min(conf) OVER (PARTITION BY model, lang, ok) AS lo, max(conf) OVER (PARTITION BY model, lang, ok) AS hi FROM (
  SELECT *, true_label = pred_label AS ok FROM pred)) GROUP BY ALL"""))
def confidence_hist(spark, d):
    rows = _pred(spark, d).withColumn("ok", F.col("true_label") == F.col("pred_label"))
    return M.confidence_hist(rows, ["model", "lang", "ok"], "conf")


@query("train_per_language")
def train_per_language(spark, d):
    """Scores of one classifier per language (optimizer results, no SQL form)."""
    return C.results(N.train_per_language(corpus(spark, d), SCOPE, "per_language"))


@query("train_pooled")
def train_pooled(spark, d):
    """Scores of one classifier over all languages."""
    return C.results(N.train_pooled(corpus(spark, d), "pooled"))


@query("sweep")
def sweep(spark, d):
    """A resumed sweep: the second call trains only what the first left open."""
    path = scratch_path(spark, "sweep")
    units = N.grid({"reg": [0.01, 0.1]}, SEEDS, SCOPE, spark)
    N.sweep(corpus(spark, d), units.where("config LIKE '%0.01%'"), None, path)
    N.sweep(corpus(spark, d), units, spark.read.parquet(path), path)
    return spark.read.parquet(path)
