"""Length, label and mix metrics of the corpora."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lengths as L
from ..sources.corpora import complete_langs
from ..testbed import corpus, outcome_log
from .registry import query, sql

_Q = lambda c, p, name: f"quantile_cont({c}, {p}) AS {name}"


@query("length_profile", sql("wlen", """SELECT lang, label, count(*) AS n, avg(wc) AS mean, stddev_samp(wc) AS std,
  """ + ", ".join(f"CAST(floor(quantile_cont(wc, {p}) + 1e-9) AS INTEGER) AS {n}" for n, p in
                  (("p10", .1), ("p25", .25), ("p50", .5), ("p75", .75), ("p90", .9), ("p95", .95))) + """,
  CAST(min(wc) AS INTEGER) AS min, CAST(max(wc) AS INTEGER) AS max FROM wlen WHERE corpus = 'seed' GROUP BY ALL""", "mean std"))
def length_profile(spark, d):
    return L.length_profile(corpus(spark, d).where("corpus = 'seed'"), ["lang", "label"])


@query("length_examples", sql("wlen", """SELECT lang, label, md5(max(text) FILTER (r = greatest(0, CAST(floor(n * 0.10) AS BIGINT)))) AS short_md5,
  md5(max(text) FILTER (r = CAST(floor(n * 0.50) AS BIGINT))) AS medium_md5,
  md5(max(text) FILTER (r = least(n - 1, CAST(floor(n * 0.90) AS BIGINT)))) AS long_md5
  FROM (SELECT lang, label, text, count(*) OVER (PARTITION BY lang, label) AS n,
    row_number() OVER (PARTITION BY lang, label ORDER BY wc, md5(CAST(id AS VARCHAR) || '#nth'), id) - 1 AS r FROM wlen WHERE corpus = 'seed')
  GROUP BY ALL"""))
def length_examples(spark, d):
    e = L.length_examples(corpus(spark, d).where("corpus = 'seed'"), ["lang", "label"])
    return e.select("lang", "label", *[F.md5(x).alias(f"{x}_md5") for x in ("short", "medium", "long")])


@query("seed_profile", sql("wlen", """SELECT lang, label, avg(wc) AS mean, stddev_samp(wc) AS std,
  max(length(text)) FILTER (r = n // 2) AS medium_chars
  FROM (SELECT lang, label, text, wc, count(*) OVER (PARTITION BY lang, label) AS n,
    row_number() OVER (PARTITION BY lang, label ORDER BY wc, md5(CAST(id AS VARCHAR) || '#nth'), id) - 1 AS r FROM wlen WHERE corpus = 'seed')
  GROUP BY ALL""", "mean std"))
def seed_profile(spark, d):
    p = L.seed_profile(corpus(spark, d).where("corpus = 'seed'"), ["lang", "label"])
    return p.select("lang", "label", "lengths.mean", "lengths.std", F.length("examples.medium").cast("long").alias("medium_chars"))


@query("label_dist", sql("corpus", """SELECT lang, corpus, label, n, total, n * 1.0 / total AS share FROM (
  SELECT lang, corpus, label, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY lang, corpus) AS BIGINT) AS total FROM corpus GROUP BY lang, corpus, label)""", "share"))
def label_dist(spark, d):
    return L.label_dist(corpus(spark, d), ["lang", "corpus"])


@query("corpus_sizes", sql("corpus", "SELECT corpus, count(*) AS n FROM corpus GROUP BY ALL"))
def corpus_sizes(spark, d):
    return L.corpus_sizes(corpus(spark, d))


@query("token_length_stats", sql("tlen", "SELECT lang, corpus, count(*) AS n, avg(tc) AS mean, stddev_pop(tc) AS std, "
  + ", ".join(_Q("tc", p, n) for n, p in (("p5", .05), ("p10", .1), ("p25", .25), ("p50", .5), ("p75", .75), ("p90", .9), ("p95", .95)))
  + ", CAST(min(tc) AS INTEGER) AS min, CAST(max(tc) AS INTEGER) AS max FROM tlen GROUP BY ALL", "mean std p5 p10 p25 p50 p75 p90 p95"))
def token_length_stats(spark, d):
    return L.token_length_stats(corpus(spark, d), ["lang", "corpus"])


@query("word_length_stats", sql("wlen", """SELECT lang, corpus, count(*) AS n, avg(wc) AS mean, stddev_samp(wc) AS std,
  CAST(min(wc) AS INTEGER) AS min, CAST(max(wc) AS INTEGER) AS max, CAST(floor(quantile_cont(wc, 0.5) + 1e-9) AS INTEGER) AS median,
  CAST(floor(quantile_cont(wc, 0.95) + 1e-9) AS INTEGER) AS p95 FROM wlen GROUP BY ALL""", "mean std"))
def word_length_stats(spark, d):
    return L.word_length_stats(corpus(spark, d), ["lang", "corpus"])


@query("bucket_shares", sql("tlen", "SELECT lang, corpus, " + ", ".join(
    f"avg(CASE WHEN tc BETWEEN {lo} AND {hi} THEN 100.0 ELSE 0.0 END) AS b{lo}_{hi}"
    for lo, hi in ((0, 9), (10, 19), (20, 29), (30, 39), (40, 49), (50, 100))) + " FROM tlen GROUP BY ALL",
    "b0_9 b10_19 b20_29 b30_39 b40_49 b50_100"))
def bucket_shares(spark, d):
    return L.bucket_shares(corpus(spark, d), ["lang", "corpus"])


@query("length_by_label", sql("tlen", """SELECT corpus, label, count(*) AS n, avg(tc) AS mean, stddev_pop(tc) AS std,
  quantile_cont(tc, 0.05) AS p5, quantile_cont(tc, 0.95) AS p95 FROM tlen GROUP BY ALL""", "mean std p5 p95"))
def length_by_label(spark, d):
    return L.length_by_label(corpus(spark, d), ["corpus"])


@query("length_match", sql("wlen", """SELECT *, CASE WHEN CAST(printf('%.2f', std_ratio) AS DOUBLE) BETWEEN 0.80 AND 1.20 AND abs(CAST(printf('%.1f', mean_diff) AS DOUBLE)) <= 5 THEN 'OK' ELSE 'CHECK' END AS verdict
  FROM (SELECT *, syn_mean - seed_mean AS mean_diff, syn_std / seed_std AS std_ratio FROM (SELECT lang, label,
    count(*) FILTER (corpus = 'seed') AS seed_n, count(*) FILTER (corpus = 'syn') AS syn_n,
    avg(wc) FILTER (corpus = 'seed') AS seed_mean, avg(wc) FILTER (corpus = 'syn') AS syn_mean,
    stddev_samp(wc) FILTER (corpus = 'seed') AS seed_std, stddev_samp(wc) FILTER (corpus = 'syn') AS syn_std
    FROM wlen GROUP BY ALL) WHERE seed_n > 1 AND syn_n > 1)""", "seed_mean syn_mean seed_std syn_std mean_diff std_ratio"))
def length_match(spark, d):
    return L.length_match(corpus(spark, d))


@query("tail_gap", sql("wlen", "SELECT lang, label, " + ", ".join(
    f"stddev_samp(wc) FILTER (corpus = '{c}') AS {c}_std, CAST(floor(quantile_cont(wc, 0.95) FILTER (corpus = '{c}') + 1e-9) AS INTEGER) AS {c}_p95, "
    f"100 * avg(CASE WHEN wc > 30 THEN 1.0 ELSE 0.0 END) FILTER (corpus = '{c}') AS {c}_over30" for c in ("seed", "syn", "test"))
    + " FROM wlen GROUP BY ALL", "seed_std seed_over30 syn_std syn_over30 test_std test_over30"))
def tail_gap(spark, d):
    return L.tail_gap(corpus(spark, d))


@query("outside_range", sql("tlen", """SELECT lang, p5, p95, count(*) FILTER (tc < p5 OR tc > p95) AS outside, count(*) AS total,
  100.0 * count(*) FILTER (tc < p5 OR tc > p95) / count(*) AS pct
  FROM tlen JOIN (SELECT lang, quantile_cont(tc, 0.05) AS p5, quantile_cont(tc, 0.95) AS p95 FROM tlen WHERE corpus = 'syn' GROUP BY ALL) USING (lang)
  WHERE corpus = 'test' GROUP BY ALL""", "p5 p95 pct"))
def outside_range(spark, d):
    return L.outside_range(corpus(spark, d), ["lang"])


@query("mix_ratio", sql("corpus", """SELECT lang, a AS seed_n, b AS syn_n, 100.0 * a / (a + b) AS seed_pct, 100.0 * b / (a + b) AS syn_pct,
  16.0 * a / (a + b) AS seed_per_batch, 16.0 * b / (a + b) AS syn_per_batch FROM (
  SELECT lang, count(*) FILTER (corpus = 'seed') AS a, count(*) FILTER (corpus = 'syn') AS b FROM corpus WHERE corpus IN ('seed', 'syn') GROUP BY ALL)""",
  "seed_pct syn_pct seed_per_batch syn_per_batch"))
def mix_ratio(spark, d):
    return L.mix_ratio(corpus(spark, d), ["lang"])


@query("length_kl", sql("tlen", """SELECT lang, sum((p / pn + 1e-10) * ln((p / pn + 1e-10) / (q / qn + 1e-10))) AS kl FROM (
  SELECT g.lang, b.bin, CAST(count(*) FILTER (t.corpus = 'seed') AS DOUBLE) AS p, CAST(count(*) FILTER (t.corpus = 'syn') AS DOUBLE) AS q,
    sum(count(*) FILTER (t.corpus = 'seed')) OVER (PARTITION BY g.lang) AS pn, sum(count(*) FILTER (t.corpus = 'syn')) OVER (PARTITION BY g.lang) AS qn
  FROM (SELECT DISTINCT lang FROM corpus) g CROSS JOIN (SELECT unnest(range(25)) AS bin) b
  LEFT JOIN tlen t ON t.lang = g.lang AND t.tc <= 100 AND least(t.tc // 2, 24) = b.bin GROUP BY g.lang, b.bin)
  WHERE pn > 0 AND qn > 0 GROUP BY ALL""", "kl"))
def length_kl(spark, d):
    return L.length_kl(corpus(spark, d), ["lang"])


_SHARES = ", ".join(f"100.0 * count(*) FILTER (corpus = '{c}' AND label = '{x}') / count(*) FILTER (corpus = '{c}') AS {c}_{x[:3]}_pct"
                    for c in ("seed", "syn") for x in ("negative", "neutral", "positive"))
_SHARE_NAMES = " ".join(f"{c}_{x}_pct" for c in ("seed", "syn") for x in ("neg", "neu", "pos"))


@query("yield_report", sql("corpus", f"""SELECT lang, count(*) FILTER (corpus = 'seed') AS seed_count, 5 * count(*) FILTER (corpus = 'seed') AS expected,
  count(*) FILTER (corpus = 'syn') AS actual_synth, 5 * count(*) FILTER (corpus = 'seed') - count(*) FILTER (corpus = 'syn') AS shortfall,
  100.0 * count(*) FILTER (corpus = 'syn') / (5 * count(*) FILTER (corpus = 'seed')) AS yield_pct, {_SHARES} FROM corpus GROUP BY ALL""",
  "yield_pct " + _SHARE_NAMES))
def yield_report(spark, d):
    return L.yield_report(corpus(spark, d))


@query("label_shift", sql("corpus", f"""SELECT *, syn_neg_pct - seed_neg_pct AS diff_neg, syn_neu_pct - seed_neu_pct AS diff_neu,
  syn_pos_pct - seed_pos_pct AS diff_pos FROM (SELECT lang, {_SHARES} FROM corpus GROUP BY ALL)""", _SHARE_NAMES + " diff_neg diff_neu diff_pos"))
def label_shift(spark, d):
    return L.label_shift(corpus(spark, d))


@query("length_range", sql("tlen", """SELECT id, lang, label, CAST(tc AS INTEGER) AS tc, p5, p95 FROM tlen JOIN (
  SELECT lang, label, quantile_cont(tc, 0.05) AS p5, quantile_cont(tc, 0.95) AS p95 FROM tlen WHERE corpus = 'seed' GROUP BY ALL) USING (lang, label)
  WHERE corpus = 'syn' AND tc BETWEEN p5 AND p95""", "p5 p95"))
def length_range(spark, d):
    return L.length_range(corpus(spark, d), ["lang", "label"]).select("id", "lang", "label", "tc", "p5", "p95")


@query("complete_langs", sql("log", """SELECT lang FROM (SELECT lang, corpus AS kind FROM corpus UNION SELECT target_lang, 'log' FROM log)
  GROUP BY lang HAVING count(DISTINCT kind) = 5"""))
def complete(spark, d):
    return complete_langs(corpus(spark, d), outcome_log(spark, d))
