"""Sources and sinks: tables are written in each format, read back and compared whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import classification as C
from ..operators import runs as R
from ..operators.sampling import ratio_variant
from ..sources import corpora as S
from ..sources import logs as G
from ..sources import runs as U
from ..session import scratch_path
from ..testbed import corpus, history, outcome_log, predictions
from .registry import query, sql


@query("read_corpus", sql("corpus", "SELECT id, lang, CASE corpus WHEN 'seed' THEN 'train' ELSE corpus END AS split, label, md5(text) AS text_md5 FROM corpus WHERE corpus <> 'syn'"))
def read_corpus(spark, d):
    root = scratch_path(spark, "csv")
    c = corpus(spark, d).cache()
    for lang in [r["lang"] for r in c.select("lang").distinct().collect()]:
        for split, name in (("train", "seed"), ("valid", "valid"), ("test", "test")):
            S.write_split_csv(c.where((F.col("lang") == lang) & (F.col("corpus") == name)), f"{root}/{lang}/{split}.csv")
    c.unpersist()
    return S.read_corpus(spark, root).select("id", "lang", "split", "label", F.md5("text").alias("text_md5"))


_LINE = r"regexp_replace(text, '[\t\n\r]+', ' ', 'g')"


@query("read_tsv", sql("corpus", f"SELECT md5({_LINE}) AS text_md5, label, count(*) AS n FROM corpus WHERE id % 17 <> 0 AND id % 19 <> 0 GROUP BY ALL"))
def read_tsv(spark, d):
    path = scratch_path(spark, "tsv")
    text = F.regexp_replace("text", r"[\t\n\r]+", " ")
    label = F.when(F.col("id") % 19 == 0, "mixed").otherwise(F.col("label"))
    line = F.concat_ws("\t", text, label, F.when(F.col("id") % 17 == 0, "surplus"))
    corpus(spark, d).select(line.alias("value")).write.text(path)
    rows = S.read_tsv(spark, path, ["negative", "neutral", "positive"])
    return rows.groupBy(F.md5("text").alias("text_md5"), "label").agg(F.count(F.lit(1)).alias("n"))


@query("read_log", sql("log", """SELECT sid, seed_id, CAST(plan_id AS INTEGER) AS plan_id, target_lang, target_label, md5(text) AS text_md5, retry_count, outcome, sv_verdict, lv_verdict, prev_feedback, sentiment_label, lid_lang, lid_conf FROM log""", "lid_conf"))
def read_log(spark, d):
    path = scratch_path(spark, "log")
    G.append_log(outcome_log(spark, d), path)
    log = G.read_log(spark, f"{path}/*")
    return log.select("sid", "seed_id", "plan_id", "target_lang", "target_label", F.md5("text").alias("text_md5"), "retry_count", "outcome", "sv_verdict",
                      "lv_verdict", "prev_feedback", "sentiment_label", "lid_lang", "lid_conf")


@query("append_corpus", sql("log", "SELECT sid AS id, target_lang AS lang, target_label AS label, md5(text) AS text_md5 FROM log WHERE outcome = 'accepted'"))
def append_corpus(spark, d):
    path = scratch_path(spark, "corpus")
    accepted = outcome_log(spark, d).where("outcome = 'accepted'")
    for a in (0, 1, 2):
        S.append_corpus(accepted.where(F.col("retry_count") == a), path)
    return spark.read.parquet(path).select("id", "lang", "label", F.md5("text").alias("text_md5"))


@query("write_augmented", sql("corpus", """SELECT lang, '50' AS tag, count(*) AS n FROM (SELECT lang FROM corpus WHERE corpus = 'seed' UNION ALL SELECT lang FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, label ORDER BY md5(CAST(id AS VARCHAR) || '#42'), id) AS r, count(*) OVER (PARTITION BY lang, label) AS n FROM corpus WHERE corpus = 'syn')
  WHERE r <= round_even(n * CAST(0.5 AS DOUBLE), 0)) GROUP BY ALL"""))
def write_augmented(spark, d):
    path = scratch_path(spark, "augmented")
    c = corpus(spark, d)
    S.write_augmented(ratio_variant(c.where("corpus = 'seed'"), c.where("corpus = 'syn'"), 0.5), path, "50")
    return spark.read.parquet(path).groupBy("lang", F.col("tag").cast("string").alias("tag")).agg(F.count(F.lit(1)).alias("n"))


def _write_results(spark, d, path):
    r = C.results(predictions(spark, d))
    report = C.class_report(C.with_pred(predictions(spark, d)).where("split = 'test'"), ["model", "seed", "lang"])
    classes = report.groupBy(F.col("model").alias("config"), "seed", "lang").agg(F.map_from_entries(F.collect_list(F.struct(
        "label", F.struct("precision", "recall", "f1", "support")))).alias("per_class_test"))
    run = F.struct("train_f1", "val_f1", "test_f1", "train_accuracy", "val_accuracy", "test_accuracy", "per_class_test")
    whole = r.join(classes, ["config", "seed", "lang"]).groupBy("config", "seed").agg(
        F.map_from_entries(F.collect_list(F.struct("lang", run))).alias("results"))
    doc = F.to_json(F.struct(F.create_map(F.lit("seed"), F.col("seed").cast("string")).alias("hyperparams"), "results"))
    whole.select("config", "seed", doc.alias("value")).write.partitionBy("config", "seed").text(path)


@query("read_results", sql("res", "SELECT config, seed, lang, train_f1, val_f1, test_f1, gap FROM res", "train_f1 val_f1 test_f1 gap"))
def read_results(spark, d):
    path = scratch_path(spark, "results")
    _write_results(spark, d, path)
    return U.read_results(spark, [f"{path}/*/*", f"{path}/missing/*"]).select("config", "seed", "lang", "train_f1", "val_f1", "test_f1", "gap")


@query("read_class_results", sql("cls", """SELECT model AS config, seed, lang, label, CASE WHEN predicted + support = 0 THEN 0.0 ELSE 2.0 * tp / (predicted + support) END AS f1, support
  FROM cls WHERE split = 'test'""", "f1"))
def read_class_results(spark, d):
    path = scratch_path(spark, "results")
    _write_results(spark, d, path)
    return U.class_rows(U.read_results(spark, [f"{path}/*/*"])).select("config", "seed", "lang", "label", "f1", "support")


@query("read_history", sql("corpus", """WITH b AS (SELECT lang, batch_idx, CAST(sum(id) AS BIGINT) AS s, count(*) AS n FROM corpus GROUP BY ALL)
  SELECT lang, (row_number() OVER (PARTITION BY lang ORDER BY p) - 1) AS pos, kind, epoch, loss, eval_loss, eval_f1 FROM (
  SELECT lang, batch_idx * 2 AS p, 'train' AS kind, CAST(batch_idx % 7 AS DOUBLE) AS epoch, n / (batch_idx % 7 + 1.0) AS loss, NULL AS eval_loss, NULL AS eval_f1 FROM b
  UNION ALL SELECT lang, batch_idx * 2 + 1, 'eval', CAST(batch_idx % 7 AS DOUBLE), NULL, s % 97 / 97.0, s % 13 / 13.0 FROM b)""".replace("WITH b AS", "SELECT * FROM (WITH b AS") + ")",
  "epoch loss eval_loss eval_f1"))
def read_history(spark, d):
    path = scratch_path(spark, "history")
    h = history(spark, d).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("pos", "epoch", "loss", "eval_loss", "eval_f1"))).alias("r"))
    records = F.to_json(F.transform("r", lambda x: F.struct(x["epoch"].alias("epoch"), x["loss"].alias("loss"), x["eval_loss"].alias("eval_loss"), x["eval_f1"].alias("eval_f1"))))
    # French and German files keep one array per stage
    doc = F.when(F.col("lang").isin("fr", "de"), F.concat(F.lit('{"lp": [], "ft": '), records, F.lit("}"))).otherwise(records)
    h.select("lang", doc.alias("value")).write.partitionBy("lang").text(path)
    rows = U.read_history(spark, f"{path}/*")
    return rows.select(F.regexp_extract("path", r"lang=([^/]+)/", 1).alias("lang"), F.col("pos").cast("long").alias("pos"), "kind", "epoch", "loss", "eval_loss", "eval_f1")


@query("stored_predictions", sql("predictions", "SELECT model, split, seed, count(*) AS n, sum(z0) AS z0, sum(z1) AS z1, sum(z2) AS z2 FROM predictions GROUP BY ALL", "z0 z1 z2"))
def stored_predictions(spark, d):
    path = scratch_path(spark, "predictions")
    U.write_predictions(predictions(spark, d), path)
    p = U.read_predictions(spark, path)
    return p.groupBy("model", "split", "seed").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.element_at("logits", i + 1)).alias(f"z{i}") for i in range(3)])


@query("write_summary", sql("res", "SELECT config, lang, 100 * avg(test_f1) AS f1, count(*) AS n FROM res GROUP BY ALL", "f1"))
def write_summary(spark, d):
    path = scratch_path(spark, "summary")
    stats = R.seed_stats(C.results(predictions(spark, d)), ("test_f1",)).select("config", "lang", F.col("mean").alias("f1"), "n")
    U.write_summary(stats, path)
    return spark.read.schema(stats.schema).json(path)
