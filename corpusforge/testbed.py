"""Corpus, outcome-log and prediction views derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import spread

CORPUS_SQL = """
SELECT d.doc_id AS id, d.lang, d.text,
  CASE WHEN d.doc_id % 10 < 2 THEN 'seed' WHEN d.doc_id % 10 < 7 THEN 'syn'
       WHEN d.doc_id % 10 = 7 THEN 'valid' ELSE 'test' END AS corpus,
  CASE WHEN l.toxic = 1 THEN 'negative' WHEN l.quality = 1 THEN 'positive' WHEN l.quality = 0 THEN 'neutral'
       WHEN d.doc_id % 3 = 0 THEN 'negative' WHEN d.doc_id % 3 = 1 THEN 'neutral' ELSE 'positive' END AS label,
  CAST(floor(d.doc_id / 50) AS BIGINT) AS batch_idx
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
"""

LOG_SQL = """
SELECT c.id * 3 + a.attempt AS sid, c.id - c.id % 10 AS seed_id, c.id % 10 - 2 AS plan_id, c.batch_idx,
  c.lang AS target_lang, c.label AS target_label, c.text, a.attempt AS retry_count,
  CASE WHEN a.attempt < (c.id * 7919 + 13) % 1009 % 3 THEN 'retried'
       WHEN (c.id * 104729 + 7) % 997 % 10 = 0 THEN 'discarded'
       WHEN (c.id * 104729 + 7) % 997 % 10 = 1 THEN 'dedup_filtered' ELSE 'accepted' END AS outcome,
  CASE WHEN a.attempt < (c.id * 7919 + 13) % 1009 % 3 AND (c.id * 31 + a.attempt) % 3 = 0 THEN 'REJECT' ELSE 'PASS' END AS sv_verdict,
  CASE WHEN a.attempt < (c.id * 7919 + 13) % 1009 % 3 AND (c.id * 31 + a.attempt) % 3 = 0 THEN NULL
       WHEN a.attempt < (c.id * 7919 + 13) % 1009 % 3 AND (c.id * 31 + a.attempt) % 3 = 1 THEN 'REJECT' ELSE 'PASS' END AS lv_verdict,
  CASE WHEN a.attempt < (c.id * 7919 + 13) % 1009 % 3 AND (c.id * 31 + a.attempt) % 3 = 2 THEN 'Length drift: generated sentence'
       WHEN a.attempt < (c.id * 7919 + 13) % 1009 % 3 THEN 'reason ' || CAST(c.id % 4 AS VARCHAR(8)) ELSE NULL END AS prev_feedback,
  CASE WHEN c.id % 11 = 0 THEN 'neutral' ELSE c.label END AS sentiment_label,
  CASE WHEN c.id % 13 = 0 THEN 'en' ELSE c.lang END AS lid_lang,
  CAST((c.id * 17) % 101 AS DOUBLE) / 101 AS lid_conf
FROM corpus c CROSS JOIN (SELECT 0 AS attempt UNION ALL SELECT 1 UNION ALL SELECT 2) a
WHERE c.corpus = 'syn' AND a.attempt <= (c.id * 7919 + 13) % 1009 % 3
"""

PREDICTIONS_SQL = """
SELECT m.model, s.seed, c.lang, c.corpus AS split, c.id AS example_id, c.label AS true_label,
  CAST((c.id * (31 + m.k * 17) + s.seed * 101 + 53) % 997 AS DOUBLE) / 997
    + CASE WHEN c.label = 'negative' THEN 45e-2 + 1e-1 * m.k ELSE 0e0 END AS z0,
  CAST((c.id * (37 + m.k * 19) + s.seed * 103 + 59) % 991 AS DOUBLE) / 991
    + CASE WHEN c.label = 'neutral' THEN 45e-2 + 1e-1 * m.k ELSE 0e0 END AS z1,
  CAST((c.id * (41 + m.k * 23) + s.seed * 107 + 61) % 983 AS DOUBLE) / 983
    + CASE WHEN c.label = 'positive' THEN 45e-2 + 1e-1 * m.k ELSE 0e0 END AS z2
FROM corpus c
CROSS JOIN (SELECT 'base' AS model, 0 AS k UNION ALL SELECT 'aug', 1) m
CROSS JOIN (SELECT 0 AS seed UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 42) s
WHERE c.corpus IN ('seed', 'valid', 'test')
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(
        CORPUS_SQL.replace("FROM documents", "FROM {documents}").replace("JOIN labels", "JOIN {labels}"),
        documents=spread(table(spark, sf_dir, "documents"), "doc_id"), labels=table(spark, sf_dir, "labels"),
    )


def outcome_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(LOG_SQL.replace("FROM corpus", "FROM {corpus}"), corpus=corpus(spark, sf_dir))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.sql(PREDICTIONS_SQL.replace("FROM corpus", "FROM {corpus}"), corpus=corpus(spark, sf_dir))
    return df.withColumn("logits", F.array("z0", "z1", "z2")).drop("z0", "z1", "z2")


def seed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds in batches of five: (lang, label, batch_idx, id, text)."""
    from .operators.sampling import assign_batches

    seeds = corpus(spark, sf_dir).where("corpus = 'seed'").drop("batch_idx")
    return assign_batches(seeds).select("lang", "label", "batch_idx", "id", "text")


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training records per language: a train and an evaluation record for each fifty documents."""
    batches = corpus(spark, sf_dir).groupBy("lang", "batch_idx").agg(F.sum("id").alias("s"), F.count(F.lit(1)).alias("n"))
    epoch = (F.col("batch_idx") % 7).cast("double")
    nothing = F.lit(None).cast("double")
    train = F.struct((F.col("batch_idx") * 2).alias("pos"), epoch.alias("epoch"), (F.col("n") / (epoch + 1)).alias("loss"),
                     nothing.alias("eval_loss"), nothing.alias("eval_f1"))
    evals = F.struct((F.col("batch_idx") * 2 + 1).alias("pos"), epoch.alias("epoch"), nothing.alias("loss"),
                     (F.col("s") % 97 / 97).alias("eval_loss"), (F.col("s") % 13 / 13).alias("eval_f1"))
    return batches.select("lang", F.explode(F.array(train, evals)).alias("r")).select("lang", "r.*")


# ---- stand-ins for the text models, written as native expressions over the request payload ----

def _broken(body, cut, short):
    """A response that is cut off where ``cut`` holds and complete elsewhere; ``short`` is the shortened one."""
    whole, less = body
    return F.when(cut, F.left(whole, F.lit(40))).when(short, less).otherwise(whole)


def plan_model(requests: DataFrame) -> DataFrame:
    """Five plans per seed; some batches answer with broken JSON or forget a seed."""
    seeds = F.from_json("payload", "array<struct<id bigint, text string, label string>>")
    variation = lambda s, v: F.struct(
        F.concat(F.lit("strategy "), F.lit(v)).alias("strategy"), F.concat(F.lit("keep "), s["label"]).alias("preserve"))
    analysis = lambda s: F.struct(
        s["id"].alias("seed_id"), F.concat(F.lit("domain "), (s["id"] % 4).cast("string")).alias("domain"),
        F.concat(F.lit("style "), (s["id"] % 3).cast("string")).alias("style"), F.lit("direct").alias("sentiment_expression"),
        F.array(*[variation(s, v) for v in range(5)]).alias("variations"))
    wrap = lambda items: F.to_json(F.struct(items.alias("seed_analyses")))
    rows = requests.withColumn("_s", seeds)
    full = F.transform("_s", analysis)
    some = F.transform(F.slice("_s", F.lit(1), F.size("_s") - 1), analysis)
    i = F.col("batch_idx") % 7
    # batch 3 of 7 never parses, batch 5 forgets a seed always, batch 6 only when first asked
    return rows.withColumn("response", _broken((wrap(full), wrap(some)), i == 3, (i == 5) | ((i == 6) & (F.col("ask") == 1)))).drop("_s")


def write_model(requests: DataFrame) -> DataFrame:
    """One sentence per plan, a leading part of its seed text; a retry gives the rejected text one word more."""
    item = "struct<seed_id bigint, plan_id int, original_text string, rejected_text string>"
    rows = requests.withColumn("_p", F.from_json("payload", f"array<{item}>"))
    words = lambda p: F.split(p["original_text"], " ")
    first = lambda p: F.array_join(F.slice(words(p), F.lit(1), F.greatest(F.lit(1), F.size(words(p)) - p["plan_id"] * 7 % 40)), " ")
    text = lambda p: F.when(p["rejected_text"].isNotNull(), F.concat(p["rejected_text"], F.lit(" again"))).otherwise(
        F.concat(first(p), F.lit(" "), p["plan_id"].cast("string")))
    out = lambda items: F.to_json(F.struct(F.transform(items, lambda p: F.struct(
        p["seed_id"].alias("seed_id"), p["plan_id"].alias("plan_id"), text(p).alias("text"))).alias("sentences")))
    less = F.slice("_p", F.lit(1), F.size("_p") - 1)
    i = F.col("batch_idx") % 11
    return rows.withColumn("response", _broken((out(F.col("_p")), out(less)), i == 4, i == 8)).drop("_p")


def judge_model(kind: str):
    """Verdicts by text length; some seed groups answer with broken JSON or forget a sentence."""
    m = 9 if kind == "sv" else 7
    extra = ("classifier_assessment", "semantic_analysis") if kind == "sv" else ("naturalness", "issues")

    def model(requests: DataFrame) -> DataFrame:
        rows = requests.withColumn("_e", F.from_json("payload", "array<struct<idx int, text string>>"))
        no = lambda e: F.length(e["text"]) % m == 0
        one = lambda e: F.struct(
            e["idx"].alias("idx"), F.lit("clear").alias(extra[0]), F.lit("none").alias(extra[1]),
            F.when(no(e), "reject").otherwise("pass").alias("verdict"), F.when(no(e), F.lit(f"{kind} reason")).alias("reason"))
        out = lambda items: F.to_json(F.struct(F.transform(items, one).alias("evaluations")))
        less = F.slice("_e", F.lit(1), F.size("_e") - 1)
        i = F.col("seed_id") % 31
        return rows.withColumn("response", _broken((out(F.col("_e")), out(less)), i == 10, (i == 20) | ((i == 30) & (F.col("ask") == 1)))).drop("_e")

    return model


def loop_models():
    """Stand-ins for all stages of the generation loop."""
    from .plans.generation import Models

    return Models(
        plan=plan_model, write=write_model, judge_sentiment=judge_model("sv"), judge_language=judge_model("lv"),
        sentiment=lambda s: s.withColumns({"sentiment_label": F.col("label"), "sentiment_conf": F.lit(0.9)}),
        language=lambda s: s.withColumns({"lid_lang": F.col("lang"), "lid_conf": F.lit(0.8)}),
    )


def letter_sentiment():
    """Scorer: the most frequent of the letters a, e and o decides."""
    import pandas as pd

    def score(texts: pd.Series, langs: pd.Series):
        counts = pd.DataFrame({"NEGATIVE": texts.str.count("a"), "NEUTRAL": texts.str.count("e"), "POSITIVE": texts.str.count("o")})
        total = counts.sum(axis=1)
        return counts.idxmax(axis=1), (counts.max(axis=1) / total.where(total > 0, 1)).astype("float64")

    return score


def marker_language(markers: dict[str, str]):
    """Scorer factory: languages ranked by how often their marker string occurs."""

    def make():
        def score(texts, k: int):
            out = []
            for t in texts:
                counts = {lang: t.count(m) + 1 for lang, m in markers.items()}
                total = sum(counts.values())
                ranked = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:k]
                out.append([(f"__label__{lang}_Latn", n / total) for lang, n in ranked])
            return out

        return score

    return make
