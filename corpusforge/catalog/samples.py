"""Sampling, mixing, ids and batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import RATIOS
from ..operators import sampling as S
from ..testbed import corpus
from .registry import query, sql


def _draw(part: str, seed: str = "42") -> str:
    return f"row_number() OVER (PARTITION BY {part} ORDER BY md5(CAST(id AS VARCHAR) || '#{seed}'), id)"


def _of(spark, d, name):
    return corpus(spark, d).where(f"corpus = '{name}'")


@query("sample_seeds", sql("corpus", f"""SELECT id, lang, label FROM (SELECT *, {_draw('lang, label')} AS r, count(*) OVER (PARTITION BY lang, label) AS n
  FROM corpus WHERE corpus = 'seed') WHERE r <= greatest(1, CAST(floor(n * 0.1) AS BIGINT))"""))
def sample_seeds(spark, d):
    return S.sample_seeds(_of(spark, d, "seed"), 0.1).select("id", "lang", "label")


@query("sample_n", sql("corpus", f"SELECT id, lang, corpus FROM corpus QUALIFY {_draw('corpus')} <= 50"))
def sample_n(spark, d):
    return S.sample_n(corpus(spark, d), 50).select("id", "lang", "corpus")


_THIN = """SELECT * FROM (SELECT *, """ + _draw("lang, label") + """ AS r, count(*) OVER (PARTITION BY lang, label) AS n FROM corpus WHERE corpus = 'syn')
  WHERE r <= round_even(n * CAST({f} AS DOUBLE), 0)"""


def _variant_sql() -> str:
    parts = []
    for tag, f in RATIOS.items():
        parts.append(f"""SELECT '{tag}' AS tag, id, lang, label, corpus FROM corpus WHERE corpus = 'seed' UNION ALL
          SELECT '{tag}', coalesce(m, -1) + row_number() OVER (PARTITION BY lang ORDER BY label, md5(CAST(id AS VARCHAR) || '#42'), id), lang, label, corpus
          FROM ({_THIN.format(f=f)}) LEFT JOIN (SELECT lang, max(id) AS m FROM corpus WHERE corpus = 'seed' GROUP BY ALL) USING (lang)""")
    return " UNION ALL ".join(parts)


@query("ratio_variants", sql("corpus", _variant_sql()))
def ratio_variants(spark, d):
    seed, syn = _of(spark, d, "seed"), _of(spark, d, "syn")
    out = None
    for tag, frac in RATIOS.items():
        v = S.ratio_variant(seed, syn, frac).select(F.lit(tag).alias("tag"), "id", "lang", "label", "corpus")
        out = v if out is None else out.unionByName(v)
    return out


@query("continue_ids", sql("corpus", """SELECT coalesce(m, -1) + row_number() OVER (PARTITION BY lang ORDER BY label, md5(CAST(id AS VARCHAR) || '#42'), id) AS id,
  lang, label, md5(text) AS text_md5 FROM corpus LEFT JOIN (SELECT lang, max(id) AS m FROM corpus WHERE corpus = 'seed' GROUP BY ALL) USING (lang) WHERE corpus = 'syn'"""))
def continue_ids(spark, d):
    return S.continue_ids(_of(spark, d, "seed"), _of(spark, d, "syn")).select("id", "lang", "label", F.md5("text").alias("text_md5"))


_DIST = """SELECT lang, label, bucket, n * 1.0 / sum(n) OVER (PARTITION BY lang, label) AS share FROM (
  SELECT lang, label, CAST(least(tc // 10, 5) AS INTEGER) AS bucket, count(*) AS n FROM tlen WHERE corpus = 'test' GROUP BY ALL)"""


@query("target_dist", sql("tlen", _DIST, "share"))
def target_dist(spark, d):
    return S.target_dist(_of(spark, d, "test"), ["lang", "label"])


_QUOTA = f"""SELECT lang, label, bucket, CAST(floor(share * total) AS BIGINT) AS quota FROM ({_DIST}) JOIN (
  SELECT lang, CAST(floor(avg(n)) AS BIGINT) AS total FROM (SELECT lang, label, count(*) AS n FROM corpus WHERE corpus = 'syn' GROUP BY ALL) GROUP BY ALL) USING (lang)
  WHERE floor(share * total) > 0"""
_SYN = "(SELECT *, CAST(least(tc // 10, 5) AS INTEGER) AS bucket FROM tlen WHERE corpus = 'syn')"


@query("stratified_sample", sql("tlen", f"SELECT id, lang, label FROM (SELECT *, {_draw('lang, label, bucket')} AS r FROM {_SYN}) JOIN ({_QUOTA}) USING (lang, label, bucket) WHERE r <= quota"))
def stratified_sample(spark, d):
    picked, _ = S.stratified_sample(_of(spark, d, "syn"), S.target_dist(_of(spark, d, "test"), ["lang", "label"]))
    return picked.select("id", "lang", "label")


@query("stratified_shortfall", sql("tlen", f"""SELECT lang, label, bucket, quota, coalesce(n, 0) AS available, quota - coalesce(n, 0) AS shortfall FROM ({_QUOTA})
  LEFT JOIN (SELECT lang, label, bucket, count(*) AS n FROM {_SYN} GROUP BY ALL) USING (lang, label, bucket) WHERE quota > coalesce(n, 0)"""))
def stratified_shortfall(spark, d):
    return S.stratified_sample(_of(spark, d, "syn"), S.target_dist(_of(spark, d, "test"), ["lang", "label"]))[1]


@query("augment_stratified", sql("tlen", f"""SELECT lang, corpus, label, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM (
  SELECT id, lang, corpus, label FROM corpus WHERE corpus = 'seed' UNION ALL
  SELECT id, lang, corpus, label FROM (SELECT *, {_draw('lang, label, bucket')} AS r FROM {_SYN}) JOIN ({_QUOTA}) USING (lang, label, bucket) WHERE r <= quota) GROUP BY ALL"""))
def augment_stratified(spark, d):
    picked, _ = S.stratified_sample(_of(spark, d, "syn"), S.target_dist(_of(spark, d, "test"), ["lang", "label"]))
    both = S.augment(_of(spark, d, "seed"), picked)
    return both.groupBy("lang", "corpus", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


@query("pool", sql("corpus", "SELECT id, lang, corpus, label FROM corpus WHERE lang IN ('de', 'en', 'fr') AND corpus IN ('seed', 'valid')"))
def pool(spark, d):
    return S.pool(corpus(spark, d), ["de", "en", "fr"]).select("id", "lang", "corpus", "label")


@query("spot_check", sql("corpus", f"SELECT id, lang, label, md5(text) AS text_md5 FROM corpus WHERE corpus = 'syn' QUALIFY {_draw('lang, label')} <= 5"))
def spot_check(spark, d):
    return S.spot_check(_of(spark, d, "syn")).select("id", "lang", "label", F.md5("text").alias("text_md5"))


@query("assign_batches", sql("corpus", """SELECT id, lang, label, (row_number() OVER (PARTITION BY lang, label ORDER BY id) - 1) // 5 AS batch_idx
  FROM corpus WHERE corpus = 'seed'"""))
def assign_batches(spark, d):
    return S.assign_batches(_of(spark, d, "seed")).select("id", "lang", "label", "batch_idx")


@query("union_all", sql("corpus", "SELECT corpus, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids, count(*) FILTER (corpus = 'syn') AS extra FROM corpus WHERE corpus IN ('seed', 'syn', 'valid') GROUP BY ALL"))
def union_all(spark, d):
    parts = [_of(spark, d, "seed"), _of(spark, d, "syn").withColumn("mark", F.lit(1)), _of(spark, d, "valid")]
    return S.union_all(*parts).groupBy("corpus").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"), F.count("mark").alias("extra"))
