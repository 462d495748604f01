"""Text functions over whole documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.numeric import argmax, softmax
from ..operators import lengths
from ..testbed import corpus, predictions, table
from .registry import SPACES, query, sql


@query("tokens_and_words", sql("tlen wlen", """SELECT a.id, a.lang, a.tc AS token_count, b.wc AS word_count,
  md5(array_to_string(a.t, ' ')) AS tokens_md5, md5(array_to_string(b.w, ' ')) AS words_md5
  FROM tlen a JOIN wlen b ON a.id = b.id"""))
def tokens_and_words(spark, d):
    c = lengths.drop_null_text(corpus(spark, d)).withColumns({"t": T.tokens("text"), "w": T.words("text")})
    return c.select("id", "lang", F.size("t").cast("long").alias("token_count"), F.size("w").cast("long").alias("word_count"),
                    F.md5(F.concat_ws(" ", "t")).alias("tokens_md5"), F.md5(F.concat_ws(" ", "w")).alias("words_md5"))


@query("bigram_sets", sql("bg", "SELECT id, len(g) AS n, md5(array_to_string(list_sort(g), '|')) AS grams_md5 FROM bg"))
def bigram_sets(spark, d):
    g = corpus(spark, d).select("id", T.bigram_set("text").alias("g"))
    return g.select("id", F.size("g").cast("long").alias("n"), F.md5(F.concat_ws("|", F.sort_array("g"))).alias("grams_md5"))


@query("token_ngrams", sql("tok", """SELECT lang, n, count(*) AS grams, count(DISTINCT g) AS distinct_grams FROM (
  SELECT lang, 1 AS n, unnest(t) AS g FROM tok UNION ALL
  SELECT lang, 2, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM tok UNION ALL
  SELECT lang, 3, unnest(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) FROM tok)
  GROUP BY ALL"""))
def token_ngrams(spark, d):
    # tokens are made once a row, n-grams leave it as 64-bit hashes
    grams = T.bind(T.tokens("text"), lambda t: F.array(*[
        F.struct(F.lit(n).alias("n"), F.transform(T.ngrams_of(t, n), lambda g: F.xxhash64(g)).alias("gs")) for n in (1, 2, 3)]))
    rows = corpus(spark, d).select("lang", F.explode(grams).alias("x")).select("lang", "x.n", F.explode("x.gs").alias("g"))
    counts = rows.groupBy("lang", "n", "g").agg(F.count(F.lit(1)).alias("c"))
    return counts.groupBy("lang", "n").agg(F.sum("c").alias("grams"), F.count(F.lit(1)).alias("distinct_grams"))


_NORM = "SELECT *, regexp_replace(lower(text), '[^0-9a-z]', '', 'g') AS h FROM corpus WHERE text IS NOT NULL"


@query("norm_and_trigrams", sql("corpus", f"""SELECT id, md5(h) AS norm_md5, len(g) AS trigrams,
  md5(array_to_string(list_sort(g), '|')) AS trigrams_md5 FROM (SELECT id, h,
    CASE WHEN length(h) >= 3 THEN list_distinct(list_transform(range(1, length(h) - 1), lambda i: substr(h, i, 3)))
         WHEN length(h) > 0 THEN [h] ELSE [] END AS g FROM ({_NORM}))"""))
def norm_and_trigrams(spark, d):
    c = corpus(spark, d).select("id", T.norm_hard("text").alias("h"))
    c = c.withColumn("g", T.char_trigrams_of(F.col("h")))
    return c.select("id", F.md5("h").alias("norm_md5"), F.size("g").cast("long").alias("trigrams"),
                    F.md5(F.concat_ws("|", F.sort_array("g"))).alias("trigrams_md5"))


#: Consecutive ids of a block; the first row of a block goes to the one before it too.
_BLOCK = 64


def _next_doc(spark, d, sets: dict):
    """Each document's sets next to those of every one with the following id: texts go through the shuffle once, and sets are made once a row, behind it."""
    block = F.floor(F.col("id") / _BLOCK).cast("long")
    c = corpus(spark, d).select("id", "text").where("id IS NOT NULL")
    c = c.withColumn("block", F.explode(F.when(F.pmod("id", F.lit(_BLOCK)) == 0, F.array(block, block - 1)).otherwise(F.array(block))))
    c = c.repartition("block").select("id", "block", F.struct(*[x.alias(n) for n, x in sets.items()]).alias("a"))
    after = Window.partitionBy("block").orderBy("id").rangeBetween(1, 1)
    rows = c.withColumn("b", F.collect_list("a").over(after)).where(F.col("block") == block)
    return rows.select("id", "a", F.explode("b").alias("b"))


@query("pair_similarities", sql("bg", f"""SELECT a.id,
  CASE WHEN len(a.g) = 0 OR len(b.g) = 0 THEN 0.0 ELSE len(list_intersect(a.g, b.g)) * 1.0
    / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))) END AS jaccard_bigram,
  len(list_intersect(x.g, y.g)) * 1.0 / greatest(1, len(x.g) + len(y.g) - len(list_intersect(x.g, y.g))) AS jaccard_trigram
  FROM bg a JOIN bg b ON b.id = a.id + 1
  JOIN (SELECT id, list_distinct(list_transform(range(1, length(h) - 1), lambda i: substr(h, i, 3))) AS g FROM ({_NORM})) x ON x.id = a.id
  JOIN (SELECT id, list_distinct(list_transform(range(1, length(h) - 1), lambda i: substr(h, i, 3))) AS g FROM ({_NORM})) y ON y.id = b.id
  """, "jaccard_bigram jaccard_trigram"))
def pair_similarities(spark, d):
    p = _next_doc(spark, d, {"g": T.bigram_set("text"), "t": T.char_trigrams("text")})
    common = F.size(F.array_intersect("a.t", "b.t"))
    return p.select("id", T.jaccard(F.col("a.g"), F.col("b.g")).alias("jaccard_bigram"),
                    (common / F.greatest(F.lit(1), F.size("a.t") + F.size("b.t") - common)).alias("jaccard_trigram"))


@query("benchmark_edit_ratio", sql("", """SELECT a.item_id, CASE WHEN greatest(length(a.h), length(b.h)) = 0 THEN 1.0
  ELSE 1 - levenshtein(a.h, b.h) * 1.0 / greatest(length(a.h), length(b.h)) END AS ratio
  FROM (SELECT item_id, regexp_replace(lower(text), '[^0-9a-z]', '', 'g') AS h FROM benchmark) a
  JOIN (SELECT item_id, regexp_replace(lower(text), '[^0-9a-z]', '', 'g') AS h FROM benchmark) b ON b.item_id = a.item_id + 1""", "ratio"))
def benchmark_edit_ratio(spark, d):
    b = table(spark, d, "benchmark").select("item_id", T.norm_hard("text").alias("h"))
    other = b.select((F.col("item_id") - 1).alias("item_id"), F.col("h").alias("o"))
    return b.join(other, "item_id").select("item_id", T.edit_ratio(F.col("h"), F.col("o")).alias("ratio"))


@query("text_fields", sql("corpus", f"""SELECT id,
  CASE WHEN length(text) > 80 THEN left(text, 80) || '...' ELSE text END AS preview, left(text, 120) AS reason,
  md5(regexp_replace(regexp_replace(text, chr(10), ' ', 'g'), '^{SPACES}|{SPACES}$', '', 'g')) AS lid_text_md5,
  lang AS lid_code, CASE lang WHEN 'de' THEN 'Javanese' WHEN 'en' THEN 'Sundanese' WHEN 'es' THEN 'Balinese' END AS lang_name,
  'Length drift: generated sentence (' || length(text) || ' words) deviates too far from seed length (' || id
  || ' words). Generate a sentence with elaboration depth closer to the seed''s character.' AS drift FROM corpus"""))
def text_fields(spark, d):
    from ..functions.rules import drift_message
    c = corpus(spark, d)
    label = F.concat(F.lit("__label__"), F.col("lang"), F.lit("_Latn"))
    # the tables' languages stand for codes that have names; fr for one that has none
    code = F.create_map(*[F.lit(x) for x in ("de", "jav", "en", "sun", "es", "ban", "fr", "xxx")])[F.col("lang")]
    return c.select("id", T.preview("text").alias("preview"), T.reason_prefix("text").alias("reason"),
                    F.md5(T.lid_text("text")).alias("lid_text_md5"), T.parse_lid(label).alias("lid_code"),
                    T.lang_name(code).alias("lang_name"),
                    drift_message(F.length("text"), F.col("id")).alias("drift"))


@query("softmax_argmax", sql("pred", """SELECT model, seed, lang, split, example_id, pred_label, conf, exp(z0 - m) / s AS p0, exp(z1 - m) / s AS p1, exp(z2 - m) / s AS p2
  FROM (SELECT *, greatest(z0, z1, z2) AS m, exp(z0 - greatest(z0, z1, z2)) + exp(z1 - greatest(z0, z1, z2)) + exp(z2 - greatest(z0, z1, z2)) AS s FROM pred)""",
  "conf p0 p1 p2"))
def softmax_argmax(spark, d):
    p = predictions(spark, d).withColumns({"p": softmax("logits"), "at": argmax("logits")})
    names = F.array(F.lit("negative"), F.lit("neutral"), F.lit("positive"))
    return p.select("model", "seed", "lang", "split", "example_id", F.element_at(names, F.col("at") + 1).alias("pred_label"),
                    F.array_max("p").alias("conf"), *[F.element_at("p", i + 1).alias(f"p{i}") for i in range(3)])


@query("length_buckets", sql("tlen", """SELECT lang, corpus, CAST(least(tc // 10, 5) AS INTEGER) AS bucket, count(*) AS n
  FROM tlen GROUP BY ALL"""))
def length_buckets(spark, d):
    return lengths.bucket_counts(corpus(spark, d), ["lang", "corpus"])
