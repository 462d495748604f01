"""Vocabulary, diversity and BLEU metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bleu as B
from ..operators import vocabulary as V
from ..operators.sampling import sample_n, sample_to_size
from ..testbed import corpus
from .registry import query, sql

_GRAMS = {
    1: "unnest(t)", 2: "unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))",
    3: "unnest(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]))",
}


def _distinct_sql(n: int, by: str, view: str = "tok") -> str:
    return (f'SELECT {by}, count(DISTINCT g) AS "unique", count(*) AS total, count(DISTINCT g) * 1.0 / count(*) AS distinct_{n} '
            f"FROM (SELECT {by}, {_GRAMS[n]} AS g FROM {view}) GROUP BY ALL")


def _register_distinct(n: int) -> None:
    @query(f"distinct_{n}", sql("tok", _distinct_sql(n, "lang, corpus"), f"distinct_{n}"))
    def run(spark, d):
        return V.distinct_n(corpus(spark, d), n, ["lang", "corpus"])


for _n in (1, 2, 3):
    _register_distinct(_n)


@query("distinct_2_by_label", sql("tok", _distinct_sql(2, "corpus, label"), "distinct_2"))
def distinct_2_by_label(spark, d):
    return V.distinct_n(corpus(spark, d), 2, ["corpus", "label"])


_EQUAL = """(SELECT * FROM tok QUALIFY row_number() OVER (PARTITION BY corpus ORDER BY md5(CAST(id AS VARCHAR) || '#42'), id) <= 100)"""


@query("distinct_2_equal_size", sql("tok", _distinct_sql(2, "corpus", _EQUAL), "distinct_2"))
def distinct_2_equal_size(spark, d):
    return V.distinct_n(sample_n(corpus(spark, d), 100), 2, ["corpus"])


@query("distinct_rule", sql("tok", f"""SELECT *, ratio < 0.85 AS filter_useful FROM (
  SELECT lang, max(distinct_2) FILTER (corpus = 'seed') AS natural_d2, max(distinct_2) FILTER (corpus = 'syn') AS syn_d2,
  max(distinct_2) FILTER (corpus = 'syn') / max(distinct_2) FILTER (corpus = 'seed') AS ratio FROM ({_distinct_sql(2, 'lang, corpus')}) GROUP BY ALL)""",
  "natural_d2 syn_d2 ratio"))
def distinct_rule(spark, d):
    return V.distinct_rule(corpus(spark, d), ["lang"])


@query("ttr", sql("tok", "SELECT lang, corpus, count(DISTINCT g) AS types, count(*) AS tokens, count(DISTINCT g) * 1.0 / count(*) AS ttr "
                         "FROM (SELECT lang, corpus, unnest(t) AS g FROM tok) GROUP BY ALL", "ttr"))
def ttr(spark, d):
    return V.ttr(corpus(spark, d), ["lang", "corpus"])


@query("ttr_equal_size", sql("tok", """SELECT lang, count(DISTINCT g) AS types, count(*) AS tokens, count(DISTINCT g) * 1.0 / count(*) AS ttr FROM (
  SELECT lang, unnest(t) AS g FROM (SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY md5(CAST(s.id AS VARCHAR) || '#42'), s.id) AS r
    FROM tok s WHERE s.corpus = 'syn') JOIN (SELECT lang, count(*) AS n FROM corpus WHERE corpus = 'seed' GROUP BY ALL) USING (lang) WHERE r <= n) GROUP BY ALL""", "ttr"))
def ttr_equal_size(spark, d):
    c = corpus(spark, d)
    return V.ttr(sample_to_size(c.where("corpus = 'syn'"), c.where("corpus = 'seed'")), ["lang"])


@query("vocab_entropy", sql("tok", """SELECT lang, corpus, CAST(sum(n) AS BIGINT) AS total, -sum((n / s) * log2(n / s)) AS entropy FROM (
  SELECT lang, corpus, n, sum(n) OVER (PARTITION BY lang, corpus) AS s FROM (
    SELECT lang, corpus, g, CAST(count(*) AS DOUBLE) AS n FROM (SELECT lang, corpus, unnest(t) AS g FROM tok) GROUP BY ALL)) GROUP BY ALL""", "entropy"))
def vocab_entropy(spark, d):
    return V.vocab_entropy(corpus(spark, d), ["lang", "corpus"])


_PRESENCE = """(SELECT lang, token, bool_or(corpus = 'seed') AS a, bool_or(corpus = 'syn') AS b, bool_or(corpus = 'valid') AS v,
  bool_or(corpus = 'test') AS c FROM voc GROUP BY ALL)"""


@query("vocab_coverage", sql("voc", f"""SELECT *, base_covered * 1.0 / test_vocab AS base_coverage, aug_covered * 1.0 / test_vocab AS aug_coverage,
  100.0 * (aug_covered - base_covered) / test_vocab AS improvement_pp, syn_unused * 1.0 / syn_vocab AS unused_share FROM (
  SELECT lang, count(*) FILTER (c) AS test_vocab, count(*) FILTER (a) AS seed_vocab, count(*) FILTER (b) AS syn_vocab,
  count(*) FILTER (b AND NOT a) AS syn_new, count(*) FILTER (c AND a) AS base_covered, count(*) FILTER (c AND (a OR b)) AS aug_covered,
  count(*) FILTER (c AND b AND NOT a) AS newly_covered, count(*) FILTER (b AND NOT c AND NOT a) AS syn_unused,
  count(*) FILTER (b AND c) AS syn_in_test FROM {_PRESENCE} GROUP BY ALL)""", "base_coverage aug_coverage improvement_pp unused_share"))
def vocab_coverage(spark, d):
    return V.vocab_coverage(corpus(spark, d), ["lang"])


_FLAGS = {"seed": "a", "syn": "b", "valid": "v", "test": "c", "aug": "(a OR b)"}


@query("vocab_matrix", sql("voc", " UNION ALL ".join(
    f"SELECT lang, '{n}' AS corpus, count(*) FILTER ({f}) AS size, "
    + ", ".join(f"coalesce(100.0 * count(*) FILTER ({f} AND {g}) / nullif(count(*) FILTER ({f}), 0), 0) AS {m}" for m, g in _FLAGS.items())
    + f" FROM {_PRESENCE} GROUP BY lang" for n, f in _FLAGS.items()), "seed syn valid test aug"))
def vocab_matrix(spark, d):
    return V.vocab_matrix(corpus(spark, d), ["lang"])


@query("vocab_sets", sql("voc", """SELECT 'overlap' AS op, count(*) AS n, min(token) AS first, max(token) AS last FROM (
  SELECT token FROM voc WHERE corpus = 'syn' INTERSECT SELECT token FROM voc WHERE corpus = 'test')
  UNION ALL SELECT 'new', count(*), min(token), max(token) FROM (SELECT token FROM voc WHERE corpus = 'syn' EXCEPT SELECT token FROM voc WHERE corpus = 'seed')
  UNION ALL SELECT 'and', count(*), min(token), max(token) FROM (SELECT token FROM voc WHERE corpus = 'seed' INTERSECT SELECT token FROM voc WHERE corpus = 'valid')
  UNION ALL SELECT 'minus', count(*), min(token), max(token) FROM (SELECT token FROM voc WHERE corpus = 'test' EXCEPT SELECT token FROM voc WHERE corpus = 'syn')
  UNION ALL SELECT 'union', count(*), min(token), max(token) FROM (SELECT DISTINCT token FROM voc WHERE corpus IN ('seed', 'syn'))"""))
def vocab_sets(spark, d):
    c = corpus(spark, d)
    v = {x: V.vocabulary(c.where(f"corpus = '{x}'"), []) for x in ("seed", "syn", "valid", "test")}
    parts = {
        "overlap": V.vocab_overlap(v["syn"], v["test"]), "new": V.vocab_new(v["syn"], v["seed"]), "and": V.vocab_and(v["seed"], v["valid"]),
        "minus": V.vocab_minus(v["test"], v["syn"]), "union": V.vocab_union(v["seed"], v["syn"])}
    out = None
    for name, frame in parts.items():
        row = frame.agg(F.lit(name).alias("op"), F.count(F.lit(1)).alias("n"), F.min("token").alias("first"), F.max("token").alias("last"))
        out = row if out is None else out.unionByName(row)
    return out


_NEW = """(SELECT s.id, s.lang, count(k.token) AS n_new FROM (SELECT id, lang, unnest(CASE WHEN len(t) = 0 THEN [NULL] ELSE list_distinct(t) END) AS token
  FROM tok WHERE corpus = 'syn') s LEFT JOIN (SELECT lang, token FROM voc WHERE corpus = 'syn' EXCEPT SELECT lang, token FROM voc WHERE corpus = 'seed') k
  ON k.lang = s.lang AND k.token = s.token GROUP BY ALL)"""


@query("novelty", sql("tok voc", f"""SELECT lang, count(*) AS n, avg(n_new) AS mean, quantile_cont(n_new, 0.5) AS median, stddev_pop(n_new) AS std,
  min(n_new) AS min, max(n_new) AS max, """ + ", ".join(f"count(*) FILTER (n_new < {t}) AS below_{t}" for t in (0, 1, 2, 3, 5)) + f" FROM {_NEW} GROUP BY ALL",
  "mean median std"))
def novelty(spark, d):
    c = corpus(spark, d)
    return V.novelty(c.where("corpus = 'syn'"), V.vocabulary(c.where("corpus = 'seed'"), ["lang"]), ["lang"])


@query("min_novelty", sql("tok voc", f"SELECT id, lang, n_new FROM {_NEW} WHERE n_new >= 3"))
def min_novelty(spark, d):
    c = corpus(spark, d)
    known = V.vocabulary(c.where("corpus = 'seed'"), ["lang"])
    return V.min_novelty(c.where("corpus = 'syn'"), known, ["lang"], 3).select("id", "lang", "n_new")


@query("label_markers", sql("tok", """SELECT lang, token, arg_max(label, n) AS label, max(n) AS n, CAST(sum(n) AS BIGINT) AS total FROM (
  SELECT lang, token, label, count(*) AS n FROM (SELECT lang, label, unnest(list_distinct(t)) AS token FROM tok WHERE corpus = 'seed') GROUP BY ALL)
  GROUP BY lang, token HAVING sum(n) >= 2 AND max(n) * 1.0 / sum(n) >= 0.66"""))
def label_markers(spark, d):
    return V.label_markers(corpus(spark, d).where("corpus = 'seed'"), ["lang"])


def _bleu_sql(own: bool) -> str:
    """BLEU of synthetic texts; against each other when ``own``, else against the seeds."""
    pool = "syn" if own else "seed"
    grams = " UNION ALL ".join(
        f"SELECT id, lang, label, corpus, {n} AS n, unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) AS g FROM lwrd"
        for n in (1, 2, 3, 4))
    other = "AND r.id <> h.id" if own else ""
    if own:
        cap = """SELECT h.id, h.n, h.g, h.c, coalesce(max(CASE WHEN x.top_id = h.id THEN x.c2 ELSE x.c1 END), 0) AS cap FROM dg h
          JOIN (SELECT lang, label, n, g, arg_max(id, c) AS top_id, max(c) AS c1, coalesce(list_sort(list(c), 'DESC')[2], 0) AS c2
                FROM dg WHERE corpus = 'syn' GROUP BY ALL) x USING (lang, label, n, g) WHERE h.corpus = 'syn' GROUP BY ALL"""
    else:
        cap = """SELECT h.id, h.n, h.g, h.c, coalesce(max(x.c1), 0) AS cap FROM dg h
          LEFT JOIN (SELECT lang, label, n, g, max(c) AS c1 FROM dg WHERE corpus = 'seed' GROUP BY ALL) x USING (lang, label, n, g)
          WHERE h.corpus = 'syn' GROUP BY ALL"""
    return f"""SELECT lang, label, avg(bleu) AS {'self_bleu' if own else 'bleu_vs_ref'} FROM (
      SELECT l.lang, l.label, CASE WHEN coalesce(m.m1, 0) = 0 THEN 0.0 ELSE (CASE WHEN l.hl > l.rl THEN 1.0 ELSE exp(1 - l.rl * 1.0 / l.hl) END)
        * exp(0.25 * ({' + '.join(f"ln((CASE WHEN m.m{n} = 0 THEN 0.1 ELSE m.m{n} END) / greatest(1, l.hl - {n - 1}))" for n in (1, 2, 3, 4))})) END AS bleu
      FROM (SELECT h.id, h.lang, h.label, len(h.w) AS hl, (SELECT arg_min(len(r.w), abs(len(r.w) - len(h.w)) * 1000000 + len(r.w)) FROM lwrd r
              WHERE r.lang = h.lang AND r.label = h.label AND r.corpus = '{pool}' {other}) AS rl FROM lwrd h WHERE h.corpus = 'syn') l
      LEFT JOIN (SELECT id, {', '.join(f"CAST(coalesce(sum(least(c, cap)) FILTER (n = {n}), 0) AS DOUBLE) AS m{n}" for n in (1, 2, 3, 4))} FROM (
        WITH dg AS (SELECT id, lang, label, corpus, n, g, count(*) AS c FROM ({grams}) GROUP BY ALL) {cap}) GROUP BY id) m ON m.id = l.id) GROUP BY ALL"""


@query("self_bleu", sql("lwrd", _bleu_sql(True), "self_bleu"))
def self_bleu(spark, d):
    return B.self_bleu(corpus(spark, d).where("corpus = 'syn'"), ["lang", "label"])


@query("bleu_vs_seed", sql("lwrd", _bleu_sql(False), "bleu_vs_ref"))
def bleu_vs_seed(spark, d):
    c = corpus(spark, d)
    return B.bleu_vs_ref(c.where("corpus = 'syn'"), c.where("corpus = 'seed'"), ["lang", "label"])


@query("bleu_report", sql("lwrd", f"""SELECT lang, avg(self_bleu) AS macro_self_bleu, avg(bleu_vs_ref) AS macro_bleu_vs_seed, """ + ", ".join(
    f"max(self_bleu) FILTER (label = '{x}') AS {x[:3]}_self_bleu, max(bleu_vs_ref) FILTER (label = '{x}') AS {x[:3]}_bleu_seed" for x in ("negative", "neutral", "positive"))
    + f" FROM ({_bleu_sql(True)}) JOIN ({_bleu_sql(False)}) USING (lang, label) GROUP BY ALL",
    "macro_self_bleu macro_bleu_vs_seed neg_self_bleu neg_bleu_seed neu_self_bleu neu_bleu_seed pos_self_bleu pos_bleu_seed"))
def bleu_report(spark, d):
    return B.bleu_report(corpus(spark, d))
