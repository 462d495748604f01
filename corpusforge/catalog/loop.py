"""Stages of the generation loop, the whole loop, and incremental ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import LABELS
from ..functions.text import word_count
from ..operators import generation as G
from ..operators import lengths as L
from ..operators import scoring as M
from ..plans.generation import generation_log, plan_batches
from ..session import materialize, scratch_path
from ..streaming.ingest import ingest_stream, running_totals
from ..testbed import corpus, loop_models, outcome_log, plan_model, seed_batches, write_model
from .registry import query, sql

_BATCHED = "(SELECT lang, label, id, text, (row_number() OVER (PARTITION BY lang, label ORDER BY id) - 1) // 5 AS batch_idx FROM corpus WHERE corpus = 'seed')"
_PLANS = f"""(SELECT lang, label, batch_idx, seed_id, text, CAST((r - 1) * 5 + v AS INTEGER) AS plan_id, v FROM (
  SELECT lang, label, batch_idx, id AS seed_id, text, row_number() OVER (PARTITION BY lang, label, batch_idx ORDER BY id) AS r FROM {_BATCHED})
  CROSS JOIN (SELECT unnest(range(5)) AS v) WHERE batch_idx % 7 NOT IN (3, 5))"""


@query("plan_requests", sql("corpus", f"SELECT lang, label, batch_idx, count(*) AS seeds, min(id) AS first_id, CAST(sum(length(text)) AS BIGINT) AS chars FROM {_BATCHED} GROUP BY ALL"))
def plan_requests(spark, d):
    """Requests read back, so that the payload itself is compared."""
    r = G.plan_requests(seed_batches(spark, d)).withColumn("s", F.from_json("payload", "array<struct<id bigint, text string, label string>>"))
    chars = F.aggregate("s", F.lit(0), lambda a, x: a + F.length(x["text"]))
    return r.select("lang", "label", "batch_idx", F.size("s").cast("long").alias("seeds"), F.element_at("s", 1)["id"].alias("first_id"), chars.cast("long").alias("chars"))


@query("flatten_plans", sql("corpus", f"""SELECT lang, label, batch_idx, seed_id, plan_id, 'strategy ' || v AS strategy, 'keep ' || label AS preserve, 'domain ' || seed_id % 4 AS domain,
  'style ' || seed_id % 3 AS style, md5(text) AS seed_md5 FROM {_PLANS}"""))
def flatten_plans(spark, d):
    plans = plan_batches(seed_batches(spark, d), loop_models())
    return plans.select("lang", "label", "batch_idx", "seed_id", "plan_id", "strategy", "preserve", "domain", "style", F.md5("original_text").alias("seed_md5"))


def _plans(spark, d):
    return plan_batches(seed_batches(spark, d), loop_models())


_CUT = "list_slice(string_split(text, ' '), 1, greatest(1, len(string_split(text, ' ')) - plan_id * 7 % 40))"
_FIRST = f"""(SELECT lang, label, batch_idx, CAST(plan_id AS BIGINT) AS sid, seed_id, plan_id, 'keep ' || label AS preserve, array_to_string({_CUT}, ' ') || ' ' || plan_id AS text
  FROM {_PLANS} WHERE batch_idx % 11 NOT IN (4, 8))"""


@query("first_sentences", sql("corpus", f"SELECT lang, label, batch_idx, sid, seed_id, plan_id, preserve, md5(text) AS text_md5, 0 AS retry_count FROM {_FIRST}"))
def first_sentences(spark, d):
    plans = _plans(spark, d)
    answers = materialize(write_model(G.sentence_requests(plans).withColumn("ask", F.lit(1))))
    s = G.first_sentences(answers, plans)
    return s.select("lang", "label", "batch_idx", "sid", "seed_id", "plan_id", "preserve", F.md5("text").alias("text_md5"), "retry_count")


_NAMES = {"de": "German", "en": "English", "es": "Spanish", "fr": "French"}
_NAMED = "CASE lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _NAMES.items()) + " ELSE lang END"
_LABELLED = ", ".join(f"CAST(printf('%.1f', {f}(wc) FILTER (label = '{x}')) AS DOUBLE) AS {x}_{n}" for x in LABELS for f, n in (("avg", "mean"), ("stddev_samp", "std")))


def _prompt():
    """A prompt made from the context: language name and label."""
    return F.concat(F.get_json_object("context", "$.language"), F.lit(" "), F.get_json_object("context", "$.label"), F.lit(": "))


def _batch_sql(items: str) -> str:
    return sql("wlen", f"""SELECT lang, label, batch_idx, {_NAMED} || ' ' || label AS head, items, seeds, words, texts_md5, p.* EXCLUDE (lang) FROM (
      SELECT b.lang, b.label, b.batch_idx, count(*) AS seeds, CAST(coalesce(sum(wc), 0) AS BIGINT) AS words, md5(coalesce(string_agg(b.text, '|' ORDER BY b.id), '')) AS texts_md5
      FROM {_BATCHED} b LEFT JOIN (SELECT id, lang, wc FROM wlen WHERE corpus = 'seed') w ON w.id = b.id AND w.lang = b.lang GROUP BY ALL)
      JOIN (SELECT lang, label, batch_idx, count(*) AS items FROM {items} GROUP BY ALL) USING (lang, label, batch_idx)
      JOIN (SELECT lang, {_LABELLED} FROM wlen WHERE corpus = 'seed' GROUP BY lang) p USING (lang)""")


def _group_sql() -> str:
    return sql("corpus", f"""SELECT lang, label, batch_idx, seed_id, {_NAMED} || ' ' || label AS head, lang AS code, md5(s.text) AS seed_md5, items FROM (
      SELECT lang, label, batch_idx, seed_id, count(*) AS items FROM {_FIRST} GROUP BY ALL) JOIN (SELECT lang, label, batch_idx, id AS seed_id, text FROM {_BATCHED}) s USING (lang, label, batch_idx, seed_id)""")


def _read_back(asked):
    """The prompt and the number of items of a request."""
    head = F.substring_index("payload", ": [", 1)
    body = F.substr(F.col("payload"), F.length(head) + 3)
    return asked.withColumns({"head": head, "items": F.size(F.from_json(body, "array<struct<text string>>")).cast("long")})


def _batch_documents(spark, d, requests):
    seeds = seed_batches(spark, d)
    asked = _read_back(G.with_context(requests, G.batch_context(seeds, L.length_profile(seeds, ["lang", "label"]), _NAMES), _prompt()))
    shape = "lengths map<string, struct<mean double, std double>>, seeds array<struct<id bigint, words int, text string>>"
    got = asked.withColumn("c", F.from_json("context", shape))
    words = F.aggregate("c.seeds", F.lit(0), lambda a, x: a + F.coalesce(x["words"], F.lit(0)))
    sizes = [F.try_element_at("c.lengths", F.lit(x))[n].alias(f"{x}_{n}") for x in LABELS for n in ("mean", "std")]
    return got.select(*G.BATCH, "head", "items", F.size("c.seeds").cast("long").alias("seeds"), words.cast("long").alias("words"),
                      F.md5(F.concat_ws("|", F.transform("c.seeds", lambda x: x["text"]))).alias("texts_md5"), *sizes)


def _group_documents(spark, d, add, label, conf):
    seeds, plans = seed_batches(spark, d), _plans(spark, d)
    answers = materialize(write_model(G.sentence_requests(plans).withColumn("ask", F.lit(1))))
    indexed = G.group_by_seed(add(loop_models())(G.first_sentences(answers, plans)))
    asked = _read_back(G.with_context(G.verdict_requests(indexed, label, conf), G.seed_context(seeds, _NAMES), _prompt()))
    field = lambda n: F.get_json_object("context", f"$.{n}")
    return asked.select(*G.GROUP, "head", field("lang").alias("code"), F.md5(field("seed")).alias("seed_md5"), "items")


@query("context_plan", _batch_sql(_BATCHED))
def context_plan(spark, d):
    """Requests with their context, read back, so that prompt, payload and context are compared."""
    return _batch_documents(spark, d, G.plan_requests(seed_batches(spark, d)))


@query("context_write", _batch_sql(_PLANS))
def context_write(spark, d):
    return _batch_documents(spark, d, G.sentence_requests(_plans(spark, d)))


@query("context_retry", _batch_sql(_FIRST))
def context_retry(spark, d):
    """A queue of all first sentences."""
    plans = _plans(spark, d)
    answers = materialize(write_model(G.sentence_requests(plans).withColumn("ask", F.lit(1))))
    return _batch_documents(spark, d, G.retry_requests(G.first_sentences(answers, plans).withColumn("prev_feedback", F.lit("shorter"))))


@query("context_sentiment", _group_sql())
def context_sentiment(spark, d):
    return _group_documents(spark, d, lambda m: m.sentiment, "sentiment_label", "sentiment_conf")


@query("context_language", _group_sql())
def context_language(spark, d):
    return _group_documents(spark, d, lambda m: m.language, "lid_lang", "lid_conf")


@query("check_bijection", sql("corpus", f"SELECT lang, label, batch_idx, batch_idx % 7 NOT IN (3, 5, 6) AS valid FROM {_BATCHED} GROUP BY ALL"))
def check_bijection(spark, d):
    """First answers of the plan stage: broken JSON or a forgotten seed makes a batch invalid."""
    seeds = seed_batches(spark, d)
    answers = plan_model(G.plan_requests(seeds).withColumn("ask", F.lit(1)))
    parsed = G.parse(answers, G.PLAN_RESPONSE, "seed_analyses").where("parsed IS NOT NULL")
    returned = parsed.select(*G.BATCH, F.explode("parsed").alias("a")).select(*G.BATCH, F.col("a.seed_id").alias("id"))
    return G.check_bijection(seeds, returned, G.BATCH, "id")


def _attempts(spark, d):
    """Log rows as validated sentences with feedback columns."""
    log = outcome_log(spark, d).withColumnsRenamed({"target_lang": "lang", "target_label": "label"})
    fb = F.col("prev_feedback")
    return log.withColumns({"sv_feedback": fb, "lv_feedback": F.when(F.col("sid") % 5 == 0, F.lit(None)).otherwise(fb),
                            "sv_verdict": F.when(F.col("sid") % 23 == 0, "VALIDATION_FAILED").otherwise(F.col("sv_verdict"))})


_ATT = """(SELECT sid, seed_id, target_lang AS lang, target_label AS label, text, retry_count, prev_feedback, prev_feedback AS sv_feedback,
  CASE WHEN sid % 5 = 0 THEN NULL ELSE prev_feedback END AS lv_feedback, CASE WHEN sid % 23 = 0 THEN 'VALIDATION_FAILED' ELSE sv_verdict END AS sv_verdict, lv_verdict FROM log)"""
_ROUTE = f"""(SELECT * EXCLUDE (prev_feedback), CASE WHEN route = 'retry' THEN coalesce(nullif(CASE WHEN sv_verdict = 'REJECT' THEN sv_feedback ELSE lv_feedback END, ''), 'Rejected without specific feedback')
  ELSE prev_feedback END AS prev_feedback FROM (SELECT *, CASE WHEN sv_verdict = 'VALIDATION_FAILED' THEN 'discard' WHEN lv_verdict = 'PASS' THEN 'candidate' WHEN retry_count >= 2 THEN 'discard' ELSE 'retry' END AS route FROM {_ATT}))"""


@query("route", sql("log", f"SELECT sid, route, prev_feedback FROM {_ROUTE}"))
def route(spark, d):
    return G.route(_attempts(spark, d)).select("sid", "route", "prev_feedback")


_SEEDED = "(SELECT r.*, s.wc AS seed_words, len(w.w) AS gen_words, p.std FROM {src} r LEFT JOIN (SELECT id, lang, wc FROM wlen WHERE corpus = 'seed') s ON s.id = r.seed_id AND s.lang = r.lang JOIN wrd w ON w.id = r.sid // 3 LEFT JOIN (SELECT lang, label, round(stddev_samp(wc), 1) AS std FROM wlen WHERE corpus = 'seed' GROUP BY ALL) p ON p.lang = r.lang AND p.label = r.label)"


@query("length_filter", sql("log wlen wrd", f"""SELECT sid, CASE WHEN route <> 'candidate' THEN route WHEN NOT drift THEN 'accept' WHEN retry_count >= 2 THEN 'discard' ELSE 'retry' END AS route,
  CASE WHEN route = 'candidate' AND drift AND retry_count < 2 THEN 'Length drift: generated sentence (' || gen_words || ' words) deviates too far from seed length (' || seed_words
    || ' words). Generate a sentence with elaboration depth closer to the seed''s character.' ELSE prev_feedback END AS prev_feedback
  FROM (SELECT *, coalesce(abs(gen_words - seed_words) > coalesce(std, 14.0), false) AS drift FROM {_SEEDED.format(src=_ROUTE)})"""))
def length_filter(spark, d):
    c = corpus(spark, d).where("corpus = 'seed'")
    routed = G.route(_attempts(spark, d))
    return G.length_filter(routed, c, L.length_profile(c, ["lang", "label"])).select("sid", "route", "prev_feedback")


@query("with_seed", sql("log wlen", """SELECT l.sid, CAST(s.wc AS INTEGER) AS seed_words FROM log l LEFT JOIN wlen s ON s.corpus = 'seed' AND s.id = l.seed_id AND s.lang = l.target_lang"""))
def with_seed(spark, d):
    log = outcome_log(spark, d).withColumnRenamed("target_lang", "lang")
    return G.with_seed(log, corpus(spark, d).where("corpus = 'seed'")).select("sid", "seed_words")


@query("with_plan", sql("corpus", f"""SELECT lang, label, batch_idx, sid, seed_id, preserve FROM {_FIRST}"""))
def with_plan(spark, d):
    """Sentences that name a wrong seed get the plan's seed back."""
    plans = _plans(spark, d)
    answers = materialize(write_model(G.sentence_requests(plans).withColumn("ask", F.lit(1))))
    wrong = G.first_sentences(answers, plans).withColumns({"seed_id": F.lit(-1).cast("long"), "preserve": F.lit("?")})
    return G.with_plan(wrong, plans).select("lang", "label", "batch_idx", "sid", "seed_id", "preserve")


@query("zip_retry", sql("corpus", f"""SELECT lang, label, batch_idx, last + 1 + pos AS sid, seed_id, plan_id, md5(text || ' again') AS text_md5, 1 AS retry_count FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, label, batch_idx ORDER BY sid) - 1 AS pos, count(*) OVER (PARTITION BY lang, label, batch_idx) AS n FROM (
    SELECT *, max(sid) OVER (PARTITION BY lang, label, batch_idx) AS last FROM {_FIRST}) WHERE sid % 3 = 0) WHERE batch_idx % 11 <> 8 OR pos < n - 1"""))
def zip_retry(spark, d):
    """A queue of every third sentence; batch 8 of 11 answers one sentence short."""
    plans = _plans(spark, d)
    answers = materialize(write_model(G.sentence_requests(plans).withColumn("ask", F.lit(1))))
    first = materialize(G.first_sentences(answers, plans))
    queue = first.where("sid % 3 = 0")
    last = first.groupBy(*G.BATCH).agg(F.max("sid").alias("last"))
    retried = write_model(G.retry_requests(queue).withColumn("ask", F.lit(1)))
    return G.zip_retry(retried, queue, last).select("lang", "label", "batch_idx", "sid", "seed_id", "plan_id", F.md5("text").alias("text_md5"), "retry_count")


_IDX = f"(SELECT *, row_number() OVER (PARTITION BY lang, label, batch_idx, seed_id ORDER BY sid) - 1 AS idx FROM {_FIRST})"


@query("apply_verdicts", sql("corpus", f"""SELECT lang, label, batch_idx, sid, CASE WHEN seed_id % 31 IN (10, 20, 30) THEN 'VALIDATION_FAILED' WHEN length(text) % 9 = 0 THEN 'REJECT' ELSE 'PASS' END AS sv_verdict,
  CASE WHEN seed_id % 31 = 10 THEN 'sv_parse_failure' WHEN seed_id % 31 IN (20, 30) THEN 'sv_bijection_failure' WHEN length(text) % 9 = 0 THEN 'sv reason' END AS sv_feedback,
  CASE WHEN seed_id % 31 NOT IN (10, 20, 30) THEN 'Classifier: clear | Semantic: none' END AS sv_cot FROM {_IDX}"""))
def apply_verdicts(spark, d):
    """First answers only, so groups that recover on a second ask fail too."""
    plans = _plans(spark, d)
    answers = materialize(write_model(G.sentence_requests(plans).withColumn("ask", F.lit(1))))
    m = loop_models()
    indexed = materialize(G.group_by_seed(m.sentiment(G.first_sentences(answers, plans))))
    requests = G.verdict_requests(indexed, "sentiment_label", "sentiment_conf").withColumn("ask", F.lit(1))
    return G.apply_verdicts(indexed, m.judge_sentiment(requests), "sv").select("lang", "label", "batch_idx", "sid", "sv_verdict", "sv_feedback", "sv_cot")


@query("group_by_seed", sql("corpus", f"SELECT lang, label, batch_idx, seed_id, count(*) AS n, max(idx) AS last_idx FROM {_IDX} GROUP BY ALL"))
def group_by_seed(spark, d):
    plans = _plans(spark, d)
    answers = materialize(write_model(G.sentence_requests(plans).withColumn("ask", F.lit(1))))
    g = G.group_by_seed(G.first_sentences(answers, plans))
    return g.groupBy("lang", "label", "batch_idx", "seed_id").agg(F.count(F.lit(1)).alias("n"), F.max("idx").cast("long").alias("last_idx"))


@query("batch_failures", sql("corpus", f"""SELECT 'batch_failed' AS outcome, lang AS target_lang, label AS target_label, batch_idx, array_to_string(list_sort(list(id)), ',') AS seed_ids, count(*) * 5 AS expected_sentences
  FROM {_BATCHED} WHERE batch_idx % 7 IN (3, 5) OR batch_idx % 11 IN (4, 8) GROUP BY ALL"""))
def batch_failures(spark, d):
    seeds, plans = seed_batches(spark, d), _plans(spark, d)
    answers = materialize(write_model(G.sentence_requests(plans).withColumn("ask", F.lit(1))))
    lost = G.batch_failures(seeds, G.first_sentences(answers, plans))
    return lost.withColumns({"seed_ids": F.concat_ws(",", F.col("seed_ids").cast("array<string>")), "expected_sentences": F.col("expected_sentences").cast("long")})


@query("call_model", sql("corpus", f"SELECT lang, label, batch_idx, CAST(CASE WHEN batch_idx % 4 = 1 OR batch_idx % 8 = 3 THEN NULL ELSE sum(length(text)) END AS BIGINT) AS chars FROM {_BATCHED} GROUP BY lang, label, batch_idx"))
def call_model(spark, d):
    """A Python text model over batches of requests: some payloads need a second try, some never parse, some make it raise."""
    def answer(payloads):
        import json
        seen = answer.__dict__.setdefault("seen", {})
        out = []
        for p in payloads:
            batch, body = p.split(" ", 1)
            if int(batch) % 8 == 3:
                raise ConnectionError("refused")
            seen[p] = seen.get(p, 0) + 1
            bad = int(batch) % 4 == 1 or (int(batch) % 4 == 2 and seen[p] == 1)
            out.append("{broken" if bad else json.dumps({"chars": sum(len(s["text"]) for s in json.loads(body))}))
        return out

    requests = G.plan_requests(seed_batches(spark, d), F.concat(F.col("batch_idx").cast("string"), F.lit(" ")))
    got = M.call_model(requests, answer)
    return got.select("lang", "label", "batch_idx", F.get_json_object("response", "$.chars").cast("long").alias("chars"))


@query("recorded_model", sql("corpus", f"SELECT lang, label, batch_idx, CASE WHEN batch_idx % 3 = 0 THEN NULL ELSE 'answer ' || count(*) END AS response FROM {_BATCHED} GROUP BY lang, label, batch_idx"))
def recorded_model(spark, d):
    requests = G.plan_requests(seed_batches(spark, d))
    size = F.size(F.from_json("payload", "array<struct<id bigint>>"))
    table = requests.where("batch_idx % 3 <> 0").withColumn("response", F.concat(F.lit("answer "), size.cast("string"))).select(*G.BATCH, "response")
    return M.recorded(table, G.BATCH)(requests).select(*G.BATCH, "response")


@query("generation_log")
def whole_loop(spark, d):
    """All rounds of the loop over every batch; compared with a sequential copy in the tests."""
    log = generation_log(seed_batches(spark, d), loop_models())
    return log.select("target_lang", "target_label", "batch_idx", "sid", "seed_id", "plan_id", "retry_count", "outcome", "sv_verdict", "lv_verdict",
                      "prev_feedback", "expected_sentences", word_count("text").alias("words"))


# ---- streaming --------------------------------------------------------------------------

def _arrivals(spark, d, run):
    """The outcome log written in three parts of rising sid, each as many files; ``run`` gets the stream after every part and takes it as one batch."""
    path = scratch_path(spark, "arrivals")
    log = outcome_log(spark, d).withColumn("lang", F.col("target_lang")).select("lang", "sid", "text", "outcome", "retry_count")
    top = log.agg(F.max("sid")).first()[0]
    for i in range(3):
        part = log.where((F.col("sid") >= top * i // 3 + (1 if i else 0)) & (F.col("sid") <= top * (i + 1) // 3))
        part.write.mode("append").parquet(path)
        run(spark.readStream.schema(log.schema).parquet(path)).awaitTermination()


_ACC = "acc AS MATERIALIZED (SELECT b.id, b.lang, l.sid, b.g FROM bg b JOIN log l ON l.sid // 3 = b.id WHERE l.outcome = 'accepted')"


def _ingest_sql() -> str:
    pairs = """e AS MATERIALIZED (SELECT a AS early, b AS late FROM (SELECT x.sid AS a, y.sid AS b, x.n AS an, y.n AS bn, count(*) AS i FROM
      (SELECT sid, lang, len(g) AS n, unnest(g) AS q FROM acc) x JOIN (SELECT sid, lang, len(g) AS n, unnest(g) AS q FROM acc) y
      ON x.lang = y.lang AND x.q = y.q AND x.sid < y.sid GROUP BY ALL) WHERE i * 1.0 / (an + bn - i) >= 0.5)"""
    steps = ["d0 AS MATERIALIZED (SELECT CAST(NULL AS BIGINT) AS id WHERE false)"]
    for i in range(1, 25):
        p = f"d{i - 1}"
        steps.append(f"d{i} AS MATERIALIZED (SELECT id FROM {p} UNION SELECT late FROM e WHERE early NOT IN (SELECT id FROM {p}) AND early NOT IN (SELECT late FROM e WHERE early NOT IN (SELECT id FROM {p})))")
    return f"SELECT * FROM (WITH {_ACC}, {pairs}, {', '.join(steps)} SELECT l.lang, l.sid, CASE WHEN l.outcome = 'accepted' AND l.sid IN (SELECT id FROM d24) THEN 'dedup_filtered' ELSE l.outcome END AS outcome FROM (SELECT *, target_lang AS lang FROM log) l)"


@query("ingest_stream", sql("bg log", _ingest_sql()))
def ingest(spark, d):
    corpus_path, log_path, offsets = scratch_path(spark, "corpus"), scratch_path(spark, "log"), scratch_path(spark, "offsets")
    _arrivals(spark, d, lambda stream: ingest_stream(stream, corpus_path, log_path, offsets, ["sid"]))
    return spark.read.parquet(log_path).select("lang", "sid", "outcome")


@query("running_totals", sql("log", """SELECT target_lang AS lang, count(*) FILTER (outcome = 'accepted') AS accepted, count(*) FILTER (outcome = 'dedup_filtered') AS dedup_filtered,
  count(*) FILTER (outcome = 'discarded') AS discarded FROM log GROUP BY ALL"""))
def totals(spark, d):
    path, offsets = scratch_path(spark, "totals"), scratch_path(spark, "offsets")
    write = lambda batch, i: batch.write.mode("overwrite").parquet(path)
    _arrivals(spark, d, lambda stream: running_totals(stream).writeStream.outputMode("complete").foreachBatch(write).option(
        "checkpointLocation", offsets).trigger(availableNow=True).start())
    return spark.read.parquet(path)
