"""Data flow of the generate, validate, collect and retry loop over whole DataFrames.

Every stage handles all batches of all languages at once. A batch is a handful of
seeds, so windows and lists per batch or per seed group stay small. Batch and seed keys
are never null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import DEFAULT_STD, MAX_RETRY, SENTENCES_PER_SEED
from ..functions.numeric import py_round
from ..functions.rules import drift_message, feedback_or_default
from ..functions.text import word_count
from ..schemas import LANGUAGE_RESPONSE, PLAN_RESPONSE, SENTENCE_RESPONSE, SENTIMENT_RESPONSE

BATCH = ["lang", "label", "batch_idx"]
GROUP = BATCH + ["seed_id"]


# ---- requests ---------------------------------------------------------------------------

def _listed(items: Column, order: str) -> Column:
    """JSON list of structs ordered by their first field."""
    rows = F.sort_array(F.collect_list(F.struct(F.col(order), items.alias("item"))))
    return F.to_json(rows.getField("item"), {"ignoreNullFields": "false"})


def plan_requests(seeds: DataFrame, prompt: Column | None = None) -> DataFrame:
    """One request per batch listing its seeds."""
    item = F.struct(F.col("id"), F.col("text"), F.col("label"))
    out = seeds.groupBy(*BATCH).agg(_listed(item, "id").alias("payload"))
    return _with_prompt(out, prompt)


def sentence_requests(plans: DataFrame, prompt: Column | None = None) -> DataFrame:
    """One request per batch listing its variation plans."""
    item = F.struct("plan_id", "seed_id", "domain", "style", "sentiment_expression", "strategy", "preserve", "original_text")
    return _with_prompt(plans.groupBy(*BATCH).agg(_listed(item, "plan_id").alias("payload")), prompt)


def retry_requests(queue: DataFrame, prompt: Column | None = None) -> DataFrame:
    """One request per batch listing the rejected sentences with their feedback."""
    item = F.struct(
        F.col("seed_id"), F.col("plan_id"), F.col("domain"), F.col("style"), F.col("sentiment_expression"),
        F.col("strategy").alias("original_strategy"), F.col("preserve").alias("original_preserve"),
        F.col("text").alias("rejected_text"), F.col("prev_feedback").alias("feedback"))
    return _with_prompt(queue.groupBy(*BATCH).agg(_listed(item, "sid").alias("payload")), prompt)


def verdict_requests(indexed: DataFrame, label: str, conf: str, prompt: Column | None = None) -> DataFrame:
    """One request per seed group listing sentences with the model signal."""
    item = F.struct(F.col("idx"), F.col("text"), F.struct(F.col(label).alias("label"), F.col(conf).alias("confidence")).alias("signal"))
    return _with_prompt(indexed.groupBy(*GROUP).agg(_listed(item, "idx").alias("payload")), prompt)


def _language(names: dict[str, str]) -> Column:
    """Name of the language of a row, its code where it has none."""
    pairs = [F.lit(x) for pair in names.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("lang")), F.col("lang")) if pairs else F.col("lang")


def batch_context(seeds: DataFrame, profile: DataFrame, names: dict[str, str]) -> DataFrame:
    """What the requests of a batch are to know: language name, label, words per text of each label of the language, and the seeds with their lengths.

    ``profile`` has (lang, label, mean, std); both are given at one decimal. A batch and the labels of a language are short lists.
    """
    size = F.struct(py_round("mean", 1).alias("mean"), py_round("std", 1).alias("std"))
    lengths = profile.groupBy("lang").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("label"), size)))).alias("lengths"))
    item = F.struct(F.col("id"), word_count("text").alias("words"), F.col("text"))
    batches = seeds.groupBy(*BATCH).agg(F.sort_array(F.collect_list(item)).alias("seeds")).join(lengths, "lang", "left")
    return batches.select(*BATCH, F.struct(_language(names).alias("language"), F.col("label"), F.col("lengths"), F.col("seeds")).alias("context"))


def seed_context(seeds: DataFrame, names: dict[str, str]) -> DataFrame:
    """What the judges of a seed's sentences are to know: language code and name, target label and the text of the seed."""
    about = F.struct(F.col("lang"), _language(names).alias("language"), F.col("label"), F.col("text").alias("seed"))
    return seeds.select(*BATCH, F.col("id").alias("seed_id"), about.alias("context"))


def with_context(requests: DataFrame, context: DataFrame, prompt: Column | None = None) -> DataFrame:
    """Requests with their ``context`` as a JSON document; ``prompt`` may be made from it and stands before the payload."""
    keys = [c for c in context.columns if c != "context"]
    rows = requests.join(context, keys, "left").withColumn("context", F.to_json("context", {"ignoreNullFields": "false"}))
    return _with_prompt(rows, prompt)


def _with_prompt(requests: DataFrame, prompt: Column | None) -> DataFrame:
    """The prompt before the payload; a null prompt is an empty one."""
    return requests if prompt is None else requests.withColumn("payload", F.concat(F.coalesce(prompt, F.lit("")), F.col("payload")))


def group_by_seed(sentences: DataFrame) -> DataFrame:
    """Sentences with their zero-based position ``idx`` in the (batch, seed) group, in sid order."""
    return sentences.withColumn("idx", F.row_number().over(Window.partitionBy(*GROUP).orderBy("sid")) - 1)


# ---- responses --------------------------------------------------------------------------

def check_bijection(expected: DataFrame, returned: DataFrame, group: list[str], key: str) -> DataFrame:
    """(group, valid): whether the returned keys are exactly the expected ones, each once."""
    tagged = expected.select(*group, F.col(key).alias("k"), F.lit(1).alias("e"), F.lit(0).alias("r")).unionByName(
        returned.select(*group, F.col(key).alias("k"), F.lit(0).alias("e"), F.lit(1).alias("r")))
    counts = tagged.groupBy(*group, "k").agg(F.sum("e").alias("e"), F.sum("r").alias("r"))
    return counts.groupBy(*group).agg(F.every((F.col("e") == 1) & (F.col("r") == 1)).alias("valid"))


def _complete(field: str, x: Column) -> Column:
    """Whether an item of a response has every required field: five variations to a seed, a text to a sentence, a verdict to an evaluation."""
    has = lambda item, *names: reduce(lambda a, b: a & b, [item.getField(n).isNotNull() for n in names])
    if field == "seed_analyses":
        whole = F.forall(x["variations"], lambda v: has(v, "strategy", "preserve"))
        return has(x, "seed_id", "domain", "style", "sentiment_expression", "variations") & (F.size(x["variations"]) == SENTENCES_PER_SEED) & whole
    if field == "sentences":
        return has(x, "plan_id", "text")
    return has(x, "idx", "verdict") & F.upper(x["verdict"]).isin("PASS", "REJECT")


def parse(responses: DataFrame, schema, field: str) -> DataFrame:
    """Response text parsed into ``parsed``; null when it is no JSON of the expected shape or an item lacks a required field."""
    body = F.from_json("response", schema, {"mode": "PERMISSIVE"})
    rows = responses.withColumn("parsed", body.getField(field))
    good = F.forall("parsed", lambda x: F.coalesce(_complete(field, x), F.lit(False)))
    return rows.withColumn("parsed", F.when(good, F.col("parsed")))


def _answered(responses: DataFrame, schema, field: str, key: str, expected: DataFrame, group: list[str], *fields: Column) -> DataFrame:
    """Parsed responses with ``valid``, whether the answers of their group name exactly the expected keys, each once, and the expected rows ``due``.

    ``expected`` has (group, key); ``due`` holds its key and ``fields``. A response is parsed once and goes through the shuffle once; a group is
    a short list. Groups of which nothing was expected drop out.
    """
    due = expected.groupBy(*group).agg(F.collect_list(F.struct(key, *fields)).alias("due"))
    named = F.flatten(F.collect_list(F.col("parsed")[key]).over(Window.partitionBy(*group)))
    rows = parse(responses, schema, field).select(*group, "parsed").withColumn("named", named).join(due, group)
    return rows.withColumn("valid", _once(F.col("due")[key], F.col("named"))).drop("named")


def _once(expected: Column, returned: Column) -> Column:
    """Whether two lists hold the same values, each once."""
    return (F.sort_array(expected) == F.sort_array(returned)) & (F.size(F.array_distinct(expected)) == F.size(expected))


def _seed_answers(responses: DataFrame, seeds: DataFrame, *fields: Column) -> DataFrame:
    expected = seeds.select(*BATCH, F.col("id").alias("seed_id"), F.col("text"))
    return _answered(responses, PLAN_RESPONSE, "seed_analyses", "seed_id", expected, BATCH, *fields).where("valid")


def planned_batches(responses: DataFrame, seeds: DataFrame) -> DataFrame:
    """Batches whose response parses and names every seed once."""
    return _seed_answers(responses, seeds).select(*BATCH)


def flatten_plans(responses: DataFrame, seeds: DataFrame) -> DataFrame:
    """Variation plans of valid batches with plan_id counted over the batch in response order; every analysis has as many variations."""
    valid = _seed_answers(responses, seeds, F.col("text"))
    analyses = valid.select(*BATCH, "due", F.posexplode("parsed").alias("a_pos", "a"))
    own = F.get(F.filter("due", lambda x: x["seed_id"] == F.col("a.seed_id")), F.lit(0))["text"]
    plans = analyses.select(*BATCH, "a_pos", "a.*", F.coalesce(own, F.lit("")).alias("original_text"))
    plans = plans.select("*", F.posexplode("variations").alias("v_pos", "v"))
    number = (F.col("a_pos") * SENTENCES_PER_SEED + F.col("v_pos")).cast("int")
    return plans.select(*GROUP, "domain", "style", "sentiment_expression", "v.*", number.alias("plan_id"), "original_text")


PLAN_FIELDS = ["strategy", "preserve", "domain", "style", "sentiment_expression"]


def written_batches(responses: DataFrame, plans: DataFrame) -> DataFrame:
    """Batches whose response parses and names every plan once."""
    return _answered(responses, SENTENCE_RESPONSE, "sentences", "plan_id", plans, BATCH).where("valid").select(*BATCH)


def first_sentences(responses: DataFrame, plans: DataFrame) -> DataFrame:
    """Sentences of valid batches; seed and plan fields come from the plan, sids count in response order."""
    fields = [F.col(c) for c in ("seed_id", *PLAN_FIELDS)]
    valid = _answered(responses, SENTENCE_RESPONSE, "sentences", "plan_id", plans, BATCH, *fields).where("valid")
    returned = valid.select(*BATCH, "due", F.posexplode("parsed").alias("pos", "s"))
    own = F.get(F.filter("due", lambda x: x["plan_id"] == F.col("s.plan_id")), F.lit(0))
    rows = returned.select(*BATCH, F.col("pos").cast("long").alias("sid"), own.alias("plan"), F.col("s.text").alias("text"))
    return rows.select(
        *BATCH, "sid", "plan.seed_id", "plan.plan_id", *[f"plan.{c}" for c in PLAN_FIELDS], "text",
        F.lit(0).alias("retry_count"), F.lit(None).cast("string").alias("prev_feedback"))


def zip_retry(responses: DataFrame, queue: DataFrame, last_sid: DataFrame) -> DataFrame:
    """Retried sentences matched to the queue by position; surplus on either side is dropped.

    Sids go on after ``last_sid`` (batch, last), the last one used in the batch.
    """
    parsed = parse(responses, SENTENCE_RESPONSE, "sentences").where(F.col("parsed").isNotNull())
    returned = parsed.select(*BATCH, F.posexplode("parsed").alias("pos", "s")).select(*BATCH, "pos", F.col("s.text").alias("new_text"))
    order = Window.partitionBy(*BATCH).orderBy("sid")
    placed = queue.withColumn("pos", F.row_number().over(order) - 1)
    matched = placed.join(returned, BATCH + ["pos"]).join(last_sid, BATCH)
    return matched.select(
        *BATCH, (F.col("last") + 1 + F.col("pos")).cast("long").alias("sid"), "seed_id", "plan_id", *PLAN_FIELDS,
        F.col("new_text").alias("text"), (F.col("retry_count") + 1).alias("retry_count"), "prev_feedback")


def answered_groups(indexed: DataFrame, responses: DataFrame, kind: str) -> DataFrame:
    """Seed groups whose response parses and names every sentence once."""
    schema = SENTIMENT_RESPONSE if kind == "sv" else LANGUAGE_RESPONSE
    return _answered(responses, schema, "evaluations", "idx", indexed, GROUP).where("valid").select(*GROUP).distinct()


def apply_verdicts(indexed: DataFrame, responses: DataFrame, kind: str) -> DataFrame:
    """Verdict, explanation and feedback of each sentence; ``kind`` is sv or lv.

    A group without a parseable answer, or whose answer does not name every sentence once,
    fails as a whole. A response is parsed once, and sentences and responses meet in one join by group.
    """
    sentiment = kind == "sv"
    schema = SENTIMENT_RESPONSE if sentiment else LANGUAGE_RESPONSE
    group = Window.partitionBy(*GROUP)
    answers = parse(responses, schema, "evaluations").select(*GROUP, "parsed").withColumn("_all", F.flatten(F.collect_list("parsed").over(group)))
    rows = indexed.withColumn("_due", F.collect_list(F.struct("idx")).over(group)).join(answers, GROUP, "left")
    keyed = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in GROUP])
    rows = rows.withColumns({
        "_read": F.when(keyed, F.col("parsed").isNotNull()),
        "_valid": _once(F.col("_due")["idx"], F.coalesce(F.col("_all")["idx"], F.array().cast("array<int>"))),
        "_own": F.get(F.filter("_all", lambda e: e["idx"] == F.col("idx")), F.lit(0))})
    good = F.col("_read") & F.col("_valid")
    a, b = ("classifier_assessment", "semantic_analysis") if sentiment else ("naturalness", "issues")
    cot = F.format_string("Classifier: %s | Semantic: %s" if sentiment else "Naturalness: %s | Issues: %s",
                          F.coalesce(F.col("_own")[a], F.lit("None")), F.coalesce(F.col("_own")[b], F.lit("None")))
    verdict = F.upper(F.col("_own")["verdict"])
    feedback = (
        F.when(~F.col("_read"), f"{kind}_parse_failure").when(~F.col("_valid"), f"{kind}_bijection_failure")
        .when(good & (verdict == "REJECT"), F.col("_own")["reason"])
    )
    return rows.withColumns({
        f"{kind}_verdict": F.when(good, verdict).otherwise("VALIDATION_FAILED"),
        f"{kind}_cot": F.when(good, cot),
        f"{kind}_feedback": feedback,
    }).drop("parsed", "_all", "_due", "_read", "_valid", "_own")


# ---- collection -------------------------------------------------------------------------

def route(sentences: DataFrame) -> DataFrame:
    """``route`` per validated sentence: candidate, retry or discard; retries carry their feedback."""
    sv, lv = F.col("sv_verdict"), F.col("lv_verdict")
    failed = F.coalesce(sv == "VALIDATION_FAILED", F.lit(False)) | F.coalesce(lv == "VALIDATION_FAILED", F.lit(False))
    where = (
        F.when(failed, "discard")
        .when(F.coalesce(lv == "PASS", F.lit(False)), "candidate")
        .when(F.col("retry_count") >= MAX_RETRY, "discard")
        .otherwise("retry")
    )
    why = F.when(F.coalesce(sv == "REJECT", F.lit(False)), F.col("sv_feedback")).otherwise(F.col("lv_feedback"))
    return sentences.withColumn("route", where).withColumn(
        "prev_feedback", F.when(F.col("route") == "retry", feedback_or_default(why)).otherwise(F.col("prev_feedback")))


def with_seed(sentences: DataFrame, seeds: DataFrame) -> DataFrame:
    """Sentences with the words of their seed, null when the seed is unknown."""
    side = seeds.select("lang", F.col("id").alias("seed_id"), word_count("text").alias("seed_words"))
    return sentences.join(side, ["lang", "seed_id"], "left")


def with_plan(sentences: DataFrame, plans: DataFrame) -> DataFrame:
    """Sentences with the fields of their plan; the plan's seed wins over the response's."""
    fields = plans.select(*BATCH, "plan_id", "seed_id", *PLAN_FIELDS)
    return sentences.drop("seed_id", *PLAN_FIELDS).join(fields, BATCH + ["plan_id"])


def length_filter(routed: DataFrame, seeds: DataFrame, profile: DataFrame) -> DataFrame:
    """Routes candidates whose word count strays more than one label std from their seed.

    ``profile`` has (lang, label, std) of the whole seed corpus; the std is used at one
    decimal, 14.0 when missing. Candidates become accept, retry or discard.
    """
    limits = profile.select("lang", "label", py_round("std", 1).alias("_std"))
    rows = with_seed(routed, seeds).join(limits, ["lang", "label"], "left").withColumn(
        "gen_words", word_count("text"))
    limit = F.coalesce("_std", F.lit(DEFAULT_STD))
    drift = F.coalesce(F.abs(F.col("gen_words") - F.col("seed_words")) > limit, F.lit(False))
    candidate = F.col("route") == "candidate"
    final = (
        F.when(~candidate, F.col("route"))
        .when(~drift, "accept")
        .when(F.col("retry_count") >= MAX_RETRY, "discard")
        .otherwise("retry")
    )
    note = F.when(candidate & drift & (F.col("retry_count") < MAX_RETRY), drift_message("gen_words", "seed_words"))
    return rows.withColumn("prev_feedback", F.coalesce(note, F.col("prev_feedback"))).withColumn(
        "route", final).drop("_std", "gen_words", "seed_words")


def batch_failures(seeds: DataFrame, outputs: DataFrame, per_seed: int = SENTENCES_PER_SEED) -> DataFrame:
    """A batch_failed log row for each batch that left no sentence at all."""
    batches = seeds.groupBy(*BATCH).agg(F.sort_array(F.collect_list("id")).alias("seed_ids"))
    lost = batches.join(outputs.select(*BATCH).distinct(), BATCH, "left_anti")
    return lost.select(
        F.lit("batch_failed").alias("outcome"), F.col("lang").alias("target_lang"), F.col("label").alias("target_label"),
        "batch_idx", "seed_ids", (F.size("seed_ids") * per_seed).alias("expected_sentences"))
