"""The whole generation run: plan, generate, validate, collect, retry, deduplicate."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import LABELS, LANG_NAMES, MAX_RETRY
from ..operators import generation as g
from ..operators.lengths import length_profile
from ..operators.outcomes import split_pass
from ..operators.sampling import union_all
from ..operators.similarity import dedup_greedy
from ..session import materialize
from ..sources.logs import outcome_rows

Stage = Callable[[DataFrame], DataFrame]


@dataclass
class Models:
    """The pluggable stages. Each text model maps a request table to one with ``response``.

    Requests have a ``payload`` and a ``context`` (JSON). ``prompts`` are columns over a request, by kind: plan, write, retry, sentiment,
    language; ``names`` are the languages' names.
    """

    plan: Stage
    write: Stage
    judge_sentiment: Stage
    judge_language: Stage
    sentiment: Stage  # adds sentiment_label and sentiment_conf
    language: Stage  # adds lid_lang and lid_conf
    prompts: dict[str, Column] = field(default_factory=dict)
    names: dict[str, str] = field(default_factory=lambda: LANG_NAMES)

    def asked(self, kind: str, requests: DataFrame, context: DataFrame) -> DataFrame:
        return g.with_context(requests, context, self.prompts.get(kind))


def _targets(df: DataFrame) -> DataFrame:
    return df.withColumns({"target_lang": F.col("lang"), "target_label": F.col("label")})


def _twice(requests: DataFrame, model: Stage, valid: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Responses, asking once more for the requests whose first answer is unusable.

    ``valid`` maps responses to the request keys it accepts.
    """
    keys = [c for c in requests.columns if c not in ("payload", "context", "ask")]
    # only keys and answers are written: requests hold every text several times
    first = materialize(model(requests.withColumn("ask", F.lit(1))).select(*keys, "response"))
    good = valid(first).select(*keys)
    # an answer that never parsed is final: the model stage has used its own attempts on it
    again = materialize(first.where(F.col("response").isNotNull()).select(*keys).join(good, keys, "left_anti"))
    if not again.take(1):
        return first
    second = materialize(model(requests.join(again, keys, "left_semi").withColumn("ask", F.lit(2))).select(*keys, "response"))
    return first.join(again, keys, "left_anti").unionByName(second)


def plan_batches(seeds: DataFrame, models: Models, context: DataFrame | None = None) -> DataFrame:
    """Variation plans of all batches; ``context`` as of ``batch_context``, by default from the lengths of these seeds."""
    if context is None:
        seeds = materialize(seeds)
        context = g.batch_context(seeds, length_profile(seeds, ["lang", "label"]), models.names)
    answers = _twice(models.asked("plan", g.plan_requests(seeds), context), models.plan, lambda r: g.planned_batches(r, seeds))
    return materialize(g.flatten_plans(answers, seeds))


def validate(sentences: DataFrame, models: Models, context: DataFrame) -> DataFrame:
    """Sentiment verdicts for all sentences, language verdicts for those that pass; ``context`` as of ``seed_context``."""
    scored = materialize(g.group_by_seed(models.sentiment(sentences)))
    ask_sv = models.asked("sentiment", g.verdict_requests(scored, "sentiment_label", "sentiment_conf"), context)
    sv = _twice(ask_sv, models.judge_sentiment, lambda r: g.answered_groups(scored, r, "sv"))
    judged = materialize(g.apply_verdicts(scored, sv, "sv").drop("idx"))
    ok, other = split_pass(judged, "sv_verdict")
    named = materialize(g.group_by_seed(models.language(ok)))
    ask_lv = models.asked("language", g.verdict_requests(named, "lid_lang", "lid_conf"), context)
    lv = _twice(ask_lv, models.judge_language, lambda r: g.answered_groups(named, r, "lv"))
    done = g.apply_verdicts(named, lv, "lv").drop("idx")
    return union_all(done, other)


def run_rounds(seeds: DataFrame, models: Models, profile: DataFrame | None = None) -> dict[str, DataFrame]:
    """Accepted, discarded and retried sentences and failed batches of all batches of all languages.

    ``seeds`` is (lang, label, batch_idx, id, text); ``profile`` defaults to the lengths of these seeds.
    One pass per attempt, each over whole tables.
    """
    seeds = materialize(seeds)
    profile = materialize(length_profile(seeds, ["lang", "label"]) if profile is None else profile)
    batch = materialize(g.batch_context(seeds, profile, models.names))
    about = g.seed_context(seeds, models.names)
    plans = plan_batches(seeds, models, batch)
    answers = _twice(models.asked("write", g.sentence_requests(plans), batch), models.write, lambda r: g.written_batches(r, plans))
    current = materialize(g.first_sentences(answers, plans))
    accepted, discarded, retried, produced = [], [], [], []
    for attempt in range(MAX_RETRY + 1):
        produced.append(current.select(*g.BATCH, "sid"))
        routed = materialize(g.length_filter(g.route(validate(current, models, about)), seeds, profile))
        accepted.append(routed.where("route = 'accept'"))
        discarded.append(routed.where("route = 'discard'"))
        queue = routed.where("route = 'retry'").drop("route")
        retried.append(queue)
        if attempt == MAX_RETRY or not queue.take(1):
            break
        last = union_all(*produced).groupBy(*g.BATCH).agg(F.max("sid").alias("last"))
        requests = models.asked("retry", g.retry_requests(queue), batch)
        current = materialize(g.zip_retry(models.write(requests.withColumn("ask", F.lit(1))), queue, last))
    out = {n: _targets(union_all(*frames)).drop("route") for n, frames in
           (("accepted", accepted), ("discarded", discarded), ("retried", retried))}
    out["batch_failed"] = g.batch_failures(seeds, union_all(*[out[n].select(*g.BATCH) for n in ("accepted", "discarded", "retried")]))
    return out


ORDER = ["label_order", "batch_idx", "retry_count", "sid"]


def with_label_order(rows: DataFrame) -> DataFrame:
    names = F.array(*[F.lit(x) for x in LABELS])
    return rows.withColumn("label_order", F.array_position(names, F.col("label")))


def generation_log(seeds: DataFrame, models: Models) -> DataFrame:
    """Outcome log of a run, near-duplicates among the accepted sentences filtered per language."""
    out = run_rounds(seeds, models)
    judged = materialize(dedup_greedy(with_label_order(out["accepted"]), ORDER, ("lang",)).drop("label_order"))
    kept, filtered = judged.where("kept").drop("kept"), judged.where("NOT kept").drop("kept")
    rows = outcome_rows(kept, filtered, out["discarded"], out["retried"])
    return rows.unionByName(out["batch_failed"], allowMissingColumns=True)
