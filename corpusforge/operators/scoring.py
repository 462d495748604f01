"""Model stages: classifiers, language identifiers and text models called per Arrow batch."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import PARSE_RETRY
from ..functions.numeric import np_round, pct, py_round
from ..functions.text import lid_text, parse_lid
from ..session import join_on
from .ranking import top_k


def score_sentiment(rows: DataFrame, make_scorer: Callable[[], Callable], text: str = "text",
                    lang: str = "lang") -> DataFrame:
    """Adds sentiment_label (lower case) and sentiment_conf (4 decimals).

    ``make_scorer`` builds the scorer once per Python worker; the scorer takes the texts and
    languages of a batch as pandas series and returns labels and scores.
    """
    scorer = _cached(make_scorer)

    @F.pandas_udf("label string, score double")
    def score(texts: pd.Series, langs: pd.Series) -> pd.DataFrame:
        labels, scores = scorer()(texts, langs)
        return pd.DataFrame({"label": list(labels), "score": list(scores)})

    return rows.withColumn("_s", score(F.col(text), F.col(lang))).withColumns({
        "sentiment_label": F.lower("_s.label"), "sentiment_conf": py_round("_s.score", 4)}).drop("_s")


def identify_language(rows: DataFrame, make_scorer: Callable[[], Callable], k: int = 1, text: str = "text") -> DataFrame:
    """Adds ``lid``: up to k (label, score) pairs, best first, plus lid_lang and lid_conf of the best.

    The scorer takes a series of cleaned texts and k and returns, per text, a list of
    (label, score); a blank text has no labels.
    """
    scorer = _cached(make_scorer)
    pairs = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("score", T.DoubleType())]))

    @F.pandas_udf(pairs)
    def identify(texts: pd.Series) -> pd.Series:
        found = scorer()(texts, k)
        return pd.Series([[{"label": a, "score": float(b)} for a, b in x] if t else [] for t, x in zip(texts, found)])

    best = F.try_element_at("lid", F.lit(1))
    return rows.withColumn("lid", identify(lid_text(text))).withColumns({
        "lid_lang": parse_lid(best.getField("label")), "lid_conf": py_round(best.getField("score"), 4)})


_MODELS: dict[str, Callable] = {}


def _cached(make: Callable[[], Callable]) -> Callable[[], Callable]:
    """One model per Python worker and factory, whatever the number of tasks.

    The factory is told apart by its pickled form, taken on the driver; the worker keeps the model in this module.
    """
    key = hashlib.sha256(cloudpickle.dumps(make)).hexdigest()

    def get() -> Callable:
        return kept_model(key, make)

    return get


def kept_model(key: str, make: Callable[[], Callable]) -> Callable:
    """The model of this process under ``key``, built at first use."""
    if key not in _MODELS:
        _MODELS[key] = make()
    return _MODELS[key]


def is_json(answer: str) -> bool:
    """Whether an answer is a JSON object."""
    try:
        return isinstance(json.loads(answer), dict)
    except (TypeError, ValueError):
        return False


def call_model(requests: DataFrame, fn: Callable[[list[str]], list[str]],
               accept: Callable[[str], bool] = is_json, attempts: int = PARSE_RETRY + 1) -> DataFrame:
    """Requests with ``response``: the first acceptable answer in ``attempts`` tries, else null; ``error``: the last
    exception of a payload without one.

    ``fn`` maps the payloads of a batch to answers, one each (another number is an error of the job). When it raises, the payloads
    of that try are sent one by one, so one of them can't spoil the others; later tries send only the payloads still open.
    """
    requests = requests.drop("response", "error")
    schema = T.StructType(requests.schema.fields + [T.StructField(n, T.StringType()) for n in ("response", "error")])

    def ask(payloads: list[str]) -> list[tuple[str | None, str | None]]:
        try:
            got = list(fn(payloads))
        except Exception as e:
            if len(payloads) > 1:
                return [one for p in payloads for one in ask([p])]
            return [(None, f"{type(e).__name__}: {e}")]
        if len(got) != len(payloads):
            raise ValueError(f"{len(payloads)} payloads got {len(got)} answers")
        return [(a, None) for a in got]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            answers: list = [None] * len(pdf)
            errors: list = [None] * len(pdf)
            for _ in range(attempts):
                waiting = [i for i, a in enumerate(answers) if a is None]
                if not waiting:
                    break
                for i, (a, error) in zip(waiting, ask([pdf["payload"].iloc[i] for i in waiting])):
                    answers[i] = a if error is None and accept(a) else None
                    errors[i] = error
            yield pdf.assign(response=pd.Series(answers, index=pdf.index, dtype="object"),
                             error=pd.Series(errors, index=pdf.index, dtype="object"))

    return requests.mapInPandas(run, schema)


def recorded(responses: DataFrame, keys: list[str]) -> Callable[[DataFrame], DataFrame]:
    """A model stage that answers from a table of recorded responses."""
    return lambda requests: join_on(requests, responses.select(*keys, "response"), keys, "left")


def lid_report(scored: DataFrame, by: list[str], expected: str = "expected") -> DataFrame:
    """Top-1 and top-3 accuracy and mean confidence of language predictions in ``lid``."""
    labels = F.col("lid.label")
    hit1 = F.coalesce(F.try_element_at(labels, F.lit(1)) == F.col(expected), F.lit(False))
    hit3 = F.coalesce(F.array_contains(F.slice(labels, 1, 3), F.col(expected)), F.lit(False))
    conf = py_round(F.coalesce(F.try_element_at("lid", F.lit(1)).getField("score"), F.lit(0.0)), 4)
    return scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(hit1).alias("top1_correct"), F.count_if(hit3).alias("top3_correct"),
        F.avg(conf).alias("avg_confidence"),
    ).withColumns({
        "top1_accuracy": pct(F.col("top1_correct"), F.col("total")),
        "top3_accuracy": pct(F.col("top3_correct"), F.col("total"))})


def lid_by_lang(report: DataFrame) -> DataFrame:
    """Totals and mean accuracies over splits per model and language."""
    return report.groupBy("model", "lang").agg(
        F.sum("total").alias("total"), F.sum("top1_correct").alias("top1_correct"),
        F.avg(py_round("top1_accuracy", 2)).alias("top1_accuracy"),
        F.avg(py_round("top3_accuracy", 2)).alias("top3_accuracy"),
        F.avg(py_round("avg_confidence", 4)).alias("avg_confidence"))


def lid_compare(report: DataFrame, models: list[str], deltas: list[tuple[str, str]]) -> DataFrame:
    """Mean top-1 accuracy per language, one column per model, with differences of model pairs."""
    # two-decimal values: nine decimals free the mean of summation noise before it is rounded
    mean = lambda m: F.round(F.avg(F.when(F.col("model") == m, py_round("top1_accuracy", 2))), 9)
    wide = report.groupBy("lang").agg(*[np_round(mean(m), 2).alias(m) for m in models])
    return wide.withColumns({f"{a}_minus_{b}": np_round(F.round(F.col(a) - F.col(b), 9), 2) for a, b in deltas})


def lid_macro(report: DataFrame) -> DataFrame:
    return report.groupBy("model").agg(
        F.avg(py_round("top1_accuracy", 2)).alias("top1_accuracy"),
        F.avg(py_round("top3_accuracy", 2)).alias("top3_accuracy"),
        F.avg(py_round("avg_confidence", 4)).alias("avg_confidence"))


def top_confusions(wrong: DataFrame, by: list[str], predicted: str, k: int = 5) -> DataFrame:
    """Most frequent wrong predictions per group with their share of all wrong ones."""
    counts = wrong.groupBy(*by, predicted).agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy(*by).agg(F.sum("n").alias("wrong"))
    ranked = top_k(counts, by, [F.desc("n"), predicted], k, predicted)
    return join_on(ranked, total, by).withColumn("share", F.col("n") / F.col("wrong"))


def confidence_hist(scored: DataFrame, by: list[str], value: str, bins: int = 20) -> DataFrame:
    """Counts in equal-width bins between the smallest and largest value of each group."""
    edges = scored.groupBy(*by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    lo = F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo"))
    hi = F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi"))
    at = F.least(F.floor((F.col(value) - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("int")
    return join_on(scored, edges, by).groupBy(*by, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
