"""Text classifiers per language or pooled, and resumable sweeps over settings and seeds."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor, as_completed
from functools import reduce
from itertools import product

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, IDF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import LABELS
from ..functions.text import tokens
from ..session import materialize
from .classification import results
from .runs import pending_units

DEFAULTS = {"features": 1 << 15, "reg": 0.01, "elastic": 0.0, "iterations": 50}


#: Models that are fitted at the same time; every fit is a series of short jobs.
AT_ONCE = 8


def with_target(corpus: DataFrame, labels: list[str] = LABELS) -> DataFrame:
    names = F.array(*[F.lit(x) for x in labels])
    return corpus.where(F.col("text").isNotNull()).withColumns({
        "tokens": tokens("text"), "target": (F.array_position(names, F.col("label")) - 1).cast("double")})


def featured(corpus: DataFrame, features: int, train_on: tuple[str, ...], held: tuple[str, ...]) -> DataFrame:
    """Written rows with TF-IDF ``features``, document frequencies counted on the training splits: made once for all settings and seeds."""
    counted = with_target(corpus.where(F.col("corpus").isin(*train_on, *held)))
    counted = materialize(HashingTF(inputCol="tokens", outputCol="tf", numFeatures=features).transform(counted).drop("tokens", "text"))
    idf = IDF(inputCol="tf", outputCol="features").fit(counted.where(F.col("corpus").isin(*train_on)))
    return materialize(idf.transform(counted).drop("tf"))


def fit(rows: DataFrame, seed: int, params: dict, train_on: tuple[str, ...]) -> LogisticRegressionModel:
    """Multinomial logistic regression, fitted by distributed passes over the training rows of a seed."""
    train = rows.where(F.col("corpus").isin(*train_on)).withColumn("weight", draw_weight(seed))
    return LogisticRegression(
        labelCol="target", featuresCol="features", weightCol="weight", family="multinomial", maxIter=params["iterations"], regParam=params["reg"],
        elasticNetParam=params["elastic"], rawPredictionCol="raw").fit(train)


def draw_weight(seed: int) -> Column:
    """Weight of a training row for a seed: 1 or 2 by a hash draw, so that runs of different seeds see differently weighted data."""
    return F.when(F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(2)) == 0, 2.0).otherwise(1.0)


def predict(model: LogisticRegressionModel, rows: DataFrame, name: str, seed: int) -> DataFrame:
    """Prediction rows with one logit per class."""
    return model.transform(rows).select(
        F.lit(name).alias("model"), F.lit(seed).alias("seed"), "lang", F.col("corpus").alias("split"),
        F.col("id").alias("example_id"), F.col("label").alias("true_label"), vector_to_array("raw").alias("logits"))


def _fitted(rows: DataFrame, units: list[tuple[str, int, str | None, dict]], train_on, held):
    """(unit, predictions) of all units (name, seed, language or None for all, settings), several fits at a time, in the order in which they end."""
    def one(unit):
        name, seed, lang, params = unit
        own = rows if lang is None else rows.where(F.col("lang") == lang)
        return unit, predict(fit(own, seed, params, train_on), own.where(F.col("corpus").isin(*held)), name, seed)

    with ThreadPoolExecutor(AT_ONCE) as pool:
        for done in as_completed([pool.submit(one, u) for u in units]):
            yield done.result()


def train_per_language(corpus: DataFrame, langs: list[str], name: str, seed: int = 42, params: dict | None = None,
                       train_on: tuple[str, ...] = ("seed",), held: tuple[str, ...] = ("seed", "valid", "test")) -> DataFrame:
    """Predictions of one model per language on its own splits."""
    p = {**DEFAULTS, **(params or {})}
    rows = featured(corpus.where(F.col("lang").isin(*langs)), p["features"], train_on, held)
    return reduce(DataFrame.unionByName, [scored for _, scored in _fitted(rows, [(name, seed, lang, p) for lang in langs], train_on, held)])


def train_pooled(corpus: DataFrame, name: str, seed: int = 42, params: dict | None = None,
                 train_on: tuple[str, ...] = ("seed",), held: tuple[str, ...] = ("seed", "valid", "test")) -> DataFrame:
    """Predictions of one model trained on all languages together."""
    p = {**DEFAULTS, **(params or {})}
    return next(_fitted(featured(corpus, p["features"], train_on, held), [(name, seed, None, p)], train_on, held))[1]


def grid(configs: dict[str, list], seeds: list[int], langs: list[str], spark) -> DataFrame:
    """Every (config, seed, lang) unit of a sweep; the config name spells out its settings."""
    names = [",".join(f"{k}={v}" for k, v in zip(configs, values)) for values in product(*configs.values())]
    rows = [(c, s, l) for c in names for s in seeds for l in langs]
    return spark.createDataFrame(rows, "config string, seed int, lang string")


def settings(config: str) -> dict:
    pairs = [x.split("=", 1) for x in config.split(",") if x]
    return {k: (int(v) if k in ("features", "iterations") else float(v)) for k, v in pairs}


def sweep(corpus: DataFrame, units: DataFrame, done: DataFrame | None, path: str,
          train_on: tuple[str, ...] = ("seed",), held: tuple[str, ...] = ("seed", "valid", "test")) -> None:
    """Train every unit without a result and append its results row to ``path``.

    The list of open units is the sweep's settings, not data. Features are made once per number of features, and fits run side by side. Each
    unit is written once trained, so a broken sweep goes on where it stopped.
    """
    todo = units if done is None else pending_units(units, done)
    open_units = [(u["config"], u["seed"], u["lang"], {**DEFAULTS, **settings(u["config"])}) for u in todo.orderBy("config", "seed", "lang").collect()]
    for size in sorted({u[3]["features"] for u in open_units}):
        mine = [u for u in open_units if u[3]["features"] == size]
        rows = featured(corpus.where(F.col("lang").isin(*{u[2] for u in mine})), size, train_on, held)
        for _, scored in _fitted(rows, mine, train_on, held):
            results(scored).write.mode("append").parquet(path)
