"""Run results, training histories, predictions and summary tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import HISTORY_RECORD, PREDICTION, RESULTS

RUN_PATH = r"/(?:\w+=)?([^/]+)/(?:seed[_=])?(-?\d+)/[^/]*$"


def read_results(spark: SparkSession, globs: list[str], config_level: str = RUN_PATH) -> DataFrame:
    """One row per (config, seed, lang) from ``<config>/seed_<n>/results_summary.json`` files.

    Missing runs are no error. Keys such as ``arm_mode/lang`` give an ``arm`` and the language.
    """
    found = _existing(spark, globs)
    if found:
        raw = spark.read.schema(RESULTS).option("multiLine", True).option("ignoreMissingFiles", True).json(found)
        path = F.col("_metadata.file_path")
    else:
        raw, path = spark.createDataFrame([], RESULTS), F.lit("")
    rows = raw.select(
        F.regexp_extract(path, config_level, 1).alias("config"),
        F.regexp_extract(path, config_level, 2).try_cast("int").alias("seed"),
        F.explode("results").alias("key", "r"))
    parts = F.split("key", "/")
    return rows.select(
        "config", "seed", F.element_at(parts, -1).alias("lang"),
        F.when(F.size(parts) > 1, F.element_at(parts, 1)).alias("arm"), "r.*",
    ).withColumn("gap", F.coalesce("gap", F.col("train_f1") - F.col("test_f1")))


def _existing(spark: SparkSession, globs: list[str]) -> list[str]:
    """The patterns that match at least one file."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    found = []
    for g in globs:
        p = jvm.org.apache.hadoop.fs.Path(g)
        hits = p.getFileSystem(conf).globStatus(p)
        if hits is not None and len(hits) > 0:
            found.append(g)
    return found


def class_rows(results: DataFrame) -> DataFrame:
    """Per-class test scores of each run as rows."""
    return results.select("config", "seed", "lang", F.explode("per_class_test").alias("label", "s")).select(
        "config", "seed", "lang", "label", "s.*")


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Training history records with their position, stage and kind (train or eval).

    A file holds an array of records, or an object with one array per stage.
    """
    whole = spark.read.option("wholetext", True).text(path).select(
        F.col("value"), F.col("_metadata.file_path").alias("path"))
    records = T.ArrayType(HISTORY_RECORD)
    staged = F.from_json("value", T.MapType(T.StringType(), records))
    plain = F.create_map(F.lit("ft"), F.from_json("value", records))
    as_map = F.when(F.trim("value").startswith("["), plain).otherwise(staged)
    rows = whole.select("path", F.explode(as_map).alias("stage", "rs")).select(
        "path", "stage", F.posexplode("rs").alias("pos", "r")).select("path", "stage", "pos", "r.*")
    return rows.withColumn("kind", F.when(F.col("loss").isNotNull() & F.col("eval_loss").isNull(), "train").otherwise("eval"))


def write_predictions(rows: DataFrame, path: str) -> None:
    rows.select(*[f.name for f in PREDICTION.fields]).write.mode("overwrite").partitionBy("model", "split").parquet(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PREDICTION).parquet(path)


def write_summary(rows: DataFrame, path: str, fmt: str = "json") -> None:
    rows.write.mode("overwrite").format(fmt).save(path)
