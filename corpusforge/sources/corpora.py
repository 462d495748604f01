"""Labelled corpora: split folders, TSV files, appended corpora and augmented training sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import CORPUS

SPLITS = ("train", "valid", "test")
# a split may be one file or a folder of part files
SPLIT_PATH = r"/([^/]+)/([^/]+)\.csv(?:/[^/]*)?$"


def read_corpus(spark: SparkSession, root: str, splits: tuple[str, ...] = SPLITS) -> DataFrame:
    """CSV files laid out ``<root>/<lang>/<split>.csv`` as (id, text, label, lang, split)."""
    raw = (
        spark.read.schema(CORPUS).option("header", True).option("multiLine", True).option("escape", '"')
        .csv([f"{root}/*/{s}.csv" for s in splits])
    )
    path = F.col("_metadata.file_path")
    return raw.select(
        "*", F.regexp_extract(path, SPLIT_PATH, 1).alias("lang"), F.regexp_extract(path, SPLIT_PATH, 2).alias("split"))


def read_tsv(spark: SparkSession, path: str, labels: list[str]) -> DataFrame:
    """Headerless, unquoted (text, label) lines; lines of another shape and other labels are left out."""
    lines = spark.read.text(path)
    parts = F.split("value", "\t", -1)
    rows = lines.select(parts.alias("p")).where(F.size("p") == 2)
    return rows.select(F.get("p", F.lit(0)).alias("text"), F.get("p", F.lit(1)).alias("label")).where(F.col("label").isin(*labels))


def complete_langs(corpus: DataFrame, log: DataFrame, kinds: tuple[str, ...] = ("seed", "syn", "valid", "test")) -> DataFrame:
    """Languages that have every corpus kind and an outcome log."""
    have = corpus.select("lang", F.col("corpus").alias("kind")).distinct().unionByName(
        log.select(F.col("target_lang").alias("lang"), F.lit("log").alias("kind")).distinct())
    want = [*kinds, "log"]
    return have.where(F.col("kind").isin(*want)).groupBy("lang").agg(F.count_distinct("kind").alias("n")).where(
        F.col("n") == len(want)).select("lang")


def only_complete(corpus: DataFrame, log: DataFrame) -> DataFrame:
    return corpus.join(complete_langs(corpus, log), "lang", "left_semi")


def append_corpus(accepted: DataFrame, path: str) -> None:
    """Append accepted sentences as (id, text) under ``lang=/label=`` folders."""
    accepted.select(
        F.col("sid").alias("id"), "text", F.col("target_lang").alias("lang"), F.col("target_label").alias("label"),
    ).write.mode("append").partitionBy("lang", "label").parquet(path)


def write_augmented(rows: DataFrame, path: str, tag: str) -> None:
    """Write an augmented training set under ``lang=/tag=`` folders, replacing only the folders it covers."""
    rows.withColumn("tag", F.lit(tag)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("lang", "tag").parquet(path)


def write_split_csv(rows: DataFrame, path: str) -> None:
    """(id, text, label) of one split as CSV with header; text is written untouched."""
    rows.select("id", "text", "label").write.mode("overwrite").options(
        header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
