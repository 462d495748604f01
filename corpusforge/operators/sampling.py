"""Seeded sampling, mixing, new ids and batches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import BATCH_SIZE
from ..functions.text import length_bucket
from ..session import join_on
from .lengths import bucket_counts, drop_null_text
from .ranking import hash_key, id_rank, take_by_hash, HASH_DIGITS, bucketed_rank


def sample_seeds(corpus: DataFrame, ratio: float | None, seed: int = 42,
                 by: tuple[str, ...] = ("lang", "label"), key: str = "id") -> DataFrame:
    """max(1, int(n * ratio)) rows per group; everything when no ratio below 1 is given."""
    if ratio is None or ratio >= 1.0:
        return corpus
    return take_by_hash(corpus, list(by), F.greatest(F.lit(1), F.floor(F.col("_size") * ratio)), key, seed)


def sample_n(corpus: DataFrame, n: int, seed: int = 42, by: tuple[str, ...] = ("corpus",),
             key: str = "id") -> DataFrame:
    """n rows per group for comparisons at equal size; smaller groups stay whole."""
    return take_by_hash(corpus, list(by), F.lit(n), key, seed)


def sample_to_size(big: DataFrame, reference: DataFrame, seed: int = 42, by: tuple[str, ...] = ("lang",),
                   key: str = "id") -> DataFrame:
    """As many rows per group as the reference has."""
    sizes = reference.groupBy(*by).agg(F.count(F.lit(1)).alias("_want"))
    return take_by_hash(big, list(by), F.col("_want"), key, seed, quotas=sizes)


def thin(synthetic: DataFrame, frac: float, seed: int = 42, by: tuple[str, ...] = ("lang", "label"),
         key: str = "id") -> DataFrame:
    """round-half-even(n * frac) rows per group, at most n."""
    quota = F.least(F.col("_size"), F.bround(F.col("_size") * frac))
    return take_by_hash(synthetic, list(by), quota, key, seed)


def continue_ids(seeds: DataFrame, synthetic: DataFrame, by: tuple[str, ...] = ("lang",),
                 seed: int = 42, key: str = "id") -> DataFrame:
    """Synthetic rows renumbered from max(seed id) + 1, in (label, draw order)."""
    last = seeds.groupBy(*by).agg(F.max(key).alias("_last"))
    cut = synthetic.withColumn("_hash", hash_key(key, seed)).withColumn(
        "_bucket", F.left("_hash", F.lit(HASH_DIGITS)))
    ranked = bucketed_rank(cut, list(by), ["label", "_bucket"], ["_hash", key], "_pos")
    return (
        join_on(ranked, last, list(by), "left")
        .withColumn(key, F.coalesce(F.col("_last"), F.lit(-1)) + F.col("_pos"))
        .select(*synthetic.columns)
    )


def augment(seeds: DataFrame, synthetic: DataFrame) -> DataFrame:
    """Seed rows followed by synthetic rows."""
    return seeds.unionByName(synthetic, allowMissingColumns=True)


def ratio_variant(seeds: DataFrame, synthetic: DataFrame, frac: float, seed: int = 42) -> DataFrame:
    """All seeds plus a stratified share of the synthetic rows with continued ids."""
    return augment(seeds, continue_ids(seeds, thin(synthetic, frac, seed), seed=seed))


def target_dist(reference: DataFrame, by: list[str]) -> DataFrame:
    """Share of each length bucket per group of a reference corpus."""
    counts = bucket_counts(reference, by)
    totals = counts.groupBy(*by).agg(F.sum("n").alias("total"))
    return counts.join(totals, by).select(*by, "bucket", (F.col("n") / F.col("total")).alias("share"))


def stratified_sample(synthetic: DataFrame, dist: DataFrame, total: int | None = None, seed: int = 42,
                      by: tuple[str, ...] = ("lang", "label"), key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Rows filling int(share * total) per bucket, and the shortfall of buckets that lack rows.

    The default total is the whole-number mean of the synthetic label counts per language.
    """
    by = list(by)
    outer = [c for c in by if c != "label"]
    cut = synthetic.withColumn("bucket", length_bucket("text"))
    per_label = synthetic.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    if total is None:
        totals = per_label.groupBy(*outer).agg(F.floor(F.avg("_n")).alias("_total"))
        quotas = join_on(dist, totals, outer)
    else:
        quotas = dist.withColumn("_total", F.lit(total))
    quotas = quotas.select(*by, "bucket", F.floor(F.col("share") * F.col("_total")).alias("quota")).where("quota > 0")
    picked = take_by_hash(drop_null_text(cut), by + ["bucket"], F.col("quota"), key, seed, quotas=quotas)
    have = drop_null_text(cut).groupBy(*by, "bucket").agg(F.count(F.lit(1)).alias("available"))
    short = join_on(quotas, have, by + ["bucket"], "left").select(
        *by, "bucket", "quota", F.coalesce("available", F.lit(0)).alias("available"),
        (F.col("quota") - F.coalesce("available", F.lit(0))).alias("shortfall"),
    ).where("shortfall > 0")
    return picked.drop("bucket"), short


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def pool(corpus: DataFrame, langs: list[str], corpora: tuple[str, ...] = ("seed", "valid")) -> DataFrame:
    """Rows of several languages as one training pool, the split kept as a column."""
    return corpus.where(F.col("lang").isin(*langs) & F.col("corpus").isin(*corpora))


def spot_check(corpus: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """k rows per language and label for reading."""
    return take_by_hash(corpus, ["lang", "label"], F.lit(k), "id", seed)


def assign_batches(corpus: DataFrame, size: int = BATCH_SIZE, by: tuple[str, ...] = ("lang", "label"),
                   key: str = "id") -> DataFrame:
    """Consecutive batches of ``size`` rows per group, in id order."""
    ranked = id_rank(corpus, list(by), key, "_pos")
    return ranked.withColumn("batch_idx", F.floor((F.col("_pos") - 1) / size)).drop("_pos")


