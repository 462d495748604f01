"""Tiered leakage filter against a held-out corpus."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import TIER1_MIN, TIER2_MIN, TRIGRAM_BLOCK
from ..functions.alignment import best_edit_ratio, best_matching_ratio, best_of_runs
from ..functions.text import char_trigrams_of, edit_ratio, norm_hard, sequence_ratio
from ..session import join_on, materialize
from .similarity import in_blocks, pairs_above


def leakage_filter(rows: DataFrame, target: DataFrame, ratio: Callable[[Column, Column], Column] = sequence_ratio,
                   key: str = "id", block: float = TRIGRAM_BLOCK, tier1: float = TIER1_MIN,
                   tier2: float = TIER2_MIN) -> DataFrame:
    """Rows with ``tier`` (exact, tier1, tier2 or keep) and ``best``, the largest edit ratio.

    Equal normalized texts are exact. Otherwise every target text with a trigram Jaccard of
    at least ``block`` is compared by ``ratio``. Equal texts share one comparison.
    """
    normed = materialize(rows.select(key, norm_hard("text").alias("h")).withColumn("hk", F.sha2("h", 256)))
    held = target.where(F.col("text").isNotNull()).select(norm_hard("text").alias("h")).distinct().withColumn(
        "hk", F.sha2("h", 256))
    exact = normed.select("hk").distinct().join(held.select("hk"), "hk", "left_semi").withColumn("is_exact", F.lit(True))
    mine = normed.dropDuplicates(["hk"]).join(exact, "hk", "left_anti").select("hk", "h")
    left, right = _sets(mine), _sets(held)
    pairs = in_blocks(_may_meet(left, right, block), right, ["all"], pairs_above(block), "a long, b long, shared long")
    best = _best_ratio(pairs, left, right, ratio)
    verdicts = exact.withColumn("best", F.lit(None).cast("double")).unionByName(
        best.withColumn("is_exact", F.lit(False)))
    tier = (
        F.when(F.coalesce("is_exact", F.lit(False)), "exact")
        .when(F.coalesce("best", F.lit(0.0)) >= tier1, "tier1")
        .when(F.coalesce("best", F.lit(0.0)) >= tier2, "tier2")
        .otherwise("keep")
    )
    judged = normed.select(key, "hk").join(verdicts, "hk", "left").select(key, tier.alias("tier"), "best")
    return join_on(rows, judged, [key])


def _sets(texts: DataFrame) -> DataFrame:
    """Written texts with their trigrams as hashes; texts without any meet nothing."""
    grams = F.array_distinct(F.transform(char_trigrams_of(F.col("h")), lambda g: F.xxhash64(g)))
    sets = texts.select(F.lit(0).alias("all"), "hk", "h", grams.alias("hashes"), F.monotonically_increasing_id().alias("rid"))
    return materialize(sets).where(F.size("hashes") > 0)


def _may_meet(left: DataFrame, right: DataFrame, block: float) -> DataFrame:
    """Left sets of a size that lets them reach a Jaccard of ``block`` with some right set."""
    sizes = right.agg(F.min(F.size("hashes")).alias("low"), F.max(F.size("hashes")).alias("high"))
    n = F.size("hashes")
    return left.crossJoin(F.broadcast(sizes)).where((n >= F.col("low") * block - 1) & (n * block <= F.col("high") + 1)).drop("low", "high")


def _best_ratio(pairs: DataFrame, left: DataFrame, right: DataFrame, ratio) -> DataFrame:
    """(hk, best): largest ratio of each left text.

    The target texts of one left text are compared with it side by side, as they stand together in a task; where they do not, the last step
    finds the largest. A ratio given as a column of its own is worked out for every pair.
    """
    mine = left.select(F.col("rid").alias("a"), "hk", F.col("h").alias("ha"))
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = pairs.select("a", "b").join(right.select(F.col("rid").alias("b"), F.col("h").alias("hb")), "b")
    both = both.repartition(parts, "a").join(mine, "a").select("hk", "a", "ha", "hb")
    if ratio in (edit_ratio, sequence_ratio):
        make = best_edit_ratio if ratio is edit_ratio else best_matching_ratio
        found = both.mapInArrow(best_of_runs(make), "hk string, r double")
    else:
        found = both.select("hk", ratio(F.col("ha"), F.col("hb")).alias("r"))
    return found.groupBy("hk").agg(F.max("r").alias("best"))


def leakage_stats(judged: DataFrame) -> DataFrame:
    """Counts per tier and in total."""
    t = F.col("tier")
    return judged.agg(
        F.count_if(t != "keep").alias("removed_total"), F.count_if(t == "exact").alias("removed_exact"),
        F.count_if(t == "tier1").alias("removed_tier1"), F.count_if(t == "tier2").alias("removed_tier2"),
        F.count_if(t.isin("exact", "tier1")).alias("clean_highconf"), F.count_if(t == "keep").alias("kept"),
        F.count(F.lit(1)).alias("orig"))
