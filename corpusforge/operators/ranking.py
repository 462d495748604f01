"""Row numbers and top picks inside groups of any size.

A plain ``row_number`` over a group puts the whole group into one task. Here every
group is cut into ordered buckets: bucket counts are pre-aggregated, a running sum of
those few counts gives each bucket its offset, and rows are numbered inside a bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import join_on

HASH_DIGITS = 4


def hash_key(key: str | Column, seed: int | str) -> Column:
    """Repeatable draw order: hex md5 of the key and the seed."""
    col = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(col.cast("string"), F.lit(f"#{seed}")))


def bucket_offsets(df: DataFrame, group: list[str], bucket: list[str]) -> DataFrame:
    """Per bucket: its row count ``_n`` and the rows of the group before it ``_before``."""
    before = Window.partitionBy(*group).orderBy(*bucket).rowsBetween(
        Window.unboundedPreceding, -1)
    counts = df.groupBy(*group, *bucket).agg(F.count(F.lit(1)).alias("_n"))
    return counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))


def bucketed_rank(df: DataFrame, group: list[str], bucket: list[str], order: list, name: str) -> DataFrame:
    """1-based position in the group ordered by (bucket, order); buckets sort before the order."""
    offsets = bucket_offsets(df, group, bucket).drop("_n")
    inside = Window.partitionBy(*group, *bucket).orderBy(*order)
    return (
        join_on(df, offsets, group + bucket)
        .withColumn(name, F.col("_before") + F.row_number().over(inside))
        .drop("_before")
    )


def id_rank(df: DataFrame, group: list[str], id_col: str, name: str, width: int = 65536) -> DataFrame:
    """Position by a whole-number id; an id range of ``width`` forms one bucket."""
    cut = df.withColumn("_bucket", F.floor(F.col(id_col) / width))
    return bucketed_rank(cut, group, ["_bucket"], [id_col], name).drop("_bucket")


def take_by_hash(df: DataFrame, group: list[str], quota: Column, key: str, seed: int | str,
                 quotas: DataFrame | None = None) -> DataFrame:
    """The first ``quota`` rows of each group in the repeatable random order.

    ``quota`` may use ``_size`` (rows of the group) and the columns of ``quotas``, which is
    joined on the group. Buckets that lie wholly inside the quota are kept as they are; only
    the one bucket that straddles it is sorted.
    """
    cut = df.withColumn("_hash", hash_key(key, seed)).withColumn(
        "_bucket", F.left("_hash", F.lit(HASH_DIGITS)))
    offsets = bucket_offsets(cut, group, ["_bucket"])
    sizes = offsets.groupBy(*group).agg(F.sum("_n").alias("_size"))
    sizes = sizes if quotas is None else join_on(sizes, quotas, group)
    sizes = sizes.select(*group, quota.cast("long").alias("_quota"))
    wanted = join_on(offsets, sizes, group).where(F.col("_before") < F.col("_quota"))
    rows = join_on(cut, wanted, group + ["_bucket"])
    inside = Window.partitionBy(*group, "_bucket").orderBy("_hash", key)
    whole = rows.where(F.col("_before") + F.col("_n") <= F.col("_quota"))
    part = (
        rows.where(F.col("_before") + F.col("_n") > F.col("_quota"))
        .withColumn("_pos", F.row_number().over(inside))
        .where(F.col("_before") + F.col("_pos") <= F.col("_quota"))
    )
    return whole.select(*df.columns).unionByName(part.select(*df.columns))


def nth_rows(df: DataFrame, group: list[str], value: str, key: str, picks: dict[str, Column],
             name: str = "pick") -> DataFrame:
    """Rows at given zero-based positions of each group ordered by (value, draw order of key).

    ``picks`` maps a pick name to a position expression over ``_size``. Two levels of counts
    (per value, then per hash bucket of the value) leave one small bucket per pick to sort.
    """
    cut = df.withColumn("_hash", hash_key(key, "nth")).withColumn(
        "_bucket", F.left("_hash", F.lit(HASH_DIGITS)))
    by_value = bucket_offsets(cut, group, [value])
    sizes = by_value.groupBy(*group).agg(F.sum("_n").alias("_size"))
    wanted = sizes.select(*group, F.explode(F.array(*[
        F.struct(F.lit(p).alias(name), pos.cast("long").alias("_target")) for p, pos in picks.items()
    ])).alias("_p")).select(*group, "_p.*")
    inside = (F.col("_target") >= F.col("_before")) & (F.col("_target") < F.col("_before") + F.col("_n"))
    at_value = join_on(by_value, wanted, group).where(inside).select(
        *group, value, name, (F.col("_target") - F.col("_before")).alias("_target"))
    values = at_value.select(*group, value).distinct()
    by_bucket = bucket_offsets(join_on(cut, values, group + [value], "left_semi"),
                               group + [value], ["_bucket"])
    at_bucket = join_on(by_bucket, at_value, group + [value]).where(inside).select(
        *group, value, "_bucket", name, (F.col("_target") - F.col("_before")).alias("_target"))
    rows = join_on(cut, at_bucket, group + [value, "_bucket"])
    order = Window.partitionBy(*group, value, "_bucket", name).orderBy("_hash", key)
    return (
        rows.withColumn("_pos", F.row_number().over(order) - 1)
        .where(F.col("_pos") == F.col("_target"))
        .select(*df.columns, name)
    )


def top_k(df: DataFrame, group: list[str], order: list, k: int, salt_key: str, parts: int = 64) -> DataFrame:
    """First ``k`` rows per group: a top-k per salted slice, then a top-k of the slice winners."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(salt_key), F.lit(parts)))
    first = Window.partitionBy(*group, "_salt").orderBy(*order)
    last = Window.partitionBy(*group).orderBy(*order)
    return (
        salted.withColumn("_pos", F.row_number().over(first)).where(F.col("_pos") <= k)
        .withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
        .drop("_salt", "_pos")
    )
