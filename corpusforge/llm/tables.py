"""Table helpers shared by the operators of this subpackage."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, ship, small_batches

__all__ = ["start", "materialize", "null_join", "read", "bit_filter", "in_filter", "FILTER_BITS"]

#: Bits of a membership filter: its size is the same for every input, a fuller filter only lets more rows through.
FILTER_BITS = 1 << 26


def start(spark: SparkSession) -> None:
    """What every query of this subpackage begins with: the package on the executors, and small batches of whole texts."""
    ship(spark)
    small_batches(spark)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def null_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys meet; the keys of ``left`` stay."""
    names = {k: f"_r_{k}" for k in keys}
    right = right.withColumnsRenamed(names)
    cond = None
    for k, n in names.items():
        one = left[k].eqNullSafe(right[n])
        cond = one if cond is None else cond & one
    return left.join(right, cond, how).drop(*names.values())


def bit_filter(keys: DataFrame, column: str, bits: int = FILTER_BITS) -> np.ndarray:
    """A bitmap with one set bit per key (a 64-bit integer), built by ``bit_or`` over its words.

    At most ``bits / 64`` words reach the driver, whatever the number of keys.
    """
    slot = F.col(column).bitwiseAND(F.lit(bits - 1))
    words = (keys.where(F.col(column).isNotNull())
             .select(F.shiftright(slot, 6).cast("int").alias("w"), F.expr(f"shiftleft(1L, CAST({column} & 63 AS INT))").alias("b"))
             .groupBy("w").agg(F.bit_or("b").alias("b")))
    out = np.zeros(bits // 64, dtype=np.int64)
    got = words.toArrow()
    out[got.column("w").to_numpy().astype(np.int64)] = got.column("b").to_numpy()
    return out.view(np.uint64)


def in_filter(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which unsigned 64-bit ``keys`` may be in the bitmap."""
    slot = keys & np.uint64(bitmap.size * 64 - 1)
    return (bitmap[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
