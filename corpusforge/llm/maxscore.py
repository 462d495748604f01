"""Exact top-k by inner product with MaxScore: terms are the components, shards are blocks of rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path

#: Queries that are sent to the tasks at once.
QUERIES_AT_ONCE = 4096
#: Rows of a shard, for which score bounds are kept.
SHARD = 4096
_PROBE = 8


def quantize(column: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """floor(scale * x) of every component as rows of a matrix (shorter vectors: zeros), and which rows take part."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    sizes = np.array([0 if x is None else x for x in column.value_lengths().to_pylist()], np.int64)
    ok = ~np.asarray(column.is_null())
    flat = column.flatten()
    row = np.repeat(np.arange(n), sizes)
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float)  # nulls are NaN
    ok[row[~np.isfinite(values)]] = False
    out = np.zeros((n, int(sizes.max(initial=0))))
    at = np.arange(row.size) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    with np.errstate(invalid="ignore"):
        out[row, at] = np.floor(scale * values)
    out[~ok] = 0
    return out, ok


def _wide(a: np.ndarray, width: int) -> np.ndarray:
    return a if a.shape[1] >= width else np.hstack([a, np.zeros((a.shape[0], width - a.shape[1]))])


def _exact(a: np.ndarray, b: np.ndarray) -> bool:
    """Doubles hold every partial sum of the products exactly."""
    return np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(a.shape[1], 1) < 2.0**53


class Best:
    """The ``k`` best rows so far of each query: higher scores first, ties to the smaller id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.rows = [np.zeros(0, np.int64)] * len(ids)
        self.scores = [np.zeros(0, np.int64)] * len(ids)

    def add(self, ids: np.ndarray, shard: np.ndarray) -> None:
        """Look at a shard. Per query the components are ordered by their score range over the shard. Those of the lowest
        ranges, which together can't lift a row to the k-th best score, are non-essential. Essential ones are summed for all rows; the
        others are probed, widest first, for rows that can still reach that score."""
        width = max(shard.shape[1], self.vectors.shape[1])
        shard, queries = _wide(shard, width), _wide(self.vectors, width)
        if not _exact(shard, queries):
            shard, queries = shard.astype(np.int64), queries.astype(np.int64)
        low, high = shard.min(axis=0), shard.max(axis=0)
        for i, q in enumerate(queries):
            least, most = np.minimum(q * low, q * high), np.maximum(q * low, q * high)
            full = self.scores[i].size == self.k
            bar = self.scores[i][-1] if full else -np.inf
            if full and most.sum() < bar:
                continue
            order = np.argsort(most - least, kind="stable")
            spread = np.cumsum((most - least)[order])
            cut = int(np.searchsorted(spread, bar - least.sum(), side="left")) if full else 0
            essential, other = order[cut:], order[:cut][::-1]
            score = shard[:, essential] @ q[essential]
            at = np.flatnonzero(score + most[other].sum() >= bar) if full else np.arange(len(ids))
            score = score[at]
            for p in range(0, other.size, _PROBE):
                if not at.size:
                    break
                terms = other[p:p + _PROBE]
                score = score + shard[np.ix_(at, terms)] @ q[terms]
                if full:
                    able = score + most[other[p + _PROBE:]].sum() >= bar
                    at, score = at[able], score[able]
            able = ids[at] != self.ids[i]
            at, score = at[able], score[able].astype(np.int64)
            if at.size:
                rows, scores = np.concatenate([self.rows[i], ids[at]]), np.concatenate([self.scores[i], score])
                top = np.lexsort((rows, -scores))[:self.k]
                self.rows[i], self.scores[i] = rows[top], scores[top]

    def batch(self) -> pa.RecordBatch:
        n = [r.size for r in self.rows]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.ids, n)), pa.array(np.concatenate(self.rows) if n else np.zeros(0, np.int64)),
                                           pa.array(np.concatenate(self.scores) if n else np.zeros(0, np.int64))], names=["query_id", "vec_id", "score"])


def search(rows: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` rows of highest integer inner product for each query: query_id, rank (from 1), vec_id, score.

    Components x count as floor(scale * x); missing ones of shorter vectors as 0. Vectors that are null or hold null or non-finite
    components, and rows with a null id, take no part. Rows with the query's own id are no candidates; ties go to the smaller id. A
    repeated row is a candidate of its own; equal queries are answered once, and different vectors of one query id together.
    Scores that need more than 64 bits are undefined.

    Queries go out in blocks of about ``QUERIES_AT_ONCE``; for each, every task keeps its own best rows shard by shard, and a window merges them.
    Each block's answers are written to the shared folder.
    """
    spark = rows.sparkSession
    rows = rows.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    asked = queries.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("v")).where("id IS NOT NULL AND v IS NOT NULL").distinct()
    total = asked.count()
    path = scratch_path(spark, "topk")
    blocks = max(1, -(-total // QUERIES_AT_ONCE))
    for b in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("id", "v"), F.lit(blocks)) == b)
        got = part.toArrow()  # one block of queries
        vectors, ok = quantize(got.column("v"), scale) if got.num_rows else (np.zeros((0, 0)), np.zeros(0, bool))
        shared = spark.sparkContext.broadcast((got.column("id").to_numpy()[ok].astype(np.int64), vectors[ok]))

        def look(batches, shared=shared):
            best = Best(*shared.value, k)
            for batch in batches:
                for i in range(0, batch.num_rows, SHARD):
                    some = batch.slice(i, SHARD)
                    shard, ok = quantize(some.column(1), scale)
                    if ok.any():
                        best.add(some.column(0).to_numpy()[ok], shard[ok])
            yield best.batch()

        found = rows.mapInArrow(look, "query_id long, vec_id long, score long")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        ranked.select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(path)
    out = spark.read.parquet(path)
    if blocks > 1:  # vectors of one query id may have been in several blocks
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        out = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
