"""Benchmark decontamination: prefix-filtered join of item windows with documents on their rarest word shingle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import nptext
from .tables import bit_filter, in_filter, materialize, null_join

#: Words of a shingle; a window of fewer words is one shingle.
SHINGLE = 3


def _words(column: pa.Array):
    data, offsets = nptext.arrow_bytes(column)
    data = nptext.LOWER[data]
    for i, j in nptext.blocks(offsets):
        yield i, j, nptext.Words(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], nptext.ALNUM)


def windows(items: DataFrame, size: int) -> DataFrame:
    """Distinct windows of the items: ``words`` (space-joined), ``n_words``, and one row per shingle (``hash``, ``at``).

    An item of fewer than ``size`` words, but not none, is one window.
    """

    def cut(batches):
        for batch in batches:
            for i, j, w in _words(batch.column(1)):
                rows = ([], [], [])
                for d in range(j - i):
                    a, b = int(w.first[d]), int(w.first[d + 1])
                    for s in range(a, max(b - size + 1, min(a + 1, b))):
                        e = min(s + size, b)
                        rows[0].append(batch.column(0)[i + d].as_py())
                        rows[1].append(w.text(s, e).decode())
                        rows[2].append(e - s)
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.int32())],
                                                 names=["item", "words", "n_words"])

    return items.select(F.col("item").cast("string").alias("item"), "text").mapInArrow(cut, "item string, words string, n_words int")


def shingles(wins: DataFrame) -> DataFrame:
    """One row per shingle of each distinct window: its hash, as documents have it, and the index of its first word."""

    def hashed(batches):
        for batch in batches:
            for i, j, w in _words(batch.column(0)):
                hs, at, row = [], [], []
                for k in (1, 2, SHINGLE):
                    g, s = w.grams(k)
                    n = np.diff(w.first)[w.doc[s]]
                    own = (n == k) if k < SHINGLE else (n >= k)
                    hs.append(g[own])
                    at.append((s - w.first[w.doc[s]])[own])
                    row.append(w.doc[s][own] + i)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(row))), pa.array(nptext.signed(np.concatenate(hs))),
                                                  pa.array(np.concatenate(at).astype(np.int32))], names=["words", "hash", "at"])

    return wins.select("words").distinct().mapInArrow(hashed, "words string, hash long, at int")


def _runs(docs: DataFrame, bitmap, sizes: list[int], size: int) -> DataFrame:
    """Per document its number of words, and the stretches of words whose shingles may all be shingles of windows.

    ``sizes``: lengths of the windows; a stretch is kept if a window of some length fits into it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("words", pa.list_(pa.string())), ("hashes", pa.list_(pa.int64()))]))
    least = min([n for n in sizes if n >= SHINGLE], default=None)
    short = [n for n in sizes if n < SHINGLE]

    def look(batches):
        for batch in batches:
            for i, j, w in _words(batch.column(2)):
                out: list[list] = [[] for _ in range(j - i)]
                for k in [SHINGLE] * (least is not None) + short:
                    g, s = w.grams(k)
                    ok = in_filter(shared.value, g)
                    g, s = g[ok], s[ok]
                    if not s.size:
                        continue
                    new = np.ones(s.size, bool)
                    if k == SHINGLE:
                        new[1:] = (s[1:] != s[:-1] + 1) | (w.doc[s[1:]] != w.doc[s[:-1]])
                    lo = np.flatnonzero(new)
                    hi = np.concatenate([lo[1:], [s.size]])
                    for a, b in zip(lo, hi):
                        if k < SHINGLE or b - a + k - 1 >= least:
                            first, last = int(s[a]), int(s[b - 1]) + k
                            d = int(w.doc[first])
                            out[d].append({"start": first - int(w.first[d]), "hashes": nptext.signed(g[a:b]).tolist(),
                                           "words": w.text(first, last).decode("utf-8", "replace").split(" ")})
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i),
                                                  pa.array(np.diff(w.first), pa.int64()), pa.array(out, kind)], names=["doc", "t", "n_words", "runs"])

    return docs.mapInArrow(look, "doc long, t long, n_words long, runs array<struct<start:int,words:array<string>,hashes:array<bigint>>>")


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text",
                  size: int = 10) -> DataFrame:
    """Which words of which documents lie in an occurrence of an item's window of ``size`` words.

    Words are runs of digits, ASCII letters (in lower case) and non-ASCII characters. Each window is joined through its
    rarest shingle only (fewest occurrences in the stretches of the documents that look like windows, then smallest hash): that is
    the necessary prefix for containment 1. A pair must leave room for the whole window on both sides of the shingle
    within the stretch, and is then compared word by word.

    Returns one row per document: id, ``n_words``, ``n_hit`` (hit words), ``items`` (sorted strings of the ids of the items
    with occurring windows). A null or wordless text has no words and no hits; items without words, or with a null id, match
    nothing. Rows with the same id and text get the same result each; rows with the same id and another text their own.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc"), F.xxhash64(text).alias("t"), F.col(text).alias("text"))
    items = items.select(F.col(item_id).alias("item"), F.col(text).alias("text")).where("item IS NOT NULL")
    wins = materialize(windows(items, size).distinct())
    parts = materialize(shingles(wins))
    sizes = [r[0] for r in wins.select("n_words").distinct().collect()]  # at most ``size`` values
    found = materialize(_runs(docs, bit_filter(parts.distinct(), "hash", 1 << 23), sizes, size))

    run = found.where(F.size("runs") > 0).select("doc", "t", F.explode("runs").alias("r")).distinct()
    near = run.select("doc", "t", F.col("r.start").alias("start"), F.col("r.words").alias("run"), F.posexplode("r.hashes").alias("pos", "hash"))
    seen = near.groupBy("hash").agg(F.count("*").alias("seen"))
    prefix = (parts.join(seen, "hash").groupBy("words")
              .agg(F.min(F.struct("seen", "hash", "at")).alias("p"), F.count("*").alias("known")))
    whole = parts.groupBy("words").agg(F.count("*").alias("n"))
    prefix = (prefix.join(whole, "words").where("known = n")  # a shingle that occurs nowhere rules its window out
              .select("words", F.split("words", " ").alias("win"), F.col("p.hash").alias("hash"), F.col("p.at").alias("at")))
    near = near.select("doc", "t", "hash", (F.col("start") + F.col("pos")).alias("pos"), F.least("pos", F.lit(size)).alias("left"),
                       F.slice("run", F.greatest(F.col("pos") - size, F.lit(0)) + 1, F.lit(2 * size + SHINGLE)).alias("around"))
    pairs = (near.join(prefix, "hash")
             .where("at <= left AND left - at + size(win) <= size(around)")
             .where("slice(around, left - at + 1, size(win)) = win")
             .select("doc", "t", (F.col("pos") - F.col("at")).alias("start"), F.size("win").alias("n"), "words").distinct())
    pairs = materialize(pairs)
    spans = pairs.select("doc", "t", "start", "n").distinct().groupBy("doc", "t").agg(F.array_distinct(F.flatten(F.collect_list(
        F.expr("sequence(start, start + n - 1)")))).alias("hit"))
    hits = spans.select("doc", "t", F.size("hit").cast("long").alias("n_hit"))
    which = (pairs.select("doc", "t", "words").distinct().join(wins.select("item", "words"), "words")
             .groupBy("doc", "t").agg(F.sort_array(F.collect_set("item")).alias("items")))
    hits = null_join(hits, which, ["doc", "t"])
    out = null_join(found.select("doc", "t", "n_words"), hits, ["doc", "t"], "left")
    return out.select(F.col("doc").alias(doc_id), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                      F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.col("t").alias("text_key"))
