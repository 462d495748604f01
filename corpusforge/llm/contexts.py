"""Candidate contexts of repeated strings: where a fixed-length window of bytes or words may stand twice.

Every window picks an anchor inside itself by winnowing, so equal windows have equal anchors at the same place. Neighbouring windows
with one anchor form a context. Only contexts whose anchor stands at least twice in the corpus can hold a repeated window, and
windows of contexts with different anchors are never equal: what is repeated can be settled anchor by anchor.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import nptext
from ..session import scratch_path
from .tables import bit_filter, in_filter, materialize, null_join

#: Items (bytes or words) of text over which a task folds equal anchors and contexts before it emits them.
FLUSH = 1 << 25
#: Contexts go sooner, once a task holds so many different ones or occurrences, or as many bytes of them as ``held`` of the unit says.
HELD_CONTEXTS, HELD_PLACES = 60_000, 250_000

#: Bytes of text taken together where every byte has a window: some twenty numbers a byte are held at a time.
TOGETHER = 1 << 18


class Piece:
    """Windows of a block of texts: anchor values, which windows lie in one text, and the row and place of each."""

    def __init__(self, values, valid, row, place, items, cut):
        self.values, self.valid, self.row, self.place = values, valid, row, place
        self.items, self.cut = items, cut  # hashes of the items, and the bytes of items i to j
        pw, self.ipw = nptext.powers(items.size + 1)
        self.sums = np.zeros(items.size + 1, np.uint64)
        np.cumsum(items * pw[:-1], out=self.sums[1:])

    def digest(self, lo, hi):
        return nptext.mix((self.sums[hi] - self.sums[lo]) * self.ipw[lo] + (hi - lo).astype(np.uint64) * nptext._COEF[254])


class Bytes:
    """Windows of ``size`` UTF-8 bytes."""

    held = 1 << 23

    def __init__(self, size: int):
        self.size, self.k = size, max(1, size // 5)

    def pieces(self, column: pa.Array):
        data, offsets = nptext.arrow_bytes(column)
        for i, j in nptext.blocks(offsets, TOGETHER):
            part, at = data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
            n = max(part.size - self.k + 1, 0)
            pos = np.arange(n)
            values = nptext.range_hash(part, pos, pos + self.k)
            windows = max(part.size - self.size + 1, 0)
            row = np.repeat(np.arange(j - i), np.diff(at))[:windows]
            start = np.arange(windows)
            yield i, j, Piece(values, at[row + 1] - start >= self.size, row, start - at[row], nptext._BYTE[part], lambda a, b, part=part: part[a:b].tobytes())


class Spaced:
    """Windows of ``size`` words without ASCII white space."""

    held = 1 << 23

    def __init__(self, size: int):
        self.size, self.k = size, max(1, (size + 2) // 3)

    def pieces(self, column: pa.Array):
        data, offsets = nptext.arrow_bytes(column)
        for i, j in nptext.blocks(offsets):
            w = nptext.Words(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], nptext.SPACED)
            n = max(w.start.size - self.k + 1, 0)
            values = np.zeros(n, np.uint64)
            for c in range(self.k):
                values += w.hash[c:c + n] * nptext._COEF[c]
            windows = max(w.start.size - self.size + 1, 0)
            row = w.doc[:windows]
            start = np.arange(windows)
            yield i, j, Piece(nptext.mix(values), row == w.doc[self.size - 1:], row, start - w.first[row], w.hash, w.text)


def repeated_anchors(docs: DataFrame, unit) -> DataFrame:
    """Anchors (``h``) that stand at least twice in the texts."""
    width = unit.size - unit.k + 1

    def count(batches):
        held, n = [], 0

        def flush():
            u, c = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(nptext.signed(u)), pa.array(np.minimum(c, 2).astype(np.int8))], names=["h", "n"])

        for batch in batches:
            for _, _, p in unit.pieces(batch.column(0)):
                pick, _, _ = nptext.anchors(p.values, width, p.valid)
                held.append(p.values[pick])
                n += p.items.size
                if n >= FLUSH:
                    yield flush()
                    held, n = [], 0
        if held:
            yield flush()

    return docs.select("text").mapInArrow(count, "h long, n tinyint").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")


#: Rank of documents without an id: after all others.
LAST = (1 << 63) - 1
_CONTEXT = ("h long, cd long, n int, off int, ctx binary, held long, least long, most long, docs array<bigint>, ts array<int>, starts array<int>")


def _fold(held: list[tuple], ctx: dict[tuple[int, int], bytes]) -> pa.RecordBatch:
    """One row per context of a flush, with its occurrences as lists."""
    h, cd, doc, none, t, start, n, off = (np.concatenate(x) for x in zip(*held))
    order = np.lexsort((cd, h))
    h, cd, doc, none, t, start, n, off = (x[order] for x in (h, cd, doc, none, t, start, n, off))
    new = np.ones(h.size, bool)
    new[1:] = (h[1:] != h[:-1]) | (cd[1:] != cd[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.concatenate([first, [h.size]]))
    rank = np.where(none, LAST, doc)
    cut = pa.array(np.concatenate([first, [h.size]]).astype(np.int32))
    lists = [pa.ListArray.from_arrays(cut, x) for x in (pa.array(doc, mask=none), pa.array(t), pa.array(start))]
    return pa.RecordBatch.from_arrays([
        pa.array(h[first]), pa.array(cd[first]), pa.array(n[first]), pa.array(off[first]),
        pa.array([ctx[k] for k in zip(h[first].tolist(), cd[first].tolist())], pa.binary()), pa.array(size),
        pa.array(np.minimum.reduceat(rank, first)), pa.array(np.maximum.reduceat(rank, first)), *lists], names=[x.split()[0] for x in _CONTEXT.split(", ")])


def candidates(docs: DataFrame, unit) -> DataFrame:
    """Contexts whose anchor stands at least twice: anchor ``h``, digest ``cd``, number of windows ``n``, place ``off`` of the anchor, items ``ctx``, and
    the occurrences that a task has seen since its last flush: their number ``held``, smallest and largest rank of their documents, and lists
    of documents (``docs``, ``ts``) and first windows (``starts``).

    ``docs`` has doc, t and text. A bitmap of fixed size keeps most other anchors back; the rest are told apart later. Written to the shared folder.
    """
    width = unit.size - unit.k + 1
    shared = docs.sparkSession.sparkContext.broadcast(bit_filter(repeated_anchors(docs, unit), "h"))

    def cut(batches):
        held: list[tuple] = []
        ctx: dict[tuple[int, int], bytes] = {}
        size = places = items = 0
        for batch in batches:
            doc, t = batch.column(0), batch.column(1).to_numpy()
            none = np.asarray(doc.is_null())
            doc = doc.fill_null(0).to_numpy()
            for i, _, p in unit.pieces(batch.column(2)):
                pick, lo, hi = nptext.anchors(p.values, width, p.valid)
                ok = in_filter(shared.value, p.values[pick])
                pick, lo, hi = pick[ok], lo[ok], hi[ok]
                h, cd = nptext.signed(p.values[pick]), nptext.signed(p.digest(lo, hi + unit.size))
                for key, a, b in zip(zip(h.tolist(), cd.tolist()), lo.tolist(), hi.tolist()):
                    if key not in ctx:
                        ctx[key] = p.cut(a, b + unit.size)
                        size += len(ctx[key])
                row = p.row[lo] + i
                if pick.size:
                    held.append((h, cd, doc[row], none[row], t[row], p.place[lo].astype(np.int32), (hi - lo + 1).astype(np.int32), (pick - lo).astype(np.int32)))
                places += pick.size
                items += p.items.size
                if held and (items >= FLUSH or size >= unit.held or len(ctx) >= HELD_CONTEXTS or places >= HELD_PLACES):
                    yield _fold(held, ctx)
                    held, ctx, size, places, items = [], {}, 0, 0, 0
        if held:
            yield _fold(held, ctx)

    path = scratch_path(docs.sparkSession, "contexts")
    docs.select("doc", "t", "text").mapInArrow(cut, _CONTEXT).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


def occurrences(found: DataFrame, parts: DataFrame, *keep: str) -> DataFrame:
    """Rows of ``parts`` (h, cd and the columns ``keep``) for every occurrence of their context: doc, t, start, and ``keep``."""
    rows = found.select("h", "cd", "docs", "ts", "starts").join(parts, ["h", "cd"])
    return rows.select(F.explode(F.arrays_zip("docs", "ts", "starts")).alias("o"), *keep).select(
        F.col("o.docs").alias("doc"), F.col("o.ts").alias("t"), F.col("o.starts").alias("start"), *keep)


def items_of(found: DataFrame, several: DataFrame) -> DataFrame:
    """Items of each different context (h, cd, off, ctx, kinds) whose anchor is in ``several`` (h, kinds)."""
    shared = found.sparkSession.sparkContext.broadcast(bit_filter(several, "h"))

    def pass_on(batches):
        for batch in batches:
            yield batch.filter(pa.array(in_filter(shared.value, batch.column(0).to_numpy().view(np.uint64))))

    rows = found.select("h", "cd", "off", "ctx").mapInArrow(pass_on, "h long, cd long, off int, ctx binary")
    return rows.join(several, "h").dropDuplicates(["h", "cd"])


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Documents as doc, t and text; ``t`` tells texts of a repeated id apart."""
    return docs.select(F.col(doc_id).cast("long").alias("doc"), F.shiftright(F.xxhash64(text), 32).cast("int").alias("t"), F.col(text).alias("text"))


def finish(docs: DataFrame, gone: DataFrame, work, schema: str) -> DataFrame:
    """``work`` over all documents (doc, text, s, e), with the lists s and e of ``gone`` (doc, t, s, e; one row per document) or nulls.

    A bitmap of fixed size tells documents that surely have no row in ``gone``; their texts are not shuffled.
    """
    gone = materialize(gone)
    mark = F.xxhash64("doc", "t")
    shared = docs.sparkSession.sparkContext.broadcast(bit_filter(gone.select(mark.alias("h")), "h", 1 << 23))
    docs = docs.withColumn("h", mark)

    def part(hit: bool):
        def run(batches):
            for batch in batches:
                may = in_filter(shared.value, batch.column("h").to_numpy().view(np.uint64))
                yield batch.filter(pa.array(may == hit))
        return run

    marked = "doc long, t int, text string, h long"
    none = docs.mapInArrow(part(False), marked).selectExpr("doc", "text", "CAST(NULL AS array<int>) AS s", "CAST(NULL AS array<int>) AS e")
    some = null_join(docs.mapInArrow(part(True), marked).drop("h"), gone, ["doc", "t"], "left").select("doc", "text", "s", "e")
    return none.mapInArrow(work, schema).unionByName(some.mapInArrow(work, schema))
