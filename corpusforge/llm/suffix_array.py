"""Maximal repeats of bytes from enhanced suffix arrays, and removal of repeated bytes."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import nptext
from .contexts import Bytes, candidates, finish, items_of, keyed, occurrences
from .tables import materialize

#: Contexts of one suffix array, about; and contexts of one anchor above which it is split by whole windows.
GROUP, HOT = 4_000, 16_000
#: Bytes of suffixes that are spelled out and sorted at once, about; bytes of text hashed at once; and numbers in one step of a comparison.
SPELLED, SLICE, STEP = 1 << 22, 1 << 18, 1 << 19


def _prefix_hashes(data: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes from each of ``at`` (ascending) on, over ``SLICE`` bytes at a time."""
    out = np.zeros(at.size, np.uint64)
    cuts = np.append(np.searchsorted(at, np.arange(0, data.size, SLICE)), at.size)
    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if i < j:
            base = int(at[i])
            out[i:j] = nptext.range_hash(data[base:int(at[j - 1]) + size], at[i:j] - base, at[i:j] - base + size)
    return out


def _whole_groups(group: np.ndarray, rows: int):
    """Stretches of at most ``rows`` of the sorted ``group``, or of one group that is larger; no group is cut."""
    cuts = np.append(np.flatnonzero(np.diff(group, prepend=-1)), group.size)
    i = 0
    while i < group.size:
        j = int(cuts[max(np.searchsorted(cuts, i + rows, side="right") - 1, np.searchsorted(cuts, i, side="right"))])
        yield i, j
        i = j


def _sorted_tails(data: np.ndarray, at: np.ndarray, end: np.ndarray, group: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of suffixes by ``group`` and then by the bytes after the first ``size``, and common prefixes with the one before in the group."""
    longest = int((end - at).max()) - size
    step = max(1, STEP // (size + longest + 1))
    tail = np.zeros((at.size, longest + 1), np.uint8)
    column = np.arange(longest)
    for i in range(0, at.size, step):
        place = at[i:i + step, None] + size + column
        inside = place < end[i:i + step, None]
        tail[i:i + step, :-1] = np.where(inside, data[np.minimum(place, data.size - 1)], 0)
    order = np.lexsort((tail.view(f"V{longest + 1}").ravel().view(f"S{longest + 1}"), group))
    at, end, group, tail = at[order], end[order], group[order], tail[order]
    common = np.zeros(at.size, np.int64)
    same = np.flatnonzero(group[1:] == group[:-1]) + 1
    first = np.arange(size)
    for i in range(0, same.size, step):
        s = same[i:i + step]
        full = (data[at[s, None] + first] == data[at[s - 1, None] + first]).all(axis=1)
        differ = tail[s] != tail[s - 1]
        run = np.where(differ.any(axis=1), differ.argmax(axis=1), longest)
        common[s] = np.where(full, np.minimum(size + run, np.minimum(end[s] - at[s], end[s - 1] - at[s - 1])), 0)
    return order, common


def suffix_order(data: np.ndarray, at: np.ndarray, end: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Enhanced suffix array over the suffixes ``at`` (ascending; each ending at ``end``, ``size`` bytes long at least) that share their first
    ``size`` bytes with another: indices of ``at`` in sorted order, and the common-prefix length of each with the one before.

    Suffixes are ordered by a hash of their first ``size`` bytes and then by their bytes; common prefixes are compared byte by byte.
    Suffixes of different hashes have no prefix in common, so whole groups of one hash are sorted a stretch at a time: only that many
    suffixes are spelled out at once.
    """
    _, group, count = np.unique(_prefix_hashes(data, at, size), return_inverse=True, return_counts=True)
    some = np.flatnonzero(count[group] > 1)
    if not some.size:
        return some, some
    some = some[np.argsort(group[some], kind="stable")]
    group = group[some]
    common = np.zeros(some.size, np.int64)
    for i, j in _whole_groups(group, max(1, SPELLED // int((end[some] - at[some]).max()))):
        own = some[i:j]
        order, common[i:j] = _sorted_tails(data, at[own], end[own], group[i:j], size)
        some[i:j] = own[order]
    return some, common


def intervals(common: np.ndarray, left: np.ndarray, least: int):
    """Stack scan of an enhanced suffix array: (length, first, last) of every common-prefix interval of ``least`` or more whose
    suffixes have different characters before them (``left``; negative: none, differs from all)."""
    stack: list[list[int]] = []  # length, first, left character or -1 if they differ
    n = common.size
    lefts = left.tolist()
    for i in range(1, n + 1):
        now = int(common[i]) if i < n else 0
        first, char = i - 1, lefts[i - 1]
        while stack and stack[-1][0] > now:
            length, first, own = stack.pop()
            char = own if own == char else -1
            if char < 0:
                yield length, first, i - 1
        if now >= least:
            if stack and stack[-1][0] == now:
                stack[-1][2] = stack[-1][2] if stack[-1][2] == char else -1
            else:
                stack.append([now, first, char])
        elif stack:
            raise AssertionError("intervals below the least length are not kept")


def _scan(contexts: list[bytes], size: int):
    """Suffixes of contexts in suffix order: position within its context, context, and the left-diverse intervals over them."""
    data = np.frombuffer(b"".join(contexts), np.uint8)
    lengths = np.array([len(c) for c in contexts], np.int64)
    begin = np.cumsum(lengths) - lengths
    n = lengths - size + 1
    owner = np.repeat(np.arange(len(contexts)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + begin[owner]
    order, common = suffix_order(data, at, (begin + lengths)[owner], size)
    at, owner = at[order], owner[order]
    left = np.where(at > begin[owner], data[np.maximum(at - 1, 0)].astype(np.int64), -1)
    return at, owner, begin, data.size, list(intervals(common, left, size))


def _bucketed(ctx: DataFrame, key: str = "h") -> DataFrame:
    groups = max(1, -(-ctx.count() // GROUP))
    return ctx.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(groups)))


def _cover(ctx: DataFrame, size: int) -> DataFrame:
    """Stretches (``s``, ``e``) of each context (h, cd, ctx) that lie in maximal repeats with other contexts of the anchor."""

    def work(table: pa.Table) -> pa.Table:
        at, owner, begin, total, found = _scan(table.column("ctx").to_pylist(), size)
        reach = np.zeros(at.size, np.int64)
        for length, first, last in found:
            np.maximum(reach[first:last + 1], length, out=reach[first:last + 1])
        hit = reach > 0
        edge = np.zeros(total + 1, np.int64)
        np.add.at(edge, at[hit], 1)
        np.add.at(edge, at[hit] + reach[hit], -1)
        inside = np.cumsum(edge)[:-1] > 0
        starts = begin[1:]
        new = inside.copy()
        new[1:] &= ~inside[:-1]
        new[starts] = inside[starts]
        stop = inside.copy()
        stop[:-1] &= ~inside[1:]
        stop[starts - 1] = inside[starts - 1]
        a, b = np.flatnonzero(new), np.flatnonzero(stop) + 1
        own = np.searchsorted(begin, a, side="right") - 1
        rows = pa.array(own)
        return pa.table({"h": table.column("h").take(rows), "cd": table.column("cd").take(rows),
                         "s": pa.array((a - begin[own]).astype(np.int32)), "e": pa.array((b - begin[own]).astype(np.int32))})

    return _bucketed(ctx).groupBy("bucket").applyInArrow(work, "h long, cd long, s int, e int")


def _cover_hot(ctx: DataFrame, size: int) -> DataFrame:
    """The same for anchors with very many contexts: windows (prefixes of ``size`` bytes) are counted by place and content."""
    one = ctx.select("h", "cd", "off", F.explode(F.sequence(F.lit(0), F.octet_length("ctx") - size)).alias("s"), "ctx")
    one = one.select("h", "cd", "s", (F.col("off") - F.col("s")).alias("place"), F.md5(F.expr(f"substring(ctx, s + 1, {size})")).alias("window"))
    often = one.groupBy("h", "place", "window").agg(F.count("*").alias("c")).where("c > 1").select("h", "place", "window")
    return one.join(often, ["h", "place", "window"], "left_semi").select("h", "cd", "s", (F.col("s") + size).alias("e"))


def _split(found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Folded contexts (h, cd, held, n), and the items of those whose anchor has others: with few, and with very many contexts."""
    folded = materialize(found.groupBy("h", "cd").agg(F.sum("held").alias("held"), F.first("n").alias("n")))
    several = materialize(folded.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1"))
    items = materialize(items_of(found, several))
    return folded, items.where(F.col("kinds") <= HOT), items.where(F.col("kinds") > HOT)


def repeated_stretches(docs: DataFrame, size: int) -> DataFrame:
    """(doc, t, s, e): stretches of bytes of each document inside strings of ``size`` bytes that stand somewhere else too."""
    found = candidates(docs, Bytes(size))
    folded, few, many = _split(found)
    whole = folded.where("held > 1").select("h", "cd", F.lit(0).alias("s"), (F.col("n") + size - 1).alias("e"))
    single = folded.where("held = 1").select("h", "cd")
    part = _cover(few, size).unionByName(_cover_hot(many, size)).join(single, ["h", "cd"], "left_semi")
    ranges = materialize(whole.unionByName(part))
    return occurrences(found, ranges, "s", "e").select("doc", "t", (F.col("start") + F.col("s")).alias("s"), (F.col("start") + F.col("e")).alias("e"))


_GROUPS = "repeat string, length int, h long, cd long, s int"


def _groups(table: pa.Table, part, owner: np.ndarray, place: np.ndarray, found: list[tuple[int, int, int]]) -> pa.Table:
    """Occurrences of intervals over suffixes (``owner``: row of the table), named by what parts them."""
    length, first, last = np.array(found, np.int64).reshape(-1, 3).T
    part = part.take(pa.array(owner[first])).to_pylist()
    names = pa.array([f"{x}.{n}.{k}" for k, (x, n) in enumerate(zip(part, length.tolist()))], pa.string())
    n = last - first + 1
    group = np.repeat(np.arange(n.size), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[group]
    rows = pa.array(owner[at])
    return pa.table({"repeat": names.take(pa.array(group)), "length": pa.array(length[group].astype(np.int32)), "h": table.column("h").take(rows),
                     "cd": table.column("cd").take(rows), "s": pa.array(place[at].astype(np.int32))})


def _hot_suffixes(ctx: DataFrame, size: int) -> DataFrame:
    """Suffixes (``tail``, from byte ``s`` on, with the byte ``before``; -1: none) of the contexts of anchors with very many, with the prefix
    of ``size`` bytes that parts them (``window``: with anchor and place). Only prefixes that stand several times stay."""
    one = ctx.select("h", "cd", "off", "ctx", F.explode(F.sequence(F.lit(0), F.octet_length("ctx") - size)).alias("s"))
    before = F.when(F.col("s") > 0, F.conv(F.hex(F.expr("substring(ctx, s, 1)")), 16, 10).cast("int")).otherwise(-1)
    one = one.select("h", "cd", "s", F.concat_ws(".", "h", F.col("off") - F.col("s"), F.md5(F.expr(f"substring(ctx, s + 1, {size})"))).alias("window"),
                     before.alias("before"), F.expr("substring(ctx, s + 1)").alias("tail"))
    one = materialize(one)
    return one.join(one.groupBy("window").agg(F.count("*").alias("c")).where("c > 1").select("window"), "window", "left_semi")


def maximal_repeats(docs: DataFrame, size: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Maximal repeat groups with all their occurrences: ``repeat``, ``length``, id, ``start`` (bytes).

    A group is a left-diverse common-prefix interval of the suffix array of the contexts of one anchor (at most about twice ``size``
    bytes long, so a longer repeat comes as a chain of overlapping groups), or a context that stands several times. Anchors with very many
    contexts are parted by place and first ``size`` bytes, with one suffix array each; an interval lies in one of them.
    """
    docs = keyed(docs, doc_id, text)
    found = candidates(docs, Bytes(size))
    folded, few, many = _split(found)

    def work(table: pa.Table) -> pa.Table:
        at, owner, begin, _, got = _scan(table.column("ctx").to_pylist(), size)
        return _groups(table, table.column("h"), owner, at - begin[owner], got)

    def work_hot(table: pa.Table) -> pa.Table:
        tails = table.column("tail").to_pylist()
        lengths = np.array([len(x) for x in tails], np.int64)
        stop = np.cumsum(lengths)
        order, common = suffix_order(np.frombuffer(b"".join(tails), np.uint8), stop - lengths, stop, size)
        left = table.column("before").to_numpy().astype(np.int64)[order]
        return _groups(table, table.column("window"), order, table.column("s").to_numpy()[order], list(intervals(common, left, size)))

    groups = _bucketed(few).groupBy("bucket").applyInArrow(work, _GROUPS)
    hot = _bucketed(_hot_suffixes(many, size), "window").groupBy("bucket").applyInArrow(work_hot, _GROUPS)
    copies = folded.where("held > 1").select(F.concat_ws(".", F.lit("copy"), "h", "cd").alias("repeat"), (F.col("n") + size - 1).cast("int").alias("length"),
                                             "h", "cd", F.lit(0).alias("s"))
    every = groups.unionByName(hot).unionByName(copies)
    return occurrences(found, every, "repeat", "length", "s").select("repeat", "length", F.col("doc").alias(doc_id), (F.col("start") + F.col("s")).alias("start"))


def remove_repeats(docs: DataFrame, size: int = 200, doc_id: str = "doc_id", text: str = "text", keep_bytes: bool = False) -> DataFrame:
    """Per row: id, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs), ``kept_sha256``; with ``keep_bytes`` also ``kept``.

    A byte is removed if a string of ``size`` bytes that covers it stands anywhere else, in the same document too; strings are judged on
    the input. Texts count as UTF-8 (null: empty); matches stay within a document. A repeated row is somewhere else; ids may be null or
    repeated.
    """
    docs = keyed(docs, doc_id, text)
    gone = repeated_stretches(docs, size).groupBy("doc", "t").agg(F.array_sort(F.collect_list("s")).alias("s"), F.array_sort(F.collect_list("e")).alias("e"))

    def drop(batches):
        for batch in batches:
            sizes, removed, spans, sha, kept = [], [], [], [], []
            for i in range(batch.num_rows):
                raw = batch.column(1)[i].as_py()
                raw = raw.encode() if raw else b""
                s, e = batch.column(2)[i].as_py(), batch.column(3)[i].as_py()
                out, at, n, runs = [], 0, 0, 0
                if s:  # the k-th start and the k-th end, both in order, bound the same union
                    depth_end, k = 0, 0
                    while k < len(s):
                        first = s[k]
                        depth_end = e[k]
                        while k + 1 < len(s) and s[k + 1] <= depth_end:
                            k += 1
                            depth_end = e[k]
                        out.append(raw[at:first])
                        at, n, runs, k = depth_end, n + depth_end - first, runs + 1, k + 1
                out.append(raw[at:])
                rest = b"".join(out)
                sizes.append(len(raw))
                removed.append(n)
                spans.append(runs)
                sha.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest if keep_bytes else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()),
                                              pa.array(sha, pa.string()), pa.array(kept, pa.binary())],
                                             names=[doc_id, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    out = finish(docs, gone, drop, f"`{doc_id}` long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out if keep_bytes else out.drop("kept")
