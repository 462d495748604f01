"""Substring dedup of words with prefix-partitioned suffix trees."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import nptext
from .contexts import LAST, Spaced, candidates, finish, items_of, keyed, occurrences
from .tables import materialize

#: Contexts of one group of subtrees, about; and contexts under one prefix above which the prefix is lengthened to whole windows.
GROUP, HOT = 8_000, 16_000


def suffixes(contexts: list[bytes], size: int, whole: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted suffixes of ``size`` words or more (``whole``: only the contexts themselves): context, place, length, and common words with
    the one before."""
    words = [c.split(b" ") for c in contexts]
    lengths = np.array([len(w) for w in words], np.int64)
    number: dict[bytes, int] = {}
    flat = np.array([number.setdefault(x, len(number)) for w in words for x in w], np.int32)
    n = np.ones_like(lengths) if whole else lengths - size + 1
    owner = np.repeat(np.arange(len(words)), n)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    left = lengths[owner] - place
    begin = (np.cumsum(lengths) - lengths)[owner] + place
    longest = int(left.max(initial=size))
    grid = np.full((owner.size, longest), -1, np.int32)
    for c in range(longest):
        has = left > c
        grid[has, c] = flat[begin[has] + c]
    order = np.lexsort(grid.T[::-1])
    grid = grid[order]
    common = np.zeros(order.size, np.int64)
    if order.size > 1:
        differ = (grid[1:] != grid[:-1]) | (grid[1:] < 0)
        common[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), longest)
    return owner[order], place[order], left[order], common


def deep_nodes(common: np.ndarray, least: int):
    """Internal nodes of the suffix tree, ``least`` words deep or deeper: (depth, first leaf, last leaf, whether no deep node is above)."""
    stack: list[list[int]] = []
    n = common.size
    values = common.tolist() + [0]
    for i in range(1, n + 1):
        now, first = values[i], i - 1
        while stack and stack[-1][0] > now:
            depth, first = stack.pop()
            yield depth, first, i - 1, not stack and now < least
        if now >= least and (not stack or stack[-1][0] < now):
            stack.append([now, first])


def _tree_minima(ctx: DataFrame, size: int) -> DataFrame:
    """Per context (h, cd) and run of windows (places ``i`` to ``j``) with an earlier document: the smallest document rank that holds them."""

    def work(table: pa.Table) -> pa.Table:
        owner, place, _, common = suffixes(table.column("ctx").to_pylist(), size)
        rank = table.column("least").to_numpy()[owner]
        best = rank.copy()
        for _, first, last, top in deep_nodes(common, size):
            if top:  # all suffixes with these first words; nodes below are longer repeats of fewer of them
                best[first:last + 1] = rank[first:last + 1].min()
        hit = best < table.column("most").to_numpy()[owner]
        order = np.lexsort((place[hit], owner[hit]))
        owner, place, best = owner[hit][order], place[hit][order], best[hit][order]
        new = np.ones(owner.size, bool)
        new[1:] = (owner[1:] != owner[:-1]) | (place[1:] != place[:-1] + 1) | (best[1:] != best[:-1])
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [owner.size]]) - 1 if first.size else first
        rows = pa.array(owner[first])
        return pa.table({"h": table.column("h").take(rows), "cd": table.column("cd").take(rows), "i": pa.array(place[first].astype(np.int32)),
                         "j": pa.array(place[last].astype(np.int32)), "best": pa.array(best[first])})

    groups = max(1, -(-ctx.count() // GROUP))
    ctx = ctx.withColumn("bucket", F.pmod(F.xxhash64("h"), F.lit(groups)))
    return ctx.select("bucket", "h", "cd", "ctx", "least", "most").groupBy("bucket").applyInArrow(work, "h long, cd long, i int, j int, best long")


def _long_prefix_minima(ctx: DataFrame, size: int) -> DataFrame:
    """The same where one anchor has very many contexts: its suffixes are parted by prefixes of ``size`` words. Such a part is one
    deep node, so its minimum is an aggregation."""
    one = ctx.withColumn("words", F.split(F.decode("ctx", "utf-8"), " "))
    one = one.select("h", "cd", "most", "least", "off", "words", F.explode(F.sequence(F.lit(0), F.size("words") - size)).alias("i"))
    one = one.select("h", "cd", "i", "least", "most", (F.col("off") - F.col("i")).alias("place"),
                     F.md5(F.array_join(F.slice("words", F.col("i") + 1, F.lit(size)), " ").cast("binary")).alias("window"))
    nodes = one.groupBy("h", "place", "window").agg(F.min("least").alias("best"))
    return one.join(nodes, ["h", "place", "window"]).where("best < most").select("h", "cd", "i", F.col("i").alias("j"), "best")


def repeated_windows(docs: DataFrame, size: int) -> DataFrame:
    """(doc, t, s, e): stretches of words of each document under windows of ``size`` words that also start in an earlier document."""
    found = candidates(docs, Spaced(size))
    folded = materialize(found.groupBy("h", "cd").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.first("n").alias("n")))
    several = materialize(folded.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1"))
    items = materialize(items_of(found, several).join(folded.select("h", "cd", "least", "most"), ["h", "cd"]))
    trees = _tree_minima(items.where(F.col("kinds") <= HOT), size).unionByName(_long_prefix_minima(items.where(F.col("kinds") > HOT), size))
    alone = folded.where("least < most").join(several, "h", "left_anti").select("h", "cd", F.lit(0).alias("i"), (F.col("n") - 1).alias("j"), F.col("least").alias("best"))
    minima = materialize(trees.unionByName(alone))
    hits = occurrences(found, minima, "i", "j", "best").where(F.col("best") < F.coalesce("doc", F.lit(LAST)))
    return hits.select("doc", "t", (F.col("start") + F.col("i")).alias("s"), (F.col("start") + F.col("j") + size).alias("e"))


def _hot_suffixes(ctx: DataFrame, size: int) -> DataFrame:
    """Suffixes (``ctx`` from word ``i`` on) of the contexts of anchors with very many, with the prefix of ``size`` words that parts
    them (``window``: with anchor and place). Only prefixes that stand several times stay."""
    one = ctx.withColumn("words", F.split(F.decode("ctx", "utf-8"), " "))
    one = one.select("h", "cd", "off", "words", F.explode(F.sequence(F.lit(0), F.size("words") - size)).alias("i"))
    prefix = F.md5(F.array_join(F.slice("words", F.col("i") + 1, F.lit(size)), " ").cast("binary"))
    one = one.select("h", "cd", "i", F.concat_ws(".", "h", F.col("off") - F.col("i"), prefix).alias("window"),
                     F.array_join(F.slice("words", F.col("i") + 1, F.size("words")), " ").cast("binary").alias("ctx"))
    one = materialize(one)
    return one.join(one.groupBy("window").agg(F.count("*").alias("c")).where("c > 1").select("window"), "window", "left_semi")


def repeats(docs: DataFrame, size: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Deep internal nodes as repeats within the contexts of one anchor: ``repeat``, ``length`` (words), id and ``start`` of each occurrence.

    Repeats that reach over several contexts come as overlapping ones; a context that stands several times is one too. Anchors with very
    many contexts are parted by place and first ``size`` words, with one subtree each; a deep node lies in one of them.
    """
    docs = keyed(docs, doc_id, text)
    found = candidates(docs, Spaced(size))
    held = materialize(found.groupBy("h", "cd").agg(F.sum("held").alias("held"), F.first("n").alias("n")))
    several = materialize(held.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1"))
    items = materialize(items_of(found, several))

    def nodes(rows: DataFrame, key: str, whole: bool) -> DataFrame:
        """Deep nodes over the suffixes of ``ctx`` (``whole``: over ``ctx`` itself, which starts at ``i``); ``key`` parts them."""

        def work(table: pa.Table) -> pa.Table:
            owner, place, _, common = suffixes(table.column("ctx").to_pylist(), size, whole)
            place = place + table.column("i").to_numpy()[owner]
            got = np.array([x[:3] for x in deep_nodes(common, size)], np.int64).reshape(-1, 3)
            depth, first, last = got.T
            part = table.column(key).take(pa.array(owner[first])).to_pylist()
            names = pa.array([f"{x}.{d}.{k}" for k, (x, d) in enumerate(zip(part, depth.tolist()))], pa.string())
            n = last - first + 1
            node = np.repeat(np.arange(n.size), n)
            leaf = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[node]
            own = pa.array(owner[leaf])
            return pa.table({"repeat": names.take(pa.array(node)), "length": pa.array(depth[node].astype(np.int32)), "h": table.column("h").take(own),
                             "cd": table.column("cd").take(own), "i": pa.array(place[leaf].astype(np.int32))})

        groups = max(1, -(-rows.count() // GROUP))
        rows = rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(groups))).select("bucket", "h", "cd", "i", "ctx", *({key} - {"h"}))
        return rows.groupBy("bucket").applyInArrow(work, "repeat string, length int, h long, cd long, i int")

    few, many = items.where(F.col("kinds") <= HOT), items.where(F.col("kinds") > HOT)
    trees = nodes(few.withColumn("i", F.lit(0)), "h", False).unionByName(nodes(_hot_suffixes(many, size), "window", True))
    copies = held.where("held > 1").select(F.concat_ws(".", F.lit("copy"), "h", "cd").alias("repeat"), (F.col("n") + size - 1).cast("int").alias("length"), "h", "cd", F.lit(0).alias("i"))
    return occurrences(found, trees.unionByName(copies), "repeat", "length", "i").select(
        "repeat", "length", F.col("doc").alias(doc_id), (F.col("start") + F.col("i")).alias("start"))


def remove_repeats(docs: DataFrame, size: int = 13, doc_id: str = "doc_id", text: str = "text", keep_text: bool = False) -> DataFrame:
    """Per row: id, ``n_words``, ``n_removed``, ``kept_sha256`` (of the kept words joined by one blank); with ``keep_text`` also ``kept``.

    A word is removed if a window of ``size`` words of its document that covers it also starts in a document with a smaller id;
    windows are judged on the input. Words have no ASCII white space and stay as they are (null: none). Documents without an id come
    after all others and leave each other alone, as do rows with the same id.
    """
    docs = keyed(docs, doc_id, text)
    gone = repeated_windows(docs, size).groupBy("doc", "t").agg(F.collect_list("s").alias("s"), F.collect_list("e").alias("e"))

    def drop(batches):
        for batch in batches:
            for i, j, w in _blocks(batch.column(1)):
                n, removed, sha, kept = np.diff(w.first), [], [], []
                for d in range(j - i):
                    first, last = batch.column(2)[i + d].as_py(), batch.column(3)[i + d].as_py()
                    gone = np.zeros(int(n[d]) + 1, np.int64)
                    if first:
                        np.add.at(gone, np.array(first), 1)
                        np.add.at(gone, np.array(last), -1)
                    stay = np.flatnonzero(np.cumsum(gone)[:-1] == 0) + int(w.first[d])
                    rest = b" ".join([w.data[a:b].tobytes() for a, b in zip(w.start[stay].tolist(), w.end[stay].tolist())])
                    removed.append(int(n[d]) - stay.size)
                    sha.append(hashlib.sha256(rest).hexdigest())
                    kept.append(rest.decode() if keep_text else None)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n.astype(np.int64)), pa.array(removed, pa.int64()),
                                                  pa.array(sha, pa.string()), pa.array(kept, pa.string())],
                                                 names=[doc_id, "n_words", "n_removed", "kept_sha256", "kept"])

    out = finish(docs, gone, drop, f"`{doc_id}` long, n_words long, n_removed long, kept_sha256 string, kept string")
    return out if keep_text else out.drop("kept")


def _blocks(column: pa.Array):
    data, offsets = nptext.arrow_bytes(column)
    for i, j in nptext.blocks(offsets):
        yield i, j, nptext.Words(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], nptext.SPACED)
