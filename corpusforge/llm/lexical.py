"""Ranked lexical search without an index: documents are scanned with a broadcast Aho-Corasick automaton of all item terms."""

from __future__ import annotations

import math
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import nptext
from .tables import materialize

#: Items go out in blocks: at most so many items times terms (cells of the score matrix of a task), or one item.
CELLS = 1 << 22
SEPARATOR = 32
#: Terms are runs of digits, ASCII letters (in lower case) and non-ASCII characters; every other byte becomes the separator.
_TERM = np.array([SEPARATOR if not w else b for w, b in zip(nptext.ALNUM[nptext.LOWER], nptext.LOWER)], np.uint8)


def terms_of(text: str | None) -> list[str]:
    """Terms of a text in order, as bytes written in Latin-1 characters (as the automaton reads them)."""
    return _TERM[np.frombuffer((text or "").encode(), np.uint8)].tobytes().decode("latin-1").split(" ") if text else []


class Items:
    """A block of items: number of each term, and per (term, item) how often it stands there."""

    def __init__(self):
        self.items: list = []
        self.terms: dict[str, int] = {}
        self.links: list[tuple[int, int, int]] = []

    def add(self, item, text: str | None) -> None:
        for term, n in Counter(t for t in terms_of(text) if t).items():
            self.links.append((self.terms.setdefault(term, len(self.terms)), len(self.items), n))
        self.items.append(item)

    def full(self) -> bool:
        return len(self.items) * len(self.terms) > CELLS

    def automaton(self) -> ahocorasick.Automaton:
        """All terms with a separator on both sides, so that only whole terms match."""
        out = ahocorasick.Automaton()
        for term, number in self.terms.items():
            out.add_word(f" {term} ", number)
        if self.terms:
            out.make_automaton()
        return out

    def matrix(self, weights: np.ndarray) -> np.ndarray:
        """Weight of each term in each item."""
        out = np.zeros((len(self.terms), len(self.items)))
        if self.links:
            t, i, n = np.array(self.links, np.int64).T
            out[t, i] = n * weights[t]
        return out


def scan(docs: DataFrame, items: Items) -> DataFrame:
    """Per document its number of terms ``n`` and, as lists, the item terms in it and how often each stands there."""
    shared = docs.sparkSession.sparkContext.broadcast(list(items.terms))

    def look(batches):
        block = Items()
        block.terms = {t: i for i, t in enumerate(shared.value)}
        automaton, any_term = block.automaton(), bool(block.terms)
        for batch in batches:
            data, offsets = nptext.arrow_bytes(batch.column(1))
            for i, j in nptext.blocks(offsets):
                part = _TERM[data[offsets[i]:offsets[j]]]
                at = offsets[i:j + 1] - offsets[i]
                inside = part != SEPARATOR
                begins = inside.copy()
                begins[1:] &= ~inside[:-1]
                edge = at[:-1][at[:-1] < part.size]
                begins[edge] = inside[edge]
                sums = np.concatenate([[0], np.cumsum(begins)])
                text = part.tobytes().decode("latin-1")
                found = [Counter(t for _, t in automaton.iter(f" {text[a:e]} ")) if any_term and e > a else {} for a, e in zip(at[:-1].tolist(), at[1:].tolist())]
                stops = pa.array(np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32))
                flat = [np.fromiter((x for f in found for x in pick(f)), np.int32) for pick in (dict.keys, dict.values)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(sums[at])),
                                                  *[pa.ListArray.from_arrays(stops, pa.array(x)) for x in flat]], names=["doc", "n", "terms", "tfs"])

    return docs.mapInArrow(look, "doc long, n long, terms array<int>, tfs array<int>")


def _frequencies(found: DataFrame, size: int) -> np.ndarray:
    """In how many documents each term stands; ``size`` numbers at most reach the driver."""

    def count(batches):
        sums = np.zeros(size, np.int64)
        for batch in batches:
            sums += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(sums[some])], names=["term", "df"])

    got = found.select("terms").mapInArrow(count, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(size, np.int64)
    out[got.column("term").to_numpy().astype(np.int64)] = got.column("df").to_numpy()
    return out


class Best:
    """The ``k`` best documents so far of each item: higher scores first, ties to the smaller id (null first)."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.rows = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * items
        self.bar = np.ones(items, np.int64)

    def add(self, docs: np.ndarray, scores: np.ndarray) -> None:
        if len(docs) > self.k:
            least = np.maximum(self.bar, np.partition(scores, len(docs) - self.k, axis=0)[len(docs) - self.k])
        else:
            least = self.bar
        good = scores >= least
        for i in np.flatnonzero(good.any(axis=0)):
            at = np.flatnonzero(good[:, i])
            d = np.concatenate([self.rows[i][0], docs[at]])
            s = np.concatenate([self.rows[i][1], scores[at, i]])
            order = np.lexsort((d, -s))[:self.k]
            self.rows[i] = d[order], s[order]
            if order.size == self.k:
                self.bar[i] = s[order[-1]]


#: Stands for a null document id in a task: sorts before all others.
_NULL = np.iinfo(np.int64).min


def _rank(found: DataFrame, items: Items, weights: np.ndarray, whole: int, terms: int, k: int) -> DataFrame:
    """Per task and item the ``k`` best documents; ``whole`` documents have ``terms`` terms in all."""
    shared = found.sparkSession.sparkContext.broadcast((items, weights))

    def go(batches):
        items, weights = shared.value
        matrix = items.matrix(weights)
        width = matrix.shape[0]
        # doubles are exact as long as no score can reach 2**53: a term adds at most 1,000,000 times its weight
        exact = matrix.sum(axis=0).max(initial=0) * 1_000_000 < 2.0**53
        matrix = matrix if exact else matrix.astype(np.int64)
        best = Best(matrix.shape[1], k)
        step = max(1, min(1024, CELLS // max(width, 1)))
        for batch in batches:
            ids = batch.column(0).fill_null(_NULL).to_numpy()
            n = batch.column(1).to_numpy()
            m = 100 - 25 + (25 * n * whole) // terms if terms else n
            sizes = batch.column(2).value_lengths().to_numpy()
            stop = np.concatenate([[0], np.cumsum(sizes)])
            term, tf = batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy().astype(np.int64)
            row = np.repeat(np.arange(batch.num_rows), sizes)
            part = (1_000_000_000 * tf) // (1000 * tf + 12 * m[row])
            for a in range(0, batch.num_rows, step):
                e = min(a + step, batch.num_rows)
                i, j = stop[a], stop[e]
                if i < j:
                    dense = np.zeros((e - a, width), matrix.dtype)
                    dense[row[i:j] - a, term[i:j]] = part[i:j]
                    best.add(ids[a:e], (dense @ matrix).astype(np.int64))
        for i, (d, s) in enumerate(best.rows):
            if d.size:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(d.size, i, np.int32)), pa.array(d, mask=d == _NULL), pa.array(s)], names=["item", "doc", "score"])

    return found.mapInArrow(go, "item int, doc long, score long")


def _blocks_of(items: DataFrame):
    block = Items()
    for row in items.toLocalIterator():  # one partition of items at a time
        block.add(row[0], row[1])
        if block.full():
            yield block
            block = Items()
    if block.items:
        yield block


def search(docs: DataFrame, items: DataFrame, k: int, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """The ``k`` best documents of every item: item id, ``rank`` (from 1), document id, ``score`` (above 0).

    A term's weight is floor(1000 ln((2N + 2) / (2 df + 1))), N documents having terms; a document of n terms scores the sum, over the item's terms with
    repeats, of the weight times (10^9 tf) div (1000 tf + 12 m), with m = 75 + (25 n N) div L and L terms in all. Higher scores come first, then smaller
    ids (null first).

    Items are distinct rows of id and text: the same id with another text is an item of its own, ranked apart under the same id; a null id is kept.
    Null and empty texts have no terms; an item without terms, or whose terms stand in no document, has no rows. Repeated documents count and rank as often as
    they stand there. Items are sent out in blocks of bounded size, each of which scans all documents; tasks hold ``k`` rows per item of a block.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))
    items = items.select(F.col(item_id).alias("item"), F.col(text).alias("text")).distinct()
    kind = items.schema["item"].dataType
    out = items.sparkSession.createDataFrame([], f"`{item_id}` {kind.simpleString()}, rank int, `{doc_id}` long, score long")
    for block in _blocks_of(items):
        found = materialize(scan(docs, block))
        whole, terms = found.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = _frequencies(found, len(block.terms))
        weights = np.array([math.floor(1000 * math.log((2 * whole + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        near = _rank(found, block, weights, whole, terms, k)
        order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc").asc_nulls_first())
        near = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = items.sparkSession.createDataFrame(list(enumerate(block.items)), f"number int, `{item_id}` {kind.simpleString()}")
        got = near.join(names, near["item"] == names["number"]).select(F.col(f"`{item_id}`"), "rank", F.col("doc").alias(doc_id), "score")
        out = out.unionByName(materialize(got))
    return out
