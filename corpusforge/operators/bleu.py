"""BLEU of synthetic texts against a reference corpus and against each other.

All n-gram counts of a group are aggregated, by 64-bit hashes, in turns of a part of them each; no text is compared with another text.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import LABELS
from ..functions.text import ngrams_of, words
from ..session import materialize
from .lengths import drop_null_text

ORDERS = (1, 2, 3, 4)
SMOOTHING = 0.1
#: Words whose n-grams are counted at once.
_WORDS = 1 << 18
#: Groups of n-grams to a shuffle partition, and turns in which all n-grams are compared: more turns hold less disk, and count the texts again.
_PARTS, ROUNDS = 4, 3


def _worded(corpus: DataFrame, by: list[str], key: str) -> DataFrame:
    return drop_null_text(corpus).select(*by, F.col(key).alias("k"), words("text", lower=True).alias("w")).withColumn(
        "hl", F.size("w"))


def _row(by: list[str]) -> Column:
    return F.xxhash64(*by, "k")


def _grams(worded: DataFrame, by: list[str]) -> DataFrame:
    """(g, row, nc) for each n-gram of each text, as ``_packed`` has them."""
    packed = reduce(DataFrame.unionByName, [_packed(worded, by, 1, k) for k in range(ROUNDS)])
    return packed.select(F.inline(F.arrays_zip("g", "row", "nc")))


def _packed(worded: DataFrame, by: list[str], parts: int, turn: int, rows: bool = True) -> DataFrame:
    """The n-grams of each text, packed by the task ``p`` that compares them: ``g``, a 64-bit hash of group, order and words, ``row``, the hash of
    group and key, and count and order in one number, ``4 * count + n - 1``.

    Texts are counted where they lie, rows of one key together, so that only these numbers go through the shuffle, once, and no task
    holds the n-grams of more than a few texts. A ``turn`` has its share of all n-grams; ``rows`` are left out where nothing asks for them.
    """
    texts = worded.select(*by, "k", F.transform("w", lambda x: F.xxhash64(x)).alias("w")).groupBy(*by, "k").agg(F.collect_list("w").alias("ws"))
    texts = texts.select(F.xxhash64(*by).alias("grp"), _row(by).alias("row"), "ws")
    return texts.mapInArrow(_count_batches(parts, turn, rows), "p int, g array<long>, row array<long>, nc array<int>")


def _count_batches(parts: int, turn: int, rows: bool):
    def work(batches):
        for batch in batches:
            ws = batch.column("ws")
            inner, at = ws.flatten(), ws.offsets.to_numpy() - ws.offsets[0].as_py()  # texts of a row
            stops = np.concatenate([[0], np.cumsum(inner.value_lengths().to_numpy())]).astype(np.int64)  # words of a text
            words_of = inner.flatten().to_numpy().view(np.uint64)
            grp, row = (batch.column(c).to_numpy().view(np.uint64) for c in ("grp", "row"))
            ends, i = stops[at], 0  # words of a row
            while i < len(row):
                j = max(i + 1, int(np.searchsorted(ends, ends[i] + _WORDS, side="right")) - 1)
                texts = np.repeat(np.arange(at[i], at[j]), np.diff(stops[at[i]:at[j] + 1]))
                g, r, nc = count_grams(words_of[ends[i]:ends[j]], texts, np.repeat(np.arange(i, j), np.diff(ends[i:j + 1])), grp)
                mine = np.flatnonzero((g >> np.uint64(8)) % np.uint64(ROUNDS) == np.uint64(turn))
                g, r, nc = g[mine], r[mine], nc[mine]
                p = ((g >> np.uint64(20)) % np.uint64(parts)).astype(np.int32)
                order = np.argsort(p, kind="stable")
                which, first = np.unique(p[order], return_index=True)
                bounds = pa.array(np.append(first, len(p)).astype(np.int32))
                packed = lambda x, kind: pa.ListArray.from_arrays(bounds, pa.array(x[order], kind))
                lists = [packed(g.view(np.int64), pa.int64()), packed(row.view(np.int64)[r], pa.int64()) if rows else pa.nulls(len(which), pa.list_(pa.int64())), packed(nc, pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(which), *lists], names=["p", "g", "row", "nc"])
                i = j

    return work


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def count_grams(words_of: np.ndarray, text: np.ndarray, row: np.ndarray, grp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams of each row as (hash, row, 4 * count + n - 1), from the word hashes of its texts; no n-gram crosses two texts."""
    out = []
    h = _mixed(words_of ^ grp[row])
    for n in ORDERS:
        if n > 1:
            inside = text[n - 1:] == text[:len(text) - n + 1]
            h = _mixed(h[:len(inside)] * np.uint64(0x9E3779B97F4A7C15) + words_of[n - 1:] + np.uint64(n))
            g, r = h[inside], row[:len(inside)][inside]
        else:
            g, r = h, row
        _, first, count = np.unique(g + _mixed(r.astype(np.uint64) + np.uint64(1)), return_index=True, return_counts=True)
        order = np.argsort(first)
        first = first[order]
        out.append((g[first], r[first], 4 * count[order] + n - 1))
    return tuple(np.concatenate(x) for x in zip(*out))


def _tally(table, refs) -> pa.Table:
    """Of the n-grams of some texts that are compared here, and those of the references, per text and order: ``l``, by how much it holds
    n-grams more often than any other text, and ``m``, how many the references match."""
    flat = lambda t, c: t.column(c).combine_chunks().flatten().to_numpy()
    g, row, nc = (flat(table, c) for c in ("g", "row", "nc"))
    order = np.lexsort((nc, g))
    g, row, n, count = g[order], row[order], nc[order] % 4, nc[order].astype(np.int64) >> 2
    rows, at = np.unique(row, return_inverse=True)
    sums = np.zeros((2, len(rows), len(ORDERS)), np.int64)
    same = g[1:] == g[:-1]
    last = np.flatnonzero(np.append(~same, np.ones(min(len(g), 1), bool)))  # the largest count of each n-gram
    second = np.where(np.append(np.zeros(min(len(g), 1), bool), same)[last], count[last - 1], 0)
    np.add.at(sums[0], (at[last], n[last]), np.where(count[last] > second, count[last] - second, 0))
    if refs is not None:
        known, cap = flat(refs, "g"), flat(refs, "nc")
        order = np.lexsort((cap, known))
        known, cap = known[order], cap[order].astype(np.int64) >> 2
        place = np.searchsorted(known, g, side="right") - 1  # the largest count of each n-gram
        hit = np.flatnonzero((place >= 0) & (known[np.maximum(place, 0)] == g)) if len(known) else np.zeros(0, np.int64)
        np.add.at(sums[1], (at[hit], n[hit]), np.minimum(count[hit], cap[place[hit]]))
    return pa.table([pa.array(rows, pa.int64()), *[pa.array(sums[i, :, k]) for i in (0, 1) for k in range(len(ORDERS))]], names=["row", *_TALLIES])


_TALLIES = [f"{x}{n}" for x in "lm" for n in ORDERS]


def _tallies(h: DataFrame, r: DataFrame | None, by: list[str]) -> DataFrame:
    """Written sums of ``_tally`` per text (``row``)."""
    parts = _PARTS * int(h.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "row long, " + ", ".join(f"{c} long" for c in _TALLIES)
    total = lambda df: materialize(df.groupBy("row").agg(*[F.sum(c).alias(c) for c in _TALLIES]))

    def turn(k: int) -> DataFrame:
        mine = _packed(h, by, parts, k).groupBy("p")
        if r is None:
            return mine.applyInArrow(lambda t: _tally(t, None), schema)
        return mine.cogroup(_packed(r, by, parts, k, rows=False).groupBy("p")).applyInArrow(lambda t, refs: _tally(t, refs), schema)

    # the shuffle files of a turn go before the next
    return total(reduce(DataFrame.unionByName, [total(turn(k)) for k in range(ROUNDS)]))


def _with_sums(worded: DataFrame, sums: DataFrame, by: list[str], name: str) -> DataFrame:
    """Texts with their sums, 0 where there are none; a text without a key has none."""
    row = F.when(F.col("k").isNotNull(), _row(by))
    sums = sums.select("row", *[f"{name}{n}" for n in ORDERS])
    return worded.select(*by, "k", "hl", row.alias("row")).join(sums, "row", "left").drop("row").na.fill(0, [f"{name}{n}" for n in ORDERS])


def _nearest(lengths: DataFrame, by: list[str]) -> DataFrame:
    """(by, hl, rl): nearest reference length of each hypothesis length, the shorter on ties.

    ``lengths`` holds one row per distinct length with counts ``hyps`` and ``refs`` and a flag
    ``own`` telling that the hypothesis itself is among the references of its length.
    """
    order = Window.partitionBy(*by).orderBy("hl")
    usable = F.when(F.col("refs") > 0, F.col("hl"))
    below = F.last(usable, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    above = F.first(usable, ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    near = (
        F.when(F.col("refs") > F.col("own").cast("int"), F.col("hl"))
        .when(F.col("below").isNull(), F.col("above"))
        .when(F.col("above").isNull(), F.col("below"))
        .when(F.col("hl") - F.col("below") <= F.col("above") - F.col("hl"), F.col("below"))
        .otherwise(F.col("above"))
    )
    return lengths.withColumns({"below": below, "above": above}).where("hyps > 0").select(*by, "hl", near.alias("rl"))


def _score(clipped: DataFrame, nearest: DataFrame, by: list[str]) -> DataFrame:
    """BLEU per text from clipped counts m1..m4, its length ``hl`` and the nearest reference length."""
    logs: Column = F.lit(0.0)
    for n in ORDERS:
        total = F.greatest(F.lit(1), F.col("hl") - (n - 1))
        top = F.when(F.col(f"m{n}") == 0, F.lit(SMOOTHING)).otherwise(F.col(f"m{n}").cast("double"))
        logs = logs + 0.25 * F.log(top / total)
    brevity = F.when(F.col("hl") > F.col("rl"), F.lit(1.0)).otherwise(F.exp(1 - F.try_divide("rl", "hl")))
    bleu = F.when((F.col("m1") == 0) | (F.col("hl") == 0), F.lit(0.0)).otherwise(brevity * F.exp(logs))
    return clipped.join(nearest, by + ["hl"]).select(*by, "k", bleu.alias("bleu"))


def bleu_scores(hyps: DataFrame, refs: DataFrame, by: list[str], key: str = "id") -> DataFrame:
    """Sentence BLEU of each hypothesis with every reference text of its group as reference."""
    h, r = _worded(hyps, by, key), _worded(refs, by, key)
    return _bleu(h, r, _tallies(h, r, by), by, key)


def _bleu(h: DataFrame, r: DataFrame, tallies: DataFrame, by: list[str], key: str) -> DataFrame:
    clipped = _with_sums(h, tallies, by, "m")
    lengths = (
        h.groupBy(*by, "hl").agg(F.count(F.lit(1)).alias("hyps"), F.lit(0).alias("refs"))
        .unionByName(r.groupBy(*by, "hl").agg(F.lit(0).alias("hyps"), F.count(F.lit(1)).alias("refs")))
        .groupBy(*by, "hl").agg(F.sum("hyps").alias("hyps"), F.sum("refs").alias("refs"))
        .withColumn("own", F.lit(False))
    )
    return _score(clipped, _nearest(lengths, by), by).where(F.col("bleu").isNotNull()).withColumnRenamed("k", key)


def self_bleu_scores(corpus: DataFrame, by: list[str], key: str = "id") -> DataFrame:
    """Sentence BLEU of each text with all other texts of its group as references.

    A text loses matches only on n-grams it holds more often than any other text; each such
    n-gram is charged to its single owner, down to the second-largest count.
    """
    worded = _worded(corpus, by, key)
    return _self_bleu(worded, _tallies(worded, None, by), by, key)


def _self_bleu(worded: DataFrame, tallies: DataFrame, by: list[str], key: str) -> DataFrame:
    clipped = _with_sums(worded, tallies, by, "l").select(
        *by, "k", "hl", *[(F.greatest(F.lit(0), F.col("hl") - (n - 1)) - F.col(f"l{n}")).alias(f"m{n}") for n in ORDERS])
    lengths = worded.groupBy(*by, "hl").agg(F.count(F.lit(1)).alias("refs")).withColumns(
        {"hyps": F.col("refs"), "own": F.lit(True)})
    return _score(clipped, _nearest(lengths, by), by).withColumn(
        "bleu", F.coalesce("bleu", F.lit(0.0))).withColumnRenamed("k", key)


def _mean_self(scores: DataFrame, by: list[str]) -> DataFrame:
    return scores.groupBy(*by).agg(F.avg("bleu").alias("self_bleu"))


def _mean_vs_ref(hyps: DataFrame, scores: DataFrame, by: list[str]) -> DataFrame:
    groups = drop_null_text(hyps).select(*by).distinct()
    means = scores.groupBy(*by).agg(F.avg("bleu").alias("bleu_vs_ref"))
    return groups.join(means, by, "left").withColumn("bleu_vs_ref", F.coalesce("bleu_vs_ref", F.lit(0.0)))


def self_bleu(corpus: DataFrame, by: list[str], key: str = "id") -> DataFrame:
    """Mean self-BLEU per group; 0.0 for a single text."""
    return _mean_self(self_bleu_scores(corpus, by, key), by)


def bleu_vs_ref(hyps: DataFrame, refs: DataFrame, by: list[str], key: str = "id") -> DataFrame:
    """Mean BLEU per group against the reference corpus; 0.0 for a group without references."""
    return _mean_vs_ref(hyps, bleu_scores(hyps, refs, by, key), by)


def bleu_report(corpus: DataFrame, key: str = "id") -> DataFrame:
    """Per language: macro means over labels and the value of each label."""
    by = ["lang", "label"]
    syn, seed = corpus.where("corpus = 'syn'"), corpus.where("corpus = 'seed'")
    h, r = _worded(syn, by, key), _worded(seed, by, key)
    tallies = _tallies(h, r, by)  # one shuffle for both reports
    both = _mean_self(_self_bleu(h, tallies, by, key), by).join(_mean_vs_ref(syn, _bleu(h, r, tallies, by, key), by), by)
    cell = lambda c, x, name: F.max(F.when(F.col("label") == x, F.col(c))).alias(f"{x[:3]}_{name}")
    return both.groupBy("lang").agg(
        F.avg("self_bleu").alias("macro_self_bleu"), F.avg("bleu_vs_ref").alias("macro_bleu_vs_seed"),
        *[c for x in LABELS for c in (cell("self_bleu", x, "self_bleu"), cell("bleu_vs_ref", x, "bleu_seed"))])
