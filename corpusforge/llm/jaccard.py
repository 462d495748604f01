"""Jaccard join of word shingles with adaptive multi-match prefixes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import nptext
from .components import components
from .tables import bit_filter, in_filter, materialize, null_join

#: Buckets of the frequency sketch; a fixed size for every input.
SKETCH = 1 << 20
#: A shingle enters the sketch if it stands in so many documents of one flush of a task.
REPEATED = 4
_FLUSH = 1 << 22
#: Shared prefix shingles that are asked for at least (fewer for small sets) and at most.
MATCHES = 5
MOST_MATCHES = 9
#: Rounds in which each posting list is compared with so many of its members only.
LEADERS = (1, 1)
#: Words of 64 bits in the parity bitmap of a set; a fixed size for every set.
WORDS = 8


def _sets(column: pa.Array, k: int):
    """Per block of rows: first row, one past the last, row of each distinct shingle, and the shingles (sorted by row)."""
    data, offsets = nptext.arrow_bytes(column)
    data = nptext.LOWER[data]
    for i, j in nptext.blocks(offsets):
        w = nptext.Words(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], nptext.SPACED)
        grams, docs = [], []
        for n in range(1, k + 1):
            g, at = w.grams(n)
            d = w.doc[at]
            if n < k:  # a shorter text is one shingle
                own = np.diff(w.first)[d] == n
                g, d = g[own], d[own]
            grams.append(g)
            docs.append(d)
        g, d = np.concatenate(grams), np.concatenate(docs)
        order = np.lexsort((g, d))
        g, d = g[order], d[order]
        new = np.ones(g.size, bool)
        new[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
        yield i, j, d[new], g[new]


def _bucket(g: np.ndarray) -> np.ndarray:
    return (nptext.mix(g) >> nptext.U(44)).astype(np.int64)


def _parity(d: np.ndarray, g: np.ndarray, rows: int) -> np.ndarray:
    """Per row a bitmap in which every shingle flips one bit.

    Shared shingles flip the same bits, so the bits in which two bitmaps differ are at most as many as the shingles that one set has alone.
    """
    slot = nptext.mix(g) & nptext.U(64 * WORDS - 1)
    bits = np.zeros(rows * WORDS, np.uint64)
    np.bitwise_xor.at(bits, d * WORDS + (slot >> nptext.U(6)).astype(np.int64), nptext.U(1) << (slot & nptext.U(63)))
    return bits.reshape(rows, WORDS)


def _often(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values that stand ``REPEATED`` times or more, and how often. ``grams`` is sorted in place: only such values take further room."""
    grams.sort()
    last = REPEATED - 1
    u = np.unique(grams[last:][grams[last:] == grams[:max(grams.size - last, 0)]])
    return u, np.searchsorted(grams, u, side="right") - np.searchsorted(grams, u)


def frequency_sketch(docs: DataFrame, k: int) -> np.ndarray:
    """Estimated document frequency per bucket of shingles, from those that repeat inside tasks, over all documents.

    It only orders shingles and estimates costs, so its errors cost time, not results. At most ``SKETCH`` numbers reach the driver.
    """

    def count(batches):
        held, n, sums = [], 0, np.zeros(SKETCH, np.int64)

        def flush():
            grams = np.concatenate(held)
            held.clear()
            u, c = _often(grams)
            np.add.at(sums, _bucket(u), c)

        for batch in batches:
            for _, _, _, g in _sets(batch.column(0), k):
                held.append(g)
                n += g.size
                if n >= _FLUSH:
                    flush()
                    n = 0
        if held:
            flush()
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(sums[some])], names=["bucket", "n"])

    got = docs.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SKETCH, np.int32)
    out[got.column("bucket").to_numpy().astype(np.int64)] = np.minimum(got.column("n").to_numpy(), (1 << 31) - 1)
    return out


def prefix(freq: np.ndarray, percent: int) -> tuple[int, int]:
    """Prefix length and number of shared prefix shingles to ask for, given the frequencies in the global order.

    With ``t`` the least overlap of a match, any match shares ``l`` of the first ``n - t + l`` shingles. Each step lengthens
    the prefix while the estimated candidates per asked match fall.
    """
    n = freq.size
    t = -(-percent * n // 100)
    sums = np.cumsum(np.maximum(freq, 1))
    best = min(MATCHES, t)
    least = sums[n - t + best - 1] / best
    for matches in range(best + 1, min(MOST_MATCHES, t) + 1):
        cost = sums[n - t + matches - 1] / matches
        if cost >= 0.95 * least:
            break
        best, least = matches, cost
    return n - t + best, best


def signatures(docs: DataFrame, sketch: np.ndarray, k: int, percent: int) -> DataFrame:
    """Per document (doc, t): number of shingles, 128-bit signature of the set, asked matches, parity bitmap and the prefix."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def sign(batches):
        for batch in batches:
            for i, j, d, g in _sets(batch.column(2), k):
                n = np.bincount(d, minlength=j - i)
                first = np.concatenate([[0], np.cumsum(n)])
                both = []
                for c in (0, 1):
                    run = np.concatenate([[nptext.U(0)], np.cumsum(nptext.mix(g ^ nptext._COEF[200 + c]), dtype=np.uint64)])
                    both.append(nptext.signed(run[first[1:]] - run[first[:-1]]))
                parity = nptext.signed(_parity(d, g, j - i))
                bits = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(parity[:, w])) for w in range(WORDS)], names=[f"w{w}" for w in range(WORDS)])
                f = shared.value[_bucket(g)]
                order = np.lexsort((g, f, d))
                f, s = f[order], nptext.signed(g[order])
                asked, parts, lengths = np.zeros(j - i, np.int32), [], np.zeros(j - i + 1, np.int64)
                for x in np.flatnonzero(n):
                    size, asked[x] = prefix(f[first[x]:first[x + 1]], percent)
                    parts.append(s[first[x]:first[x] + size])
                    lengths[x + 1] = size
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum(lengths).astype(np.int32)), pa.array(np.concatenate(parts) if parts else s[:0]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(n.astype(np.int64)),
                                                  pa.array(both[0]), pa.array(both[1]), pa.array(asked), bits, lists],
                                                 names=["doc", "t", "n", "s1", "s2", "l", "bits", "prefix"])

    words = ", ".join(f"w{w}: bigint" for w in range(WORDS))
    return docs.mapInArrow(sign, f"doc long, t long, n long, s1 long, s2 long, l int, bits struct<{words}>, prefix array<bigint>")


def _full_sets(rows: DataFrame, keys: DataFrame, k: int) -> DataFrame:
    """``row`` and its whole set for the rows of ``keys`` (row, doc, t).

    A bitmap of fixed size keeps most other documents from being cut into shingles and shuffled; the join is exact.
    """
    mark = F.xxhash64("doc", "t")
    shared = rows.sparkSession.sparkContext.broadcast(bit_filter(keys.select(mark.alias("h")).distinct(), "h", 1 << 23))

    def make(batches):
        for batch in batches:
            may = in_filter(shared.value, batch.column(3).to_numpy().view(np.uint64))
            batch = batch.filter(pa.array(may))
            for i, j, d, g in _sets(batch.column(2), k):
                first = np.searchsorted(d, np.arange(j - i + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i),
                                                  pa.ListArray.from_arrays(pa.array(first), pa.array(nptext.signed(g)))], names=["doc", "t", "tokens"])

    made = rows.select("doc", "t", "text", mark.alias("h")).mapInArrow(make, "doc long, t long, tokens array<bigint>")
    return null_join(keys, made, ["doc", "t"]).select("row", "tokens").dropDuplicates(["row"])


def _may(x: str, y: str, percent: int) -> str:
    """Whether a shared prefix shingle can be one of the first ``l`` that two similar sets share.

    ``x`` and ``y`` name a row each with size n, asked matches l and position pos. With sizes that allow the similarity, the sets share at least ``o``
    shingles, so the first l of them stand among the first n - o + l of either set.
    """
    o = _overlap(x, y, percent)
    l = f"least({x}l, {y}l)"
    return (f"100 * least({x}n, {y}n) >= {percent} * greatest({x}n, {y}n) "
            f"AND {x}pos < {x}n - {o} + {l} AND {y}pos < {y}n - {o} + {l}")


def _overlap(x: str, y: str, percent: int) -> str:
    """Least number of shared shingles of two similar sets of ``x``n and ``y``n shingles."""
    return f"(({percent} * ({x}n + {y}n) + {100 + percent - 1}) div {100 + percent})"


def _near(x: str, y: str, percent: int) -> str:
    """Whether the parity bitmaps allow the similarity; never false for similar sets."""
    apart = " + ".join(f"bit_count({x}bits.w{w} ^ {y}bits.w{w})" for w in range(WORDS))
    return f"{apart} <= {x}n + {y}n - 2 * {_overlap(x, y, percent)}"


def _verify(pairs: DataFrame, rows: DataFrame, keys: DataFrame, k: int, percent: int) -> DataFrame:
    """Those pairs (a, b) whose whole sets reach the similarity. Whole sets are fetched only for pairs that the bitmaps of ``keys`` allow."""
    small = keys.select("row", F.struct("n", "bits").alias("x"))
    pairs = materialize(pairs.join(small.withColumnsRenamed({"row": "a"}), "a").join(small.withColumnsRenamed({"row": "b", "x": "y"}), "b")
                        .where(_near("x.", "y.", percent)).select("a", "b"))
    some = pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct()
    sets = materialize(_full_sets(rows, materialize(keys.select("row", "doc", "t").join(some, "row", "left_semi")), k))
    left = sets.select(F.col("row").alias("a"), F.col("tokens").alias("x"))
    right = sets.select(F.col("row").alias("b"), F.col("tokens").alias("y"))
    return (pairs.join(left, "a").join(right, "b").withColumn("both", F.size(F.array_intersect("x", "y")))
            .where(f"100 * both >= {percent} * (size(x) + size(y) - both)").select("a", "b"))


def _pair(x: str, y: str):
    return F.greatest(x, y).alias("a"), F.least(x, y).alias("b")


def cluster(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80, leaders: tuple[int, ...] = LEADERS) -> DataFrame:
    """Components of the documents whose shingle sets (``k`` words) have a Jaccard similarity of ``percent`` / 100 or more.

    Words have no ASCII white space; A-Z count as a-z. Returns one row per row of ``docs``: id, ``n_shingles``,
    ``component_id`` (the smallest id reachable by links), ``text_key`` (xxhash64 of the text) and ``keep``, true for one row
    of each component (smallest id, then text key). A text without words has an empty set and is linked with nothing; rows
    with a null id take part and get the smallest id of their component (null if it has none). Rows are documents of their
    own, also if an id is repeated.

    1. Equal sets become one class. 2. Postings of the adaptive prefixes; lists of one class go, and classes with fewer
    shared shingles than any partner asks for. 3. Rounds: every list
    is compared with at most ``leaders[round]`` members, and lists within one component go, so groups of near copies need a few comparisons
    per member. More leaders join loosely linked groups earlier; the rows are the same for any number. 4. All pairs of different components that are left and share the asked number of prefix shingles are compared. Within
    this join, and before whole sets are fetched, a parity bitmap of fixed size per set bounds the overlap from above, so pairs just below the
    similarity go without being emitted and no link is lost.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), F.xxhash64(text).alias("t"), F.col(text).alias("text"))
    signed = materialize(signatures(rows, frequency_sketch(rows, k), k, percent).withColumn("row", F.monotonically_increasing_id()))
    classes = materialize(signed.where("n > 0").groupBy("s1", "s2", "n")
                          .agg(F.min("row").alias("rep"), F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "t", "row")).alias("least")))
    keys = signed.select("row", "doc", "t", "n", "bits")
    first = signed.join(classes.select(F.col("rep").alias("row")), "row", "left_semi")
    need = F.expr(f"least({MATCHES}, ceil({percent} * ceil({percent} * n / 100) / 100))")  # what the smallest partner may ask for
    asks = materialize(first.select("row", "n", "l", need.alias("need")))
    posts = first.select("row", F.posexplode("prefix").alias("pos", "token"))
    for _ in range(2):  # a row needs enough shingles that other rows have too
        held = posts.join(posts.groupBy("token").agg(F.count("*").alias("held")).where("held > 1").select("token"), "token")
        held = materialize(held)
        able = held.groupBy("row").agg(F.count("*").alias("held")).join(asks, "row").where("held >= need").select("row")
        posts = materialize(held.join(able, "row", "left_semi"))
    posts = materialize(posts.join(asks.drop("need"), "row"))
    some = posts.select("row").distinct()

    links = spark.createDataFrame([], "a long, b long")
    done = links
    state = some.select("row", F.col("row").alias("comp"))
    for r, many in enumerate(leaders):
        now = posts.join(state, "row")
        chosen = F.min_by(F.struct("row", "n", "l", "pos", "comp"), F.xxhash64("row", F.lit(r))).alias("lead")
        if many == 1:
            lead = (now.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), chosen)
                    .where("low <> high").select("token", "lead"))
        else:  # one leader of each slice of a list
            lead = now.groupBy("token", F.pmod(F.xxhash64("row", F.lit(r), F.lit("slice")), F.lit(many)).alias("slice")).agg(chosen).select("token", "lead")
        pairs = (now.join(lead, "token").where("comp <> lead.comp").where(_may("", "lead.", percent))
                 .groupBy(*_pair("row", "lead.row")).agg(F.count("*").alias("hits")).where("hits > 1").select("a", "b")
                 .join(done, ["a", "b"], "left_anti"))
        pairs = materialize(pairs)
        if pairs.isEmpty():
            break
        fresh = materialize(_verify(pairs, rows, keys, k, percent))
        links, done = links.unionByName(fresh), done.unionByName(pairs)
        comp = components(links)
        state = materialize(some.join(comp.withColumnRenamed("node", "row"), "row", "left")
                            .select("row", F.coalesce("component", "row").alias("comp")))

    now = posts.join(state, "row")
    sizes = now.groupBy("token", "comp").agg(F.count("*").alias("held"))
    mixed = sizes.groupBy("token").agg(F.count("*").alias("comps"), F.max_by("comp", F.struct("held", "comp")).alias("major")).where("comps > 1")
    now = now.join(mixed.select("token", "major"), "token")
    now = materialize(now.join(keys.select("row", "bits"), "row"))
    other = now.select("token", F.struct("row", "n", "l", "pos", "comp", "bits").alias("o"))
    # after the last match counted, at most the shorter rest of both sets can be shared
    rest = F.least(F.min(F.col("n") - F.col("pos")), F.min(F.col("o.n") - F.col("o.pos"))) - 1
    least = F.first(F.expr(_overlap("", "o.", percent)))
    pairs = (now.where("comp <> major").join(other, "token").where("comp <> o.comp AND (o.comp = major OR row < o.row)")
             .where(_may("", "o.", percent)).where(_near("", "o.", percent)).groupBy(*_pair("row", "o.row"))
             .agg(F.count("*").alias("hits"), F.min(F.least("l", "o.l")).alias("asked"), rest.alias("rest"), least.alias("least"))
             .where("hits >= asked AND hits + rest >= least").select("a", "b")
             .join(done, ["a", "b"], "left_anti"))
    pairs = materialize(pairs)
    links = links.unionByName(_verify(pairs, rows, keys, k, percent))

    comp = materialize(components(links))
    own = materialize(classes.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("s1", "s2", "n", "least", F.coalesce("component", "rep").alias("comp")))
    named = own.join(own.groupBy("comp").agg(F.min("least").alias("best")), "comp").select("s1", "s2", "n", "best")
    out = signed.select("doc", "t", "row", "n", "s1", "s2").join(named, ["s1", "s2", "n"], "left")
    return out.select(F.col("doc").alias(doc_id), F.col("n").alias("n_shingles"),
                      F.when(F.col("n") == 0, F.col("doc")).otherwise(F.col("best.doc")).alias("component_id"),
                      F.col("t").alias("text_key"), F.coalesce(F.col("best.row") == F.col("row"), F.lit(True)).alias("keep"))
