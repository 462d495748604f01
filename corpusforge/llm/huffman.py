"""Token ids as canonical length-limited Huffman code, in independent blocks with bit-offset checkpoints.

The file format is two Parquet tables in one folder. ``codebook``: id and code length of every id in use (canonical: shorter codes
first, then smaller ids). ``blocks``: whole documents in ascending id order; ``part`` and ``block`` number the blocks, ``docs`` and
``sizes`` are the document ids and their numbers of token ids, ``marks`` the bit offset of every ``STEP``-th token id, ``payload`` the bits,
most significant first, and ``n_ids`` their number. A block is decoded on its own, and each checkpoint within it too.
"""

from __future__ import annotations

import re
import zlib
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path

#: Longest code in bits.
LIMIT = 20
#: Token ids between checkpoints.
STEP = 256
#: A block is closed once it has so many token ids.
BLOCK_IDS = 1 << 16
#: Words remembered per worker.
CACHE = 1_000_000


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths (at most ``limit``) of an optimal prefix code for ``counts``; 0 where the count is 0. Package-merge."""
    used = np.flatnonzero(counts)
    out = np.zeros(counts.size, np.int64)
    n = used.size
    if n == 0:
        return out
    if n == 1:
        out[used] = 1
        return out
    if n > 1 << limit:
        raise ValueError(f"{n} ids need codes of more than {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    level, is_leaf = leaves, []
    for _ in range(limit):
        is_leaf_now = np.ones(n, bool) if level is leaves and not is_leaf else mixed
        is_leaf.append(is_leaf_now)
        packs = level[:level.size // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, packs])
        rank = np.argsort(both, kind="stable")
        level, mixed = both[rank], rank < n
    take, lengths = 2 * n - 2, np.zeros(n, np.int64)
    for flags in reversed(is_leaf):  # what the top list takes, opened level by level
        own = int(flags[:take].sum())
        lengths[:own] += 1
        take = 2 * (take - own)
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by length and then id."""
    codes = np.zeros(lengths.size, np.int64)
    code = last = 0
    for i in np.lexsort((np.arange(lengths.size), lengths)):
        if lengths[i]:
            code <<= int(lengths[i]) - last
            codes[i], last = code, int(lengths[i])
            code += 1
    return codes


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Bits of ``ids``, and the bit offset of every ``STEP``-th."""
    size = lengths[ids]
    stop = np.cumsum(size)
    at = stop - size
    word = codes[ids] << (32 - (at & 7) - size)
    byte, n = at >> 3, int(stop[-1] + 7 >> 3) + 4 if ids.size else 0
    out = np.zeros(n)
    for k in range(4):
        out += np.bincount(byte + k, weights=(word >> (24 - 8 * k)) & 255, minlength=n)
    return out.astype(np.uint8)[:max(n - 4, 0)].tobytes(), at[::STEP]


def lookup(lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Decoding table over the next ``width`` bits: id and code length."""
    width = int(lengths.max(initial=1))
    ids, sizes = np.zeros(1 << width, np.int64), np.ones(1 << width, np.int64)
    order = np.lexsort((np.arange(lengths.size), lengths))
    order = order[lengths[order] > 0]
    fill = np.repeat(order, 1 << (width - lengths[order]))
    ids[:fill.size], sizes[:fill.size] = fill, lengths[fill]
    return ids, sizes, width


def unpack(payloads: list[bytes], counts: np.ndarray, marks: list[np.ndarray], table) -> np.ndarray:
    """Ids of several blocks one after the other: all their checkpoints are decoded side by side."""
    ids, sizes, width = table
    data = np.frombuffer(b"".join(payloads) + b"\0" * 8, np.uint8).astype(np.int64)
    base = np.concatenate([[0], np.cumsum([len(p) for p in payloads])])[:-1] * 8
    at = np.concatenate([m + b for m, b in zip(marks, base)]) if marks else np.zeros(0, np.int64)
    lefts = [np.minimum(STEP, c - np.arange(len(m)) * STEP) for c, m in zip(counts, marks)]
    left = np.concatenate(lefts) if lefts else np.zeros(0, np.int64)
    to = np.concatenate([[0], np.cumsum(left)])[:-1]
    out = np.zeros(int(left.sum()), np.int64)
    order = np.argsort(-left, kind="stable")
    at, to, left = at[order], to[order], left[order]
    for k in range(int(left.max(initial=0))):
        n = int(np.searchsorted(-left, -k, side="left"))
        a = at[:n]
        b = a >> 3
        word = data[b] << 24 | data[b + 1] << 16 | data[b + 2] << 8 | data[b + 3]
        key = (word >> (32 - (a & 7) - width)) & ((1 << width) - 1)
        out[to[:n] + k] = ids[key]
        at[:n] += sizes[key]
    return out


#: Words without ASCII white space, cut before marks that follow a letter: the tokenizer never has both in one word.
_WORD = re.compile(r"[^ \t\n\r](?:[^ \t\n\r.,!?;:]+|(?<![A-Za-z])[.,!?;:])*")
_TOKENIZERS: dict[tuple[int, int], _Encoder] = {}


class _Encoder:
    """A tokenizer with a memory of words; ids come as little-endian bytes of ``width``.

    Text is cut at ASCII white space, which the tokenizer drops before it cuts words, and where ``_WORD`` says: each part stands alone.
    """

    def __init__(self, model: bytes, width: int):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.whole = Tokenizer.from_str(model.decode())
        self.plain = Tokenizer.from_str(model.decode())  # for ASCII letters in lower case, which its first steps leave alone
        self.plain.normalizer = self.plain.pre_tokenizer = None
        self.lowers = self.whole.encode_batch(["Aa"], add_special_tokens=False)[0].ids == self.whole.encode_batch(["aa"], add_special_tokens=False)[0].ids
        self.kind = f"<u{width}"
        self.known, self.rows = _Numbers(), []

    def _learn(self, words: list[str]) -> list[bytes]:
        easy = [w.isascii() and w.isalpha() and self.lowers for w in words]
        got = [iter(t.encode_batch_fast(some, add_special_tokens=False)) for t, some in (
            (self.plain, [w.lower() for w, e in zip(words, easy) if e]), (self.whole, [w for w, e in zip(words, easy) if not e]))]
        ids = [next(got[0 if e else 1]).ids for e in easy]
        raw = np.fromiter(chain.from_iterable(ids), self.kind).tobytes()
        stop = (np.cumsum([0, *map(len, ids)]) * np.dtype(self.kind).itemsize).tolist()
        return [raw[a:e] for a, e in pairwise(stop)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out = []
        for i in range(0, len(texts), 200):
            if len(self.rows) >= CACHE:
                self.known, self.rows = _Numbers(), []
            numbers = [list(map(self.known.__getitem__, _WORD.findall(t))) if t else [] for t in texts[i:i + 200]]
            self.rows += self._learn(self.known.take())
            out += [b"".join(map(self.rows.__getitem__, n)) for n in numbers]
        return out


class _Numbers(dict):
    """A number for each word, in order of first sight; ``take`` gives the words since the last call."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n

    def take(self) -> list[str]:
        new, self.new = self.new, []
        return new


def token_ids(docs: DataFrame, model: bytes, end_id: int, doc_id: str = "doc_id", text: str = "text", width: int = 2) -> DataFrame:
    """``doc``, ``n`` and ``ids`` (bytes of ``width`` each) of every whole text with ``end_id`` at its end (null: only that)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        key = zlib.crc32(shared.value), width
        if key not in _TOKENIZERS:
            _TOKENIZERS[key] = _Encoder(shared.value, width)
        end = end_id.to_bytes(width, "little")
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                got = [b + end for b in _TOKENIZERS[key].encode(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(b) // width for b in got], pa.int64()), pa.array(got, pa.binary())],
                                                 names=["doc", "n", "ids"])

    return docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text")).mapInArrow(work, "doc long, n long, ids binary")


def id_counts(tokens: DataFrame, vocabulary: int, width: int = 2) -> np.ndarray:
    """How often each id stands in all documents; at most ``vocabulary`` numbers reach the driver."""

    def count(batches):
        sums = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for b in batch.column(0).to_pylist():
                sums += np.bincount(np.frombuffer(b, f"<u{width}"), minlength=vocabulary) if len(b) > vocabulary else 0
                if len(b) <= vocabulary:
                    np.add.at(sums, np.frombuffer(b, f"<u{width}"), 1)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(sums[some])], names=["id", "n"])

    got = tokens.select("ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(vocabulary, np.int64)
    out[got.column("id").to_numpy().astype(np.int64)] = got.column("n").to_numpy()
    return out


def write_archive(tokens: DataFrame, folder: str, vocabulary: int, width: int = 2) -> None:
    """Write rows (doc, n, ids) as an archive in ascending order of the id; null ids first, repeated ids by size and bytes."""
    spark = tokens.sparkSession
    lengths = code_lengths(id_counts(tokens, vocabulary, width))
    book = np.flatnonzero(lengths)
    spark.createDataFrame([(int(i), int(lengths[i])) for i in book], "id int, length int").coalesce(1).write.parquet(f"{folder}/codebook")
    shared = spark.sparkContext.broadcast((lengths, canonical(lengths)))

    def blocks(batches):
        part, block = TaskContext.get().partitionId(), 0
        docs, held, n = [], [], 0

        def close():
            sizes = [len(b) // width for b in held]
            payload, marks = pack(np.frombuffer(b"".join(held), f"<u{width}").astype(np.int64), *shared.value)
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([docs], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int32())),
                pa.array([n], pa.int64()), pa.array([marks], pa.list_(pa.int64())), pa.array([payload], pa.binary())],
                names=["part", "block", "docs", "sizes", "n_ids", "marks", "payload"])

        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                docs.append(doc)
                held.append(ids)
                n += len(ids) // width
                if n >= BLOCK_IDS:
                    yield close()
                    docs, held, n, block = [], [], 0, block + 1
        if docs:
            yield close()

    ordered = tokens.repartitionByRange("doc").sortWithinPartitions("doc", "n", "ids").select("doc", "ids")
    ordered.mapInArrow(blocks, "part int, block int, docs array<bigint>, sizes array<int>, n_ids long, marks array<bigint>, payload binary") \
        .write.parquet(f"{folder}/blocks")


def read_archive(spark: SparkSession, folder: str, ids: bool = False) -> DataFrame:
    """Documents of an archive: ``doc``, ``start`` (token ids of all documents before it), ``n``, ``crc32`` of the ids as
    little-endian unsigned 32-bit integers, and with ``ids`` the ids themselves."""
    rows = spark.read.parquet(f"{folder}/codebook").collect()  # at most one row per id of the vocabulary
    lengths = np.zeros(max([r["id"] for r in rows], default=0) + 1, np.int64)
    for r in rows:
        lengths[r["id"]] = r["length"]
    shared = spark.sparkContext.broadcast(lengths)
    blocks = spark.read.parquet(f"{folder}/blocks")

    def work(batches):
        table = lookup(shared.value, canonical(shared.value))
        for batch in batches:
            for i in range(0, batch.num_rows, 16):
                part = batch.slice(i, 16)
                c = {n: part.column(k) for k, n in enumerate(part.schema.names)}
                counts = c["n_ids"].to_numpy()
                flat = unpack(c["payload"].to_pylist(), counts, [np.array(m, np.int64) for m in c["marks"].to_pylist()], table)
                sizes = [np.array(s, np.int64) for s in c["sizes"].to_pylist()]
                own = np.concatenate(sizes)
                stop = np.cumsum(own)
                base = np.repeat(np.concatenate([[0], np.cumsum(counts)])[:-1], [len(s) for s in sizes])
                raw = flat.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * (e - n):4 * e]) for e, n in zip(stop.tolist(), own.tolist())]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stop]).astype(np.int32)), pa.array(flat.astype(np.int32))) \
                    if ids else pa.nulls(own.size, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(c["part"].to_numpy(), [len(s) for s in sizes])), pa.array(np.repeat(c["block"].to_numpy(), [len(s) for s in sizes])),
                    pa.array([d for docs in c["docs"].to_pylist() for d in docs], pa.int64()), pa.array(stop - own - base), pa.array(own),
                    pa.array(crc, pa.int64()), lists], names=["part", "block", "doc", "inside", "n", "crc32", "ids"])

    docs = blocks.mapInArrow(work, "part int, block int, doc long, inside long, n long, crc32 long, ids array<int>")
    sums = blocks.groupBy("part", "block").agg(F.sum("n_ids").alias("n_ids"))  # one row per block
    whole = sums.groupBy("part").agg(F.sum("n_ids").alias("all"))  # one row per written file
    whole = whole.withColumn("before", F.coalesce(F.sum("all").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inner = F.sum("n_ids").over(Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    offset = sums.withColumn("inner", F.coalesce(inner, F.lit(0))).join(whole, "part").select("part", "block", (F.col("before") + F.col("inner")).alias("base"))
    out = docs.join(offset, ["part", "block"]).withColumn("start", F.col("base") + F.col("inside"))
    return out.select("doc", "start", "n", "crc32", *["ids"] * ids)


def write_documents(docs: DataFrame, folder: str, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> None:
    """Tokenize every whole text with the tokenizer file (words without white space, as described at ``_Encoder``) and write the archive."""
    with open(tokenizer, "rb") as f:
        model = f.read()
    import json

    known = json.loads(model)
    vocabulary = max([*known["model"]["vocab"].values(), *(t["id"] for t in known["added_tokens"]), end_id]) + 1
    width = 2 if vocabulary <= 1 << 16 else 4
    path = scratch_path(docs.sparkSession, "ids")
    token_ids(docs, model, end_id, doc_id, text, width).write.option("compression", "zstd").parquet(path)
    write_archive(docs.sparkSession.read.parquet(path), folder, vocabulary, width)
