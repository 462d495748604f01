"""Merkle manifest of a table: 8-ary hash trees per group and over the groups, kept as blocks in van Emde Boas layout.

A block is an aligned subtree of at most ``HEIGHT`` levels of hashing. Its digests are one binary value: the tree is split at half height, the top part comes first and
then the parts below it, each laid out in the same way. ``address`` finds a node by arithmetic alone, for building as for reading siblings.
Block roots are the leaves of the next table of blocks, and so on until a group has one block.
"""

from __future__ import annotations

from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import materialize, null_join

ARITY = 8
#: Levels of hashing in a block: 4,096 leaves, 150 KB of digests.
HEIGHT = 4
LEAVES = ARITY**HEIGHT
_SIZE = 32


def nodes_of(levels: int) -> int:
    """Nodes of a whole tree of so many levels."""
    return (ARITY**levels - 1) // (ARITY - 1)


def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Place of nodes (by depth from the root and index within it) in the layout of a tree of ``levels`` levels."""
    if levels == 1:
        return np.zeros_like(index)
    top = levels // 2
    if depth < top:
        return address(top, depth, index)
    below = levels - top
    width = ARITY ** (depth - top)
    return nodes_of(top) + index // width * nodes_of(below) + address(below, depth - top, index % width)


@lru_cache(maxsize=None)
def _places(levels: int, depth: int) -> np.ndarray:
    return address(levels, depth, np.arange(ARITY**depth))


def height_of(n: int) -> int:
    """Levels of hashing from ``n`` leaves to one root."""
    h = 0
    while n > 1:
        n, h = -(-n // ARITY), h + 1
    return h


def build(leaves: list[bytes], height: int) -> bytes:
    """Layout of the tree of ``height`` levels of hashing over the leaves; places without a node stay zero."""
    out = np.zeros((nodes_of(height + 1), _SIZE), np.uint8)
    level = leaves
    for depth in range(height, -1, -1):
        out[_places(height + 1, depth)[:len(level)]] = np.frombuffer(b"".join(level), np.uint8).reshape(-1, _SIZE)
        if depth:
            text = b"".join(level).hex().encode()
            step = 2 * _SIZE * ARITY
            level = [sha256(text[i:i + step]).digest() for i in range(0, len(text), step)]
    return out.tobytes()


class Block:
    """Reads a block: its nodes by depth as hex text."""

    def __init__(self, tree: bytes, n: int):
        self.n = n
        nodes = len(tree) // _SIZE
        self.height = next(h for h in range(HEIGHT + 1) if nodes_of(h + 1) == nodes)
        data = np.frombuffer(tree, np.uint8).reshape(-1, _SIZE)
        self.levels = []
        for up in range(self.height + 1):  # from the leaves to the root
            count = -(-n // ARITY**up)
            self.levels.append(data[_places(self.height + 1, self.height - up)[:count]].tobytes().hex().encode())

    def siblings(self, leaf: int):
        """Per level of hashing, the hex digests before and after the node on the way from the leaf."""
        for text in self.levels[:self.height]:
            run = leaf // ARITY * ARITY
            a, own, e = (2 * _SIZE * x for x in (run, leaf, run + ARITY))
            yield text[a:own], text[own + 2 * _SIZE:e]
            leaf //= ARITY


def _pack(steps: list[tuple[bytes, bytes]]) -> bytes:
    """Siblings on a way up as one value: per level how many stand before and after, and their digests."""
    return b"".join(bytes([len(a) // (2 * _SIZE), len(b) // (2 * _SIZE)]) + bytes.fromhex((a + b).decode()) for a, b in steps)


def _unpack(way: bytes) -> list[tuple[bytes, bytes]]:
    out, i = [], 0
    while i < len(way):
        a, b = way[i], way[i + 1]
        mid, end = i + 2 + a * _SIZE, i + 2 + (a + b) * _SIZE
        out.append((way[i + 2:mid].hex().encode(), way[mid:end].hex().encode()))
        i = end
    return out


def _numbered(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """``rank`` of each row in its group by ``order`` (rows that are equal there: any order), and ``size`` of the group.

    Rows are range-partitioned over groups and order, so a group may cover any number of tasks; only the counts per task and group are summed up.
    """
    rows = materialize(rows).withColumn("_own", F.monotonically_increasing_id())  # parts equal rows too
    sort = [by, *order, "_own"]
    placed = materialize(rows.repartitionByRange(*sort).sortWithinPartitions(*sort).drop("_own").withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    counts = placed.groupBy(by, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))  # a row per task and group
    whole = Window.partitionBy(by)
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(by, "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias("size"))
    return null_join(placed, counts, [by, "_part"]).withColumn("rank", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def _blocks(leaves: DataFrame, by: str) -> DataFrame:
    """Blocks over leaves (``by``, ``rank``, ``size``, ``digest``, ``id``, ``claim``): one row per block, at most ``LEAVES`` leaves each."""
    kind = leaves.schema[by].dataType.simpleString()

    def make(key, group):
        group = group.sort_by("rank")
        n, size = group.num_rows, group.column("size")[0].as_py()
        tree = build(group.column("digest").to_pylist(), HEIGHT if size > LEAVES else height_of(n))
        root = np.frombuffer(tree, np.uint8).reshape(-1, _SIZE)[0].tobytes()  # the layout begins with the root
        claims = b"".join(group.column("claim").to_pylist())
        return pa.table({by: pa.array([key[0].as_py()], group.schema.field(by).type), "block": pa.array([key[1].as_py()], pa.int64()),
                         "n": pa.array([n], pa.int32()), "blocks": pa.array([-(-size // LEAVES)], pa.int64()), "tree": pa.array([tree], pa.binary()),
                         "root": pa.array([root], pa.binary()), "ids": pa.array([group.column("id").to_pylist()], pa.list_(pa.int64())),
                         "claims": pa.array([claims], pa.binary())})

    rows = leaves.select(by, F.expr(f"rank div {LEAVES}").alias("block"), "rank", "size", "digest", "id", "claim")
    return rows.groupBy(by, "block").applyInArrow(
        make, f"`{by}` {kind}, block long, n int, blocks long, tree binary, root binary, ids array<bigint>, claims binary")


def forest(leaves: DataFrame, by: str) -> list[DataFrame]:
    """Written block tables of the trees of all groups, the lowest first; the loop runs once per ``HEIGHT`` levels of the largest tree."""
    tables = [materialize(_blocks(leaves, by))]
    while (tables[-1].agg(F.max("blocks")).first()[0] or 0) > 1:
        upper = tables[-1].where("blocks > 1").select(by, F.col("block").alias("rank"), F.col("blocks").alias("size"), F.col("root").alias("digest"),
                                                      F.lit(0).cast("long").alias("id"), F.lit(b"").alias("claim"))
        tables.append(materialize(_blocks(upper, by)))
    return tables


def _ways(blocks: DataFrame, by: str) -> DataFrame:
    """Rows (``by``, ``rank`` of a leaf of these blocks, ``way`` from it to the top, ``subroot``, ``top``); blocks come with their own way."""
    kind = blocks.schema[by].dataType.simpleString()

    def go(batches):
        for batch in batches:
            c = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            for r in range(batch.num_rows):
                block = Block(c["tree"][r].as_py(), c["n"][r].as_py())
                above, first = c["way"][r].as_py(), c["block"][r].as_py() * LEAVES
                ways = [_pack(list(block.siblings(i))) + above for i in range(block.n)]
                same = pa.array([0] * block.n)
                yield pa.RecordBatch.from_arrays([c[by].slice(r, 1).take(same), pa.array(np.arange(first, first + block.n)), pa.array(ways, pa.binary()),
                                                  c["subroot"].slice(r, 1).take(same), c["top"].slice(r, 1).take(same)], names=[by, "rank", "way", "subroot", "top"])

    return blocks.select(by, "block", "n", "tree", "way", "subroot", "top").mapInArrow(
        go, f"`{by}` {kind}, rank long, way binary, subroot binary, top binary")


def _with_ways(tables: list[DataFrame], by: str, tops: DataFrame) -> DataFrame:
    """The lowest blocks with ``way``, ``subroot`` and ``top``, handed down from the last table; ``tops`` has them per group."""
    sole = [null_join(t.where("blocks = 1"), tops, [by]) for t in tables]
    out = sole[-1]
    for lower, ended in zip(reversed(tables[:-1]), reversed(sole[:-1])):
        ways = materialize(_ways(out, by).withColumnRenamed("rank", "block"))
        out = null_join(lower.where("blocks > 1"), ways, [by, "block"]).unionByName(ended)
    return out


def _proofs(blocks: DataFrame) -> DataFrame:
    def go(batches):
        for batch in batches:
            c = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            for r in range(batch.num_rows):
                block = Block(c["tree"][r].as_py(), c["n"][r].as_py())
                above = _unpack(c["way"][r].as_py())
                claims, leaves = c["claims"][r].as_py().hex().encode(), block.levels[0].decode()
                proofs, folded = [], []
                for i in range(block.n):
                    steps = [*block.siblings(i), *above]
                    proofs.append(sha256(b"".join(a + b for a, b in steps)).hexdigest())
                    own = claims[2 * _SIZE * i:2 * _SIZE * (i + 1)]
                    for a, b in steps:
                        own = sha256(a + own + b).hexdigest().encode()
                    folded.append(own.decode())
                top = c["top"][r].as_py().hex()
                yield pa.RecordBatch.from_pydict({
                    "id": c["ids"].slice(r, 1).flatten(), "leaf": [leaves[i:i + 2 * _SIZE] for i in range(0, len(leaves), 2 * _SIZE)],
                    "subroot": [c["subroot"][r].as_py().hex()] * block.n, "root": [top] * block.n, "proof_sha256": proofs, "folded_root": folded,
                    "verified": [f == top for f in folded]})

    return blocks.select("n", "tree", "ids", "claims", "way", "subroot", "top").mapInArrow(
        go, "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def row_digest(*columns: Column) -> Column:
    """SHA-256 (binary) of the values: each `-` if null, else its UTF-8 byte count, `:` and the value as text."""
    parts = []
    for c in columns:
        text = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def manifest(leaves: DataFrame, by: str = "by", row_id: str = "id", digest: str = "digest", claim: str = "claim") -> DataFrame:
    """Proof of every row against the root over all rows.

    ``leaves`` has a group, a row id, the row's 32-byte ``digest`` and the digest that is ``claim``ed for it now (null: the same). Leaves of a group
    ascend by id (null first, equal ids by digest), groups by their value (null first). Eight nodes in a row, fewer at the end, are hashed (SHA-256 of
    their hex digests) until one is left; so are the groups' subroots.

    Returns per row: the id, ``leaf``, ``subroot``, ``root``, ``proof_sha256`` (over the siblings from the leaf to the root, left to right), ``folded_root``
    (from the claimed digest and the siblings) and ``verified`` (whether it is the root). Repeated rows are leaves of their own, with equal results. An empty table
    has no rows. No task holds more than blocks of ``LEAVES`` leaves, however large a group is or however many there are.
    """
    rows = leaves.select(F.col(by).alias("by"), F.col(row_id).cast("long").alias("id"), F.col(digest).alias("digest"),
                         F.coalesce(F.col(claim), F.col(digest)).alias("claim"))
    trees = forest(_numbered(rows, "by", ["id", "digest"]), "by")
    roots = trees[0].where("blocks = 1").select("by", "root")
    for t in trees[1:]:
        roots = roots.unionByName(t.where("blocks = 1").select("by", "root"))
    groups = materialize(_numbered(roots.withColumn("all", F.lit(0)), "all", ["by"]))
    over = forest(groups.select("all", "rank", "size", F.col("root").alias("digest"), F.lit(0).cast("long").alias("id"), F.lit(b"").alias("claim")), "all")
    top = over[-1].select("all", F.lit(b"").alias("way"), F.col("root").alias("subroot"), F.col("root").alias("top"))  # one row
    ways = _ways(_with_ways(over, "all", top), "all").select("all", "rank", "way", "top")
    tops = groups.join(ways, ["all", "rank"]).select("by", "way", F.col("root").alias("subroot"), "top")
    got = _proofs(_with_ways(trees, "by", materialize(tops)))
    return got.select(F.col("id").alias(row_id), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def document_manifest(docs: DataFrame) -> DataFrame:
    """``manifest`` of documents by language, with the texts of some lower-cased after the fact: where 3 divides the crc32 of the id as text.

    A null id is never lower-cased; null values are hashed as `-`.
    """
    def leaf(text):
        return row_digest(F.col("doc_id").cast("long"), F.col("source"), F.col("lang"), F.col("n_chars").cast("long"), text)

    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    picked = F.pmod(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")), F.lit(3)) == 0
    leaves = docs.select(F.col("lang").alias("by"), F.col("doc_id").alias("id"), leaf(F.col("text")).alias("digest"),
                         F.when(picked, leaf(F.translate("text", upper, upper.lower()))).alias("claim"))
    return manifest(leaves).withColumnRenamed("id", "doc_id")
