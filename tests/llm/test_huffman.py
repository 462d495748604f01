"""Huffman archive: exact round trip, code properties, and a plain tokenizer run."""

import heapq
import zlib

import numpy as np
import public_tokenizers
from corpusforge.llm import huffman
from corpusforge.llm.queries import QUERIES
from corpusforge.session import scratch_path
from tokenizers import Tokenizer

from .test_filters import SF, docs_of

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_code_lengths():
    rng = np.random.default_rng(4)
    for n, limit in ((2, 20), (3, 2), (50, 20), (50, 6), (700, 10), (700, 20)):
        counts = (rng.pareto(0.7, n) * 10).astype(np.int64) + 1
        counts[rng.integers(0, n)] = 10**12
        lengths = huffman.code_lengths(counts, limit)
        assert lengths.max() <= limit and sum(2.0 ** -int(x) for x in lengths) == 1
        heap, total = list(counts), 0
        heapq.heapify(heap)
        while len(heap) > 1:
            s = heapq.heappop(heap) + heapq.heappop(heap)
            total += s
            heapq.heappush(heap, s)
        if limit == 20 and n <= 50:
            cost = sum(int(c) * int(x) for c, x in zip(counts, lengths))
            assert cost >= total and (cost == total or lengths.max() == limit)
    assert huffman.code_lengths(np.array([0, 5, 0])).tolist() == [0, 1, 0]
    assert huffman.code_lengths(np.array([1, 1, 1, 1, 100]), 3).tolist() == [3, 3, 3, 3, 1]


def test_pack_unpack():
    rng = np.random.default_rng(9)
    counts = np.r_[0, rng.integers(1, 10**6, 400)]
    lengths = huffman.code_lengths(counts)
    codes = huffman.canonical(lengths)
    table = huffman.lookup(lengths, codes)
    blocks = [rng.integers(1, 401, n) for n in (1, 255, 256, 257, 5000)]
    packed = [huffman.pack(b, lengths, codes) for b in blocks]
    got = huffman.unpack([p for p, _ in packed], np.array([len(b) for b in blocks]), [m for _, m in packed], table)
    assert (got == np.concatenate(blocks)).all()
    p, m = packed[4]  # from a checkpoint within the block
    assert (huffman.unpack([p], np.array([300]), [m[3:5]], table)[:256] == blocks[4][768:1024]).all()


def plain(rows):
    t = Tokenizer.from_file(PATH)
    start, out = 0, []
    for d, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = t.encode(x or "", add_special_tokens=False).ids + [2]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query(spark):
    for sf in (SF, "/root/testdata/sf0.01"):
        assert sorted(tuple(r) for r in QUERIES["op7_huffman_ids"](spark, sf).collect()) == plain(docs_of(spark, sf))


def test_edges(spark):
    rows = [(7, None), (3, ""), (5, "Don't  STOP… naïve café́ <|endoftext|> x<|startoftext|>y 12,5 !!! a.b.c,d word."), (4, "long " * 70_000), (None, "void"),
            (9, "same text"), (9, "same text"), (-2, "日本語 \x1c 　 é ́x")]
    df = spark.createDataFrame([(*r, 1, "q") for r in rows], "doc_id long, text string, n int, ids string")
    folder = scratch_path(spark, "archive")
    huffman.write_documents(df, folder, PATH, 2)
    got = huffman.read_archive(spark, folder, ids=True).collect()
    assert sorted((tuple(r)[:4] for r in got), key=lambda r: r[1]) == plain(rows)
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["crc32"] for r in got)
    folder = scratch_path(spark, "archive")
    huffman.write_documents(df.where("false"), folder, PATH, 2)
    assert huffman.read_archive(spark, folder).count() == 0
