"""WARC archives: exact round trip and assembly."""

import gzip
import hashlib

import pytest
from corpusforge.llm import warc
from corpusforge.llm.queries import QUERIES
from corpusforge.session import scratch_path

from .test_filters import SF


def plain(rows):
    best = {}
    for i, _, h in rows:
        if i is not None:
            best[h or ""] = max(i, best.get(h or "", i))
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        again = len(b) >= 1000 and best.get(h or "", i) != i
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", best[h or ""] if again else None))
    return sorted(out, key=repr)


def test_query(spark):
    pages = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted((tuple(r) for r in QUERIES["op1_warc_assembly"](spark, SF).collect()), key=repr) == plain(pages)


def test_edges(spark):
    big, trap = "é" * 700, "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nxyz\r\n\r\n" * 40
    rows = [(1, "http://a", big), (9, "http://b", big), (5, None, big), (9, "http://b", big), (9, "http://c", big), (2, "x\r\ny", ""), (3, "x", None),
            (4, "", trap), (6, "u", trap), (7, "v", "short"), (8, "v", "short"), (None, "n", "\r\n\r\n"), (None, "n", big), (10, "w", "z" * 3_000_000)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, size int").repartition(3)
    folder = scratch_path(spark, "warc")
    warc.write(df, folder)
    got = warc.page_captures(spark, folder).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == plain(rows)
    assert all(r["intact"] for r in got if r["record_type"] == "response")
    full = warc.read(spark, folder, payload=True).where("type = 'response'").select("payload").collect()
    assert {bytes(r[0]).decode() for r in full} == {r[2] or "" for r in rows}
    folder = scratch_path(spark, "warc")
    warc.write(df.where("false"), folder)
    assert warc.page_captures(spark, folder).count() == 0


def test_assembly_links(spark):
    def rec(i, kind, to=()):
        return (i, kind, list(to), None, None, None, 0, None, None, None, None)

    rows = [rec("r1", "response", ["q1"]), rec("q1", "request"), rec("m1", "metadata", ["q1"]), rec("m2", "metadata", ["r1"]), rec("m2", "metadata", ["r1"]),
            rec("r2", "revisit"), rec("r2", "revisit"), rec("q9", "request", ["gone"]), rec(None, "metadata", ["r1"]), rec("x", None, ["r2"])]
    got = {r["record_id"]: r for r in warc.assemble(spark.createDataFrame(rows, warc._SCHEMA)).collect()}
    assert set(got) == {"r1", "r2"}
    assert got["r1"]["request"]["record_id"] == "q1" and [m["record_id"] for m in got["r1"]["metadata"]] == ["m1", "m2"]
    assert got["r2"]["request"] is None and got["r2"]["metadata"] == [] and got["r2"]["copies"] == 2


def test_parse():
    record = b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: 4\r\n\r\n\r\n\r\n\r\n\r\n"
    two = gzip.compress(record) + gzip.compress(record)
    assert [b for _, b in warc.parse(warc._unzip(two))] == [b"\r\n\r\n"] * 2
    with pytest.raises(ValueError):
        list(warc.parse(record[:-6]))
    with pytest.raises(ValueError):
        list(warc.parse(b"junk"))


@pytest.mark.parametrize("payload", [False, True])
def test_plain_archives_count_like_packed_ones(spark, tmp_path, payload):
    df = spark.createDataFrame([(i, f"http://x/{i}", f"page {i} " * 300) for i in range(6)], "page_id long, url string, html string")
    folder = scratch_path(spark, "warc")
    warc.write(df, folder)
    want = sorted((r["record_id"], r["type"], r["payload_digest"]) for r in warc.read(spark, folder, payload).collect())
    mixed = tmp_path / "mixed"
    mixed.mkdir()
    for n, f in enumerate(spark.read.format("binaryFile").load(folder).select("content").collect()):
        if n % 2:
            (mixed / f"{n}.warc").write_bytes(gzip.decompress(f[0]))
        else:
            (mixed / f"packed{n}").write_bytes(f[0])  # gzip by content, not by name
    (mixed / "notes.txt").write_text("no archive at all")
    (mixed / "empty.warc").write_bytes(b"")
    got = sorted((r["record_id"], r["type"], r["payload_digest"]) for r in warc.read(spark, f"file://{mixed}", payload).collect())
    assert got == want and want
