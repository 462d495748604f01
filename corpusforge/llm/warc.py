"""WARC archives: writing captures as request, response or revisit and metadata records, and assembling them again."""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import materialize

#: Payloads of at least so many bytes are stored once.
REVISIT_MIN = 1000
CAPTURES = ("response", "revisit", "resource")
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "


def _urn(kind: str, *parts: Column) -> Column:
    """A record id that follows from the kind and the capture; nulls and empty texts differ."""
    text = F.concat_ws("|", F.lit(kind), *[F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("-")) for p in parts])
    h = F.md5(text.cast("binary"))
    cut = [F.substr(h, F.lit(a), F.lit(n)) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(headers: list[tuple[str, Column | str]], block: Column) -> Column:
    """A WARC record without its closing line breaks; headers with a null value are left out."""
    lines = [F.concat(F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value) for name, value in headers]
    return F.concat(F.concat_ws("\r\n", F.lit("WARC/1.1"), *lines, F.concat(F.lit("Content-Length: "), F.octet_length(block))), F.lit("\r\n\r\n"), block)


def write(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = "2024-01-01T00:00:00Z") -> None:
    """Write three records per page to gzip files: request, response or revisit, and metadata with the page id.

    A null ``html`` is an empty payload, a null ``url`` leaves the target out, line breaks in it are percent-encoded. Of equal payloads of
    ``REVISIT_MIN`` bytes or more, those with the largest id are responses (all, if no id is given) and the others revisit them.
    Rows that are equal in all three columns give equal records. Every record is made on the JVM and ends with two line breaks, which
    Spark's text writer adds.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("id"), F.col(url).alias("url"), F.coalesce(html, F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("size", F.octet_length("html"))
    best = (rows.where(F.col("size") >= REVISIT_MIN).groupBy("digest").agg(F.max_by(F.struct("id", "url"), F.struct("id", "url")).alias("first"), F.count("*").alias("n"))
            .where("n > 1").select("digest", "first"))
    rows = rows.join(best, "digest", "left")
    own, uri = [F.col(c) for c in ("id", "url", "digest")], F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    is_new = F.coalesce(F.col("id") == F.col("first.id"), F.col("first.id").isNull())
    rid = _urn("response", *own)
    head = F.concat(F.lit(_HTTP), F.col("size"), F.lit("\r\n\r\n"))
    common = [("WARC-Target-URI", uri), ("WARC-Date", date)]
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    response = _record([("WARC-Type", "response"), ("WARC-Record-ID", rid), *common, ("Content-Type", "application/http;msgtype=response"), digest],
                       F.concat(head, F.col("html")))
    revisit = _record([("WARC-Type", "revisit"), ("WARC-Record-ID", rid), *common, ("Content-Type", "application/http;msgtype=response"), digest,
                       ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                       ("WARC-Refers-To", _urn("response", F.col("first.id"), F.col("first.url"), F.col("digest")))], head)
    request = _record([("WARC-Type", "request"), ("WARC-Record-ID", _urn("request", *own)), *common, ("WARC-Concurrent-To", rid),
                       ("Content-Type", "application/http;msgtype=request")],
                      F.concat(F.lit("GET "), F.coalesce(uri, F.lit("/")), F.lit(" HTTP/1.1\r\n\r\n")))
    metadata = _record([("WARC-Type", "metadata"), ("WARC-Record-ID", _urn("metadata", *own)), *common, ("WARC-Concurrent-To", rid),
                        ("Content-Type", "application/warc-fields")], F.concat(F.lit("page_id: "), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit("\r\n")))
    records = rows.select(F.explode(F.array(request, F.when(is_new, response).otherwise(revisit), metadata)).alias("value"))
    records.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(folder)


def _headers(data: bytes) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for line in data.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if colon:
            out.setdefault(name.strip().decode("latin-1").lower(), []).append(value.strip().decode("utf-8", "replace"))
    return out


def parse(data: bytes):
    """Headers and block of each record of an uncompressed archive. A record that is cut off is an error."""
    at, n = 0, len(data)
    while True:
        while at < n and data[at] in b"\r\n":
            at += 1
        if at >= n:
            return
        stop = data.find(b"\r\n\r\n", at)
        if stop < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        head = _headers(data[at:stop])
        size = int(head["content-length"][0])
        at = stop + 4 + size
        if at > n:
            raise ValueError("the last record is cut off")
        yield head, data[stop + 4:at]


def _unzip(data: bytes) -> bytes:
    """Contents of one or several gzip members; other data as they are."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data[:2] == b"\x1f\x8b":
        z = zlib.decompressobj(31)
        out.append(z.decompress(data) + z.flush())
        data = z.unused_data
    return b"".join(out)


_SCHEMA = ("record_id string, type string, concurrent_to array<string>, refers_to string, uri string, date string, payload_bytes long, "
           "payload_digest string, intact boolean, fields map<string,string>, payload binary")
_ARROW = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("concurrent_to", pa.list_(pa.string())), ("refers_to", pa.string()), ("uri", pa.string()),
                    ("date", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("intact", pa.bool_()),
                    ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])


def _row(head: dict[str, list[str]], block: bytes, payload: bool) -> dict:
    one = {k: v[0] for k, v in head.items()}
    kind, content = one.get("warc-type"), one.get("content-type", "")
    named = one.get("warc-payload-digest", "").rpartition(":")[2] or None
    body, fields = block, None
    size, digest, intact = len(body), named, None
    if content.startswith("application/http"):
        top, _, body = block.partition(b"\r\n\r\n")
        size = len(body)
        if kind == "revisit":
            size = int(_headers(top).get("content-length", ["0"])[0])
    elif content.startswith("application/warc-fields"):
        fields = [(k, v[0]) for k, v in _headers(block).items()]
    if kind in ("response", "resource"):
        digest = hashlib.sha1(body).hexdigest()
        intact = named is None or named == digest
    return {"record_id": one.get("warc-record-id"), "type": kind, "concurrent_to": head.get("warc-concurrent-to", []), "refers_to": one.get("warc-refers-to"),
            "uri": one.get("warc-target-uri"), "date": one.get("warc-date"), "payload_bytes": size, "payload_digest": digest, "intact": intact,
            "fields": fields, "payload": body if payload else None}


def read(spark: SparkSession, folder: str, payload: bool = False) -> DataFrame:
    """One row per record of the archives in ``folder`` (plain or gzip, whatever their names; other files have no records).

    ``payload_bytes`` and ``payload_digest`` (SHA-1, hex) are those of the full payload: computed from the bytes of a response (``intact``: as the
    record says), taken from the headers of a revisit. The payload itself comes only with ``payload``.
    """
    files = spark.read.format("binaryFile").load(folder).select("content")

    def work(batches):
        for batch in batches:
            for data in batch.column(0):
                rows, size = [], 0
                content = _unzip(data.as_py())
                if not content[:64].lstrip(b"\r\n").startswith(b"WARC/"):
                    continue
                for head, block in parse(content):
                    rows.append(_row(head, block, payload))
                    size += len(block)
                    if size > 1 << 23 or len(rows) >= 5000:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return files.mapInArrow(work, _SCHEMA)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``record_id``, ``copies``, ``capture`` (the response, revisit or resource), ``request`` (of several the one
    with the smallest id) and ``metadata`` (array, by id).

    Records belong together if one names the other in its concurrent-to list, in either direction, or over one record between them (metadata of
    a request). Repeated records count as one, and ``copies`` says how often the capture stands there. Records that lead to no capture
    have no row; a capture without request or metadata has null or an empty array. Records without an id take no part.
    """
    records = records.where("record_id IS NOT NULL")
    is_capture = F.col("type").isin(*CAPTURES)
    held = records.where(is_capture)
    rest = records.where(~F.coalesce(is_capture, F.lit(False)))
    names = rest.select(F.col("record_id").alias("id"), F.explode("concurrent_to").alias("to")).distinct()
    known = held.select("record_id").distinct()
    near = names.join(known, names["to"] == known["record_id"], "left_semi").select("id", F.col("to").alias("capture_id"))
    near = near.unionByName(held.select(F.explode("concurrent_to").alias("id"), F.col("record_id").alias("capture_id"))).distinct()
    far = names.join(near.withColumnsRenamed({"id": "to"}), "to").select("id", "capture_id")
    links = near.unionByName(far).distinct()
    item = F.struct("record_id", "type", "uri", "date", "fields", "payload_bytes")
    others = links.join(rest.withColumnRenamed("record_id", "id"), "id").withColumn("record_id", F.col("id")).select("capture_id", "id", "type", item.alias("item"))
    groups = others.groupBy("capture_id").agg(
        F.min_by(F.when(F.col("type") == "request", F.col("item")), F.when(F.col("type") == "request", F.col("id"))).alias("request"),
        F.collect_list(F.when(F.col("type") == "metadata", F.struct("id", "item"))).alias("metadata"))
    once = held.groupBy("record_id").agg(F.count("*").alias("copies"), F.first(F.struct(
        "type", "uri", "date", "refers_to", "payload_bytes", "payload_digest", "intact", "payload")).alias("capture"))
    by_id = F.array_sort("metadata", lambda a, b: F.when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0))
    one = F.transform(F.array_compact(F.transform(by_id, lambda m: m)), lambda m: m["item"])
    one = F.aggregate(one, F.array().cast(f"array<{_ITEM}>"), lambda acc, m: F.when(F.exists(acc, lambda x: x["record_id"] == m["record_id"]), acc)
                      .otherwise(F.array_append(acc, m)))
    joined = once.join(groups.withColumnRenamed("capture_id", "record_id"), "record_id", "left")
    return joined.select("record_id", "copies", "capture", "request", F.coalesce(one, F.array().cast(f"array<{_ITEM}>")).alias("metadata"))


_ITEM = "struct<record_id:string,type:string,uri:string,date:string,fields:map<string,string>,payload_bytes:bigint>"


def page_captures(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of an archive that ``write`` made: page id, size and digest of the full payload, type, and the page that a revisit refers to."""
    whole = materialize(assemble(materialize(read(spark, folder))))
    rows = whole.select("record_id", "copies", F.element_at("metadata", 1)["fields"]["page_id"].try_cast("long").alias("page_id"), "capture.*")
    seen = rows.where("type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("to_page"))
    out = rows.join(seen, "refers_to", "left").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return out.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("to_page").alias("refers_to"), "uri", "intact")
