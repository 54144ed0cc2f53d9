"""Deterministic sharded WARC writer, and a reader.

Records are put into ranges of their id whose bounds depend on the data alone, sorted, written to
gzip members, and rolled to a new file by compressed size. Equal payloads are stored once; the
others become revisit records. Task attempts write under temporary names of their own; the driver
renames the files that finished attempts report and then writes a manifest, itself under a
temporary name first. What a lost attempt leaves is never read.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import posixpath
import uuid
import zlib
from base64 import b32encode
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122

BROADCAST_GROUPS = 500_000  # of about 64 bytes; beyond that the join shuffles


@dataclass(frozen=True)
class Layout:
    """range_bytes: payload bytes a range holds on average; roll_bytes: compressed size at which a
    file ends; dedup_bytes: smallest payload that is stored once; date: of all records."""

    range_bytes: int = 64 << 20
    roll_bytes: int = 256 << 20
    dedup_bytes: int = 1000
    date: str = "2024-01-01T00:00:00Z"


def open_store(url: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(url) if "://" in url or url.startswith("file:") else (pafs.LocalFileSystem(), url)


def classify(pages: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """(page_id, url, html, payload_bytes, payload_digest, record_type, refers_to).

    Null html is an empty payload. Of records with equal payloads of at least ``dedup_bytes`` that
    with the largest page_id is the response and the others revisit it; rows that repeat it with
    the same page_id are responses too. Payloads found only under a null page_id are responses.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("payload_digest", F.sha1("html"))
    large = rows.where(F.col("payload_bytes") >= layout.dedup_bytes)
    # only groups of several matter; digests travel, payloads stay where the groups are few
    groups = large.groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("__top"), F.count("*").alias("__n")).where("__n > 1 and __top is not null").drop("__n")
    groups = C.Scratch(pages.sparkSession).save(groups, "groups")
    few = groups.count() <= BROADCAST_GROUPS
    out = rows.join(F.broadcast(groups) if few else groups, ["payload_digest", "payload_bytes"], "left")
    again = F.coalesce(~F.col("page_id").eqNullSafe(F.col("__top")) & F.col("__top").isNotNull(), F.lit(False))
    return out.select("page_id", "url", F.when(~again, F.col("html")).alias("html"), "payload_bytes", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("__top")).alias("refers_to"))


def _record_id(page_id: int | None, url: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{page_id} {url}')}>"


def _one_line(s: str | None) -> str:
    return "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in s or "") or "about:blank"


def record(row: dict, layout: Layout) -> bytes:
    """One WARC/1.1 record, headers and digests made anew from the row."""
    digest = b32encode(bytes.fromhex(row["payload_digest"])).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % row["payload_bytes"]
    block = http + (row["html"] or b"" if row["record_type"] == "response" else b"")
    head = [
        ("WARC-Type", row["record_type"]),
        ("WARC-Record-ID", _record_id(row["page_id"], row["url"])),
        ("WARC-Date", layout.date),
        ("WARC-Target-URI", _one_line(row["url"])),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{b32encode(hashlib.sha1(block).digest()).decode()}"),
        ("WARC-X-Page-Id", "" if row["page_id"] is None else str(row["page_id"])),
        ("WARC-X-Payload-Length", str(row["payload_bytes"])),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if row["record_type"] == "revisit":
        head[1:1] = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-X-Refers-To-Page-Id", str(row["refers_to"]))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


MANIFEST = "name string, temporary string, records long, bytes long, sha256 string"


def _writer(root: str, layout: Layout):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(root)
        attempt = TaskContext.get().taskAttemptId()
        out = None
        name = temporary = ""
        place, part, records, size, digest = None, 0, 0, 0, None

        def done() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"name": [name], "temporary": [temporary], "records": [records], "bytes": [size], "sha256": [digest.hexdigest()]})

        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(n)[k].as_py() for n in batch.schema.names}
                if out is None or row["range"] != place or size >= layout.roll_bytes:
                    if out is not None:
                        yield done()
                    part = part + 1 if row["range"] == place else 0
                    place, records, size, digest = row["range"], 0, 0, hashlib.sha256()
                    name = f"range-{place:06d}-{part:04d}.warc.gz"
                    temporary = f"_temporary/{name}.{attempt}"
                    out = store.open_output_stream(posixpath.join(base, temporary), compression=None)
                member = gzip.compress(record(row, layout), compresslevel=6, mtime=0)
                out.write(member)
                digest.update(member)
                size, records = size + len(member), records + 1
        if out is not None:
            yield done()

    return run


def write(pages: DataFrame, root: str, layout: Layout = Layout()) -> DataFrame:
    """Write ``pages(page_id, url, html)`` below ``root``; returns the manifest (name, records, bytes,
    sha256). Equal input gives equal files however it is partitioned. An empty table gives a
    manifest without files. ``root`` must be a new folder that all executors reach."""
    spark = pages.sparkSession
    C.small_batches(spark)
    rows = classify(pages, layout)
    # bounds: of a sample by hash, the same whatever the partitioning; at most about 64 a range
    n, total = pages.select(F.count("*"), F.sum(F.octet_length(F.coalesce(F.col("html").cast("string"), F.lit(""))))).first()
    ranges = max(1, -(-(total or 0) // layout.range_bytes))
    ids = pages.select(F.col("page_id").cast("long").alias("i")).where("i is not null")
    picked = sorted(r[0] for r in ids.where(F.pmod(F.xxhash64("i"), F.lit(max(1, n // (64 * ranges)))) == 0).distinct().collect())
    bounds = sorted({picked[k * len(picked) // ranges] for k in range(1, ranges)}) if picked else []
    place = F.size(F.filter(F.lit(bounds).cast("array<bigint>") if bounds else F.array().cast("array<bigint>"), lambda b: b <= F.coalesce("page_id", F.lit(-(1 << 63))))) if len(bounds) < 256 else None
    if place is None:  # many ranges: width_bucket searches the bounds in logarithmic time
        place = F.expr("cast(width_bucket(cast(coalesce(page_id, -9223372036854775807) as double), array(%s)) as int)" % ", ".join(f"{b}D" for b in bounds))
    store, base = open_store(root)
    store.create_dir(posixpath.join(base, "_temporary"), recursive=True)
    dealt = rows.withColumn("range", place).repartitionById(len(bounds) + 1, F.col("range"))
    dealt = dealt.sortWithinPartitions("page_id", "payload_digest", "url")
    files = dealt.mapInArrow(_writer(root, layout), MANIFEST).collect()  # one row a file
    files.sort(key=lambda f: f["name"])
    for f in files:
        store.move(posixpath.join(base, f["temporary"]), posixpath.join(base, f["name"]))
    listing = [{k: f[k] for k in ("name", "records", "bytes", "sha256")} for f in files]
    with store.open_output_stream(posixpath.join(base, "_temporary/manifest.json")) as out:
        out.write(json.dumps({"files": listing}, indent=1).encode())
    store.move(posixpath.join(base, "_temporary/manifest.json"), posixpath.join(base, "manifest.json"))
    store.delete_dir(posixpath.join(base, "_temporary"))
    return manifest(spark, root)


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """The files a finished write has committed; an error where there is no manifest."""
    store, base = open_store(root)
    with store.open_input_stream(posixpath.join(base, "manifest.json")) as f:
        files = json.loads(f.read())["files"]
    return spark.createDataFrame([(f["name"], f["records"], f["bytes"], f["sha256"]) for f in files], "name string, records long, bytes long, sha256 string")


class _Chain(io.RawIOBase):
    """Decompressed bytes of all gzip members of a stream."""

    def __init__(self, raw):
        self.raw, self.z, self.held = raw, zlib.decompressobj(31), b""

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while not self.held:
            data = self.z.unused_data if self.z.eof else b""
            if self.z.eof:
                self.z = zlib.decompressobj(31)
            data = data or self.raw.read(1 << 16)
            if not data:
                return 0
            self.held = self.z.decompress(data)
        n = min(len(into), len(self.held))
        into[:n], self.held = self.held[:n], self.held[n:]
        return n


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record of an open .warc.gz."""
    f = io.BufferedReader(_Chain(stream), 1 << 18)
    while first := f.readline():
        if not first.strip():
            continue
        if not first.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        head = {}
        while (line := f.readline().rstrip(b"\r\n")) != b"":
            k, _, v = line.decode().partition(": ")
            head[k.lower()] = v
        block = f.read(int(head["content-length"]))
        if f"sha1:{b32encode(hashlib.sha1(block).digest()).decode()}" != head["warc-block-digest"]:
            raise ValueError(f"damaged record {head['warc-record-id']}")
        yield head, block


RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, file string"


def read(spark: SparkSession, root: str, payloads: bool = True) -> DataFrame:
    """One row per record of the committed files. A response's length and digest are those of the
    payload read; a revisit has those its headers give. Damaged records are errors."""
    import base64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(root)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("file", pa.string())])
        for batch in batches:
            for name in batch.column("name").to_pylist():
                held, size = [], 0
                with store.open_input_stream(posixpath.join(base, name), compression=None) as raw:
                    for h, block in records(raw):
                        body = block[block.index(b"\r\n\r\n") + 4 :]
                        stated = base64.b32decode(h["warc-payload-digest"][5:]).hex()
                        kind, page = h["warc-type"], h["warc-x-page-id"]
                        if kind == "response" and hashlib.sha1(body).hexdigest() != stated:
                            raise ValueError(f"damaged payload in {name}")
                        held.append((int(page) if page else None, h["warc-target-uri"], len(body) if kind == "response" else int(h["warc-x-payload-length"]), stated, kind, int(h["warc-x-refers-to-page-id"]) if kind == "revisit" else None, body if payloads and kind == "response" else None, name))
                        size += len(body) if payloads else 100
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)

    files = manifest(spark, root)
    n = max(1, min(files.count(), 100_000))
    spread = files.select("name").withColumn("__p", F.row_number().over(_by_name()) % n)
    return spread.repartitionById(n, F.col("__p")).mapInArrow(run, RECORDS)


def _by_name():
    from pyspark.sql.window import Window

    return Window.orderBy("name")  # one row a file
