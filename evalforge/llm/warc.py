"""WARC archives: a writer with revisit records and a splittable reader.

Archives are gzip members, one a record, in the cluster's shared folder. The reader cuts
every file into byte ranges, one a task. A task looks for gzip magic in its range, takes a
place for a member only if decoding its beginning yields a WARC header, and owns the
records that start inside the range; the last of them is read past the range's end. From a
record's end on, members follow each other, so bytes inside a record are never searched.

Scale: records are written where pages are read. Which pages revisit another is decided on
digests alone; only digests that occur more than once are joined back, by a broadcast
while their counted number stays within a bound. A file belongs to the task attempt whose
row in the manifest was committed; files of lost attempts are never read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, small

MAGIC = b"\x1f\x8b\x08"
CHUNK = 1 << 20
SPLIT_BYTES = 4 << 20
#: A task starts a new file beyond so many bytes.
FILE_BYTES = 1 << 30
WRITTEN = "path string, size long, records long"
RECORD = "page_id {id}, record_type string, refers_to {id}, uri string, payload_bytes long, payload_digest string, intact boolean, payload binary"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def encode(page_id, url: str | None, payload: bytes, refers_to=None, revisit: bool = False, date: str = "2020-01-01T00:00:00Z") -> bytes:
    """One record as a gzip member. A revisit keeps the HTTP header and leaves out the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {date}",
        f"WARC-Target-URI: {' '.join((url or '').split())}", f"WARC-Payload-Digest: sha1:{digest32(payload)}", "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def decode(record: bytes) -> dict:
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next((int(x.split(b":", 1)[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(payload))
    name = lambda key: (v := fields.get(key, "").removeprefix("<urn:page:").removesuffix(">")) and v not in ("None", "") and v or None
    kind, told = fields.get("warc-type"), fields.get("warc-payload-digest", "").removeprefix("sha1:")
    return {
        "page_id": name("warc-record-id"), "record_type": kind, "refers_to": name("warc-refers-to"), "uri": fields.get("warc-target-uri") or None,
        "payload_bytes": length if kind == "revisit" else len(payload), "payload_digest": told if kind == "revisit" else digest32(payload),
        "intact": kind == "revisit" or len(payload) == length and digest32(payload) == told, "payload": None if kind == "revisit" else payload,
    }


class Archive:
    """A file of gzip members, read by byte ranges."""

    def __init__(self, uri: str):
        store, path = fs.FileSystem.from_uri(uri)
        self.file = store.open_input_file(path)

    def __enter__(self) -> Archive:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def bytes_at(self, pos: int, n: int) -> bytes:
        self.file.seek(pos)
        return self.file.read(n)

    def starts_record(self, pos: int) -> bool:
        try:
            return zlib.decompressobj(31).decompress(self.bytes_at(pos, 4096), 8).startswith(b"WARC/1.")
        except zlib.error:
            return False

    def next_record(self, pos: int, end: int) -> int | None:
        """The first place in [pos, end) where a record starts."""
        while pos < end:
            data = self.bytes_at(pos, CHUNK + len(MAGIC) - 1)
            at = data.find(MAGIC)
            while at >= 0:
                if pos + at >= end:
                    return None
                if self.starts_record(pos + at):
                    return pos + at
                at = data.find(MAGIC, at + 1)
            pos += CHUNK
        return None

    def member(self, pos: int) -> tuple[bytes, int]:
        """The decoded member at pos, and where it ends."""
        z, out = zlib.decompressobj(31), []
        while not z.eof:
            data = self.bytes_at(pos, CHUNK if out else 1 << 16)
            if not data:
                raise EOFError("a record is cut off")
            out.append(z.decompress(data))
            pos += len(data)
        return b"".join(out), pos - len(z.unused_data)

    def records(self, start: int, end: int) -> Iterator[dict]:
        pos = self.next_record(start, end)
        while pos is not None and pos < end:
            data, pos = self.member(pos)
            yield decode(data)
            if pos < end and not self.starts_record(pos):
                pos = self.next_record(pos, end)


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record for every row of pages to archives in the folder; the result, which
    must be run once and kept (as Scratch.save does), names the files: path, size, records.

    The payload is the html in UTF-8, null as empty. Of rows with equal payloads, empty
    ones too, that with the largest id is a response and the others revisit it; rows that
    repeat this id are responses as well. Null ids come last; if a group has no other, all
    its rows are responses.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    many = rows.groupBy("sha").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("c")).filter("c > 1").select("sha", "first")
    many = Scratch(pages.sparkSession, "warc-digests").save(many)
    rows = rows.join(small(many), "sha", "left")
    revisits = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    rows = rows.select("id", "url", "payload", F.when(revisits, F.col("first")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, done, n = None, [], 0
        for b in batches:
            for i, url, payload, ref in zip(*(b.column(c).to_pylist() for c in ("id", "url", "payload", "refers_to")), strict=True):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, n = store.open_output_stream(f"{root}/{name}", compression=None), 0
                out.write(encode(i, url, payload, ref, ref is not None))
                n += 1
                if out.tell() >= FILE_BYTES:
                    done.append((f"{folder}/{name}", out.tell(), n))
                    out.close()
                    out = None
        if out is not None:
            done.append((f"{folder}/{name}", out.tell(), n))
            out.close()
        cols = list(zip(*done)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], ["path", "size", "records"])

    return rows.mapInArrow(run, WRITTEN)


def read(files: DataFrame, id_type: str = "bigint", split_bytes: int = SPLIT_BYTES, payload: bool = True) -> DataFrame:
    """The records of archives (path, size), read by byte ranges; see RECORD for columns.
    A revisit has the digest and length of the payload that it refers to. `payload` false
    leaves the payloads out once they are checked."""
    splits = files.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    n = splits.count()
    spec = RECORD.format(id=id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in spec.split(", ")]
        as_id = int if id_type in ("bigint", "int", "long") else str

        def batch(found: list[dict]) -> pa.RecordBatch:
            for r in found:
                for k in ("page_id", "refers_to"):
                    r[k] = None if r[k] is None else as_id(r[k])
                r["payload"] = r["payload"] if payload else None
            ids = pa.int64() if as_id is int and id_type != "int" else pa.int32() if as_id is int else pa.string()
            kinds = [ids, pa.string(), ids, pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in zip(names, kinds, strict=True)], names)

        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist(), strict=True):
                found, total = [], 0
                with Archive(path) as archive:
                    for r in archive.records(start, start + split_bytes):
                        found.append(r)
                        total += len(r["payload"] or b"")
                        if total > 8 * CHUNK or len(found) >= 2000:
                            yield batch(found)
                            found, total = [], 0
                if found:
                    yield batch(found)

    return splits.repartition(max(1, n)).mapInArrow(run, spec)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Archive the pages in the shared folder and read them back."""
    scratch = Scratch(spark, "warc")
    files = scratch.save(write(pages, scratch.path("archives")), "manifest")
    out = read(files, pages.schema["page_id"].dataType.simpleString(), payload=False)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "uri", "intact")


#: DuckDB has SHA-1 in hexadecimal; its 160 bits are taken by fives.
ORACLE = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
k AS (SELECT *, sha1(h) AS hex, max(page_id) OVER (PARTITION BY h) AS first FROM p),
b AS (SELECT *, array_to_string(list_transform(generate_series(1, 40), lambda i: right(bin(('0x' || hex[i])::INT + 16), 4)), '') AS bits FROM k)
SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes,
  array_to_string(list_transform(generate_series(0, 31), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(
    16 * bits[5*i+1]::INT + 8 * bits[5*i+2]::INT + 4 * bits[5*i+3]::INT + 2 * bits[5*i+4]::INT + bits[5*i+5]::INT) + 1]), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to,
  nullif(trim(url), '') AS uri, true AS intact FROM b
"""
