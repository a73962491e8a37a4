"""WARC archives: a writer that stores repeated payloads once, and a splittable reader.

Writer: every row becomes one record in a gzip member of its own. Of the rows whose payloads are equal and hold
at least ``least`` bytes, the one with the smallest id is written as a response; the others become revisit
records that name it and carry no payload. Only the digests that occur more than once are joined to the rows:
by broadcast while they are few, else by a sort-merge join (which AQE splits where one digest is hot). Each
task writes one archive under a name of its own attempt and reports it in the manifest; files of attempts that
were lost are not in the manifest and so are never read.

Reader: tasks get byte ranges. A task looks for gzip magic from the start of its range, validates a candidate by
decoding the member's header, and owns the records whose members start inside the range, reading past its end
where the last one needs it. A member that is not a WARC record is passed over.

Defined results: a null payload is an empty one; rows with a null id never name a group and come back with a
null id; rows that repeat the smallest id of a group are all responses; an empty table gives an empty manifest
and no records; only the named columns are read, so other columns may have any name. Line breaks in a URL are
percent-encoded. Memory: one Arrow batch when writing, one record when reading.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .common import fresh_path, stored

MAGIC = b"\x1f\x8b\x08"
BLOCK, STEP = 1 << 20, 1 << 14
#: More repeated digests than this are joined without a broadcast (some 100 bytes each).
BROADCAST_ROWS = 200_000
MANIFEST = "path string, bytes long, records long"
RECORDS = "record_id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string"


def open_store(uri: str):
    """(file system, path) of a folder or file in the shared store."""
    from pyarrow import fs

    uri = re.sub(r"^s3a:", "s3:", re.sub(r"^file:/+", "/", uri))
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def member(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One record as a gzip member."""
    urn = f"<urn:page:{quote(str(page_id), safe='')}>" if page_id is not None else f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, digest)}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {urn}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: <urn:page:{quote(str(refers_to), safe='')}>")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(4, wbits=31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 100) -> DataFrame:
    """Write the archives; returns the manifest (path, bytes, records), stored."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    groups = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("id").alias("first_id"), F.count("*").alias("n"))
    firsts = stored(groups.where("n > 1 AND first_id IS NOT NULL").select(F.col("digest").alias("same"), "first_id"), "warc-repeats")
    if firsts.count() <= BROADCAST_ROWS:
        firsts = F.broadcast(firsts)
    # payloads too short to be shared are dealt out by row, not by digest
    key = F.when(F.octet_length("payload") >= least, F.col("digest")).otherwise(F.concat(F.lit("#"), F.xxhash64("id", "url").cast("string")))
    rows = rows.withColumn("same", key).join(firsts, "same", "left")
    refers = F.when(F.col("first_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    rows = rows.select("id", "url", "payload", "digest", refers.alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, size, records = None, "", 0, 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    store, at = open_store(path)
                    store.create_dir(at.rpartition("/")[0], recursive=True)
                    out = store.open_output_stream(at, compression=None)
                data = member(*row)
                out.write(data)
                size, records = size + len(data), records + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"path": path, "bytes": size, "records": records}])

    ship(pages.sparkSession)
    return stored(rows.mapInArrow(run, MANIFEST), "warc-manifest")


def parse(data: bytes) -> tuple | None:
    """(record_id, url, type, payload_bytes, payload_digest, refers_to, payload) of a decoded member."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not found or not lines[0].startswith("WARC/1."):
        return None
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = fields.get("content-length", "")
    if not n.isdigit() or len(rest) < int(n) or "warc-type" not in fields:
        return None
    http, _, payload = rest[: int(n)].partition(b"\r\n\r\n")
    urn = lambda x: unquote(m[1]) if (m := re.fullmatch(r"<urn:page:(.*)>", x)) else None
    if fields["warc-type"] == "revisit":
        size = re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)
        return urn(fields.get("warc-record-id", "")), fields.get("warc-target-uri"), "revisit", int(size[1]) if size else None, fields.get("warc-payload-digest", "").removeprefix("sha256:"), urn(fields.get("warc-refers-to", "")), None
    return urn(fields.get("warc-record-id", "")), fields.get("warc-target-uri"), fields["warc-type"], len(payload), hashlib.sha256(payload).hexdigest(), None, payload


class Window:
    """Reads of a file in large blocks, of which small views are taken."""

    def __init__(self, file):
        self.file, self.at, self.block = file, 0, b""

    def view(self, pos: int, n: int = STEP) -> bytes:
        """Up to n bytes from pos; none at the end of the file."""
        i = pos - self.at
        if i < 0 or i + n > len(self.block):
            self.file.seek(pos)
            self.at, self.block, i = pos, self.file.read(max(n, BLOCK)), 0
        return self.block[i : i + n]


def decode_member(window: Window, at: int) -> tuple[tuple | None, int]:
    """(record, length of its member) at a position; (None, 1) if no valid record starts there."""
    z, out, pos = zlib.decompressobj(31), bytearray(), at
    try:
        while not z.eof:
            data = window.view(pos)
            if not data:
                return None, 1
            pos += len(data)
            out += z.decompress(data)
            if len(out) >= 7 and not out.startswith(b"WARC/1."):
                return None, 1
    except zlib.error:
        return None, 1
    record = parse(bytes(out))
    return (record, pos - len(z.unused_data) - at) if record else (None, 1)


def records_in(file, start: int, end: int) -> Iterator[tuple]:
    """The records whose members start in [start, end)."""
    window, pos = Window(file), start
    while pos < end:
        data = window.view(pos)
        i = data.find(MAGIC)
        if i < 0:
            pos += max(1, len(data) - len(MAGIC) + 1)
            continue
        pos += i
        if pos >= end:
            return
        record, length = decode_member(window, pos)
        if record:
            yield record
        pos += length


def read_warc(manifest: DataFrame, split_bytes: int = 8 << 20, with_payload: bool = False) -> DataFrame:
    """The records of the archives that a (path, bytes) table lists."""
    ranges = manifest.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    # the ranges are few bytes but much work: a stated number of partitions is not merged into a few tasks
    splits = manifest.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 1
    ranges = ranges.repartition(int(splits), "path", "start")
    schema = RECORDS + (", payload binary" if with_payload else "")
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.binary() if n == "payload" else pa.int64() if n == "payload_bytes" else pa.string() for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, size, start in zip(*(c.to_pylist() for c in b.columns)):
                store, at = open_store(path)
                rows, held = [], 0
                with store.open_input_file(at) as f:
                    for r in records_in(f, start, min(size, start + split_bytes)):
                        rows.append(r[: len(names)])
                        held += len(r[6] or b"") if with_payload else 200
                        if held > 16 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    ship(manifest.sparkSession)
    return ranges.mapInArrow(run, schema)


def round_trip(spark: SparkSession, pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Write all pages and read the archives back: one row per page."""
    kind = pages.schema[id_col].dataType
    manifest = write_warc(pages, fresh_path(spark, "warc"), id_col)
    return read_warc(manifest).select(F.col("record_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


ORACLE = """
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
             min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id FROM pages)"""
