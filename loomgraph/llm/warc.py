"""WARC records in ZIP archives: written, then read back by range without extraction.

An archive holds stored members: files of gzip records (one gzip member for each record, so each can be
read alone) and an index of their ranges.  The reader parses the end record, the ZIP64 locator and end
record, and the central directory with its ZIP64 fields; locates the stored members and the index;
deals out ranges; and reads and inflates each record from its range.

Archives go to the folder that all executors share, through pyarrow's file systems (a mount, HDFS, S3, GS).
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import bounded_batches, shared_dir, written

#: Bytes of records in one archive, in one read, in one share of an archive, and in the shares of one task.
ARCHIVE_BYTES = 128 << 20
READ_BYTES = 4 << 20
SHARE_BYTES = 2 << 20
TASK_BYTES = 32 << 20
#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 0
INDEX = "index.jsonl"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def record_id(page_id: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}|{digest}')}>"


def record(page_id: str | None, url: str | None, payload: bytes, digest: str, response: bool, leader: str | None) -> bytes:
    """One WARC/1.1 record.  A revisit has the HTTP head alone and refers to the response's record."""
    head = ["WARC/1.1", f"WARC-Type: {'response' if response else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest)}", "WARC-Date: 2024-01-01T00:00:00Z"]
    if page_id is not None:
        head.append(f"X-Page-ID: {quote(page_id, safe='')}")
    if url:
        head.append(f"WARC-Target-URI: {url.replace('%', '%25').replace(chr(13), '%0D').replace(chr(10), '%0A')}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if not response:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(leader, digest)}"]
    body = _HTTP + payload if response else _HTTP
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """A record's header fields, by lower-case name, and its payload (HTTP head removed)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode().split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    body = rest[: int(fields["content-length"])]
    return fields, body.partition(b"\r\n\r\n")[2]


class Writer:
    """A stream of records to one archive; the index member follows the records."""

    def __init__(self, root: str) -> None:
        self.system, folder = opened(root)
        self.system.create_dir(folder, recursive=True)
        name = f"{uuid.uuid4().hex}.zip"  # a repeated attempt writes another archive; only the manifest's are read
        self.path = f"{root}/{name}"
        self.out = self.system.open_output_stream(f"{folder}/{name}")
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(zipfile.ZipInfo("records-00000.warc.gz"), "w", force_zip64=True)
        self.at = 0
        self.index: list[tuple[int, int]] = []

    def add(self, raw: bytes) -> None:
        packed = gzip.compress(raw, compresslevel=3, mtime=0)
        self.member.write(packed)
        self.index.append((self.at, len(packed)))
        self.at += len(packed)

    def close(self) -> tuple[str, int, int]:
        """(path, records, bytes of records)."""
        self.member.close()
        with self.zip.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as f:
            for offset, length in self.index:
                f.write(json.dumps({"member": "records-00000.warc.gz", "offset": offset, "length": length}).encode() + b"\n")
        self.zip.close()
        self.out.close()
        return self.path, len(self.index), self.at


def _write(root: str, archive_bytes: int) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Writer | None = None
        done: list[tuple[str, int, int]] = []
        for batch in batches:
            cols = [batch.column(c) for c in ("i", "u", "payload", "digest", "response", "leader")]
            for i, u, payload, digest, response, leader in zip(*cols, strict=True):
                now = now or Writer(root)
                now.add(record(i.as_py(), u.as_py(), payload.as_py(), base32(digest.as_py()), response.as_py(), leader.as_py()))
                if now.at >= archive_bytes:
                    done.append(now.close())
                    now = None
        if now:
            done.append(now.close())
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["path", "records", "bytes"])

    return run


@dataclass
class Member:
    name: str
    method: int
    packed: int
    header: int


def members(f: BinaryIO, size: int) -> list[Member]:
    """The central directory of a ZIP or ZIP64 archive, from ranges at its end."""
    tail_at = max(0, size - 65_557)
    f.seek(tail_at)
    tail = f.read(size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end record: not a ZIP archive")
    count, length, at = struct.unpack("<HII", tail[end + 10 : end + 20])
    locator = end - 20
    if locator >= 0 and tail[locator : locator + 4] == b"PK\x06\x07":
        f.seek(struct.unpack("<Q", tail[locator + 8 : locator + 16])[0])
        far = f.read(56)
        if far[:4] != b"PK\x06\x06":
            raise ValueError("the ZIP64 locator points to no end record")
        count, length, at = struct.unpack("<QQQ", far[32:56])
    elif 0xFFFF == count or 0xFFFFFFFF in (length, at):
        raise ValueError("ZIP64 values without a locator")
    f.seek(at)
    raw, out, p = f.read(length), [], 0
    for _ in range(count):
        if raw[p : p + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method, = struct.unpack("<H", raw[p + 10 : p + 12])
        packed, plain, n, m, k = struct.unpack("<IIHHH", raw[p + 20 : p + 34])
        header, = struct.unpack("<I", raw[p + 42 : p + 46])
        name = raw[p + 46 : p + 46 + n].decode()
        extra = raw[p + 46 + n : p + 46 + n + m]
        while len(extra) >= 4:
            tag, room = struct.unpack("<HH", extra[:4])
            if tag == 1:  # 64-bit values, in this order, of the fields that are full
                wide = list(struct.unpack(f"<{room // 8}Q", extra[4 : 4 + room // 8 * 8]))
                if plain == 0xFFFFFFFF:
                    plain = wide.pop(0)
                if packed == 0xFFFFFFFF:
                    packed = wide.pop(0)
                if header == 0xFFFFFFFF:
                    header = wide.pop(0)
            extra = extra[4 + room :]
        out.append(Member(name, method, packed, header))
        p += 46 + n + m + k
    return out


def data_start(f: BinaryIO, m: Member) -> int:
    """Where a stored member's bytes begin."""
    if m.method != 0:
        raise ValueError(f"{m.name} is not stored")
    f.seek(m.header)
    local = f.read(30)
    if local[:4] != b"PK\x03\x04":
        raise ValueError(f"{m.name} has no local header")
    n, k = struct.unpack("<HH", local[26:30])
    return m.header + 30 + n + k


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Archive paths to a row for each record: path, offset in the archive, length."""
    for batch in batches:
        for path in batch.column("path").to_pylist():
            system, name = opened(path)
            with system.open_input_file(name) as f:
                found = {m.name: m for m in members(f, f.size())}
                starts = {n: data_start(f, m) for n, m in found.items() if n.endswith(".warc.gz")}
                index = found[INDEX]
                at, left, rest = data_start(f, index), index.packed, b""
                while left:
                    f.seek(at)
                    part = f.read(min(left, READ_BYTES))
                    at, left = at + len(part), left - len(part)
                    lines = (rest + part).split(b"\n")
                    rest = lines.pop()
                    rows = [json.loads(x) for x in lines]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), pa.array([starts[r["member"]] + r["offset"] for r in rows], pa.int64()), pa.array([r["length"] for r in rows], pa.int64())], names=["path", "offset", "length"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges, sorted by path and offset, to records; near ranges share a read."""
    path, f, have_at, have = None, None, 0, b""
    try:
        for batch in batches:
            rows = []
            spans = list(zip(*[batch.column(c).to_pylist() for c in ("path", "offset", "length")], strict=True))
            for k, (p, offset, length) in enumerate(spans):
                if p != path:
                    if f:
                        f.close()
                    system, name = opened(p)
                    path, f, have_at, have = p, system.open_input_file(name), 0, b""
                if not (have_at <= offset and offset + length <= have_at + len(have)):
                    end = offset + length
                    for q, o, n in spans[k + 1 :]:
                        if q != p or o > end + 4096 or o + n - offset > READ_BYTES:
                            break
                        end = max(end, o + n)
                    f.seek(offset)
                    have_at, have = offset, f.read(end - offset)
                fields, payload = parse(zlib.decompress(have[offset - have_at : offset - have_at + length], wbits=31))
                digest = fields["warc-payload-digest"].removeprefix("sha1:")
                kind = fields["warc-type"]
                if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                    raise ValueError(f"{fields['warc-record-id']}: the payload does not have its digest")
                page = fields.get("x-page-id")
                rows.append((fields["warc-record-id"], unquote(page) if page is not None else None, len(payload), digest, kind, fields.get("warc-refers-to")))
            kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["rid", "page", "bytes", "digest", "kind", "refers"])
    finally:
        if f:
            f.close()


def write_archives(pages: DataFrame, root: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = LEAST_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes pages as archives under root; the manifest (path, records, bytes) lists those of finished tasks.

    Of records with equal payloads of least_bytes or more, that with the largest id is the response and the
    others revisit it; rows that share the largest id are all responses, and a null id is the smallest.
    Ids are of any type that casts to a string and back.  A null page has the empty payload.
    """
    bounded_batches(pages.sparkSession)
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    given = pages.select(F.col(id_col).alias("i"), F.col(url_col).alias("u"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    leaders = given.where(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(F.max("i").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "leader")
    leaders = written(leaders, "leaders")  # joined as a table, so that the rows of a very common payload can be split
    response = F.col("leader").isNull() | F.col("i").eqNullSafe(F.col("leader"))
    met = given.join(leaders, "digest", "left").select(F.col("i").cast("string").alias("i"), "u", "payload", "digest", response.alias("response"), F.col("leader").cast("string").alias("leader"))
    return written(met.mapInArrow(_write(root, archive_bytes), "path string, records bigint, bytes bigint"), "manifest")


def read_archives(manifest: DataFrame, id_col: str = "page_id", id_type: str = "bigint") -> DataFrame:
    """One row per record of the archives: id, payload_bytes, payload_digest, record_type, refers_to.

    Archives are listed and their records read by as many tasks as their bytes ask for.  A revisit's bytes
    and refers_to are those of the response that its record names.
    """
    archives, size = manifest.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    at_once = manifest.sparkSession.sparkContext.defaultParallelism
    listers, readers = max(1, min(archives, 10_000)), max(1, min(size // SHARE_BYTES, at_once), min(size // TASK_BYTES, 100_000))
    ranges = manifest.select("path").repartition(listers, "path").mapInArrow(_ranges, "path string, offset bigint, length bigint")
    dealt = ranges.withColumn("share", F.expr(f"offset div {SHARE_BYTES}")).repartition(readers, "path", "share").sortWithinPartitions("path", "offset").select("path", "offset", "length")
    records = written(dealt.mapInArrow(_read, "rid string, page string, bytes bigint, digest string, kind string, refers string"), "records")
    named = records.where("kind = 'response'").groupBy("rid").agg(F.max("page").alias("to"), F.max("bytes").alias("full")).withColumnRenamed("rid", "refers")
    met = records.where("kind = 'revisit'").join(named, "refers")
    out = records.where("kind = 'response'").select("page", "bytes", "digest", "kind", F.lit(None).cast("string").alias("refers_to"))
    out = out.union(met.select("page", F.col("full"), "digest", "kind", "to"))
    return out.select(F.col("page").cast(id_type).alias(id_col), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), F.col("refers_to").cast(id_type).alias("refers_to"))


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", **settings: int) -> DataFrame:
    """Writes the archives into a new folder of the shared one and reads them back."""
    root = f"{shared_dir(pages.sparkSession)}/loomgraph/archives-{uuid.uuid4().hex}"
    return read_archives(write_archives(pages, root, id_col, url_col, html_col, **settings), id_col, pages.schema[id_col].dataType.simpleString())
