"""WARC: archives of pages, and a sequential reader for them.

Writing. Copies of a payload are found by one small aggregation over digests
(largest page id per digest, with map-side combining); pages then learn their
role by page id, so that a payload that a third of all pages share is never
brought together. Each task writes archives of bounded size into the shared
folder, one gzip member per record, under names that hold the task attempt: a
repeated task cannot touch what another one wrote, and only archives listed in
the manifest of the attempt that succeeded are read.

Reading. Each archive is a stream that is read once from front to end:
compressed bytes go through an incremental zlib decompressor in small steps, a
record's header is split off, its block is framed by Content-Length, and block
and payload digests are computed as the bytes pass and held against the
header. A record must end with its gzip member. Damage raises ``WarcError``.

Files are opened with pyarrow's file systems, so that the shared folder can be
any store these know (``file:``, ``hdfs:``, ``s3:`` and others).

Defined cases: null html is an empty payload; a null url gives the target
``urn:x-none``; pages that repeat an id are each written; of pages that tie on
the largest id each is a response; a null page id comes back null, and such a
page revisits the response of its payload if one has an id; an empty table
writes no record and reads as no row; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetwatch.llm.common import cut

#: Fixed values of the WARC format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: High halves of record ids: of pages with an id, and of pages without one.
_PAGE, _NO_PAGE = 0x66616365_7477_4000 << 64, 0x66616365_7477_4001 << 64
_MASK = (1 << 64) - 1
STEP = 1 << 16
#: Bytes of archives that a reading task gets.
TASK_BYTES = 128 << 20


class WarcError(ValueError):
    """A record that breaks the format or its digests."""


def record_id(page_id: int | None, other: int = 0) -> str:
    """The record id of a page; it holds the page id in its low 64 bits."""
    return f"<urn:uuid:{uuid.UUID(int=_NO_PAGE | other & _MASK if page_id is None else _PAGE | page_id & _MASK)}>"


def page_of(rid: str) -> int | None:
    """The page id in a record id."""
    n = uuid.UUID(rid.strip("<>").removeprefix("urn:uuid:")).int
    if n & ~_MASK != _PAGE:
        return None
    low = n & _MASK
    return low - (1 << 64) if low >> 63 else low


def _digest(h) -> str:
    return "sha1:" + base64.b32encode(h.digest()).decode()


def make_record(rid: str, uri: str | None, payload: bytes, refers_to: str | None = None, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """One record as a gzip member; with ``refers_to`` it is a revisit without its payload."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers_to is None:
        block += payload
    uri = "".join(c for c in uri or "urn:x-none" if c not in "\r\n")
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", rid), ("WARC-Date", date), ("WARC-Target-URI", uri)]
    if refers_to is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", refers_to)]
    head += [("WARC-Payload-Digest", _digest(hashlib.sha1(payload))), ("WARC-Block-Digest", _digest(hashlib.sha1(block))), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    raw = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


class _Members:
    """Bytes of one gzip member after the other out of a stream."""

    def __init__(self, stream: BinaryIO):
        self.stream, self.raw, self.z = stream, b"", None

    def begin(self) -> bool:
        """Goes to the next member; False at the end of the stream."""
        if not self.raw:
            self.raw = self.stream.read(STEP)
        self.z = zlib.decompressobj(31) if self.raw else None
        return self.z is not None

    def some(self) -> bytes:
        """A piece of the member; empty at its end."""
        while not self.z.eof:
            if not self.raw and not self.z.unconsumed_tail:
                self.raw = self.stream.read(STEP)
                if not self.raw:
                    raise WarcError("the archive ends inside a gzip member")
            out = self.z.decompress(self.z.unconsumed_tail + self.raw, STEP)
            self.raw = b""
            if self.z.eof:
                self.raw = self.z.unused_data
            if out:
                return out
        return b""


def _headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:]) if k}


def read_records(stream: BinaryIO, payloads: bool = True) -> Iterator[dict]:
    """Records of an archive in order; each one is checked before it is given out."""
    members = _Members(stream)
    try:
        while members.begin():
            got = b""
            while b"\r\n\r\n" not in got:
                part = members.some()
                if not part:
                    raise WarcError("a record's header has no end")
                got += part
            raw, _, got = got.partition(b"\r\n\r\n")
            if not raw.startswith(b"WARC/"):
                raise WarcError("a record does not begin with its version")
            head = _headers(raw)
            if not head.get("content-length", "").isdigit():
                raise WarcError("a record has no Content-Length")
            left = int(head["content-length"])
            block, payload, http, size, kept = hashlib.sha1(), hashlib.sha1(), b"", 0, []
            in_http = head.get("content-type", "").startswith("application/http")
            http_head = None if in_http else {}
            while left:
                if not got:
                    got = members.some()
                    if not got:
                        raise WarcError("a record is shorter than its Content-Length")
                part, got = got[:left], got[left:]
                left -= len(part)
                block.update(part)
                if http_head is None:
                    http += part
                    if b"\r\n\r\n" not in http:
                        continue
                    raw, _, part = http.partition(b"\r\n\r\n")
                    http_head = _headers(raw)
                payload.update(part)
                size += len(part)
                if payloads:
                    kept.append(part)
            while len(got) <= 4 and (part := members.some()):
                got += part
            if got != b"\r\n\r\n":
                raise WarcError("a record does not end with its gzip member")
            if head.get("warc-block-digest", _digest(block)) != _digest(block):
                raise WarcError(f"block digest of {head.get('warc-record-id')}")
            revisit = head.get("warc-type") == "revisit"
            if not revisit and head.get("warc-payload-digest", _digest(payload)) != _digest(payload):
                raise WarcError(f"payload digest of {head.get('warc-record-id')}")
            if revisit:
                if not (n := (http_head or {}).get("content-length", "")).isdigit():
                    raise WarcError("a revisit does not tell the length of its payload")
                size, digest = int(n), base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
            else:
                digest = payload.hexdigest()
            yield {"record_id": head["warc-record-id"], "record_type": head["warc-type"], "target_uri": head.get("warc-target-uri"), "refers_to": head.get("warc-refers-to"), "payload_bytes": size, "payload_digest": digest, "payload": b"".join(kept) if payloads and not revisit else None}
    except zlib.error as e:
        raise WarcError(f"broken gzip member: {e}") from e


def roles(pages: DataFrame, least: int = 1000) -> DataFrame:
    """``page_id, digest, refers_to`` of the pages that revisit another one."""
    small = pages.select("page_id", "digest", "size").where(F.col("size") >= least)
    keeper = small.groupBy("digest", "size").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null").drop("n")
    found = small.join(keeper, ["digest", "size"]).where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    return found.select(F.col("page_id").alias("__page"), F.col("digest").alias("__digest"), "refers_to").distinct()


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 1000, archive_bytes: int = 64 << 20) -> DataFrame:
    """Writes a record per page below ``folder``; returns the manifest ``path, n_records, n_bytes``."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload"))
    again = roles(rows, least)
    rows = rows.join(again, F.col("page_id").eqNullSafe(F.col("__page")) & (F.col("digest") == F.col("__digest")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        stem, k, out, path, records, size, done = f"part-{task.partitionId():06d}-{task.taskAttemptId()}", 0, None, "", 0, 0, []
        for b in batches:
            for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    path = f"{stem}-{len(done):04d}.warc.gz"
                    out, records, size = store.open_output_stream(f"{base}/{path}", compression=None), 0, 0
                k += 1
                raw = make_record(record_id(page_id, task.partitionId() << 40 | k), url, payload, None if refers_to is None else record_id(refers_to))
                out.write(raw)
                records, size = records + 1, size + len(raw)
                if size >= archive_bytes:
                    out.close()
                    done.append((path, records, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path, records, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{d[0]}" for d in done]), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], ["path", "n_records", "n_bytes"])

    return cut(rows.select("page_id", "url", "payload", "refers_to").mapInArrow(run, "path string, n_records long, n_bytes long"))


def read_archives(archives: DataFrame, payloads: bool = True, readers: int | None = None) -> DataFrame:
    """All records of the archives in column ``path``, one archive after the other in each task.

    Archives are dealt evenly to ``readers`` tasks; by default to as many as their
    bytes ask for, two for each core at least, and no more than there are archives.
    """
    if readers is None:
        size = F.sum("n_bytes") if "n_bytes" in archives.columns else F.lit(None).cast("long")
        n, total = archives.agg(F.count("*"), size).first()
        readers = max(1, min(n, max(2 * archives.sparkSession.sparkContext.defaultParallelism, -(-(total or n * TASK_BYTES) // TASK_BYTES))))
    schema = "path string, record_id string, record_type string, target_uri string, page_id long, refers_to long, payload_bytes long, payload_digest string" + ", payload binary" * payloads
    names = [x.split()[0] for x in schema.split(", ")]

    def batch(rows: list[dict]) -> pa.RecordBatch:
        kinds = {"page_id": pa.int64(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in names], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                store, at = fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with store.open_input_stream(at, compression=None) as stream:
                    for r in read_records(stream, payloads):
                        refers_to = page_of(r["refers_to"]) if r["refers_to"] else None
                        rows.append(r | {"path": path, "page_id": page_of(r["record_id"]), "refers_to": refers_to})
                        held += len(r["payload"] or b"")
                        if len(rows) >= 2000 or held > 8 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    return archives.select("path").repartition(readers).mapInArrow(run, schema)
