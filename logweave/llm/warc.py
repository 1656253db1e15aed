"""WARC archives: a writer with revisit records, and a sequential reader.

One gzip member per record. The reader inflates step by step, takes a block's length from Content-Length, and verifies
the block's and the payload's SHA-1, so its memory is bounded by one read buffer and one record header.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import byte_slices, put, scratch_path

LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Archive records per reading task are bounded by the size at which a writer begins the next file.
FILE_BYTES = 256 << 20
#: Rows of one payload are spread over this many partitions.
SALTS = 16


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record(kind: str, page: str, url: str | None, block: bytes, payload_digest: str, more: list[str]) -> bytes:
    target = quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else f"urn:page:{page}"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page}>", f"WARC-Target-URI: {target}", f"WARC-Date: {DATE}",
            f"WARC-Payload-Digest: sha1:{payload_digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", "Content-Type: application/http; msgtype=response", *more, f"Content-Length: {len(block)}"]
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def _http(length: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()


def response_record(page: str, url: str | None, payload: bytes, payload_digest: str | None = None) -> bytes:
    return _record("response", page, url, _http(len(payload)) + payload, payload_digest or base32_sha1(payload), [])


def revisit_record(page: str, url: str | None, length: int, payload_digest: str, refers_to: str) -> bytes:
    """The payload is left out; its length stays in the HTTP header."""
    return _record("revisit", page, url, _http(length), payload_digest, [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{refers_to}>"])


@dataclass
class Record:
    headers: dict[str, str]
    http_length: int = 0
    payload_bytes: int = 0
    payload: bytes | None = None
    faults: list[str] = field(default_factory=list)


class _Member:
    """Inflated bytes of gzip members one after the other, from a file read step by step."""

    def __init__(self, stream, step: int = 1 << 18):
        self.stream, self.step, self.raw = stream, step, b""

    def next_member(self) -> bool:
        self.z, self.out = zlib.decompressobj(31), b""
        if not self.raw:
            self.raw = self.stream.read(self.step)
        return bool(self.raw)

    def more(self) -> bool:
        """Inflate another piece; False at the member's end."""
        while not self.z.eof:
            data = self.z.unconsumed_tail or self.raw
            if not data:
                data = self.stream.read(self.step)
                if not data:
                    raise ValueError("the archive ends within a record")
            got = self.z.decompress(data, self.step)
            self.raw = self.z.unused_data if self.z.eof else b""
            if got:
                self.out += got
                return True
        return False

    def until(self, mark: bytes) -> bytes:
        """What comes before the mark, however long: a header holds the URL, which may be."""
        begin = 0
        while (at := self.out.find(mark, begin)) < 0:
            begin = max(0, len(self.out) - len(mark))
            if not self.more():
                raise ValueError("a record has no end of header")
        head, self.out = self.out[:at], self.out[at + len(mark) :]
        return head

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.out and not self.more():
                raise ValueError("a block is shorter than its Content-Length")
            part, self.out = self.out[:n], self.out[n:]
            n -= len(part)
            yield part


def read_records(stream, keep_payload: bool = False) -> Iterator[Record]:
    """Records of an archive in order. Digests that don't agree are listed in faults; broken framing raises ValueError."""
    members = _Member(stream)
    while members.next_member():
        lines = members.until(b"\r\n\r\n").decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("a record has no version line")
        record = Record({k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])})
        block, payload, kept, head, in_head = hashlib.sha1(), hashlib.sha1(), [], b"", True
        for part in members.take(int(record.headers["content-length"])):
            block.update(part)
            if in_head:
                head += part
                if (at := head.find(b"\r\n\r\n")) < 0:
                    continue
                fields = dict(x.partition(": ")[::2] for x in head[:at].decode("latin-1").lower().split("\r\n")[1:])
                record.http_length = int(fields.get("content-length", 0))
                part, in_head = head[at + 4 :], False
            payload.update(part)
            record.payload_bytes += len(part)
            if keep_payload:
                kept.append(part)
        if b"".join(members.take(4)) != b"\r\n\r\n" or members.more() or members.out:
            raise ValueError("a record doesn't end where its Content-Length says")
        name = lambda h: "sha1:" + base64.b32encode(h.digest()).decode()
        if name(block) != record.headers.get("warc-block-digest", name(block)):
            record.faults.append("block digest")
        if record.headers["warc-type"] != "revisit":
            if name(payload) != record.headers.get("warc-payload-digest", name(payload)):
                record.faults.append("payload digest")
            if record.http_length != record.payload_bytes:
                record.faults.append("payload length")
        record.payload = b"".join(kept) if keep_payload else None
        yield record


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record per row of pages under `folder`; returns the archives' (path, records, bytes), which are on disk by then.

    Of rows with equal payloads of min_bytes or more, the one with the largest id becomes the response and the others
    revisit it; null ids come before all others, and of rows that tie in the id one becomes the response. Null html is an
    empty payload, a null url is written as a urn. Payloads are compressed before the shuffle that brings equal ones
    together, in salted groups, so one that fills a third of the table loads no single task.
    """
    spark = pages.sparkSession
    fsys, _ = _open(folder)
    html = F.coalesce(F.col(html_col), F.lit(""))
    row = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    row = row.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    first = row.where(F.octet_length("html") >= min_bytes).groupBy("digest", "salt").agg(F.max("id").alias("id"), F.count("*").alias("n"))
    first = first.groupBy("digest").agg(F.max("id").alias("last"), F.sum("n").alias("n"), F.collect_set("salt").alias("salts")).where("n > 1").select("digest", "last", F.explode("salts").alias("salt"))

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_slices(batches, "html"):
            payloads = [h.encode() for h in part.column("html").to_pylist()]
            digests = [base64.b32encode(bytes.fromhex(d)).decode() for d in part.column("digest").to_pylist()]
            records = [response_record(str(i), u, p, d) for i, u, p, d in zip(part.column("id").to_pylist(), part.column("url").to_pylist(), payloads, digests)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("id", "url", "digest", "salt")), pa.array(list(map(len, payloads)), pa.int64()), pa.array(records, pa.binary())], names=["id", "url", "digest", "salt", "length", "record"])

    packed = row.mapInArrow(squeeze, "id long, url string, digest string, salt int, length long, record binary")
    # rows that tie in the id have one salt, so after this they are in one task, however the join is run
    joined = packed.repartition("digest", "salt").join(first, ["digest", "salt"], "left")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fsys = _open(folder)[0]
        out, made, taken = None, [], set()

        def close() -> None:
            # a file appears under its name when it is whole; a task that runs twice writes the same bytes again
            stream.close()
            put(fsys, temp, final)
            made[-1][2] = size

        for b in byte_slices(batches, "record"):
            for id_, url, digest, length, record, last in zip(*(b.column(c).to_pylist() for c in ("id", "url", "digest", "length", "record", "last"))):
                if out is None:
                    final = _open(f"{folder}/part-{task.partitionId():06d}-{len(made):04d}.warc.gz")[1]
                    temp = f"{final}.{task.taskAttemptId()}"
                    stream, size, out = fsys.open_output_stream(temp, compression=None), 0, True
                    made.append([f"{folder}/{final.rsplit('/', 1)[1]}", 0, 0])
                if last is not None and (id_ != last or digest in taken):
                    record = revisit_record(str(id_), url, length, base64.b32encode(bytes.fromhex(digest)).decode(), str(last))
                elif last is not None:
                    taken.add(digest)
                stream.write(record)
                size += len(record)
                made[-1][1] += 1
                if size > FILE_BYTES:
                    close()
                    out = None
        if out:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], t) for k, t in ((0, pa.string()), (1, pa.int64()), (2, pa.int64()))], names=["path", "records", "bytes"])

    fsys.create_dir(_open(folder)[1], recursive=True)
    manifest = f"{folder}/manifest"
    joined.select("id", "url", "digest", "length", "record", "last").mapInArrow(write, "path string, records long, bytes long").write.mode("overwrite").parquet(manifest)
    return spark.read.schema("path string, records long, bytes long").parquet(manifest)


def read_archives(archives: DataFrame, path_col: str = "path", keep_payload: bool = False) -> DataFrame:
    """A row per record of the archives: record_id, page_id, uri, record_type, refers_to, payload_bytes, payload_digest and payload (if kept).

    A digest that doesn't hold, or framing that doesn't, fails the task. Archives are dealt to tasks one by one.
    """
    n = archives.count()
    schema = "page_id long, uri string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda urn: None if urn is None or (x := urn.rpartition(":")[2].rstrip(">")) == "None" else int(x)
        for b in batches:
            for path in b.column(0).to_pylist():
                fsys, inner = _open(path)
                rows: list[tuple] = []
                held = 0
                with fsys.open_input_stream(inner, compression=None) as stream:
                    for r in read_records(stream, keep_payload):
                        if r.faults:
                            raise ValueError(f"{path}: {r.headers.get('warc-record-id')}: {', '.join(r.faults)}")
                        h = r.headers
                        rows.append((number(h["warc-record-id"]), h["warc-target-uri"], h["warc-type"], number(h.get("warc-refers-to")), r.http_length, h["warc-payload-digest"][5:], r.payload))
                        held += len(r.payload or b"") + 200
                        if held > 4 << 20:
                            yield _rows(rows)
                            rows, held = [], 0
                if rows:
                    yield _rows(rows)

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["page_id", "uri", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"])

    dealt = archives.select(F.col(path_col).alias("path")).coalesce(1)  # a row per archive of up to FILE_BYTES
    return dealt.repartition(max(1, min(n, 10_000))).mapInArrow(run, schema)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write pages as archives in the shared folder and read them back: a row per page, as read_archives gives them.

    Nulls, ties and equal payloads are as write_archives says; pages that repeat in full give a response and revisits. An
    empty table gives no rows. Page ids are whole numbers; other columns aren't read.
    """
    folder = scratch_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder, min_bytes))
