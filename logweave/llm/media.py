"""Content-defined chunking of media payloads: gear-hash cuts, a deduplicated chunk store, verified reassembly.

A payload is stored as the samples of an 8-bit mono WAV file. The file is cut where a rolling gear hash says so, and each
distinct chunk is kept compressed in pack files in the shared folder, and referred to in one place only. A medium is an ordered list of chunk
digests; joins on digests find where each chunk lies, and the bytes are never shuffled: tasks write packs, and read them
back by position.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import byte_slices, filled, put, scratch_path

#: Chunk sizes: none under MIN but the last, a cut expected MEAN bytes after it, none over MAX.
MIN, MEAN, MAX = 1024, 4096, 32768
WINDOW = 32
_MASK = np.uint32((MEAN - 1) << 12)  # bits that depend on 12 to 24 bytes
GEAR = np.frombuffer(b"".join(hashlib.sha256(bytes([i])).digest()[:4] for i in range(256)), dtype="<u4").astype(np.uint32)
PACK_BYTES = 64 << 20


def wav(payload: bytes, rate: int = 8000) -> bytes:
    """The payload as unsigned 8-bit mono samples (always an even number of them here, so no padding byte)."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload)) + payload


def wav_payload(media: bytes) -> bytes:
    tag, size, kind, fmt, n, pcm, channels, _, _, _, bits, data, length = struct.unpack("<4sI4s4sIHHIIHH4sI", media[:44])
    if (tag, kind, fmt, n, pcm, channels, bits, data) != (b"RIFF", b"WAVE", b"fmt ", 16, 1, 1, 8, b"data") or length != len(media) - 44 or size != len(media) - 8:
        raise ValueError("this isn't an 8-bit mono WAV file")
    return media[44:]


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """h[i] = (h[i-1] << 1) + GEAR[data[i]] modulo 2^32, which the last 32 bytes decide; by doubling the window."""
    h, width = GEAR[data], 1
    while width < WINDOW:
        h[width:] += h[:-width].copy() << np.uint32(width) if len(h) > width else h[:0]
        width *= 2
    return h


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of one medium, in order; the last is its length."""
    marks = np.flatnonzero((gear_hashes(np.frombuffer(data, np.uint8)) & _MASK) == 0) + 1 if len(data) > MIN else np.zeros(0, np.int64)
    ends, start = [], 0
    while len(data) - start > MIN:
        k = int(np.searchsorted(marks, start + MIN))
        end = min(int(marks[k]) if k < len(marks) else len(data), start + MAX, len(data))
        if end == len(data):
            break
        ends.append(end)
        start = end
    return [*ends, len(data)]


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


class _Packer:
    """Pack files of one task. A pack appears under its final name when it's whole, so a task may run twice."""

    def __init__(self, folder: str, label: str):
        self.folder, self.label, self.made, self.out = folder, label, 0, None
        self.fsys, self.root = _open(folder)

    def add(self, data: bytes) -> tuple[str, int]:
        if self.out is None:
            self.name = f"{self.label}-{self.made:04d}.pack"
            self.temp = f"{self.root}/{self.name}.{TaskContext.get().taskAttemptId()}"
            self.out, self.size = self.fsys.open_output_stream(self.temp, compression=None), 0
        at = (self.name, self.size)
        self.out.write(data)
        self.size += len(data)
        if self.size > PACK_BYTES:
            self.close()
        return at

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            put(self.fsys, self.temp, f"{self.root}/{self.name}")
            self.out, self.made = None, self.made + 1


class _Packs:
    """Positions of pack files, a few of them open."""

    def __init__(self, folder: str):
        self.fsys, self.root = _open(folder)
        self.files: dict[str, pa.NativeFile] = {}

    def read(self, name: str, at: int, size: int) -> bytes:
        if name not in self.files:
            if len(self.files) >= 32:
                self.files.pop(next(iter(self.files))).close()
            self.files[name] = self.fsys.open_input_file(f"{self.root}/{name}")
        return self.files[name].read_at(size, at)


_PLACES = "digest binary, pack string, at long, size int"
_PIECES = "home int, row long, doc_id long, n_bytes long, seq int, digest binary, pack string, at long, size int"


def store(df: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", multiple: int = 64, max_unused: float = 0.1) -> DataFrame:
    """Store each row's text in `folder` as chunks; returns the recipes: a row per chunk of each medium with its pack, place and digest.

    A text is UTF-8, filled up with zero bytes to a positive multiple of `multiple` (null: empty). Repeated rows are media
    of their own with the same chunks; null ids stay null; an empty table has no recipes; other columns aren't read. First each task packs
    those of its chunks that it hasn't packed yet; of the copies that several tasks made, a join picks one, and recipes
    refer to that alone. A pack of which more than `max_unused` isn't referred to is then rewritten with what is, and
    deleted.
    """
    spark = df.sparkSession
    tables = f"{folder}/tables"
    for d in ("first", "compact"):
        fsys, inner = _open(f"{folder}/{d}")
        fsys.create_dir(inner, recursive=True)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        packer, seen, number, z = _Packer(folder, f"first/{task:06d}"), {}, 0, zstandard.ZstdCompressor(level=3)
        for part in byte_slices(batches, "text"):
            rows: list[tuple] = []
            for doc, text in zip(part.column("id").to_pylist(), filled(part.column("text")).to_pylist()):
                data = text.encode()
                media, start = wav(data + bytes(-len(data) % multiple if data else multiple)), 0
                for seq, end in enumerate(cuts(media)):
                    chunk = media[start:end]
                    digest, start = hashlib.sha256(chunk).digest(), end
                    if digest not in seen:
                        if len(seen) > 1_000_000:
                            seen.clear()
                        squeezed = z.compress(chunk)
                        seen[digest] = (*packer.add(squeezed), len(squeezed))
                    rows.append((task, number, doc, len(data), seq, digest, *seen[digest]))
                number += 1
            yield _batch(rows)
        packer.close()

    pieces_at = f"{tables}/pieces"
    df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(cut, _PIECES).write.parquet(pieces_at)
    pieces = spark.read.schema(_PIECES).parquet(pieces_at)
    chosen = pieces.groupBy("digest").agg(F.min(F.struct("pack", "at", "size")).alias("p")).select("digest", "p.*")

    chosen_at = f"{tables}/chosen"
    chosen.write.parquet(chosen_at)
    chosen = spark.read.schema(_PLACES).parquet(chosen_at)
    held = pieces.select("pack", "at", "size").distinct().groupBy("pack").agg(F.sum("size").alias("held"))
    used = chosen.groupBy("pack").agg(F.sum("size").alias("used"))
    wasteful_at = f"{tables}/wasteful"
    held.join(used, "pack", "left").where(F.coalesce("used", F.lit(0)) < (1 - max_unused) * F.col("held")).select("pack").write.parquet(wasteful_at)
    wasteful = spark.read.schema("pack string").parquet(wasteful_at)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        packs, packer = _Packs(folder), _Packer(folder, f"compact/{task:06d}")
        for b in batches:
            got = [packer.add(packs.read(p, a, s)) for p, a, s in zip(*(b.column(c).to_pylist() for c in ("pack", "at", "size")))]
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.int64()), b.column("size")], names=["digest", "pack", "at", "size"])
        packer.close()

    def delete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fsys, root = _open(folder)
        for b in batches:
            for pack in b.column("pack").to_pylist():
                if fsys.get_file_info(f"{root}/{pack}").type == fs.FileType.File:
                    fsys.delete_file(f"{root}/{pack}")
            yield b

    moved = chosen.join(wasteful, "pack", "left_semi").select("digest", "pack", "at", "size").repartition("pack").sortWithinPartitions("pack", "at")
    moved.mapInArrow(rewrite, _PLACES).write.parquet(f"{tables}/moved")
    wasteful.mapInArrow(delete, "pack string").write.format("noop").mode("overwrite").save()
    index = chosen.join(wasteful, "pack", "left_anti").select("digest", "pack", "at", "size").union(spark.read.schema(_PLACES).parquet(f"{tables}/moved"))
    # salted: copies of one chunk may be a third of all pieces, and each digest meets only the salts that it occurs with
    salted = pieces.drop("pack", "at", "size").withColumn("salt", F.pmod(F.xxhash64("home", "row"), F.lit(16)).cast("int"))
    salts = salted.groupBy("digest", "salt").agg(F.count("*").alias("n"))
    placed = salts.join(index, "digest").drop("n")
    return salted.join(placed, ["digest", "salt"]).drop("salt")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.string(), pa.int64(), pa.int32()]
    columns = list(zip(*rows)) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["home", "row", "doc_id", "n_bytes", "seq", "digest", "pack", "at", "size"])


def feature(payload: bytes) -> str:
    """Mean and deviation of the samples, how often neighbours cross the middle, and the loudest of eight equal parts."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64)
    crossings = int(np.count_nonzero((x[1:] >= 96) != (x[:-1] >= 96)))
    parts = np.add.reduceat(x * x, np.arange(8) * (len(x) // 8))
    return f"mean={x.mean():.6f};std={x.std():.6f};crossings={crossings};loudest={int(parts.argmax())}"


def load(recipes: DataFrame, folder: str) -> DataFrame:
    """Reassemble every medium from its chunk list, verify it, and describe it; a row per stored row.

    doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, chunks, feature. A chunk whose
    digest doesn't hold fails the task. No recipes give no rows.
    """
    one = recipes.repartition("home").groupBy("home", "row", "doc_id", "n_bytes").agg(F.sort_array(F.collect_list(F.struct("seq", "digest", "pack", "at", "size"))).alias("chunks"))
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "chunks", "feature"]
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, chunks long, feature string"

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs, z = _Packs(folder), zstandard.ZstdDecompressor()
        for b in batches:
            rows = []
            for k in range(b.num_rows):
                got = []
                for c in b.column("chunks")[k].as_py():
                    chunk = z.decompress(packs.read(c["pack"], c["at"], c["size"]))
                    if hashlib.sha256(chunk).digest() != c["digest"]:
                        raise ValueError("a stored chunk doesn't have its digest")
                    got.append(chunk)
                media = b"".join(got)
                payload = wav_payload(media)
                rows.append((b.column("doc_id")[k].as_py(), b.column("n_bytes")[k].as_py(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), len(got), feature(payload)))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 9, kinds)], names=names)

    return one.select("doc_id", "n_bytes", "chunks").mapInArrow(build, schema)


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store the texts in the shared folder and read them back. Null ids stay null, repeated rows each give a row."""
    folder = scratch_path(df.sparkSession, "media")
    return load(store(df, folder, id_col, text_col), folder)
