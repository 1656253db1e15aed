"""Cost-balanced packing of documents into token sequences, cutting only where nothing has room.

Every scan partition packs what it reads, in groups of a bounded number of tokens and pieces, so there is no shuffle, no state that
grows with the corpus, and a lost task is simply run again with the same result. A group loses no room: its sequences
hold 1024 tokens each, and what is left over goes to sequences whose lengths are the powers of two that add up to it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from logweave.llm.common import SMALL_SLICE_BYTES, byte_slices, filled
from logweave.llm.tokenize import encoder

#: Tokens of a group at most (plus one document's remainder): 16 MB of ids; and pieces: another 16 MB.
GROUP_TOKENS, GROUP_PIECES = 4 << 20, 1 << 16


def attention_cost(length, linear: float = 1.0, quadratic: float = 1.0 / 1024):
    """Estimated cost of a document piece of so many tokens: a linear part and one that is quadratic, as attention is."""
    return linear * length + quadratic * length * length


def assign(lengths: np.ndarray, capacity: int, linear: float = 1.0, quadratic: float = 1.0 / 1024) -> list[tuple[int, int, int, int, int]]:
    """(piece, from, size, sequence, offset) for pieces shorter than `capacity`.

    In descending order (ties in input order) each piece goes to the sequence of lowest cost that has room for it; a
    piece for which none has room is cut to the most room there is. Sequences are filled completely.
    """
    total = int(lengths.sum())
    rest = total % capacity
    room = np.array([capacity] * (total // capacity) + [1 << b for b in range(rest.bit_length())[::-1] if rest >> b & 1], np.int64)
    used, cost, out = np.zeros(len(room), np.int64), np.zeros(len(room)), []
    for piece in np.argsort(-lengths, kind="stable"):
        start, left = 0, int(lengths[piece])
        while left:
            fits = np.where(room >= left, cost, np.inf)
            best = int(fits.argmin()) if len(fits) else 0
            if not np.isfinite(fits[best]):
                best = int(room.argmax())
            size = min(left, int(room[best]))
            out.append((int(piece), start, size, best, int(used[best])))
            room[best] -= size
            used[best] += size
            cost[best] += attention_cost(size, linear, quadratic)
            start, left = start + size, left - size
    return out


def pack(df: DataFrame, path: str, end_id: int = 0, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text", group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's tokens are its ids and end_id; null and empty texts are end_id alone. Each id lies in one piece.
    Repeated rows are packed as often as they occur; null ids stay null; other columns are not read. An empty table
    gives no rows. capacity must be a power of two.
    """
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, " + ", ".join(f"`{n}` long" for n in names[1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, end_id)
        next_id = TaskContext.get().partitionId() << 33
        rows: list[tuple] = []
        held: list[tuple] = []
        held_tokens = 0
        id_type = None

        def flush() -> list[tuple]:
            nonlocal next_id, held, held_tokens
            lengths = np.fromiter((len(h[2]) for h in held), np.int64, len(held))
            done, most = [], -1
            for k, start, size, seq, offset in assign(lengths, capacity):
                doc, before, ids, doc_tokens = held[k]
                done.append((doc, before + start, size, zlib.crc32(ids[start : start + size]), doc_tokens, next_id + seq, offset))
                most = max(most, seq)
            next_id += most + 1
            held, held_tokens = [], 0
            return done

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], id_type)] + [pa.array(c, pa.int64()) for c in columns[1:]], names=names)

        for part in byte_slices(batches, text_col, SMALL_SLICE_BYTES):
            id_type = part.column(id_col).type
            ids, offsets = enc.ids(filled(part.column(text_col)))
            ids = np.ascontiguousarray(ids, "<u4")
            for doc, a, b in zip(part.column(id_col).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                tokens = b - a
                whole = tokens // capacity * capacity
                for start in range(0, whole, capacity):
                    rows.append((doc, start, capacity, zlib.crc32(ids[a + start : a + start + capacity]), tokens, next_id, 0))
                    next_id += 1
                if len(rows) > 20_000:
                    yield batch_of(rows)
                    rows = []
                if tokens > whole:
                    held.append((doc, whole, ids[a + whole : b].copy(), tokens))
                    held_tokens += tokens - whole
                    if held_tokens >= group_tokens or len(held) >= GROUP_PIECES:
                        rows += flush()
            if len(rows) > 20_000:
                yield batch_of(rows)
                rows = []
        if held:
            rows += flush()
        if rows:
            yield batch_of(rows)

    return df.select(id_col, text_col).mapInArrow(run, schema)
