"""Shared plumbing of the corpus operators: Arrow slices and vectorised word hashing."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SLICE_BYTES = 4 << 20
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive pieces of a batch with at most about limit bytes of text each, one row at least."""
    if batch.num_rows == 0:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def utf8(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array, one after the other, and the n + 1 offsets; null counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = pc.fill_null(arr, "" if pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type) else b"")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = arr.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_WORD = np.zeros(256, bool)
_WORD[128:] = True
for _c in b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_'":
    _WORD[_c] = True
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        p = np.full(max(n, 1 << 20), base, U64)
        p[0] = 1
        have = _powers[name] = np.multiply.accumulate(p)
    return have[:n]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words in each text, and the index of each word's text; a word never spans two texts."""
    if len(data) == 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    word = _WORD[data]
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begins[cuts] = word[cuts]
    ends[cuts - 1] = word[cuts - 1]
    s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    total = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * _power("p", _P, len(data)), out=total[1:])
    h = (total[e] - total[s]) * _power("i", _P_INV, len(data))[s]
    return mix64(h ^ (e - s).astype(U64)), np.searchsorted(offsets, s, side="right") - 1


BLOCK_BYTES = 32 << 20


def write_block(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def read_blocks(bodies: pa.ChunkedArray) -> Iterator[pa.RecordBatch]:
    for body in bodies:
        yield from pa.ipc.open_stream(body.as_buffer())


def packed_by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, body): the rows of one block that lie in one task as one compressed row, so that a shuffle by block is small."""
    held: list[pa.RecordBatch] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        blocks = table.column("block").to_numpy()
        order = np.argsort(blocks, kind="stable")
        cuts = np.flatnonzero(np.concatenate(([True], blocks[order][1:] != blocks[order][:-1])))
        for a, b in zip(cuts, np.append(cuts[1:], len(order))):
            own = table.take(pa.array(order[a:b])).drop_columns(["block"]).combine_chunks()
            yield pa.RecordBatch.from_arrays([pa.array([blocks[order[a]]], pa.int32()), pa.array([write_block(own)], pa.binary())], ["block", "body"])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size > BLOCK_BYTES:
            yield from flush()
            held, size = [], 0
    if held:
        yield from flush()


def blocks_for(size: int, block: int, cores: int) -> int:
    """As many blocks as size bytes need, and for a small table as many as there are cores to work on them."""
    return max(1, -(-size // block), min(cores, -(-size // (1 << 20))))


class Disjoint:
    """Disjoint spans in order of place; whether another one overlaps any of them takes a binary search."""

    def __init__(self) -> None:
        self.begins: list[int] = []
        self.rows: list[tuple] = []

    def add(self, row: tuple) -> None:
        """Add (begin, end, ...) if it overlaps nothing."""
        k = bisect.bisect_left(self.begins, row[1])
        if k and self.rows[k - 1][1] > row[0]:
            return
        self.begins.insert(k, row[0])
        self.rows.insert(k, row)
