"""An index, or some of its blocks, as arrays: small indexes for every executor and the driver, larger ones a few blocks at a time.

Tables come to these arrays as runs: rows of (block, part, start, n, data), the values of neighbouring positions as bytes, so that what is sent or
shuffled takes little more than the arrays.  Positions without a row hold 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions import geometry as g
from keyloom.functions import kernels as K

STATUSES = ("OK", "NOT_FOUND", "KEY_TOO_SHORT", "KEY_TOO_LONG")
OK, NOT_FOUND, KEY_TOO_SHORT, KEY_TOO_LONG = range(4)
RUN = "block_id long, part int, start long, n long, data binary"
#: the part that says of a block how many keys are before it and in it
BLOCKS = 0
#: positions in a row without values that a run goes on over
GAP = 16


def bytes_of(meta: dict, how: ModuleType) -> int:
    """What the arrays of an index take."""
    entry = 4 * (meta["fp_size"] > 0) + 8 * (meta["payload_size"] > 0)
    return how.Packed.bytes_of(meta["total_keys"], meta["num_blocks"]) + entry * meta["total_keys"]


def parts_of(meta: dict, how: ModuleType) -> list[tuple[str, str, dict[str, str]]]:
    """(table, its column of positions, columns with their types in a run) of what a lookup reads beside the blocks; part numbers from 1."""
    values = {**({"fp": "<u4"} if meta["fp_size"] else {}), **({"payload": "<i8"} if meta["payload_size"] else {})}
    return [*how.PARTS, *([("entries", "rank", values)] if values else [])]


def cut(part: int, types: list[str], block: np.ndarray, at: np.ndarray, values: list[np.ndarray]) -> pa.RecordBatch:
    """Rows of a table as runs."""
    if len(at) and ((block[1:] < block[:-1]) | (block[1:] == block[:-1]) & (at[1:] < at[:-1])).any():
        order = np.lexsort((at, block))
        block, at, values = block[order], at[order], [v[order] for v in values]
    first = np.flatnonzero(np.concatenate(([True], (block[1:] != block[:-1]) | (at[1:] - at[:-1] > GAP)))) if len(at) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(at)) - 1
    data = []
    for a, b in zip(first.tolist(), last.tolist()):
        place = at[a : b + 1] - at[a]
        dense = [np.zeros(place[-1] + 1, kind) for kind in types]
        for d, v in zip(dense, values):
            d[place] = v[a : b + 1]
        data.append(b"".join(d.tobytes() for d in dense))
    columns = [pa.array(block[first], pa.int64()), pa.array(np.full(len(first), part), pa.int32()), pa.array(at[first], pa.int64()), pa.array(at[last] - at[first] + 1, pa.int64()), pa.array(data, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["block_id", "part", "start", "n", "data"])


def _numpy(table: pa.Table | pa.RecordBatch, column: str) -> np.ndarray:
    return table.column(column).to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table.column(column).to_numpy()


def runs(meta: dict, how: ModuleType, tables: dict[str, DataFrame]) -> DataFrame:
    """The tables that a lookup reads, as runs; without a shuffle."""
    whole = tables["blocks"].select("block_id", F.lit(BLOCKS).alias("part"), F.col("keys_before").alias("start"), F.col("keys_in_block").alias("n"), F.lit(None).cast("binary").alias("data"))
    for part, (name, at, values) in enumerate(parts_of(meta, how), 1):

        def run(batches: Iterator[pa.RecordBatch], part: int = part, values: dict[str, str] = values) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield cut(part, list(values.values()), _numpy(b, "block_id"), _numpy(b, "at"), [_numpy(b, v) for v in values])

        whole = whole.unionByName(tables[name].select("block_id", F.col(at).cast("long").alias("at"), *values).mapInArrow(run, RUN))
    return whole


def folded() -> Column:
    """part, start, n and data of a run as one value: beside rows of a probe, that is one column without a value a row instead of five."""
    return F.concat(*[F.unhex(F.lpad(F.hex(F.col(c).cast("long")), 16, "0")) for c in ("part", "start", "n")], F.coalesce("data", F.lit(b"")))


def unfolded(block: np.ndarray, run: pa.Array) -> pa.RecordBatch:
    raw = run.to_pylist()
    head = np.frombuffer(b"".join(r[:24] for r in raw), ">i8").astype(np.int64).reshape(-1, 3)
    return pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), *map(pa.array, head.T), pa.array([r[24:] for r in raw], pa.binary())], ["block_id", "part", "start", "n", "data"])


class PackedIndex:
    """The directory of an index, and its entries in rank order."""

    def __init__(self, meta: dict, how: ModuleType, tables: dict[str, pa.Table]) -> None:
        b = tables["blocks"]
        rows = [pa.RecordBatch.from_arrays([b.column("block_id").combine_chunks(), pa.array(np.zeros(b.num_rows, np.int32)), b.column("keys_before").combine_chunks(), b.column("keys_in_block").combine_chunks(), pa.nulls(b.num_rows, pa.binary())], ["block_id", "part", "start", "n", "data"])]
        for part, (name, at, values) in enumerate(parts_of(meta, how), 1):
            rows.append(cut(part, list(values.values()), _numpy(tables[name], "block_id"), _numpy(tables[name], at).astype(np.int64), [_numpy(tables[name], v) for v in values]))
        self._fill(meta, how, rows)

    @classmethod
    def of_runs(cls, meta: dict, how: ModuleType, rows: list[pa.RecordBatch]) -> PackedIndex:
        """Of the runs of all blocks, or of some."""
        index = cls.__new__(cls)
        index._fill(meta, how, rows)
        return index

    def _fill(self, meta: dict, how: ModuleType, rows: list[pa.RecordBatch]) -> None:
        self.blocks, self.fp_size = meta["num_blocks"], meta["fp_size"]
        block, part, start, n = (np.concatenate([_numpy(r, c) for r in rows]) for c in ("block_id", "part", "start", "n"))
        own = np.flatnonzero(part == BLOCKS)
        own = own[np.argsort(block[own])]
        self.ids, held, before = block[own], n[own], start[own]
        self.keys, self.whole = int(held.sum()), len(own) == self.blocks
        #: a key's rank is its place among the blocks held and this
        local = np.cumsum(held) - held
        self.shift = before - local
        sizes, firsts = how.Packed.places(held)
        parts = parts_of(meta, how)
        arrays = [{name: np.zeros(size, kind) for name, kind in values.items()} for (_, _, values), size in zip(parts, [*sizes, self.keys])]
        # where position 0 of a block lies in its part's arrays
        zero = [*firsts, local - before]
        at = np.searchsorted(self.ids, block)
        i = 0
        for r in rows:
            data = r.column("data")
            for k in range(r.num_rows):
                if part[i]:
                    p = part[i] - 1
                    a, raw, done = int(zero[p][at[i]] + start[i]), data[k].as_py(), 0
                    for name, kind in parts[p][2].items():
                        values = np.frombuffer(raw, kind, n[i], done)
                        # what other runs hold of the same stretch stays
                        arrays[p][name][a : a + n[i]] |= values
                        done += values.nbytes
                i += 1
        self.directory = how.Packed(arrays, meta["global_seed"], held, local)
        self.fp = arrays[-1].get("fp")
        self.payload = arrays[-1].get("payload")

    def _places(self, keys: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, number of the block, status) of binary keys; place means nothing where status isn't OK."""
        n, prefix, k0, k1 = K.key_halves(keys)
        status = np.where(n < g.MIN_KEY, KEY_TOO_SHORT, np.where(n > g.MAX_KEY, KEY_TOO_LONG, OK))
        block = K.fast_range(prefix, self.blocks).astype(np.int64)
        if not self.whole:
            # keys that don't fit come with any blocks
            block = np.minimum(np.searchsorted(self.ids, block), len(self.ids) - 1)
        place = self.directory.ranks(block, k0, k1)
        there = (place >= 0) & (place < self.keys)
        if self.keys:
            place = np.where(there, place, 0)
            if self.fp is not None:
                there &= self.fp[place] == K.fingerprint(k0, k1, self.fp_size)
        return place, block, np.where((status == OK) & ~there, NOT_FOUND, status)

    def find(self, keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(rank, status) of binary keys; rank means nothing where status isn't OK."""
        place, block, status = self._places(keys)
        return place if self.whole else place + self.shift[block], status

    def answer(self, keys: pa.Array, payload: bool) -> pa.StructArray:
        """(rank, payload, status) of binary keys."""
        place, block, status = self._places(keys)
        none = status != OK
        rank = place if self.whole else place + self.shift[block]
        values = pa.array(self.payload[place] if self.keys else place, mask=none) if payload else pa.nulls(len(rank), pa.int64())
        fields = {"rank": pa.array(rank, mask=none), "payload": values}
        return pa.StructArray.from_arrays([*fields.values(), pa.array(STATUSES).take(pa.array(status))], [*fields, "status"])
