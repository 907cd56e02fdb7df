"""Blocks of 1024 buckets of about three keys; a bucket's smallest seed that sends its keys to distinct slots is stored.

Buckets of eight keys or more are split: their first seed sends exactly half of the keys to distinct slots of the lower half, the
second one orders the rest.  The search runs in numpy, over all buckets of one size at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions import geometry as g
from keyloom.functions import hashing as h
from keyloom.functions import kernels as K

NAME = "bijection"
CODE = 0
SOLVED = "kind int, block_id long, bucket_id int, bucket_start int, bucket_size int, seed0 long, seed1 long, first_rank long, rank long, fp long, payload long, error string"
OK, DUPLICATE, SPLIT_FAILED = None, "DUPLICATE_KEY", "SPLIT_FAILED"


def num_blocks(keys: int) -> int:
    return g.bijection_blocks(keys)


def bucket(k0: Column, k1: Column) -> Column:
    return h.bijection_bucket(k0, g.BIJECTION_BUCKETS)


def mixed(k0: np.ndarray, k1: np.ndarray, seeds: np.ndarray, size: int) -> np.ndarray:
    """(buckets, seeds, keys) slots; k0 and k1 are (buckets, keys) and hold the global seed already."""
    return K.fast_range(K.wymix(k0[:, None, :] ^ seeds[None, :, None].astype(K.U), k1[:, None, :]), size)


def direct_seeds(k0: np.ndarray, k1: np.ndarray) -> np.ndarray:
    """The smallest seed of each row of keys that makes its slots distinct, or -1."""
    rows, size = k0.shape
    out = np.full(rows, -1, np.int64)
    if size <= 1:
        out[:] = 0
        return out
    todo = np.arange(rows)
    same = (np.sort(k0, axis=1)[:, 1:] == np.sort(k0, axis=1)[:, :-1]).any(1)
    for i in np.flatnonzero(same):  # two keys equal in both halves collide under every seed
        if len(set(zip(k0[i].tolist(), k1[i].tolist()))) < size:
            todo = todo[todo != i]
    first, step = 0, 16
    while len(todo) and first < g.DIRECT_SEEDS:
        seeds = np.arange(first, min(first + step, g.DIRECT_SEEDS))
        slots = mixed(k0[todo], k1[todo], seeds, size)
        if size <= 63:
            good = np.bitwise_or.reduce(np.left_shift(np.uint64(1), slots), axis=2) == np.uint64((1 << size) - 1)
        else:
            s = np.sort(slots, axis=2)
            good = (s[:, :, 1:] != s[:, :, :-1]).all(2)
        hit = good.any(1)
        out[todo[hit]] = first + good[hit].argmax(1)
        todo = todo[~hit]
        first += len(seeds)
        step = max(16, min(first, 400_000 // max(1, len(todo) * size), 1 << 14))  # doubling, within memory
    return out


def split_seeds(k0: np.ndarray, k1: np.ndarray) -> tuple[int, int]:
    """The two seeds of a large bucket; -1 for one that isn't found."""
    size = len(k0)
    half = size // 2
    first, step = 0, 64
    while first < g.SPLIT_SEEDS:
        slots = mixed(k0[None], k1[None], np.arange(first, min(first + step, g.SPLIT_SEEDS)), size)[0]
        low = slots < half
        candidates = np.flatnonzero(low.sum(1) == half)
        for c in candidates:
            own = slots[c][low[c]]
            if len(set(own.tolist())) == half:
                return first + int(c), int(direct_seeds(k0[None, ~low[c]], k1[None, ~low[c]])[0])
        first += step
        step = min(2 * step, 1 << 14)
    return -1, -1


def slots_of(k0: np.ndarray, k1: np.ndarray, global_seed: int, size: np.ndarray, seed0: np.ndarray, seed1: np.ndarray) -> np.ndarray:
    """Slots within their buckets of keys, given their buckets' sizes and seeds."""
    a, b = k0 ^ K.U(global_seed), k1 ^ K.U(global_seed)
    size = size.astype(K.U)
    slot = K.fast_range(K.wymix(a ^ seed0.astype(K.U), b), size)
    half = size >> K.U(1)
    second = np.flatnonzero((size >= g.SPLIT_AT) & (slot >= half))
    if len(second):
        slot[second] = half[second] + K.fast_range(K.wymix(a[second] ^ seed1[second].astype(K.U), b[second]), (size - half)[second])
    slot[size <= 1] = 0
    return slot.astype(np.int64)


def solve(k0: np.ndarray, k1: np.ndarray, global_seed: int) -> tuple[dict[str, np.ndarray], np.ndarray, str | None]:
    """A block's buckets (id, start, size, seeds) that hold keys, each key's slot in the block, and what went wrong."""
    ids = K.fast_range(k0, g.BIJECTION_BUCKETS).astype(np.int64)
    order = np.lexsort((k1, k0, ids))
    first = np.flatnonzero(np.concatenate(([True], ids[order][1:] != ids[order][:-1])))
    size = np.diff(np.append(first, len(ids)))
    a, b = k0[order] ^ K.U(global_seed), k1[order] ^ K.U(global_seed)
    seed0, seed1 = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
    error = OK
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        if n < g.SPLIT_AT:
            rows = first[at][:, None] + np.arange(n)
            seed0[at] = direct_seeds(a[rows], b[rows])
            if (seed0[at] < 0).any():
                error = DUPLICATE
        else:
            for i in at:
                s = slice(first[i], first[i] + n)
                seed0[i], seed1[i] = split_seeds(a[s], b[s])
                if seed0[i] < 0:
                    error = SPLIT_FAILED
                elif seed1[i] < 0:
                    error = DUPLICATE
    start = np.cumsum(size) - size
    bucket_of = np.repeat(np.arange(len(first)), size)
    slot = np.empty(len(ids), np.int64)
    slot[order] = start[bucket_of] + slots_of(k0[order], k1[order], global_seed, size[bucket_of], seed0[bucket_of], seed1[bucket_of])
    return {"bucket_id": ids[order][first], "start": start, "size": size, "seed0": seed0, "seed1": seed1}, slot, error


_SCHEMA = pa.schema([("kind", pa.int32()), ("block_id", pa.int64()), ("bucket_id", pa.int32()), ("bucket_start", pa.int32()), ("bucket_size", pa.int32()), ("seed0", pa.int64()), ("seed1", pa.int64()), ("first_rank", pa.int64()), ("rank", pa.int64()), ("fp", pa.int64()), ("payload", pa.int64()), ("error", pa.string())])


def solver(global_seed: int, fp_size: int):
    """Of a block's keys and its total: its entries by rank (kind 0) and its buckets (kind 1), or one row with what went wrong."""

    def run(keys: pa.Table, total: pa.Table) -> pa.Table:
        if not keys.num_rows:
            return _SCHEMA.empty_table()
        block, before = keys.column("block_id")[0].as_py(), total.column("keys_before")[0].as_py()
        k0, k1 = (keys.column(c).to_numpy().view(np.uint64) for c in ("k0", "k1"))
        buckets, slot, error = solve(k0, k1, global_seed)
        if error is not OK:
            return K.rows_of(_SCHEMA, 1, block_id=[block], error=[error])
        order = np.argsort(slot)
        fp = K.fingerprint(k0, k1, fp_size)[order] if fp_size else np.zeros(len(order), np.int64)
        entries = K.rows_of(_SCHEMA, len(order), kind=np.zeros(len(order)), block_id=np.full(len(order), block), rank=before + np.arange(len(order)), fp=fp, payload=keys.column("payload").to_numpy()[order])
        n = len(buckets["size"])
        own = K.rows_of(_SCHEMA, n, kind=np.ones(n), block_id=np.full(n, block), bucket_id=buckets["bucket_id"], bucket_start=buckets["start"], bucket_size=buckets["size"], seed0=buckets["seed0"], seed1=buckets["seed1"], first_rank=before + buckets["start"])
        return pa.concat_tables([entries, own])

    return run


def directory(solved: DataFrame, blocks: DataFrame) -> dict[str, DataFrame]:
    """The tables that lookups read: buckets with the rank of their first slot."""
    return {"buckets": solved.where("kind = 1").select("block_id", "bucket_id", "bucket_start", "bucket_size", "seed0", "seed1", "first_rank")}


#: what a lookup reads: table, positions in a block, values
PARTS = [("buckets", "bucket_id", {"bucket_size": "<u2", "seed0": "<i4", "seed1": "<i4"})]


class Packed:
    """All buckets of some blocks as dense arrays."""

    def __init__(self, arrays: list[dict[str, np.ndarray]], global_seed: int, keys: np.ndarray, before: np.ndarray) -> None:
        self.global_seed = global_seed
        self.size, self.seed0, self.seed1 = arrays[0].values()
        total = np.cumsum(self.size, dtype=np.int64)
        self.first = total - self.size

    @staticmethod
    def places(keys: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
        """How long the arrays of each part are, and where those of each block begin."""
        return [len(keys) * g.BIJECTION_BUCKETS], [np.arange(len(keys)) * g.BIJECTION_BUCKETS]

    @staticmethod
    def bytes_of(keys: int, blocks: int) -> int:
        return 18 * g.BIJECTION_BUCKETS * blocks

    def ranks(self, block: np.ndarray, k0: np.ndarray, k1: np.ndarray) -> np.ndarray:
        """The place of each key among those of the blocks, -1 in an empty bucket."""
        at = block * g.BIJECTION_BUCKETS + K.fast_range(k0, g.BIJECTION_BUCKETS).astype(np.int64)
        size = self.size[at]
        slot = slots_of(k0, k1, self.global_seed, size, self.seed0[at], self.seed1[at])
        return np.where(size > 0, self.first[at] + slot, -1)


def lookup(probe: DataFrame, tables: dict[str, DataFrame], global_seed: int, blocks: DataFrame | None = None) -> DataFrame:
    """probe (k0, k1, block_id, ...) with rank, null where the block or the bucket is empty."""

    @F.arrow_udf("long")
    def slot(k0: pa.Array, k1: pa.Array, size: pa.Array, seed0: pa.Array, seed1: pa.Array) -> pa.Array:
        s = slots_of(K.unsigned(k0), K.unsigned(k1), global_seed, K.signed(size), K.signed(seed0), K.signed(seed1))
        return pa.array(s, mask=size.is_null().to_numpy(zero_copy_only=False))

    found = probe.withColumn("bucket_id", bucket(F.col("k0"), F.col("k1")).cast("int")).join(tables["buckets"], ["block_id", "bucket_id"], "left")
    rank = F.col("first_rank") + slot("k0", "k1", "bucket_size", "seed0", "seed1")
    return found.withColumn("rank", rank).select(*probe.columns, "rank")
