"""Blocks of 10,000 skewed buckets, each with one of 256 pilots that sends its keys to free slots; overflow slots are remapped to holes.

Buckets are placed from the largest down, those of one size in batches.  A bucket for which no pilot finds free slots takes the pilot that displaces the least (the
sum of squared bucket sizes), and those displaced are placed again.  The start of that search is random, from a generator
seeded by block and attempt, so that a build can be repeated exactly.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.functions import geometry as g
from keyloom.functions import kernels as K
from keyloom.functions.model import pilot_hash

NAME = "ptrhash"
CODE = 1
SOLVED = "kind int, block_id long, bucket_id int, pilot int, keys_in_block long, keys_before long, overflow_slot long, hole long, rank long, fp long, payload long, error string"
BATCH = 512
ATTEMPTS, PINNED, EVICTIONS = 10, 16, 10
DUPLICATE, INDISTINGUISHABLE, EXHAUSTED = "DUPLICATE_KEY", "INDISTINGUISHABLE", "EVICTION_LIMIT"


def num_blocks(keys: int) -> int:
    return g.pilot_blocks(keys)


def hashed_pilots(global_seed: int) -> np.ndarray:
    return np.array([pilot_hash(p, global_seed) for p in range(g.PILOTS)], np.uint64)


class _Stop(Exception):
    pass


class _Block:
    def __init__(self, k0: np.ndarray, k1: np.ndarray, global_seed: int, buckets: int) -> None:
        self.n = len(k0)
        self.slots_n = g.slots(self.n)
        ids = K.cubic_bucket(k1, buckets)
        self.order = np.lexsort((k1, k0, ids))
        self.size = np.bincount(ids, minlength=buckets)
        self.first = np.concatenate(([0], np.cumsum(self.size)))
        self.fold = K.folded(k0, k1)[self.order]
        self.xor = (k0 ^ k1)[self.order]
        hashed = hashed_pilots(global_seed)
        # every key's slot under every pilot
        self.slots = K.fast_range(self.fold[:, None] * hashed[None, :], self.slots_n).astype(np.int32)

    def solve(self, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        """(pilot of each bucket, owner of each slot or -1)."""
        self.owner = np.full(self.slots_n, -1, np.int64)
        self.pilots = np.zeros(len(self.size), np.int64)
        self.placed = np.zeros(len(self.size), bool)
        self.cost = self.size.astype(np.int64) ** 2
        self.pinned: list[int] = []
        self.evictions = 0
        order = np.argsort(-self.size, kind="stable")
        order = order[self.size[order] > 0]
        cuts = np.flatnonzero(np.diff(self.size[order])) + 1
        for group in np.split(order, cuts):
            for s in range(0, len(group), BATCH):
                for b in self._place_free(group[s : s + BATCH]).tolist():
                    self._place(b, rng)
        return self.pilots, self.owner

    def _place_free(self, buckets: np.ndarray) -> np.ndarray:
        """Give buckets of one size the first pilot that sends their keys to free slots, all at once; of several that meet the first has its way and the others
        choose again.  Returns those for which no pilot does."""
        size = int(self.size[buckets[0]])
        rows = self.first[buckets][:, None] + np.arange(size)
        slots = self.slots[rows]  # bucket, key, pilot
        ordered = np.sort(slots, axis=1)
        twice = (ordered[:, 1:] == ordered[:, :-1]).any(1)
        stuck = []
        todo = np.arange(len(buckets))
        while len(todo):
            free = ~(twice[todo] | (self.owner[slots[todo]] >= 0).any(1))
            has = free.any(1)
            stuck.append(todo[~has])
            todo, free = todo[has], free[has]
            if not len(todo):
                break
            p = free.argmax(1)
            own = slots[todo, :, p]  # bucket, key
            _, first = np.unique(own.ravel(), return_index=True)
            wins = np.bincount(first // size, minlength=len(todo)) == size
            b = buckets[todo[wins]]
            self.pilots[b] = p[wins]
            self.placed[b] = True
            self.owner[own[wins]] = b[:, None]
            todo = todo[~wins]
        return buckets[np.sort(np.concatenate(stuck))] if stuck else buckets[:0]

    def _place(self, start: int, rng: np.random.Generator) -> None:
        """Place a bucket for which there may be no free slots, and all that it displaces."""
        waiting = [(-int(self.size[start]), start)]
        while waiting:
            _, b = heapq.heappop(waiting)
            if self.placed[b]:
                continue
            slots = self.slots[self.first[b] : self.first[b + 1]]
            owners = self.owner[slots]
            free = np.flatnonzero((owners < 0).all(0))
            p = next((int(p) for p in free if len(slots) == 1 or len(set(slots[:, p].tolist())) == len(slots)), -1)
            if p < 0:
                p = self._cheapest(b, slots, owners, self.cost, self.pinned, int(rng.integers(g.PILOTS)))
                for out in sorted(set(owners[:, p].tolist()) - {-1}):
                    mine = self.slots[self.first[out] : self.first[out + 1], self.pilots[out]]
                    self.owner[mine[self.owner[mine] == out]] = -1
                    self.placed[out] = False
                    heapq.heappush(waiting, (-int(self.size[out]), out))
                    self.evictions += 1
                self.pinned.append(b)
                if len(self.pinned) > PINNED:
                    self.pinned.pop(0)
            self.pilots[b] = p
            self.owner[slots[:, p]] = b
            self.placed[b] = True
            if self.evictions > EVICTIONS * self.slots_n:
                raise _Stop(EXHAUSTED)

    def _cheapest(self, b: int, slots: np.ndarray, owners: np.ndarray, cost: np.ndarray, pinned: list[int], start: int) -> int:
        score = np.where(owners >= 0, cost[np.maximum(owners, 0)], 0).sum(0)
        fixed = np.isin(owners, pinned).any(0)
        ordered = np.sort(slots, axis=0)
        twice = (ordered[1:] == ordered[:-1]).any(0)
        turn = (start + np.arange(g.PILOTS)) % g.PILOTS
        usable = turn[~(fixed | twice)[turn]]
        if not len(usable):
            x = self.xor[self.first[b] : self.first[b + 1]]
            raise _Stop(DUPLICATE if len(set(x.tolist())) < len(x) else INDISTINGUISHABLE)
        cheap = np.flatnonzero(score[usable] <= self.size[b] ** 2)
        return int(usable[cheap[0]] if len(cheap) else usable[np.argmin(score[usable])])


def solve(k0: np.ndarray, k1: np.ndarray, block: int, global_seed: int, buckets: int = g.PILOT_BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray, str | None]:
    """(pilots, remap of overflow slots, each key's slot in the block, what went wrong)."""
    state = _Block(k0, k1, global_seed, buckets)
    error = None
    for attempt in range(ATTEMPTS):
        try:
            pilots, owner = state.solve(np.random.Generator(np.random.PCG64([block, attempt])))
            error = None
            break
        except _Stop as stop:
            error = str(stop)
            if error != EXHAUSTED:
                break
    remap = np.zeros(state.slots_n - state.n, np.int64)
    slot = np.zeros(state.n, np.int64)
    if error is not None:
        return np.zeros(buckets, np.int64), remap, slot, INDISTINGUISHABLE if error == EXHAUSTED else error
    used = np.flatnonzero(owner[state.n :] >= 0)
    remap[used] = np.flatnonzero(owner[: state.n] < 0)[: len(used)]
    own = state.slots[np.arange(state.n), np.repeat(pilots, state.size)]
    slot[state.order] = np.where(own < state.n, own, remap[np.maximum(own - state.n, 0)] if len(remap) else 0)
    return pilots, remap, slot, None


_SCHEMA = pa.schema([("kind", pa.int32()), ("block_id", pa.int64()), ("bucket_id", pa.int32()), ("pilot", pa.int32()), ("keys_in_block", pa.int64()), ("keys_before", pa.int64()), ("overflow_slot", pa.int64()), ("hole", pa.int64()), ("rank", pa.int64()), ("fp", pa.int64()), ("payload", pa.int64()), ("error", pa.string())])


def solver(global_seed: int, fp_size: int):
    """Of a block's keys and its total: its entries by rank (kind 0), pilots (kind 1) and remap (kind 2), or one row with what went wrong."""

    def run(keys: pa.Table, total: pa.Table) -> pa.Table:
        if not keys.num_rows:
            return _SCHEMA.empty_table()
        block, before = keys.column("block_id")[0].as_py(), total.column("keys_before")[0].as_py()
        k0, k1 = (keys.column(c).to_numpy().view(np.uint64) for c in ("k0", "k1"))
        pilots, remap, slot, error = solve(k0, k1, block, global_seed)
        if error is not None:
            return K.rows_of(_SCHEMA, 1, block_id=[block], error=[error])
        order, n = np.argsort(slot), len(slot)
        fp = K.fingerprint(k0, k1, fp_size)[order] if fp_size else np.zeros(n, np.int64)
        entries = K.rows_of(_SCHEMA, n, kind=np.zeros(n), block_id=np.full(n, block), rank=before + np.arange(n), fp=fp, payload=keys.column("payload").to_numpy()[order])
        b, r = len(pilots), len(remap)
        own = K.rows_of(_SCHEMA, b, kind=np.ones(b), block_id=np.full(b, block), bucket_id=np.arange(b), pilot=pilots, keys_in_block=np.full(b, n), keys_before=np.full(b, before))
        moved = K.rows_of(_SCHEMA, r, kind=np.full(r, 2), block_id=np.full(r, block), overflow_slot=n + np.arange(r), hole=remap)
        return pa.concat_tables([entries, own, moved])

    return run


def directory(solved: DataFrame, blocks: DataFrame) -> dict[str, DataFrame]:
    return {
        "pilots": solved.where("kind = 1").select("block_id", "bucket_id", "pilot", "keys_in_block", "keys_before"),
        "remap": solved.where("kind = 2").select("block_id", "overflow_slot", "hole"),
    }


#: what a lookup reads: table, positions in a block, values
PARTS = [("pilots", "bucket_id", {"pilot": "<u1"}), ("remap", "overflow_slot", {"hole": "<i8"})]


def _slots(keys: np.ndarray) -> np.ndarray:
    return np.maximum(np.ceil(keys / g.LOAD).astype(np.int64), keys)


class Packed:
    """All pilots and remaps of some blocks as dense arrays."""

    def __init__(self, arrays: list[dict[str, np.ndarray]], global_seed: int, keys: np.ndarray, before: np.ndarray) -> None:
        self.hashed = hashed_pilots(global_seed)
        self.n, self.before, self.slots = keys, before, _slots(keys)
        self.pilots, self.moved = arrays[0]["pilot"], np.append(arrays[1]["hole"], 0)
        over = self.slots - self.n
        self.moved_at = np.cumsum(over) - over

    @staticmethod
    def places(keys: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
        """How long the arrays of each part are, and where those of each block begin: overflow slots are counted from the first slot of the block."""
        over = _slots(keys) - keys
        return [len(keys) * g.PILOT_BUCKETS, int(over.sum())], [np.arange(len(keys)) * g.PILOT_BUCKETS, np.cumsum(over) - over - keys]

    @staticmethod
    def bytes_of(keys: int, blocks: int) -> int:
        return (g.PILOT_BUCKETS + 32) * blocks + keys // 10

    def ranks(self, block: np.ndarray, k0: np.ndarray, k1: np.ndarray) -> np.ndarray:
        """The place of each key among those of the blocks, -1 in an empty block."""
        pilot = self.pilots[block * g.PILOT_BUCKETS + K.cubic_bucket(k1, g.PILOT_BUCKETS)]
        n = self.n[block]
        slot = K.fast_range(K.folded(k0, k1) * self.hashed[pilot], self.slots[block].astype(np.uint64)).astype(np.int64)
        slot = np.where(slot < n, slot, self.moved[np.clip(self.moved_at[block] + slot - n, 0, len(self.moved) - 1)])
        return np.where(n > 0, self.before[block] + slot, -1)


def lookup(probe: DataFrame, tables: dict[str, DataFrame], global_seed: int, blocks: DataFrame | None = None) -> DataFrame:
    """probe (k0, k1, block_id, ...) with rank, null where the block is empty."""
    hashed = hashed_pilots(global_seed)

    @F.arrow_udf("int")
    def bucket_of(k1: pa.Array) -> pa.Array:
        return pa.array(K.cubic_bucket(K.unsigned(k1), g.PILOT_BUCKETS).astype(np.int32))

    @F.arrow_udf("long")
    def slot_of(k0: pa.Array, k1: pa.Array, pilot: pa.Array, keys: pa.Array) -> pa.Array:
        n = K.signed(keys)
        slots = np.maximum(np.ceil(n / g.LOAD).astype(np.int64), n)
        slot = K.fast_range(K.folded(K.unsigned(k0), K.unsigned(k1)) * hashed[K.signed(pilot)], slots.astype(np.uint64))
        return pa.array(slot.astype(np.int64), mask=pilot.is_null().to_numpy(zero_copy_only=False))

    found = probe.withColumn("bucket_id", bucket_of("k1")).join(tables["pilots"], ["block_id", "bucket_id"], "left")
    found = found.withColumn("__slot", slot_of("k0", "k1", "pilot", "keys_in_block"))
    placed = found.withColumn("overflow_slot", F.when(F.col("__slot") >= F.col("keys_in_block"), F.col("__slot")))
    moved = placed.join(tables["remap"], ["block_id", "overflow_slot"], "left")
    return moved.withColumn("rank", F.col("keys_before") + F.coalesce("hole", "__slot")).select(*probe.columns, "rank")
