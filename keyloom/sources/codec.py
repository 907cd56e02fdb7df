"""The compact binary form of an index, both ways: succinct block metadata, dense entries, one file.

Layout: a 64-byte header, the user's metadata and an empty algorithm section (each after its 4-byte length), the block directory (two
40-bit numbers for each block and an end mark), entries in rank order, block metadata in block order, a 32-byte footer with checksums.
Blocks are encoded and decoded by Arrow functions; the file itself is written in one stream, since it is one file, and read by ranges of blocks.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom import errors
from keyloom.functions import geometry as g
from keyloom.operators.index import EMPTY_HASH, Index, packed_entries
from keyloom.session import checkpoint, ensure_checkpoint_dir
from keyloom.sources import files

MAGIC, VERSION = 0x53544D48, 1
HEADER, FOOTER, DIRECTORY_ENTRY = 64, 32, 10
_HEADER = struct.Struct("<IHQIIIBQH27x")
SMALLEST = 304
LOG_BUCKETS, STRIDE, STOPS = 10, 128, 7
LONGEST = 16
CHECK = 0x55
GROUP = 8 << 20


def fixed_size(meta: dict) -> int:
    return HEADER + 4 + len(meta["user_metadata"]) + 4 + (meta["num_blocks"] + 1) * DIRECTORY_ENTRY + FOOTER


# bits


class Bits:
    """A run of bits, lowest first."""

    def __init__(self) -> None:
        self.value, self.n = 0, 0

    def put(self, value: int, width: int) -> None:
        self.value |= (value & ((1 << width) - 1)) << self.n
        self.n += width

    def ones(self, n: int) -> None:
        self.put((1 << n) - 1, n)

    def bytes(self) -> bytes:
        return self.value.to_bytes((self.n + 7) // 8, "little")


def low_width(n: int, universe: int) -> int:
    return (universe // n).bit_length() - 1 if n and universe > n else 0


def monotone_size(n: int, universe: int) -> int:
    w = low_width(n, universe)
    return (n * w + n + (universe >> w) + 7) // 8 if n else 0


def encode_monotone(values: np.ndarray, universe: int) -> bytes:
    """Non-decreasing numbers by Elias and Fano: their low bits side by side, their high parts as gaps in unary."""
    n, w = len(values), low_width(len(values), universe)
    bits = np.zeros(8 * monotone_size(n, universe), np.uint8)
    for b in range(w):
        bits[np.arange(n) * w + b] = (values >> b) & 1
    bits[n * w + (values >> w) + np.arange(n)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def decode_monotone(raw: bytes, n: int, universe: int) -> np.ndarray:
    w = low_width(n, universe)
    bits = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little").astype(np.int64)
    high = np.flatnonzero(bits[n * w :])[:n] - np.arange(n)
    if len(high) < n:
        raise errors.CorruptedIndex("bucket counts end early")
    low = sum((bits[np.arange(n) * w + b] << b for b in range(w)), np.zeros(n, np.int64))
    return (high << w) | low


def rice(size: int) -> int:
    """The bits of a seed that are written as they are; found by trial for the sizes in use."""
    return size - 1 if size < 7 else min(size, 8)


class _SeedReader:
    def __init__(self, raw: bytes) -> None:
        self.value, self.at, self.n = int.from_bytes(raw, "little"), 0, 8 * len(raw)

    def seed(self, size: int) -> int | None:
        """The next seed, or None for one in the list at the end."""
        ones = 0
        while ones < LONGEST and self.value >> self.at & 1:
            ones, self.at = ones + 1, self.at + 1
        if self.at > self.n:
            raise errors.CorruptedIndex("seeds end early")
        if ones == LONGEST:
            return None
        k = rice(size)
        rest = self.value >> (self.at + 1) & ((1 << k) - 1)
        self.at += 1 + k
        return ones << k | rest


# blocks


def encode_bijection_block(bucket_id: np.ndarray, size: np.ndarray, seed0: np.ndarray, seed1: np.ndarray) -> bytes:
    """A block's metadata: bit positions at every 128th bucket, bucket counts, seeds, and the list of seeds too large for their code."""
    sizes = np.zeros(g.BIJECTION_BUCKETS, np.int64)
    sizes[bucket_id] = size
    if not sizes.sum():
        return bytes(4 * STOPS) + b"\xff" * (g.BIJECTION_BUCKETS // 8) + b"\0"
    seeds = {int(b): (int(a), int(c)) for b, a, c in zip(bucket_id, seed0, seed1)}
    cumulative = np.cumsum(sizes)
    total = int(cumulative[-1])
    w = low_width(len(sizes), total)
    stream, listed, seed_stops = Bits(), [], []

    def put(bucket: int, half: int, seed: int, n: int) -> None:
        if n <= 1:
            return
        k = rice(n)
        if n > 8 or seed >= LONGEST << k:
            stream.ones(LONGEST)
            listed.append(bucket << 22 | half << 21 | seed)
        else:
            stream.ones(seed >> k)
            stream.put(0, 1)
            stream.put(seed, k)

    for b, n in enumerate(sizes.tolist()):
        if b and b % STRIDE == 0 and len(seed_stops) < STOPS:
            seed_stops.append(stream.n)
        if n >= g.SPLIT_AT:
            put(b, 0, seeds[b][0], n // 2)
            put(b, 1, seeds[b][1], n - n // 2)
        elif n > 1:
            put(b, 0, seeds[b][0], n)
    if len(listed) > 255 or max(seed_stops) > 0xFFFF:
        raise errors.InvalidGeometry("a block's seeds don't fit the format")
    count_stops = [min(b + int(cumulative[b - 1] >> w), 0xFFFF) for b in range(STRIDE, len(sizes), STRIDE)][:STOPS]
    return (
        struct.pack(f"<{2 * STOPS}H", *count_stops, *seed_stops)
        + encode_monotone(cumulative, total)
        + stream.bytes()
        + bytes([len(listed)])
        + b"".join(x.to_bytes(4, "little") for x in listed)
        + bytes([len(listed) ^ CHECK])
    )


def decode_bijection_block(raw: bytes, keys: int) -> dict[str, np.ndarray]:
    """(bucket_id, start, size, seed0, seed1) of the buckets that hold keys."""
    buckets = g.BIJECTION_BUCKETS
    begin = 4 * STOPS
    end = begin + monotone_size(buckets, keys)
    if len(raw) < end + 1:
        raise errors.CorruptedIndex("block metadata is too short")
    cumulative = decode_monotone(raw[begin:end], buckets, keys)
    sizes = np.diff(np.concatenate(([0], cumulative)))
    if (sizes < 0).any() or cumulative[-1] != keys:
        raise errors.CorruptedIndex("bucket counts don't add up")
    listed: dict[tuple[int, int], int] = {}
    tail = len(raw)
    if keys:
        n = raw[-1] ^ CHECK
        tail = len(raw) - 2 - 4 * n
        if tail < end or raw[tail] != n:
            raise errors.CorruptedIndex("the list of large seeds is damaged")
        for i in range(n):
            x = int.from_bytes(raw[tail + 1 + 4 * i : tail + 5 + 4 * i], "little")
            listed[x >> 22, x >> 21 & 1] = x & (1 << 21) - 1
    reader = _SeedReader(raw[end:tail])
    ids = np.flatnonzero(sizes)
    seed0, seed1 = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)

    def read(bucket: int, half: int, n: int) -> int:
        if n <= 1:
            return 0
        seed = reader.seed(n)
        if seed is None:
            if (bucket, half) not in listed:
                raise errors.CorruptedIndex("a large seed is missing")
            return listed[bucket, half]
        return seed

    for i, b in enumerate(ids.tolist()):
        n = int(sizes[b])
        if n >= g.SPLIT_AT:
            seed0[i], seed1[i] = read(b, 0, n // 2), read(b, 1, n - n // 2)
        else:
            seed0[i] = read(b, 0, n)
    return {"bucket_id": ids, "start": (cumulative - sizes)[ids], "size": sizes[ids], "seed0": seed0, "seed1": seed1}


def encode_pilot_block(pilots: np.ndarray, remap: np.ndarray) -> bytes:
    return pilots.astype(np.uint8).tobytes() + struct.pack("<H", len(remap)) + remap.astype("<u2").tobytes()


def decode_pilot_block(raw: bytes, keys: int) -> tuple[np.ndarray, np.ndarray]:
    n = g.PILOT_BUCKETS
    if len(raw) < n + 2:
        raise errors.CorruptedIndex("block metadata is too short")
    (entries,) = struct.unpack_from("<H", raw, n)
    if len(raw) != n + 2 + 2 * entries or entries != (g.slots(keys) - keys if keys else 0):
        raise errors.CorruptedIndex("the remap table has a wrong length")
    return np.frombuffer(raw[:n], np.uint8).astype(np.int64), np.frombuffer(raw[n + 2 :], "<u2").astype(np.int64)


def block_metadata(index: Index) -> DataFrame:
    """(block_id, metadata) of all blocks."""
    if index.meta["algorithm"] == "bijection":

        def one(key: tuple, table: pa.Table) -> pa.Table:
            c = {n: table.column(n).to_numpy() for n in ("bucket_id", "bucket_size", "seed0", "seed1")}
            return pa.table({"block_id": [key[0].as_py()], "metadata": [encode_bijection_block(c["bucket_id"], c["bucket_size"], c["seed0"], c["seed1"])]})

        full = index.tables["buckets"].groupBy("block_id").applyInArrow(one, "block_id long, metadata binary")
        empty = encode_bijection_block(*[np.zeros(0, np.int64)] * 4)
    else:

        def two(key: tuple, pilots: pa.Table, remap: pa.Table) -> pa.Table:
            if not pilots.num_rows:
                return pa.table({"block_id": pa.array([], pa.int64()), "metadata": pa.array([], pa.binary())})
            p = pilots.sort_by("bucket_id").column("pilot").to_numpy()
            return pa.table({"block_id": [key[0].as_py()], "metadata": [encode_pilot_block(p, remap.sort_by("overflow_slot").column("hole").to_numpy())]})

        full = index.tables["pilots"].groupBy("block_id").cogroup(index.tables["remap"].groupBy("block_id")).applyInArrow(two, "block_id long, metadata binary")
        empty = encode_pilot_block(np.zeros(g.PILOT_BUCKETS), np.zeros(0))
    return index.tables["blocks"].join(full, "block_id", "left").select("block_id", "keys_in_block", "keys_before", F.coalesce("metadata", F.lit(bytearray(empty))).alias("metadata"))


def block_entries(index: Index) -> DataFrame:
    """(block_id, entries) of the blocks that hold keys, packed."""
    fp_size, payload_size = index.meta["fp_size"], index.payload_size

    def one(table: pa.Table) -> pa.Table:
        rows = table.to_pandas().sort_values("rank")
        return pa.table({"block_id": [int(rows["block_id"].iloc[0])], "entries": [packed_entries(rows["fp"], rows["payload"], fp_size, payload_size)]})

    return index.tables["entries"].groupBy("block_id").applyInArrow(one, "block_id long, entries binary")


# files


def _five(n: int) -> bytes:
    return n.to_bytes(5, "little")


def export_file(index: Index, path: str) -> None:
    """Write the binary form, block after block; one file is one stream, of which the driver holds a block at a time."""
    files.write_file(path, _stream(index))


def _stream(index: Index) -> Iterator[bytes]:
    m = index.meta
    code = {"bijection": 0, "ptrhash": 1}[m["algorithm"]]
    blocks = checkpoint(block_metadata(index))
    yield _HEADER.pack(MAGIC, VERSION, m["total_keys"], m["num_blocks"], g.ram_bits(m["num_blocks"]), m["payload_size"], m["fp_size"], m["global_seed"], code)
    yield struct.pack("<I", len(m["user_metadata"])) + m["user_metadata"] + struct.pack("<I", 0)
    offset = before = 0
    for row in blocks.select("block_id", "keys_in_block", F.octet_length("metadata").alias("n")).orderBy("block_id").toLocalIterator():
        yield _five(before) + _five(offset)
        before, offset = before + row.keys_in_block, offset + row.n
    yield _five(before) + _five(offset)
    payload_hash, metadata_hash = xxhash.xxh64(), xxhash.xxh64()
    entries = blocks.select("block_id").join(block_entries(index), "block_id", "left").orderBy("block_id") if m["payload_size"] + m["fp_size"] else blocks.select("block_id", F.lit(None).cast("binary").alias("entries"))
    for row in entries.toLocalIterator():
        raw = bytes(row.entries or b"")
        yield raw
        payload_hash.update((xxhash.xxh64_intdigest(raw) if raw else EMPTY_HASH).to_bytes(8, "little"))
    for row in blocks.select("block_id", "metadata").orderBy("block_id").toLocalIterator():
        yield bytes(row.metadata)
        metadata_hash.update(bytes(row.metadata))
    yield struct.pack("<QQ16x", payload_hash.intdigest(), metadata_hash.intdigest())


class Parsed:
    """The header and block directory of a binary index (in memory, or in a file of which no more is read), checked for what can be checked without its checksums."""

    def __init__(self, raw: bytes | str) -> None:
        self.size = len(raw) if isinstance(raw, bytes) else files.size_of(raw)
        self.read = (lambda a, b: raw[a:b]) if isinstance(raw, bytes) else (lambda a, b: files.read_range(raw, a, b))
        if self.size < HEADER:
            raise errors.TruncatedFile("shorter than a header")
        magic, version, keys, blocks, _, payload, fp, seed, code = _HEADER.unpack(self.read(0, HEADER))
        if magic != MAGIC:
            raise errors.InvalidMagic(hex(magic))
        if version != VERSION:
            raise errors.InvalidVersion(str(version))
        if self.size < SMALLEST:
            raise errors.TruncatedFile(f"shorter than {SMALLEST} bytes")
        if payload > g.MAX_PAYLOAD or fp > g.MAX_FINGERPRINT or blocks == 0 and keys:
            raise errors.CorruptedIndex("the header holds impossible sizes")
        if code > 1:
            raise errors.UnknownAlgorithm(str(code))
        at = HEADER
        sections = []
        for _ in range(2):
            head = self.read(at, at + 4)
            if len(head) < 4:
                raise errors.TruncatedFile("a section is cut off")
            (n,) = struct.unpack("<I", head)
            if at + 4 + n > self.size - FOOTER:
                raise errors.TruncatedFile("a section is cut off")
            sections.append(self.read(at + 4, at + 4 + n))
            at += 4 + n
        if sections[1]:
            raise errors.CorruptedIndex("the algorithm section isn't empty")
        self.entries_at = at + (blocks + 1) * DIRECTORY_ENTRY
        if self.entries_at > self.size - FOOTER:
            raise errors.TruncatedFile("the directory is cut off")
        pairs = np.frombuffer(self.read(at, self.entries_at), np.uint8).reshape(-1, 2, 5).astype(np.int64)
        directory = (pairs << (8 * np.arange(5))).sum(2)
        self.before, self.offset = directory[:, 0], directory[:, 1]
        self.entry_size = payload + fp
        self.metadata_at = self.entries_at + keys * self.entry_size
        if self.metadata_at > self.size - FOOTER:
            raise errors.TruncatedFile("entries are cut off")
        if (np.diff(self.before) < 0).any() or (np.diff(self.offset) < 0).any() or self.before[-1] != keys or self.offset[-1] != self.size - FOOTER - self.metadata_at:
            raise errors.CorruptedIndex("the directory contradicts the file's size")
        self.hashes = struct.unpack("<QQ", self.read(self.size - FOOTER, self.size - FOOTER + 16))
        self.meta = {"algorithm": ("bijection", "ptrhash")[code], "total_keys": keys, "num_blocks": blocks, "payload_size": payload, "fp_size": fp, "global_seed": seed, "user_metadata": sections[0]}

    def groups(self) -> list[tuple[int, int]]:
        """Ranges of blocks of about GROUP bytes."""
        ends = self.before * self.entry_size + self.offset
        cuts = [0]
        while cuts[-1] < len(ends) - 1:
            cuts.append(max(cuts[-1] + 1, int(np.searchsorted(ends, ends[cuts[-1]] + GROUP, side="right")) - 1))
        return list(zip(cuts, cuts[1:]))

    def entry_hashes(self, first: int, last: int) -> list[int]:
        """The hash of each block's entries, of blocks [first, last)."""
        begin = self.entries_at + int(self.before[first]) * self.entry_size
        raw = self.read(begin, self.entries_at + int(self.before[last]) * self.entry_size)
        cuts = (self.before[first : last + 1] - self.before[first]) * self.entry_size
        return [xxhash.xxh64_intdigest(raw[a:b]) for a, b in zip(cuts.tolist(), cuts[1:].tolist())]

    def verify(self, hashes: Iterable[int] | None = None) -> None:
        """Compare checksums, of which the hashes of blocks' entries may be given; the metadata is read once from front to back."""
        whole = xxhash.xxh64()
        for h in hashes if hashes is not None else (h for a, b in self.groups() for h in self.entry_hashes(a, b)):
            whole.update(h.to_bytes(8, "little"))
        metadata = xxhash.xxh64()
        for at in range(self.metadata_at, self.size - FOOTER, GROUP):
            metadata.update(self.read(at, min(at + GROUP, self.size - FOOTER)))
        if (whole.intdigest(), metadata.intdigest()) != self.hashes:
            raise errors.ChecksumFailed("entries or metadata are damaged")


def _number(columns: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(columns), 8), np.uint8)
    wide[:, : columns.shape[1]] = columns
    return wide.view("<i8").ravel()


def _entries_reader(path: str, at: int, fp_size: int, payload_size: int):
    size = fp_size + payload_size

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                before = np.array(r["before"], np.int64)
                raw = files.read_range(path, at + int(before[0]) * size, at + int(before[-1]) * size)
                packed = np.frombuffer(raw, np.uint8).reshape(-1, size) if size else np.zeros((int(before[-1] - before[0]), 0), np.uint8)
                ids = np.repeat(r["first"] + np.arange(len(before) - 1), np.diff(before))
                yield pa.RecordBatch.from_arrays([pa.array(before[0] + np.arange(len(packed))), pa.array(ids), pa.array(_number(packed[:, :fp_size])), pa.array(_number(packed[:, fp_size:]))], ["rank", "block_id", "fp", "payload"])

    return read


def _directory_reader(path: str, at: int, decode: object):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                offset, before = r["offset"], r["before"]
                raw = files.read_range(path, at + offset[0], at + offset[-1])
                for k in range(len(before) - 1):
                    found = decode(r["first"] + k, before[k + 1] - before[k], before[k], raw[offset[k] - offset[0] : offset[k + 1] - offset[0]])
                    if found is not None:
                        yield pa.RecordBatch.from_pydict(found)

    return read


def _buckets(block: int, keys: int, before: int, raw: bytes) -> dict:
    d = decode_bijection_block(raw, keys)
    k = len(d["size"])
    return {"block_id": np.full(k, block), "bucket_id": d["bucket_id"].astype(np.int32), "bucket_start": d["start"].astype(np.int32), "bucket_size": d["size"].astype(np.int32), "seed0": d["seed0"], "seed1": d["seed1"], "first_rank": before + d["start"]}


def _pilots(block: int, keys: int, before: int, raw: bytes) -> dict | None:
    if not keys:
        return None
    pilots, _ = decode_pilot_block(raw, keys)
    k = len(pilots)
    return {"block_id": np.full(k, block), "bucket_id": np.arange(k, dtype=np.int32), "pilot": pilots.astype(np.int32), "keys_in_block": np.full(k, keys), "keys_before": np.full(k, before)}


def _remap(block: int, keys: int, before: int, raw: bytes) -> dict | None:
    if not keys:
        return None
    _, remap = decode_pilot_block(raw, keys)
    return {"block_id": np.full(len(remap), block), "overflow_slot": keys + np.arange(len(remap)), "hole": remap}


def open_file(spark: SparkSession, path: str, verify: bool = False) -> Index:
    """The index in a file that all executors can read; with verify, after its checksums.

    The driver reads the header and the block directory (ten bytes a block); entries and block metadata are read and decoded by tasks, a range of blocks each.
    """
    p = Parsed(path)
    groups = p.groups()
    ranges = spark.createDataFrame(
        pa.table({"first": pa.array([a for a, _ in groups], pa.int64()), "before": pa.array([p.before[a : b + 1] for a, b in groups], pa.list_(pa.int64())), "offset": pa.array([p.offset[a : b + 1] for a, b in groups], pa.list_(pa.int64()))})
    ).repartition(max(1, len(groups)))
    if verify:

        def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Parsed(path)
            for batch in batches:
                for r in batch.to_pylist():
                    found = own.entry_hashes(r["first"], r["first"] + len(r["before"]) - 1)
                    yield pa.RecordBatch.from_arrays([pa.array(r["first"] + np.arange(len(found))), pa.array([x.to_bytes(8, "little") for x in found], pa.binary())], ["block_id", "hash"])

        rows = ranges.mapInArrow(hashed, "block_id long, hash binary").orderBy("block_id")
        p.verify(int.from_bytes(r.hash, "little") for r in rows.toLocalIterator())
    blocks = spark.createDataFrame(pa.table({"block_id": np.arange(len(p.before) - 1), "keys_in_block": np.diff(p.before), "keys_before": p.before[:-1]}))
    entries = ranges.mapInArrow(_entries_reader(path, p.entries_at, p.meta["fp_size"], p.meta["payload_size"]), "rank long, block_id long, fp long, payload long")

    def decoded(decode: object, schema: str) -> DataFrame:
        return ranges.mapInArrow(_directory_reader(path, p.metadata_at, decode), schema)

    if p.meta["algorithm"] == "bijection":
        tables = {"buckets": decoded(_buckets, "block_id long, bucket_id int, bucket_start int, bucket_size int, seed0 long, seed1 long, first_rank long")}
    else:
        tables = {
            "pilots": decoded(_pilots, "block_id long, bucket_id int, pilot int, keys_in_block long, keys_before long"),
            "remap": decoded(_remap, "block_id long, overflow_slot long, hole long"),
        }
    return Index(spark, p.meta, {"blocks": blocks, "entries": entries, **tables})


def open_bytes(spark: SparkSession, raw: bytes, verify: bool = False) -> Index:
    """The index in a binary form, which is put in the shared folder for the executors."""
    Parsed(raw)
    path = f"{ensure_checkpoint_dir(spark).sparkContext.getCheckpointDir()}/binary-{uuid.uuid4().hex}.idx"
    files.write_file(path, [raw])
    return open_file(spark, path, verify)
