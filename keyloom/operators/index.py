"""An immutable index as DataFrames: batch lookups, membership, statistics, verification, Parquet."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from types import ModuleType

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.errors import PySparkTypeError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from keyloom import errors
from keyloom.functions import geometry as g
from keyloom.functions import hashing as h
from keyloom.functions import kernels as K
from keyloom.functions.model import fast_range, signed, split_key
from keyloom.operators import packed as P
from keyloom.operators.packed import OK, PackedIndex, bytes_of
from keyloom.plans import validate
from keyloom.session import checkpoint, remove_folder, shuffle_partitions, subfolders

VERSION = 1
#: an index whose arrays take no more goes to every executor whole
PACK_BYTES = 64 << 20
#: the bytes of a larger index that a task of a lookup reads, but for one block more, and the keys whose arrays it holds at once, but for one block
TASK_BYTES, HELD_KEYS = 16 << 20, 100_000
EMPTY_HASH = xxhash.xxh64_intdigest(b"")
_META = "version int, algorithm string, total_keys long, num_blocks long, payload_size int, fp_size int, global_seed long, user_metadata binary, payload_hash long, metadata_hash long, metadata_size long, data string"


def _module(name: str) -> ModuleType:
    from keyloom.operators.build import algorithm_of

    return algorithm_of(name)


def _in_arrow(df: DataFrame) -> bool:
    try:
        to_arrow_schema(df.schema)
    except PySparkTypeError:
        return False
    return True


def packed_entries(fp: pd.Series, payload: pd.Series, fp_size: int, payload_size: int) -> bytes:
    """Entries in rank order as they are stored: fingerprint, then payload, both little-endian."""
    out = np.empty((len(fp), fp_size + payload_size), np.uint8)
    out[:, :fp_size] = fp.to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8)[:, :fp_size]
    out[:, fp_size:] = payload.to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8)[:, :payload_size]
    return out.tobytes()


class Index:
    def __init__(self, spark: SparkSession, meta: dict, tables: dict[str, DataFrame], hashes: tuple[int, int] | None = None) -> None:
        self.spark, self.meta, self.tables = spark, meta, tables
        self._hashes, self._closed = hashes, False
        self._packed = self._broadcast = None
        self._metadata_size: int | None = None

    # what it holds

    @property
    def num_keys(self) -> int:
        return self.meta["total_keys"]

    @property
    def num_blocks(self) -> int:
        return self.meta["num_blocks"]

    @property
    def payload_size(self) -> int:
        return self.meta["payload_size"]

    @property
    def user_metadata(self) -> bytes:
        return self.meta["user_metadata"]

    def close(self) -> None:
        """No more lookups; closing twice is no fault."""
        self._closed = True
        if self._broadcast is not None:
            self._broadcast.unpersist()
        self._packed = self._broadcast = None

    def with_payload(self) -> Index:
        """This index, if it can answer payload lookups."""
        self._open()
        if not self.payload_size:
            raise errors.NoPayload("the index was built without payloads")
        return self

    def _open(self) -> None:
        if self._closed:
            raise errors.IndexClosed("the index is closed")

    # lookups

    def packed(self) -> PackedIndex | None:
        """The index as arrays, if they take no more than PACK_BYTES; collected once."""
        how = _module(self.meta["algorithm"])
        if self._packed is None and bytes_of(self.meta, how) <= PACK_BYTES:
            self._packed = PackedIndex.of_runs(self.meta, how, P.runs(self.meta, how, self.tables).toArrow().to_batches())
        return self._packed

    def _packed_lookup(self, probe: DataFrame, raw: Column, payload: bool) -> DataFrame:
        if self._broadcast is None:
            self._broadcast = self.spark.sparkContext.broadcast(self._packed)
        held = self._broadcast

        @F.arrow_udf("rank long, payload long, status string")
        def find(keys: pa.Array) -> pa.Array:
            return held.value.answer(keys, payload)

        own = [F.col(c) for c in probe.columns if c not in ("rank", "payload", "status")]
        # else a filter on the outcome would go below the projection and be a second search
        found = probe.select(*own, find.asNondeterministic()(raw).alias("__found"))
        return found.select(*own, "__found.rank", *(["__found.payload"] if payload else []), "__found.status")

    def _shuffled_lookup(self, probe: DataFrame, raw: Column, key: str, payload: bool) -> DataFrame:
        """The probe's rows and the index as runs, shuffled once by block; each task reads its blocks in order, the runs of some in front of the rows that look there."""
        meta, how = self.meta, _module(self.meta["algorithm"])
        blocks = self.num_blocks
        tasks = min(blocks, max(shuffle_partitions(self.spark), self.spark.sparkContext.defaultParallelism, -(-bytes_of(meta, how) // TASK_BYTES)))
        # task b % tasks has block b; blocks of one step are held at once
        step = tasks * max(1, HELD_KEYS * blocks // self.num_keys)
        own = [c for c in probe.columns if c not in ("rank", "payload", "status")]
        given = key in own and dict(probe.dtypes)[key] == "binary"
        at_key = key if given else "__key"
        let = h.Let(probe.select(*own, *([] if given else [raw.alias("__key")])))
        # outside the condition, in which it would be read anew wherever the number of the block names it
        (prefix,) = let(h.prefix(F.col(at_key)))
        # keys that don't fit need no block, and are spread
        block = F.when(validate.key_length_status(F.col(at_key)) == "OK", h.fast_range(prefix, blocks)).otherwise(F.spark_partition_id() % blocks)
        keyed = let.result(__order=(block * 2 + 1).cast("long"), __run=F.lit(None).cast("binary"))
        names = keyed.columns[:-2]
        kinds = {f.name: f.dataType for f in keyed.schema}
        index = P.runs(meta, how, self.tables).select(*[F.lit(None).cast(kinds[c]).alias(c) for c in names], (F.col("block_id") * 2).alias("__order"), P.folded().alias("__run"))
        turn = F.expr(f"shiftright(__order, 1) div {step} * 2 + (__order & 1)")
        spread = keyed.union(index).repartitionById(tasks, F.expr(f"cast(shiftright(__order, 1) % {tasks} as int)")).sortWithinPartitions(turn)
        at = names.index(at_key)
        kept = len(own)
        fields = ["rank", *(["payload"] if payload else []), "status"]

        def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows, held, of = [], None, -1
            for batch in batches:
                order = batch.column(len(names)).to_numpy()
                turns = (order >> 1) // step * 2 + (order & 1)
                cuts = [0, *(np.flatnonzero(turns[1:] != turns[:-1]) + 1).tolist(), len(turns)]
                for a, b in zip(cuts[:-1], cuts[1:]):
                    if a == b:
                        continue
                    part = batch.slice(a, b - a)
                    if turns[a] & 1 == 0:
                        if turns[a] != of:
                            rows, held, of = [], None, turns[a]
                        rows.append(P.unfolded(order[a:b] >> 1, part.column(len(names) + 1)))
                        continue
                    if held is None:
                        held, rows = PackedIndex.of_runs(meta, how, rows), []
                    found = held.answer(part.column(at), payload)
                    yield pa.RecordBatch.from_arrays([*part.columns[:kept], *[found.field(f) for f in fields]], [*own, *fields])

        kind = StructType([*[StructField(c, kinds[c]) for c in own], StructField("rank", LongType()), *([StructField("payload", LongType())] if payload else []), StructField("status", StringType())])
        return spread.mapInArrow(answers, kind)

    def lookup(self, probe: DataFrame, key: str = "key", payload: bool = False) -> DataFrame:
        """probe with rank, payload (if wanted) and status: OK, NOT_FOUND, KEY_TOO_SHORT (also null) or KEY_TOO_LONG.

        Without fingerprints a key that isn't in the index may be given some key's rank; with f bytes that happens once in 256^f times.
        An index of up to PACK_BYTES is broadcast and probed without a shuffle; with a larger one the probe is shuffled once.  Works on streams too, which
        are joined with a larger index, as are rows with columns that Arrow doesn't have.
        """
        self._open()
        if payload:
            self.with_payload()
        raw = F.col(key) if dict(probe.dtypes)[key] == "binary" else F.encode(F.col(key), "utf-8")
        if self.packed() is not None:
            return self._packed_lookup(probe, raw, payload)
        if not probe.isStreaming and _in_arrow(probe):
            return self._shuffled_lookup(probe, raw, key, payload)
        return self._joined_lookup(probe, raw, payload)

    def _joined_lookup(self, probe: DataFrame, raw: Column, payload: bool) -> DataFrame:
        own = [c for c in probe.columns if c not in ("rank", "payload", "status")]
        checked = probe.select(*[F.col(c).alias(f"__p_{c}") for c in own], validate.key_length_status(raw).alias("key_status"), raw.alias("__key"))
        fits = F.col("key_status") == "OK"
        keyed = checked.withColumns({"k0": F.when(fits, h.k0(F.col("__key"))), "k1": F.when(fits, h.k1(F.col("__key"))), "block_id": F.when(fits, h.fast_range(h.prefix(F.col("__key")), self.num_blocks))}).drop("__key")
        found = _module(self.meta["algorithm"]).lookup(keyed, self.tables, self.meta["global_seed"], self.tables["blocks"])
        columns = [F.col(f"__p_{c}").alias(c) for c in own]
        if payload or self.meta["fp_size"]:
            found = found.join(self.tables["entries"].drop("block_id"), "rank", "left")
            if self.meta["fp_size"]:
                same = F.col("fp") == K.fingerprint_column(F.col("k0"), F.col("k1"), self.meta["fp_size"])
                found = found.withColumn("rank", F.when(same, F.col("rank")))
        status = F.when(F.col("key_status") != "OK", F.col("key_status")).when(F.col("rank").isNull(), "NOT_FOUND").otherwise("OK").alias("status")
        values = [F.when(F.col("rank").isNotNull(), F.col("payload")).alias("payload")] if payload else []
        return found.select(*columns, "rank", *values, status)

    def query_rank(self, probe: DataFrame, key: str = "key") -> DataFrame:
        return self.lookup(probe, key)

    def query_payload(self, probe: DataFrame, key: str = "key") -> DataFrame:
        return self.lookup(probe, key, payload=True)

    def rank_of(self, key: bytes) -> int:
        """The rank of one key, looked up on the driver; raises NotFound, KeyTooShort or KeyTooLong."""
        return self._one(key, False)[0]

    def payload_of(self, key: bytes) -> int:
        """The payload of one key, looked up on the driver."""
        self.with_payload()
        return self._one(key, True)[1]

    def _one(self, key: bytes, payload: bool) -> tuple[int, int | None]:
        self._open()
        if len(key) < g.MIN_KEY:
            raise errors.KeyTooShort(f"{len(key)} bytes")
        if len(key) > g.MAX_KEY:
            raise errors.KeyTooLong(f"{len(key)} bytes")
        packed = self.packed()
        if packed is None:
            # one block's part of the directory and one entry, by filters that reach the files
            prefix, _, _ = split_key(key)
            own = F.col("block_id") == fast_range(prefix, self.num_blocks)
            probe = self.spark.createDataFrame([(bytearray(key),)], "key binary")
            narrow = Index(self.spark, self.meta, {n: t.where(own) for n, t in self.tables.items()})
            row = narrow.lookup(probe, payload=payload).first()
            if row.status != "OK":
                raise errors.NotFound(key[:16].hex())
            return row.rank, row.payload if payload else None
        rank, status = packed.find(pa.array([key], pa.binary()))
        if status[0] != OK:
            raise errors.NotFound(key[:16].hex())
        return int(rank[0]), int(packed.payload[rank[0]]) if payload else None

    def members(self, probe: DataFrame, key: str = "key") -> DataFrame:
        """probe's rows whose key is (but for false positives) in the index."""
        return self.lookup(probe, key).where("status = 'OK'").drop("rank", "status")

    def non_members(self, probe: DataFrame, key: str = "key") -> DataFrame:
        return self.lookup(probe, key).where("status <> 'OK'").drop("rank", "status")

    # integrity

    def entry_hashes(self) -> DataFrame:
        """(block_id, entry_hash): the xxHash64 of each block's stored entries, empty blocks too."""
        fp_size, payload_size = self.meta["fp_size"], self.payload_size

        def one(table: pa.Table) -> pa.Table:
            rows = table.to_pandas().sort_values("rank")
            raw = packed_entries(rows["fp"], rows["payload"], fp_size, payload_size)
            return pa.table({"block_id": pa.array([int(rows["block_id"].iloc[0])]), "entry_hash": pa.array([signed(xxhash.xxh64_intdigest(raw))])})

        hashed = self.tables["entries"].groupBy("block_id").applyInArrow(one, "block_id long, entry_hash long")
        return self.tables["blocks"].join(hashed, "block_id", "left").select("block_id", F.coalesce("entry_hash", F.lit(signed(EMPTY_HASH))).alias("entry_hash"))

    def directory_hashes(self) -> DataFrame:
        """(block_id, entry_hash, size): the xxHash64 of each block's encoded metadata, and its bytes."""
        from keyloom.sources import codec

        def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                raw = batch.column("metadata").to_pylist()
                yield pa.RecordBatch.from_arrays([batch.column("block_id"), pa.array([signed(xxhash.xxh64_intdigest(r)) for r in raw], pa.int64()), pa.array(list(map(len, raw)), pa.int64())], ["block_id", "entry_hash", "size"])

        return codec.block_metadata(self).select("block_id", "metadata").mapInArrow(hashed, "block_id long, entry_hash long, size long")

    @staticmethod
    def _folded(hashes: DataFrame) -> int:
        """The hash of all blocks' hashes in block order, streamed past the driver."""
        whole = xxhash.xxh64()
        for row in hashes.orderBy("block_id").toLocalIterator():
            whole.update((row.entry_hash & (1 << 64) - 1).to_bytes(8, "little"))
        return whole.intdigest()

    def hashes(self) -> tuple[int, int]:
        return self._folded(self.entry_hashes()), self._folded(self.directory_hashes())

    def verify(self) -> None:
        """Raise ChecksumFailed if entries or metadata are not those that were saved."""
        self._open()
        if self._hashes is None:
            raise errors.CorruptedIndex("the index was never saved and has no checksums")
        if self.hashes() != self._hashes:
            raise errors.ChecksumFailed("the index differs from what was saved")

    def stats(self) -> DataFrame:
        """One row: keys, blocks, payload and fingerprint sizes, bits a key in the binary form and beyond payloads and fingerprints, sizes, algorithm."""
        from keyloom.sources import codec

        self._open()
        if self._metadata_size is None:
            lengths = self.directory_hashes().agg(F.sum("size").alias("metadata_size"))
        else:
            lengths = self.spark.createDataFrame([(self._metadata_size,)], "metadata_size long")
        entry = self.payload_size + self.meta["fp_size"]
        fixed = codec.fixed_size(self.meta)
        size = F.col("metadata_size") + fixed + self.num_keys * entry
        bits = size * 8 / F.lit(float(self.num_keys))
        return lengths.select(
            F.lit(self.num_keys).cast("long").alias("num_keys"),
            F.lit(self.num_blocks).cast("long").alias("num_blocks"),
            bits.alias("bits_per_key"),
            F.lit(self.payload_size).alias("payload_size"),
            F.lit(self.meta["fp_size"]).alias("fingerprint_size"),
            (bits - 8 * entry).alias("overhead_bits_per_key"),
            size.alias("index_size"),
            F.lit(self.meta["algorithm"]).alias("algorithm"),
        )

    # storage

    def save(self, path: str) -> Index:
        """Write the index as Parquet tables in a new folder under path, then the one-row meta table that names it, and return the index with its checksums.

        Whatever is interrupted, path holds the old index, the new one or none, and never parts of two.
        """
        self._open()
        entry_hash = self._folded(self.entry_hashes())
        directory = checkpoint(self.directory_hashes())
        self._hashes = entry_hash, self._folded(directory)
        self._metadata_size = directory.agg(F.sum("size")).first()[0]
        data = f"data-{uuid.uuid4().hex}"
        for name, table in self.tables.items():
            by = "rank" if name == "entries" else "block_id"
            table.repartitionByRange(by).sortWithinPartitions(by).write.parquet(f"{path}/{data}/{name}")
        m = self.meta
        row = (VERSION, m["algorithm"], m["total_keys"], m["num_blocks"], m["payload_size"], m["fp_size"], signed(m["global_seed"]), bytearray(m["user_metadata"]), *map(signed, self._hashes), self._metadata_size, data)
        self.spark.createDataFrame([row], _META).coalesce(1).write.mode("overwrite").parquet(f"{path}/index_meta")
        for name in subfolders(self.spark, path):
            if name.startswith("data-") and name != data:
                remove_folder(self.spark, f"{path}/{name}")
        return self

    def __repr__(self) -> str:
        return json.dumps({k: v for k, v in self.meta.items() if k != "user_metadata"})


def open_index(spark: SparkSession, path: str) -> Index:
    """An index that was saved; its checksums are only looked at by verify."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.parquet(f"{path}/index_meta").collect()
    except AnalysisException as e:
        raise errors.TruncatedFile(f"no complete index at {path}") from e
    if len(rows) != 1:
        raise errors.CorruptedIndex("index_meta has other than one row")
    row = rows[0]
    if row.version != VERSION:
        raise errors.InvalidVersion(f"version {row.version}")
    if not 0 <= row.payload_size <= 8 or not 0 <= row.fp_size <= 4 or row.num_blocks == 0 and row.total_keys > 0:
        raise errors.CorruptedIndex("index_meta holds impossible sizes")
    meta = {
        "algorithm": row.algorithm,
        "total_keys": row.total_keys,
        "num_blocks": row.num_blocks,
        "payload_size": row.payload_size,
        "fp_size": row.fp_size,
        "global_seed": row.global_seed & (1 << 64) - 1,
        "user_metadata": bytes(row.user_metadata),
    }
    _module(row.algorithm)
    names = ["blocks", "entries", *(["buckets"] if row.algorithm == "bijection" else ["pilots", "remap"])]
    try:
        tables = {n: spark.read.parquet(f"{path}/{row.data}/{n}") for n in names}
    except AnalysisException as e:
        raise errors.TruncatedFile(f"a table of the index at {path} is missing") from e
    index = Index(spark, meta, tables, (row.payload_hash & (1 << 64) - 1, row.metadata_hash & (1 << 64) - 1))
    index._metadata_size = row.metadata_size
    return index


def open_payload(spark: SparkSession, path: str) -> Index:
    return open_index(spark, path).with_payload()


def get_stats(spark: SparkSession, path: str) -> DataFrame:
    return open_index(spark, path).stats()
