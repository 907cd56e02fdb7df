"""Entry files: an 8-byte little-endian count, then entries of a 16-byte key and a 4-byte little-endian payload.

Read as a Spark data source whose partitions are ranges of entries, so that one large file is many tasks:

    register(spark)
    spark.read.format("keyloom_entries").option("path", "/shared/keys/*.bin").load()
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from keyloom import errors
from keyloom.functions import hashing as h
from keyloom.sources import files

FORMAT = "keyloom_entries"
ENTRY, KEY = 20, 16
CHUNK = 1 << 20
HEADERS_AT_ONCE = 32
AT_ONCE = 1 << 16


def file_count(path: str) -> int:
    """The entries of a file, from its first eight bytes and its size."""
    head = files.read_range(path, 0, 8)
    if len(head) < 8:
        raise errors.TruncatedFile(path)
    (n,) = struct.unpack("<Q", head)
    if files.size_of(path) < 8 + ENTRY * n:
        raise errors.TruncatedFile(f"{path} has fewer than {n} entries")
    return n


def file_counts(paths: list[str]) -> list[int]:
    """The entries of each file; headers are read by many threads, since each is a wait."""
    with ThreadPoolExecutor(HEADERS_AT_ONCE) as pool:
        return list(pool.map(file_count, paths))


def total_entries(paths: list[str]) -> int:
    return sum(file_counts(paths))


class EntryRange(InputPartition):
    def __init__(self, path: str, first: int, n: int) -> None:
        self.path, self.first, self.n = path, first, n


class EntryReader(DataSourceReader):
    def __init__(self, paths: list[str], chunk: int) -> None:
        self.paths, self.chunk = paths, chunk

    def partitions(self) -> list[EntryRange]:
        return [EntryRange(p, s, min(self.chunk, n - s)) for p, n in zip(self.paths, file_counts(self.paths)) for s in range(0, n, self.chunk)]

    def read(self, partition: EntryRange) -> Iterator[pa.RecordBatch]:
        system, path = files.located(partition.path)
        with system.open_input_file(path) as f:
            f.seek(8 + ENTRY * partition.first)
            left = partition.n
            while left > 0:
                n = min(left, AT_ONCE)
                raw = np.frombuffer(f.read(ENTRY * n), np.uint8).reshape(n, ENTRY)
                keys = pa.FixedSizeBinaryArray.from_buffers(pa.binary(KEY), n, [None, pa.py_buffer(np.ascontiguousarray(raw[:, :KEY]))]).cast(pa.binary())
                payloads = np.ascontiguousarray(raw[:, KEY:]).view("<u4").ravel().astype(np.int64)
                yield pa.RecordBatch.from_arrays([keys, pa.array(payloads)], ["key", "payload"])
                left -= n


class EntrySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "key binary, payload bigint"

    def reader(self, schema: StructType) -> EntryReader:
        return EntryReader(files.matching(self.options["path"]), int(self.options.get("chunk", CHUNK)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(EntrySource)


def read_entries(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    register(spark)
    return spark.read.format(FORMAT).option("path", path).option("chunk", chunk).load()


def synthetic(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """n distinct random (key, payload) entries."""
    ids = spark.range(n)
    return ids.select(F.unhex(F.md5(F.encode(F.concat_ws(":", F.lit(seed), F.col("id")), "utf-8"))).alias("key"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 32)).alias("payload"))


def write_entries(entries: DataFrame, folder: str, files_n: int, ordered: bool = False) -> DataFrame:
    """Write (key, payload) as files in a shared folder, in key order across and within files if ordered; (path, entries) of each file.

    A task holds its file's entries (20 bytes each), since their number stands first.
    """
    spread = entries.select("key", "payload")
    spread = spread.repartitionByRange(files_n, "key").sortWithinPartitions("key") if ordered else spread.repartition(files_n)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        path, n, parts = f"{folder}/entries-{TaskContext.get().partitionId():05d}.bin", 0, []
        for batch in batches:
            raw = np.empty((batch.num_rows, ENTRY), np.uint8)
            raw[:, :KEY] = np.frombuffer(b"".join(batch.column("key").to_pylist()), np.uint8).reshape(-1, KEY)
            raw[:, KEY:] = batch.column("payload").to_numpy().astype("<u4").view(np.uint8).reshape(-1, 4)
            parts.append(raw.tobytes())
            n += batch.num_rows
        files.write_file(path, [struct.pack("<Q", n), *parts])
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n])], ["path", "entries"])

    return spread.mapInArrow(write, "path string, entries long")


def evenly_spread(df: DataFrame, column: str) -> DataFrame:
    """df with a key of any column's MD5, for sources whose keys aren't spread."""
    return df.withColumn("key", h.key_bytes(column))
