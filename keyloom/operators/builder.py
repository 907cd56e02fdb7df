"""A builder that keys are handed to one by one, by several writers, or as DataFrames, until they are complete.

    with Builder(spark, total_keys=n, payload_size=4) as b:
        for key, value in source:
            b.add_key(key, value)
        index = b.finish()

Keys are held BATCH at a time and then written to the shared folder, so that neither their number nor a lost executor matters.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom import errors
from keyloom.functions import geometry as g
from keyloom.functions.model import fast_range, signed, split_key
from keyloom.operators.build import BIJECTION, algorithm_of, build
from keyloom.operators.index import Index
from keyloom.plans import validate
from keyloom.session import ensure_checkpoint_dir, remove_folder

BATCH = 1 << 18


class Builder:
    def __init__(self, spark: SparkSession, total_keys: int | None = None, *, ordered: bool = False, payload_size: int = 0, fingerprint_size: int = 0, algorithm: str = BIJECTION, **options: object) -> None:
        """total_keys, if given, must be the number of keys that come; ordered needs it, and takes keys only if their blocks don't go back."""
        how = algorithm_of(algorithm)
        validate.check_options(1 if total_keys is None else total_keys, payload_size, fingerprint_size)
        if ordered and total_keys is None:
            raise ValueError("an ordered builder must know how many keys come")
        self.spark, self.total_keys, self.payload_size = spark, total_keys, payload_size
        self.options = {"payload_size": payload_size, "fingerprint_size": fingerprint_size, "algorithm": algorithm, **options}
        self.path = f"{ensure_checkpoint_dir(spark).sparkContext.getCheckpointDir()}/builder-{uuid.uuid4().hex}"
        self.tag = f"keyloom-{uuid.uuid4().hex}"
        self.blocks = how.num_blocks(total_keys) if ordered else 0
        self.last_block = self.added = 0
        self.rows: list[tuple[bytes, int]] = []
        self.mode: str | None = None
        self.closed = self.cancelled = False
        self.lock = threading.Lock()

    def __enter__(self) -> Builder:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def _usable(self, mode: str) -> None:
        if self.closed:
            raise errors.BuilderClosed("the builder is finished or closed")
        if self.cancelled:
            raise errors.Cancelled("the build was cancelled")
        if self.mode not in (None, mode):
            raise errors.MixedWriters(f"keys came by {self.mode} before, and by {mode} now")
        self.mode = mode

    def _checked(self, key: bytes, payload: int) -> tuple[bytes, int]:
        if len(key) < g.MIN_KEY:
            raise errors.KeyTooShort(f"{len(key)} bytes")
        if len(key) > g.MAX_KEY:
            raise errors.KeyTooLong(f"{len(key)} bytes")
        if self.payload_size and not 0 <= payload < 1 << 8 * self.payload_size:
            raise errors.PayloadOverflow(f"{payload} needs more than {self.payload_size} bytes")
        # only the first 16 bytes tell keys apart
        return bytes(key[:16]), signed(payload) if self.payload_size else 0

    def _part(self) -> str:
        """A folder of its own for each write, since writers don't wait for each other."""
        return f"{self.path}/{uuid.uuid4().hex}"

    def _write(self, rows: list[tuple[bytes, int]]) -> None:
        table = pa.table({"key": pa.array([k for k, _ in rows], pa.binary()), "payload": pa.array([p for _, p in rows], pa.int64())})
        self.spark.createDataFrame(table).coalesce(1).write.parquet(self._part())
        with self.lock:
            self.added += len(rows)

    def add_key(self, key: bytes, payload: int = 0) -> None:
        self._usable("add_key")
        row = self._checked(key, payload)
        if self.blocks:
            block = fast_range(split_key(row[0])[0], self.blocks)
            if block < self.last_block:
                raise errors.UnsortedInput("the key's block is before the block of the key in front")
            self.last_block = block
        self.rows.append(row)
        if len(self.rows) >= BATCH:
            self._write(self.rows)
            self.rows = []

    def add_frame(self, df: DataFrame, key: str = "key", payload: str | None = None) -> None:
        """All keys of a DataFrame, which are checked when the builder finishes."""
        self._usable("add_frame")
        if self.blocks:
            raise errors.UnsortedInput("the rows of a DataFrame have no order")
        raw = F.col(key) if dict(df.dtypes)[key] == "binary" else F.encode(F.col(key), "utf-8")
        df.select(raw.alias("key"), (F.col(payload).cast("long") if payload else F.lit(0).cast("long")).alias("payload")).write.parquet(self._part())

    def add_keys(self, writers: int, write: Callable[[int, Callable[..., None]], None]) -> Index:
        """Run write(number, add) for each of some writers side by side, each with an add(key, payload=0) of its own, and finish."""
        self._usable("add_keys")
        if writers < 1:
            raise ValueError("one writer at least")
        if self.blocks:
            raise errors.UnsortedInput("several writers have no common order")

        def one(number: int) -> None:
            rows: list[tuple[bytes, int]] = []

            def add(key: bytes, payload: int = 0) -> None:
                if self.cancelled:
                    raise errors.Cancelled("the build was cancelled")
                rows.append(self._checked(key, payload))
                if len(rows) >= BATCH:
                    self._write(rows)
                    rows.clear()

            write(number, add)
            if rows:
                self._write(rows)

        with ThreadPoolExecutor(writers) as pool:
            list(pool.map(one, range(writers)))
        return self.finish()

    def finish(self) -> Index:
        """The index of all keys that came; no more can come after that, whether it succeeds or not."""
        if self.closed:
            raise errors.BuilderClosed("the builder is finished or closed")
        sc = self.spark.sparkContext
        sc.addJobTag(self.tag)
        try:
            if self.cancelled:
                raise errors.Cancelled("the build was cancelled")
            if self.rows:
                self._write(self.rows)
                self.rows = []
            if not self.added and self.mode != "add_frame":
                if self.total_keys:
                    raise errors.KeyCountMismatch(f"{self.total_keys} keys were declared, none came")
                raise errors.EmptyIndex("an index needs a key")
            keys = self.spark.read.schema("key binary, payload long").option("recursiveFileLookup", "true").parquet(self.path)
            return build(keys, payload="payload" if self.payload_size else None, total_keys=self.total_keys, **self.options)
        except errors.KeyloomError:
            raise
        except Exception as e:
            if self.cancelled:
                raise errors.Cancelled("the build was cancelled") from e
            raise
        finally:
            sc.removeJobTag(self.tag)
            self.close()

    def cancel(self) -> None:
        """Stop the build from any thread: no more keys are taken, and jobs of finish() that run are ended."""
        self.cancelled = True
        self.spark.sparkContext.cancelJobsWithTag(self.tag)

    def close(self) -> None:
        """Drop what came; closing twice is no fault."""
        if not self.closed:
            self.closed = True
            self.rows = []
            remove_folder(self.spark, self.path)
