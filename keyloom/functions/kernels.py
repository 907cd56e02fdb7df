"""The hash algebra on numpy arrays of unsigned 64-bit integers, for the solvers and, as Arrow functions, for lookups.

Lookups use these and not the column expressions: joins on the outcome of long expressions make Catalyst's inference of constraints
grow without measure, and two products in a row run slower than one batch of numpy (see README).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from keyloom.functions.model import FINGERPRINT_FACTOR

U = np.uint64
_LOW, _32 = U(0xFFFFFFFF), U(32)


def product(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(high, low) of a times b."""
    al, ah, bl, bh = a & _LOW, a >> _32, b & _LOW, b >> _32
    ll, lh, hl = al * bl, al * bh, ah * bl
    middle = (ll >> _32) + (lh & _LOW) + (hl & _LOW)
    return ah * bh + (lh >> _32) + (hl >> _32) + (middle >> _32), a * b


def fast_range(h: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    n = np.asarray(n, U)
    return ((h >> _32) * n + (((h & _LOW) * n) >> _32)) >> _32


def wymix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    high, low = product(a, b)
    return high ^ low


def folded(k0: np.ndarray, k1: np.ndarray) -> np.ndarray:
    h = k0 ^ k1
    return h ^ (h >> _32)


def cubic_bucket(x: np.ndarray, buckets: int) -> np.ndarray:
    cubed = product(product(x, x)[0], (x >> U(1)) | U(1 << 63))[0]
    return fast_range((cubed >> U(8)) * U(255) + (x >> U(8)), buckets).astype(np.int64)


def fingerprint(k0: np.ndarray, k1: np.ndarray, size: int) -> np.ndarray:
    return (((k0 ^ (k1 * U(FINGERPRINT_FACTOR))) >> _32) & U((1 << (8 * size)) - 1)).astype(np.int64)


def unsigned(a: pa.Array) -> np.ndarray:
    """The bit patterns of a bigint array; 0 for null."""
    return a.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)


def signed(a: pa.Array) -> np.ndarray:
    return a.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)


def fingerprint_column(k0: Column, k1: Column, size: int) -> Column:
    """Stored fingerprints; those of null keys mean nothing."""
    if size == 0:
        return F.lit(0).cast("long")

    @F.arrow_udf("long")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(fingerprint(unsigned(a), unsigned(b), size))

    return run(k0, k1)


def key_halves(keys: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(octets, prefix, k0, k1) of binary keys; null has -1 octets, and keys under 16 bytes no meaningful halves."""
    if isinstance(keys, pa.ChunkedArray):
        keys = keys.combine_chunks()
    wide = pa.types.is_large_binary(keys.type) or pa.types.is_large_string(keys.type)
    _, offsets, data = keys.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[keys.offset : keys.offset + len(keys) + 1].astype(np.int64) if len(keys) else np.zeros(1, np.int64)
    n = np.where(keys.is_valid().to_numpy(zero_copy_only=False), np.diff(off), -1)
    first = np.zeros((len(keys), 16), np.uint8)
    fits = np.flatnonzero(n >= 16)
    if len(fits):
        first[fits] = np.frombuffer(data, np.uint8)[off[fits][:, None] + np.arange(16)]
    halves = first.view("<u8")
    return n, halves[:, 0].byteswap(), halves[:, 0].copy(), halves[:, 1].copy()


def rows_of(schema: pa.Schema, n: int, **columns: object) -> pa.Table:
    """A table of n rows with columns, and nulls in the others."""
    return pa.table([pa.array(columns[f.name]).cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)
