"""The hash algebra as Catalyst expressions on bigint columns that carry unsigned bit patterns.

Nothing relies on wrapping arithmetic, so that ANSI mode, where overflow raises, makes no difference: products go through 16-bit limbs.
A product reads each limb several times, so that nested products would grow without measure if written as one expression.  Functions with
products therefore take a Let, which makes what they read into columns of their own; Catalyst keeps such projections apart, and
code generation fuses them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions.model import FINGERPRINT_FACTOR, pilot_hash, signed

LOW = 0xFFFFFFFF


def u64(value: int) -> Column:
    return F.lit(signed(value)).cast("long")


def key_bytes(*columns: str | Column) -> Column:
    """16 evenly spread bytes of any columns: the MD5 of their texts, joined by a bar."""
    columns = tuple(F.col(c) if isinstance(c, str) else c for c in columns)
    text = columns[0].cast("string") if len(columns) == 1 else F.concat_ws("|", *[c.cast("string") for c in columns])
    return F.unhex(F.md5(F.encode(text, "utf-8")))


def _bits(hex_digits: Column) -> Column:
    return F.conv(hex_digits, 16, -10).cast("long")


def prefix(key: Column) -> Column:
    return _bits(F.hex(F.substring(key, 1, 8)))


def _little_endian(key: Column, first: int) -> Column:
    digits = F.hex(F.substring(key, first, 8))
    return _bits(F.concat(*[F.substring(digits, 15 - 2 * i, 2) for i in range(8)]))


def k0(key: Column) -> Column:
    return _little_endian(key, 1)


def k1(key: Column) -> Column:
    return _little_endian(key, 9)


def as_hex(value: Column) -> Column:
    """A bit pattern as 16 hexadecimal digits, which order as the unsigned numbers do."""
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def _and(a: Column, mask: int) -> Column:
    return a.bitwiseAND(F.lit(mask).cast("long"))


def _limbs(a: Column) -> list[Column]:
    return [_and(F.shiftrightunsigned(a, 16 * i), 0xFFFF) for i in range(4)]


class Let:
    """A DataFrame that gains a hidden column for each expression it is given."""

    def __init__(self, df: DataFrame) -> None:
        self.df, self._columns = df, df.columns

    def __call__(self, *expressions: Column) -> list[Column]:
        names = [f"__let_{len(self.df.columns) + i}" for i in range(len(expressions))]
        self.df = self.df.withColumns(dict(zip(names, expressions)))
        return [F.col(n) for n in names]

    def result(self, **columns: Column) -> DataFrame:
        """The DataFrame as it was, with columns."""
        return self.df.select(*[c for c in self._columns if c not in columns], *[e.alias(n) for n, e in columns.items()])


def _digits(let: Let, a: Column, b: Column) -> tuple[Column, Column, Column, Column]:
    """a times b in four digits of 32 bits, which may be too large by what the next one takes over."""
    limbs = let(*_limbs(a), *_limbs(b))
    x, y = limbs[:4], limbs[4:]
    sums = []
    for k in range(7):
        terms = [x[i] * y[k - i] for i in range(max(0, k - 3), min(3, k) + 1)]
        total = terms[0]
        for t in terms[1:]:
            total = total + t
        sums.append(total)
    c = let(*sums)

    def low(v: Column) -> Column:
        return F.shiftleft(_and(v, 0xFFFF), 16)

    def high(v: Column) -> Column:
        return F.shiftrightunsigned(v, 16)

    return c[0] + low(c[1]), c[2] + high(c[1]) + low(c[3]), c[4] + high(c[3]) + low(c[5]), c[6] + high(c[5])


def product(let: Let, a: Column, b: Column) -> tuple[Column, Column]:
    """(high, low) 64 bits of a times b."""
    d0, d1, d2, d3 = let(*_digits(let, a, b))
    (d1,) = let(d1 + F.shiftrightunsigned(d0, 32))
    (d2,) = let(d2 + F.shiftrightunsigned(d1, 32))
    d3 = d3 + F.shiftrightunsigned(d2, 32)
    return F.shiftleft(d3, 32).bitwiseOR(_and(d2, LOW)), F.shiftleft(d1, 32).bitwiseOR(_and(d0, LOW))


def byteswapped(x: Column) -> Column:
    """A bit pattern with its bytes in reverse."""
    swapped = F.shiftleft(x, 56)
    for i in range(1, 8):
        swapped = swapped.bitwiseOR(F.shiftleft(_and(F.shiftrightunsigned(x, 8 * i), 0xFF), 56 - 8 * i))
    return swapped


def halves(let: Let, key: Column) -> tuple[Column, Column, Column]:
    """(prefix, k0, k1), with each half of the key read from its digits once."""
    first, second = let(prefix(key), _bits(F.hex(F.substring(key, 9, 8))))
    return first, byteswapped(first), byteswapped(second)


def fast_range(h: Column, n: int | Column) -> Column:
    """The high 64 bits of an unsigned h times n, n below 2^31."""
    n = F.lit(n).cast("long") if isinstance(n, int) else n
    return F.shiftrightunsigned(F.shiftrightunsigned(h, 32) * n + F.shiftrightunsigned(_and(h, LOW) * n, 32), 32)


def wymix(let: Let, a: Column, b: Column) -> Column:
    high, low = product(let, a, b)
    return high.bitwiseXOR(low)


def mixed_slot(let: Let, k0: Column, k1: Column, global_seed: int, seed: Column, size: Column) -> Column:
    (mixed,) = let(wymix(let, k0.bitwiseXOR(u64(global_seed)).bitwiseXOR(seed), k1.bitwiseXOR(u64(global_seed))))
    return F.when(size <= 1, F.lit(0).cast("long")).otherwise(fast_range(mixed, size.cast("long")))


def bijection_bucket(k0: Column, buckets: int) -> Column:
    return fast_range(k0, buckets)


def cubic_bucket(let: Let, x: Column, buckets: int) -> Column:
    if buckets <= 1:
        return F.lit(0).cast("long")
    (x,) = let(x)
    squared, _ = product(let, x, x)
    (squared,) = let(squared)
    cubed, _ = product(let, squared, F.shiftrightunsigned(x, 1).bitwiseOR(u64(1 << 63)))
    c, d = let(F.shiftrightunsigned(cubed, 8), F.shiftrightunsigned(x, 8))
    (low,) = let(_and(c, LOW) * 255 + _and(d, LOW))
    high = F.shiftrightunsigned(c, 32) * 255 + F.shiftrightunsigned(d, 32) + F.shiftrightunsigned(low, 32)
    (scaled,) = let(F.shiftleft(high, 32).bitwiseOR(_and(low, LOW)))
    return fast_range(scaled, buckets)


def folded(k0: Column, k1: Column) -> Column:
    h = k0.bitwiseXOR(k1)
    return h.bitwiseXOR(F.shiftrightunsigned(h, 32))


def pilot_hashes(global_seed: int) -> Column:
    """All 256 hashed pilots, by place from 1."""
    return F.array(*[u64(pilot_hash(p, global_seed)) for p in range(256)])


def pilot_slot(let: Let, fold: Column, hashed_pilot: Column, slots: int | Column) -> Column:
    (mixed,) = let(product(let, *let(fold, hashed_pilot))[1])
    return fast_range(mixed, slots)


def fingerprint(let: Let, k0: Column, k1: Column, size: int) -> Column:
    if size == 0:
        return F.lit(0).cast("long")
    _, low = product(let, *let(k1, u64(FINGERPRINT_FACTOR)))
    return _and(F.shiftrightunsigned(k0.bitwiseXOR(low), 32), (1 << (8 * size)) - 1)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [None if k is None else xxhash.xxh3_128_digest(k)[::-1] for k in batch.columns[-1].to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(keys, pa.binary())], batch.schema.names)


def pre_hash(df: DataFrame, column: str, out: str = "key") -> DataFrame:
    """df with a last column out: 16-byte keys, the 128-bit xxHash3 of a binary or text column with the low half first."""
    raw = F.col(column) if dict(df.dtypes)[column] == "binary" else F.encode(F.col(column).cast("string"), "utf-8")
    widened = df.select(*[c for c in df.columns if c != out], raw.alias(out))
    return widened.mapInArrow(_hashed, widened.schema)
