"""Pinned values, and the column expressions and numpy kernels against plain integers, with ANSI mode on and off."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.functions import geometry as g
from keyloom.functions import hashing as h
from keyloom.functions import kernels as K
from keyloom.functions import model as m

WYMIX = [
    (0, 0, 0),
    (1, 1, 1),
    (0x0123456789ABCDEF, 0xFEDCBA9876543210, 0x2317228F48165BB2),
    (m.M64, m.M64, m.M64),
    (0xDEADBEEFCAFEBABE, 0x0123456789ABCDEF, 0x7E4BD22A04F6DD7F),
]
FINGERPRINTS = [
    (0xDEADBEEFCAFEBABE, 0, 0, 0),
    (0xDEADBEEFCAFEBABE, 0, 1, 0xEF),
    (0xDEADBEEFCAFEBABE, 0, 2, 0xBEEF),
    (0xDEADBEEFCAFEBABE, 0, 3, 0xADBEEF),
    (0xDEADBEEFCAFEBABE, 0, 4, 0xDEADBEEF),
    (0x123456789ABCDEF0, 0xFEDCBA9876543210, 1, 0xE3),
    (0x123456789ABCDEF0, 0xFEDCBA9876543210, 2, 0xA5E3),
    (0x123456789ABCDEF0, 0xFEDCBA9876543210, 3, 0x82A5E3),
    (0x123456789ABCDEF0, 0xFEDCBA9876543210, 4, 0x4582A5E3),
    (0, m.M64, 4, 0xAE833E48),
    (m.M64, 1, 4, 0xAE833E48),
]


def test_pinned():
    for a, b, want in WYMIX:
        assert m.wymix(a, b) == want
        assert int(K.wymix(np.array([a], np.uint64), np.array([b], np.uint64))[0]) == want
    for a, b, size, want in FINGERPRINTS:
        assert m.fingerprint(a, b, size) == want
    assert [g.bijection_blocks(n) for n in (1, 100, 1000, 10_000, 100_000, 1_000_000)] == [2, 2, 2, 4, 33, 326]
    assert [g.pilot_blocks(n) for n in (1, 100, 1000, 10_000, 100_000, 1_000_000)] == [2, 2, 2, 2, 4, 32]
    assert [g.slots(n) for n in (1, 10, 100, 1000, 10_000)] == [2, 11, 102, 1011, 10102]
    assert m.cubic_bucket(5, 0) == m.cubic_bucket(5, 1) == m.cubic_bucket(0, 10) == 0
    assert m.cubic_bucket(m.M64, 10_000) == 9999


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_expressions(spark, ansi):
    rng = random.Random(7)
    edges = [0, 1, m.M64, 1 << 63, (1 << 63) - 1, m.M32, 1 << 32]
    pairs = [(a, b) for a in edges for b in edges] + [(rng.getrandbits(64), rng.getrandbits(64)) for _ in range(800)] + [(a, b) for a, b, _ in WYMIX]
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        df = spark.createDataFrame([(i, m.signed(a), m.signed(b)) for i, (a, b) in enumerate(pairs)], "i int, a long, b long")
        a, b = F.col("a"), F.col("b")
        let = h.Let(df)
        high, low = h.product(let, a, b)
        out = let.result(
            wymix=h.wymix(let, a, b),
            high=high,
            low=low,
            range=h.fast_range(a, 1_000_003),
            cubic=h.cubic_bucket(let, a, 10_000),
            folded=h.folded(a, b),
            fp=h.fingerprint(let, a, b, 3),
            pilot_slot=h.pilot_slot(let, h.folded(a, b), F.element_at(h.pilot_hashes(g.DEFAULT_SEED), 201), 31_920),
            slot=h.mixed_slot(let, a, b, g.DEFAULT_SEED, F.lit(77).cast("long"), F.lit(6)),
            hex=h.as_hex(a),
        ).collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", "true")
    assert len(out) == len(pairs)
    hashed = m.pilot_hash(200, g.DEFAULT_SEED)
    for r in out:
        a, b = pairs[r.i]
        assert r.wymix == m.signed(m.wymix(a, b))
        assert r.high == m.signed(a * b >> 64) and r.low == m.signed(a * b & m.M64)
        assert r.range == m.fast_range(a, 1_000_003)
        assert r.cubic == m.cubic_bucket(a, 10_000)
        assert r.folded == m.signed(m.folded(a, b))
        assert r.fp == m.fingerprint(a, b, 3)
        assert r.pilot_slot == m.pilot_slot(m.folded(a, b), hashed, 31_920)
        assert r.slot == m.mixed_slot(a, b, g.DEFAULT_SEED, 77, 6)
        assert r.hex == f"{a:016x}"


def test_kernels():
    rng = random.Random(8)
    xs, ys = ([rng.getrandbits(64) for _ in range(500)] + [0, m.M64] for _ in range(2))
    a, b = np.array(xs, np.uint64), np.array(ys, np.uint64)
    high, low = K.product(a, b)
    assert [int(x) for x in high] == [x * y >> 64 for x, y in zip(xs, ys)]
    assert [int(x) for x in low] == [x * y & m.M64 for x, y in zip(xs, ys)]
    assert K.fingerprint(a, b, 3).tolist() == [m.fingerprint(x, y, 3) for x, y in zip(xs, ys)]
    assert K.cubic_bucket(a, 10_000).tolist() == [m.cubic_bucket(x, 10_000) for x in xs]


def test_key_split_and_prehash(spark):
    import xxhash

    keys = [bytes(range(16)), bytes(reversed(range(100, 120))), b"\xff" * 16]
    df = spark.createDataFrame([(bytearray(k),) for k in keys], "key binary")
    rows = df.select(h.prefix(F.col("key")).alias("p"), h.k0(F.col("key")).alias("k0"), h.k1(F.col("key")).alias("k1")).collect()
    assert [tuple(r) for r in rows] == [tuple(map(m.signed, m.split_key(k))) for k in keys]
    hashed = h.pre_hash(spark.createDataFrame([("a", 1), (None, 2), ("bc", 3)], "url string, n int"), "url").collect()
    assert [r.n for r in hashed] == [1, 2, 3]
    want = xxhash.xxh3_128_intdigest(b"bc")
    assert bytes(hashed[2].key) == (want & m.M64).to_bytes(8, "little") + (want >> 64).to_bytes(8, "little")
    assert hashed[1].key is None


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_halves(spark, ansi):
    """Keys split from two readings of their digits are split as those of plain integers."""
    rng = random.Random(11)
    keys = [b"\0" * 16, b"\xff" * 16, bytes(range(16)), b"\x80" + b"\0" * 14 + b"\x80", *[rng.randbytes(rng.randrange(16, 40)) for _ in range(300)]]
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        let = h.Let(spark.createDataFrame([(bytearray(k),) for k in keys], "key binary"))
        prefix, k0, k1 = h.halves(let, F.col("key"))
        rows = let.result(prefix=prefix, k0=k0, k1=k1).collect()
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")
    for r in rows:
        assert (r.prefix, r.k0, r.k1) == tuple(map(m.signed, m.split_key(bytes(r.key))))
    short = h.Let(spark.createDataFrame([(None,), (bytearray(),), (bytearray(b"123456789"),)], "key binary"))
    assert short.result(**dict(zip("pab", h.halves(short, F.col("key"))))).count() == 3
