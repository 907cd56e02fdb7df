"""Builds, lookups, errors, storage and streams, for both algorithms."""

import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keyloom import errors
from keyloom.functions import geometry as g
from keyloom.functions import hashing as h
from keyloom.functions import model as m
from keyloom.operators import bijection, ptrhash
from keyloom.operators.build import BIJECTION, PTRHASH, build
from keyloom.operators.index import get_stats, open_index, open_payload
from keyloom.plans import routing, validate
from keyloom.sources import codec, entry_files
from keyloom.streaming import ingest

BOTH = pytest.mark.parametrize("algorithm", [BIJECTION, PTRHASH])


def keyed(spark, n, seed=0, length=16, payload_bits=8):
    rng = random.Random(seed)
    rows = [(bytearray(rng.randbytes(length)), rng.getrandbits(payload_bits), i) for i in range(n)]
    return spark.createDataFrame(pa.table({"key": pa.array([bytes(k) for k, _, _ in rows], pa.binary()), "value": [v for _, v, _ in rows], "i": [i for _, _, i in rows]}))


def check_ranks(index, df, n):
    r = index.lookup(df).agg(F.count("rank").alias("n"), F.count_distinct("rank").alias("d"), F.min("rank").alias("a"), F.max("rank").alias("b")).first()
    assert (r.n, r.d, r.a, r.b) == (n, n, 0, n - 1)


@BOTH
@pytest.mark.parametrize("n", [1, 2, 3, 8, 9, 100])
def test_small(spark, algorithm, n):
    df = keyed(spark, n)
    check_ranks(build(df, algorithm=algorithm), df, n)


@BOTH
@pytest.mark.parametrize("payload_size,fp_size,length", [(0, 0, 16), (4, 1, 24), (2, 4, 17), (8, 0, 20)])
def test_modes(spark, algorithm, payload_size, fp_size, length):
    df = keyed(spark, 3000, seed=length, length=length, payload_bits=15)
    index = build(df, payload="value", payload_size=payload_size, fingerprint_size=fp_size, algorithm=algorithm)
    check_ranks(index, df, 3000)
    if payload_size:
        wrong = index.query_payload(df).where("status <> 'OK' or payload <> value").count()
        assert wrong == 0
    else:
        with pytest.raises(errors.NoPayload):
            index.query_payload(df)
    if fp_size:
        others = keyed(spark, 2000, seed=999, length=length)
        assert index.members(others).count() <= 2000 * 3 / 256**fp_size + 2
        assert index.non_members(df).count() == 0


def test_bijection_is_the_model_and_free_of_partitions(spark):
    df = keyed(spark, 4000, seed=5)
    want = None
    for parts in (1, 5):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        got = {bytes(r.key): r.rank for r in build(df.orderBy(F.rand(parts))).lookup(df).select("key", "rank").collect()}
        assert want is None or got == want
        want = got
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    # plain-integer model of one block
    blocks = bijection.num_blocks(4000)
    buckets: dict[tuple[int, int], list] = {}
    for key in want:
        prefix, k0, k1 = m.split_key(key)
        buckets.setdefault((m.fast_range(prefix, blocks), m.fast_range(k0, 1024)), []).append((k0, k1, key))
    base = 0
    for at in sorted(buckets):
        own, n = buckets[at], len(buckets[at])
        slots = lambda seed, part, size: [m.mixed_slot(a, b, g.DEFAULT_SEED, seed, size) for a, b, _ in part]
        if n < 8:
            seed = next(s for s in range(1 << 21) if len(set(slots(s, own, n))) == n)
            placed = dict(zip((k for _, _, k in own), slots(seed, own, n)))
        else:
            half = n // 2
            seed = next(s for s in range(1 << 20) if sum(x < half for x in slots(s, own, n)) == half == len({x for x in slots(s, own, n) if x < half}))
            first = slots(seed, own, n)
            rest = [o for o, x in zip(own, first) if x >= half]
            seed1 = next(s for s in range(1 << 21) if len(set(slots(s, rest, n - half))) == n - half)
            placed = {o[2]: x for o, x in zip(own, first) if x < half} | {o[2]: half + x for o, x in zip(rest, slots(seed1, rest, n - half))}
        for key, slot in placed.items():
            assert want[key] == base + slot
        base += n


def test_pilot_block_fills_every_slot():
    import numpy as np

    rng = np.random.default_rng(3)
    for n in (1, 2, 50, 5000, 33_000):
        k0, k1 = (rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) for _ in range(2))
        _, _, slot, error = ptrhash.solve(k0, k1, 1, g.DEFAULT_SEED)
        assert error is None and sorted(slot.tolist()) == list(range(n))


@BOTH
def test_faults(spark, algorithm):
    df = keyed(spark, 20)
    doubled = df.unionByName(df.limit(1))
    with pytest.raises(errors.DuplicateKey):
        build(doubled, algorithm=algorithm)
    with pytest.raises(errors.EmptyIndex):
        build(df.limit(0), algorithm=algorithm)
    with pytest.raises(errors.KeyTooShort):
        build(df.withColumn("key", F.substring("key", 1, 15)), algorithm=algorithm)
    with pytest.raises(errors.KeyTooShort):
        build(df.withColumn("key", F.lit(None).cast("binary")), algorithm=algorithm)
    with pytest.raises(errors.PayloadOverflow):
        build(df.withColumn("value", F.lit(256)), payload="value", payload_size=1, algorithm=algorithm)
    with pytest.raises(errors.KeyCountMismatch):
        build(df, total_keys=21, algorithm=algorithm)
    with pytest.raises(errors.PayloadTooLarge):
        build(df, payload_size=9, algorithm=algorithm)
    with pytest.raises(errors.FingerprintTooLarge):
        build(df, fingerprint_size=5, algorithm=algorithm)
    index = build(df, algorithm=algorithm)
    index.close()
    index.close()
    with pytest.raises(errors.IndexClosed):
        index.lookup(df)
    with pytest.raises(errors.CorruptedIndex):
        build(df, algorithm=algorithm).verify()


def test_more_faults(spark):
    df = keyed(spark, 200)
    with pytest.raises(errors.UnknownAlgorithm):
        build(df, algorithm="other")
    with pytest.raises(errors.KeyTooLong):
        build(df.limit(2).withColumn("key", F.encode(F.repeat(F.hex("key"), 4000), "utf-8")))
    with pytest.raises(errors.UnsortedInput):
        build(df, sorted_by="i")
    ordered = df.withColumn("i", F.hex("key"))
    check_ranks(build(ordered, sorted_by="i"), df, 200)
    with pytest.raises(errors.BlockOverflow):
        build(spark.range(5000).select(F.encode(F.lpad(F.col("id").cast("string"), 16, "0"), "utf-8").alias("key")))
    with pytest.raises(errors.TooManyKeys):
        validate.check_options((1 << 40) + 1, 0, 0)


def test_statuses_and_clashing_columns(spark):
    df = keyed(spark, 50)
    index = build(df, payload="value", payload_size=1, fingerprint_size=4)
    probe = df.select("key", F.lit("x").alias("rank"), F.lit(1).alias("block_id"), F.lit(2).alias("bucket_id"), F.lit(3).alias("fp"), F.lit(4).alias("k0"))
    found = index.query_payload(probe)
    assert found.columns == ["key", "block_id", "bucket_id", "fp", "k0", "rank", "payload", "status"]
    assert found.where("status = 'OK' and block_id = 1 and bucket_id = 2 and fp = 3 and k0 = 4").count() == 50
    odd = spark.createDataFrame([(None,), (bytearray(b"short"),), (bytearray(70000),), (bytearray(20),)], "key binary")
    assert sorted(r.status for r in index.lookup(odd).collect()) == ["KEY_TOO_LONG", "KEY_TOO_SHORT", "KEY_TOO_SHORT", "NOT_FOUND"]
    assert index.lookup(odd.limit(0)).count() == 0


@BOTH
def test_save_open_verify(spark, tmp_path, algorithm):
    df = keyed(spark, 2500, payload_bits=30)
    path = f"file://{tmp_path}/index"
    build(df, payload="value", payload_size=4, fingerprint_size=2, algorithm=algorithm, metadata=b"mine").save(path)
    index = open_payload(spark, path)
    index.verify()
    assert (index.user_metadata, index.num_keys, index.payload_size) == (b"mine", 2500, 4)
    assert index.query_payload(df).where("payload = value").count() == 2500
    stats = get_stats(spark, path).first()
    assert stats.num_keys == 2500 and stats.algorithm == algorithm and stats.index_size > 2500 * 6
    index.tables["entries"].withColumn("payload", F.when(F.col("rank") == 7, F.col("payload").bitwiseXOR(F.lit(1))).otherwise(F.col("payload"))).write.parquet(f"{path}/damaged")
    index.tables["entries"] = spark.read.parquet(f"{path}/damaged")
    with pytest.raises(errors.ChecksumFailed):
        index.verify()
    with pytest.raises(errors.TruncatedFile):
        open_index(spark, f"file://{tmp_path}/none")


@BOTH
@pytest.mark.parametrize("n", [3, 6000])
def test_binary_form(spark, tmp_path, algorithm, n):
    df = keyed(spark, n, seed=n, payload_bits=16)
    index = build(df, payload="value", payload_size=2, fingerprint_size=1, algorithm=algorithm, metadata=b"abc")
    path = f"{tmp_path}/index.bin"
    codec.export_file(index, path)
    raw = open(path, "rb").read()
    again = codec.open_bytes(spark, raw, verify=True)
    ranks = index.lookup(df).select("i", F.col("rank").alias("before"))
    assert again.query_payload(df).join(ranks, "i").where("rank = before and payload = value").count() == n
    assert again.user_metadata == b"abc"
    assert index.stats().first().index_size == os.path.getsize(path)
    codec.export_file(again, f"{path}2")
    assert open(f"{path}2", "rb").read() == raw
    for change, error in (
        (lambda b: b"\0" + b[1:], errors.InvalidMagic),
        (lambda b: b[:4] + b"\7" + b[5:], errors.InvalidVersion),
        (lambda b: b[:30], errors.TruncatedFile),
        (lambda b: b[:22] + b"\x20" + b[23:], errors.CorruptedIndex),
        (lambda b: b[:-200] + bytes([b[-200] ^ 1]) + b[-199:], errors.ChecksumFailed),
    ):
        with pytest.raises(error):
            codec.Parsed(change(raw)).verify()


def test_codec_parts():
    import numpy as np

    rng = np.random.default_rng(1)
    assert [codec.low_width(1024, u) for u in (1024, 2048, 3072, 10000, 65535)] == [0, 1, 1, 3, 5]
    for top in (0, 1, 700, 3072, 9000):
        values = np.sort(rng.integers(0, top + 1, 1024))
        values[-1] = top
        raw = codec.encode_monotone(values, top)
        assert len(raw) == codec.monotone_size(1024, top)
        assert codec.decode_monotone(raw, 1024, top).tolist() == values.tolist()
    empty = codec.encode_bijection_block(*[np.zeros(0, np.int64)] * 4)
    assert len(empty) == 157
    # seeds beyond their code's reach go to the list
    ids, size = np.array([0, 5, 300, 1023]), np.array([2, 7, 9, 21])
    seed0, seed1 = np.array([31, 2048, 300, 77]), np.array([0, 0, 5000, 1_000_000])
    back = codec.decode_bijection_block(codec.encode_bijection_block(ids, size, seed0, seed1), int(size.sum()))
    assert [back[c].tolist() for c in ("bucket_id", "size", "seed0", "seed1")] == [ids.tolist(), size.tolist(), seed0.tolist(), seed1.tolist()]


def test_bits_per_key(spark):
    df = keyed(spark, 20_000)
    assert 2.0 < build(df).stats().first().bits_per_key < 6.0


def test_routing(spark):
    counts = spark.createDataFrame([(i, i % 7) for i in range(9000)], "block_id long, n long")
    got = {r.block_id: r.keys_before for r in routing.keys_before(counts).collect()}
    total = 0
    for i in range(9000):
        assert got[i] == total
        total += i % 7
    df = keyed(spark, 500)
    whole = [bytes(r.key) for r in routing.merged(df.where("i % 2 = 0"), df.where("i % 2 = 1")).collect()]
    assert whole == sorted(whole) and len(whole) == 500


def test_entry_files(spark, tmp_path):
    made = entry_files.synthetic(spark, 1000)
    files = entry_files.write_entries(made, f"{tmp_path}/e", 3, ordered=True).collect()
    assert entry_files.total_entries([f.path for f in files]) == 1000
    back = entry_files.read_entries(spark, f"{tmp_path}/e/*.bin", chunk=100)
    assert back.rdd.getNumPartitions() >= 10
    assert sorted((bytes(r.key), r.payload) for r in back.collect()) == sorted((bytes(r.key), r.payload) for r in made.collect())
    bad = tmp_path / "bad.bin"
    bad.write_bytes((5).to_bytes(8, "little"))
    with pytest.raises(errors.TruncatedFile):
        entry_files.file_count(str(bad))


def test_streams(spark, tmp_path):
    df = keyed(spark, 300)
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    ingest.stage(stream, f"{tmp_path}/staging", f"{tmp_path}/c1").awaitTermination()
    index = ingest.finish(spark, f"{tmp_path}/staging", total_keys=300, payload="value", payload_size=1, fingerprint_size=1)
    ingest.stage(ingest.probe(stream, index, payload=True), f"{tmp_path}/out", f"{tmp_path}/c2").awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.where("status = 'OK' and payload = value").count() == 300
    with pytest.raises(errors.KeyCountMismatch):
        ingest.finish(spark, f"{tmp_path}/staging", total_keys=301)


def test_mixed_expression_matches_kernel(spark):
    import numpy as np

    df = keyed(spark, 200)
    let = h.Let(df)
    a, b = let(h.k0(F.col("key")), h.k1(F.col("key")))
    rows = let.result(a=a, b=b, s=h.mixed_slot(let, a, b, 5, F.lit(9).cast("long"), F.lit(7))).collect()
    k0, k1 = (np.array([getattr(r, c) for r in rows]).view(np.uint64) for c in "ab")
    size, seed = np.full(200, 7), np.full(200, 9)
    assert bijection.slots_of(k0, k1, 5, size, seed, seed * 0).tolist() == [r.s for r in rows]
