"""All payload and fingerprint sizes, damaged files, large-index plans, builders and single keys."""

import threading

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom import cli, errors
from keyloom.functions import geometry as g
from keyloom.functions import hashing as h
from keyloom.functions import model as m
from keyloom.operators import bijection, index, packed, ptrhash
from keyloom.operators.build import BIJECTION, PTRHASH, build
from keyloom.operators.builder import Builder
from keyloom.plans import routing, validate
from keyloom.session import checkpoint
from keyloom.sources import codec, entry_files, files

BOTH = pytest.mark.parametrize("algorithm", [BIJECTION, PTRHASH])
MODULES = {BIJECTION: bijection, PTRHASH: ptrhash}


def random_keys(n, seed=0, length=24):
    raw = np.random.default_rng(seed).integers(0, 256, (n, length), np.uint8)
    return [r.tobytes() for r in raw]


def tables_without_spark(keys, payloads, how, blocks, fp_size, seed=g.DEFAULT_SEED):
    """What a build's tasks return, put together."""
    split = [m.split_key(k) for k in keys]
    block = np.array([m.fast_range(p, blocks) for p, _, _ in split])
    counts = np.bincount(block, minlength=blocks)
    before = np.cumsum(counts) - counts
    parts = []
    for b in range(blocks):
        at = np.flatnonzero(block == b)
        own = pa.table({"block_id": np.full(len(at), b), "k0": np.array([m.signed(split[i][1]) for i in at], np.int64), "k1": np.array([m.signed(split[i][2]) for i in at], np.int64), "payload": np.array([m.signed(payloads[i]) for i in at], np.int64)})
        parts.append(how.solver(seed, fp_size)(own, pa.table({"block_id": [b], "keys_before": [int(before[b])]})))
    solved = pa.concat_tables(parts)
    kind = solved.column("kind").to_numpy(zero_copy_only=False)
    pick = lambda k: solved.filter(pa.array(kind == k))
    named = {"entries": pick(0), "buckets": pick(1), "pilots": pick(1), "remap": pick(2)}
    return {**named, "blocks": pa.table({"block_id": np.arange(blocks), "keys_in_block": counts, "keys_before": before})}


@BOTH
def test_all_payload_and_fingerprint_sizes(algorithm):
    """9 payload sizes and 5 fingerprint sizes: ranks are one to one, payloads come back, strangers are told apart as often as they should be."""
    how, keys, strangers = MODULES[algorithm], random_keys(300), random_keys(4000, 9)
    for payload_size in range(9):
        rng = np.random.default_rng(payload_size)
        payloads = [int.from_bytes(rng.bytes(payload_size), "little") for _ in keys]
        for fp_size in range(5):
            meta = {"num_blocks": 3, "total_keys": len(keys), "payload_size": payload_size, "fp_size": fp_size, "global_seed": g.DEFAULT_SEED}
            p = packed.PackedIndex(meta, how, tables_without_spark(keys, payloads, how, 3, fp_size))
            rank, status = p.find(pa.array(keys, pa.binary()))
            assert sorted(rank.tolist()) == list(range(len(keys))) and (status == packed.OK).all()
            if payload_size:
                assert [int(x) & (1 << 64) - 1 for x in p.payload[rank]] == payloads
            if fp_size:
                _, status = p.find(pa.array(strangers, pa.binary()))
                assert (status == packed.OK).sum() <= 3 * len(strangers) / 256**fp_size + 2


@BOTH
@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 9, 5000])
def test_clustered_and_small(algorithm, n):
    """Prefixes near four places leave most blocks empty."""
    how = MODULES[algorithm]
    tails = random_keys(n, 4, 16)
    keys = [((i % 4 << 62) + i // 4).to_bytes(8, "big") + tails[i] for i in range(n)]
    blocks = how.num_blocks(n)
    meta = {"num_blocks": blocks, "total_keys": n, "payload_size": 0, "fp_size": 0, "global_seed": g.DEFAULT_SEED}
    try:
        tables = tables_without_spark(keys, [0] * n, how, blocks, 0)
    except IndexError:
        pytest.fail("a block came out empty")
    rank, status = packed.PackedIndex(meta, how, tables).find(pa.array(keys, pa.binary()))
    assert sorted(rank.tolist()) == list(range(n)) and (status == packed.OK).all()


def test_keys_that_differ_in_the_last_byte():
    for how in (bijection, ptrhash):
        keys = [bytes(15) + bytes([i]) for i in (1, 2)]
        tables = tables_without_spark(keys, [0, 0], how, 2, 0)
        assert tables["entries"].num_rows == 2


def test_pilots_are_placed_as_they_say():
    rng = np.random.default_rng(5)
    for n in (3, 900, 31_600):
        k0, k1 = rng.integers(0, (1 << 64) - 1, (2, n), dtype=np.uint64)
        state = ptrhash._Block(k0, k1, g.DEFAULT_SEED, g.PILOT_BUCKETS)
        pilots, owner = state.solve(np.random.Generator(np.random.PCG64([1, 0])))
        for b in np.flatnonzero(state.size):
            own = state.slots[state.first[b] : state.first[b + 1], pilots[b]]
            assert (owner[own] == b).all() and len(set(own.tolist())) == state.size[b]
        assert (owner >= 0).sum() == n


@pytest.fixture(scope="module")
def keyed(spark):
    keys = random_keys(4000, 3)
    return spark.createDataFrame(pa.table({"key": pa.array(keys, pa.binary()), "value": np.arange(4000), "i": np.arange(4000)}))


@BOTH
def test_flipped_bytes(spark, keyed, tmp_path, algorithm):
    """One changed bit anywhere: an error of this library or, outside the checksums (header, metadata of the user, directory), at most another index."""
    path = f"{tmp_path}/i.bin"
    codec.export_file(build(keyed, payload="value", payload_size=2, fingerprint_size=1, algorithm=algorithm, metadata=b"mine"), path)
    raw = open(path, "rb").read()
    p = codec.Parsed(raw)
    rng = np.random.default_rng(7)
    for at in [*range(0, p.entries_at, 7), *rng.integers(p.entries_at, len(raw), 300).tolist()]:
        changed = raw[:at] + bytes([raw[at] ^ (1 << int(rng.integers(8)))]) + raw[at + 1 :]
        try:
            codec.Parsed(changed).verify()
            fine = True
        except errors.KeyloomError:
            fine = False
        if p.entries_at <= at < len(raw) - 16:
            assert not fine
    for cut in range(0, len(raw), 97):
        with pytest.raises(errors.KeyloomError):
            codec.Parsed(raw[:cut]).verify()


@BOTH
def test_file_is_read_by_ranges(spark, keyed, tmp_path, monkeypatch, algorithm):
    path = f"file://{tmp_path}/i.bin"
    index_ = build(keyed, payload="value", payload_size=3, fingerprint_size=2, algorithm=algorithm)
    codec.export_file(index_, path)
    monkeypatch.setattr(codec, "GROUP", 3000)
    assert len(codec.Parsed(path).groups()) > 1 or algorithm == PTRHASH
    again = codec.open_file(spark, path, verify=True)
    wrong = again.query_payload(keyed).where("status <> 'OK' or payload <> value").count()
    assert wrong == 0
    for name, table in index_.tables.items():
        columns = again.tables[name].columns
        assert sorted(map(tuple, again.tables[name].collect()))[:500] == sorted(map(tuple, table.select(*columns).collect()))[:500]


@BOTH
def test_large_indexes_are_joined(spark, keyed, monkeypatch, algorithm):
    """What is joined beyond PACK_BYTES answers as what is broadcast below it; no plan has more than four exchanges."""
    small = build(keyed, payload="value", payload_size=2, fingerprint_size=2, algorithm=algorithm)
    probe = keyed.select("key", "i").unionByName(spark.createDataFrame([(bytearray(random_keys(1, 77)[0]), -1), (bytearray(b"short"), -2), (None, -3), (bytearray(70_000), -4)], "key binary, i long"))
    want = sorted(map(tuple, small.query_payload(probe).select("i", "rank", "payload", "status").collect()))
    monkeypatch.setattr(index, "PACK_BYTES", 0)
    large = index.Index(spark, small.meta, small.tables)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = large.query_payload(probe).select("i", "rank", "payload", "status")
        assert sorted(map(tuple, found.collect())) == want
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") <= (4 if algorithm == BIJECTION else 6)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    keys = [bytes(r.key) for r in keyed.limit(3).collect()]
    assert [large.rank_of(k) for k in keys] == [small.rank_of(k) for k in keys]
    assert [large.payload_of(k) for k in keys] == [small.payload_of(k) for k in keys]
    with pytest.raises(errors.NotFound):
        large.rank_of(random_keys(1, 78)[0])
    with pytest.raises(errors.KeyTooLong):
        small.rank_of(bytes(70_000))


@BOTH
def test_what_the_driver_collects(spark, keyed, monkeypatch, algorithm):
    """A small index comes to the driver in about the bytes that its arrays take."""
    sent, kind, to_arrow = [], type(keyed), type(keyed).toArrow
    own = build(keyed, payload="value", payload_size=2, fingerprint_size=4, algorithm=algorithm)
    monkeypatch.setattr(kind, "toArrow", lambda df: sent.append(to_arrow(df)) or sent[-1])
    held = own.packed()
    assert sum(t.nbytes for t in sent) < 1.25 * packed.bytes_of(own.meta, MODULES[algorithm])
    assert sorted(held.payload.tolist()) == list(range(4000))


def test_runs_in_any_order():
    """Rows of one block from several batches and out of order, with positions that only another run has."""
    how, keys = bijection, random_keys(3000, 5)
    meta = {"num_blocks": 2, "total_keys": len(keys), "payload_size": 2, "fp_size": 1, "global_seed": g.DEFAULT_SEED}
    tables = tables_without_spark(keys, range(3000), how, 2, 1)
    mixed = {n: t.take(np.random.default_rng(1).permutation(t.num_rows)) for n, t in tables.items()}
    kinds = list(how.PARTS[0][2].values())
    pieces = [mixed["buckets"].slice(i, 100) for i in range(0, mixed["buckets"].num_rows, 100)]
    cuts = [packed.cut(1, kinds, *(p.column(c).to_numpy() for c in ("block_id", "bucket_id")), [p.column(c).to_numpy() for c in how.PARTS[0][2]]) for p in pieces]
    entries = packed.cut(2, ["<u4", "<i8"], *(mixed["entries"].column(c).to_numpy() for c in ("block_id", "rank")), [mixed["entries"].column(c).to_numpy() for c in ("fp", "payload")])
    whole = pa.RecordBatch.from_pydict({"block_id": [1, 0], "part": [0, 0], "start": tables["blocks"].column("keys_before").to_pylist()[::-1], "n": tables["blocks"].column("keys_in_block").to_pylist()[::-1], "data": pa.nulls(2, pa.binary())})
    p = packed.PackedIndex.of_runs(meta, how, [*cuts, entries, whole])
    rank, status = p.find(pa.array(keys, pa.binary()))
    assert (status == packed.OK).all() and p.payload[rank].tolist() == list(range(3000))


@BOTH
def test_large_lookups_shuffle_once(spark, keyed, monkeypatch, algorithm):
    """A probe of an index beyond PACK_BYTES is shuffled once, whatever blocks a task holds; rows that Arrow doesn't have are joined."""
    probe = keyed.selectExpr("key", "i", "if(i % 9 = 0, null, array(i)) as own").unionByName(keyed.limit(50).selectExpr("substring(key, 1, 9) as key", "-i as i", "null as own")).unionByName(spark.range(300).selectExpr("encode(md5(string(id)), 'utf-8') as key", "-id as i", "null as own"))
    texts = probe.selectExpr("hex(key) as rank", "i")
    small = build(keyed, payload="value", payload_size=2, fingerprint_size=4, algorithm=algorithm)
    want = sorted(map(repr, small.query_payload(probe).collect())), sorted(map(repr, small.query_payload(texts, "rank").collect()))
    monkeypatch.setattr(index, "PACK_BYTES", 0)
    monkeypatch.setattr(index, "HELD_KEYS", 1)
    large = index.Index(spark, small.meta, small.tables)
    for task_bytes in (1, 1 << 20):
        monkeypatch.setattr(index, "TASK_BYTES", task_bytes)
        found = large.query_payload(probe)
        assert sorted(map(repr, found.collect())) == want[0]
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.split("== Initial Plan ==")[-1].count("Exchange ") == 1 and "Join" not in plan
        assert sorted(map(repr, large.query_payload(texts, "rank").collect())) == want[1]
    odd = probe.withColumn("own", F.expr("make_interval(1)"))
    assert large.query_payload(odd).where("status = 'OK' and own is not null").count() == 4000


def test_keys_are_read_once(spark, monkeypatch):
    """A build reads each half of a key's digits once and a large lookup the first half once, and its probe carries no fields of runs."""
    plans, keyed = [], spark.range(4000).select(h.key_bytes("id").alias("key"), F.col("id").alias("value"))

    def kept(df):
        plans.append(df)
        return checkpoint(df)

    monkeypatch.setattr("keyloom.operators.build.checkpoint", kept)
    small = build(keyed, payload="value", payload_size=2, fingerprint_size=1)
    readings = lambda df: df._jdf.queryExecution().executedPlan().toString().count("conv(")
    assert readings(plans[0]) == 2
    monkeypatch.setattr(index, "PACK_BYTES", 0)
    found = index.Index(spark, small.meta, small.tables).query_payload(keyed)
    assert readings(found) == 1
    assert "struct(" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.where("status = 'OK' and payload = value").count() == 4000


def test_totals_by_both_plans(spark, keyed, monkeypatch):
    routed = keyed.withColumn("block_id", F.pmod(F.xxhash64("i"), F.lit(50)))
    df, largest = routing.totals(routed, 60)
    local = sorted(map(tuple, df.collect()))
    assert largest == max(n for _, n, _ in local)
    monkeypatch.setattr(routing, "LOCAL_BLOCKS", 0)
    df, again = routing.totals(routed, 60)
    assert sorted(map(tuple, df.collect())) == local and len(local) == 60 and again == largest


def test_unsorted_over_ranges(spark):
    rng = np.random.default_rng(2)
    blocks = rng.integers(0, 5, 3000).tolist()
    df = spark.createDataFrame(list(enumerate(blocks)), "at long, block_id long").repartition(8)
    want = [(i, blocks[i - 1]) for i in range(1, 3000) if blocks[i - 1] > blocks[i]]
    got = sorted((r.at, r.previous_block) for r in validate.unsorted(df, "at").collect())
    assert got == want
    assert validate.unsorted(df.limit(0), "at").count() == 0


def test_interrupted_and_repeated_saves(spark, keyed, tmp_path):
    path = f"file://{tmp_path}/i"
    build(keyed, payload="value", payload_size=2).save(path)
    first = index.open_index(spark, path)
    # tables of a save that never came to its end don't matter
    spark.range(5).write.parquet(f"{path}/data-broken/entries")
    assert index.open_index(spark, path).query_payload(keyed).where("payload = value").count() == 4000
    first.save(path)  # onto itself
    again = index.open_index(spark, path)
    again.verify()
    assert again.stats().first().bits_per_key == build(keyed, payload="value", payload_size=2).stats().first().bits_per_key
    assert len(list((tmp_path / "i").glob("data-*"))) == 1


# builders


@BOTH
def test_builder(spark, algorithm):
    keys = random_keys(700, 8)
    with Builder(spark, 700, payload_size=2, fingerprint_size=1, algorithm=algorithm) as b:
        for i, k in enumerate(keys):
            b.add_key(k, i)
        made = b.finish()
    assert [made.payload_of(k) for k in keys[:50]] == list(range(50))
    with pytest.raises(errors.BuilderClosed):
        b.add_key(keys[0])
    with pytest.raises(errors.BuilderClosed):
        b.finish()
    by_writers = Builder(spark, payload_size=2, fingerprint_size=1, algorithm=algorithm).add_keys(4, lambda n, add: [add(k, i) for i, k in enumerate(keys) if i % 4 == n])
    if algorithm == BIJECTION:
        assert [by_writers.rank_of(k) for k in keys] == [made.rank_of(k) for k in keys]


def test_builder_faults(spark, monkeypatch):
    keys = sorted(random_keys(40, 2))
    with Builder(spark, 40, ordered=True) as b:
        for k in keys:
            b.add_key(k)
        assert b.finish().num_keys == 40
    with Builder(spark, payload_size=1) as b:
        for key, payload, error in ((b"short", 0, errors.KeyTooShort), (bytes(70_000), 0, errors.KeyTooLong), (bytes(16), 256, errors.PayloadOverflow), (bytes(16), -1, errors.PayloadOverflow)):
            with pytest.raises(error):
                b.add_key(key, payload)
        with pytest.raises(errors.EmptyIndex):
            b.finish()
    with pytest.raises(errors.EmptyIndex):
        Builder(spark, 0)
    with pytest.raises(ValueError):
        Builder(spark, ordered=True)
    with Builder(spark) as b, pytest.raises(ValueError):
        b.add_keys(0, lambda n, add: None)
    with Builder(spark, 3) as b:
        b.add_key(keys[0])
        with pytest.raises(errors.KeyCountMismatch):
            b.finish()
    with Builder(spark) as b:
        b.add_key(keys[0])
        b.add_key(keys[0])
        with pytest.raises(errors.DuplicateKey):
            b.finish()
    with Builder(spark) as b, pytest.raises(errors.KeyTooShort):
        b.add_keys(2, lambda n, add: add(b"short"))


def test_a_running_build_is_cancelled(spark):
    b = Builder(spark)

    @F.udf("binary")
    def slow(i):
        import time

        time.sleep(0.05)
        return i.to_bytes(16, "big")

    def late():
        b.cancel()

    b.add_key(bytes(16))
    timer = threading.Timer(1.0, late)
    b._write([(k, 0) for k in random_keys(50)])
    original = b.spark.read
    timer.start()
    import keyloom.operators.builder as module

    real = module.build
    module.build = lambda keys, **options: real(spark.range(4000).repartition(4).select(slow("id").alias("key")), **options)
    try:
        with pytest.raises(errors.Cancelled):
            b.finish()
    finally:
        module.build = real
        timer.cancel()
    assert original is not None


def test_files(tmp_path):
    path = f"file://{tmp_path}/a/x-1.bin"
    files.write_file(path, [b"abc", b"", b"def"])
    assert files.size_of(path) == 6 and files.read_range(path, 2, 99) == b"cdef" and files.read_range(f"{tmp_path}/a/x-1.bin", 4, 2) == b""
    files.write_file(f"{tmp_path}/a/x-2.bin", [b""])
    assert files.matching(f"{tmp_path}/a/x-*.bin") == [f"{tmp_path}/a/x-1.bin", f"{tmp_path}/a/x-2.bin"] and files.matching(f"{tmp_path}/none/*.bin") == []
    with pytest.raises(FileNotFoundError):
        files.size_of(f"{tmp_path}/none")


def test_bench_files(spark, tmp_path, capsys):
    cli.main(["gen", "--dir", str(tmp_path), "--keys", "600", "--files", "3", "--sorted"])
    for more in ([], ["--sorted", "--workers", "3"]):
        cli.main(["bench-files", "--dir", str(tmp_path), "--queries", "100", *more])
    lines = [x for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert '"entries": 600' in lines[0] and all('"keys": 600' in x and '"found": 100' in x for x in lines[1:])
    assert entry_files.total_entries(files.matching(f"{tmp_path}/*.bin")) == 600


def test_expressions_and_kernels_split_keys_alike(spark, keyed):
    from keyloom.functions import kernels

    rows = keyed.select("key", h.prefix(F.col("key")).alias("p"), h.k0(F.col("key")).alias("a"), h.k1(F.col("key")).alias("b")).limit(50).collect()
    n, p, a, b = kernels.key_halves(pa.array([bytes(r.key) for r in rows] + [None, b"x"], pa.binary())[0:52])
    assert n.tolist() == [24] * 50 + [-1, 1]
    assert [m.signed(int(x)) for x in p[:50]] == [r.p for r in rows] and [m.signed(int(x)) for x in a[:50]] == [r.a for r in rows] and [m.signed(int(x)) for x in b[:50]] == [r.b for r in rows]
    assert isinstance(keyed.schema["key"].dataType, T.BinaryType)
