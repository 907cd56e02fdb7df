"""Queries over the test tables for every operator, and the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyloom.functions import geometry as g
from keyloom.functions import hashing as h
from keyloom.functions.model import FINGERPRINT_FACTOR, pilot_hash
from keyloom import errors
from keyloom.operators import bijection, ptrhash
from keyloom.operators.build import algorithm_of, build
from keyloom.operators.builder import Builder
from keyloom.operators.index import get_stats, open_index, open_payload
from keyloom.plans import routing, validate
from keyloom.session import ensure_checkpoint_dir, table
from keyloom.sources import codec, entry_files, files
from keyloom.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
SEED = g.DEFAULT_SEED


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLES[name or f.__name__] = sql
        return f

    return register


# SQL of the hash algebra: h is the key in 32 hexadecimal digits


def _wide(digits: str) -> str:
    return f"('0x' || {digits})::UBIGINT::UHUGEINT"


def _le(first: int) -> str:
    return _wide("(" + " || ".join(f"substr(h, {first + 14 - 2 * i}, 2)" for i in range(8)) + ")")


TWO64 = "18446744073709551616::UHUGEINT"
PREFIX, K0, K1 = _wide("substr(h, 1, 16)"), _le(1), _le(17)


def _range(x: str, n: object) -> str:
    return f"((({x}) * ({n})::UHUGEINT) >> 64)"


def _md5(column: str) -> str:
    return f"md5(CAST({column} AS VARCHAR))"


def _xor(a: str, b: str) -> str:
    return f"xor(({a})::UBIGINT, ({b})::UBIGINT)"


def _keyed(column: str, source: str, more: str = "") -> str:
    return f"(SELECT {column}{more}, {_md5(column)} AS h FROM {source})"


def _bijection_blocks(source: str) -> str:
    return f"(SELECT greatest(2, ceil(ceil(count(*) / 3.0) / 1024)::BIGINT) FROM {source})"


def _routed(spark: SparkSession, sf_dir: str, name: str, column: str) -> tuple[DataFrame, int]:
    keys = table(spark, sf_dir, name).select(column)
    blocks = g.bijection_blocks(keys.count())
    return routing.route(keys, h.key_bytes(column), blocks), blocks


BLOCK_SQL = f"{_range(PREFIX, _bijection_blocks('orders'))}::BIGINT"


@query(f"SELECT o_orderkey, {BLOCK_SQL} AS block_id FROM {_keyed('o_orderkey', 'orders')}")
def route_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routed(spark, sf_dir, "orders", "o_orderkey")[0].select("o_orderkey", "block_id")


@query("SELECT o_orderkey, substr(h, 1, 16) AS prefix, " + ", ".join(f"({' || '.join(f'substr(h, {first + 14 - 2 * i}, 2)' for i in range(8))}) AS {name}" for name, first in (("k0", 1), ("k1", 17))) + f" FROM {_keyed('o_orderkey', 'orders')}")
def key_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = h.key_bytes("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", h.as_hex(h.prefix(key)).alias("prefix"), h.as_hex(h.k0(key)).alias("k0"), h.as_hex(h.k1(key)).alias("k1"))


COUNTS_SQL = f"SELECT b.range AS block_id, count(h) AS n FROM range({_bijection_blocks('orders')}) b LEFT JOIN {_keyed('o_orderkey', 'orders')} ON {BLOCK_SQL} = b.range GROUP BY b.range"


@query(COUNTS_SQL)
def block_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.block_counts(*_routed(spark, sf_dir, "orders", "o_orderkey"))


@query(f"SELECT block_id, n AS keys_in_block, (sum(n) OVER (ORDER BY block_id) - n)::BIGINT AS keys_before FROM ({COUNTS_SQL})")
def keys_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.keys_before(block_histogram(spark, sf_dir))


BUCKET_SQL = f"{_range(K0, g.BIJECTION_BUCKETS)}::BIGINT"


def _bucketed(spark: SparkSession, sf_dir: str, name: str, column: str) -> DataFrame:
    return _routed(spark, sf_dir, name, column)[0].withColumn("bucket_id", bijection.bucket(F.col("k0"), F.col("k1")))


@query(f"SELECT o_orderkey, {BLOCK_SQL} AS block_id, {BUCKET_SQL} AS bucket_id FROM {_keyed('o_orderkey', 'orders')}")
def bijection_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bucketed(spark, sf_dir, "orders", "o_orderkey").select("o_orderkey", "block_id", "bucket_id")


@query(f"SELECT n AS bucket_size, count(*) AS n_buckets FROM (SELECT count(*) AS n FROM {_keyed('o_orderkey', 'orders')} GROUP BY {BLOCK_SQL}, {BUCKET_SQL}) GROUP BY n")
def bucket_size_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.bucket_counts(_bucketed(spark, sf_dir, "orders", "o_orderkey")).groupBy(F.col("n").alias("bucket_size")).agg(F.count(F.lit(1)).alias("n_buckets"))


@query(f"SELECT max(n) AS max_block, (SELECT max(n) FROM (SELECT count(*) AS n FROM {_keyed('o_orderkey', 'orders')} GROUP BY {BLOCK_SQL}, {BUCKET_SQL})) AS max_bucket, sum(n)::BIGINT AS total FROM ({COUNTS_SQL})")
def largest_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    buckets = routing.bucket_counts(_bucketed(spark, sf_dir, "orders", "o_orderkey")).withColumnRenamed("n", "m")
    by_block = buckets.groupBy("block_id").agg(F.sum("m").alias("n"), F.max("m").alias("m"))
    return by_block.agg(F.max("n").alias("max_block"), F.max("m").alias("max_bucket"), F.sum("n").alias("total"))


@query(
    f"SELECT block_id, bucket_id, n, (sum(n) OVER (PARTITION BY block_id ORDER BY bucket_id))::BIGINT AS cumulative FROM (SELECT {_range(PREFIX, _bijection_blocks('customer'))}::BIGINT AS block_id, {BUCKET_SQL} AS bucket_id, count(*) AS n FROM {_keyed('c_custkey', 'customer')} GROUP BY ALL)"
)
def bucket_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.cumulative(routing.bucket_counts(_bucketed(spark, sf_dir, "customer", "c_custkey")))


def _fingerprints(size: int) -> None:
    product = f"((({K1}) * {FINGERPRINT_FACTOR}::UHUGEINT) % {TWO64})"
    sql = f"SELECT o_orderkey, (({_xor(K0, product)} >> 32) & {(1 << (8 * size)) - 1})::BIGINT AS fp FROM {_keyed('o_orderkey', 'orders')}"

    @query(sql, f"fingerprints_{size}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = h.key_bytes("o_orderkey")
        let = h.Let(table(spark, sf_dir, "orders").select("o_orderkey"))
        return let.result(fp=h.fingerprint(let, h.k0(key), h.k1(key), size))


for _size in (1, 2, 3, 4):
    _fingerprints(_size)


def _wymix_sql(a: str, b: str) -> str:
    return _xor(f"(({a})::UHUGEINT * ({b})::UHUGEINT) >> 64", f"(({a})::UHUGEINT * ({b})::UHUGEINT) % {TWO64}")


def _mixed_sql(seed: str, size: str) -> str:
    a, b = _xor(_xor(K0, str(SEED)), seed), _xor(K1, str(SEED))
    return f"{_range(f'({_wymix_sql(a, b)})::UHUGEINT', size)}::BIGINT"


@query(f"SELECT p_partkey, {_mixed_sql('p_partkey', '5')} AS slot FROM {_keyed('p_partkey', 'part')}")
def wymix_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = h.key_bytes("p_partkey")
    let = h.Let(table(spark, sf_dir, "part").select("p_partkey"))
    return let.result(slot=h.mixed_slot(let, *let(h.k0(key), h.k1(key)), SEED, F.col("p_partkey").cast("long"), F.lit(5)))


@query(
    f"SELECT o_orderkey, {_range('(cubed // 256) * 255::UHUGEINT + x // 256', g.PILOT_BUCKETS)}::BIGINT AS bucket_id FROM (SELECT *, (squared * (x // 2 + 9223372036854775808::UHUGEINT)) >> 64 AS cubed FROM (SELECT *, (x * x) >> 64 AS squared FROM (SELECT o_orderkey, {K1} AS x FROM {_keyed('o_orderkey', 'orders')})))"
)
def cubic_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    let = h.Let(table(spark, sf_dir, "orders").select("o_orderkey"))
    return let.result(bucket_id=h.cubic_bucket(let, h.k1(h.key_bytes("o_orderkey")), g.PILOT_BUCKETS))


PILOT = 17
_FOLD = _xor("x", "x >> 32")


@query(
    f"SELECT p_partkey, {_range(f'(({_FOLD})::UHUGEINT * {pilot_hash(PILOT, SEED)}::UHUGEINT) % {TWO64}', '(SELECT greatest(ceil(count(*) / 0.99::DOUBLE)::BIGINT, count(*)) FROM part)')}::BIGINT AS slot FROM (SELECT p_partkey, {_xor(K0, K1)} AS x FROM {_keyed('p_partkey', 'part')})"
)
def pilot_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, key = table(spark, sf_dir, "part"), h.key_bytes("p_partkey")
    hashed = F.element_at(h.pilot_hashes(SEED), PILOT + 1)
    let = h.Let(part.select("p_partkey"))
    return let.result(slot=h.pilot_slot(let, h.folded(*let(h.k0(key), h.k1(key))), hashed, g.slots(part.count())))


# indexes


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", h.key_bytes("o_orderkey").alias("key"), F.col("o_custkey").alias("payload"))


def _exact_rank_sql() -> str:
    small = ", ".join(f"({n}, {m})" for n, m in ((1, 1), (2, 192), (3, 256), (4, 512), (5, 1024), (6, 2048), (7, 8192)))
    return f"""
        WITH keys AS (SELECT c_custkey, {K0} AS k0, {K1} AS k1, {_range(PREFIX, _bijection_blocks('customer'))}::BIGINT AS blk, {BUCKET_SQL} AS bkt FROM {_keyed('c_custkey', 'customer')}),
        buckets AS (SELECT blk, bkt, count(*) AS n FROM keys GROUP BY ALL),
        based AS (SELECT *, (sum(n) OVER (ORDER BY blk, bkt) - n)::BIGINT AS base FROM buckets),
        own AS (SELECT k.*, n, base, xor(k0::UBIGINT, {SEED}::UBIGINT) AS a, xor(k1::UBIGINT, {SEED}::UBIGINT) AS b FROM keys k JOIN based USING (blk, bkt)),
        limits(n, seeds) AS (VALUES {small}),
        direct AS (SELECT c_custkey, blk, bkt, n, base, s.range AS seed, {_slot_sql('s.range', 'n')} AS slot FROM own JOIN limits USING (n), range(8192) s WHERE n < 8 AND s.range < seeds),
        found AS (SELECT blk, bkt, min(seed) AS seed FROM (SELECT blk, bkt, seed FROM direct GROUP BY blk, bkt, n, seed HAVING count(DISTINCT slot) = n) GROUP BY blk, bkt),
        halves AS (SELECT c_custkey, blk, bkt, n, base, a, b, n // 2 AS half, s.range AS seed, {_slot_sql('s.range', 'n')} AS slot FROM own, range(8192) s WHERE n >= 8),
        found0 AS (SELECT blk, bkt, min(seed) AS seed FROM (SELECT blk, bkt, seed FROM halves GROUP BY blk, bkt, half, seed HAVING count(*) FILTER (slot < half) = half AND count(DISTINCT slot) FILTER (slot < half) = half) GROUP BY blk, bkt),
        split AS (SELECT h.* FROM halves h JOIN found0 USING (blk, bkt, seed)),
        rest AS (SELECT c_custkey, blk, bkt, n, base, half, s.range AS seed1, {_slot_sql('s.range', '(n - half)')} AS slot1 FROM split, range(16384) s WHERE slot >= half),
        found1 AS (SELECT blk, bkt, min(seed1) AS seed1 FROM (SELECT blk, bkt, seed1 FROM rest GROUP BY blk, bkt, n, half, seed1 HAVING count(DISTINCT slot1) = n - half) GROUP BY blk, bkt)
        SELECT c_custkey, base + slot AS rank FROM direct JOIN found USING (blk, bkt, seed)
        UNION ALL SELECT c_custkey, base + slot FROM split WHERE slot < half
        UNION ALL SELECT c_custkey, base + half + slot1 FROM rest JOIN found1 USING (blk, bkt, seed1)"""


def _slot_sql(seed: str, size: str) -> str:
    a = f"xor(a, ({seed})::UBIGINT)"
    return f"{_range(f'({_wymix_sql(a, chr(98))})::UHUGEINT', size)}::BIGINT"


@query(_exact_rank_sql())
def bijection_rank_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", h.key_bytes("c_custkey").alias("key"))
    return build(customers).lookup(customers).select("c_custkey", "rank")


CHECK_SQL = "SELECT count(*) AS n, count(DISTINCT o_orderkey) AS n_ranks, 0::BIGINT AS lowest, count(*) - 1 AS highest FROM orders"


def _mphf_check(algorithm: str) -> None:
    @query(CHECK_SQL, f"{algorithm}_mphf_check")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        orders = _orders(spark, sf_dir)
        ranks = build(orders, algorithm=algorithm).lookup(orders)
        return ranks.agg(F.count("rank").alias("n"), F.count_distinct("rank").alias("n_ranks"), F.min("rank").alias("lowest"), F.max("rank").alias("highest"))


def _payload_lookup(name: str, algorithm: str) -> None:
    @query("SELECT l_orderkey, l_linenumber, o_custkey AS payload FROM lineitem JOIN orders ON l_orderkey = o_orderkey", name)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        index = build(_orders(spark, sf_dir), payload="payload", payload_size=4, fingerprint_size=1, algorithm=algorithm)
        probe = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", h.key_bytes("l_orderkey").alias("key"))
        return index.query_payload(probe).where("status = 'OK'").select("l_orderkey", "l_linenumber", "payload")


for _name in ("bijection", "ptrhash"):
    _mphf_check(_name)
    _payload_lookup(f"payload_lookup_{_name[:3]}", _name)


@query("SELECT conv_id, turn, length(text)::BIGINT AS payload, 'OK' AS status FROM conversations")
def composite_key_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", h.key_bytes("conv_id", "turn").alias("key"), F.length("text").cast("long").alias("n"))
    return build(turns, payload="n", payload_size=3, fingerprint_size=2).query_payload(turns).select("conv_id", "turn", "payload", "status")


def _membership(name: str, member: bool, algorithm: str) -> None:
    @query(f"SELECT o_orderkey * 2 AS probe FROM orders WHERE (o_orderkey * 2) {'' if member else 'NOT'} IN (SELECT o_orderkey FROM orders)", name)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        orders = _orders(spark, sf_dir)
        index = build(orders, fingerprint_size=4, algorithm=algorithm)
        probe = orders.select((F.col("o_orderkey") * 2).alias("probe")).withColumn("key", h.key_bytes("probe"))
        return (index.members(probe) if member else index.non_members(probe)).select("probe")


_membership("membership_semi", True, "bijection")
_membership("membership_anti", False, "ptrhash")


@query("SELECT * FROM (VALUES (1, 10000::BIGINT, true), (2, 300000::BIGINT, true)) t(fp_size, probes, within_bound)")
def nonmember_fpr(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _orders(spark, sf_dir)
    rows = []
    for size, probes in ((1, 10_000), (2, 300_000)):
        probe = spark.range(probes).select(h.key_bytes(F.col("id") + 1_000_000_000).alias("key"))
        hits = build(orders, fingerprint_size=size).lookup(probe)
        rate = F.avg((F.col("status") == "OK").cast("double"))
        rows.append(hits.agg(F.count(F.lit(1)).alias("probes"), (rate <= 3 / 256**size).alias("within_bound")).select(F.lit(size).alias("fp_size"), "probes", "within_bound"))
    return rows[0].unionByName(rows[1])


@query(
    "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'KEY_TOO_SHORT' WHEN c_custkey % 3 = 1 THEN 'OK' ELSE 'NOT_FOUND' END AS status FROM customer"
)
def lookup_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", h.key_bytes("c_custkey").alias("key"))
    other = h.key_bytes(F.col("c_custkey") + 1_000_000_000)
    kind = F.col("c_custkey") % 3
    probe = customers.withColumn("key", F.when(kind == 1, F.col("key")).when(kind == 2, other).when(F.col("c_custkey") % 2 == 0, F.substring("key", 1, 15)))
    return build(customers, fingerprint_size=4).lookup(probe).select("c_custkey", "status")


# validation


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.duplicates(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query("SELECT md5(text) AS text_key, count(*) AS n FROM documents GROUP BY ALL HAVING count(*) > 1")
def duplicate_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.duplicates(table(spark, sf_dir, "documents").select(F.md5(F.encode("text", "utf-8")).alias("text_key")), "text_key")


@query(f"SELECT o_orderkey, previous_block, block_id FROM (SELECT o_orderkey, block_id, lag(block_id) OVER (ORDER BY o_orderkey) AS previous_block FROM (SELECT o_orderkey, {BLOCK_SQL} AS block_id FROM {_keyed('o_orderkey', 'orders')})) WHERE previous_block > block_id")
def unsorted_input_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = _routed(spark, sf_dir, "orders", "o_orderkey")[0]
    return validate.unsorted(routed, "o_orderkey").select("o_orderkey", "previous_block", "block_id")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey > 255")
def payload_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where(validate.overflowing(F.col("o_custkey"), 1)).select("o_orderkey", "o_custkey")


@query("SELECT page_id, CASE WHEN octet_length(encode(url)) < 40 THEN 'KEY_TOO_SHORT' ELSE 'OK' END AS status FROM pages")
def key_length_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the last 24 bytes are kept back, so that some of the urls are too short
    key = F.encode("url", "utf-8")
    return table(spark, sf_dir, "pages").select("page_id", validate.key_length_status(F.substring(key, F.lit(1), F.greatest(F.octet_length(key) - 24, F.lit(0)))).alias("status"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY h) AS position FROM (SELECT o_orderkey, md5(CAST(o_orderkey AS VARCHAR)) AS h FROM orders)")
def merge_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _orders(spark, sf_dir).select("o_orderkey", "key")
    # a row without key is in the first stream
    stream = F.coalesce(F.pmod("o_orderkey", F.lit(4)), F.lit(0))
    return routing.numbered(routing.merged(*[orders.where(stream == i) for i in range(4)]).select("o_orderkey"), "position")


# stats, integrity, storage, streams


@query(f"SELECT count(*) AS num_keys, {_bijection_blocks('orders')} AS num_blocks, 4 AS payload_size, 1 AS fingerprint_size, 'bijection' AS algorithm, true AS size_within_bounds FROM orders")
def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = build(_orders(spark, sf_dir), payload="payload", payload_size=4, fingerprint_size=1).stats()
    return stats.select("num_keys", "num_blocks", "payload_size", "fingerprint_size", "algorithm", F.col("overhead_bits_per_key").between(2.0, 6.0).alias("size_within_bounds"))


def _folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).sparkContext.getCheckpointDir()}/query-{uuid.uuid4().hex}"


@query("SELECT 'verified' AS status, count(*) AS n FROM orders")
def verify_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{_folder(spark)}/index"
    build(_orders(spark, sf_dir), payload="payload", payload_size=4, fingerprint_size=2).save(path)
    index = open_index(spark, path)
    index.verify()
    return index.tables["entries"].agg(F.lit("verified").alias("status"), F.count(F.lit(1)).alias("n"))


@query()
def prehash_xxh3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return h.pre_hash(table(spark, sf_dir, "pages").select("page_id", "url"), "url").select("page_id", F.lower(F.hex("key")).alias("key"))


def _codec(algorithm: str) -> None:
    @query("SELECT c_custkey, c_nationkey::BIGINT AS payload, true AS same_rank FROM customer", f"codec_roundtrip_{algorithm[:3]}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        customers = table(spark, sf_dir, "customer").select("c_custkey", h.key_bytes("c_custkey").alias("key"), F.col("c_nationkey").cast("long").alias("payload"))
        index = build(customers, payload="payload", payload_size=2, fingerprint_size=1, algorithm=algorithm, metadata=b"round trip")
        path = f"{_folder(spark)}/index.bin"
        codec.export_file(index, path)
        again = codec.open_file(spark, path, verify=True)
        ranks = index.lookup(customers.select("c_custkey", "key")).select("c_custkey", F.col("rank").alias("before"))
        return again.query_payload(customers.select("c_custkey", "key")).join(ranks, "c_custkey").select("c_custkey", "payload", (F.col("rank") == F.col("before")).alias("same_rank"))


for _name in ("bijection", "ptrhash"):
    _codec(_name)


@query("SELECT count(*) AS n, count(DISTINCT text) AS n_ranks, count(DISTINCT text) - 1 AS highest FROM documents")
def doc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select(h.key_bytes("text").alias("key"))
    return build(documents.distinct()).lookup(documents).agg(F.count("rank").alias("n"), F.count_distinct("rank").alias("n_ranks"), F.max("rank").alias("highest"))


@query("SELECT event_id, c_nationkey::BIGINT AS payload, 'OK' AS status FROM events JOIN customer ON user_id = c_custkey UNION ALL SELECT event_id, NULL, 'NOT_FOUND' FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer)")
def streaming_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(h.key_bytes("c_custkey").alias("key"), F.col("c_nationkey").cast("long").alias("payload"))
    index = build(customers, payload="payload", payload_size=1, fingerprint_size=4)
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    found = ingest.probe(events.select("event_id", h.key_bytes("user_id").alias("key")), index, payload=True)
    folder = _folder(spark)
    ingest.stage(found.select("event_id", "payload", "status"), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@query("SELECT count(*) AS n, count(DISTINCT o_orderkey) AS n_ranks FROM orders")
def streaming_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.readStream.schema(table(spark, sf_dir, "orders").schema).parquet(f"{sf_dir}/orders.parquet*")
    folder = _folder(spark)
    ingest.stage(orders.select(h.key_bytes("o_orderkey").alias("key")), f"{folder}/staging", f"{folder}/checkpoint").awaitTermination()
    index = ingest.finish(spark, f"{folder}/staging", total_keys=table(spark, sf_dir, "orders").count(), algorithm="ptrhash")
    return index.lookup(_orders(spark, sf_dir)).agg(F.count("rank").alias("n"), F.count_distinct("rank").alias("n_ranks"))


@query("SELECT count(*) AS n, count(DISTINCT p_partkey) AS n_ranks, sum(p_size)::BIGINT AS payloads FROM part")
def entry_file_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(h.key_bytes("p_partkey").alias("key"), F.col("p_size").cast("long").alias("payload"))
    folder = _folder(spark)
    entry_files.write_entries(parts, folder, 3, ordered=True).count()
    entries = entry_files.read_entries(spark, f"{folder}/*.bin", chunk=500)
    index = build(entries, payload="payload", payload_size=1, fingerprint_size=1)
    return index.query_payload(entries.select("key")).agg(F.count("rank").alias("n"), F.count_distinct("rank").alias("n_ranks"), F.sum("payload").alias("payloads"))


# statuses: what each fault raises, as rows


def _raised(run: Callable[[], object]) -> str:
    try:
        run()
    except errors.KeyloomError as e:
        return type(e).__name__
    return "OK"


def _statuses(name: str, expected: dict[str, str]) -> Callable[[Callable[[SparkSession, str], dict[str, Callable[[], object]]]], None]:
    """A query of (fault, status), one row for each of the actions that a function gives; its SQL holds the statuses that must come."""
    values = ", ".join(f"('{k}', '{v}')" for k, v in expected.items())

    def register(f: Callable[[SparkSession, str], dict[str, Callable[[], object]]]) -> None:
        @query(f"SELECT * FROM (VALUES {values}) t(fault, status)", name)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return spark.createDataFrame([(k, _raised(action)) for k, action in f(spark, sf_dir).items()], "fault string, status string")

    return register


@_statuses("option_statuses", {"no keys": "EmptyIndex", "2^40 keys": "OK", "one key more": "TooManyKeys", "payload 8": "OK", "payload 9": "PayloadTooLarge", "fingerprint 4": "OK", "fingerprint 5": "FingerprintTooLarge", "bijection": "OK", "ptrhash": "OK", "other": "UnknownAlgorithm"})
def _options(spark: SparkSession, sf_dir: str) -> dict[str, Callable[[], object]]:
    check = validate.check_options
    return {
        "no keys": lambda: check(0, 0, 0),
        "2^40 keys": lambda: check(g.MAX_KEYS, 0, 0),
        "one key more": lambda: check(g.MAX_KEYS + 1, 0, 0),
        "payload 8": lambda: check(1, 8, 0),
        "payload 9": lambda: check(1, 9, 0),
        "fingerprint 4": lambda: check(1, 0, 4),
        "fingerprint 5": lambda: check(1, 0, 5),
        **{name: (lambda name=name: algorithm_of(name)) for name in ("bijection", "ptrhash", "other")},
    }


@_statuses(
    "build_statuses",
    {"empty": "EmptyIndex", "one short": "KeyTooShort", "one null": "KeyTooShort", "one overflows": "PayloadOverflow", "one twice": "DuplicateKey", "one fewer than declared": "KeyCountMismatch", "as declared": "OK", "not spread": "BlockOverflow", "out of order": "UnsortedInput", "in order": "OK", "ptrhash, one twice": "DuplicateKey"},
)
def _builds(spark: SparkSession, sf_dir: str) -> dict[str, Callable[[], object]]:
    suppliers = table(spark, sf_dir, "supplier").select(h.key_bytes("s_suppkey").alias("key"), F.col("s_suppkey").alias("id"))
    n = suppliers.count()
    first = F.col("id") == suppliers.agg(F.min("id")).first()[0]
    ascii_keys = table(spark, sf_dir, "orders").select(F.encode(F.lpad(F.col("o_orderkey").cast("string"), 16, "0"), "utf-8").alias("key"))
    parts = table(spark, sf_dir, "orders").select(h.key_bytes("o_orderkey").alias("key"), F.col("o_orderkey").alias("id"))
    return {
        "empty": lambda: build(suppliers.limit(0)),
        "one short": lambda: build(suppliers.withColumn("key", F.when(first, F.substring("key", 1, 15)).otherwise(F.col("key")))),
        "one null": lambda: build(suppliers.withColumn("key", F.when(~first, F.col("key")))),
        "one overflows": lambda: build(suppliers.withColumn("id", F.when(first, 65536).otherwise(1)), payload="id", payload_size=2),
        "one twice": lambda: build(suppliers.unionByName(suppliers.where(first))),
        "one fewer than declared": lambda: build(suppliers, total_keys=n + 1),
        "as declared": lambda: build(suppliers, total_keys=n),
        "not spread": lambda: build(ascii_keys),
        "out of order": lambda: build(parts, sorted_by="id"),
        "in order": lambda: build(parts.withColumn("id", F.hex("key")), sorted_by="id"),
        "ptrhash, one twice": lambda: build(suppliers.unionByName(suppliers.where(first)), algorithm="ptrhash"),
    }


@_statuses(
    "file_statuses",
    {"whole": "OK", "magic": "InvalidMagic", "version": "InvalidVersion", "header cut": "TruncatedFile", "below 304 bytes": "TruncatedFile", "payload size": "CorruptedIndex", "no blocks": "CorruptedIndex", "algorithm": "UnknownAlgorithm", "footer cut": "CorruptedIndex", "directory": "CorruptedIndex", "entry": "ChecksumFailed", "metadata": "ChecksumFailed", "footer": "ChecksumFailed"},
)
def _files(spark: SparkSession, sf_dir: str) -> dict[str, Callable[[], object]]:
    customers = table(spark, sf_dir, "customer").select(h.key_bytes("c_custkey").alias("key"), F.col("c_nationkey").alias("payload"))
    path = f"{_folder(spark)}/index.bin"
    codec.export_file(build(customers, payload="payload", payload_size=2, fingerprint_size=1), path)
    raw = files.read_range(path, 0, files.size_of(path))
    whole = codec.Parsed(raw)

    def put(at: int, new: bytes) -> bytes:
        return raw[:at] + new + raw[at + len(new) :]

    def flipped(at: int) -> bytes:
        return put(at, bytes([raw[at] ^ 1]))

    changed = {
        "whole": raw,
        "magic": flipped(0),
        "version": flipped(4),
        "header cut": raw[:40],
        "below 304 bytes": raw[:300],
        "payload size": put(22, b"\x20\0\0\0"),
        "no blocks": put(14, bytes(4)),
        "algorithm": put(35, b"\7"),
        "footer cut": raw[:-9],
        "directory": put(whole.entries_at - 10, b"\xff" * 5),
        "entry": flipped(whole.entries_at + 5),
        "metadata": flipped(whole.metadata_at + 5),
        "footer": flipped(len(raw) - 30),
    }
    return {name: (lambda data=data: codec.Parsed(data).verify()) for name, data in changed.items()}


@_statuses("block_statuses", {"short metadata": "CorruptedIndex", "counts": "CorruptedIndex", "list mark": "CorruptedIndex", "remap length": "CorruptedIndex", "whole": "OK", "empty block": "OK", "empty pilot block": "OK"})
def _blocks_of_a_file(spark: SparkSession, sf_dir: str) -> dict[str, Callable[[], object]]:
    keys = np.random.default_rng(1).integers(0, 1 << 62, (2, 3000)).astype(np.uint64)
    buckets, _, _ = bijection.solve(keys[0], keys[1], SEED)
    raw = codec.encode_bijection_block(buckets["bucket_id"], buckets["size"], buckets["seed0"], buckets["seed1"])
    pilots = codec.encode_pilot_block(np.zeros(g.PILOT_BUCKETS), np.zeros(3))
    none = codec.encode_bijection_block(*[np.zeros(0, np.int64)] * 4)
    return {
        "short metadata": lambda: codec.decode_bijection_block(raw[:40], 3000),
        "counts": lambda: codec.decode_bijection_block(raw, 2999),
        "list mark": lambda: codec.decode_bijection_block(raw[:-1] + bytes([raw[-1] ^ 1]), 3000),
        "remap length": lambda: codec.decode_pilot_block(pilots, 31_000),
        "whole": lambda: codec.decode_bijection_block(raw, 3000),
        "empty block": lambda: codec.decode_bijection_block(none, 0),
        "empty pilot block": lambda: codec.decode_pilot_block(codec.encode_pilot_block(np.zeros(g.PILOT_BUCKETS), np.zeros(0)), 0),
    }


@_statuses("handle_statuses", {"open": "OK", "payload of none": "NoPayload", "never saved": "CorruptedIndex", "closed": "IndexClosed", "closed twice": "OK", "nothing there": "TruncatedFile", "key of another": "NotFound", "short key": "KeyTooShort", "builder used again": "BuilderClosed", "two ways of adding": "MixedWriters", "blocks go back": "UnsortedInput", "cancelled": "Cancelled"})
def _handles(spark: SparkSession, sf_dir: str) -> dict[str, Callable[[], object]]:
    suppliers = table(spark, sf_dir, "supplier").select(h.key_bytes("s_suppkey").alias("key"))
    index, closed = build(suppliers, fingerprint_size=4), build(suppliers)
    closed.close()

    def used_again() -> None:
        with Builder(spark) as b:
            b.add_key(bytes(16))
            b.finish()
            b.add_key(bytes(17))

    def mixed() -> None:
        with Builder(spark) as b:
            b.add_key(bytes(16))
            b.add_keys(2, lambda number, add: None)

    def back() -> None:
        with Builder(spark, 5000, ordered=True) as b:
            b.add_key(b"\xff" * 16)
            b.add_key(bytes(16))

    def cancelled() -> None:
        with Builder(spark) as b:
            b.add_key(bytes(16))
            b.cancel()
            b.finish()

    return {
        "open": lambda: index.lookup(suppliers).count(),
        "payload of none": lambda: index.query_payload(suppliers),
        "never saved": index.verify,
        "closed": lambda: closed.lookup(suppliers),
        "closed twice": closed.close,
        "nothing there": lambda: open_index(spark, _folder(spark)),
        "key of another": lambda: index.rank_of(b"not a supplier's key"),
        "short key": lambda: index.rank_of(b"short"),
        "builder used again": used_again,
        "two ways of adding": mixed,
        "blocks go back": back,
        "cancelled": cancelled,
    }


# builders, single keys, empty places


@query("SELECT s_suppkey, s_nationkey::BIGINT AS payload FROM supplier")
def builder_add_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", h.key_bytes("s_suppkey").alias("key"), F.col("s_nationkey").alias("payload"))
    rows = suppliers.collect()  # keys that a caller holds

    def write(number: int, add: Callable[..., None]) -> None:
        for r in rows[number::3]:
            add(bytes(r.key), r.payload)

    index = Builder(spark, len(rows), payload_size=1, fingerprint_size=2).add_keys(3, write)
    return index.query_payload(suppliers.select("s_suppkey", "key")).where("status = 'OK'").select("s_suppkey", "payload")


@query("SELECT s_suppkey, s_nationkey::BIGINT AS payload FROM supplier WHERE s_suppkey <= 50 UNION ALL SELECT -1 - s_suppkey, NULL FROM supplier WHERE s_suppkey <= 50")
def single_key_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", h.key_bytes("s_suppkey").alias("key"), h.key_bytes(-1 - F.col("s_suppkey")).alias("other"), F.col("s_nationkey").alias("payload"))
    with Builder(spark, payload_size=1, fingerprint_size=4) as b:
        b.add_frame(suppliers, payload="payload")
        index = b.finish()

    def one(key: bytes) -> int | None:
        try:
            return index.payload_of(key)
        except errors.NotFound:
            return None

    asked = suppliers.where("s_suppkey <= 50").collect()
    return spark.createDataFrame([(r.s_suppkey, one(bytes(r.key))) for r in asked] + [(-1 - r.s_suppkey, one(bytes(r.other))) for r in asked], "s_suppkey long, payload long")


_NATION_BLOCK = f"{_range(PREFIX, _bijection_blocks('nation'))}::BIGINT"


@query(
    f"SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM n WHERE n.block = c.block AND n.bucket = c.bucket) THEN 'OK' ELSE 'NOT_FOUND' END AS status FROM (SELECT c_custkey, {_NATION_BLOCK} AS block, {BUCKET_SQL} AS bucket FROM {_keyed('c_custkey', 'customer')}) c".replace(
        "SELECT c_custkey, CASE", f"WITH n AS (SELECT {_NATION_BLOCK} AS block, {BUCKET_SQL} AS bucket FROM {_keyed('n_nationkey', 'nation')}) SELECT c_custkey, CASE", 1
    )
)
def empty_bucket_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select(h.key_bytes("n_nationkey").alias("key"))
    return build(nations).lookup(table(spark, sf_dir, "customer").select("c_custkey", h.key_bytes("c_custkey").alias("key"))).select("c_custkey", "status")


@query(f"SELECT c_custkey, CASE WHEN block = (SELECT {_range(PREFIX, 2)}::BIGINT FROM {_keyed('n_nationkey', 'nation')} WHERE n_nationkey = 0) THEN 'OK' ELSE 'NOT_FOUND' END AS status FROM (SELECT c_custkey, {_range(PREFIX, 2)}::BIGINT AS block FROM {_keyed('c_custkey', 'customer')})")
def empty_block_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = table(spark, sf_dir, "nation").where("n_nationkey = 0").select(h.key_bytes("n_nationkey").alias("key"))
    return build(one, algorithm="ptrhash").lookup(table(spark, sf_dir, "customer").select("c_custkey", h.key_bytes("c_custkey").alias("key"))).select("c_custkey", "status")


_CUBIC = f"SELECT {_range('(cubed // 256) * 255::UHUGEINT + x // 256', g.PILOT_BUCKETS)}::BIGINT AS bucket_id, count(*) AS n FROM (SELECT *, (squared * (x // 2 + 9223372036854775808::UHUGEINT)) >> 64 AS cubed FROM (SELECT *, (x * x) >> 64 AS squared FROM (SELECT {K1} AS x FROM {_keyed('c_custkey', 'customer')}))) GROUP BY ALL"


@query(f"SELECT bucket_id, n, row_number() OVER (ORDER BY n DESC, bucket_id) AS turn FROM ({_CUBIC})")
def bucket_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order in which a block's pilots are searched: one block's buckets, at most 10,000 rows."""
    let = h.Let(table(spark, sf_dir, "customer").select("c_custkey"))
    buckets = let.result(bucket_id=h.cubic_bucket(let, h.k1(h.key_bytes("c_custkey")), g.PILOT_BUCKETS)).groupBy("bucket_id").agg(F.count(F.lit(1)).alias("n"))
    return buckets.withColumn("turn", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "bucket_id")))


@query("SELECT 3 AS files, count(*)::BIGINT AS entries, count(DISTINCT p_partkey) AS keys FROM part")
def header_count_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(h.key_bytes("p_partkey").alias("key"), F.col("p_size").cast("long").alias("payload"))
    folder = _folder(spark)
    paths = [r.path for r in entry_files.write_entries(parts, folder, 3).collect()]
    counted = entry_files.total_entries(paths)
    return entry_files.read_entries(spark, f"{folder}/*.bin").agg(F.lit(len(paths)).alias("files"), F.lit(counted).cast("long").alias("entries"), F.count_distinct("key").alias("keys"))


@query("SELECT 5000 AS n, 5000 AS n_keys, 16 AS shortest, true AS payloads_fit")
def synthetic_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = entry_files.synthetic(spark, 5000)
    return made.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("key").alias("n_keys"), F.min(F.octet_length("key")).alias("shortest"), F.min(F.col("payload").between(0, (1 << 32) - 1)).alias("payloads_fit"))


@query("SELECT o_orderkey, o_custkey AS payload FROM orders")
def open_payload_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{_folder(spark)}/index"
    build(_orders(spark, sf_dir), payload="payload", payload_size=4, algorithm="ptrhash").save(path)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", h.key_bytes("o_orderkey").alias("key"))
    return open_payload(spark, path).query_payload(orders).select("o_orderkey", "payload")


@query(f"SELECT count(*) AS num_keys, {_bijection_blocks('orders')} AS num_blocks, 4 AS payload_size, 2 AS fingerprint_size, true AS as_before FROM orders")
def stored_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{_folder(spark)}/index"
    index = build(_orders(spark, sf_dir), payload="payload", payload_size=4, fingerprint_size=2)
    bits = index.stats().first().bits_per_key
    index.save(path)
    return get_stats(spark, path).select("num_keys", "num_blocks", "payload_size", "fingerprint_size", (F.col("bits_per_key") == bits).alias("as_before"))


@query("SELECT * FROM (VALUES (0, 0, true), (0, 4, true), (3, 2, true), (8, 0, true)) t(payload_size, fp_size, within_bounds)")
def bits_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for payload, fp in ((0, 0), (0, 4), (3, 2), (8, 0)):
        stats = build(_orders(spark, sf_dir), payload="payload", payload_size=payload, fingerprint_size=fp).stats().first()
        rows.append((payload, fp, 8 * (payload + fp) + 2 <= stats.bits_per_key <= 8 * (payload + fp) + 6))
    return spark.createDataFrame(rows, "payload_size int, fp_size int, within_bounds boolean")


@query("SELECT 'SPLIT_FAILED' AS search, true AS failed UNION ALL SELECT 'DUPLICATE_KEY', true UNION ALL SELECT 'INDISTINGUISHABLE', true UNION ALL SELECT 'none', false")
def search_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the block solvers report of keys that no seed or pilot can part."""
    same = np.full(9, 7, np.uint64)
    spread = np.random.default_rng(2).integers(0, 1 << 62, (2, 40)).astype(np.uint64)
    twins = np.array([5, 6], np.uint64)
    found = [
        ("SPLIT_FAILED", bijection.solve(same, same, SEED)[2]),
        ("DUPLICATE_KEY", bijection.solve(same[:3], same[:3], SEED)[2]),
        # different keys whose halves' exclusive or, which places them, is one
        ("INDISTINGUISHABLE", ptrhash.solve(twins ^ np.uint64(9), np.array([5, 6], np.uint64) ^ np.uint64(1), 0, SEED, 1)[3]),
        ("none", ptrhash.solve(spread[0], spread[1], 0, SEED)[3]),
    ]
    return spark.createDataFrame([(name, error is not None) for name, error in found], "search string, failed boolean")
