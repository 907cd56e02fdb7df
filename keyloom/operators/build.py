"""Building an index: keys to blocks, one solved block a group, running totals, tables.

    index = build(df, key="key", payload="value", payload_size=4, fingerprint_size=1)

df.key holds 16 to 65,535 bytes, evenly spread (`functions.hashing.key_bytes` or `pre_hash` make such keys).  The keyed input is written to the
shared folder once, so that checks, retries and the solve read the same rows; blocks are solved by groupBy(block).applyInArrow; nothing
but counts reaches the driver.
"""

from __future__ import annotations

from types import ModuleType

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom import errors
from keyloom.functions import geometry as g
from keyloom.functions import hashing as h
from keyloom.operators import bijection, ptrhash
from keyloom.operators.index import Index
from keyloom.plans import routing, validate
from keyloom.session import checkpoint, shuffle_partitions

ALGORITHMS: dict[str, ModuleType] = {bijection.NAME: bijection, ptrhash.NAME: ptrhash}
BIJECTION, PTRHASH = bijection.NAME, ptrhash.NAME
_ERRORS = {
    "DUPLICATE_KEY": errors.DuplicateKey,
    "SPLIT_FAILED": errors.SplitBucketSeedSearchFailed,
    "INDISTINGUISHABLE": errors.IndistinguishableHashes,
}


def algorithm_of(name: str) -> ModuleType:
    if name not in ALGORITHMS:
        raise errors.UnknownAlgorithm(f"{name}: the algorithms are {', '.join(ALGORITHMS)}")
    return ALGORITHMS[name]


def _next_seed(seed: int) -> int:
    return (seed * 6364136223846793005 + 1442695040888963407) % (1 << 64)


def build(
    df: DataFrame,
    key: str = "key",
    payload: str | None = None,
    *,
    payload_size: int = 0,
    fingerprint_size: int = 0,
    algorithm: str = BIJECTION,
    global_seed: int = g.DEFAULT_SEED,
    total_keys: int | None = None,
    sorted_by: str | None = None,
    metadata: bytes = b"",
    retries: int = 0,
    workers: int | None = None,
) -> Index:
    """An index over df's keys.

    total_keys, if given, must be the number of rows. sorted_by names a position column by which blocks must not go back.  A
    search that fails for one global seed is tried again with another, retries times.  workers is the number of tasks that solve blocks, by default that of shuffle partitions or cores.  Null and short keys, long ones, payloads above
    payload_size bytes and repeated keys raise.
    """
    how = algorithm_of(algorithm)
    validate.check_options(1, payload_size, fingerprint_size)
    value = F.col(payload).cast("long") if payload and payload_size else F.lit(0).cast("long")
    keys = F.col(key) if dict(df.dtypes)[key] == "binary" else F.encode(F.col(key), "utf-8")
    position = [F.col(sorted_by).alias("position")] if sorted_by else []
    let = h.Let(df.select(keys.alias("key"), value.alias("payload"), *position))
    prefix, k0, k1 = h.halves(let, F.col("key"))
    keyed = checkpoint(let.result(k0=k0, k1=k1, prefix=prefix, key_length=F.octet_length("key")).drop("key"))
    n = validate.check_keyed(keyed, payload_size)
    validate.check_options(n, payload_size, fingerprint_size)
    if total_keys is not None and total_keys != n:
        raise errors.KeyCountMismatch(f"{total_keys} keys were declared, {n} came")
    blocks = how.num_blocks(n)
    routed = keyed.withColumn("block_id", h.fast_range(F.col("prefix"), blocks))
    if sorted_by:
        validate.check_sorted(routed, "position")
    totals, largest = routing.totals(routed, blocks)
    if largest > g.block_limit(n, blocks):
        if validate.duplicates(keyed, "k0", "k1").limit(1).count():
            raise errors.DuplicateKey("two keys have the same first 16 bytes")
        raise errors.BlockOverflow("keys are not evenly spread over blocks; hash them first")
    # an explicit number of partitions, since a search over few bytes of keys is long work that must not be coalesced into one task
    tasks = workers or min(blocks, max(shuffle_partitions(df.sparkSession), df.sparkSession.sparkContext.defaultParallelism))
    by_block = routed.select("block_id", "k0", "k1", "payload").repartition(tasks, "block_id").groupBy("block_id")
    by_total = totals.repartition(tasks, "block_id").groupBy("block_id")
    for attempt in range(retries + 1):
        # equal keys meet in their block, whose solver reports them
        solved = checkpoint(by_block.cogroup(by_total).applyInArrow(how.solver(global_seed, fingerprint_size), how.SOLVED))
        failed = solved.where("error is not null").select("error").first()
        if failed is None:
            break
        if attempt == retries or failed.error == "DUPLICATE_KEY":
            raise _ERRORS[failed.error](f"a block can't be solved with global seed {global_seed:#x}")
        global_seed = _next_seed(global_seed)
    entries = solved.where("kind = 0").select("rank", "block_id", "fp", "payload")
    meta = {
        "algorithm": algorithm,
        "total_keys": n,
        "num_blocks": blocks,
        "payload_size": payload_size,
        "fp_size": fingerprint_size,
        "global_seed": global_seed,
        "user_metadata": bytes(metadata),
    }
    return Index(df.sparkSession, meta, {"blocks": totals, "entries": entries, **how.directory(solved, totals)})
