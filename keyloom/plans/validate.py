"""What makes keys unfit for an index, each as a DataFrame of offending rows, and the checks that a build runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom import errors
from keyloom.functions import geometry as g
from keyloom.session import checkpoint


def check_options(keys: int, payload_size: int, fingerprint_size: int) -> None:
    if keys == 0:
        raise errors.EmptyIndex("an index needs a key")
    if keys > g.MAX_KEYS:
        raise errors.TooManyKeys(f"{keys} keys; at most 2^40")
    if not 0 <= payload_size <= g.MAX_PAYLOAD:
        raise errors.PayloadTooLarge(f"payloads have 0 to {g.MAX_PAYLOAD} bytes")
    if not 0 <= fingerprint_size <= g.MAX_FINGERPRINT:
        raise errors.FingerprintTooLarge(f"fingerprints have 0 to {g.MAX_FINGERPRINT} bytes")


def key_length_status(key: Column) -> Column:
    n = F.octet_length(key)
    return F.when(key.isNull() | (n < g.MIN_KEY), "KEY_TOO_SHORT").when(n > g.MAX_KEY, "KEY_TOO_LONG").otherwise("OK")


def bad_keys(df: DataFrame, key: Column) -> DataFrame:
    """Rows whose key is null, shorter than 16 bytes or longer than 65535, with a status."""
    return df.withColumn("status", key_length_status(key)).where("status <> 'OK'")


def overflowing(payload: Column, size: int) -> Column:
    """Whether an unsigned payload needs more than size bytes."""
    return F.lit(False) if size in (0, 8) else F.shiftrightunsigned(payload, 8 * size) != 0


def duplicates(df: DataFrame, *by: str) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def unsorted(df: DataFrame, position: str, block: str = "block_id") -> DataFrame:
    """Rows whose block is before the block of the row in front; order within a block is free.

    Rows are ordered in ranges of positions, each by itself; only the last block of each range goes through a window over all.
    """
    ranged = df.repartitionByRange(position).withColumn("__part", F.spark_partition_id())
    own = Window.partitionBy("__part").orderBy(position)
    # kept, since another sample of positions would make other ranges
    lagged = checkpoint(ranged.withColumns({"previous_block": F.lag(block).over(own), "__turn": F.row_number().over(own), "__last": F.lead(F.lit(1)).over(own).isNull()}))
    ends = lagged.where("__last").select((F.lead("__part").over(Window.orderBy("__part"))).alias("__part"), F.col(block).alias("__before"))
    seen = lagged.join(ends.where("__part is not null"), "__part", "left")
    before = F.when(F.col("__turn") == 1, F.col("__before")).otherwise(F.col("previous_block"))
    return seen.withColumn("previous_block", before).where(F.col("previous_block") > F.col(block)).drop("__part", "__turn", "__last", "__before")


def overfull(counts: DataFrame, keys: int, blocks: int) -> DataFrame:
    return counts.where(F.col("n") > g.block_limit(keys, blocks))


def check_keyed(keyed: DataFrame, payload_size: int) -> int:
    """The number of keys in (key_length, payload), in one pass; raises for the first kind of fault."""
    faults = keyed.agg(
        F.count(F.lit(1)).alias("n"),
        F.max((F.coalesce(F.col("key_length"), F.lit(0)) < g.MIN_KEY).cast("int")).alias("short"),
        F.max((F.col("key_length") > g.MAX_KEY).cast("int")).alias("long"),
        F.max(overflowing(F.col("payload"), payload_size).cast("int")).alias("overflow"),
    ).first()
    if faults.short:
        raise errors.KeyTooShort(f"a key is null or has fewer than {g.MIN_KEY} bytes")
    if faults.long:
        raise errors.KeyTooLong(f"a key has more than {g.MAX_KEY} bytes")
    if faults.overflow:
        raise errors.PayloadOverflow(f"a payload needs more than {payload_size} bytes")
    return faults.n


def check_sorted(df: DataFrame, position: str) -> None:
    if unsorted(df, position).limit(1).count():
        raise errors.UnsortedInput("a key's block is before the block of the key in front")
