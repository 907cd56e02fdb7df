"""Keys to blocks and buckets, counts, and running totals: the relational half of a build."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions import hashing as h
from keyloom.session import checkpoint

LOCAL_BLOCKS = 1 << 16


def route(df: DataFrame, key: Column, blocks: int) -> DataFrame:
    """df with k0, k1 and block_id."""
    return df.withColumns({"k0": h.k0(key), "k1": h.k1(key), "block_id": h.fast_range(h.prefix(key), blocks)})


def block_counts(routed: DataFrame, blocks: int) -> DataFrame:
    """(block_id, n) of all blocks, the empty ones too."""
    counts = routed.groupBy("block_id").agg(F.count(F.lit(1)).alias("n"))
    return routed.sparkSession.range(blocks).withColumnRenamed("id", "block_id").join(counts, "block_id", "left").select("block_id", F.coalesce("n", F.lit(0)).alias("n"))


def keys_before(counts: DataFrame) -> DataFrame:
    """(block_id, keys_in_block, keys_before): the running total in front of each block.

    A window over all blocks would put them in one task; here ranges of blocks are summed first, so that only one row a range goes through
    the global window.
    """
    spread = counts.withColumn("__range", F.shiftrightunsigned(F.col("block_id"), 12))
    ranges = spread.groupBy("__range").agg(F.sum("n").alias("__n"))
    total = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    base = ranges.select("__range", F.coalesce(F.sum("__n").over(total), F.lit(0)).alias("__base"))
    own = Window.partitionBy("__range").orderBy("block_id").rowsBetween(Window.unboundedPreceding, -1)
    return spread.join(base, "__range").select("block_id", F.col("n").alias("keys_in_block"), (F.col("__base") + F.coalesce(F.sum("n").over(own), F.lit(0))).alias("keys_before"))


def totals(routed: DataFrame, blocks: int) -> tuple[DataFrame, int]:
    """(block_id, keys_in_block, keys_before) of all blocks, kept, and the keys of the largest: up to LOCAL_BLOCKS of them are added up on the driver, in one job; more by keys_before."""
    if blocks > LOCAL_BLOCKS:
        whole = checkpoint(keys_before(block_counts(routed, blocks)))
        return whole, whole.agg(F.max("keys_in_block")).first()[0]
    found = routed.groupBy("block_id").agg(F.count(F.lit(1)).alias("n")).toArrow()
    n = np.zeros(blocks, np.int64)
    n[found.column("block_id").to_numpy()] = found.column("n").to_numpy()
    return routed.sparkSession.createDataFrame(pa.table({"block_id": np.arange(blocks), "keys_in_block": n, "keys_before": np.cumsum(n) - n})), int(n.max())


def bucket_counts(bucketed: DataFrame) -> DataFrame:
    return bucketed.groupBy("block_id", "bucket_id").agg(F.count(F.lit(1)).alias("n"))


def cumulative(counts: DataFrame) -> DataFrame:
    """(block_id, bucket_id, n, cumulative) with running totals within each block."""
    w = Window.partitionBy("block_id").orderBy("bucket_id").rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("cumulative", F.sum("n").over(w))


def merged(*streams: DataFrame) -> DataFrame:
    """Key streams as one, in key order across and within partitions: a sort-merge union."""
    whole = streams[0]
    for s in streams[1:]:
        whole = whole.unionByName(s)
    order = F.col("key").asc_nulls_last()
    return whole.repartitionByRange(order).sortWithinPartitions(order)


def numbered(ordered: DataFrame, name: str) -> DataFrame:
    """The rows of partitions that are ranges in order, with their positions from 1, without a window over all.

    Kept with their turns, since the rows in front of a partition are counted in a second reading: another sample of keys would make other ranges.
    """
    turn = F.monotonically_increasing_id()
    placed = checkpoint(ordered.withColumns({"__part": F.spark_partition_id().cast("long"), "__turn": turn - F.shiftleft(F.shiftrightunsigned(turn, 33), 33)}))
    counts = keys_before(placed.groupBy(F.col("__part").alias("block_id")).agg(F.count(F.lit(1)).alias("n"))).select(F.col("block_id").alias("__part"), "keys_before")
    return placed.join(F.broadcast(counts), "__part").select(*ordered.columns, (F.col("keys_before") + F.col("__turn") + 1).alias(name))
