"""What the library needs from a session: importable workers and a shared folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ensure_importable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from a checkout that isn't installed."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> SparkSession:
    """The cluster names its shared folder in spark.checkpoint.dir; only a local session without one gets a temporary folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="keyloom-checkpoint-")
        sc.setCheckpointDir(named)
    return spark


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut df's lineage with a copy in the shared folder, which outlives any executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system, whatever kind that is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """The names of what lies in a folder."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return [f.getPath().getName() for f in target.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(target)]
