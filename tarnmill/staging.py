"""Tables written between the steps of an iterative plan.

A staged table lies in the folder that the cluster shares (`spark.checkpoint.dir`), so it survives
the loss of any executor, ends the lineage, and can be read several times without being computed
again. Only a local session without that setting gets a folder of its own.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table, in bytes as estimated from its rows, that is ever sent to all executors.
BROADCAST_BYTES = 32 << 20


def staging_dir(spark: SparkSession) -> str:
    """The shared folder; a private one only for a local master where the setting is missing."""
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="tarnmill-")
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone; the folder is the cluster's scratch space
        pass


def drop_staged(df: DataFrame) -> None:
    """Remove the files of a staged table that no later step reads."""
    if path := getattr(df, "_tarnmill_path", None):
        _remove(df.sparkSession, path)


_staged: list[str] = []


def clear_staged(spark: SparkSession) -> None:
    """Remove all staged tables of this process. Results that still read them can't be used after."""
    while _staged:
        _remove(spark, _staged.pop())


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write `df` to the shared folder and return the written table (same columns and types)."""
    spark = df.sparkSession
    path = f"{staging_dir(spark)}/tarnmill/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _staged:
        atexit.register(clear_staged, spark)
    _staged.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tarnmill_path = path
    return out


def small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """`df` marked for broadcast if `rows * row_bytes`, a counted size, is within BROADCAST_BYTES;
    else unchanged, so the join is a shuffle join."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame) -> DataFrame:
    """`df` over all cores if it comes in fewer partitions, as a single small file does; else as it
    is. For work that costs far more a row than moving the row. A plan that shuffles is left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df  # asking for its partitions would run it
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
