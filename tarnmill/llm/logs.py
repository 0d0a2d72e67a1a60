"""Host log sequences: cleaning, plain form, and neighbours without one task per host.

A host's sequence is cut into blocks of `BLOCK` positions. Rows are spread by (host, block), so one
host that holds a third of all rows is spread too; what a block needs from the blocks after it (its
first few rows) is passed over as a small table of block heads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import shuffle_partitions, stage

#: Positions of a host in one block.
BLOCK = 1 << 16


def plain_log(log: Column) -> Column:
    """Lower-case log, cut off from the first `#` or `[` on, then trimmed of spaces."""
    return F.trim(F.substring_index(F.substring_index(F.lower(log), "#", 1), "[", 1))


def clean_log_rows(rows: DataFrame, with_ts: bool = False) -> DataFrame:
    """(host_id, block, pos, log[, ts]): clean rows with plain logs.

    Rows without host_id or pos have no place in a sequence and are left out (`loose_rows`). Of rows with equal
    (host_id, pos) the one with the lowest row_id stays (ties: the lowest log, then ts); a null
    row_id counts as lowest. Then rows with a null log or an empty plain log go. Redelivered rows
    are merged before the shuffle, which is on (host_id, pos) and so has no hot key.
    """
    payload = ["row_id", "log"] + (["ts"] if with_ts else [])
    one = (
        rows.where(F.col("host_id").isNotNull() & F.col("pos").isNotNull())
        .groupBy("host_id", "pos")
        .agg(F.min(F.struct(*payload)).alias("r"))
    )
    cols = [F.col("host_id"), F.greatest(F.lit(0), F.floor(F.col("pos") / BLOCK).cast("int")).alias("block"), F.col("pos"), plain_log(F.col("r.log")).alias("log")]
    if with_ts:
        cols.append(F.col("r.ts").alias("ts"))
    return one.where(F.col("r.log").isNotNull()).select(*cols).where(F.col("log") != "")


def loose_rows(rows: DataFrame) -> DataFrame:
    """(host_id, log): rows with a host and a plain log but without pos. They stand nowhere in a
    sequence and can't be told to be redelivered, so each counts as an occurrence of its log."""
    found = rows.where(F.col("host_id").isNotNull() & F.col("pos").isNull() & F.col("log").isNotNull())
    return found.select("host_id", plain_log(F.col("log")).alias("log")).where(F.col("log") != "")


def staged_clean_rows(rows: DataFrame, with_ts: bool = False) -> DataFrame:
    return stage(clean_log_rows(rows, with_ts), "clean-logs")


def with_following(seq: DataFrame, k: int, payload: list[str]) -> DataFrame:
    """`seq` (host_id, block, pos, ...) with `nexts`: the payload structs of the next k rows of the
    host, in order, whatever the gaps in pos; fewer at the host's end.

    `seq` should be staged, as it is read twice: once spread by (host_id, block), and once for the
    heads of blocks, of which only hosts beyond the first block have any.
    """
    item = F.struct(*payload)
    main = seq.repartition(shuffle_partitions(seq.sparkSession), "host_id", "block")
    w = Window.partitionBy("host_id", "block").orderBy("pos")
    heads = (
        seq.where(F.col("block") != 0)
        .withColumn("rn", F.row_number().over(w))
        .where(F.col("rn") <= k)
        .groupBy("host_id", "block")
        .agg(F.sort_array(F.collect_list(F.struct("pos", item.alias("item")))).alias("head"))
    )
    by_host = Window.partitionBy("host_id").orderBy("block")
    # The first head block of a host follows block 0: lower positions all lie in block 0.
    target = F.coalesce(F.lag("block").over(by_host), F.lit(0))
    ahead = F.slice(F.flatten(F.collect_list("head").over(by_host.rowsBetween(0, k - 1))), 1, k)
    halo = heads.select("host_id", target.alias("block"), F.transform(ahead, lambda x: x["item"]).alias("halo"))
    own = F.array_compact(F.array(*[F.lead(item, j).over(w) for j in range(1, k + 1)]))
    return (
        main.join(halo, ["host_id", "block"], "left")
        .withColumn("nexts", own)
        .withColumn("nexts", F.when(F.col("halo").isNull(), F.col("nexts")).otherwise(F.slice(F.concat("nexts", "halo"), 1, k)))
        .drop("halo")
    )


def hot_salts(counts: DataFrame, term: str, count: str) -> DataFrame:
    """(term, salts) of the terms that hold more than half a partition's share of all rows.

    At most 2 x partitions terms can, so the table has a proven bound and may be broadcast. `salts`
    is the number of tasks that such a term is spread over.
    """
    spark = counts.sparkSession
    parts = shuffle_partitions(spark)
    total = counts.agg(F.sum(count)).first()[0] or 0
    hot = counts.where(F.col(count) * 2 * parts > F.lit(total)).select(
        F.col(term), F.least(F.lit(parts), F.ceil(F.col(count) * 2 * parts / F.lit(max(total, 1)))).cast("int").alias("salts")
    )
    rows = hot.collect()
    schema = hot.schema
    return spark.createDataFrame(rows, schema)
