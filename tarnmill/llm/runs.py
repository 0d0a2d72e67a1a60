"""Runs of equal consecutive events, found by pointer doubling.

A row whose log equals that of the row before it points to that row. Each round replaces a pointer
by its target's pointer, so pointers double their reach until all lead to the start of their run:
logarithmically many joins on the unique key (host_id, pos), which no long run or large host skews.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import drop_staged, stage
from .logs import with_following


def links_to_previous(seq: DataFrame) -> DataFrame:
    """(host_id, pos, log, ts, to, to_ts): rows equal to the row before them, with a pointer to it."""
    nxt = with_following(seq, 1, ["pos", "log", "ts"]).withColumn("next", F.get("nexts", F.lit(0)))
    return nxt.where(F.col("next.log") == F.col("log")).select(
        "host_id", F.col("next.pos").alias("pos"), "log", F.col("next.ts").alias("ts"), F.col("pos").alias("to"), F.col("ts").alias("to_ts")
    )


def double_pointers(links: DataFrame) -> DataFrame:
    """`links` (host_id, pos, log, ts, to, to_ts), staged, with all pointers at the starts of their runs."""
    while True:
        target = links.select("host_id", F.col("pos").alias("to"), F.col("to").alias("to2"), F.col("to_ts").alias("to_ts2"))
        joined = links.join(target, ["host_id", "to"], "left")
        moved = F.col("to2").isNotNull()
        nxt = stage(
            joined.select(
                "host_id", "pos", "log", "ts", F.coalesce("to2", "to").alias("to"), F.when(moved, F.col("to_ts2")).otherwise(F.col("to_ts")).alias("to_ts"), moved.alias("moved")
            ),
            "run-pointers",
        )
        done = nxt.where("moved").limit(1).count() == 0
        drop_staged(links)
        links = nxt
        if done:
            return links


def runs(seq: DataFrame, min_length: int = 1) -> DataFrame:
    """(host_id, start_pos, end_pos, log, n, first_ts, last_ts, duration): the longest runs of rows with
    equal logs, of at least `min_length` rows. `seq` is staged (host_id, block, pos, log, ts).

    duration is the seconds from first_ts to last_ts, 0 for a row alone with a ts. first_ts and last_ts are the earliest and the latest known ts of the run, null if none is known
    (rows of a run may come with skewed clocks). A host with one row has one run. An empty table
    gives none.
    """
    seq = seq.select("host_id", "block", "pos", "log", "ts")
    links = double_pointers(stage(links_to_previous(seq), "run-links"))
    long = links.groupBy("host_id", F.col("to").alias("start_pos")).agg(
        F.max("pos").alias("end_pos"),
        F.min("log").alias("log"),
        (F.count("*") + 1).alias("n"),
        F.least(F.min("ts"), F.min("to_ts")).alias("first_ts"),
        F.greatest(F.max("ts"), F.max("to_ts")).alias("last_ts"),
    )
    if min_length > 1:
        return _with_duration(long.where(F.col("n") >= min_length).select("host_id", "start_pos", "end_pos", "log", "n", "first_ts", "last_ts"))
    starts = seq.select("host_id", F.col("pos").alias("start_pos"), "log", "ts").join(
        links.select("host_id", F.col("pos").alias("start_pos")), ["host_id", "start_pos"], "left_anti"
    )
    every = starts.join(long.drop("log"), ["host_id", "start_pos"], "left").select(
        "host_id",
        "start_pos",
        F.coalesce("end_pos", "start_pos").alias("end_pos"),
        "log",
        F.coalesce("n", F.lit(1)).cast("long").alias("n"),
        F.when(F.col("n").isNull(), F.col("ts")).otherwise(F.col("first_ts")).alias("first_ts"),
        F.when(F.col("n").isNull(), F.col("ts")).otherwise(F.col("last_ts")).alias("last_ts"),
    )
    return _with_duration(every)


def _with_duration(found: DataFrame) -> DataFrame:
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return found.withColumn("duration", (micros("last_ts") - micros("first_ts")) / F.lit(1e6))
