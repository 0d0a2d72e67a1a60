"""Transition counts over a stream of events.

Each host's last event is state, so pairs are found across micro-batches; the counts of each
micro-batch are written, and added up when read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_OUT = "host string, state string, next string"


def _pairs(key: tuple[Any], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last = state.get[0] if state.exists else "<SOS>"
    # Arrow batches of one micro-batch of a host; events are ordered within the micro-batch.
    rows = pd.concat(list(batches)).sort_values(["ts", "tie"])
    logs = rows["log"].tolist()
    if logs:
        state.update((logs[-1],))
        yield pd.DataFrame({"host": [str(key[0])] * len(logs), "state": [last, *logs[:-1]], "next": logs})


def transition_pairs(events: DataFrame, host: str, ts: str, tie: str, log: str) -> DataFrame:
    """(host, state, next) of a stream: each event with the host's event before it, also across
    micro-batches. Events that come later than ones already seen follow them."""
    src = events.selectExpr(f"cast({host} as string) as host", f"{ts} as ts", f"{tie} as tie", f"{log} as log").where("host is not null and log is not null")
    return src.groupBy("host").applyInPandasWithState(_pairs, _OUT, "last string", "append", GroupStateTimeout.NoTimeout)


def stream_counts(pairs: DataFrame, folder: str, checkpoint: str, available_now: bool = True):
    """Starts a query that writes the (state, next, cnt) of each micro-batch of `transition_pairs`
    to `folder`, one part for each batch, so a batch that is tried again replaces its own part."""

    def add(batch: DataFrame, number: int) -> None:
        counts = batch.groupBy("state", "next").agg(F.count("*").alias("cnt"))
        counts.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    writer = pairs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_counts(spark: SparkSession, folder: str) -> DataFrame:
    """(state, next, cnt) over all batches so far; `markov.probabilities` reads it."""
    return spark.read.parquet(folder).groupBy("state", "next").agg(F.sum("cnt").alias("cnt"))
