"""Inputs that the queries share, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sequences import to_sequences
from ..sources.tables import table


def r6(c: str | Column, name: str | None = None) -> Column:
    """Rounded to 6 digits, without negative zero."""
    return (F.round(c, 6) + F.lit(0.0)).alias(name or c)


def sequences(spark: SparkSession, d: str) -> DataFrame:
    """A user's event types by time."""
    return to_sequences(table(spark, d, "events"), "user_id", "ts", "event_id", "event_type")


def user_days(spark: SparkSession, d: str) -> DataFrame:
    """(txn, item): event types of a user on a day."""
    return table(spark, d, "events").select(F.concat_ws("@", "user_id", F.to_date("ts")).alias("txn"), F.col("event_type").alias("item")).distinct()


SEQ = "seq as (select user_id as host, row_number() over (partition by user_id order by ts, event_id) as pos, event_type as log, ts from events)"
BASKETS = "b as (select distinct concat_ws('@', user_id, cast(ts as date)) as txn, event_type as item from events)"
