"""Joins with keys of which one may hold a third of all rows.

A key is hot if it holds more than half a partition's share of the rows; at most 2 x partitions keys
can, so their table has a proven bound. Rows of a hot key are spread by a hash over several tasks,
and the other side's rows of that key are copied to each of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..staging import shuffle_partitions

#: Rows that one task joins without trouble; no key with fewer is spread.
HOT_ROWS = 1_000_000


def hot_keys(df: DataFrame, keys: list[str], rows: int) -> DataFrame | None:
    """(keys, salts) of the hot keys of `df`, of which `rows` is the number of rows; None without any."""
    parts = shuffle_partitions(df.sparkSession)
    if rows < HOT_ROWS or parts < 2:
        return None
    n = F.col("__n")
    counts = df.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("__n"))
    hot = counts.where((n * 2 * parts > F.lit(rows)) & (n >= F.lit(HOT_ROWS))).select(*keys, F.least(F.lit(parts), F.ceil(n * 2 * parts / F.lit(max(rows, 1)))).cast("int").alias("salts"))
    found = hot.collect()  # at most 2 x partitions rows
    return df.sparkSession.createDataFrame(found, hot.schema) if found else None


def _salt_by(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString() and not isinstance(f.dataType, T.VariantType)]


def skew_join(many: DataFrame, one: DataFrame, keys: list[str], how: str = "inner", rows: int | None = None) -> DataFrame:
    """`many.join(one, keys, how)` (inner, left, left_semi or left_anti), with the hot keys of `many`
    spread over tasks. `many` is staged, as its keys are counted first; `rows` is its number of rows,
    counted if it isn't known. Rows with a null key match nothing and are spread too."""
    rows = many.count() if rows is None else rows
    hot = hot_keys(many, keys, rows)
    if hot is None:
        return many.join(one, keys, how)
    no_key = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    salts = F.when(no_key, F.lit(shuffle_partitions(many.sparkSession))).otherwise(F.coalesce("salts", F.lit(1)))
    mine = F.pmod(F.xxhash64(*_salt_by(many)), salts).cast("int")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))
    left = many.join(F.broadcast(hot), keys, "left").withColumn("__salt", mine).drop("salts")
    right = one.join(F.broadcast(hot), keys, "left").withColumn("__salt", copies).drop("salts")
    return left.join(right, [*keys, "__salt"], how).drop("__salt")
