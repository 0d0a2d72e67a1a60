"""Host sequences in long form (host, pos, log), pos dense from 1.

Numbering and neighbours work on blocks of a host's sequence, not on whole hosts, so one host with
a large share of all rows is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import stage
from .indexing import number_rows
from .skew import skew_join

#: Positions of a host in one block.
BLOCK = 1 << 16
#: Rows of a host's day that one task orders.
DAY_ROWS = 1 << 20


def to_sequences(rows: DataFrame, host: str, ts: str, tie: str, log: str) -> DataFrame:
    """Rows with a host, numbered per host by (ts, tie). Rows are numbered within a day first; the
    days' counts, summed up per host, give the offsets. Rows without ts come first.

    If a host has more rows on one day, or without ts, than a task should order, all rows are numbered
    together by ranges instead, and each host's first number is taken off."""
    base = rows.where(F.col(host).isNotNull()).select(F.col(host).alias("host"), F.col(ts).alias("ts"), F.col(tie).alias("tie"), F.col(log).alias("log"), F.to_date(ts).alias("day"))
    days = stage(base.groupBy("host", "day").agg(F.count("*").alias("n")), "host-days")
    if (days.agg(F.max("n")).first()[0] or 0) > DAY_ROWS:
        numbered = number_rows(base, "host", F.asc_nulls_first("ts"), "tie", name="at")
        first = numbered.groupBy("host").agg(F.min("at").alias("first"))
        return skew_join(numbered, first, ["host"]).select("host", (F.col("at") - F.col("first") + 1).cast("int").alias("pos"), "log", "ts")
    before = Window.partitionBy("host").orderBy(F.asc_nulls_first("day")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = days.select("host", F.coalesce("day", F.lit("0001-01-01").cast("date")).alias("key"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    w = Window.partitionBy("host", "key").orderBy(F.asc_nulls_first("ts"), "tie")
    numbered = base.withColumn("key", F.coalesce("day", F.lit("0001-01-01").cast("date"))).withColumn("rn", F.row_number().over(w))
    return numbered.join(offsets, ["host", "key"]).select("host", (F.col("rn") + F.col("offset")).cast("int").alias("pos"), "log", "ts")


def following(seq: DataFrame, k: int, payload: list[str]) -> DataFrame:
    """`seq` with `next1` to `nextk`: structs of the payload of the next rows of the host, else null.

    The first k rows of a block are sent to the block before as well, so one shuffle by
    (host, block) is enough.
    """
    block = F.floor((F.col("pos") - 1) / BLOCK)
    homes = F.when(((F.col("pos") - 1) % BLOCK < k) & (block > 0), F.array(block, block - 1)).otherwise(F.array(block))
    w = Window.partitionBy("host", "__block").orderBy("pos")
    item = F.struct(*payload)
    spread = seq.withColumn("__block", F.explode(homes))
    return (
        spread.select("*", *[F.lead(item, j).over(w).alias(f"next{j}") for j in range(1, k + 1)])
        .where(F.col("__block") == block)
        .drop("__block")
    )


def ngrams(seq: DataFrame, n: int) -> DataFrame:
    """(host, log): sliding n-grams joined by a vertical bar; hosts shorter than n give none."""
    if n == 1:
        return seq.select("host", F.col("log").cast("string").alias("log"))
    f = following(seq, n - 1, ["log"]).where(F.col(f"next{n - 1}").isNotNull())
    return f.select("host", F.concat_ws("|", "log", *[F.col(f"next{j}.log") for j in range(1, n)]).alias("log"))


def sliding_windows(arr: Column, n: int, fill: Column, step: int = 1) -> Column:
    """Windows of n elements every `step`, as arrays. The first is always there, padded with `fill`
    if the array is short; a last padded one follows if elements are left that lie in no window and
    it would hold at least one element not skipped by the step."""
    if n < 0 or step < 1:
        raise ValueError("n must not be negative and step must be positive")
    if n == 0:
        return F.array(F.array().cast("array<int>"))
    size = F.size(arr)
    full = F.when(size >= n, F.floor((size - n) / step)).otherwise(0).cast("int")
    pad = lambda a: F.slice(F.concat(a, F.array_repeat(fill, n)), 1, n)
    windows = F.transform(F.sequence(F.lit(0), full), lambda i: pad(F.slice(arr, i * step + 1, n)))
    rest = (size - n) % step
    tail = (size > n) & (rest > 0) & (F.lit(step) - rest < n)
    return F.when(tail, F.concat(windows, F.array(pad(F.slice(arr, (full + 1) * step + 1, n))))).otherwise(windows)


def batches(arr: Column, n: int) -> Column:
    """Slices of n elements that don't overlap; the last may be short; an empty array gives none."""
    if n < 1:
        raise ValueError("n must be positive")
    count = F.ceil(F.size(arr) / n).cast("int")
    return F.when(F.size(arr) > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(arr, i * n + 1, n))).otherwise(
        F.transform(F.array().cast("array<int>"), lambda i: F.slice(arr, 1, n))
    )


def flat_map(arr: Column, f) -> Column:
    """Elements of the arrays that `f` gives for the elements of `arr`."""
    return F.flatten(F.transform(arr, f))


def unique_items(rows: DataFrame, items: str, dtype: str | None = None) -> DataFrame:
    """Distinct items over all arrays; cast after, and made distinct again."""
    found = rows.select(F.explode(items).alias("item")).distinct()
    return found.select(F.expr(f"try_cast(item as {dtype})").alias("item")).distinct() if dtype else found
