"""Sampling and sorting with results that a seed fixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import seeded
from ..staging import small, stage
from .indexing import number_rows

#: Buckets that a class's rows are ranked in.
BUCKETS = 256


def class_size(sizes: DataFrame, how: str = "both", fixed_size: int | None = None) -> int:
    """Rows for each class: `up` the largest class, `down` the smallest, `both` the median (floor)."""
    if how not in ("up", "down", "both"):
        raise ValueError("how must be up, down or both")
    if fixed_size is not None:
        return fixed_size
    lo, hi, mid = sizes.agg(F.min("n"), F.max("n"), F.percentile("n", F.lit(0.5))).first()
    return int({"up": hi, "down": lo, "both": mid}[how] or 0)


def balanced_sample(df: DataFrame, stratum: str, key: str, how: str = "both", fixed_size: int | None = None, seed: int = 0, replace: bool = True) -> DataFrame:
    """`df` resampled so that each class of `stratum` has the same number of rows.

    Rows of a class are ranked by a seeded hash of `key`, in buckets, so that no task ranks a whole
    class. Without replacement the lowest ranks are taken, and a class with too few rows is an
    error; with it, each of the class's draws takes the row of a seeded random rank. Rows with a
    null class are left out.
    """
    rows = df.where(F.col(stratum).isNotNull())
    h = seeded(seed, F.col(key))
    placed = rows.withColumn("__h", h).withColumn("__b", F.floor(h / F.lit(float((1 << 60) // BUCKETS))).cast("int"))
    in_bucket = stage(placed.groupBy(F.col(stratum).alias("__c"), "__b").agg(F.count("*").alias("m")), "strata")
    sizes = in_bucket.groupBy("__c").agg(F.sum("m").alias("n"))
    size = class_size(sizes, how, fixed_size)
    if not replace and sizes.where(F.col("n") < size).take(1):
        raise ValueError("a class has fewer rows than are to be taken from it")
    before = F.sum("m").over(Window.partitionBy("__c").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    offsets = in_bucket.select("__c", "__b", F.coalesce(before, F.lit(0)).alias("__o"))
    w = Window.partitionBy(stratum, "__b").orderBy("__h", key)
    ranked = (
        placed.withColumn("__rn", F.row_number().over(w))
        .join(offsets, (F.col(stratum) == F.col("__c")) & (placed["__b"] == offsets["__b"]))
        .withColumn("__rank", F.col("__rn") + F.col("__o"))
        .drop(offsets["__b"])
    )
    if not replace:
        return ranked.where(F.col("__rank") <= size).select(*df.columns)
    # Draw d of class c is row d x classes + c of one range, which is made in parts.
    classes = stage(number_rows(sizes, "__c", name="__no"), "classes")
    n_classes = classes.count()
    spark = df.sparkSession
    slots = spark.range(size * n_classes).select((F.col("id") % max(n_classes, 1)).alias("__no"), (F.floor(F.col("id") / max(n_classes, 1)) + 1).cast("int").alias("__d"))
    draws = slots.join(small(classes, n_classes, 64), "__no")
    draws = draws.select(F.col("__c").alias("__dc"), (F.pmod(seeded(seed + 1, F.col("__c"), F.col("__d")), F.col("n")) + 1).alias("__rank"))
    return ranked.join(draws, (F.col("__c") == F.col("__dc")) & (ranked["__rank"] == draws["__rank"])).select(*[ranked[c] for c in df.columns])


def sorted_values(df: DataFrame, column: str, *ties: str) -> DataFrame:
    """Rows in ascending order of a column, NaN after all numbers, nulls last; equal values by `ties`."""
    return df.orderBy(F.asc_nulls_last(column), *ties)
