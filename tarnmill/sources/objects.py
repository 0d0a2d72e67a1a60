"""Object paths of the form <customer>/<text>-<stamp>-<text>, filtered before reading."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Form of the stamp in an object's name (fixed value).
STAMP = "yyyyMMdd'T'HHmmss.SSSSSS'Z'"


def customer_of(name: Column) -> Column:
    return F.when(F.instr(name, "/") > 0, F.substring_index(name, "/", 1))


def stamp_of(name: Column) -> Column:
    """Second piece between hyphens as a stamp; null if it is none."""
    text = F.get(F.split(name, "-"), F.lit(1))
    form = r"^(\d{8}T\d{6})\.(\d{1,6})Z$"
    # Fewer digits of a second are padded to the six that the format has.
    whole = F.concat(F.regexp_extract(text, form, 1), F.lit("."), F.rpad(F.regexp_extract(text, form, 2), 6, "0"), F.lit("Z"))
    return F.try_to_timestamp(F.when(text.rlike(form), whole), F.lit(STAMP)).cast("timestamp_ntz")


def filter_paths(names: DataFrame, column: str, customer: str | list[str] | None = None, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """Names with a valid stamp, of the customer or customers, within inclusive bounds."""
    c = F.col(column)
    keep = stamp_of(c).isNotNull()
    if isinstance(customer, str):
        keep &= customer_of(c) == customer
    elif isinstance(customer, (list, tuple, set)):
        keep &= customer_of(c).isin(*customer)
    if start is not None:
        keep &= stamp_of(c) >= F.lit(start).cast("timestamp_ntz")
    if end is not None:
        keep &= stamp_of(c) <= F.lit(end).cast("timestamp_ntz")
    return names.where(keep)


def read_filtered(spark: SparkSession, fmt: str, names: DataFrame, column: str, prefix: str, **bounds) -> DataFrame:
    """Reads the objects that pass `filter_paths`, as <prefix>/<name>. The list of paths is what a
    reader takes, so it is brought to the driver; for very many objects use a partitioned layout."""
    paths = [f"{prefix.rstrip('/')}/{r[0]}" for r in filter_paths(names, column, **bounds).select(column).collect()]
    if not paths:
        raise ValueError("no object passes the filter")
    return spark.read.format(fmt).load(paths)
