"""String functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance; null if either is null. Meant for short strings: it costs their product."""
    return F.levenshtein(a, b)


def joined_key(*cols: Column) -> Column:
    """Values as one string, joined by vertical bars."""
    return F.concat_ws("|", *[c.cast("string") for c in cols])


def padded_id(prefix: str, number: Column, digits: int = 7) -> Column:
    return F.concat(F.lit(prefix), F.lpad(number.cast("string"), digits, "0"))


def seeded(seed: int | str, *cols: Column) -> Column:
    """A number from 0 to 2^60 - 1 that a seed and values fix: the first 15 hex digits of the MD5 of
    them, joined by vertical bars. The same in any engine that has MD5."""
    text = F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")
