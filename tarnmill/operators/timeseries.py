"""Series in long form (ts, value): weeks by calendar slot, and longer date ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
#: Slots in a week.
PERIODS = {"days": 7, "hours": 168, "minutes": 10080}


def slot_label(slot: Column, resampled_at: str = "hours") -> Column:
    """monday, monday-00:00 or monday-00:01."""
    day, per_day = F.array(*map(F.lit, DAYS)), PERIODS[resampled_at] // 7
    name = F.get(day, F.floor(slot / per_day).cast("int"))
    if resampled_at == "days":
        return name
    rest = slot % per_day
    hour, minute = (rest, F.lit(0)) if resampled_at == "hours" else (F.floor(rest / 60), rest % 60)
    two = lambda c: F.lpad(c.cast("int").cast("string"), 2, "0")
    return F.concat(name, F.lit("-"), two(hour), F.lit(":"), two(minute))


def week_slots(series: DataFrame, ts: str, value: str, resampled_at: str = "hours") -> DataFrame:
    """(week, slot, value): weeks from 0 at the first one, slots from Monday 00:00; the value of
    several rows in a slot is the lowest. Gaps leave slots out."""
    if resampled_at not in PERIODS:
        raise ValueError("resampled_at must be days, hours or minutes")
    monday = F.date_trunc("week", ts).cast("date")
    slot = {"days": F.weekday(ts), "hours": F.weekday(ts) * 24 + F.hour(ts), "minutes": (F.weekday(ts) * 24 + F.hour(ts)) * 60 + F.minute(ts)}[resampled_at]
    rows = series.where(F.col(ts).isNotNull()).select(monday.alias("monday"), slot.cast("int").alias("slot"), F.col(value).alias("value"))
    first = rows.agg(F.min("monday")).first()[0]
    return rows.groupBy(F.floor(F.datediff("monday", F.lit(first)) / 7).cast("int").alias("week"), "slot").agg(F.min("value").alias("value"))


def _pivot(slots: DataFrame, key: list[str], resampled_at: str) -> DataFrame:
    last = slots.agg(F.max("week")).first()[0]
    weeks = list(range((last if last is not None else -1) + 1))
    cells = [F.max(F.when(F.col("week") == w, F.col("value"))).alias(f"week_{w}") for w in weeks]
    if not cells:
        return slots.select(*key).distinct()
    return slots.groupBy(*key).agg(*cells)


def split_weeks(series: DataFrame, ts: str, value: str, resampled_at: str = "hours") -> DataFrame:
    """(slot, label, week_0, ...): one row for each slot of the week that has any value."""
    wide = _pivot(week_slots(series, ts, value, resampled_at), ["slot"], resampled_at)
    return wide.withColumn("label", slot_label(F.col("slot"), resampled_at))


def split_overlapping_weeks(series: DataFrame, ts: str, value: str, additional: int = 12, resampled_at: str = "hours") -> DataFrame:
    """As `split_weeks`, with the last `additional` slots of the week before (labels from -) and the
    first of the week after (labels from +) in each week's column."""
    n = PERIODS[resampled_at]
    if not 0 <= additional <= n:
        raise ValueError("additional must be from 0 to the slots of a week")
    slots = week_slots(series, ts, value, resampled_at)
    last = slots.agg(F.max("week")).first()[0] or 0
    before = slots.where(F.col("slot") >= n - additional).select((F.col("week") + 1).alias("week"), (F.col("slot") - n).alias("slot"), "value").where(F.col("week") <= last)
    after = slots.where(F.col("slot") < additional).select((F.col("week") - 1).alias("week"), (F.col("slot") + n).alias("slot"), "value").where("week >= 0")
    wide = _pivot(slots.unionByName(before).unionByName(after), ["slot"], resampled_at)
    sign = F.when(F.col("slot") < 0, "-").when(F.col("slot") >= n, "+").otherwise("")
    return wide.withColumn("label", F.concat(sign, slot_label(F.pmod("slot", F.lit(n)), resampled_at)))


def extend_dates(series: DataFrame, ts: str, periods: int) -> DataFrame:
    """(ts): all stamps, and `periods` more at the mean distance. Needs two stamps or more."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    lo, hi, n = series.agg(F.min(micros), F.max(micros), F.count(ts)).first()
    if (n or 0) < 2:
        raise ValueError("two stamps are needed")
    step = (hi - lo) // (n - 1)
    more = series.sparkSession.range(1, periods + 1).select(F.timestamp_micros(F.lit(hi) + F.col("id") * F.lit(step)).cast("timestamp_ntz").alias("ts"))
    return series.select(F.col(ts).cast("timestamp_ntz").alias("ts")).unionByName(more)
