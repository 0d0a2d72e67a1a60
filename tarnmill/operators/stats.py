"""Association, regression, distribution and signal statistics as aggregates."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..staging import stage
from .indexing import number_rows
from .skew import skew_join


def counted_values(df: DataFrame, value: str, groups: list[str] | None = None) -> DataFrame:
    """(groups, value, n, upto, size), staged: the distinct values of each group with their counts, the
    rows up to and with them, and all rows of the group. Nulls are left out.

    Counts are merged before the shuffle; their running sums go by ranges of (group, value), so neither
    a large group nor a column of very many values is one task.
    """
    groups = groups or []
    rows = df.where(F.col(value).isNotNull()).groupBy(*groups, F.col(value).alias("value")).agg(F.count("*").alias("n"))
    ranged = stage(rows.repartitionByRange(*groups, "value").withColumn("__part", F.spark_partition_id()), "value-counts")
    parts = ranged.groupBy(*groups, "__part").agg(F.sum("n").alias("m"))
    w = Window.partitionBy(*groups)
    before = F.sum("m").over(w.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    shifts = parts.select(*groups, "__part", F.coalesce(before, F.lit(0)).alias("__shift"), F.sum("m").over(w).alias("size"))
    run = F.sum("n").over(Window.partitionBy(*groups, "__part").orderBy("value"))
    same = [F.col(f"c.{g}").eqNullSafe(F.col(f"s.{g}")) for g in groups] + [F.col("c.__part") == F.col("s.__part")]
    placed = ranged.withColumn("__run", run).alias("c").join(shifts.alias("s"), reduce(lambda x, y: x & y, same))
    return placed.select(*[f"c.{g}" for g in groups], "value", "n", (F.col("__run") + F.col("__shift")).alias("upto"), "size")


def quantiles(df: DataFrame, value: str, shares: list[float], groups: list[str] | None = None) -> DataFrame:
    """(groups, q array<double>): exact quantiles, interpolated between neighbours."""
    picks = []
    for share in shares:
        at = F.lit(float(share)) * (F.col("size") - 1)
        low = F.min(F.when(F.col("upto") > F.floor(at), F.col("value").cast("double")))
        high = F.min(F.when(F.col("upto") > F.ceil(at), F.col("value").cast("double")))
        part = F.first(at - F.floor(at))
        picks.append(low + (high - low) * part)
    counted = counted_values(df, value, groups)
    return counted.groupBy(*(groups or [])).agg(F.array(*picks).alias("q"))


def modes(df: DataFrame, value: str, groups: list[str]) -> DataFrame:
    """(groups, value): the commonest value of each group, the lowest among equals."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*groups, F.col(value).alias("value")).agg(F.count("*").alias("n"))
    return counts.groupBy(*groups).agg(F.min(F.struct((-F.col("n")).alias("n"), "value"))["value"].alias("value"))


def describe(df: DataFrame, value: str) -> DataFrame:
    """One row: count, mean, population std, min, quartiles (interpolated), max. Nulls are left out;
    a column that is not numeric is refused."""
    if not isinstance(df.schema[value].dataType, T.NumericType):
        raise ValueError("describe needs a numeric column")
    v = F.col(value).cast("double")
    figures = df.agg(F.count(v).cast("double").alias("count"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    q = quantiles(df, value, [0.25, 0.5, 0.75]).select("q").scalar()
    return figures.withColumn("q", q).select("count", "mean", "std", "min", F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75"), "max")


def _cells(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").cast("double").alias("n"))


def _entropies(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row (s, s_xy): the entropy of x, and of x given y."""
    cells = _cells(df, x, y)
    by_y, by_x = cells.groupBy("y").agg(F.sum("n").alias("ny")), cells.groupBy("x").agg(F.sum("n").alias("nx"))
    # S(x|y) = (sum ny ln ny - sum n ln n) / N; S(x) = ln N - sum nx ln nx / N.
    term = lambda c: F.sum(F.col(c) * F.log(c))
    one = cells.agg(term("n").alias("a"), F.sum("n").alias("all"))
    b, c = by_y.agg(term("ny")).scalar(), by_x.agg(term("nx")).scalar()
    return one.select((F.log("all") - c / F.col("all")).alias("s"), ((b - F.col("a")) / F.col("all")).alias("s_xy"))


def conditional_entropy(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row (entropy): of x given y, natural logarithm."""
    return _entropies(df, x, y).select(F.col("s_xy").alias("entropy"))


def theil_u(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row (u): share of the entropy of x that y explains; 1 if x has one value."""
    e = _entropies(df, x, y)
    return e.select(F.when(F.abs("s") < 1e-12, F.lit(1.0)).otherwise((F.col("s") - F.col("s_xy")) / F.col("s")).alias("u"))


def chi_square(df: DataFrame, x: str, y: str, yates: bool = True) -> DataFrame:
    """One row (chi2, n, r, k). Empty cells count; a two-by-two table has Yates' correction, at most
    the difference itself. chi2 = sum over all cells; those without rows add their expectation."""
    cells = _cells(df, x, y)
    by_x, by_y = cells.groupBy("x").agg(F.sum("n").alias("nx")), cells.groupBy("y").agg(F.sum("n").alias("ny"))
    full = cells.join(by_x, "x").join(by_y, "y").withColumns(
        {"r": by_x.agg(F.count("*")).scalar(), "k": by_y.agg(F.count("*")).scalar(), "n_all": by_x.agg(F.sum("nx")).scalar()}
    )
    e = F.col("nx") * F.col("ny") / F.col("n_all")
    diff = F.abs(F.col("n") - e)
    two = (F.col("r") == 2) & (F.col("k") == 2)
    shift = F.when(two, F.least(diff, F.lit(0.5))).otherwise(0.0) if yates else F.lit(0.0)
    seen = F.sum((diff - shift) * (diff - shift) / e)
    # An empty cell of a table without correction adds e; the expectations of all cells sum to n.
    # In a two-by-two table an empty cell is added on its own, as it is corrected too.
    agg = full.groupBy("r", "k", "n_all").agg(seen.alias("seen"), F.sum(e).alias("e_seen"), F.count("*").alias("cells"))
    rest = F.col("n_all") - F.col("e_seen")
    if yates:
        empty = rest - F.least(rest, F.lit(0.5))
        rest = F.when(two & (F.col("cells") == 3), empty * empty / rest).otherwise(rest)
    rest = F.when(F.col("cells") == F.col("r") * F.col("k"), 0.0).otherwise(rest)
    return agg.select((F.col("seen") + rest).alias("chi2"), F.col("n_all").alias("n"), "r", "k")


def cramer_v(df: DataFrame, x: str, y: str, yates: bool = True) -> DataFrame:
    """One row (v): bias-corrected Cramer's V; NaN if either column has one value."""
    c = chi_square(df, x, y, yates)
    n, r, k = F.col("n"), F.col("r").cast("double"), F.col("k").cast("double")
    phi = F.greatest(F.lit(0.0), F.col("chi2") / n - (k - 1) * (r - 1) / (n - 1))
    rc, kc = r - (r - 1) * (r - 1) / (n - 1), k - (k - 1) * (k - 1) / (n - 1)
    least = F.least(rc - 1, kc - 1)
    return c.select(F.when(least > 0, F.sqrt(phi / least)).otherwise(F.lit(float("nan"))).alias("v"))


def corr_ratio(df: DataFrame, category: str, value: str) -> DataFrame:
    """One row (eta2): sum of squares between categories over that of all rows; 0 if the first is 0.
    Rows with a null category are in no group, but in the total."""
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull())
    groups = rows.groupBy(F.col(category).alias("c")).agg(F.count("*").cast("double").alias("n"), F.avg(v).alias("m"), F.var_pop(v).alias("var"))
    mean = groups.agg(F.sum(F.col("n") * F.col("m")) / F.sum("n")).scalar()
    d2 = F.col("n") * F.pow(F.col("m") - F.col("mean"), 2)
    sums = groups.withColumn("mean", mean).agg(F.sum(F.when(F.col("c").isNotNull(), d2)).alias("between"), F.sum(d2 + F.col("n") * F.col("var")).alias("total"))
    return sums.select(F.when(F.coalesce("between", F.lit(0.0)) == 0, 0.0).otherwise(F.col("between") / F.col("total")).alias("eta2"))


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _moments(df: DataFrame, xs: list[str], y: str) -> tuple[np.ndarray, np.ndarray, float]:
    """X'X with a leading column of ones, X'y and y'y, by one aggregate; rows with nulls are left out."""
    cols = [F.lit(1.0), *[F.col(c).cast("double") for c in xs]]
    t = F.col(y).cast("double")
    whole = df.dropna(subset=[*xs, y])
    k = len(cols)
    parts = [F.sum(cols[i] * cols[j]) for i in range(k) for j in range(i, k)] + [F.sum(c * t) for c in cols] + [F.sum(t * t)]
    row = [float(v or 0.0) for v in whole.agg(*[p.alias(f"m{i}") for i, p in enumerate(parts)]).first()]
    xx, at = np.zeros((k, k)), 0
    for i in range(k):
        for j in range(i, k):
            xx[i, j] = xx[j, i] = row[at]
            at += 1
    return xx, np.array(row[at : at + k]), row[-1]


def linreg(df: DataFrame, xs: list[str], y: str, ridge: float = 0.0) -> tuple[np.ndarray, float]:
    """(theta, cost): least squares with intercept first; with `ridge` its penalty spares the
    intercept. cost = half the mean squared error, plus ridge / 2n times the squared weights."""
    xx, xy, yy = _moments(df, xs, y)
    n = max(xx[0, 0], 1.0)
    lam = ridge * np.eye(len(xy))
    lam[0, 0] = 0.0
    theta = np.linalg.pinv(xx + lam) @ xy
    cost = (yy - 2 * theta @ xy + theta @ xx @ theta) / (2 * n) + ridge * float(theta[1:] @ theta[1:]) / (2 * n)
    return theta, float(cost)


def linreg_cost(df: DataFrame, xs: list[str], y: str, theta: list[float]) -> DataFrame:
    """One row (cost): half the mean squared error of an intercept and weights."""
    pred = sum((F.col(c).cast("double") * F.lit(float(t)) for c, t in zip(xs, theta[1:])), F.lit(float(theta[0])))
    return df.dropna(subset=[*xs, y]).agg((F.sum(F.pow(pred - F.col(y), 2)) / (2 * F.count("*"))).alias("cost"))


def linreg_legacy_cost(df: DataFrame, xs: list[str], y: str, theta: list[float]) -> DataFrame:
    """One row (cost): as `linreg_cost`, plus a quarter of the squared weights whatever the penalty."""
    extra = 0.25 * sum(float(t) ** 2 for t in theta[1:])
    return linreg_cost(df, xs, y, theta).select((F.col("cost") + F.lit(extra)).alias("cost"))


def bic(df: DataFrame, vector: str, cluster: str) -> DataFrame:
    """One row (bic, clusters): Bayesian information criterion of a clustering, higher is better."""
    dims = df.where(F.col(vector).isNotNull() & F.col(cluster).isNotNull()).select(F.col(cluster).alias("c"), F.posexplode(vector).alias("dim", "v"))
    per = dims.groupBy("c", "dim").agg(F.count("*").cast("double").alias("n"), F.var_pop(F.col("v").cast("double")).alias("var"))
    per_c = per.groupBy("c").agg(F.max("n").alias("n"), F.sum(F.col("n") * F.col("var")).alias("ss"), F.count("*").cast("double").alias("d"))
    g = per_c.agg(F.sum("n").alias("rows"), F.count("*").cast("double").alias("m"), F.sum("ss").alias("ss"), F.max("d").alias("d"))
    var = F.col("ss") / ((F.col("rows") - F.col("m")) * F.col("d"))
    g = g.withColumn("pv", var)
    j = per_c.select("n").withColumns({c: g.select(c).scalar() for c in ("rows", "m", "d", "pv")})
    n, d = F.col("n"), F.col("d")
    part = n * F.log(n) - n * F.log("rows") - n * d / 2 * F.log(2 * math.pi * F.col("pv")) - (n - 1) * d / 2
    return j.groupBy("rows", "m", "d").agg(F.sum(part).alias("s")).select((F.col("s") - 0.5 * F.col("m") * F.log("rows") * (d + 1)).alias("bic"), F.col("m").cast("long").alias("clusters"))


def fourier_extrapolation(df: DataFrame, series: str, t: str, value: str, harmonics: int = 25, predict: int = 0) -> DataFrame:
    """(series, t, value): each series, without its trend, as the sum of its lowest harmonics over its n
    points (t = 0..n-1, in the order of t) and `predict` more, with the trend added again.

    A harmonic's weight is a sum over the points, so a series is two aggregates, not one group: first
    its trend, then the cosine and sine sums of harmonics 0 to `harmonics` (at most n / 2).
    """
    src = df.select(F.col(series).cast("string").alias("series"), F.col(t).cast("long").alias("t"), F.col(value).cast("double").alias("value")).dropna()
    numbered = number_rows(src, "series", "t", name="at")
    heads = numbered.groupBy("series").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    points = stage(skew_join(numbered, heads, ["series"]).select("series", (F.col("at") - F.col("first")).alias("t"), "n", "value"), "series-points")
    slopes = points.groupBy("series").agg(F.coalesce(F.regr_slope("value", F.col("t").cast("double")), F.lit(0.0)).alias("slope"))
    flat = skew_join(points, slopes, ["series"]).withColumn("flat", F.col("value") - F.col("slope") * F.col("t"))

    def angle(k: int | Column) -> Column:  # of whole turns only the rest counts
        return F.lit(2 * math.pi) * F.pmod(F.lit(k) * F.col("t") if isinstance(k, int) else k * F.col("t"), F.col("n")) / F.col("n")

    sums = [F.struct(F.lit(k).alias("k"), F.sum(F.col("flat") * F.cos(angle(k))).alias("re"), F.sum(F.col("flat") * F.sin(angle(k))).alias("im")) for k in range(harmonics + 1)]
    waves = stage(flat.groupBy("series", "n", "slope").agg(F.array(*sums).alias("waves")), "series-waves")
    more = waves.select("series", F.explode(F.sequence(F.col("n"), F.col("n") + predict - 1)).alias("t")) if predict > 0 else None
    wanted = points.select("series", "t") if more is None else stage(points.select("series", "t").unionByName(more), "series-wanted")
    full = skew_join(wanted, waves, ["series"])
    # Harmonics k and n - k are one real wave; 0, and n / 2 of an even n, stand alone.
    weight = lambda k: F.when(2 * k > F.col("n"), 0.0).when((k == 0) | (2 * k == F.col("n")), 1.0).otherwise(2.0)
    wave = F.aggregate("waves", F.lit(0.0), lambda s, x: s + weight(x["k"]) * (x["re"] * F.cos(angle(x["k"])) + x["im"] * F.sin(angle(x["k"]))))
    return full.select("series", "t", (wave / F.col("n") + F.col("slope") * F.col("t")).alias("value"))


def rolling(df: DataFrame, keys: list[str], order: list[str], value: str, periods: int = 12, block: int = 1 << 16) -> DataFrame:
    """`df` with rolling mean and sample std over the last `periods` rows of a series, null until
    there are so many. Rows are numbered by (keys, order) and cut into blocks, each with copies of the
    rows just before it, so a long series is spread over tasks."""
    rows = number_rows(df, *keys, *order, name="__at")
    home = F.floor(F.col("__at") / block)
    homes = F.when(F.col("__at") % block > block - periods, F.array(home, home + 1)).otherwise(F.array(home))
    w = Window.partitionBy(*keys, "__block").orderBy("__at").rowsBetween(-(periods - 1), 0)
    full = F.count(value).over(w) == periods
    out = rows.withColumn("__block", F.explode(homes)).withColumn("rolling_mean", F.when(full, F.avg(value).over(w))).withColumn("rolling_std", F.when(full, F.stddev_samp(value).over(w)))
    return out.where(F.col("__block") == home).drop("__block", "__at")


def ecdf(df: DataFrame, value: str) -> DataFrame:
    """(value, ecdf): distinct values with the share of rows up to them, ties together."""
    return counted_values(df, value).select(F.col("value").cast("double").alias("value"), (F.col("upto").cast("double") / F.col("size")).alias("ecdf"))


def histogram(df: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """(bin, low, high, n): equal bins from the least to the greatest value; empty bins are there."""
    lo, hi = df.agg(F.min(value), F.max(value)).first()
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin int, low double, high double, n bigint")
    lo, hi = float(lo), float(hi)
    wide = (hi - lo) / bins or 1.0
    at = F.least(F.lit(bins - 1), F.floor((F.col(value) - F.lit(lo)) / F.lit(wide))).cast("int")
    n = df.where(F.col(value).isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(n, "bin", "left").select("bin", (F.lit(lo) + F.col("bin") * F.lit(wide)).alias("low"), (F.lit(lo) + (F.col("bin") + 1) * F.lit(wide)).alias("high"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def kde(df: DataFrame, value: str, points: list[float], bandwidth: float) -> DataFrame:
    """(x, density): Gaussian kernel density at a few points, over counts per distinct value."""
    rows = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").cast("double").alias("n"))
    x = F.explode(F.array(*[F.lit(float(p)) for p in points]))
    k = F.exp(-F.pow((F.col("x") - F.col("v")) / F.lit(bandwidth), 2) / 2) / F.lit(bandwidth * math.sqrt(2 * math.pi))
    return rows.select("v", "n", x.alias("x")).groupBy("x").agg((F.sum(F.col("n") * k) / F.sum("n")).alias("density"))
