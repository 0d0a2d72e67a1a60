"""Statistics over the star tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import stats
from ..sources.tables import table
from .base import r6

_XS = ["l_quantity", "l_discount", "l_tax"]
_THETA = [10.0, 1500.0, 3.0, -2.0]


def _all6(df: DataFrame) -> DataFrame:
    return df.select(*[r6(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def describe(spark: SparkSession, d: str) -> DataFrame:
    return _all6(stats.describe(table(spark, d, "part"), "p_retailprice"))


def conditional_entropy(spark: SparkSession, d: str) -> DataFrame:
    return _all6(stats.conditional_entropy(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus"))


def _sized(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").withColumn("size_class", F.floor(F.col("p_size") / 10).cast("int")).withColumn("half", F.when(F.col("p_size") > 25, "big").otherwise("small"))


def theil_u(spark: SparkSession, d: str) -> DataFrame:
    return _all6(stats.theil_u(_sized(spark, d), "half", "size_class"))


def cramer_v(spark: SparkSession, d: str) -> DataFrame:
    return _all6(stats.cramer_v(_sized(spark, d), "size_class", "half"))


def chi_square_yates(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.when(F.col("l_returnflag") == "A", "a").otherwise("b").alias("x"), F.when(F.col("l_quantity") > 25, "hi").otherwise("lo").alias("y"))
    return _all6(stats.chi_square(rows, "x", "y"))


def corr_ratio(spark: SparkSession, d: str) -> DataFrame:
    return _all6(stats.corr_ratio(table(spark, d, "part"), "p_brand", "p_retailprice"))


def sigmoid(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", r6(stats.sigmoid(F.col("c_acctbal") / 1000), "s"))


def linreg_1d(spark: SparkSession, d: str) -> DataFrame:
    theta, cost = stats.linreg(table(spark, d, "lineitem"), ["l_quantity"], "l_extendedprice")
    return spark.createDataFrame([(round(float(theta[0]), 3), round(float(theta[1]), 3))], "intercept double, slope double")


def linreg_multi(spark: SparkSession, d: str) -> DataFrame:
    theta, cost = stats.linreg(table(spark, d, "lineitem"), _XS, "l_extendedprice")
    return spark.createDataFrame([(c, round(float(t), 3)) for c, t in zip(["1", *_XS], theta)], "term string, weight double")


def ridge(spark: SparkSession, d: str) -> DataFrame:
    theta, cost = stats.linreg(table(spark, d, "lineitem"), _XS, "l_extendedprice", ridge=50.0)
    return spark.createDataFrame([(c, round(float(t), 3)) for c, t in zip(["1", *_XS], theta)], "term string, weight double")


def linreg_cost(spark: SparkSession, d: str) -> DataFrame:
    return stats.linreg_cost(table(spark, d, "lineitem"), _XS, "l_extendedprice", _THETA).select(F.round("cost", 2).alias("cost"))


def linreg_legacy_cost(spark: SparkSession, d: str) -> DataFrame:
    return stats.linreg_legacy_cost(table(spark, d, "lineitem"), _XS, "l_extendedprice", _THETA).select(F.round("cost", 2).alias("cost"))


def bic(spark: SparkSession, d: str) -> DataFrame:
    return stats.bic(table(spark, d, "embeddings"), "embedding", "label").select(F.round("bic", 3).alias("bic"), "clusters")


def fourier(spark: SparkSession, d: str) -> DataFrame:
    days = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.sum("value").alias("v"))
    days = days.select(F.lit("all").alias("series"), F.datediff("day", F.lit("2024-01-01")).alias("t"), "v")
    return stats.fourier_extrapolation(days, "series", "t", "v", 2, 0).select("t", F.round("value", 3).alias("value"))


def fourier_extrapolated(spark: SparkSession, d: str) -> DataFrame:
    days = table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.sum("value").alias("v"))
    days = days.select("event_type", F.datediff("day", F.lit("2024-01-01")).alias("t"), "v")
    return stats.fourier_extrapolation(days, "event_type", "t", "v", 3, 7).select("series", "t", F.round("value", 3).alias("value"))


def rolling_stats(spark: SparkSession, d: str) -> DataFrame:
    out = stats.rolling(table(spark, d, "events").select("user_id", "ts", "event_id", "value"), ["user_id"], ["ts", "event_id"], "value", 12)
    return out.select("event_id", r6("rolling_mean"), r6("rolling_std"))


def ecdf(spark: SparkSession, d: str) -> DataFrame:
    return _all6(stats.ecdf(table(spark, d, "lineitem"), "l_quantity"))


def histogram(spark: SparkSession, d: str) -> DataFrame:
    return _all6(stats.histogram(table(spark, d, "part"), "p_retailprice", 12))


def kde(spark: SparkSession, d: str) -> DataFrame:
    return _all6(stats.kde(table(spark, d, "part"), "p_size", [5, 15, 25, 35, 45], 2.5))


def queries() -> dict:
    names = (
        "describe conditional_entropy theil_u cramer_v chi_square_yates corr_ratio sigmoid linreg_1d linreg_multi ridge linreg_cost linreg_legacy_cost bic "
        "fourier fourier_extrapolated rolling_stats ecdf histogram kde"
    ).split()
    return {n: globals()[n] for n in names}


_SIZED = "s as (select p_size // 10 as size_class, case when p_size > 25 then 'big' else 'small' end as half from part)"


def _cells(src: str, x: str, y: str) -> str:
    return f"""c as (select {x} as x, {y} as y, count(*)::double as n from {src} group by all), cx as (select x, sum(n) as nx from c group by x),
    cy as (select y, sum(n) as ny from c group by y), t as (select sum(n) as total from c),
    f as (select x, y, coalesce(n, 0) as n, nx * ny / total as e, total from cx cross join cy cross join t left join c using (x, y))"""


def _solve(ridge: float) -> str:
    """Least squares of three centred columns by Cramer's rule."""
    c = lambda a, b: f"covar_pop({a}, {b}) * count(*)"
    q, d, t, y = *_XS, "l_extendedprice"
    return f"""with m as (select {c(q, q)} + {ridge} as a, {c(q, d)} as b, {c(q, t)} as c, {c(d, d)} + {ridge} as e, {c(d, t)} as f, {c(t, t)} + {ridge} as i, {c(q, y)} as u, {c(d, y)} as v, {c(t, y)} as w,
        avg({q}) as mq, avg({d}) as md, avg({t}) as mt, avg({y}) as my from lineitem),
        s as (select *, a * (e * i - f * f) - b * (b * i - f * c) + c * (b * f - e * c) as det from m),
        x as (select *, (u * (e * i - f * f) - b * (v * i - f * w) + c * (v * f - e * w)) / det as t1, (a * (v * i - f * w) - u * (b * i - f * c) + c * (b * w - v * c)) / det as t2,
              (a * (e * w - v * f) - b * (b * w - v * c) + u * (b * f - e * c)) / det as t3 from s)
        select unnest(['1', '{q}', '{d}', '{t}']) as term, round(unnest([my - t1 * mq - t2 * md - t3 * mt, t1, t2, t3]), 3) as weight from x"""


def oracle_sql() -> dict[str, str]:
    cost = "round(sum(power(10.0 + 1500.0 * l_quantity + 3.0 * l_discount - 2.0 * l_tax - l_extendedprice, 2)) / (2 * count(*))"
    return {
        "describe": """select count(*)::double as count, round(avg(p_retailprice), 6) as mean, round(stddev_pop(p_retailprice), 6) as std, min(p_retailprice) as min,
            round(quantile_cont(p_retailprice, 0.25), 6) as p25, round(quantile_cont(p_retailprice, 0.5), 6) as p50, round(quantile_cont(p_retailprice, 0.75), 6) as p75, max(p_retailprice) as max from part""",
        "conditional_entropy": f"with {_cells('lineitem', 'l_returnflag', 'l_linestatus')} select round(sum(n / total * ln(ny / n)), 6) as entropy from c join cy using (y), t",
        "theil_u": f"""with {_SIZED}, {_cells('s', 'half', 'size_class')}, h as (select -sum(nx / total * ln(nx / total)) as s from cx, t)
            select round((any_value(s) - sum(n / total * ln(ny / n))) / any_value(s), 6) as u from c join cy using (y), t, h""",
        "cramer_v": f"""with {_SIZED}, {_cells('s', 'size_class', 'half')},
            m as (select sum(power(n - e, 2) / e) as chi2, any_value(total) as n, count(distinct x)::double as r, count(distinct y)::double as k from f),
            p as (select greatest(0, chi2 / n - (k - 1) * (r - 1) / (n - 1)) as phi, r - power(r - 1, 2) / (n - 1) as rc, k - power(k - 1, 2) / (n - 1) as kc from m)
            select round(sqrt(phi / least(rc - 1, kc - 1)), 6) as v from p""",
        "chi_square_yates": f"""with s as (select case when l_returnflag = 'A' then 'a' else 'b' end as x0, case when l_quantity > 25 then 'hi' else 'lo' end as y0 from lineitem), {_cells('s', 'x0', 'y0')}
            select round(sum(power(abs(n - e) - least(0.5, abs(n - e)), 2) / e), 6) as chi2, any_value(total) as n, count(distinct x) as r, count(distinct y) as k from f""",
        "corr_ratio": """with g as (select p_brand, count(*) as n, avg(p_retailprice) as m from part group by 1), a as (select avg(p_retailprice) as mean, var_pop(p_retailprice) * count(*) as total from part)
            select round(sum(n * power(m - mean, 2)) / any_value(total), 6) as eta2 from g, a""",
        "sigmoid": "select c_custkey, round(1 / (1 + exp(-c_acctbal / 1000)), 6) as s from customer",
        "linreg_1d": "select round(regr_intercept(l_extendedprice, l_quantity), 3) as intercept, round(regr_slope(l_extendedprice, l_quantity), 3) as slope from lineitem",
        "linreg_multi": _solve(0),
        "ridge": _solve(50),
        "linreg_cost": f"select {cost}, 2) as cost from lineitem",
        "linreg_legacy_cost": f"select {cost} + 0.25 * (1500.0 * 1500.0 + 13.0), 2) as cost from lineitem",
        "bic": """with v as (select label as c, unnest(embedding)::double as v, unnest(range(64)) as dim from embeddings),
            p as (select c, dim, count(*)::double as n, var_pop(v) as var from v group by all), q as (select c, max(n) as n, sum(n * var) as ss from p group by c),
            g as (select sum(n) as big, count(*)::double as m, sum(ss) / ((sum(n) - count(*)) * 64) as pv from q)
            select round(sum(n * ln(n) - n * ln(big) - n * 64 / 2 * ln(2 * pi() * pv) - (n - 1) * 64 / 2) - 0.5 * any_value(m) * ln(any_value(big)) * 65, 3) as bic, any_value(m)::bigint as clusters from q, g""",
        "fourier": """with s as (select datediff('day', date '2024-01-01', cast(ts as date))::double as t, sum(value) as v from events group by 1),
            r as (select regr_slope(v, t) as b, count(*)::double as n from s), z as (select t, v - b * t as x, n, b from s, r),
            k as (select unnest(range(0, 3))::double as k), co as (select k, any_value(n) as n, sum(x * cos(2 * pi() * k * t / n)) as re, -sum(x * sin(2 * pi() * k * t / n)) as im from z, k group by k)
            select t::bigint as t, round(sum(case when k = 0 then 1 else 2 end * (re * cos(2 * pi() * k * t / z.n) - im * sin(2 * pi() * k * t / z.n)) / z.n) + any_value(b) * t, 3) as value from z, co group by t""",
        "fourier_extrapolated": """with s as (select event_type as series, datediff('day', date '2024-01-01', cast(ts as date))::double as t, sum(value) as v from events group by 1, 2),
            r as (select series, regr_slope(v, t) as b, count(*)::double as n from s group by 1), z as (select series, t, v - b * t as x, n, b from s join r using (series)),
            k as (select unnest(range(0, 4))::double as k), co as (select series, k, any_value(n) as n, any_value(b) as b, sum(x * cos(2 * pi() * k * t / n)) as re, -sum(x * sin(2 * pi() * k * t / n)) as im from z, k group by 1, 2),
            p as (select series, unnest(range(n::bigint + 7)) as t from r)
            select series, t, round(sum(case when k = 0 then 1 else 2 end * (re * cos(2 * pi() * k * t / n) - im * sin(2 * pi() * k * t / n)) / n) + any_value(b) * t, 3) as value from p join co using (series) group by 1, 2""",
        "rolling_stats": """select event_id, round(case when count(*) over w = 12 then avg(value) over w end, 6) as rolling_mean, round(case when count(*) over w = 12 then stddev_samp(value) over w end, 6) as rolling_std
            from events window w as (partition by user_id order by ts, event_id rows between 11 preceding and current row)""",
        "ecdf": "select distinct l_quantity as value, round(cume_dist() over (order by l_quantity), 6) as ecdf from lineitem",
        "histogram": """with m as (select min(p_retailprice) as lo, max(p_retailprice) as hi from part), w as (select lo, (hi - lo) / 12 as wide from m),
            c as (select least(11, floor((p_retailprice - lo) / wide))::int as bin, count(*) as n from part, w group by 1)
            select b::int as bin, round(lo + b * wide, 6) as low, round(lo + (b + 1) * wide, 6) as high, coalesce(n, 0) as n from (select unnest(range(12)) as b) cross join w left join c on bin = b""",
        "kde": """select x::double as x, round(avg(exp(-power((x - p_size) / 2.5, 2) / 2) / (2.5 * sqrt(2 * pi()))), 6) as density from part, (select unnest([5, 15, 25, 35, 45]) as x) group by x""",
    }
