"""Time series and network queries, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import network, timeseries
from ..sources.tables import table
from .base import r6

_NETS = [
    (1, "10.0.5.0/24", {"name": "five", "zone": "a"}), (2, "10.0.7.0/24", {"name": "seven"}), (3, "10.0.64.0/18", {"name": "upper", "zone": "b"}),
    (4, "10.0.0.0/16", {"name": "wide", "zone": "c"}), (7, "10.128.0.0/10", {"name": "half", "zone": "d"}), (8, "10.128.0.0/9", {"name": "more"}), (5, "10.0.5.128/25", {"name": "late"}), (6, "192.168.0.0/16", {"name": "none"}),
]


def hourly(spark: SparkSession, d: str) -> DataFrame:
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")
    return table(spark, d, "events").groupBy(hour).agg(F.count("*").alias("n"))


def split_weeks(spark: SparkSession, d: str) -> DataFrame:
    return timeseries.split_weeks(hourly(spark, d), "ts", "n").drop("slot")


def week_slots_days(spark: SparkSession, d: str) -> DataFrame:
    daily = table(spark, d, "events").groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts")).agg(F.count("*").alias("n"))
    return timeseries.week_slots(daily, "ts", "n", "days").select("week", timeseries.slot_label(F.col("slot"), "days").alias("label"), "value")


def split_overlapping_weeks(spark: SparkSession, d: str) -> DataFrame:
    return timeseries.split_overlapping_weeks(hourly(spark, d), "ts", "n", 12).drop("slot")


def extend_dates(spark: SparkSession, d: str) -> DataFrame:
    daily = table(spark, d, "events").select(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts")).distinct()
    return timeseries.extend_dates(daily, "ts", 10)


def _ips(spark: SparkSession, d: str) -> DataFrame:
    """(id, ip): addresses of hosts as they are registered, addresses made of events, and odd ones."""
    made = table(spark, d, "events").select(F.col("event_id").cast("string").alias("id"), F.concat_ws(".", F.lit("10"), F.floor(F.col("user_id") / 256) % 256, F.col("user_id") % 256, F.col("event_id") % 256).alias("ip"))
    odd = spark.createDataFrame([("-1", None), ("-2", "999.1.1.1"), ("-3", "::1"), ("-4", "172.16.0.9"), ("-5", "10.01.0.1")], "id string, ip string")
    return made.unionByName(table(spark, d, "host_inventory").select(F.col("host_id").alias("id"), "ip")).unionByName(odd)


def _nets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_NETS, "prio int, cidr string, attrs map<string,string>")


def check_ip(spark: SparkSession, d: str) -> DataFrame:
    return _ips(spark, d).select("id", network.check_ip(F.col("ip")).alias("ip"), network.ip_number(F.col("ip")).alias("num"))


def find_subnet(spark: SparkSession, d: str) -> DataFrame:
    return network.find_subnets(_ips(spark, d), "ip", _nets(spark))


def append_network_data(spark: SparkSession, d: str) -> DataFrame:
    return network.append_network_data(_ips(spark, d), "ip", _nets(spark), ["name", "zone", "absent"])


def subnet_members(spark: SparkSession, d: str) -> DataFrame:
    return network.subnet_members(_ips(spark, d), "ip", _nets(spark))


def lookup_subnets(spark: SparkSession, d: str) -> DataFrame:
    """Addresses that no known subnet holds, asked for at a provider that knows networks of 16 bits."""

    def provider(addresses):
        for a in addresses:
            net = ".".join(a.split(".")[:2])
            yield f"{net}.0.0/16", {"name": f"net {net}"}

    found = network.lookup_subnets(_ips(spark, d), "ip", provider, _nets(spark))
    return found.select("prio", "cidr", F.col("attrs")["name"].alias("name"))


def _scans(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("event_id") % 3 == 0, "connected").when(F.col("event_id") % 3 == 1, "refused")
    e = table(spark, d, "events")
    ip = F.concat_ws(".", F.lit("10"), F.lit("0"), F.floor(F.col("user_id") / 256) % 256, F.col("user_id") % 256)
    return e.select(ip.alias("ip"), (F.col("event_id") % 23 + 20).cast("int").alias("port"), status.alias("status"))


def port_summary(spark: SparkSession, d: str) -> DataFrame:
    return network.port_summary(_scans(spark, d))


def port_status(spark: SparkSession, d: str) -> DataFrame:
    """Every address with each of the default ports."""
    return network.port_status(_scans(spark, d))


def week_minutes(spark: SparkSession, d: str) -> DataFrame:
    """Events of each minute, by week and minute of the week."""
    minute = table(spark, d, "events").groupBy(F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("ts")).agg(F.count("*").alias("n"))
    return timeseries.week_slots(minute, "ts", "n", "minutes").select("week", timeseries.slot_label(F.col("slot"), "minutes").alias("label"), "value")


def queries() -> dict:
    names = "hourly split_weeks week_slots_days split_overlapping_weeks extend_dates check_ip find_subnet append_network_data subnet_members lookup_subnets port_summary port_status week_minutes".split()
    return {n: globals()[n] for n in names}


_SLOTS = """with h as (select date_trunc('hour', ts) as ts, count(*) as n from events group by 1),
f as (select min(date_trunc('week', ts)) as first from h),
s as (select (datediff('day', first, date_trunc('week', ts)) // 7)::int as week, ((isodow(ts) - 1) * 24 + hour(ts))::int as slot, n from h, f),
lab as (select i as slot, ['monday','tuesday','wednesday','thursday','friday','saturday','sunday'][i // 24 + 1] || '-' || lpad((i % 24)::varchar, 2, '0') || ':00' as label from (select unnest(range(168)) as i))
"""
_WEEKS = ", ".join(f"max(case when week = {w} then n end) as week_{w}" for w in range(5))
_NET_SQL = """with ips as (select event_id::varchar as id, concat_ws('.', 10, user_id // 256 % 256, user_id % 256, event_id % 256) as ip from events union all select host_id, ip from host_inventory
  union all select * from (values ('-1', null), ('-2', '999.1.1.1'), ('-3', '::1'), ('-4', '172.16.0.9'), ('-5', '10.01.0.1')) v(id, ip)),
nets as (select * from (values (1, '10.0.5.0/24', 'five', 'a'), (2, '10.0.7.0/24', 'seven', null), (3, '10.0.64.0/18', 'upper', 'b'), (4, '10.0.0.0/16', 'wide', 'c'), (7, '10.128.0.0/10', 'half', 'd'), (8, '10.128.0.0/9', 'more', null), (5, '10.0.5.128/25', 'late', null), (6, '192.168.0.0/16', 'none', null)) v(prio, cidr, name, zone)),
num as (select id, ip, case when regexp_full_match(ip, '((0|[1-9][0-9]?|1[0-9][0-9]|2[0-4][0-9]|25[0-5])\\.){3}(0|[1-9][0-9]?|1[0-9][0-9]|2[0-4][0-9]|25[0-5])')
  then split_part(ip, '.', 1)::bigint * 16777216 + split_part(ip, '.', 2)::bigint * 65536 + split_part(ip, '.', 3)::bigint * 256 + split_part(ip, '.', 4)::bigint end as num from ips),
r as (select *, split_part(split_part(cidr, '/', 1), '.', 1)::bigint * 16777216 + split_part(cidr, '.', 2)::bigint * 65536 + split_part(cidr, '.', 3)::bigint * 256 + split_part(split_part(cidr, '/', 1), '.', 4)::bigint as lo,
  (1::bigint << (32 - split_part(cidr, '/', 2)::int)) as wide from nets),
hit as (select distinct ip, cidr, name, zone, prio from num join r on num >= lo and num < lo + wide qualify row_number() over (partition by ip order by prio) = 1)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "hourly": "select date_trunc('hour', ts)::timestamp as ts, count(*) as n from events group by 1",
        "split_weeks": _SLOTS + f"select label, {_WEEKS} from s join lab using (slot) group by label",
        "week_slots_days": """with h as (select cast(ts as date) as ts, count(*) as n from events group by 1), f as (select min(date_trunc('week', ts)) as first from h)
            select (datediff('day', first, date_trunc('week', ts)) // 7)::int as week, lower(dayname(ts)) as label, n as value from h, f""",
        "split_overlapping_weeks": _SLOTS + f""", l as (select max(week) as last from s), x as (select week, slot, '' as sign, n from s
              union all select week + 1, slot, '-', n from s, l where slot >= 156 and week + 1 <= last union all select week - 1, slot, '+', n from s where slot < 12 and week > 0)
            select sign || label as label, {_WEEKS} from x join lab using (slot) group by 1""",
        "extend_dates": """with t as (select distinct date_trunc('day', ts)::timestamp as ts from events), m as (select min(ts) as lo, max(ts) as hi, count(*) as n from t)
            select ts from t union all select hi + to_microseconds(i * (date_diff('microsecond', lo, hi) // (n - 1))) from m, (select unnest(range(1, 11)) as i)""",
        "check_ip": _NET_SQL + "select id, case when num is not null then ip end as ip, num from num",
        "find_subnet": _NET_SQL + "select ip, cidr from hit",
        "append_network_data": _NET_SQL + "select id, ips.ip, cidr, name, zone, null::varchar as absent from ips left join hit using (ip)",
        "subnet_members": _NET_SQL + "select cidr, count(*) as addresses from hit group by 1",
        "lookup_subnets": _NET_SQL + """, u as (select distinct split_part(ip, '.', 1) || '.' || split_part(ip, '.', 2) as net from num where num is not null and ip not in (select ip from hit))
            select prio::int as prio, cidr, name from nets union all select 1000000, net || '.0.0/16', 'net ' || net from u""",
        "port_summary": "select (event_id % 23 + 20)::int as port, count(*) filter (event_id % 3 = 0) as connected, count(*) filter (event_id % 3 = 1) as refused, count(*) filter (event_id % 3 = 2) as unknown from events group by 1",
        "port_status": """with s as (select concat_ws('.', 10, 0, user_id // 256 % 256, user_id % 256) as ip, (event_id % 23 + 20)::int as port, case event_id % 3 when 0 then 'connected' when 1 then 'refused' end as status from events),
            p as (select unnest([20, 21, 22, 23, 25, 53, 80, 110, 119, 123, 139, 143, 161, 194, 443, 445, 1433, 1521, 3306, 3389, 5432, 8080, 8443]) as port), m as (select ip, port, min(status) as status from s group by 1, 2)
            select ip, port, status from (select distinct ip from s) cross join p left join m using (ip, port)""",
        "week_minutes": """with h as (select date_trunc('minute', ts) as ts, count(*) as n from events group by 1), f as (select min(date_trunc('week', ts)) as first from h)
            select (datediff('day', first, date_trunc('week', ts)) // 7)::int as week, lower(dayname(ts)) || '-' || strftime(ts, '%H:%M') as label, n as value from h, f""",
    }
