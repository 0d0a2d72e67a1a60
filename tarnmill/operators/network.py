"""IPv4 addresses, subnets and port scans."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import small, stage
from .skew import skew_join

_OCTET = r"(0|[1-9]\d?|1\d\d|2[0-4]\d|25[0-5])"
_IP = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"


def ip_number(ip: Column, error_bad_ip: bool = False) -> Column:
    """The address as a number; null, or an error, for what is no IPv4 address (leading zeros too)."""
    text = ip.cast("string")
    parts = [F.regexp_extract(text, _IP, i).cast("bigint") for i in range(1, 5)]
    good = parts[0] * F.lit(1 << 24) + parts[1] * F.lit(1 << 16) + parts[2] * F.lit(1 << 8) + parts[3]
    bad = F.raise_error(F.concat(F.lit("not an IPv4 address: "), text)).cast("bigint") if error_bad_ip else F.lit(None).cast("bigint")
    return F.when(text.rlike(_IP), good).otherwise(F.when(text.isNull(), F.lit(None).cast("bigint")).otherwise(bad))


def check_ip(ip: Column, error_bad_ip: bool = False) -> Column:
    """The address if it is valid IPv4, else null or an error."""
    return F.when(ip_number(ip, error_bad_ip).isNotNull(), ip.cast("string"))


def parse_subnets(subnets: DataFrame) -> DataFrame:
    """`subnets` (prio, cidr, ...) with `len` and `net`, the network's number shifted right by 32 - len."""
    length = F.substring_index("cidr", "/", -1).cast("int")
    return subnets.withColumn("len", length).withColumn("net", F.floor(ip_number(F.substring_index("cidr", "/", 1)) / F.pow(F.lit(2.0), F.lit(32) - length)).cast("bigint"))


def find_subnets(ips: DataFrame, ip: str, subnets: DataFrame) -> DataFrame:
    """(ip, cidr): for each distinct valid address the containing subnet with the lowest prio; none
    if there is none. One equi-join on (prefix length, network) instead of a range join: an address
    is tried at each length that some subnet has (at most 33)."""
    nets = stage(parse_subnets(subnets).select("prio", "cidr", "len", "net"), "subnets")
    lengths = sorted(r["len"] for r in nets.select("len").distinct().collect())
    n = nets.count()
    num = ip_number(F.col(ip))
    tries = F.explode(F.array(*[F.struct(F.lit(x).alias("len"), F.floor(F.col("num") / F.lit(float(1 << (32 - x)))).cast("bigint").alias("net")) for x in lengths]))
    found = (
        ips.select(F.col(ip).cast("string").alias("ip"), num.alias("num")).where("num is not null").distinct()
        .select("ip", tries.alias("t")).select("ip", "t.*")
        .join(small(nets, n, 80), ["len", "net"])
    )
    return found.groupBy("ip").agg(F.min(F.struct("prio", "cidr")).alias("b")).select("ip", F.col("b.cidr").alias("cidr"))


def append_network_data(rows: DataFrame, ip: str, subnets: DataFrame, attributes: list[str] | None = None) -> DataFrame:
    """`rows` with `cidr` and the subnet's attributes (from the map `attrs`; all as one map if none
    are named). Bad addresses and addresses without subnet have nulls. Looked up once per address."""
    if isinstance(attributes, str):
        raise ValueError("attributes must be a list")
    hit = stage(find_subnets(rows, ip, subnets), "addresses")
    n = hit.count()
    hit = hit.join(subnets.select("cidr", "attrs").dropDuplicates(["cidr"]), "cidr")
    values = [F.col("attrs")] if attributes is None else [F.try_element_at("attrs", F.lit(a)).alias(a) for a in attributes]
    named = stage(hit.select(F.col("ip").alias("__ip"), "cidr", *values), "address-values")
    width = named.agg(F.max(F.length(F.to_json(F.struct("*"))))).first()[0] or 0
    one = small(named, n, 4 * width)
    if one is named:  # too large to send to all: a frequent address is spread
        return skew_join(stage(rows.withColumn("__ip", F.col(ip).cast("string")), "address-rows"), named, ["__ip"], "left").drop("__ip")
    return rows.join(one, rows[ip].cast("string") == named["__ip"], "left").drop("__ip")


def subnet_members(ips: DataFrame, ip: str, subnets: DataFrame) -> DataFrame:
    """(cidr, addresses): how many distinct addresses each subnet was found for."""
    return find_subnets(ips, ip, subnets).groupBy("cidr").agg(F.count("*").alias("addresses"))


def lookup_subnets(ips: DataFrame, ip: str, provider: Callable[[list[str]], Iterator[tuple[str, dict[str, str]]]], known: DataFrame | None = None) -> DataFrame:
    """(prio, cidr, attrs) from a provider called with distinct addresses that no known subnet holds.

    The provider gets addresses in batches on the executors and yields (cidr, attributes); a failing
    address is simply not yielded. Known subnets come first.
    """
    import pandas as pd

    todo = ips.select(F.col(ip).cast("string").alias("ip")).where(ip_number(F.col("ip")).isNotNull()).distinct()
    if known is not None:
        todo = todo.join(find_subnets(todo, "ip", known), "ip", "left_anti")

    def ask(batches):
        for pdf in batches:
            rows = list(provider(pdf["ip"].tolist()))
            yield pd.DataFrame({"cidr": [c for c, _ in rows], "attrs": [a for _, a in rows]})

    found = todo.mapInPandas(ask, "cidr string, attrs map<string,string>")
    # Of different answers for a subnet the first by its sorted text.
    text = F.to_json(F.array_sort(F.map_entries("attrs")))
    found = found.groupBy("cidr").agg(F.min_by("attrs", text).alias("attrs"))
    found = found.select(F.lit(1_000_000).alias("prio"), "cidr", "attrs")
    return found if known is None else known.select("prio", "cidr", "attrs").unionByName(found)


#: Ports that are looked at unless others are named (fixed values).
DEFAULT_PORTS = (20, 21, 22, 23, 25, 53, 80, 110, 119, 123, 139, 143, 161, 194, 443, 445, 1433, 1521, 3306, 3389, 5432, 8080, 8443)


def port_list(ports: str | list[int] = "default") -> list[int]:
    """The default ports, all from 1 to 65535, or the named ones; others are an error."""
    if ports == "default":
        return list(DEFAULT_PORTS)
    if ports == "all":
        return list(range(1, 65536))
    if isinstance(ports, str) or any(isinstance(p, bool) or not isinstance(p, int) or not 1 <= p <= 65535 for p in ports):
        raise ValueError("ports must be default, all, or whole numbers from 1 to 65535")
    return list(ports)


def port_status(scans: DataFrame, ports: str | list[int] = "default") -> DataFrame:
    """(ip, port, status) of every address and every port of the list: the status seen, else null. Of
    several the last by `scanned_at`, if it is there, else the least."""
    wanted = scans.select("ip").where("ip is not null").distinct().select("ip", F.explode(F.array(*map(F.lit, port_list(ports)))).alias("port"))
    last = F.max_by("status", "scanned_at") if "scanned_at" in scans.columns else F.min("status")
    seen = scans.where("status is not null").groupBy("ip", "port").agg(last.alias("status"))
    return wanted.join(seen, ["ip", "port"], "left")


def port_summary(scans: DataFrame) -> DataFrame:
    """(port, connected, refused, unknown) over (ip, port, status); ports out of 1..65535 are left
    out; of several results for an address and port the last by `scanned_at` counts, if it is there."""
    rows = scans.where(F.col("port").between(1, 65535))
    if "scanned_at" in scans.columns:
        w = Window.partitionBy("ip", "port").orderBy(F.desc_nulls_last("scanned_at"), F.asc_nulls_last("status"))
        rows = rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1")
    count = lambda s: F.count(F.when(s, 1))
    st = F.col("status")
    return rows.groupBy("port").agg(count(st == "connected").alias("connected"), count(st == "refused").alias("refused"), count(st.isNull()).alias("unknown"))
