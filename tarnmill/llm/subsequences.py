"""Frequent subsequences with gaps, mined on weighted sequence decision diagrams.

For each first step, the windows that follow its occurrences are stored as one shared directed
acyclic graph: a node stands for what is left of a window, equal remainders are one node, and an
edge leads over a term to the node after it. A node's weight is the set of hosts that reach it.
Mining pushes conditional diagrams: the nodes behind prefix + term, with the hosts of equal nodes
merged. The edges of a node are worked out once, however many prefixes reach it, and so is the
conditional diagram of a set of nodes.

Before that, terms and first pairs that can't reach the support are left out by counts that are
never below it (all occurrences of a term; (host, block) pairs of a pair), so nothing frequent is
lost.

A first step that holds a large share of all rows is spread over tasks by host. A pattern on at least
`least` hosts is on at least least / tasks hosts of one of them, so each task gives the patterns that
reach this, and a second pass counts just those in all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import groupby
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.indexing import number_rows
from ..operators.skew import skew_join
from ..staging import shuffle_partitions, small, stage
from .logs import hot_salts, with_following

_OUT = "steps array<int>, hosts bigint"


class Diagram:
    """Shared windows of one first step. A node is the tuple of the terms left; -1 is a term that
    is not frequent and only takes a place."""

    def __init__(self, gap: int, steps: int, distinct: bool = True):
        self.gap, self.steps, self.distinct = gap, steps, distinct
        self.roots: dict[tuple, set] = {}
        self._edges: dict[tuple[int, tuple], dict[int, list[tuple]]] = {}
        self._behind: dict[tuple[int, frozenset], dict[int, dict[tuple, list[tuple]]]] = {}

    def add(self, window: tuple, host) -> None:
        self.roots.setdefault(window[: self.gap * self.steps], set()).add(host)

    def edges(self, left: int, node: tuple) -> dict[int, list[tuple]]:
        """Term -> nodes behind it, for a node with `left` steps to go."""
        key = (left, node)
        out = self._edges.get(key)
        if out is None:
            out = self._edges[key] = {}
            reach = self.gap * (left - 1)
            for i, term in enumerate(node[: self.gap]):
                if term >= 0:
                    child = node[i + 1 : i + 1 + reach]
                    nodes = out.setdefault(term, [])
                    if child not in nodes:
                        nodes.append(child)
        return out

    def behind(self, left: int, nodes: frozenset) -> dict[int, dict[tuple, list[tuple]]]:
        """Term -> nodes behind it -> those of `nodes` that lead there."""
        key = (left, nodes)
        out = self._behind.get(key)
        if out is None:
            out = self._behind[key] = {}
            for node in nodes:
                for term, children in self.edges(left, node).items():
                    to = out.setdefault(term, {})
                    for child in children:
                        to.setdefault(child, []).append(node)
        return out

    def patterns(self, first: int, seconds: set[int], least: int) -> Iterator[tuple[list[int], int]]:
        """(steps, number of hosts) of 2 to steps + 1 steps; the second step is one of `seconds`."""
        yield from self._mine((first,), self.roots, self.steps, {(first,): seconds}, False, least)

    def supports(self, first: int, wanted: list[list[int]]) -> Iterator[tuple[list[int], int]]:
        """(steps, number of hosts) of the wanted patterns that any host has."""
        after: dict[tuple, set[int]] = {}
        for p in wanted:
            for i in range(1, len(p)):
                after.setdefault(tuple(p[:i]), set()).add(p[i])
        exact = set(map(tuple, wanted))
        yield from (x for x in self._mine((first,), self.roots, self.steps, after, True, 1) if tuple(x[0]) in exact)

    def _mine(self, prefix, weights, left, after, only, least):
        allowed = after.get(prefix, () if only else None)
        for term, children in self.behind(left, frozenset(weights)).items():
            if (allowed is not None and term not in allowed) or (self.distinct and term in prefix):
                continue
            reached = {child: set().union(*(weights[n] for n in nodes)) for child, nodes in children.items()}
            support = len(set().union(*reached.values()))
            if support >= least:
                longer = (*prefix, term)
                yield list(longer), support
                if left > 1:
                    yield from self._mine(longer, reached, left - 1, after, only, least)


def _mine_partition(gap: int, steps: int, distinct: bool, least: int):
    """Rows (code, salt, salts, host, window, seconds, wanted) come by (code, salt), the one with the
    second steps, or with the wanted patterns, before the windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(7))))
        found: list[tuple[list[int], int]] = []
        for (code, _), part in groupby(rows, lambda r: r[:2]):
            diagram, seconds, wanted, parts = Diagram(gap, steps, distinct), (), None, 1
            for _, _, salts, host, window, second, want in part:
                if window is None:
                    seconds, wanted, parts = set(second or ()), want, salts
                else:
                    diagram.add(tuple(window), host)
            for p in diagram.patterns(code, seconds, -(-least // parts)) if wanted is None else diagram.supports(code, wanted):
                found.append(p)
                if len(found) == 20_000:
                    yield _batch(found)
                    found = []
        yield _batch(found)

    return run


def _batch(found) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([x for x, _ in found], pa.list_(pa.int32())), pa.array([n for _, n in found], pa.int64())], names=["steps", "hosts"]
    )


def frequent_subsequences(
    seq: DataFrame, steps: int = 3, max_gap: int = 3, min_hosts: int = 6, min_share: float = 0.1, distinct: bool = True
) -> DataFrame:
    """(steps array<string>, n, hosts): ordered patterns of 2 to `steps` steps, each 1 to `max_gap`
    places after the one before, on at least `min_hosts` hosts and `min_share` of all hosts.

    `seq` is staged (host_id, block, pos, log). With `distinct` all steps of a pattern differ. An
    empty table gives no rows; hosts with too few rows count as hosts but support nothing.
    """
    spark = seq.sparkSession
    seq = seq.select("host_id", "block", "pos", "log")
    parts = shuffle_partitions(spark)
    per_term = stage(seq.groupBy("log").agg(F.count("*").alias("total")), "terms")
    n_hosts = seq.select("host_id").distinct().count()
    least = max(min_hosts, ceil(Fraction(str(min_share)) * n_hosts), 1)

    # At most rows / least terms are frequent. They are numbered in place, not on the driver.
    codes = stage(number_rows(per_term.where(F.col("total") >= least), F.desc("total"), "log", name="code").select("log", F.col("code").cast("int").alias("code"), "total"), "codes")
    n_codes, width = codes.agg(F.count("*"), F.max(F.length("log"))).first()
    row_bytes = 4 * (width or 0) + 32
    salts = hot_salts(codes, "code", "total")
    coded = seq.join(small(codes.select("log", "code"), n_codes, row_bytes), "log", "left").select(
        "host_id", "block", "pos", F.coalesce("code", F.lit(-1)).alias("code")
    )
    span = max_gap * (steps - 1)
    windows = with_following(coded, span, ["code"]).where("code >= 0").select("host_id", "block", "code", F.col("nexts")["code"].alias("window"))
    windows = stage(windows.where(F.exists(F.slice("window", 1, max_gap), lambda x: x >= 0)), "windows")

    pairs = (
        windows.select("host_id", "block", "code", F.explode(F.array_distinct(F.slice("window", 1, max_gap))).alias("after"))
        .where("after >= 0")
        .distinct()
        .groupBy("code", "after")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= least)
    )
    if distinct:
        pairs = pairs.where("code != after")
    seconds = stage(pairs.groupBy("code").agg(F.collect_list("after").alias("after")), "pairs")
    n_pairs = seconds.agg(F.sum(F.size("after"))).first()[0] or 0
    one = small(seconds, n_pairs, 16)
    joined = windows.join(one, "code") if one is not seconds else skew_join(windows, seconds, ["code"])
    useful = joined.where(F.arrays_overlap(F.slice("window", 1, max_gap), "after")).select("code", "host_id", "window")

    def mined(rows: DataFrame, heads: DataFrame) -> DataFrame:
        """Windows, and the one row of each step that steers its mining, sent to all its tasks once."""
        spread = lambda df: df.join(F.broadcast(salts), "code", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
        own = spread(rows).withColumn("salt", F.pmod(F.xxhash64("host_id"), F.col("salts")).cast("int"))
        head = spread(heads).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        both = own.unionByName(head, allowMissingColumns=True).select("code", "salt", "salts", "host_id", "window", "seconds", "wanted")
        routed = both.repartition(parts, "code", "salt").sortWithinPartitions("code", "salt", F.col("window").isNotNull())
        return routed.mapInArrow(_mine_partition(max_gap, steps - 1, distinct, least), _OUT)

    no_pattern = F.lit(None).cast("array<array<int>>")
    first = mined(useful, seconds.select("code", F.col("after").alias("seconds"), no_pattern.alias("wanted")))
    hot = {r["code"] for r in salts.collect()}  # at most 2 x partitions
    if hot:
        first = stage(first, "patterns")
        is_hot = lambda c: c.isin(list(hot))
        candidates = first.where(is_hot(F.col("steps")[0])).select("steps").distinct()
        wanted = candidates.groupBy(F.col("steps")[0].alias("code")).agg(F.collect_list("steps").alias("wanted"))
        again = mined(useful.where(is_hot(F.col("code"))), wanted.select("code", F.lit(None).cast("array<int>").alias("seconds"), "wanted"))
        first = first.where(~is_hot(F.col("steps")[0])).unionByName(again)
    found = (
        first.groupBy("steps")
        .agg(F.sum("hosts").alias("hosts"))
        .where(F.col("hosts") >= least)
        .select(F.monotonically_increasing_id().alias("id"), "steps", "hosts")
    )
    names = codes.select("log", "code")
    return (
        found.select("id", "hosts", F.posexplode("steps").alias("place", "code"))
        .join(small(names, n_codes, row_bytes), "code")
        .groupBy("id", "hosts")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "log"))), lambda x: x["log"]).alias("steps"))
        .select("steps", F.size("steps").alias("n"), "hosts")
    )
