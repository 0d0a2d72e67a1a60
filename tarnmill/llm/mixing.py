"""Mixing sources to target weights.

Documents are grouped by the set of wanted sources they belong to. A minimum-cost flow routes the
tokens of each group to the sources' quotas; the r-th use of a token costs r, so repetition is
spread as evenly as it can be. Only one number per group reaches the driver. Documents are then
chosen by a seeded order: each group's tokens lie on a line, each source's flow is a stretch of it
(winding round the line as often as documents repeat), and a document is used once for each time
its first token lies in a stretch. The line is cut into bins by hash, so no task orders a whole group.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass
from fractions import Fraction
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import small, stage

#: Most membership patterns that a flow is worked out for, on the driver; the cost is theirs, not the rows'.
MAX_PATTERNS = 100_000
#: Bins of a group's line of tokens.
BINS = 4096


def plain_source(source: Column) -> Column:
    return F.lower(F.trim(source))


@dataclass(frozen=True)
class Target:
    source: str
    share: Fraction
    max_repeats: int


def read_targets(targets: DataFrame) -> list[Target]:
    """Sources with a weight above 0; shares are weights over their sum. A source named twice has
    the sum of its weights and the larger max_repeats; a null max_repeats is 1."""
    rows = targets.select(plain_source(F.col("source")).alias("s"), "weight", "max_repeats").where("s is not null and weight > 0 and not isnan(weight)").collect()
    weights: dict[str, Fraction] = {}
    repeats: dict[str, int] = {}
    for r in rows:
        weights[r["s"]] = weights.get(r["s"], Fraction(0)) + Fraction(str(r["weight"]))
        repeats[r["s"]] = max(repeats.get(r["s"], 0), 1 if r["max_repeats"] is None else max(0, r["max_repeats"]))
    total = sum(weights.values())
    return [Target(s, w / total, repeats[s]) for s, w in sorted(weights.items())]


class Flow:
    """Minimum-cost flow by successive shortest paths (costs may be any integers, no negative cycle)."""

    def __init__(self, nodes: int):
        self.to: list[int] = []
        self.cap: list[int] = []
        self.cost: list[int] = []
        self.at: list[list[int]] = [[] for _ in range(nodes)]

    def edge(self, a: int, b: int, cap: int, cost: int) -> int:
        for x, y, c, w in ((a, b, cap, cost), (b, a, 0, -cost)):
            self.at[x].append(len(self.to))
            self.to.append(y)
            self.cap.append(c)
            self.cost.append(w)
        return len(self.to) - 2

    def used(self, e: int) -> int:
        return self.cap[e ^ 1]

    def run(self, s: int, t: int) -> None:
        while True:
            far = [None] * len(self.at)
            via = [-1] * len(self.at)
            far[s] = 0
            queue, queued = deque([s]), {s}
            while queue:
                a = queue.popleft()
                queued.discard(a)
                for e in self.at[a]:
                    b, d = self.to[e], far[a] + self.cost[e]
                    if self.cap[e] > 0 and (far[b] is None or d < far[b]):
                        far[b], via[b] = d, e
                        if b not in queued:
                            queue.append(b)
                            queued.add(b)
            if far[t] is None:
                return
            path, b = [], t
            while b != s:
                path.append(via[b])
                b = self.to[via[b] ^ 1]
            much = min(self.cap[e] for e in path)
            for e in path:
                self.cap[e] -= much
                self.cap[e ^ 1] += much


def route(sizes: dict[tuple[str, ...], int], targets: list[Target], total: int) -> tuple[dict[tuple[tuple[str, ...], str], int], dict[str, int], dict[str, int]]:
    """Tokens from each group to each source, the sources' demands, and what they get.

    The demand of a source is its share of `total`, rounded up to whole tokens.
    """
    groups = sorted(sizes)
    of = {t.source: i for i, t in enumerate(targets)}
    f = Flow(2 + len(groups) + len(targets))
    s, t = 0, 1
    demand = {x.source: ceil(x.share * total) for x in targets}
    links = {}
    for g, members in enumerate(groups, 2):
        for r in range(1, max((targets[of[m]].max_repeats for m in members), default=0) + 1):
            f.edge(s, g, sizes[members], r)
        for m in members:
            links[members, m] = f.edge(g, 2 + len(groups) + of[m], sizes[members] * targets[of[m]].max_repeats, 0)
    gets = {x.source: f.edge(2 + len(groups) + of[x.source], t, demand[x.source], 0) for x in targets}
    f.run(s, t)
    return {k: f.used(e) for k, e in links.items()}, demand, {k: f.used(e) for k, e in gets.items()}


def mix(docs: DataFrame, targets: list[Target], seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(chosen, report) for `docs` (id, sources array<string>, tokens), staged.

    The total is the size of all documents of a wanted source. chosen: (id, source, copies, tokens),
    copies >= 1 and at most the source's max_repeats. report: (source, share, size, demand, flow,
    shortfall, docs, drawn, reached) with drawn the tokens chosen and reached their share of all
    drawn; drawn differs from flow by less than one document for each stretch. Documents without
    tokens or without a wanted source take no part; no wanted source gives empty results.
    """
    spark = docs.sparkSession
    wanted = [t.source for t in targets]
    names = F.array(*[F.lit(w) for w in wanted]) if wanted else F.array().cast("array<string>")
    member = docs.where("tokens > 0").select("id", F.array_sort(F.array_intersect("sources", names)).alias("members"), "tokens").where(F.size("members") > 0)
    patterns = stage(member.groupBy("members").agg(F.sum("tokens").alias("size")), "patterns")
    if patterns.count() > MAX_PATTERNS:
        raise ValueError("documents belong to too many different sets of sources for one flow")
    sizes = {tuple(r["members"]): r["size"] for r in patterns.collect()}
    total = sum(sizes.values())
    flows, demand, gets = route(sizes, targets, total)

    stretches, end = [], dict.fromkeys(sizes, 0)
    for (members, source), much in sorted(flows.items()):
        if much:
            stretches.append((list(members), source, end[members], end[members] + much, sizes[members]))
            end[members] += much
    plan = spark.createDataFrame(stretches, "members array<string>, source string, a bigint, b bigint, line bigint")
    h = F.xxhash64(F.lit(seed), "id")
    binned = member.withColumn("h", h).withColumn("bin", F.pmod(h, F.lit(BINS)).cast("int"))
    bins = binned.groupBy("members", "bin").agg(F.sum("tokens").alias("in_bin"))
    starts = bins.withColumn("start", F.sum("in_bin").over(Window.partitionBy("members").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)))
    w = Window.partitionBy("members", "bin").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, -1)
    placed = binned.withColumn("within", F.coalesce(F.sum("tokens").over(w), F.lit(0))).join(
        starts.select("members", "bin", F.coalesce("start", F.lit(0)).alias("start")), ["members", "bin"]
    )
    x = F.col("start") + F.col("within")
    # Times n with a <= n * line + x < b.
    below = lambda bound: F.greatest(F.lit(0), F.ceil((F.col(bound) - F.col("x")) / F.col("line")))
    chosen = (
        placed.withColumn("x", x)
        .join(small(plan, len(stretches), 64 + 16 * len(wanted)), "members")
        .withColumn("copies", (below("b") - below("a")).cast("int"))
        .where("copies > 0")
        .select("id", "source", "copies", "tokens")
    )
    rows = [(t.source, float(t.share), sum(n for m, n in sizes.items() if t.source in m), demand[t.source], gets[t.source], demand[t.source] - gets[t.source]) for t in targets]
    report = spark.createDataFrame(rows, "source string, share double, size bigint, demand bigint, flow bigint, shortfall bigint")
    return chosen, report


def with_reached(chosen: DataFrame, report: DataFrame) -> DataFrame:
    drawn = chosen.groupBy("source").agg(F.sum("copies").alias("docs"), F.sum(F.col("copies") * F.col("tokens")).alias("drawn"))
    full = report.join(drawn, "source", "left").na.fill(0, ["docs", "drawn"])
    every = drawn.agg(F.sum("drawn").alias("every")).first()[0] or 0
    return full.withColumn("reached", F.col("drawn") / F.lit(float(max(every, 1))))
