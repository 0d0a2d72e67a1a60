"""Parent-child rows to full hierarchies by pointer doubling.

Every node starts with a pointer to its parent and the length of that jump. Each round joins the
pointers of unfinished nodes to their targets' pointers, which doubles the jumps, so a tree of depth
d takes about log2(d) joins on the unique node key. A node whose depth is above 2^r always has an
ancestor that finishes in round r + 1; so a round in which no node finishes proves that the rest
never reach a root: they are on a cycle or hang from one. These rounds carry no paths, as a path
round a cycle would double for ever.

Paths are made the same way for the nodes that do reach a root: a jump's path segment is joined to
its target's segment, and as depths are known, so is the number of rounds.

A round writes only the nodes that took part in it; those finished before stay where they were
written. A parent with very many children is a hot key, which `skew_join` spreads.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..staging import stage
from .skew import skew_join


def plain_guid(guid: Column) -> Column:
    """Lower-case guid without braces."""
    return F.translate(F.lower(guid), "{}", "")


def clean_processes(rows: DataFrame, *extra: str) -> DataFrame:
    """(guid, parent_guid, proc_name, *extra) with plain guids; of rows with equal plain guid the one
    with the lowest rec_id. Rows without guid are left out; a null rec_id counts as lowest."""
    cols = ["rec_id", "parent_guid", "proc_name", *[c for c in extra if c != "rec_id"]]
    one = rows.where(F.col("guid").isNotNull()).groupBy(plain_guid(F.col("guid")).alias("guid")).agg(F.min(F.struct(*cols)).alias("r"))
    return one.select("guid", plain_guid(F.col("r.parent_guid")).alias("parent_guid"), F.col("r.proc_name").alias("proc_name"), *[F.col(f"r.{c}").alias(c) for c in extra])


class _Rounds:
    """Staged tables of the rounds so far. Each node is in the latest table that has it: finished
    (to is null) where it finished, unfinished in the last one."""

    def __init__(self, first: DataFrame, label: str):
        self.tables, self.label, self.n_left = [], label, 0
        self.add(first)

    def every(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [t.where("to is null") for t in self.tables], self.left())

    def left(self) -> DataFrame:
        return self.tables[-1].where("to is not null")

    def add(self, table: DataFrame) -> None:
        """Writes a round; the unfinished rows are counted as they are written."""
        seen = Observation()
        self.tables.append(stage(table.observe(seen, F.count_if(F.col("to").isNotNull()).alias("left")), self.label))
        self.n_left = seen.get["left"]


def _double(links: DataFrame) -> _Rounds:
    """Rounds of (node, to, root, depth) of (node, up): to is null once the root is reached, and stays
    set for nodes that never reach one."""
    known = links.select(F.col("node").alias("up"), F.lit(True).alias("known"))
    start = skew_join(links.select("node", "up"), known, ["up"], "left").select("node", F.when(F.col("known"), F.col("up")).alias("to"))
    is_root = F.col("to").isNull()
    rounds = _Rounds(start.select("node", "to", F.when(is_root, F.col("node")).alias("root"), F.when(is_root, 0).otherwise(1).alias("depth")), "tree-pointers")
    left = rounds.n_left
    while left:
        target = rounds.every().select(F.col("node").alias("to"), F.col("to").alias("to2"), F.col("root").alias("root2"), F.col("depth").alias("depth2"))
        jumped = skew_join(rounds.left(), target, ["to"], "inner", left)
        rounds.add(jumped.select("node", F.col("to2").alias("to"), F.col("root2").alias("root"), (F.col("depth") + F.col("depth2")).alias("depth")))
        if rounds.n_left == left:
            break
        left = rounds.n_left
    return rounds


def _links(nodes: DataFrame, key: str, parent: str, name: str | None) -> DataFrame:
    seg = F.col(name).cast("string") if name else F.lit(None).cast("string")
    base = nodes.select(F.col(key).cast("string").alias("node"), F.col(parent).cast("string").alias("up"), seg.alias("name")).where("node is not null")
    return stage(base, "tree-links")


def _roots(doubled: _Rounds) -> DataFrame:
    ended = F.col("to").isNull()
    return doubled.every().select("node", F.when(ended, F.col("root")).otherwise(F.lit("")).alias("root"), F.when(ended, F.col("depth")).otherwise(F.lit(-1)).alias("depth"))


def roots(nodes: DataFrame, key: str = "guid", parent: str = "parent_guid") -> DataFrame:
    """(node, root, depth) of every node, without paths. See `ancestors`."""
    return _roots(_double(_links(nodes, key, parent, None)))


def ancestors(nodes: DataFrame, key: str = "guid", parent: str = "parent_guid", name: str | None = "proc_name") -> DataFrame:
    """(node, root, depth, ids, names): path from the root to the node, both included.

    `nodes` has one row per key. A node is a root (depth 0) if its parent is null or not a key.
    Nodes whose chain of parents never ends have root '', depth -1 and null paths; a node that is
    its own parent is one. A null name stays null in `names`. Keys are taken as strings. An empty
    table gives no rows.
    """
    links = _links(nodes, key, parent, name)
    doubled = _double(links)
    found = _roots(doubled)
    # Last round in which a node has any node under it at the jump's length: it is no target after.
    jumps = [t.where("to is not null").select(F.col("to").alias("node"), F.lit(r).alias("rank")) for r, t in enumerate(doubled.tables)]
    ranks = reduce(DataFrame.unionByName, jumps).groupBy("node").agg(F.max("rank").alias("rank"))
    start = links.join(found.where("depth >= 0").select("node", "depth"), "node").join(ranks, "node", "left")
    to = F.when(F.col("depth") > 0, F.col("up"))
    rounds = _Rounds(start.select("node", "depth", "rank", to.alias("to"), F.array("node").alias("ids"), F.array("name").alias("names")), "tree-paths")
    targets = None
    for r in range(len(doubled.tables)):
        if not rounds.n_left:
            break
        # Before round r a segment covers min(depth + 1, 2^r) nodes; those that cover all are done.
        # Targets are kept apart as they are now, so a round reads them and the unfinished rows only.
        wanted = F.col("rank") >= r
        targets = rounds.tables[0].where(wanted) if targets is None else stage(targets.where("to is null").unionByName(rounds.tables[-1]).where(wanted), "tree-targets")
        target = targets.select(F.col("node").alias("to"), F.col("to").alias("to2"), F.col("ids").alias("ids2"), F.col("names").alias("names2"))
        joined = skew_join(rounds.left(), target, ["to"], "inner", rounds.n_left)
        rounds.add(joined.select("node", "depth", "rank", F.col("to2").alias("to"), F.concat("ids2", "ids").alias("ids"), F.concat("names2", "names").alias("names")))
    ended = rounds.every().select("node", F.element_at("ids", 1).alias("root"), "depth", "ids", "names")
    nothing = F.lit(None).cast("array<string>")
    return ended.unionByName(found.where("depth < 0").select("node", "root", "depth", nothing.alias("ids"), nothing.alias("names")))


def deepest_below(nodes: DataFrame, found: DataFrame, key: str = "guid", parent: str = "parent_guid") -> DataFrame:
    """(node, depth, below): the greatest depth at and under each node that reaches a root.

    `found` is (node, depth) of `roots` or `ancestors`, staged. In round r each node hands the
    greatest depth within 2^r steps under it to its ancestor 2^r steps up, so log2(depth) rounds of
    narrow rows do, without paths. What many children hand up is merged before the shuffle.
    """
    reach = found.where("depth >= 0").select("node", "depth")
    up = nodes.select(F.col(key).cast("string").alias("node"), F.col(parent).cast("string").alias("up"))
    to = F.when(F.col("depth") > 0, F.col("up")).alias("to")
    cur = stage(reach.join(up, "node").select("node", "depth", to, F.col("depth").alias("below")), "tree-below")
    for _ in range((cur.agg(F.max("depth")).first()[0] or 0).bit_length()):
        handed = cur.where("to is not null").groupBy(F.col("to").alias("node")).agg(F.max("below").alias("more"))
        nxt = skew_join(cur, cur.select(F.col("node").alias("to"), F.col("to").alias("to2")), ["to"], "left")
        cur = stage(nxt.join(handed, "node", "left").select("node", "depth", F.col("to2").alias("to"), F.greatest("below", "more").alias("below")), "tree-below")
    return cur.select("node", "depth", "below")


def hierarchy(found: DataFrame, sep: str = "/") -> DataFrame:
    """(node, root, depth, path, descendants, endless) of `ancestors`: the names from the root joined
    by `sep` ('' for a null name) and the number of all nodes below."""
    below = (
        found.where("depth > 0")
        .select(F.explode(F.slice("ids", 1, F.col("depth"))).alias("node"))
        .groupBy("node")
        .agg(F.count("*").alias("descendants"))
    )
    path = F.concat_ws(sep, F.transform("names", lambda x: F.coalesce(x, F.lit(""))))
    return found.join(below, "node", "left").select(
        "node", "root", "depth", F.when(F.col("depth") >= 0, path).alias("path"), F.coalesce("descendants", F.lit(0)).cast("long").alias("descendants"), (F.col("depth") < 0).alias("endless")
    )


def descendants(found: DataFrame) -> DataFrame:
    """(node, descendant, distance): every node with each node below it."""
    return found.where("depth > 0").select(
        F.posexplode(F.slice("ids", 1, F.col("depth"))).alias("at", "node"), F.col("node").alias("descendant"), "depth"
    ).select("node", "descendant", (F.col("depth") - F.col("at")).alias("distance"))
