"""Trees in long form (tree_id, node_id, parent_id, name, ...), many at once.

Depths and paths come from pointer doubling (`hierarchy.ancestors`), so a deep tree takes a few
joins. Trees are equal if their signatures are: the root's name and the sorted name paths of all
leaves; so comparing all trees is one equi-join on a hash, not a comparison of pairs. Ids are
strings; nodes are told apart by id, never by name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import stage
from .hierarchy import ancestors, deepest_below, roots
from .indexing import number_rows
from .skew import skew_join

_CUT = "\u0001"


def _key(tree: str | Column, node: str | Column) -> Column:
    return F.concat(F.col(tree) if isinstance(tree, str) else tree, F.lit(_CUT), F.col(node) if isinstance(node, str) else node)


def as_nodes(rows: DataFrame, tree: str, node: str, parent: str, name: str, *extra: str) -> DataFrame:
    s = lambda c: F.col(c).cast("string")
    return rows.select(s(tree).alias("tree_id"), s(node).alias("node_id"), s(parent).alias("parent_id"), s(name).alias("name"), *extra)


def with_known_parents(nodes: DataFrame) -> DataFrame:
    """`nodes` without parents that their tree does not have: a node under such a one is a root."""
    known = nodes.select("tree_id", F.col("node_id").alias("parent_id"), F.lit(True).alias("__known"))
    return skew_join(nodes, known, ["tree_id", "parent_id"], "left").withColumn("parent_id", F.when(F.col("__known"), F.col("parent_id"))).select(*nodes.columns)


def paths(nodes: DataFrame) -> DataFrame:
    """(tree_id, node_id, name, root_id, depth, ids, names): ids and names from the root to the node;
    nodes on or under a cycle have depth -1 and null paths."""
    keyed = nodes.select(_key("tree_id", "node_id").alias("key"), _key("tree_id", "parent_id").alias("up"), "name")
    a = ancestors(keyed, "key", "up", "name")
    local = lambda c: F.substring_index(c, _CUT, -1)
    return a.select(
        F.substring_index("node", _CUT, 1).alias("tree_id"),
        local(F.col("node")).alias("node_id"),
        F.element_at("names", -1).alias("name"),
        local(F.col("root")).alias("root_id"),
        "depth",
        F.transform("ids", local).alias("ids"),
        "names",
    )


def levels(nodes: DataFrame) -> DataFrame:
    """(tree_id, node_id, root_id, depth) as in `paths`, without paths: fewer and narrower joins."""
    r = roots(nodes.select(_key("tree_id", "node_id").alias("key"), _key("tree_id", "parent_id").alias("up")), "key", "up")
    return r.select(F.substring_index("node", _CUT, 1).alias("tree_id"), F.substring_index("node", _CUT, -1).alias("node_id"), F.substring_index("root", _CUT, -1).alias("root_id"), "depth")


def edges(nodes: DataFrame) -> DataFrame:
    return nodes.where("parent_id is not null").select("tree_id", "parent_id", "node_id")


def leaves(nodes: DataFrame) -> DataFrame:
    """Nodes without children."""
    parents = nodes.where("parent_id is not null").select("tree_id", F.col("parent_id").alias("node_id")).distinct()
    return nodes.join(parents, ["tree_id", "node_id"], "left_anti")


def layers(found: DataFrame) -> DataFrame:
    """(tree_id, layer, nodes): number of nodes in each layer of `levels` or `paths`."""
    return found.where("depth >= 0").groupBy("tree_id", F.col("depth").alias("layer")).agg(F.count("*").alias("nodes"))


def depths(found: DataFrame) -> DataFrame:
    """(tree_id, depth): layers of the tree; 1 for a root alone."""
    return found.groupBy("tree_id").agg((F.max("depth") + 1).alias("depth"))


def widths(nodes: DataFrame) -> DataFrame:
    """(tree_id, width): number of leaves."""
    return leaves(nodes).groupBy("tree_id").agg(F.count("*").alias("width"))


def branch_to_trunk(found: DataFrame, truncate_at_root_name: bool = False) -> DataFrame:
    """(tree_id, node_id, branch): names from the node up to the root. With the flag, the branch
    stops before the first ancestor named like the root and goes on with the root itself."""
    up = F.reverse("names")
    if truncate_at_root_name:
        root = F.element_at("names", 1)
        rest = F.slice(up, 2, F.size(up))
        at = F.array_position(rest, root)
        up = F.when((F.size("names") > 1) & (at > 0), F.concat(F.slice(up, 1, 1), F.slice(rest, 1, at.cast("int") - 1), F.array(root))).otherwise(up)
    return found.where("depth >= 0").select("tree_id", "node_id", up.alias("branch"))


def validate(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """(tree_id, roots, orphans, endless, repeated, valid): a tree is valid with one node without
    parent, no parent that is missing, no cycle, and no node id twice."""
    ids = nodes.select("tree_id", F.col("node_id").alias("parent_id")).distinct().withColumn("known", F.lit(True))
    checked = nodes.join(ids, ["tree_id", "parent_id"], "left")
    facts = checked.groupBy("tree_id").agg(
        F.count_if(F.col("parent_id").isNull()).alias("roots"), F.count_if(F.col("parent_id").isNotNull() & F.col("known").isNull()).alias("orphans"), F.count("*").alias("rows")
    )
    # A repeated id would be found once for each of its rows, so distinct ids are counted apart.
    different = nodes.select("tree_id", "node_id").distinct().groupBy("tree_id").agg(F.count("*").alias("ids"))
    loops = found.where("depth < 0").groupBy("tree_id").agg(F.count("*").alias("endless"))
    out = facts.join(different, "tree_id").join(loops, "tree_id", "left").withColumn("endless", F.coalesce("endless", F.lit(0)))
    return out.select(
        "tree_id", "roots", "orphans", "endless", (F.col("rows") - F.col("ids")).alias("repeated"),
        ((F.col("roots") == 1) & (F.col("orphans") == 0) & (F.col("endless") == 0) & (F.col("rows") == F.col("ids"))).alias("valid"),
    )


def signatures(nodes: DataFrame, found: DataFrame, truncate_at_root_name: bool = False) -> DataFrame:
    """(tree_id, signature): equal for trees with the same root name and the same name paths of leaves.

    Paths are merged to counts first, so a tree with many equal leaves is small; the sorted list of a
    tree is one row.
    """
    branch = branch_to_trunk(found, truncate_at_root_name)
    of = leaves(nodes).select("tree_id", "node_id").join(branch, ["tree_id", "node_id"])
    hashed = F.sha2(F.to_json(F.struct("branch")), 256)
    counts = of.groupBy("tree_id", hashed.alias("p")).agg(F.count("*").alias("n"))
    return counts.groupBy("tree_id").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("p", "n")))), 256).alias("signature"))


def signature_groups(sig: DataFrame) -> DataFrame:
    """(signature, first, n): the least id and the number of trees with each signature."""
    return sig.groupBy("signature").agg(F.min("tree_id").alias("first"), F.count("*").alias("n"))


def match_groups(sig: DataFrame) -> DataFrame:
    """(tree_id, first, matches): each tree with the least id of its equals and the number of the
    others; pairs of equal trees are not written out. `sig` is staged."""
    return skew_join(sig, signature_groups(sig), ["signature"]).select("tree_id", "first", (F.col("n") - 1).alias("matches"))


def matches(a: DataFrame, b: DataFrame) -> DataFrame:
    """(tree_id, other): trees of signatures `a` with the equal ones of `b`."""
    return a.join(b.select(F.col("tree_id").alias("other"), "signature"), "signature").select("tree_id", "other")


def subtree(found: DataFrame, node_id: str) -> DataFrame:
    """Rows of `paths` at and under the node, in every tree that has it, with paths from it on."""
    at = F.array_position("ids", node_id).cast("int")
    return found.where(F.array_contains("ids", node_id)).select(
        "tree_id", "node_id", "name", F.lit(node_id).alias("root_id"), (F.col("depth") - at + 1).alias("depth"), F.slice("ids", at, F.size("ids")).alias("ids"), F.slice("names", at, F.size("names")).alias("names")
    )


def subtree_depths(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """(tree_id, node_id, height): layers from the node down; 1 for a leaf. Nodes that no root reaches
    have none. `found` is `levels` or `paths`."""
    keyed = nodes.select(_key("tree_id", "node_id").alias("key"), _key("tree_id", "parent_id").alias("up"))
    depth = found.select(_key("tree_id", "node_id").alias("node"), "depth")
    below = deepest_below(keyed, depth, "key", "up")
    return below.select(F.substring_index("node", _CUT, 1).alias("tree_id"), F.substring_index("node", _CUT, -1).alias("node_id"), (F.col("below") - F.col("depth") + 1).alias("height"))


def has_subtree(nodes: DataFrame, other: DataFrame) -> DataFrame:
    """(tree_id, start_id): the places in the trees of `nodes` that hold the one tree of `other`, rows
    of `paths`.

    A place is a node named like the other's root under which, for every layer, each (name, parent's
    name) occurs at least as often as in the other tree. The search starts at the nodes with the
    root's name and steps down one layer at a time, only under nodes whose name has children there.
    """
    parent = F.when(F.col("depth") > 0, F.element_at("names", F.greatest("depth", F.lit(1))))
    need = other.where("depth >= 0").groupBy(F.col("depth").alias("layer"), F.col("name").alias("n"), parent.alias("p")).agg(F.count("*").alias("need"))
    need = stage(need, "subtree-need")
    kinds, last = need.agg(F.count("*"), F.max("layer")).first()
    if last is None:
        return nodes.select("tree_id", F.col("node_id").alias("start_id")).where("false")
    at = nodes.select("tree_id", F.col("node_id").alias("start_id"), "node_id", F.col("name").alias("n"), F.lit(None).cast("string").alias("p"), F.lit(0).alias("layer"))
    at = at.join(F.broadcast(need.where("layer = 0").select("n")), at["n"].eqNullSafe(need["n"])).select(at["*"])
    found = [at.select("tree_id", "start_id", "layer", "n", "p")]
    for layer in range(1, last + 1):
        inner = need.where(F.col("layer") == layer).select(F.col("p").alias("inner")).distinct()
        above = at.join(inner, at["n"].eqNullSafe(inner["inner"])).select("tree_id", F.col("node_id").alias("parent_id"), "start_id", F.col("n").alias("p"))
        at = skew_join(nodes.select("tree_id", "node_id", "parent_id", F.col("name").alias("n")), above, ["tree_id", "parent_id"])
        at = at.select("tree_id", "start_id", "node_id", "n", "p", F.lit(layer).alias("layer"))
        found.append(at.select("tree_id", "start_id", "layer", "n", "p"))
    have = reduce(DataFrame.unionByName, found).groupBy("tree_id", "start_id", "layer", "n", "p").agg(F.count("*").alias("have"))
    ok = have.join(need, (have["layer"] == need["layer"]) & have["n"].eqNullSafe(need["n"]) & have["p"].eqNullSafe(need["p"])).where("have >= need")
    return ok.groupBy("tree_id", "start_id").agg(F.count("*").alias("k")).where(F.col("k") == kinds).select("tree_id", "start_id")


def last_leaves(nodes: DataFrame, order: str = "node_id") -> DataFrame:
    """(tree_id, node_id, leaf_id): where the chain of first children (lowest `order`) ends; '' if it
    never does."""
    first = nodes.where("parent_id is not null").groupBy("tree_id", F.col("parent_id").alias("node_id")).agg(F.min_by("node_id", order).alias("child"))
    down = nodes.select("tree_id", "node_id").join(first, ["tree_id", "node_id"], "left").select(_key("tree_id", "node_id").alias("key"), _key("tree_id", "child").alias("next"))
    a = roots(down, "key", "next")
    return a.select(F.substring_index("node", _CUT, 1).alias("tree_id"), F.substring_index("node", _CUT, -1).alias("node_id"), F.substring_index("root", _CUT, -1).alias("leaf_id"))


def branch_to_leaf(nodes: DataFrame, order: str = "node_id") -> DataFrame:
    """(tree_id, node_id, leaf_id, branch): the chain of first children from the node down to its
    last leaf, as names; null for a chain that never ends."""
    first = nodes.where("parent_id is not null").groupBy("tree_id", F.col("parent_id").alias("node_id")).agg(F.min_by("node_id", order).alias("child"))
    down = nodes.select("tree_id", "node_id", "name").join(first, ["tree_id", "node_id"], "left").select(_key("tree_id", "node_id").alias("key"), _key("tree_id", "child").alias("next"), "name")
    a = ancestors(down, "key", "next", "name")
    return a.select(F.substring_index("node", _CUT, 1).alias("tree_id"), F.substring_index("node", _CUT, -1).alias("node_id"), F.substring_index("root", _CUT, -1).alias("leaf_id"), F.reverse("names").alias("branch"))


def child_names(nodes: DataFrame) -> DataFrame:
    """(tree_id, node_id, children, names): number of children and their distinct names; nodes with
    equal values have the same children."""
    kids = nodes.where("parent_id is not null").groupBy("tree_id", F.col("parent_id").alias("node_id")).agg(F.count("*").alias("children"), F.array_sort(F.collect_set("name")).alias("names"))
    empty = F.array().cast("array<string>")
    return nodes.select("tree_id", "node_id").join(kids, ["tree_id", "node_id"], "left").select("tree_id", "node_id", F.coalesce("children", F.lit(0)).alias("children"), F.coalesce("names", empty).alias("names"))


def layout(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """(tree_id, node_id, x, y) from 0 to 1: x by layer, y by the order of leaves along their paths
    (equal ids of different length in their own order); an inner node has the y of its last leaf.
    Nodes that no root reaches have none. Leaves of all trees are numbered together, so no task
    orders the leaves of one large tree."""
    found = found.where("depth >= 0")
    deepest = found.groupBy("tree_id").agg(F.max("depth").alias("last"))
    leaf = leaves(nodes).select("tree_id", "node_id").join(found.select("tree_id", "node_id", "ids"), ["tree_id", "node_id"])
    numbered = stage(number_rows(leaf, "tree_id", "ids", name="at"), "leaf-order")
    ends = numbered.groupBy("tree_id").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    last_leaf = numbered.select("tree_id", F.explode("ids").alias("node_id"), "at").groupBy("tree_id", "node_id").agg(F.max("at").alias("at"))
    of_tree = deepest.join(ends, "tree_id")
    placed = found.select("tree_id", "node_id", "depth").join(last_leaf, ["tree_id", "node_id"])
    y = (F.col("at") - F.col("first")) / F.greatest(F.col("n") - 1, F.lit(1))
    return skew_join(stage(placed, "layout"), of_tree, ["tree_id"]).select("tree_id", "node_id", (F.col("depth") / F.greatest(F.col("last"), F.lit(1))).alias("x"), y.alias("y"))


def append_nodes(nodes: DataFrame, more: DataFrame) -> DataFrame:
    """Both; check the result with `validate`."""
    return nodes.unionByName(more)


def push_node(nodes: DataFrame, tree_id: str, node_id: str, name: str, children: list[str]) -> DataFrame:
    """A new node above the given ones, which keep a parent that they have."""
    new = nodes.sparkSession.createDataFrame([(tree_id, node_id, None, name)], "tree_id string, node_id string, parent_id string, name string")
    takes = (F.col("tree_id") == tree_id) & F.col("node_id").isin(*children) & F.col("parent_id").isNull() if children else F.lit(False)
    return nodes.withColumn("parent_id", F.when(takes, F.lit(node_id)).otherwise(F.col("parent_id"))).unionByName(new, allowMissingColumns=True)


def delete_node(nodes: DataFrame, tree_id: str, node_id: str) -> DataFrame:
    """Without the node; its children become roots."""
    here = F.col("tree_id") == tree_id
    rest = nodes.where(~(here & (F.col("node_id") == node_id)))
    return rest.withColumn("parent_id", F.when(here & (F.col("parent_id") == node_id), F.lit(None)).otherwise(F.col("parent_id")))


def run_data(nodes: DataFrame, ts: str = "ts") -> DataFrame:
    """(tree_id, root_id, start, elapsed): stamp of the root, and seconds to the latest leaf; null if
    the root or any leaf has no stamp."""
    roots = nodes.where("parent_id is null").groupBy("tree_id").agg(F.min_by("node_id", "node_id").alias("root_id"), F.min_by(ts, "node_id").alias("start"))
    ends = leaves(nodes).groupBy("tree_id").agg(F.when(F.count(ts) == F.count("*"), F.max(ts)).alias("end"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return roots.join(ends, "tree_id").select("tree_id", "root_id", "start", ((micros("end") - micros("start")) / 1e6).alias("elapsed"))


def dedupe_hosts(trees: DataFrame) -> DataFrame:
    """(host_id, tree_id, signature, runs, iterations) over (host_id, tree_id, signature, start,
    elapsed, root_id): equal trees of a host are one, the first by (start, tree_id); iterations are
    the runs of all of them, by start."""
    run = F.struct("start", "elapsed", "root_id")
    return trees.groupBy("host_id", "signature").agg(
        F.min(F.struct(F.col("start").isNull().alias("no"), "start", "tree_id"))["tree_id"].alias("tree_id"), F.count("*").alias("runs"), F.array_sort(F.collect_list(run)).alias("iterations")
    ).select("host_id", "tree_id", "signature", "runs", "iterations")


def find_matches(trees: DataFrame, signature: str) -> DataFrame:
    """Trees with a signature, by host and id."""
    return trees.where(F.col("signature") == signature).select("host_id", "tree_id")


def build_master(host_trees: DataFrame, name: str, digits: int = 7, start: int = 1) -> DataFrame:
    """(master_id, signature, hosts): one master tree for each signature of the deduped trees,
    numbered from `start` by its least (host_id, tree_id). A host with two equal trees is an error."""
    per_host = host_trees.groupBy("signature", "host_id").agg(F.min("tree_id").alias("tree_id"), F.count("*").alias("n"))
    once = F.when(F.col("n") == 1, F.col("tree_id")).otherwise(F.raise_error(F.lit("a host has two equal trees; dedupe first")).cast("string"))
    grouped = per_host.groupBy("signature").agg(F.min(F.struct("host_id", once.alias("tree_id"))).alias("first"), F.count("*").alias("hosts"))
    numbered = number_rows(grouped, F.col("first.host_id"), F.col("first.tree_id"), name="no", start=start)
    return numbered.select(F.concat(F.lit(f"{name}_MasterTree_"), F.lpad(F.col("no").cast("string"), digits, "0")).alias("master_id"), "signature", "hosts")


def include_trees(master: DataFrame, more: DataFrame, name: str, digits: int = 7) -> DataFrame:
    """`master` (master_id, signature, hosts) with the trees of other hosts taken in: a tree that is
    there already adds its hosts, a new one is numbered after the last. `more` is deduped trees
    (host_id, tree_id, signature) of hosts that the master does not have yet."""
    taken = master.agg(F.max(F.substring_index("master_id", "_", -1).cast("bigint"))).first()[0] or 0
    added = more.groupBy("signature").agg(F.countDistinct("host_id").alias("added"))
    known = master.join(added, "signature", "left").select("master_id", "signature", (F.col("hosts") + F.coalesce("added", F.lit(0))).alias("hosts"))
    new = build_master(more.join(master.select("signature"), "signature", "left_anti"), name, digits, taken + 1)
    return known.unionByName(new)


def containing_hosts(master: DataFrame, host_trees: DataFrame) -> DataFrame:
    """(master_id, host_id, tree_id): the mapping of master trees to hosts, in long form, as a tree may
    be on very many hosts."""
    return host_trees.join(master.select("signature", "master_id"), "signature").select("master_id", "host_id", "tree_id")


def find_in_master(master: DataFrame, trees: DataFrame) -> DataFrame:
    """(tree_id, master_id) of the trees with signatures that the master has."""
    return trees.join(master.select("signature", "master_id"), "signature").select("tree_id", "master_id")


def render(found: DataFrame, tree_id: str) -> str:
    """One tree as indented text; its rows are brought to the driver."""
    rows = sorted(found.where((F.col("tree_id") == tree_id) & (F.col("depth") >= 0)).collect(), key=lambda r: r["ids"])
    return "\n".join(("    " * (r["depth"] - 1) + "└── " if r["depth"] else "") + str(r["name"]) for r in rows)


def to_nested(found: DataFrame, tree_id: str) -> list:
    """One tree as [name, [children]]; its rows are brought to the driver."""
    at: dict[str, list] = {}
    top: list = []
    for r in sorted(found.where((F.col("tree_id") == tree_id) & (F.col("depth") >= 0)).collect(), key=lambda r: (r["depth"], r["ids"])):
        at[r["node_id"]] = node = [r["name"], []]
        (at[r["ids"][-2]][1] if r["depth"] else top).append(node)
    return top[0] if len(top) == 1 else top
