"""Tree queries over the whole trees of `processes`, and their SQL.

A tree is the clean processes of one tree_id; those without tree_id are one forest for each host. A
parent that is not in the same tree counts as none, except for `tree_validate`, which reports it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import hierarchy, trees
from ..sources import tree_json
from ..sources.tables import table
from ..staging import stage
from .base import r6


def _raw(spark: SparkSession, d: str) -> DataFrame:
    clean = hierarchy.clean_processes(table(spark, d, "processes"), "tree_id", "host_id", "proc_path", "proc_ts", "rec_id")
    tree = F.coalesce("tree_id", F.concat(F.lit("of "), F.coalesce("host_id", F.lit(""))))
    rows = clean.withColumn("tree_id", tree).withColumn("ts", tree_json.parse_stamp(F.col("proc_ts")))
    return stage(trees.as_nodes(rows, "tree_id", "guid", "parent_guid", "proc_name", "host_id", "proc_path", "ts", "rec_id"), "tree-rows")


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return stage(trees.with_known_parents(_raw(spark, d)), "tree-nodes")


def _paths(spark: SparkSession, d: str) -> DataFrame:
    return trees.paths(_nodes(spark, d))


def _text(names: str | Column, sep: str) -> Column:
    return F.array_join(names, sep, "")


def tree_edges(spark: SparkSession, d: str) -> DataFrame:
    return trees.edges(_nodes(spark, d))


def tree_layers(spark: SparkSession, d: str) -> DataFrame:
    return trees.layers(trees.levels(_nodes(spark, d)))


def tree_depth(spark: SparkSession, d: str) -> DataFrame:
    return trees.depths(trees.levels(_nodes(spark, d)))


def tree_leaves(spark: SparkSession, d: str) -> DataFrame:
    return trees.leaves(_nodes(spark, d)).select("tree_id", "node_id", "name")


def tree_width(spark: SparkSession, d: str) -> DataFrame:
    return trees.widths(_nodes(spark, d))


def branch_to_trunk(spark: SparkSession, d: str) -> DataFrame:
    return trees.branch_to_trunk(_paths(spark, d)).select("tree_id", "node_id", _text("branch", "<").alias("branch"))


def branch_truncated(spark: SparkSession, d: str) -> DataFrame:
    return trees.branch_to_trunk(_paths(spark, d), True).select("tree_id", "node_id", _text("branch", "<").alias("branch"))


def tree_validate(spark: SparkSession, d: str) -> DataFrame:
    nodes = _raw(spark, d)
    return trees.validate(nodes, trees.levels(nodes))


def _signatures(spark: SparkSession, d: str) -> DataFrame:
    nodes = _nodes(spark, d)
    return stage(trees.signatures(nodes, trees.paths(nodes)), "signatures")


def tree_signature_groups(spark: SparkSession, d: str) -> DataFrame:
    return trees.signature_groups(_signatures(spark, d)).select("first", "n")


def tree_matches(spark: SparkSession, d: str) -> DataFrame:
    """Each tree with the first tree equal to it and the number of its equals."""
    return trees.match_groups(_signatures(spark, d))


def tree_find_match(spark: SparkSession, d: str) -> DataFrame:
    """All equals of the trees whose number is divisible by 20."""
    sig = _signatures(spark, d)
    return trees.matches(sig.where("try_cast(substring(tree_id, 3) as bigint) % 20 = 0"), sig)


def subtree(spark: SparkSession, d: str) -> DataFrame:
    """From the node with the most children on."""
    nodes = _nodes(spark, d)
    top = trees.edges(nodes).groupBy("parent_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "parent_id").first()
    return trees.subtree(trees.paths(nodes), top["parent_id"] if top else "").select("tree_id", "node_id", "depth", F.concat_ws(">", "ids").alias("ids"))


def subtree_depth(spark: SparkSession, d: str) -> DataFrame:
    nodes = _nodes(spark, d)
    return trees.subtree_depths(nodes, stage(trees.levels(nodes), "tree-levels"))


def has_subtree(spark: SparkSession, d: str) -> DataFrame:
    """Where the commonest pair of parent and child names stands, as a tree of two nodes."""
    nodes = _nodes(spark, d)
    pair = trees.edges(nodes).join(nodes.select("tree_id", F.col("node_id").alias("parent_id"), F.col("name").alias("up")), ["tree_id", "parent_id"])
    pair = pair.join(nodes.select("tree_id", "node_id", "name"), ["tree_id", "node_id"]).where("up is not null and name is not null")
    top = pair.groupBy("up", "name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "up", "name").first()
    spec = [("x", "1", None, top["up"]), ("x", "2", "1", top["name"])] if top else []
    pattern = spark.createDataFrame(spec, "tree_id string, node_id string, parent_id string, name string")
    return trees.has_subtree(nodes, trees.paths(pattern))


def last_leaf(spark: SparkSession, d: str) -> DataFrame:
    return trees.last_leaves(_nodes(spark, d), "rec_id")


def branch_to_leaf(spark: SparkSession, d: str) -> DataFrame:
    return trees.branch_to_leaf(_nodes(spark, d), "rec_id").select("tree_id", "node_id", "leaf_id", _text("branch", ">").alias("branch"))


def child_names(spark: SparkSession, d: str) -> DataFrame:
    return trees.child_names(_nodes(spark, d)).select("tree_id", "node_id", "children", F.concat_ws("|", "names").alias("names"))


def tree_layout(spark: SparkSession, d: str) -> DataFrame:
    nodes = _nodes(spark, d)
    return trees.layout(nodes, trees.paths(nodes)).select("tree_id", "node_id", r6("x"), r6("y"))


def tree_elapsed(spark: SparkSession, d: str) -> DataFrame:
    return trees.run_data(_nodes(spark, d)).select("tree_id", "root_id", "start", r6("elapsed"))


def node_edits(spark: SparkSession, d: str) -> DataFrame:
    """In the first tree, a node pushed above its first root, one appended under that root, and the
    root's first child deleted."""
    nodes = _nodes(spark, d).select("tree_id", "node_id", "parent_id", "name")
    root = nodes.where("parent_id is null").orderBy("tree_id", "node_id").first()
    child = nodes.where((F.col("tree_id") == root["tree_id"]) & (F.col("parent_id") == root["node_id"])).agg(F.min("node_id")).first()[0]
    pushed = trees.push_node(nodes, root["tree_id"], "top", "boot", [root["node_id"]])
    more = spark.createDataFrame([(root["tree_id"], "extra", root["node_id"], "late")], "tree_id string, node_id string, parent_id string, name string")
    return trees.delete_node(trees.append_nodes(pushed, more), root["tree_id"], child or "")


def _host_trees(spark: SparkSession, d: str) -> DataFrame:
    nodes = _nodes(spark, d)
    sig = trees.signatures(nodes, trees.paths(nodes))
    host = nodes.groupBy("tree_id").agg(F.min("host_id").alias("host_id"))
    return stage(trees.dedupe_hosts(sig.join(trees.run_data(nodes), "tree_id").join(host, "tree_id")), "host-trees")


def host_dedupe(spark: SparkSession, d: str) -> DataFrame:
    its = F.col("iterations")
    return _host_trees(spark, d).select(
        "host_id", "tree_id", "runs", F.array_min(its["start"]).alias("start"), F.size(F.filter(its["elapsed"], lambda x: x.isNotNull())).alias("known")
    )


def _even(host: str = "host_id") -> Column:
    return F.coalesce(F.expr(f"try_cast(substring({host}, 5) as bigint)"), F.lit(0)) % 2 == 0


def master_build(spark: SparkSession, d: str) -> DataFrame:
    return trees.build_master(_host_trees(spark, d), "all").select("master_id", "hosts")


def master_include(spark: SparkSession, d: str) -> DataFrame:
    """A master of the hosts with even numbers, with those of the other hosts taken in."""
    every = _host_trees(spark, d)
    return trees.include_trees(trees.build_master(every.where(_even()), "all"), every.where(~_even()), "all").select("master_id", "hosts")


def containing_hosts(spark: SparkSession, d: str) -> DataFrame:
    host_trees = _host_trees(spark, d)
    return trees.containing_hosts(trees.build_master(host_trees, "all"), host_trees)


def find_in_master(spark: SparkSession, d: str) -> DataFrame:
    """The trees of all hosts in a master of the hosts with even numbers."""
    host_trees = _host_trees(spark, d)
    return trees.find_in_master(trees.build_master(host_trees.where(_even()), "all"), host_trees)


def tree_json_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    nodes = _nodes(spark, d)
    extra = nodes.select("tree_id", "node_id", "proc_path", F.col("ts").alias("timestamp"))
    docs = tree_json.trees_to_json(trees.paths(nodes), extra)
    return tree_json.trees_from_json(docs)


def host_json(spark: SparkSession, d: str) -> DataFrame:
    """Hosts with their deduped trees and runs as JSON, read again as rows of runs."""
    found = stage(trees.paths(_nodes(spark, d)), "tree-paths")
    kept = _host_trees(spark, d)
    docs = tree_json.trees_to_json(found).join(kept.select("host_id", "tree_id"), "tree_id")
    names = table(spark, d, "host_inventory").groupBy("host_id").agg(F.max("host_name").alias("host_name"))
    hosts = kept.select("host_id").distinct().join(names, "host_id", "left")
    text = tree_json.host_to_json(hosts, docs, kept.select("host_id", "tree_id", "iterations"))
    runs = F.from_json("json", "host_name string, tree_iterations map<string,array<array<string>>>, process_trees map<string,struct<tree_id:string>>")
    return text.select("host_id", runs.alias("j")).select("host_id", F.explode("j.tree_iterations").alias("tree_id", "its"), "j").select(
        "host_id", "tree_id", F.size("its").alias("runs"), F.col("j.process_trees")[F.col("tree_id")]["tree_id"].isNotNull().alias("there"), F.col("j.host_name").alias("host_name")
    )


def master_json(spark: SparkSession, d: str) -> DataFrame:
    return tree_json.master_from_json(tree_json.master_to_json(containing_hosts(spark, d), "all"))


def queries() -> dict:
    names = (
        "tree_edges tree_layers tree_depth tree_leaves tree_width branch_to_trunk branch_truncated tree_validate tree_signature_groups tree_matches tree_find_match subtree subtree_depth "
        "has_subtree last_leaf branch_to_leaf child_names tree_layout tree_elapsed node_edits host_dedupe master_build master_include containing_hosts find_in_master tree_json_roundtrip "
        "host_json master_json"
    ).split()
    return {n: globals()[n] for n in names}


_PLAIN = "replace(replace(lower({}), '{{', ''), '}}', '')"
_T = f"""with recursive p as (select {_PLAIN.format('guid')} as node_id, {_PLAIN.format('parent_guid')} as up, coalesce(tree_id, 'of ' || coalesce(host_id, '')) as tree_id, host_id, proc_name as name, proc_path, rec_id,
    case when lower(trim(proc_ts)) not in ('none', 'nat', '') then try_cast(trim(proc_ts) as timestamp) end as ts from processes where guid is not null
    qualify row_number() over (partition by {_PLAIN.format('guid')} order by rec_id nulls first) = 1),
n as (select p.*, q.node_id as parent_id from p left join p q on q.tree_id = p.tree_id and q.node_id = p.up),
t as (select tree_id, node_id, name, 0 as depth, [node_id] as ids, [name] as names from n where parent_id is null
      union all select n.tree_id, n.node_id, n.name, depth + 1, list_append(ids, n.node_id), list_append(names, n.name) from n join t on n.tree_id = t.tree_id and n.parent_id = t.node_id),
leaf as (select n.* from n where not exists (select 1 from n as c where c.tree_id = n.tree_id and c.parent_id = n.node_id)),
f as (select tree_id, parent_id as node_id, arg_min(node_id, rec_id) as child from n where parent_id is not null group by 1, 2)
"""


def _joined(names: str, sep: str, null: str = "''") -> str:
    return f"array_to_string(list_transform({names}, lambda x: coalesce(x, {null})), '{sep}')"


_SIG = f""", sig as (select tree_id, string_agg({_joined('names', '>', 'chr(1)')}, ',' order by {_joined('names', '>', 'chr(1)')}) as signature from t join leaf using (tree_id, node_id) group by tree_id)"""
_RUN = """, ends as (select tree_id, case when count(ts) = count(*) then max(ts) end as last from leaf group by 1),
    first as (select tree_id, min(node_id) as root_id, arg_min_null(ts, node_id) as start from n where parent_id is null group by 1),
    run as (select tree_id, root_id, start, date_diff('microsecond', start, last) / 1e6 as elapsed from first join ends using (tree_id))"""
_HOSTS = _SIG + _RUN + """, th as (select tree_id, min(host_id) as host_id from n group by 1),
    ht as (select host_id, signature, first(tree_id order by start nulls last, tree_id) as tree_id, count(*) as runs, min(start) as start, count(elapsed) as known
           from sig join run using (tree_id) join th using (tree_id) group by 1, 2)"""
_EVEN = "coalesce(try_cast(substring(host_id, 5) as bigint), 0) % 2 = 0"


def _master(where: str = "true", name: str = "m", start: str = "0") -> str:
    return f""", {name}g as (select signature, min((host_id, tree_id)) as first, count(*) as hosts from ht where {where} group by signature),
    {name} as (select 'all_MasterTree_' || lpad(({start} + row_number() over (order by first))::varchar, 7, '0') as master_id, signature, hosts from {name}g)"""


def oracle_sql() -> dict[str, str]:
    return {
        "tree_edges": _T + "select tree_id, parent_id, node_id from n where parent_id is not null",
        "tree_layers": _T + "select tree_id, depth as layer, count(*) as nodes from t group by all",
        "tree_depth": _T + "select tree_id, coalesce(max(t.depth) + 1, 0)::int as depth from n left join t using (tree_id, node_id) group by tree_id",
        "tree_leaves": _T + "select tree_id, node_id, name from leaf",
        "tree_width": _T + "select tree_id, count(*) as width from leaf group by all",
        "branch_to_trunk": _T + f"select tree_id, node_id, {_joined('list_reverse(names)', '<')} as branch from t",
        "branch_truncated": _T + f""", b as (select tree_id, node_id, list_reverse(names) as up, names[1] as root, len(names) as size, list_position(list_reverse(names)[2:], names[1]) as place from t)
            select tree_id, node_id, {_joined("(case when size > 1 and root is not null and place > 0 then list_append(up[1:place], root) else up end)", '<')} as branch from b""",
        "tree_validate": _T + """, k as (select tree_id, count(*) filter (up is null) as roots, count(*) filter (up is not null and parent_id is null) as orphans, count(*) as nodes from n group by 1),
            r as (select tree_id, count(*) as reached from t group by 1)
            select k.tree_id, roots, orphans, nodes - coalesce(reached, 0) as endless, 0::bigint as repeated, roots = 1 and orphans = 0 and nodes = coalesce(reached, 0) as valid from k left join r using (tree_id)""",
        "tree_signature_groups": _T + _SIG + "select min(tree_id) as first, count(*) as n from sig group by signature",
        "tree_matches": _T + _SIG + "select tree_id, min(tree_id) over (partition by signature) as first, count(*) over (partition by signature) - 1 as matches from sig",
        "tree_find_match": _T + _SIG + "select a.tree_id, b.tree_id as other from sig a join sig b using (signature) where try_cast(substring(a.tree_id, 3) as bigint) % 20 = 0",
        "subtree": _T + """, top as (select parent_id from n where parent_id is not null group by 1 order by count(*) desc, 1 limit 1)
            select tree_id, node_id, (depth - list_position(ids, parent_id) + 1)::int as depth, array_to_string(ids[list_position(ids, parent_id):], '>') as ids from t, top where list_contains(ids, parent_id)""",
        "subtree_depth": _T + "select tree_id, ids[i] as node_id, max(depth - i + 2)::int as height from (select tree_id, ids, depth, unnest(range(1, depth + 2)) as i from t) group by all",
        "has_subtree": _T + """, e as (select n.tree_id, p.node_id, p.name as up, n.name from n join n as p on p.tree_id = n.tree_id and p.node_id = n.parent_id),
            top as (select up, name from e where up is not null and name is not null group by 1, 2 order by count(*) desc, 1, 2 limit 1)
            select distinct tree_id, node_id as start_id from e join top using (up, name)""",
        "last_leaf": _T + """, d as (select tree_id, node_id, node_id as cur from n union select d.tree_id, d.node_id, f.child from d join f on f.tree_id = d.tree_id and f.node_id = d.cur)
            select d.tree_id, d.node_id, coalesce(max(case when f.child is null then cur end), '') as leaf_id from d left join f on f.tree_id = d.tree_id and f.node_id = d.cur group by 1, 2""",
        "branch_to_leaf": _T + f""", d as (select tree_id, node_id, node_id as cur from n union select d.tree_id, d.node_id, f.child from d join f on f.tree_id = d.tree_id and f.node_id = d.cur),
            l as (select d.tree_id, d.node_id, coalesce(max(case when f.child is null then cur end), '') as leaf_id from d left join f on f.tree_id = d.tree_id and f.node_id = d.cur group by 1, 2),
            b as (select tree_id, node_id, node_id as cur, leaf_id, [name] as names from n join l using (tree_id, node_id) where leaf_id <> ''
                  union all select b.tree_id, b.node_id, n.node_id, leaf_id, list_append(names, n.name) from b join f on f.tree_id = b.tree_id and f.node_id = b.cur join n on n.tree_id = b.tree_id and n.node_id = f.child)
            select tree_id, node_id, leaf_id, {_joined('names', '>')} as branch from b where cur = leaf_id union all select tree_id, node_id, leaf_id, null from l where leaf_id = ''""",
        "child_names": _T + "select n.tree_id, n.node_id, count(c.node_id) as children, coalesce(string_agg(distinct c.name, '|' order by c.name), '') as names from n left join n as c on c.tree_id = n.tree_id and c.parent_id = n.node_id group by all",
        "tree_layout": _T + """, mx as (select tree_id, max(depth) as last from t group by 1), x as (select t.tree_id, ids, (row_number() over (partition by t.tree_id order by ids) - 1) / greatest(count(*) over (partition by t.tree_id) - 1, 1) as y from t join leaf using (tree_id, node_id)),
            y as (select tree_id, node_id, max(y) as y from (select tree_id, unnest(ids) as node_id, y from x) group by all)
            select tree_id, node_id, round(depth / greatest(last, 1), 6) as x, round(y, 6) as y from t join mx using (tree_id) join y using (tree_id, node_id)""",
        "tree_elapsed": _T + _RUN + "select tree_id, root_id, start, round(elapsed, 6) as elapsed from run",
        "node_edits": _T + """, r as (select tree_id as in_tree, node_id as root from n where parent_id is null order by 1, 2 limit 1), c as (select in_tree, root, (select min(node_id) from n where tree_id = in_tree and parent_id = root) as child from r)
            select tree_id, node_id, case when tree_id = in_tree and node_id = root then 'top' when tree_id = in_tree and parent_id = child then null else parent_id end as parent_id, name from n, c where not (tree_id = in_tree and node_id is not distinct from child)
            union all select in_tree, 'top', null, 'boot' from c union all select in_tree, 'extra', root, 'late' from c""",
        "host_dedupe": _T + _HOSTS + "select host_id, tree_id, runs, start, known::int as known from ht",
        "master_build": _T + _HOSTS + _master() + "select master_id, hosts from m",
        "master_include": _T + _HOSTS + _master(_EVEN) + _master(f"not ({_EVEN}) and signature not in (select signature from m)", "o", "(select count(*) from m)") + f"""
            select master_id, hosts + (select count(*) from ht where not ({_EVEN}) and ht.signature = m.signature) as hosts from m union all select master_id, hosts from o""",
        "containing_hosts": _T + _HOSTS + _master() + "select master_id, host_id, tree_id from m join ht using (signature)",
        "find_in_master": _T + _HOSTS + _master(_EVEN) + "select tree_id, master_id from m join ht using (signature)",
        "tree_json_roundtrip": _T + "select tree_id, node_id, parent_id, n.name, proc_path, ts from n join t using (tree_id, node_id)",
        "host_json": _T + _HOSTS + ", hn as (select host_id, max(host_name) as host_name from host_inventory group by 1) select host_id, tree_id, runs::int as runs, true as there, host_name from ht left join hn using (host_id)",
        "master_json": _T + _HOSTS + _master() + "select 'all' as name, master_id, host_id, tree_id from m join ht using (signature)",
    }
