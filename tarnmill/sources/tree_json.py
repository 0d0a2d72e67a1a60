"""Layered tree JSON: {"tree_id", "nodes": {layer: {ordinal: node}}}, written and read."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_NODE = "node_id string, name string, tree_id string, parent string, children map<string,string>, proc_path string, timestamp string"
_TREE = f"tree_id string, nodes map<string,map<string,struct<{_NODE.replace(' ', ':').replace(',:', ',')}>>>"


def trees_to_json(found: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """(tree_id, json) of the rows of `trees.paths`; nodes that no root reaches are left out. A tree is
    one document, so its nodes are gathered in one row. `extra` (tree_id, node_id, proc_path,
    timestamp) is written with the nodes; nulls are left out."""
    rows = found.where("depth >= 0").select("tree_id", "node_id", "name", "depth", F.get("ids", F.col("depth") - 1).alias("parent"))
    if extra is not None:
        rows = rows.join(extra, ["tree_id", "node_id"], "left").withColumn("timestamp", F.col("timestamp").cast("string"))
    w = Window.partitionBy("tree_id", "depth").orderBy("node_id")
    kid = Window.partitionBy("tree_id", "parent").orderBy("node_id")
    kids = rows.where("parent is not null").withColumn("i", (F.row_number().over(kid) - 1).cast("string")).groupBy("tree_id", F.col("parent").alias("node_id")).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("i", F.col("node_id").alias("child"))))).alias("children")
    )
    more = ["proc_path", "timestamp"] if extra is not None else []
    node = F.struct("node_id", "name", "tree_id", "parent", "children", *more)
    layered = rows.join(kids, ["tree_id", "node_id"], "left").withColumn("ord", (F.row_number().over(w) - 1).cast("string")).groupBy("tree_id", F.col("depth").cast("string").alias("layer")).agg(
        F.map_from_entries(F.collect_list(F.struct("ord", node.alias("node")))).alias("layer_nodes")
    )
    doc = layered.groupBy("tree_id").agg(F.map_from_entries(F.collect_list(F.struct("layer", "layer_nodes"))).alias("nodes"))
    return doc.select("tree_id", F.to_json(F.struct("tree_id", "nodes")).alias("json"))


def trees_from_json(docs: DataFrame, column: str = "json") -> DataFrame:
    """(tree_id, node_id, parent_id, name, proc_path, ts) of layered tree JSON. Stamps 'None' and
    'NaT' are null; documents that are not valid give nothing."""
    tree = F.from_json(column, _TREE)
    nodes = docs.select(tree.alias("t")).select("t.tree_id", F.explode("t.nodes").alias("layer", "ns")).select("tree_id", F.explode("ns").alias("ord", "n"))
    return nodes.select(
        "tree_id", F.col("n.node_id").alias("node_id"), F.col("n.parent").alias("parent_id"), F.col("n.name").alias("name"), F.col("n.proc_path").alias("proc_path"), parse_stamp(F.col("n.timestamp")).alias("ts")
    )


def parse_stamp(text):
    """A stamp in any of the usual spellings; null for 'None', 'NaT' and what is no stamp."""
    return F.try_to_timestamp(F.when(~F.lower(F.trim(text)).isin("none", "nat", ""), F.trim(text))).cast("timestamp_ntz")


def host_to_json(hosts: DataFrame, trees: DataFrame, iterations: DataFrame) -> DataFrame:
    """(host_id, json): host fields, tree_iterations {tree: [[start, elapsed, node]]} and
    process_trees {tree: tree JSON}, of (host_id, ...), (host_id, tree_id, json) and (host_id,
    tree_id, iterations array<struct<start, elapsed, root_id>>)."""
    runs = F.transform("iterations", lambda x: F.array(x["start"].cast("string"), x["elapsed"].cast("string"), x["root_id"].cast("string")))
    its = iterations.select("host_id", "tree_id", runs.alias("runs")).groupBy("host_id").agg(F.map_from_entries(F.collect_list(F.struct("tree_id", "runs"))).alias("tree_iterations"))
    ts = trees.select("host_id", "tree_id", F.from_json("json", _TREE).alias("t")).groupBy("host_id").agg(F.map_from_entries(F.collect_list(F.struct("tree_id", "t"))).alias("process_trees"))
    every = hosts.join(its, "host_id", "left").join(ts, "host_id", "left")
    return every.select("host_id", F.to_json(F.struct(*[c for c in every.columns])).alias("json"))


def master_to_json(mapping: DataFrame, name: str) -> DataFrame:
    """(name, master_id, json) of (master_id, host_id, tree_id): a master tree is one document, so its
    hosts are gathered in one row."""
    hosts = mapping.groupBy("master_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("host_id", "tree_id")))).alias("tree_host_mapping"))
    body = F.struct(F.lit(name).alias("name"), "master_id", "tree_host_mapping")
    return hosts.select(F.lit(name).alias("name"), "master_id", F.to_json(body).alias("json"))


def master_from_json(docs: DataFrame, column: str = "json") -> DataFrame:
    """(name, master_id, host_id, tree_id)."""
    m = F.from_json(column, "name string, master_id string, tree_host_mapping map<string,string>")
    return docs.select(m.alias("m")).select("m.name", "m.master_id", F.explode("m.tree_host_mapping").alias("host_id", "tree_id"))
