"""Queries over processes, raw_reports and agent_states, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import hierarchy, nested
from ..operators.skew import skew_join
from ..sources.tables import table
from ..staging import stage


def _ancestors(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.ancestors(hierarchy.clean_processes(table(spark, d, "processes")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Depth is that of the whole path: the number of nodes above."""
    found = _ancestors(spark, d).where((F.col("depth") < 0) | (F.size("names") > 12))
    return found.select(F.col("node").alias("guid"), F.col("root").alias("root_guid"))


def p5_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.hierarchy(_ancestors(spark, d)).withColumnsRenamed({"node": "guid", "root": "root_guid"})


def p5_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(_ancestors(spark, d)).withColumnRenamed("node", "guid")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.process_nodes(table(spark, d, "raw_reports")).select("report_id", "tree_id", "node_id", "parent_id")


def p6_nodes(spark: SparkSession, d: str) -> DataFrame:
    return nested.process_nodes(table(spark, d, "raw_reports"))


def p6_trees(spark: SparkSession, d: str) -> DataFrame:
    """Each tree with the number of trees, its own included, that are equal to it."""
    found = stage(nested.report_trees(table(spark, d, "raw_reports")), "report-trees")
    return skew_join(found, found.groupBy("hash").agg(F.count("*").alias("equal")), ["hash"]).select("report_id", "tree_id", "ordinal", "equal")


def p6_reports(spark: SparkSession, d: str) -> DataFrame:
    return nested.report_hosts(table(spark, d, "raw_reports"))


def p6_iterations(spark: SparkSession, d: str) -> DataFrame:
    return nested.report_iterations(table(spark, d, "raw_reports"))


def flatten_json(spark: SparkSession, d: str) -> DataFrame:
    """All leaves of raw_reports.body, those of its trees and their runs too."""
    return nested.flatten_json(table(spark, d, "raw_reports"), "report_id", "body")


def _state_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    states = table(spark, d, "agent_states")
    body = F.to_json(F.struct(*[c for c in states.columns if c != "state_id"]))
    return nested.merkle_tables(states.select("state_id", body.alias("body")), "state_id", "body")


def p6_objects(spark: SparkSession, d: str) -> DataFrame:
    """Distinct subtrees of agent_states, with the number of their occurrences."""
    return _state_tables(spark, d)[0]


def p6_states(spark: SparkSession, d: str) -> DataFrame:
    return nested.state_rows(*_state_tables(spark, d))


def p6_nics(spark: SparkSession, d: str) -> DataFrame:
    return nested.state_nics(*_state_tables(spark, d))


def p6_addresses(spark: SparkSession, d: str) -> DataFrame:
    return nested.state_addresses(*_state_tables(spark, d))


def p6_tags(spark: SparkSession, d: str) -> DataFrame:
    return nested.state_tags(*_state_tables(spark, d))


def p6_marks(spark: SparkSession, d: str) -> DataFrame:
    return nested.state_marks(*_state_tables(spark, d))


def queries() -> dict:
    names = "flatten_json p5_found p5_hierarchy p5_descendants p6_found p6_nodes p6_trees p6_reports p6_iterations p6_objects p6_states p6_nics p6_addresses p6_tags p6_marks".split()
    return {n: globals()[n] for n in names}


_TREE = """with recursive p as (
  select replace(replace(lower(guid), '{', ''), '}', '') as guid, replace(replace(lower(parent_guid), '{', ''), '}', '') as parent, proc_name from processes where guid is not null
  qualify row_number() over (partition by replace(replace(lower(guid), '{', ''), '}', '') order by rec_id nulls first) = 1),
l as (select p.guid, q.guid as up, p.proc_name from p left join p q on p.parent = q.guid),
t as (select guid, guid as root, 0 as depth, coalesce(proc_name, '') as path, [guid] as ids from l where up is null
      union all select l.guid, t.root, t.depth + 1, t.path || '/' || coalesce(l.proc_name, ''), list_append(t.ids, l.guid) from l join t on l.up = t.guid),
below as (select node, count(*) as descendants from (select unnest(ids[:-2]) as node from t) group by node)
"""


_BODY = """with recursive b0 as (select report_id, case when json_valid(body) then case when json_type(body) = 'VARCHAR' then body ->> '$' else body end end as body from raw_reports),
b as (select report_id, case when json_valid(body) then case when json_type(body) = 'VARCHAR' then body ->> '$' else body end end as body from b0),
t as materialized (select report_id, x.id, x.parent, x.key, x.type, x.value from (select * from b where json_valid(body)) b, json_tree(b.body) x),
"""
_NODES = _BODY + """pt as (select t.report_id, t.id, t.type from t join t as r on r.report_id = t.report_id and r.parent is null and t.parent = r.id and r.type = 'OBJECT' where t.key = 'process_trees'),
w as (select t.report_id, t.id, t.type, coalesce(t.value ->> 'tree_id', case when pt.type = 'OBJECT' then t.key end, '') as tree_id, null::varchar as owner, t.value
      from t join pt on t.report_id = pt.report_id and t.parent = pt.id where t.type in ('OBJECT', 'ARRAY')
      union all select t.report_id, t.id, t.type, w.tree_id, coalesce(case when w.type = 'OBJECT' then w.value ->> 'node_id' end, w.owner), t.value
      from t join w on t.report_id = w.report_id and t.parent = w.id where t.type in ('OBJECT', 'ARRAY')),
n as (select report_id, tree_id, value ->> 'node_id' as node_id, coalesce(value ->> 'parent', owner, '') as parent_id, value ->> 'name' as name,
      case when value ->> 'timestamp' not in ('None', 'NaT', '') then value ->> 'timestamp' end as ts, value ->> 'proc_path' as proc_path from w where type = 'OBJECT' and value ->> 'node_id' is not null)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p5_found": _TREE + "select guid, root as root_guid from t where depth >= 12 union all select guid, '' from p where guid not in (select guid from t)",
        "p5_hierarchy": _TREE + """select p.guid, coalesce(root, '') as root_guid, coalesce(depth, -1) as depth, path, coalesce(descendants, 0) as descendants, root is null as endless
            from p left join t using (guid) left join below on below.node = p.guid""",
        "p5_descendants": _TREE + "select ids[i] as guid, guid as descendant, (depth + 1 - i)::int as distance from (select guid, ids, depth, unnest(range(1, depth + 1)) as i from t)",
        "p6_found": _NODES + "select distinct report_id, tree_id, node_id, parent_id from n",
        "p6_nodes": _NODES + "select report_id, tree_id, node_id, parent_id, min(name) as name, min(ts) as ts, min(proc_path) as proc_path from n group by all",
        "p6_trees": _BODY + """pt as (select t.report_id, t.id, t.type from t join t as r on r.report_id = t.report_id and r.parent is null and t.parent = r.id and r.type = 'OBJECT' where t.key = 'process_trees' and t.type in ('OBJECT', 'ARRAY')),
            e as (select t.report_id, t.id, t.value, t.key, pt.type as box, row_number() over (partition by t.report_id order by t.id) - 1 as ordinal from t join pt on t.report_id = pt.report_id and t.parent = pt.id),
            w as (select report_id, id as entry, id, '' as path from e union all select t.report_id, w.entry, t.id, w.path || '/' || coalesce(t.key, '') from t join w on t.report_id = w.report_id and t.parent = w.id),
            l as (select w.report_id, w.entry, string_agg(w.path || t.type || case when t.type in ('OBJECT', 'ARRAY') then '' else t.value::varchar end, chr(1) order by w.path) as whole from w join t on t.report_id = w.report_id and t.id = w.id group by 1, 2)
            select e.report_id, coalesce(e.value ->> 'tree_id', case when box = 'OBJECT' then e.key end, '') as tree_id, ordinal::int as ordinal, count(*) over (partition by whole) as equal
            from e join l on l.report_id = e.report_id and l.entry = e.id where json_type(e.value) = 'OBJECT'""",
        "p6_reports": _BODY.rstrip(",\n ") + """ select report_id, value ->> 'host_id' as host_id, value ->> 'host_name' as host_name, value ->> 'op_sys' as op_sys, value ->> 'ip' as ip,
            case when json_type(value, '$.env') = 'OBJECT' then value ->> '$.env.stage' else value ->> 'env' end as env from t where parent is null and type = 'OBJECT'""",
        "p6_iterations": _BODY.rstrip(",\n ") + """ select r.report_id, l.key as tree_id, i.key::int as ordinal, i.value ->> '$[0]' as start, try_cast(i.value ->> '$[1]' as double) as elapsed, i.value ->> '$[2]' as node_id
            from t as r join t as m on m.report_id = r.report_id and m.parent = r.id and m.key = 'tree_iterations' join t as l on l.report_id = r.report_id and l.parent = m.id and m.type = 'OBJECT' and l.type = 'ARRAY'
            join t as i on i.report_id = r.report_id and i.parent = l.id and i.type = 'ARRAY' where r.parent is null""",
        "p6_states": """select state_id, host.id as host_id, coalesce(host.os, host_os) as host_os, host.site.room as host_site_room, host.site.rack as host_site_rack,
            coalesce(disk.main.mount, disk_main_mount) as disk_main_mount, disk.main.label as disk_main_label,
            case when isnan(disk.main.size_gb) then null else disk.main.size_gb end as disk_main_size_gb, disk.encrypted as disk_encrypted from agent_states""",
        "p6_nics": "select state_id, (i - 1)::int as nic_ord, nics[i].nic as nic, nics[i].mtu as mtu from (select state_id, nics, unnest(range(1, len(nics) + 1)) as i from agent_states)",
        "p6_addresses": """select state_id, nic_ord, (j - 1)::int as addr_ord, a[j].ip as ip, array_to_string(a[j].scopes, ',') as scopes from
            (select state_id, nic_ord, a, unnest(range(1, len(a) + 1)) as j from
              (select state_id, (i - 1)::int as nic_ord, nics[i].addrs as a from (select state_id, nics, unnest(range(1, len(nics) + 1)) as i from agent_states)))""",
        "p6_tags": "select state_id, (i - 1)::int as tag_ord, tags[i] as tag from (select state_id, host.site.tags as tags, unnest(range(1, len(host.site.tags) + 1)) as i from agent_states)",
        "p6_marks": "select state_id, e.key as mark, e.value as value from (select state_id, unnest(map_entries(marks)) as e from agent_states)",
    }
