"""Queries over their whole input at the second scale, beside their SQL or brute force."""

import json
import math
from collections import Counter

import pytest
from conftest import FOLDER

from compare import difference, duck, rows_of
from tarnmill.plans import feature_queries, markov_queries, misc_queries, nested_queries, series_queries, tree_queries

#: Several users to a host of the tree queries, so that some of their small trees are equal.
FOLDER_01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def con_01():
    return duck(FOLDER_01)


def whole_body(text):
    def bad(x):
        raise ValueError(x)

    try:
        v = json.loads(text, parse_int=lambda x: ("number", x), parse_float=lambda x: ("number", x), parse_constant=bad)
        while isinstance(v, str):
            v = json.loads(v, parse_int=lambda x: ("number", x), parse_float=lambda x: ("number", x), parse_constant=bad)
        return v
    except (ValueError, TypeError):
        return None


def as_json(v):
    if isinstance(v, tuple):
        return v[1]
    if isinstance(v, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{as_json(v[k])}" for k in sorted(v)) + "}"
    return "[" + ",".join(map(as_json, v)) + "]" if isinstance(v, list) else json.dumps(v, ensure_ascii=False)


def leaves_of(v, at=()):
    if isinstance(v, dict):
        for k, x in v.items():
            yield from leaves_of(x, (*at, k))
    else:
        yield "->".join(at), v if v is None or isinstance(v, str) else as_json(v)


def test_flatten_json_gives_all_leaves(spark, tmp_path):
    """Against brute force: the leaves of trees and runs are leaves like any others."""
    body = '{"host_id":7,"process_trees":{"t":{"nodes":{"0":{"0":{"name":"a","n":1.50}}}}},"tree_iterations":{"t":[["s",2,"x"]]},"env":{"stage":"p"}}'
    spark.createDataFrame([(1, body)], "report_id bigint, body string").write.parquet(f"{tmp_path}/raw_reports.parquet")
    got = sorted(tuple(r) for r in nested_queries.flatten_json(spark, str(tmp_path)).collect())
    assert got == [
        (1, "env->stage", "p"), (1, "host_id", "7"), (1, "process_trees->t->nodes->0->0->n", "1.50"), (1, "process_trees->t->nodes->0->0->name", "a"), (1, "tree_iterations->t", '[["s",2,"x"]]'),
    ]
    reports = spark.read.parquet(f"{FOLDER}/raw_reports.parquet").collect()
    want = [(r["report_id"], *x) for r in reports if isinstance(v := whole_body(r["body"]), dict) for x in leaves_of(v)]
    assert sum(p.startswith("process_trees") for _, p, _ in want) > 100
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in nested_queries.flatten_json(spark, FOLDER).collect())


TREES = "tree_signature_groups tree_matches tree_find_match tree_layout node_edits host_dedupe master_build master_include containing_hosts find_in_master host_json master_json".split()


@pytest.mark.parametrize("name", TREES)
def test_whole_trees(spark, con_01, name):
    """Against the query's SQL over all processes."""
    df = tree_queries.queries()[name](spark, FOLDER_01)
    assert difference(rows_of(df), df.columns, con_01, tree_queries.oracle_sql()[name]) == ""


@pytest.fixture(scope="session", params=[3, 4, 7])
def small_trees(request, con_01, tmp_path_factory):
    """Heap-shaped trees of each user's first few events, five users to a host, so that some are equal."""
    folder = tmp_path_factory.mktemp(f"trees{request.param}")
    con_01.execute(f"""copy (with s as (select user_id as u, row_number() over (partition by user_id order by ts, event_id) as pos, event_type, ts from events)
        select u * 100 + pos as rec_id, 'hst-' || lpad((u // 5)::varchar, 8, '0') as host_id, 'tr' || lpad(u::varchar, 10, '0') as tree_id, '{{N' || u || '-' || pos || '}}' as guid,
        case when pos > 1 then 'n' || u || '-' || (pos // 2) end as parent_guid, event_type as proc_name, '/opt/' || event_type as proc_path, ts::varchar as proc_ts
        from s where pos <= {request.param}) to '{folder}/processes.parquet'""")
    con_01.execute(f"copy host_inventory to '{folder}/host_inventory.parquet'")
    return str(folder)


@pytest.mark.parametrize("name", TREES)
def test_small_trees(spark, small_trees, name):
    """Trees of a few nodes, of which some are equal."""
    df = tree_queries.queries()[name](spark, small_trees)
    got = rows_of(df)
    assert difference(got, df.columns, duck(small_trees), tree_queries.oracle_sql()[name]) == ""
    if name == "tree_signature_groups" and not small_trees.endswith("70"):
        assert 1 < len(got) < 150


def test_order2_scores_whole_sequences(spark, con_01):
    """Against brute force: the end is that of the user's sequence, and long sequences don't round to 0."""
    seqs = {}
    for user, log in con_01.execute("select user_id, event_type from events order by user_id, ts, event_id").fetchall():
        seqs.setdefault(user, []).append(log)
    assert min(map(len, seqs.values())) > 5
    steps = {u: [((a, b), c) for a, b, c in zip(xs, xs[1:], [*xs[2:], "<EOS>"])] for u, xs in seqs.items()}
    step, state = Counter(s for x in steps.values() for s in x), Counter(s[0] for x in steps.values() for s in x)
    start = Counter((xs[0], xs[1]) for xs in seqs.values())
    want = {u: math.log(start[x[0][0]] / len(seqs)) + math.fsum(math.log(step[s] / state[s[0]]) for s in x) for u, x in steps.items()}
    got = {r["host"]: r["log_prob"] for r in markov_queries.order2_sequence_probability(spark, FOLDER_01).collect()}
    assert got == pytest.approx(want, abs=2e-6) and max(want.values()) < -20


def test_sliding_window_over_whole_sequences(spark, con_01):
    df = feature_queries.sliding_window(spark, FOLDER_01)
    assert difference(rows_of(df), df.columns, con_01, feature_queries.oracle_sql()["sliding_window"]) == ""


STATES = "state_id bigint, host struct<id:string,os:string,site:struct<room:string,rack:int,tags:array<string>>>, host_os string, nics array<struct<nic:string,mtu:int,addrs:array<struct<ip:string,scopes:array<string>>>>>, disk struct<main:struct<mount:string,label:string,size_gb:double>,encrypted:boolean>, disk_main_mount string, marks map<string,string>, legacy_note string"


def test_states_keep_every_nested_value(spark, tmp_path):
    nics = [("e0", 1500, [("::1", ["a", None, "b"]), None, ("x", []), ("y", None)]), None, (None, None, None), ("e1", 9, [])]
    data = [
        (1, ("h", None, ("r", 3, ["t", None, "t"])), "os", nics, (("/", "é\"/", float("nan")), True), None, {"k": "v", "n": None, "a/~b": "1.50"}, None),
        (2, None, None, [], ((None, None, 1e-7), False), "/m", {}, None),
        (3, (None, None, None), None, None, None, None, None, None),
    ]
    spark.createDataFrame(data, STATES).write.parquet(f"{tmp_path}/agent_states.parquet")
    got = {n: sorted((tuple(r) for r in nested_queries.queries()[n](spark, str(tmp_path)).collect()), key=str) for n in "p6_states p6_nics p6_addresses p6_tags p6_marks".split()}
    assert got["p6_states"] == [(1, "h", "os", "r", 3, "/", "é\"/", None, True), (2, None, None, None, None, "/m", None, 1e-7, False), (3, *[None] * 8)]
    assert got["p6_nics"] == [(1, 0, "e0", 1500), (1, 1, None, None), (1, 2, None, None), (1, 3, "e1", 9)]
    assert got["p6_addresses"] == [(1, 0, 0, "::1", "a,b"), (1, 0, 1, None, None), (1, 0, 2, "x", ""), (1, 0, 3, "y", None)]
    assert got["p6_tags"] == [(1, 0, "t"), (1, 1, None), (1, 2, "t")]
    assert got["p6_marks"] == [(1, "a/~b", "1.50"), (1, "k", "v"), (1, "n", None)]
    states = spark.read.parquet(f"{FOLDER_01}/agent_states.parquet").collect()
    tags = sorted((r["state_id"], i, t) for r in states if r["host"] and r["host"]["site"] for i, t in enumerate(r["host"]["site"]["tags"] or []))
    marks = sorted(((r["state_id"], k, v) for r in states for k, v in (r["marks"] or {}).items()), key=str)
    assert len(tags) > 50 and len(marks) > 50
    assert sorted(tuple(r) for r in nested_queries.p6_tags(spark, FOLDER_01).collect()) == tags
    assert sorted((tuple(r) for r in nested_queries.p6_marks(spark, FOLDER_01).collect()), key=str) == marks


def test_vectorizer_takes_every_host(spark, con_01):
    df = feature_queries.vectorizer_transform(spark, FOLDER_01)
    assert difference(rows_of(df), df.columns, con_01, feature_queries.oracle_sql()["vectorizer_transform"]) == ""


def test_every_week_has_its_column(spark, tmp_path):
    spark.sql("select timestamp_ntz'2024-01-01 05:00:00' + make_dt_interval(7 * id) as ts from range(8)").write.parquet(f"{tmp_path}/events.parquet")
    df = series_queries.split_overlapping_weeks(spark, str(tmp_path))
    assert sorted(df.columns) == sorted(["label", *[f"week_{i}" for i in range(8)]])
    got = {r["label"]: [r[f"week_{i}"] for i in range(8)] for r in df.collect()}
    assert got == {"monday-05:00": [1] * 8, "+monday-05:00": [1] * 7 + [None]}


def test_profiles_take_every_column(spark):
    states = spark.read.parquet(f"{FOLDER_01}/agent_states.parquet").collect()
    profile = misc_queries.null_profile(spark, FOLDER_01).first().asDict()
    assert profile["nics"] == sum(r["nics"] is None for r in states) and profile["marks"] == sum(r["marks"] is None for r in states)
    assert profile["host_site_tags"] == sum(not (r["host"] and r["host"]["site"] and r["host"]["site"]["tags"] is not None) for r in states)
    kept = misc_queries.drop_all_null(spark, FOLDER_01)
    assert set(kept.columns) == set(profile) - {"legacy_note"} and {"nics", "marks", "host_site_tags", "host_os", "disk_main_mount"} <= set(kept.columns)
    plain = lambda v: None if v is None else json.loads(json.dumps(v.asDict(True) if hasattr(v, "asDict") else [x.asDict(True) for x in v] if isinstance(v, list) else v))
    want = {r["state_id"]: (plain(r["nics"]), plain(r["marks"])) for r in states}
    assert {r["state_id"]: tuple(None if r[c] is None else json.loads(r[c]) for c in ("nics", "marks")) for r in kept.collect()} == want
