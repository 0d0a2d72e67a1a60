"""Hot keys and the ways for large tables: every bound that chooses between ways is set to its least."""

import math
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnmill import staging
from tarnmill.operators import features, hierarchy, itemsets, markov, nested, network, sampling, sequences, skew, stats, trees
from tarnmill.staging import stage


@pytest.fixture(autouse=True)
def everything_is_large(monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 0)
    monkeypatch.setattr(staging, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(sequences, "DAY_ROWS", 0)
    monkeypatch.setattr(sequences, "BLOCK", 8)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skew_join_is_a_join(spark, how):
    many = stage(spark.createDataFrame([(i, None if i % 7 == 0 else "hot" if i % 3 else f"k{i % 20}") for i in range(600)], "id bigint, k string"), "many")
    one = spark.createDataFrame([("hot", 1), ("k3", 2), ("k5", 3), (None, 4)], "k string, v int")
    assert rows(skew.skew_join(many, one, ["k"], how)) == rows(many.join(one, ["k"], how))
    two = one.unionByName(spark.createDataFrame([("hot", 9)], one.schema))
    assert rows(skew.skew_join(many, two, ["k"], how)) == rows(many.join(two, ["k"], how))


def test_hot_key_is_spread(spark):
    """A third of all rows, and as many without key, under one key: no task of the join gets them all."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        many = stage(spark.range(9000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("k"), F.col("id"))).alias("k")), "many")
        one = many.where("k is not null").select("k").distinct().withColumn("v", F.lit(1))
        assert [r["k"] for r in skew.hot_keys(many, ["k"], 9000).collect()] == ["hot"]
        tasks = lambda df: [r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.sum("v")).collect()]
        assert max(tasks(many.join(one, ["k"], "left"))) >= 3000
        assert max(tasks(skew.skew_join(many, one, ["k"], "left"))) < 1500
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def random_forest(seed, n=300):
    """A third of all nodes under one parent, a long chain, and some cycles."""
    rng = random.Random(seed)
    parent = {f"c{i}": f"c{i - 1}" if i else None for i in range(40)} | {f"s{i}": "c20" for i in range(n // 3)} | {"x": "y", "y": "z", "z": "x", "w": "w"}
    for i in range(n):
        parent[f"n{i}"] = rng.choice([None, "gone", rng.choice(list(parent))])
    return parent


def depth_of(parent):
    def depth(x):
        seen = []
        while x in parent and x not in seen:
            seen.append(x)
            x = parent[x]
        return -1 if x in seen else len(seen) - 1

    return {x: depth(x) for x in parent}


def test_forest_with_a_hot_parent(spark):
    parent = random_forest(3)
    want = depth_of(parent)
    df = spark.createDataFrame([(k, p, None if k == "c3" else k.upper()) for k, p in parent.items()], "guid string, parent_guid string, proc_name string")
    a = hierarchy.ancestors(df).collect()
    assert {r["node"]: r["depth"] for r in a} == want
    for r in a:
        if r["depth"] >= 0:
            ids = [r["node"]]
            while parent.get(ids[0]) in parent:
                ids.insert(0, parent[ids[0]])
            assert r["ids"] == ids and r["root"] == ids[0] and r["names"] == [None if x == "c3" else x.upper() for x in ids]
        else:
            assert r["root"] == "" and r["ids"] is None
    assert {r["node"]: (r["root"], r["depth"]) for r in hierarchy.roots(df).collect()} == {r["node"]: (r["root"], r["depth"]) for r in a}
    below = {x: d for x, d in want.items() if d >= 0}
    for x in below:
        at, d = x, want[x]
        while parent.get(at) in parent:
            at = parent[at]
            below[at] = max(below[at], d)
    got = hierarchy.deepest_below(df, stage(hierarchy.roots(df).select("node", "depth"), "levels"))
    assert {r["node"]: r["below"] for r in got.collect()} == below


def test_trees_with_a_hot_parent(spark):
    nodes = stage(spark.createDataFrame([("t", "r", None, "root")] + [("t", f"k{i}", "r", "kid") for i in range(200)] + [("t", "g", "k7", "leaf"), ("u", "r", None, "root"), ("u", "k", "gone", "kid")], "tree_id string, node_id string, parent_id string, name string"), "nodes")
    whole = trees.with_known_parents(nodes)
    assert whole.where("parent_id is null").count() == 3
    pattern = trees.paths(spark.createDataFrame([("p", "1", None, "root"), ("p", "2", "1", "kid"), ("p", "3", "1", "kid"), ("p", "4", "3", "leaf")], nodes.schema))
    assert rows(trees.has_subtree(whole, pattern)) == [("t", "r")]
    heights = {(r["tree_id"], r["node_id"]): r["height"] for r in trees.subtree_depths(whole, stage(trees.levels(whole), "levels")).collect()}
    assert heights["t", "r"] == 3 and heights["t", "k7"] == 2 and heights["t", "k1"] == 1 and heights["u", "k"] == 1
    sig = stage(spark.createDataFrame([(f"t{i}", "same" if i % 3 else f"s{i}") for i in range(90)], "tree_id string, signature string"), "signatures")
    got = {r["tree_id"]: (r["first"], r["matches"]) for r in trees.match_groups(sig).collect()}
    assert got["t1"] == ("t1", 59) and got["t3"] == ("t3", 0) and len(got) == 90


def test_include_trees(spark):
    made = lambda data: spark.createDataFrame(data, "host_id string, tree_id string, signature string")
    old, new = made([("h1", "a", "s1"), ("h2", "b", "s2")]), made([("h3", "c", "s2"), ("h3", "d", "s9"), ("h4", "e", "s9")])
    got = {r["signature"]: (r["master_id"], r["hosts"]) for r in trees.include_trees(trees.build_master(old, "m"), new, "m").collect()}
    assert got == {"s1": ("m_MasterTree_0000001", 1), "s2": ("m_MasterTree_0000002", 2), "s9": ("m_MasterTree_0000003", 2)}
    assert rows(trees.include_trees(trees.build_master(old, "m"), new.limit(0), "m")) == rows(trees.build_master(old, "m"))


def test_branch_to_leaf(spark):
    nodes = spark.createDataFrame([("t", "a", None, "A"), ("t", "b", "a", "B"), ("t", "c", "a", None), ("t", "d", "b", "D"), ("t", "x", "y", "X"), ("t", "y", "x", "Y")], "tree_id string, node_id string, parent_id string, name string")
    got = {r["node_id"]: (r["leaf_id"], r["branch"]) for r in trees.branch_to_leaf(nodes).collect()}
    assert got == {"a": ("d", ["A", "B", "D"]), "b": ("d", ["B", "D"]), "c": ("c", [None]), "d": ("d", ["D"]), "x": ("", None), "y": ("", None)}


def test_repeated_subtrees_are_looked_up(spark):
    """Nearly all nodes are one object; reports hold it many times, and again in other tasks."""
    node = '{"node_id": "n", "name": "same", "tree_id": "t"}'
    bodies = [(i, f'{{"process_trees": {{"t": {{"tree_id": "t", "nodes": [{node}, {node}, {{"node_id": "m{i}", "children": [{node}]}}]}}}}}}') for i in range(60)]
    df = spark.createDataFrame(bodies, "report_id bigint, body string").repartition(4)
    got = rows(nested.process_nodes(df).select("report_id", "tree_id", "node_id", "parent_id", "name"))
    want = [(i, "t", n, p, name) for i in range(60) for n, p, name in (("n", "", "same"), ("n", f"m{i}", "same"), (f"m{i}", "", None))]
    assert got == sorted(want, key=str)


def test_long_days_are_numbered_alike(spark):
    rng = random.Random(2)
    data = [(rng.choice("aab"), rng.choice([None, 1, 2, 3]), i, f"e{i}") for i in range(200)]
    df = spark.createDataFrame(data, "h string, d int, tie int, log string").withColumn("ts", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(d)"))
    got = {(r["host"], r["pos"]): r["log"] for r in sequences.to_sequences(df, "h", "ts", "tie", "log").collect()}
    want = {}
    for h in "ab":
        for pos, x in enumerate(sorted((x for x in data if x[0] == h), key=lambda x: (x[1] is not None, x[1] or 0, x[2])), 1):
            want[h, pos] = x[3]
    assert got == want


def test_quantiles_and_modes(spark):
    rng = random.Random(4)
    data = [(rng.choice(["a", "a", "b", None]), rng.choice([None, float(rng.randint(0, 9)), round(rng.random(), 2)])) for _ in range(500)] + [("one", 3.0)]
    df = spark.createDataFrame(data, "g string, v double")
    of = lambda g: [v for x, v in data if x == g and v is not None]
    got = {r["g"]: r["q"] for r in stats.quantiles(df, "v", [0.0, 0.25, 0.5, 0.9, 1.0], ["g"]).collect()}
    for g in ("a", "b", None, "one"):
        assert got[g] == pytest.approx(list(np.quantile(of(g), [0.0, 0.25, 0.5, 0.9, 1.0])))
    modes = {r["g"]: r["value"] for r in stats.modes(df, "v", ["g"]).collect()}
    for g in ("a", "b", None, "one"):
        count = Counter(of(g))
        assert modes[g] == min(count, key=lambda v: (-count[v], v))
    assert stats.quantiles(df.limit(0), "v", [0.5]).collect()[0]["q"] == [None]
    assert stats.describe(spark.createDataFrame([(None,)], "v double"), "v").first()["count"] == 0


@pytest.mark.parametrize("n,harmonics", [(8, 3), (9, 4), (9, 25), (1, 2), (12, 6)])
def test_fourier_from_its_definition(spark, n, harmonics):
    rng = random.Random(n)
    x = np.array([rng.random() for _ in range(n)])
    df = spark.createDataFrame([("s", i * 3, float(v)) for i, v in enumerate(x)], "s string, t int, v double")
    at = np.arange(n)
    slope = np.cov(at, x, bias=True)[0, 1] / np.var(at) if n > 1 else 0.0
    wave = np.fft.rfft(x - slope * at)
    wave[harmonics + 1 :] = 0
    got = [r["value"] for r in stats.fourier_extrapolation(df, "s", "t", "v", harmonics, 2).orderBy("t").collect()]
    assert got[:n] == pytest.approx(list(np.fft.irfft(wave, n) + slope * at) if n > 1 else [x[0]], abs=1e-9)
    assert len(got) == n + 2 and got[n] == pytest.approx(got[0] + slope * n, abs=1e-9)


def test_item_sets_of_a_huge_basket(spark):
    rng = random.Random(8)
    data = {(t, rng.choice("abcdef")) for t in range(40) for _ in range(4)} | {(99, x) for x in [*"abcdef", *map(str, range(150))]}
    baskets = {t: {x for u, x in data if u == t} for t in {t for t, _ in data}}
    least = max(1, int(len(baskets) * 0.1))
    want = {c: n for k in (2, 3, 4) for c in combinations("abcdef", k) if (n := sum(set(c) <= b for b in baskets.values())) >= least}
    got = {tuple(r["items"]): r["support"] for r in itemsets.frequent_itemsets(spark.createDataFrame(sorted(data), "txn bigint, item string"), 4, 2, 0.1).collect()}
    assert got == want and any(len(x) == 3 for x in want)


def test_item_sets_in_other_baskets(spark):
    made = lambda d: spark.createDataFrame([(t, x) for t, xs in d.items() for x in xs], "txn string, item string")
    enc = itemsets.ItemsetEncoder(3, 2, 0.7).fit(made({"1": "ab", "2": "abc", "3": "bc"}))
    assert rows(enc.mapping()) == [(0, "a|b"), (1, "b|c")]
    assert rows(enc.transform(made({"x": "abz", "y": "z", "w": "cba"}))) == [("w", 0, "a|b"), ("w", 1, "b|c"), ("x", 0, "a|b")]
    with pytest.raises(ValueError):
        itemsets.ItemsetEncoder().mapping()


def test_stationary_by_rounds(spark):
    seq = spark.createDataFrame([("h", i, x) for i, x in enumerate("abababcabcb", 1)] + [("g", i, x) for i, x in enumerate("cbabc", 1)], "host string, pos int, log string")
    counts = stage(markov.transition_counts(seq), "counts")
    near = {r["state"]: r["prob"] for r in markov.stationary_distribution(counts, max_states=1).collect()}
    assert near == pytest.approx({r["state"]: r["prob"] for r in markov.stationary_distribution(counts).collect()}, abs=1e-7)
    ring = spark.createDataFrame([("a", "b", 1), ("b", "a", 1)], "state string, next string, cnt bigint")
    assert {r["state"]: r["prob"] for r in markov.stationary_distribution(ring, 1).collect()} == pytest.approx({"a": 0.5, "b": 0.5})


def test_steps_multiply_to_the_probability(spark):
    seq = stage(spark.createDataFrame([(h, i, x) for h, xs in (("p", "abab"), ("q", "ba"), ("r", "a")) for i, x in enumerate(xs, 1)], "host string, pos int, log string"), "seq")
    probs = markov.probabilities(markov.transition_counts(seq.where("host <> 'q'")))
    whole = {r["host"]: r["prob"] for r in markov.sequence_probability(seq, probs).collect()}
    steps = markov.sequence_steps(seq, probs).collect()
    for h, n in (("p", 5), ("q", 3), ("r", 2)):
        mine = [r["prob"] for r in steps if r["host"] == h]
        assert len(mine) == n and math.prod(mine) == pytest.approx(whole[h])
    assert whole["q"] == 0
    starts = markov.start_shares(markov.extend(markov.start_counts(seq.where("host = 'p'")), markov.start_probabilities(seq.where("host = 'q'"))))
    assert rows(starts) == [(["a", "b"], 1, 0.5), (["b", "a"], 1, 0.5)]
    k2 = markov.probabilities(markov.order_counts(seq, 2))
    assert {r["host"] for r in markov.order_sequence_probability(seq, k2, None, 2).collect()} == {"p", "q"}


def test_drawing_by_steps_is_the_same(spark):
    counts = spark.createDataFrame([("<SOS>", "a", 3), ("<SOS>", "b", 1), ("a", "b", 2), ("a", "<EOS>", 1), ("b", "a", 1), ("b", "b", 4)], "state string, next string, cnt bigint")
    want = rows(markov.generate(counts, 9, 5, max_len=8))
    assert rows(markov.generate_by_steps(counts, 9, 5, 8)) == want and len(want) > 20
    assert markov.generate_next(counts, "a", 3) in ("b", "<EOS>") and markov.generate_next(counts, "zz") is None


def test_weights_and_addresses_by_shuffle(spark):
    counts = stage(spark.createDataFrame([(f"h{i}", x, i % 4 + 1) for i in range(60) for x in ("all", f"x{i % 7}")], "host string, log string, cnt bigint"), "counts")
    got = {(r["host"], r["log"]): r["value"] for r in features.weights(counts, 60).collect()}
    ihf = lambda n: math.log(61 / (1 + n)) + 1
    a, b = 2 * ihf(60), 2 * ihf(sum(i % 7 == 1 for i in range(60)))
    assert got["h1", "all"] == pytest.approx(a / math.hypot(a, b))
    ips = spark.createDataFrame([(i, "10.0.0.1" if i % 2 else f"10.1.0.{i % 200}" if i % 4 else None) for i in range(400)], "id bigint, ip string")
    nets = spark.createDataFrame([(1, "10.0.0.0/16", {"n": "zero"})], "prio int, cidr string, attrs map<string,string>")
    out = network.append_network_data(ips, "ip", nets, ["n"])
    assert out.count() == 400 and out.columns == ["id", "ip", "cidr", "n"] and {r["n"] for r in out.where("id % 2 = 1").collect()} == {"zero"} and out.where("id % 2 = 0 and n is not null").count() == 0


def test_ports():
    assert len(network.port_list()) == 23 and network.port_list("all")[-1] == 65535 and network.port_list([22, 80]) == [22, 80]
    for bad in ("some", [0], [65536], ["22"], [True], [2.0]):
        with pytest.raises(ValueError):
            network.port_list(bad)


def test_port_status(spark):
    scans = spark.createDataFrame([("a", 22, None), ("a", 22, "refused"), ("a", 80, None), (None, 22, "connected"), ("b", 99, "connected")], "ip string, port int, status string")
    got = {(r["ip"], r["port"]): r["status"] for r in network.port_status(scans, [22, 80]).collect()}
    assert got == {("a", 22): "refused", ("a", 80): None, ("b", 22): None, ("b", 80): None}


def test_samples_take_all_classes(spark):
    df = spark.createDataFrame([(i, "big" if i % 10 else "small") for i in range(500)] + [(1000, None)], "id bigint, y string")
    up = sampling.balanced_sample(df, "y", "id", "up", seed=1).groupBy("y").count()
    assert rows(up) == [("big", 450), ("small", 450)]
    assert rows(sampling.balanced_sample(df, "y", "id", fixed_size=0).groupBy("y").count()) == []
    assert sampling.balanced_sample(df.limit(0), "y", "id").count() == 0
