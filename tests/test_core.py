"""Golden examples, brute force and edge cases of the core operators."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnmill.operators import cluster, features, hierarchy, indexing, itemsets, markov, nested, network, sampling, schema, sequences, stats, timeseries, trees
from tarnmill.sources import tree_json

COUNTS = [(0, i, "4107") for i in range(1, 7)] + [(1, i, "7610") for i in range(1, 5)] + [(2, 1, "4107"), (2, 2, "4107"), (3, 1, "7610")]


def seq_df(spark, hosts):
    return spark.createDataFrame([(h, i, x) for h, xs in enumerate(hosts) for i, x in enumerate(xs, 1)], "host int, pos int, log string")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# --- features ---------------------------------------------------------------------------------


def test_counts_golden(spark):
    seq = spark.createDataFrame(COUNTS, "host int, pos int, log string")
    assert rows(features.count_logs(seq)) == [(0, "4107", 6), (1, "7610", 4), (2, "4107", 2), (3, "7610", 1)]
    v = features.LogVectorizer(weighted=True)
    assert {round(r["value"], 9) for r in v.fit_transform(seq).collect()} == {1.0}
    assert rows(v.logs_.select("log", "idx")) == [("4107", 0), ("7610", 1)]


def test_short_host_keeps_constant(spark):
    seq = seq_df(spark, [["a"], ["a", "b", "c"]])
    assert rows(features.count_logs(seq, 2)) == [(0, "const", 1), (1, "a|b", 1), (1, "b|c", 1), (1, "const", 1)]
    v = features.LogVectorizer(features.CountSpec(ngram=2))
    once, again = rows(v.fit_transform(seq)), rows(v.transform(seq))
    assert once == again


def test_bounds(spark):
    with pytest.raises(ValueError):
        features.CountSpec(max_hf=0.1, min_hf=0.5).bounds(10)
    with pytest.raises(ValueError):
        features.CountSpec(logs=("a", "a"))
    with pytest.raises(ValueError):
        features.LogVectorizer(features.CountSpec(min_hf=5)).fit(seq_df(spark, [["a"]]))
    fixed = features.LogVectorizer(features.CountSpec(logs=("b", "z"))).fit(seq_df(spark, [["a", "b"]]))
    assert rows(fixed.logs_.select("log", "idx")) == [("b", 0), ("z", 1)]


def test_norms(spark):
    seq = seq_df(spark, [list("abcab"), list("bcc"), list("aaaa")])
    counts = features.count_logs(seq)
    w = features.weights(counts, 3)
    for r in w.groupBy("host").agg(F.sum(F.col("value") ** 2).alias("s")).collect():
        assert r["s"] == pytest.approx(1)


def test_itemsets_golden(spark):
    b = spark.createDataFrame([(0, "4107"), (0, "7610"), (1, "7610"), (1, "4107"), (2, "4107"), (3, "7610"), (None, "x"), (4, None)], "txn int, item string")
    sets = itemsets.frequent_itemsets(b)
    assert rows(sets) == [(["4107", "7610"], 2, 2)]
    assert rows(itemsets.encode_itemsets(b, sets)) == [(0, "4107|7610"), (1, "4107|7610")]
    assert itemsets.frequent_itemsets(b, threshold=0.9).count() == 0


def test_itemsets_brute(spark):
    rng = random.Random(3)
    data = [{rng.choice("abcdefg") for _ in range(rng.randint(1, 6))} for _ in range(60)]
    from itertools import combinations

    want = sorted((list(c), k, n) for k in (2, 3, 4, 5) for c in combinations("abcdefg", k) if (n := sum(set(c) <= t for t in data)) >= 6)
    b = spark.createDataFrame([(i, x) for i, t in enumerate(data) for x in t], "txn int, item string")
    assert rows(itemsets.frequent_itemsets(b, 5, 2, 0.1)) == want


def test_encoder(spark):
    seq = seq_df(spark, [["b", "a"], ["c"]])
    e = features.SequenceEncoder(include_constant=True).fit(seq)
    assert rows(e.transform(seq).select("host", "codes")) == [(0, [1, 0]), (1, [0, 2])]
    assert rows(e.one_hot(seq)) == [(0, [[0, 1, 0, 1], [1, 0, 0, 1]]), (1, [[0, 0, 0, 1], [0, 0, 1, 1]])]
    with pytest.raises(ValueError):
        features.SequenceEncoder(embedding_len=2).fit(seq)
    with pytest.raises(Exception):
        e.transform(seq_df(spark, [["zz"]])).collect()


# --- sequences --------------------------------------------------------------------------------


def test_windows_golden(spark):
    def win(a, n, fill=None, step=1):
        df = spark.createDataFrame([(a,)], "a array<string>")
        return df.select(sequences.sliding_windows(F.col("a"), n, F.lit(fill).cast("string"), step).alias("w")).first()["w"]

    assert win(list("12345"), 3) == [list("123"), list("234"), list("345")]
    assert win(list("123"), 4) == [["1", "2", "3", None]]
    assert win(list("123456"), 3, "!", 2) == [list("123"), list("345"), ["5", "6", "!"]]
    assert win([None, None, "1", "2", "3", "4"], 3) == [[None, None, "1"], [None, "1", "2"], list("123"), list("234")]
    assert win([], 2) == [[None, None]]


def test_windows_brute(spark):
    def brute(n, size, step):
        a = [str(i) for i in range(size)]
        out, i = [], 0
        if size <= n:
            return [a + ["!"] * (n - size)]
        while i + n <= size:
            out.append(a[i : i + n])
            i += step
        r = (size - n) % step
        if r and step - r < n:
            out.append((a[i:] + ["!"] * n)[:n])
        return out

    for n in (1, 2, 3, 5):
        for step in (1, 2, 3, 4):
            df = spark.createDataFrame([([str(i) for i in range(s)],) for s in range(8)], "a array<string>")
            got = {len(r["a"]): r["w"] for r in df.select("a", sequences.sliding_windows(F.col("a"), n, F.lit("!"), step).alias("w")).collect()}
            for s in range(8):
                assert got[s] == brute(n, s, step), (n, s, step)


def test_following_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(sequences, "BLOCK", 3)
    seq = seq_df(spark, [list("abcdefghij"), list("xy")])
    got = {(r["host"], r["pos"]): [r[f"next{j}"] and r[f"next{j}"]["log"] for j in (1, 2, 3)] for r in sequences.following(seq, 3, ["log"]).collect()}
    for h, xs in enumerate(["abcdefghij", "xy"]):
        for i in range(len(xs)):
            assert got[h, i + 1] == [xs[i + j] if i + j < len(xs) else None for j in (1, 2, 3)]
    assert len(got) == 12


def test_to_sequences_days_and_nulls(spark):
    df = spark.sql(
        "select * from values (1, timestamp_ntz'2024-01-02 00:00:00', 2, 'c'), (1, timestamp_ntz'2024-01-01 10:00:00', 1, 'b'), (1, null, 9, 'a'), (null, timestamp_ntz'2024-01-01 10:00:00', 3, 'x'), (1, timestamp_ntz'2024-01-02 00:00:00', 3, 'd') t(h, ts, id, log)"
    )
    got = sequences.to_sequences(df, "h", "ts", "id", "log")
    assert [r["log"] for r in got.orderBy("pos").collect()] == ["a", "b", "c", "d"]
    assert [r["pos"] for r in got.orderBy("pos").collect()] == [1, 2, 3, 4]


def test_batches_and_numbers(spark):
    df = spark.createDataFrame([(["1", "2", "3"],), ([],)], "a array<string>")
    assert rows(df.select(sequences.batches(F.col("a"), 2))) == [([],), ([["1", "2"], ["3"]],)]
    n = indexing.number_rows(spark.range(1000).withColumn("v", F.col("id") % 7), "v", "id")
    assert [r["idx"] for r in n.orderBy("v", "id").collect()] == list(range(1000))
    assert indexing.number_rows(spark.range(0), "id").count() == 0


# --- markov -----------------------------------------------------------------------------------

MARKOV = [["4107", "4107", "4107", "7610"], ["7610"] * 4, ["4107", "7610"], ["7610"]]


def test_markov_golden(spark):
    c = markov.transition_counts(seq_df(spark, MARKOV))
    assert rows(c) == sorted([("4107", "4107", 2), ("4107", "7610", 2), ("7610", "7610", 3), ("7610", "<EOS>", 4), ("<SOS>", "4107", 2), ("<SOS>", "7610", 2)])
    for r in markov.probabilities(c).groupBy("state").agg(F.sum("prob").alias("s")).collect():
        assert r["s"] == pytest.approx(1)
    a, b = seq_df(spark, MARKOV[:2]), seq_df(spark, MARKOV[2:])
    assert rows(markov.extend(markov.transition_counts(a), markov.transition_counts(b))) == rows(c)
    p = markov.sequence_probability(seq_df(spark, [["4107", "7610"], ["7610", "4107"]]), markov.probabilities(c))
    assert {r["host"]: round(r["prob"], 9) for r in p.collect()} == {0: round(0.5 * 0.5 * 4 / 7, 9), 1: 0.0}
    g = markov.generate(c, 3, seed=1)
    assert rows(g) == rows(markov.generate(c, 3, seed=1)) and g.count() > 0
    s = markov.stationary_distribution(c)
    assert s.agg(F.sum("prob")).first()[0] == pytest.approx(1)


def test_generate(spark):
    seq = seq_df(spark, MARKOV)
    c = markov.transition_counts(seq)
    assert markov.generate_next(c, "7610", 3) in ("7610", markov.EOS) and markov.generate_next(c, "none") is None
    o, s = markov.order_counts(seq, 2), markov.start_probabilities(seq, 2)
    assert markov.generate_next(o, ["4107", "4107"], 1) in ("4107", "7610")
    g = rows(markov.generate_order(o, s, 4, seed=2))
    assert g == rows(markov.generate_order(o, s, 4, seed=2)) and {h for h, _, _ in g} == {0, 1, 2, 3}
    assert rows(markov.generate_order(o, s, 1, start=["x", "y"])) == [(0, 1, "x"), (0, 2, "y")]


def test_order_two_golden(spark):
    seq = seq_df(spark, [["4107", "4107", "4107", "7610"], ["7610"] * 4, ["4107", "4107", "7610"], ["1"]])
    p = markov.probabilities(markov.order_counts(seq, 2))
    assert {r["next"]: round(r["prob"], 6) for r in markov.subsequent_probability(p, ["4107", "4107"]).collect()} == {"7610": 0.666667, "4107": 0.333333}
    with pytest.raises(ValueError):
        markov.order_counts(seq, 6)


# --- trees and hierarchies --------------------------------------------------------------------


def brute_roots(parent):
    out = {}
    for n in parent:
        seen, x, path = set(), n, [n]
        while parent[x] is not None and parent[x] in parent:
            if x in seen:
                break
            seen.add(x)
            x = parent[x]
            path.append(x)
        else:
            out[n] = (x, len(path) - 1, path[::-1])
            continue
        out[n] = ("", -1, None)
    return out


def test_hierarchy_brute(spark):
    rng = random.Random(5)
    parent = {str(i): (str(rng.randint(0, 400)) if rng.random() < 0.97 else None) for i in range(300)}
    for i in range(400, 520):
        parent[str(i)] = str(i - 1)  # a deep chain
    parent["399"] = None
    parent["self"] = "self"
    df = spark.createDataFrame([(n, p, None if n == "3" else f"n{n}") for n, p in parent.items()], "guid string, parent_guid string, proc_name string")
    a = hierarchy.ancestors(df)
    got = {r["node"]: (r["root"], r["depth"], r["ids"]) for r in a.collect()}
    want = brute_roots(parent)
    assert got == want
    below = dict.fromkeys(parent, 0)
    for _, d, ids in want.values():
        for x in (ids or [])[:-1]:
            below[x] += 1
    assert {r["node"]: r["descendants"] for r in hierarchy.hierarchy(a).collect()} == below
    assert hierarchy.descendants(a).count() == sum(below.values())
    assert hierarchy.ancestors(df.limit(0)).count() == 0


def test_clean_processes(spark):
    df = spark.createDataFrame(
        [(2, "{A}", "x", "late"), (1, "a", None, "first"), (3, None, "a", "none"), (None, "B", "{A}", None)], "rec_id int, guid string, parent_guid string, proc_name string"
    ).withColumn("node", F.lit("clash"))
    assert rows(hierarchy.clean_processes(df).where("guid = 'a'")) == [("a", None, "first")]
    got = {r["node"]: r["depth"] for r in hierarchy.ancestors(hierarchy.clean_processes(df, "node")).collect()}
    assert got == {"a": 0, "b": 1}


def tree_df(spark, spec):
    return spark.createDataFrame([(t, n, p, name) for t, n, p, name in spec], "tree_id string, node_id string, parent_id string, name string")


def test_trees(spark):
    nodes = tree_df(
        spark,
        [("1", "a", None, "r"), ("1", "b", "a", "x"), ("1", "c", "b", "r"), ("1", "d", "c", "y")]
        + [("2", "q", None, "r"), ("2", "w", "q", "x"), ("2", "e", "w", "r"), ("2", "z", "e", "y")]
        + [("3", "a", None, "r"), ("3", "b", "a", "y")],
    )
    p = trees.paths(nodes)
    sig = trees.signatures(nodes, p)
    assert rows(trees.matches(sig.where("tree_id = '1'"), sig)) == [("1", "1"), ("1", "2")]
    cut = {r["node_id"]: r["branch"] for r in trees.branch_to_trunk(p.where("tree_id = '1'"), True).collect()}
    assert cut["d"] == ["y", "r"] and cut["b"] == ["x", "r"] and cut["a"] == ["r"] and cut["c"] == ["r", "x", "r"]
    assert trees.render(p, "1").splitlines()[1] == "└── x" and trees.to_nested(p, "3") == ["r", [["y", []]]]
    assert all(r["valid"] for r in trees.validate(nodes, p).collect())
    bad = tree_df(spark, [("1", "a", "b", "r"), ("1", "b", "a", "x"), ("2", "a", None, "r"), ("2", "a", None, "r"), ("3", "k", "gone", "r")])
    assert [r["valid"] for r in trees.validate(bad, trees.paths(bad.distinct())).orderBy("tree_id").collect()] == [False] * 3
    assert rows(trees.has_subtree(nodes, p.where("tree_id = '3'"))) == [("1", "c"), ("2", "e"), ("3", "a")]
    assert trees.paths(nodes.limit(0)).count() == 0


def test_master_refuses_equal_trees_of_a_host(spark):
    df = spark.createDataFrame([("h", "t1", "s"), ("h", "t2", "s")], "host_id string, tree_id string, signature string")
    with pytest.raises(Exception):
        trees.build_master(df, "m").collect()


def test_tree_stamps(spark):
    df = spark.createDataFrame([("None",), ("NaT",), ("2024-01-18T23:37:14.872057",), ("2024-01-24 19:44:32",), (None,), ("x",)], "t string")
    got = [str(r[0]) for r in df.select(tree_json.parse_stamp(F.col("t"))).collect()]
    assert got == ["None", "None", "2024-01-18 23:37:14.872057", "2024-01-24 19:44:32", "None", "None"]


# --- nested records ---------------------------------------------------------------------------


def test_parse_json_against_library():
    good = ['{"a":[1,2,{"b":null}],"a":3}', '"x\\u00e9"', "[]", " {} ", "-1.5e3", "[[],[{}]]", '{"k":"v\\n"}']
    for t in good:
        v = nested.parse_json(t)
        assert json.loads(t) == (json.loads(v) if isinstance(v, nested.Number) else v) or t.startswith(("{", "[")), t
    assert nested.parse_json('{"a":[1,2,{"b":null}],"a":3}') == {"a": "3"}
    for t in good:
        assert nested._parse_deep(t) == nested.parse_json(t)
    for t in ["", "{", "{'a':1}", "[1,]", "NaN", "n/a", '{"a" 1}', "[1] 2", '"', "01", "{,}", '{"a":}', "[1 2]"]:
        for parse in (nested.parse_json, nested._parse_deep):
            with pytest.raises(ValueError):
                parse(t)
    deep = "[" * 50_000 + "]" * 50_000
    assert len(nested.merkle_rows(nested.parse_json("[" * 3000 + "]" * 3000), None)) == 3000
    assert nested.parse_json(deep) is not None


def brute_nodes(body):
    v = nested.parse_body(body)
    out = set()
    trees_ = v.get("process_trees") if isinstance(v, dict) else None
    items = list(trees_.items()) if isinstance(trees_, dict) else [(None, t) for t in trees_ or []] if isinstance(trees_, list) else []

    def walk(x, tree, owner):
        if isinstance(x, dict):
            me = owner
            if x.get("node_id") is not None:
                up = x.get("parent")
                out.add((tree, str(x["node_id"]), str(up) if up is not None else owner or ""))
                me = str(x["node_id"])
            for y in x.values():
                walk(y, tree, me)
        elif isinstance(x, list):
            for y in x:
                walk(y, tree, owner)

    for k, t in items:
        if isinstance(t, (dict, list)):
            walk(t, str(t.get("tree_id")) if isinstance(t, dict) and t.get("tree_id") is not None else k or "", None)
    return out


def test_process_nodes_brute(spark):
    reports = spark.read.parquet("/root/testdata/sf0.01/raw_reports.parquet")
    got = {tuple(r) for r in nested.process_nodes(reports).select("report_id", "tree_id", "node_id", "parent_id").collect()}
    want = {(r["report_id"], *x) for r in reports.collect() for x in brute_nodes(r["body"])}
    assert got == want and len(want) > 1000


def test_flatten_json(spark):
    bodies = [(1, '{"a":{"b":[1,{"z":null,"c":"é"}],"e":{}},"n":null,"t":true,"s":"x"}'), (2, "[1]"), (3, None), (4, "{"), (5, '"{\\"q\\":1.50}"')]
    got = rows(nested.flatten_json(spark.createDataFrame(bodies, "path int, value string").withColumnsRenamed({"path": "id", "value": "text"}), "id", "text"))
    assert sorted(map(str, got)) == sorted(map(str, [(1, "a->b", '[1,{"c":"é","z":null}]'), (1, "n", None), (1, "s", "x"), (1, "t", "true"), (5, "q", "1.50")]))


def test_merkle_identity(spark):
    bodies = [(1, '{"x":{"b":1,"a":[1,{"q":null}]},"y":{"a":[1,{"q":null}],"b":1}}'), (2, '"{\\"z\\":{}}"'), (3, "bad"), (4, None), (5, ""), (6, "[]"), (7, '{"é/~":{"t":"\\ud800"}}'), (8, '{"\\udc00":[]}')]
    df = spark.createDataFrame(bodies, "hash int, content string")
    objects, bridge = nested.merkle_tables(df.withColumnsRenamed({"hash": "id", "content": "text"}), "id", "text")
    assert {r["uses"] for r in objects.where("content like '%\"b\":1%'").collect()} == {2}
    b = bridge.collect()
    assert {r["id"] for r in b} == {1, 2, 6, 7, 8}
    assert sorted(r["pointer"] for r in b if r["id"] == 1) == ["", "/x", "/x/a", "/x/a/1", "/y", "/y/a", "/y/a/1"]
    assert [r["pointer"] for r in b if r["id"] == 7 and r["occ"] == 1] == ["/é~1~0"]
    # Put together again.
    content = {r["hash"]: json.loads(r["content"]) for r in objects.collect()}

    def build(h):
        def un(v):
            return build(v["#"]) if isinstance(v, dict) and set(v) == {"#"} else v

        c = content[h]
        return {k: un(v) for k, v in c.items()} if isinstance(c, dict) else [un(v) for v in c]

    root = next(r["hash"] for r in b if r["id"] == 1 and r["occ"] == 0)
    assert build(root) == json.loads(bodies[0][1])
    assert nested.process_nodes(df.withColumnsRenamed({"hash": "id", "content": "text"}).limit(0), "id", "text").count() == 0


# --- schema -----------------------------------------------------------------------------------


def test_flatten_merges_all_collisions(spark):
    df = spark.sql("select named_struct('b', cast(null as string)) as a, cast(null as string) as A_b, 'z' as a_B, map('k', 1) as m")
    assert rows(schema.flatten_df(df)) == [("z",)]
    assert schema.flatten_df(df, "all").columns == ["a_b", "m"]
    assert schema.flatten_df(df, "all", keep_merged=True).columns == ["a_b", "a_b_x", "a_b_x2", "m"]


def test_drop_all_null(spark):
    df = spark.sql("select cast(null as string) as a, double('nan') as b, 1 as c union all select null, null, null")
    assert schema.drop_all_null(df).columns == ["c"]
    assert schema.drop_all_null(df.limit(0)).columns == ["a", "b", "c"]
    assert schema.flat_paths(["a", ["b", ["cc"]]]) == ["a", "b", "cc"]


# --- statistics -------------------------------------------------------------------------------


def test_linreg_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 2))
    y = 3 + x @ [1.5, -2] + rng.normal(size=200) * 0.1
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, y double")
    theta, cost = stats.linreg(df, ["a", "b"], "y")
    X = np.c_[np.ones(200), x]
    assert np.allclose(theta, np.linalg.lstsq(X, y, rcond=None)[0])
    assert cost == pytest.approx(((X @ theta - y) ** 2).mean() / 2)
    ridge, _ = stats.linreg(df, ["a", "b"], "y", ridge=10)
    assert np.allclose(ridge, np.linalg.solve(X.T @ X + np.diag([0, 10, 10]), X.T @ y))


def test_fourier_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=21).cumsum()
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(x)], "s string, t int, v double")
    full = [r["value"] for r in stats.fourier_extrapolation(df, "s", "t", "v", 25, 4).orderBy("t").collect()]
    assert np.allclose(full[:21], x) and len(full) == 25


def test_association_ranges(spark):
    df = spark.createDataFrame([(i % 3, (i * i) % 4) for i in range(50)], "x int, y int")
    for v in (stats.theil_u(df, "x", "y").first()[0], stats.cramer_v(df, "x", "y").first()[0]):
        assert -1e-9 <= v <= 1 + 1e-9
    assert stats.theil_u(df.withColumn("x", F.lit(1)), "x", "y").first()[0] == 1.0
    assert np.isnan(stats.cramer_v(df.withColumn("x", F.lit(1)), "x", "y").first()[0])
    assert stats.corr_ratio(df.withColumn("v", F.lit(2.0)), "x", "v").first()[0] == 0.0
    with pytest.raises(ValueError):
        stats.describe(df.withColumn("x", F.lit("a")), "x")


def test_yates_with_empty_cell(spark):
    df = spark.createDataFrame([("a", "p")] * 6 + [("b", "p")] * 3 + [("b", "q")] * 5, "x string, y string")
    n = np.array([[6, 0], [3, 5]], float)
    e = n.sum(1, keepdims=True) * n.sum(0) / n.sum()
    want = ((np.abs(n - e) - np.minimum(0.5, np.abs(n - e))) ** 2 / e).sum()
    assert stats.chi_square(df, "x", "y").first()["chi2"] == pytest.approx(want)
    assert stats.chi_square(df, "x", "y", False).first()["chi2"] == pytest.approx(((n - e) ** 2 / e).sum())


# --- others -----------------------------------------------------------------------------------


def test_rolling_over_blocks(spark):
    rng = np.random.default_rng(4)
    data = [(k, i, float(v)) for k in ("a", "b", "c") for i, v in enumerate(rng.normal(size=20 if k != "c" else 2))]
    df = spark.createDataFrame(data, "k string, i int, v double")
    want = {(k, i): np.mean([v for kk, j, v in data if kk == k and i - 2 <= j <= i]) if i >= 2 else None for k, i, _ in data}
    got = {(r["k"], r["i"]): r["rolling_mean"] for r in stats.rolling(df, ["k"], ["i"], "v", 3, block=4).collect()}
    assert got.keys() == want.keys() and all((got[x] is None) == (want[x] is None) and (want[x] is None or abs(got[x] - want[x]) < 1e-9) for x in want)


def test_weeks_with_gap(spark):
    df = spark.sql("select * from values (timestamp_ntz'2024-01-03 05:00:00', 1), (timestamp_ntz'2024-01-08 00:00:00', 2), (timestamp_ntz'2024-01-10 05:00:00', 3) t(ts, v)")
    got = {r["label"]: (r["week_0"], r["week_1"]) for r in timeseries.split_weeks(df, "ts", "v").collect()}
    assert got == {"wednesday-05:00": (1, 3), "monday-00:00": (None, 2)}
    over = timeseries.split_overlapping_weeks(df, "ts", "v", 0)
    assert over.count() == 2
    labels = [r[0] for r in spark.range(1440, 1442).select(timeseries.slot_label(F.col("id"), "minutes")).collect()]
    assert labels == ["tuesday-00:00", "tuesday-00:01"]
    with pytest.raises(ValueError):
        timeseries.week_slots(df, "ts", "v", "years")
    with pytest.raises(ValueError):
        timeseries.extend_dates(df.limit(1), "ts", 3)


def test_lookup_provider(spark):
    nets = spark.createDataFrame([(1, "10.0.0.0/8", {"name": "ten"})], "prio int, cidr string, attrs map<string,string>")
    ips = spark.createDataFrame([("10.1.1.1",), ("20.1.1.1",), ("bad",), (None,)], "ip string")

    def provider(batch):
        assert "10.1.1.1" not in batch
        for ip in batch:
            yield ip.rsplit(".", 1)[0] + ".0/24", {"name": "asked"}

    known = network.lookup_subnets(ips, "ip", provider, nets)
    got = {r["ip"]: r["name"] for r in network.append_network_data(ips, "ip", known, ["name"]).collect()}
    assert got == {"10.1.1.1": "ten", "20.1.1.1": "asked", "bad": None, None: None}
    with pytest.raises(Exception):
        ips.select(network.check_ip(F.col("ip"), True)).collect()
    with pytest.raises(ValueError):
        network.append_network_data(ips, "ip", nets, "name")


def test_balanced_sample(spark):
    df = spark.range(400).withColumn("y", F.when(F.col("id") < 300, "class_1").otherwise("class_2"))
    size = lambda **k: {r["y"]: r["count"] for r in sampling.balanced_sample(df, "y", "id", **k).groupBy("y").count().collect()}
    assert size() == {"class_1": 200, "class_2": 200}
    assert size(how="down", replace=False) == {"class_1": 100, "class_2": 100}
    assert size(how="up", seed=4) == {"class_1": 300, "class_2": 300}
    assert rows(sampling.balanced_sample(df, "y", "id", seed=9)) == rows(sampling.balanced_sample(df, "y", "id", seed=9))
    with pytest.raises(ValueError):
        size(fixed_size=150, replace=False)
    with pytest.raises(ValueError):
        size(how="odd", fixed_size=3)


def test_k_medians_brute(spark):
    rng = np.random.default_rng(0)
    x = np.r_[rng.normal(0, 1, (30, 2)), rng.normal(8, 1, (30, 2))]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id int, v array<double>")
    got, centres = cluster.k_medians(df, "id", "v", centroids=[[0.0, 0.0], [5.0, 5.0]])
    c = {r["key"]: r["cluster"] for r in got.collect()}
    assert all(c[i] == (i >= 30) for i in range(60))
    assert np.allclose(centres, [np.median(x[:30], 0), np.median(x[30:], 0)])
    modes, mc = cluster.k_modes(df.withColumn("v", F.transform("v", lambda e: F.round(e / 8) + 1)), "id", "v", centroids=[[1.0, 2.0], [2.0, 1.0]])
    assert modes.count() == 60 and len(mc) == 2
    with pytest.raises(ValueError):
        cluster._update(spark.createDataFrame([(0, [1.0]), (1, [1.0])], "cluster int, vec array<double>"), [[0.0], [2.0]], "median")
    assert len(cluster.init_centroids(df, "id", "v", 3)) == 3


def test_stream_equals_batch(spark, tmp_path):
    from tarnmill.sources.tables import table
    from tarnmill.streaming import transitions

    ev = table(spark, "/root/testdata/sf0.001", "events").select("user_id", "ts", "event_id", "event_type")
    folder = str(tmp_path / "in")
    for lo, hi in (("2024-01-01", "2024-01-12"), ("2024-01-12", "2024-02-01")):
        ev.where(f"ts >= '{lo}' and ts < '{hi}'").coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(ev.schema).parquet(folder)
        q = transitions.stream_counts(transitions.transition_pairs(stream, "user_id", "ts", "event_id", "event_type"), str(tmp_path / "out"), str(tmp_path / "ck"))
        q.awaitTermination()
    want = markov.transition_counts(sequences.to_sequences(ev, "user_id", "ts", "event_id", "event_type")).where("next <> '<EOS>'")
    assert rows(transitions.read_counts(spark, str(tmp_path / "out")).select("state", "next", "cnt")) == rows(want)
