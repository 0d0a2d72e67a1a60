"""Hot terms, hosts, items and baskets, with the broadcast bound at 0 and no key too small to spread."""

import math
import random
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tarnmill import staging
from tarnmill.llm import cooccurrence, distinctive, logs, mixing, runs, subsequences, term_counts
from tarnmill.operators import skew
from tarnmill.staging import stage

LOGS = "row_id bigint, host_id string, pos int, log string, ts timestamp_ntz"


@pytest.fixture(autouse=True)
def everything_is_large(monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 0)
    monkeypatch.setattr(staging, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(logs, "BLOCK", 16)


def hosts_with_one_hot():
    """Half of all rows on one host, half of all terms the same one."""
    rng = random.Random(5)
    term = lambda: "a" if rng.random() < 0.5 else rng.choice("bcdefg")
    return [[term() for _ in range(rng.randint(1, 30))] for _ in range(20)] + [[term() for _ in range(300)]]


def clean(spark, hosts):
    rows = [(i * 1000 + j, f"h{i}", j, x, None) for i, xs in enumerate(hosts) for j, x in enumerate(xs)]
    return logs.staged_clean_rows(spark.createDataFrame(rows, LOGS))


def test_hot_host_and_term_are_spread(spark):
    hosts = hosts_with_one_hot()
    seq = clean(spark, hosts)
    by_host = seq.groupBy("host_id").agg(F.count("*").alias("n"))
    assert [r["host_id"] for r in logs.hot_salts(by_host, "host_id", "n").collect()] == ["h20"]
    totals, records = Counter(), defaultdict(set)
    for h, xs in enumerate(hosts):
        for n in (1, 2, 3):
            for i in range(len(xs) - n + 1):
                totals[tuple(xs[i : i + n])] += 1
                records[tuple(xs[i : i + n])].add(h)
    got = {tuple(r["gram"]): (r["total"], r["records"]) for r in term_counts.gram_counts(seq, 3).collect()}
    assert got == {g: (n, len(records[g])) for g, n in totals.items()}


def test_rows_without_place_count_as_terms(spark):
    rows = [(1, "h", 1, "a", None), (2, "h", 2, "b", None), (3, "h", None, "A #1", None), (4, "h", None, "a", None), (5, "i", None, "c", None), (6, None, None, "a", None), (7, "i", None, " [x", None), (8, "i", None, None, None)]
    df = spark.createDataFrame(rows, LOGS)
    got = {tuple(r["gram"]): (r["total"], r["records"]) for r in term_counts.gram_counts(logs.staged_clean_rows(df), 2, None, logs.loose_rows(df)).collect()}
    assert got == {("a",): (3, 1), ("b",): (1, 1), ("c",): (1, 1), ("a", "b"): (1, 1)}


def test_hot_first_step(spark):
    hosts = hosts_with_one_hot()
    support = defaultdict(set)
    for h, xs in enumerate(hosts):
        for i, a in enumerate(xs):
            for j in range(i + 1, min(i + 4, len(xs))):
                support[a, xs[j]].add(h)
                for k in range(j + 1, min(j + 4, len(xs))):
                    support[a, xs[j], xs[k]].add(h)
    least = max(3, math.ceil(0.4 * len(hosts)))
    want = {p: len(s) for p, s in support.items() if len(s) >= least and len(set(p)) == len(p)}
    got = subsequences.frequent_subsequences(clean(spark, hosts), 3, 3, 3, 0.4)
    assert {tuple(r["steps"]): r["hosts"] for r in got.collect()} == want
    assert any(p[0] == "a" for p in want)


def test_supports_of_wanted_patterns():
    d = subsequences.Diagram(2, 2)
    for host in range(9):
        d.add((1, 2, 3, 4) if host % 3 else (2, 1, 4, 4), host)
    assert dict((tuple(p), n) for p, n in d.supports(0, [[0, 1, 3], [0, 1], [0, 7]])) == {(0, 1): 9, (0, 1, 3): 6}


def test_hot_item_and_basket(spark):
    rng = random.Random(6)
    data = {(t, rng.choice("abcdefghij")) for t in range(60) for _ in range(4)} | {(t, "all") for t in range(60)} | {(99, f"x{i}") for i in range(200)}
    items = stage(spark.createDataFrame(sorted(data), "txn bigint, item string"), "baskets")
    of = defaultdict(set)
    for t, x in data:
        of[t].add(x)
    want = Counter(p for xs in of.values() for p in combinations(sorted(xs), 2))
    for least in (1, 5):
        got = {(r["item_a"], r["item_b"]): r["n_ab"] for r in cooccurrence.pair_counts(items, least, 16).collect()}
        assert got == {p: n for p, n in want.items() if n >= least}


def test_weights_by_shuffle(spark):
    hosts = hosts_with_one_hot()
    count, on = [Counter(xs) for xs in hosts], Counter(x for xs in hosts for x in set(xs))
    w = lambda h, x: (1 + math.log(count[h][x])) * (math.log((1 + len(hosts)) / (1 + on[x])) + 1)
    want = {(f"h{h}", x): w(h, x) / math.sqrt(sum(w(h, y) ** 2 for y in c)) for h, c in enumerate(count) for x in c}
    got = {(r["host_id"], r["log"]): r["weight"] for r in distinctive.term_weights(clean(spark, hosts)).collect()}
    assert got == pytest.approx(want)


def test_runs_have_a_duration(spark):
    rows = spark.sql("select id as row_id, 'h' as host_id, cast(id as int) as pos, if(id < 3, 'a', 'b') as log, if(id = 3, null, timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id * 1.5)) as ts from range(4)")
    got = {r["log"]: (r["n"], r["duration"]) for r in runs.runs(logs.staged_clean_rows(rows, True)).collect()}
    assert got == {"a": (3, 3.0), "b": (1, None)}


def test_overlapping_sources_share_documents(spark):
    """A source without enough of its own is filled from documents that others have too."""
    targets = [mixing.Target("a", mixing.Fraction(1, 2), 1), mixing.Target("b", mixing.Fraction(1, 2), 1)]
    docs = [(i, ["a", "b"] if i % 2 else ["a"], 10) for i in range(2000)]
    sized = stage(spark.createDataFrame(docs, "id bigint, sources array<string>, tokens bigint"), "sizes")
    chosen, report = mixing.mix(sized, targets)
    found = {r["source"]: r for r in mixing.with_reached(stage(chosen, "chosen"), report).collect()}
    assert [found[s]["shortfall"] for s in "ab"] == [0, 0] and all(abs(found[s]["reached"] - 0.5) < 0.01 for s in "ab")
    assert chosen.where("source = 'b'").join(sized, "id").where("not array_contains(sources, 'b')").count() == 0


def test_too_many_patterns_are_refused(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_PATTERNS", 1)
    sized = stage(spark.createDataFrame([(1, ["a"], 1), (2, ["a", "b"], 1)], "id bigint, sources array<string>, tokens bigint"), "sizes")
    with pytest.raises(ValueError):
        mixing.mix(sized, [mixing.Target(s, mixing.Fraction(1, 2), 1) for s in "ab"])
