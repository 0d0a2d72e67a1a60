"""The llm operators against SQL, brute force, reference tokenizers and edge cases."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import FOLDER
from pyspark.sql import functions as F

from compare import difference, rows_of
from tarnmill.llm import cooccurrence, distinctive, logs, mixing, queries, reading, runs, subsequences, term_counts, tokenizer
from tarnmill.staging import stage

QUERIES, SQL = queries.queries(), queries.oracle_sql()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    got = rows_of(df)
    assert got or name in ("p3_found", "p4_found", "p9_found")
    if name in SQL:
        assert difference(got, df.columns, con, SQL[name]) == ""


# --- logs: cleaning and neighbours --------------------------------------------------------------

LOGS = "row_id bigint, host_id string, pos int, log string, ts timestamp_ntz"


def raw(spark, hosts, gap=1):
    rows = [(i * 1000 + j, f"h{i}", j * gap, x, None) for i, xs in enumerate(hosts) for j, x in enumerate(xs)]
    return spark.createDataFrame(rows, LOGS)


def test_cleaning(spark):
    rows = [
        (5, "h", 1, "B", None), (4, "h", 1, "A #7", None), (4, "h", 1, "A #7", None), (None, "h", 2, "null id[3]", None), (1, "h", 2, "later", None),
        (6, None, 1, "x", None), (7, "h", None, "x", None), (8, "h", 3, None, None), (9, "h", 4, " #only", None), (10, "h", 5, "", None),
        (11, "h", 6, "q", None), (10, "h", 6, None, None), (12, "h", -3, "neg", None),
    ]
    df = spark.createDataFrame(rows, LOGS).withColumn("block", F.lit("clash")).withColumn("r", F.lit(1))
    got = sorted((r["pos"], r["log"]) for r in logs.clean_log_rows(df).collect())
    assert got == [(-3, "neg"), (1, "a"), (2, "null id")]
    assert logs.clean_log_rows(df.limit(0)).count() == 0


def following(xs, i, k):
    return xs[i + 1 : i + 1 + k]


@pytest.mark.parametrize("gap", [1, 3, 7])
def test_following_over_blocks(spark, monkeypatch, gap):
    monkeypatch.setattr(logs, "BLOCK", 5)
    hosts = [[f"a{j}" for j in range(23)], ["x"], ["y", "z"]]
    seq = logs.staged_clean_rows(raw(spark, hosts, gap))
    assert seq.select("block").distinct().count() > 1
    for k in (1, 3):
        got = {(r["host_id"], r["pos"]): [n["log"] for n in r["nexts"]] for r in logs.with_following(seq, k, ["log"]).collect()}
        want = {(f"h{i}", j * gap): following(xs, j, k) for i, xs in enumerate(hosts) for j in range(len(xs))}
        assert got == want


def many_hosts(seed, hosts=25, terms="abcdefgh", longest=60):
    rng = random.Random(seed)
    return [[rng.choice(terms) for _ in range(rng.randint(0, longest))] for _ in range(hosts)] + [["a"] * 70]


# --- 1: counts ----------------------------------------------------------------------------------


def test_stack():
    rng = random.Random(1)
    data = [(tuple(rng.choice("abc") for _ in range(rng.randint(1, 3))), rng.randint(0, 4), rng.randint(1, 3)) for _ in range(200)]
    order = sorted(data, key=lambda x: [ord(c) for c in x[0]] + [0] * (3 - len(x[0])), reverse=True)
    total, hosts = Counter(), defaultdict(set)
    for s, h, n in data:
        for k in range(1, len(s) + 1):
            total[s[:k]] += n
            hosts[s[:k]].add(h)
    got = list(term_counts.prefixes_by_stack(iter(order), 3))
    assert sorted(got) == sorted((g, total[g], len(hosts[g])) for g in total)
    assert list(term_counts.prefixes_by_stack(iter([]), 3)) == []


@pytest.mark.parametrize("max_n", [1, 3])
def test_gram_counts(spark, monkeypatch, max_n):
    monkeypatch.setattr(logs, "BLOCK", 16)
    hosts = many_hosts(2)
    total, where = Counter(), defaultdict(set)
    for h, xs in enumerate(hosts):
        for n in range(1, max_n + 1):
            for i in range(len(xs) - n + 1):
                total[tuple(xs[i : i + n])] += 1
                where[tuple(xs[i : i + n])].add(h)
    got = {tuple(r["gram"]): (r["n"], r["total"], r["records"]) for r in term_counts.gram_counts(logs.staged_clean_rows(raw(spark, hosts)), max_n).collect()}
    assert got == {g: (len(g), total[g], len(where[g])) for g in total}


def clashing(seq):
    for c in ("code", "nexts", "halo", "n", "salt", "salts", "after", "t0", "total", "to"):
        seq = seq.withColumn(c, F.lit("clash"))
    return seq


def test_clashing_columns(spark):
    seq = logs.staged_clean_rows(raw(spark, [list("abcabc"), list("aab")]), with_ts=True)
    more = clashing(seq)
    assert rows_of(term_counts.gram_counts(more, 2)) == rows_of(term_counts.gram_counts(seq, 2))
    assert rows_of(subsequences.frequent_subsequences(more, 3, 2, 1, 0.1)) == rows_of(subsequences.frequent_subsequences(seq, 3, 2, 1, 0.1))
    assert rows_of(runs.runs(more)) == rows_of(runs.runs(seq))
    assert rows_of(distinctive.term_weights(more)) == rows_of(distinctive.term_weights(seq))
    nulls = spark.createDataFrame([("h", None), (None, "x"), ("h", "x")], "host_id string, log string")
    assert distinctive.term_weights(nulls).count() == 1
    items = spark.createDataFrame([(1, "a", 0), (1, "b", 0), (2, None, 0)], "txn int, item string, chunks int")
    assert cooccurrence.pair_counts(items).count() == 1


def test_long_logs(spark):
    long = "x" * 200_000
    seq = logs.staged_clean_rows(raw(spark, [[long, long, "b"], [long]]))
    got = {r["gram"][0][:1]: (r["total"], r["records"]) for r in term_counts.gram_counts(seq, 2).where("n = 1").collect()}
    assert got == {"x": (3, 2), "b": (1, 1)}


def test_counts_of_nothing(spark):
    seq = logs.staged_clean_rows(raw(spark, []))
    counts = term_counts.gram_counts(seq, 2)
    assert counts.count() == 0 and term_counts.mark_unused(counts, 0).count() == 0


def test_hot_terms_have_a_bound(spark):
    counts = spark.createDataFrame([("hot", 1000)] + [(f"t{i}", 1) for i in range(500)], "log string, total bigint")
    hot = logs.hot_salts(counts, "log", "total").collect()
    assert [(r["log"], r["salts"] > 1) for r in hot] == [("hot", True)]


# --- 2: pairs -----------------------------------------------------------------------------------


@pytest.mark.parametrize("chunk", [3, 10, 256])
def test_pairs(spark, chunk):
    rng = random.Random(chunk)
    data = [(t, rng.choice([" A", "b", "C ", "d", "e", "f", "g", "h", "i"])) for t in range(40) for _ in range(rng.randint(1, 12))]
    data += [(99, f"i{j}") for j in range(40)] * 2 + [(98, f"i{j}") for j in range(0, 40, 2)] + [(None, "a"), (1, None), (1, " ")]
    sets = defaultdict(set)
    for t, x in data:
        if t is not None and x and x.strip():
            sets[t].add(x.strip().lower())
    single, both = Counter(), Counter()
    for s in sets.values():
        single.update(s)
        both.update((a, b) for a in s for b in s if a < b)
    items = stage(cooccurrence.baskets(spark.createDataFrame(data, "txn int, item string").withColumn("n_ab", F.lit(0))), "t")
    for least in (1, 2, 5):
        got = {(r["item_a"], r["item_b"]): (r["n_a"], r["n_b"], r["n_ab"]) for r in cooccurrence.pair_counts(items, least, chunk).collect()}
        assert got == {p: (single[p[0]], single[p[1]], n) for p, n in both.items() if n >= least}
    scored = cooccurrence.association(cooccurrence.pair_counts(items, 2, chunk), len(sets)).first()
    assert scored["lift"] == pytest.approx(scored["n_ab"] * len(sets) / scored["n_a"] / scored["n_b"])
    assert cooccurrence.pair_counts(items.limit(0), 1, chunk).count() == 0


def test_p2_pairs_has_rare_pairs(spark, con, tmp_path):
    """Every pair has its row, those of a single transaction too; only p2_found has a least count."""
    data = [(t, x) for t, xs in enumerate(["ab", "abc", "abd", "ab", "ab", "cd", "e"]) for x in xs]
    spark.createDataFrame(data, "txn bigint, item string").write.parquet(f"{tmp_path}/txn_items.parquet")
    got = {(r["item_a"], r["item_b"]): r for r in queries.p2_pairs(spark, str(tmp_path)).collect()}
    assert {p: r["n_ab"] for p, r in got.items()} == {("a", "b"): 5, ("a", "c"): 1, ("b", "c"): 1, ("a", "d"): 1, ("b", "d"): 1, ("c", "d"): 1}
    cd = got["c", "d"]
    assert (cd["n_a"], cd["n_b"], cd["lift"], cd["jaccard"]) == (2, 2, 1.75, 0.333333)
    assert cd["pmi"] == pytest.approx(math.log2(1.75), abs=1e-6) and cd["npmi"] == pytest.approx(math.log2(1.75) / math.log2(7), abs=1e-6)
    assert queries.p2_found(spark, str(tmp_path)).count() == 0
    of = "item_a, item_b, n_a, n_b, n_ab"
    want = con.execute(queries._ITEMS + f"select {of} from pairs").fetchall()
    assert sorted(tuple(r) for r in queries.p2_pairs(spark, FOLDER).select(*of.split(", ")).collect()) == sorted(want)


# --- 3: subsequences ----------------------------------------------------------------------------


@pytest.mark.parametrize("distinct", [True, False])
def test_subsequences(spark, monkeypatch, distinct):
    monkeypatch.setattr(logs, "BLOCK", 16)
    hosts = [h for h in many_hosts(4) if h]
    support = defaultdict(set)
    for h, xs in enumerate(hosts):
        for i, a in enumerate(xs):
            for j in range(i + 1, min(i + 3, len(xs))):
                support[a, xs[j]].add(h)
                for k in range(j + 1, min(j + 3, len(xs))):
                    support[a, xs[j], xs[k]].add(h)
    least = max(2, math.ceil(0.3 * len(hosts)))
    want = {p: len(s) for p, s in support.items() if len(s) >= least and (not distinct or len(set(p)) == len(p))}
    got = subsequences.frequent_subsequences(logs.staged_clean_rows(raw(spark, hosts)), 3, 2, 2, 0.3, distinct)
    assert {tuple(r["steps"]): r["hosts"] for r in got.collect()} == want and want
    nothing = subsequences.frequent_subsequences(logs.staged_clean_rows(raw(spark, [])), 3, 2, 2, 0.3)
    assert nothing.count() == 0


def test_diagram_shares_nodes():
    d = subsequences.Diagram(2, 2)
    for host in range(50):
        d.add((1, 2, 3, 4), host)
        d.add((9, 1, 2, 3), host)
    assert len(d.roots) == 2
    found = {tuple(p): n for p, n in d.patterns(0, {1, 2, 9}, 1)}
    assert found[0, 1] == 50 and found[0, 1, 3] == 50 and (0, 3) not in found


# --- 4: distinctive terms -------------------------------------------------------------------------


def test_weights(spark):
    hosts = many_hosts(6, 8, "abcd", 20)
    pairs = spark.createDataFrame([(f"h{i}", x) for i, xs in enumerate(hosts) for x in xs], "host_id string, log string")
    per, tot, hf = [Counter(xs) for xs in hosts], Counter(), Counter()
    for c in per:
        tot.update(c)
        hf.update(c.keys())
    n, every = sum(1 for c in per if c), sum(tot.values())
    for r in distinctive.term_weights(pairs).collect():
        c = per[int(r["host_id"][1:])]
        w = {t: (1 + math.log(k)) * (math.log((1 + n) / (1 + hf[t])) + 1) for t, k in c.items()}
        assert r["weight"] == pytest.approx(w[r["log"]] / math.sqrt(sum(x * x for x in w.values())))
        t = np.array([[c[r["log"]], sum(c.values()) - c[r["log"]]], [tot[r["log"]] - c[r["log"]], 0]], float)
        t[1, 1] = every - t.sum()
        e = t.sum(1, keepdims=True) * t.sum(0) / every
        g = 2 * sum(a * math.log(a / b) for a, b in zip(t.ravel(), e.ravel()) if a > 0)
        assert r["llr"] == pytest.approx(g, abs=1e-6) and r["over"] == (t[0, 0] > e[0, 0] + 1e-9)
    assert distinctive.term_weights(pairs.limit(0)).count() == 0
    one = distinctive.term_weights(spark.createDataFrame([("h", "x")], "host_id string, log string")).first()
    assert (one["weight"], one["llr"]) == (1.0, 0.0)


def test_found_by_weight_alone(spark, tmp_path, monkeypatch):
    raw(spark, [["a", "a"], ["a"]]).write.parquet(str(tmp_path / "log_rows.parquet"))
    weights = {r["host_id"]: (r["llr"], r["weight"]) for r in queries.p4_weights(spark, str(tmp_path)).collect()}
    assert weights == {"h0": (0.0, 1.0), "h1": (0.0, 1.0)}  # cases with a ratio of 0, so no bound above 0 keeps them
    monkeypatch.setattr(distinctive, "log_likelihood_ratio", lambda *cells: pytest.fail("a ratio that leaves no row out"))
    assert sorted(map(tuple, queries.p4_found(spark, str(tmp_path)).collect())) == [("h0", "a"), ("h1", "a")]


# --- 7: runs ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("gap", [1, 4])
def test_runs(spark, monkeypatch, gap):
    from itertools import groupby

    monkeypatch.setattr(logs, "BLOCK", 8)
    hosts = many_hosts(8, 12, "ab", 40)
    want = []
    for h, xs in enumerate(hosts):
        i = 0
        for x, g in groupby(xs):
            n = len(list(g))
            want.append((f"h{h}", i * gap, (i + n - 1) * gap, x, n))
            i += n
    seq = logs.staged_clean_rows(raw(spark, hosts, gap), with_ts=True)
    cols = ["host_id", "start_pos", "end_pos", "log", "n"]
    assert sorted(tuple(r) for r in runs.runs(seq).select(*cols).collect()) == sorted(want)
    assert sorted(tuple(r) for r in runs.runs(seq, 3).select(*cols).collect()) == sorted(w for w in want if w[4] >= 3)
    assert runs.runs(logs.staged_clean_rows(raw(spark, []), with_ts=True), 3).count() == 0


# --- 8: tokenizer ------------------------------------------------------------------------------------


def odd_texts():
    rng = random.Random(5)
    fixed = [None, "", " ", "\n\n  \t", "<|endoftext|> is text", "a" * 20_000, "ab" * 9_000 + "é" * 3_000, "　\x1c\x85 x", "ﷺ" * 300, "漢字かな交じり文。" * 50, "x" * 300 + " " * 300 + "'ll", "١٢٣ ½ ²"]
    return fixed + ["".join(rng.choice("abe é漢\n\t's1٣\U0001f600‍-_") for _ in range(rng.randint(1, 80))) for _ in range(300)]


def test_tokenizer_against_libraries(spark):
    import tiktoken
    from tokenizers import Tokenizer

    texts = odd_texts() + [r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("text").collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    ids = {r["doc_id"]: r["ids"] for r in tokenizer.encode_texts(df).collect()}
    counts = {r["doc_id"]: r["tokens"] for r in tokenizer.count_tokens(df).collect()}
    ranks = tokenizer.read_ranks(tokenizer.vocabulary())
    enc = tiktoken.Encoding("own", pat_str=tokenizer.PATTERN, mergeable_ranks=ranks, special_tokens={})
    lib = Tokenizer.from_file(f"{tokenizer.FOLDER}/byte_bpe_50k.json")
    lib.encode_special_tokens = True
    back = {i: b for b, i in ranks.items()}
    for i, t in enumerate(texts):
        assert counts[i] == len(ids[i])
        if not t:
            assert ids[i] == []
            continue
        assert ids[i] == enc.encode_ordinary(t) == lib.encode(t, add_special_tokens=False).ids, repr(t[:50])
        assert b"".join(back[x] for x in ids[i]).decode() == t


def test_merge_without_whole_piece():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abab": 258, b"aa": 259}

    def brute(p):
        parts = [p[i : i + 1] for i in range(len(p))]
        while True:
            best = min(((ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1)), default=(1 << 40, 0))
            if best[0] == 1 << 40:
                return tuple(ranks[x] for x in parts)
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    rng = random.Random(0)
    for _ in range(500):
        p = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 40)))
        assert tokenizer.merge_piece(p, ranks) == (brute(p) if p not in ranks else (ranks[p],))


def test_tokenizer_keeps_columns_and_rows(spark):
    df = spark.createDataFrame([(1, "a b", "t"), (1, "a b", "t"), (2, None, None)], "doc_id int, text string, tokens string")
    assert tokenizer.encode_texts(df).columns == ["doc_id", "tokens", "ids"] and tokenizer.encode_texts(df).count() == 3
    with pytest.raises(ValueError):
        tokenizer.count_tokens(df)
    assert tokenizer.encode_texts(df.limit(0)).count() == 0


def test_store_starts_anew(monkeypatch):
    monkeypatch.setattr(tokenizer, "KEPT", 3)
    e = tokenizer.Encoder(tokenizer.vocabulary())
    text = "one two three four five one two zzzqqq"
    assert e.encode(text) == tokenizer.Encoder(tokenizer.vocabulary()).encode(text) and len(e) <= 3


# --- 9: mixing ------------------------------------------------------------------------------------------


def test_flow_is_optimal():
    # One overlapping group can serve both sources; repeating costs more than using it once.
    t = [mixing.Target("a", mixing.Fraction(1, 2), 2), mixing.Target("b", mixing.Fraction(1, 2), 2)]
    flows, demand, gets = mixing.route({("a",): 10, ("a", "b"): 10, ("b",): 10}, t, 30)
    assert demand == gets == {"a": 15, "b": 15}
    assert flows[("a",), "a"] + flows[("a", "b"), "a"] == 15 and flows[("a", "b"), "a"] + flows[("a", "b"), "b"] == 10
    flows, demand, gets = mixing.route({("a",): 10, ("b",): 90}, t, 100)
    assert gets == {"a": 20, "b": 50} and demand == {"a": 50, "b": 50}


def test_mix(spark):
    rng = random.Random(9)
    docs = [(i, rng.choice([["x"], ["y"], ["x", "y"], ["z"], ["x", "x"], [], None]), rng.choice([0, 5, 20, 100, None])) for i in range(3000)]
    df = stage(spark.createDataFrame(docs, "id int, sources array<string>, tokens bigint"), "t")
    raw_targets = spark.createDataFrame([("X ", 3.0, 3), ("y", 1.0, None), ("none", 0.5, 2), ("w", None, 2), ("v", -1.0, 2), (None, 1.0, 1)], "source string, weight double, max_repeats int")
    targets = mixing.read_targets(raw_targets)
    assert [(t.source, t.max_repeats) for t in targets] == [("none", 2), ("x", 3), ("y", 1)]
    chosen, report = mixing.mix(df, targets)
    full = {r["source"]: r for r in mixing.with_reached(stage(chosen, "c"), report).collect()}
    of = {i: (set(s or []), n) for i, s, n in docs}
    limit = {t.source: t.max_repeats for t in targets}
    drawn = Counter()
    for r in chosen.collect():
        assert r["source"] in of[r["id"]][0] and 1 <= r["copies"] <= limit[r["source"]] and r["tokens"] == of[r["id"]][1]
        drawn[r["source"]] += r["copies"] * r["tokens"]
    for s, r in full.items():
        assert r["drawn"] == drawn[s] and abs(r["drawn"] - r["flow"]) <= 400
    assert full["none"]["shortfall"] == full["none"]["demand"] > 0
    assert rows_of(chosen) == rows_of(mixing.mix(df, targets)[0])
    none, rep = mixing.mix(df, [])
    assert none.count() == 0 and rep.count() == 0
    empty, rep = mixing.mix(df.limit(0), targets)
    assert empty.count() == 0 and rep.count() == 3


# --- 10: reading level -----------------------------------------------------------------------------------


def test_ordinal_fit():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(800, 3))
    y = 1 + (x @ [2.0, -1.0, 0.0] + rng.logistic(size=800) * 0.1 > np.array([-2, -0.5, 0.5, 2])[:, None]).sum(0)
    m = reading.fit_ordinal(x, y)
    assert (m.grade(x) == y).mean() > 0.8 and np.all(np.diff(m.cuts) > 0) and abs(m.beta[2]) < 0.3
    only = reading.fit_ordinal(x[:10], np.full(10, 3))
    assert np.all(np.isfinite(only.cuts))


def test_held_out_grades(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "reading_labels"))
    held = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    got = {r["doc_id"]: r["grade"] for r in reading.reading_levels(docs, labels.where(~held)).collect()}
    by = defaultdict(list)
    for r in labels.where(held).collect():
        by[r["doc_id"]].append(r["grade"])
    sure = {d: g[0] for d, g in by.items() if len(g) > 1 and len(set(g)) == 1 and d in got}
    assert len(sure) > 50
    assert np.mean([got[d] == g for d, g in sure.items()]) > 0.9


def test_reading_edges(spark):
    docs = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, " 　\n", "en"), (4, "12 34", "EN "), (5, "A b. C d!", "xx"), (6, "Word " * 30_000, "fr"), (6, "Word " * 30_000, "fr"), (None, "One two.", "de"), (8, "Eins zwei.", None)], "doc_id int, text string, lang string").withColumn("grade", F.lit("clash"))
    labels = spark.createDataFrame([(4, 1, "r"), (6, 5, "r"), (6, 4, None), (None, 3, "r"), (4, None, "r"), (4, 9, "r")], "doc_id int, grade int, rater string")
    got = sorted((str(r["doc_id"]), r["lang"]) for r in reading.reading_levels(docs, labels).collect())
    assert got == [("4", "en"), ("6", "fr"), ("6", "fr"), ("None", "de")]
    assert {r["grade"] for r in reading.reading_levels(docs, labels.limit(0)).collect()} == {None}
    assert reading.reading_levels(docs.limit(0), labels).count() == 0


@pytest.mark.parametrize("broadcast", [True, False])
def test_rarity_counts_words_exactly(spark, monkeypatch, broadcast):
    """A rare word is rare, though its hash shares the lowest 16 bits with that of a frequent word."""
    if not broadcast:
        monkeypatch.setattr("tarnmill.staging.BROADCAST_BYTES", 0)
    letters = F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")
    cell = F.pmod(F.xxhash64(F.lit("en"), letters), F.lit(1 << 16))
    often, rare = spark.range(2000).groupBy(cell).agg(F.array_sort(F.collect_list(letters)).alias("w")).where("size(w) > 1").orderBy("w").first()["w"][:2]
    docs = spark.createDataFrame([(1, "en", " ".join([often] * 50)), (2, "en", rare), (3, "de", often), (4, "en", "1")], "doc_id int, lang string, text string")
    rarities = reading.word_rarities(docs)
    assert sorted((r["lang"], r["w"]) for r in rarities.collect()) == sorted([("en", often), ("en", rare), ("de", often)])
    got = {r["doc_id"]: r["rarity"] for r in reading.text_features(docs, rarities).collect()}
    assert got == pytest.approx({1: math.log(52 / 50), 2: math.log(52), 3: math.log(52), 4: 0.0})
