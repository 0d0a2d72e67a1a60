"""The p queries of this subpackage, each over its whole tables, and their SQL."""

from __future__ import annotations

import math
from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import skew_join
from ..sources.tables import table
from ..staging import stage
from . import cooccurrence, distinctive, mixing, reading, runs, subsequences, term_counts, tokenizer
from .logs import clean_log_rows, loose_rows, staged_clean_rows


def _grams(spark: SparkSession, d: str, max_n: int = 3) -> tuple[DataFrame, int]:
    rows = table(spark, d, "log_rows")
    seq, loose = staged_clean_rows(rows), loose_rows(rows)
    hosts = seq.select("host_id").unionByName(loose.select("host_id")).distinct().count()
    return term_counts.gram_counts(seq, max_n, term_counts.raw_term_rows(rows), loose), hosts


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    grams, hosts = _grams(spark, d)
    marked = term_counts.mark_unused(grams.where("n = 1"), hosts, 3, 0.6)
    return marked.where("too_rare or too_common").select(F.col("gram")[0].alias("log"))


def p1_terms(spark: SparkSession, d: str) -> DataFrame:
    grams, hosts = _grams(spark, d)
    return term_counts.mark_unused(grams, hosts, 3, 0.6).select(F.concat_ws("|", "gram").alias("gram"), "n", "total", "records", "too_rare", "too_common")


def _pairs(spark: SparkSession, d: str, min_count: Callable[[int], int] = lambda n: 1) -> tuple[DataFrame, int]:
    """min_count: the least n_ab, from the number of transactions; by default no pair is left out."""
    items = stage(cooccurrence.baskets(table(spark, d, "txn_items")), "baskets")
    n = items.select("txn").distinct().count()
    return cooccurrence.association(cooccurrence.pair_counts(items, min_count(n)), n), n


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    pairs, n = _pairs(spark, d, lambda n: max(5, math.ceil(Fraction("0.005") * n)))
    # lift >= 3 in whole numbers.
    return pairs.where(F.col("n_ab") * F.lit(n) >= 3 * F.col("n_a") * F.col("n_b")).select("item_a", "item_b")


def p2_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs, _ = _pairs(spark, d)
    r = lambda c: F.round(c, 6).alias(c)
    return pairs.select("item_a", "item_b", "n_a", "n_b", "n_ab", r("lift"), r("pmi"), r("npmi"), r("jaccard"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    found = subsequences.frequent_subsequences(staged_clean_rows(table(spark, d, "log_rows")), 3, 3, 6, 0.1)
    return found.where("n = 3").select(*[F.col("steps")[i].alias(f"step{i + 1}") for i in range(3)])


def p3_subsequences(spark: SparkSession, d: str) -> DataFrame:
    found = subsequences.frequent_subsequences(staged_clean_rows(table(spark, d, "log_rows")), 3, 3, 6, 0.05)
    return found.select(F.concat_ws(">", "steps").alias("steps"), "n", "hosts")


def _weights(spark: SparkSession, d: str, ratio: bool = True) -> DataFrame:
    rows = table(spark, d, "log_rows")
    return distinctive.term_weights(clean_log_rows(rows).select("host_id", "log").unionByName(loose_rows(rows)), ratio=ratio)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The case is defined by the weight, which no bound on the ratio gives (README), so the ratio
    isn't worked out here; p4_weights has it."""
    return _weights(spark, d, ratio=False).where((F.col("records") >= 2) & (F.round("weight", 6) >= 0.5)).select("host_id", "log")


def p4_weights(spark: SparkSession, d: str) -> DataFrame:
    return _weights(spark, d).select("host_id", "log", "n", "records", "over", F.round("llr", 4).alias("llr"), F.round("weight", 6).alias("weight"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return runs.runs(staged_clean_rows(table(spark, d, "log_rows"), with_ts=True), 3).select("host_id", "start_pos", "end_pos")


def p7_runs(spark: SparkSession, d: str) -> DataFrame:
    return runs.runs(staged_clean_rows(table(spark, d, "log_rows"), with_ts=True))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encode_texts(table(spark, d, "documents"), keep=["doc_id"])


def p8_counts(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.count_tokens(table(spark, d, "documents"), keep=["doc_id"])


def _sized(spark: SparkSession, d: str) -> DataFrame:
    """(id, family, source, tokens), staged; blank texts have no tokens."""
    docs = table(spark, d, "documents").withColumn("text", F.when(F.col("text").rlike(r"[^\s\p{Z}]"), F.col("text")))
    sized = tokenizer.count_tokens(docs, keep=["doc_id", "family_id", "source"])
    return stage(sized.select(F.col("doc_id").alias("id"), F.col("family_id").alias("family"), mixing.plain_source(F.col("source")).alias("source"), "tokens"), "sizes")


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The documents chosen, staged, and the report of the mixture, shares reached included."""
    sized = _sized(spark, d).select("id", F.array_compact(F.array("source")).alias("sources"), "tokens")
    chosen, report = mixing.mix(sized, mixing.read_targets(table(spark, d, "mix_targets")))
    chosen = stage(chosen, "chosen")
    return chosen, mixing.with_reached(chosen, report)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[1].where("shortfall > 0").select("source")


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[0].select(F.col("id").alias("doc_id"), "source", "copies", "tokens")


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[1]


def p9_overlap(spark: SparkSession, d: str) -> DataFrame:
    """The report of a mixture in which a document belongs to the wanted sources of all its family."""
    targets = mixing.read_targets(table(spark, d, "mix_targets"))
    sized = _sized(spark, d)
    wanted = sized.where(F.col("source").isin([t.source for t in targets]))
    # At most as many sources as there are targets, merged before the shuffle.
    of_family = wanted.where("family is not null").groupBy("family").agg(F.collect_set("source").alias("sources"))
    joined = skew_join(sized, of_family, ["family"], "left")
    sources = F.coalesce("sources", F.array_compact(F.array("source")))
    chosen, report = mixing.mix(stage(joined.select("id", sources.alias("sources"), "tokens"), "memberships"), targets)
    return mixing.with_reached(stage(chosen, "chosen"), report)


def _levels(spark: SparkSession, d: str) -> DataFrame:
    return reading.reading_levels(table(spark, d, "documents"), table(spark, d, "reading_labels"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _levels(spark, d).where("grade in (1, 5)").select("doc_id", "grade")


def p10_levels(spark: SparkSession, d: str) -> DataFrame:
    return _levels(spark, d)


def queries() -> dict:
    names = ("p1_found p1_terms p2_found p2_pairs p3_found p3_subsequences p4_found p4_weights p7_found p7_runs p8_ids p8_counts p9_found p9_mix p9_report p9_overlap p10_found p10_levels").split()
    return {n: globals()[n] for n in names}


_SEQ = """
clean as (select host_id, pos, row_id, trim(split_part(split_part(lower(log), '#', 1), '[', 1)) as log, ts, log is null as gone
          from log_rows where host_id is not null and pos is not null
          qualify row_number() over (partition by host_id, pos order by row_id nulls first) = 1),
loose as (select host_id, trim(split_part(split_part(lower(log), '#', 1), '[', 1)) as log from log_rows where host_id is not null and pos is null and log is not null),
seq as (select host_id, pos, log, ts, row_number() over (partition by host_id order by pos) as rn from clean where not gone and log <> '')
"""
_GRAMS = f"""with {_SEQ},
next as (select host_id, log as t0, lead(log, 1) over w as t1, lead(log, 2) over w as t2 from seq window w as (partition by host_id order by pos)),
grams as (select host_id, t0 as gram, 1 as n, t0 as log from next union all select host_id, log, 1, log from loose where log <> ''
          union all select host_id, concat(t0, '|', t1), 2, null from next where t1 is not null
          union all select host_id, concat(t0, '|', t1, '|', t2), 3, null from next where t2 is not null),
h as (select count(distinct host_id) as hosts from grams),
c as (select gram, n, count(*) as total, count(distinct host_id) as records, any_value(hosts) as hosts from grams, h group by gram, n)
"""
_ITEMS = """with items as (select distinct txn, lower(trim(item)) as item from txn_items where txn is not null and trim(item) <> ''),
n as (select count(distinct txn) as n from items),
c as (select item, count(*) as c from items group by item),
ab as (select a.item as item_a, b.item as item_b, count(*) as n_ab from items a join items b on a.txn = b.txn and a.item < b.item group by 1, 2),
pairs as (select item_a, item_b, x.c as n_a, y.c as n_b, n_ab, n, n_ab * n / (x.c * y.c * 1e0) as lift
          from ab join c x on item_a = x.item join c y on item_b = y.item, n)
"""


def _sub(share: str) -> str:
    return f"""with {_SEQ},
h as (select greatest(6, {share} * count(distinct host_id)) as least from seq),
ab as (select distinct a.host_id, b.rn, a.log as a, b.log as b from seq a join seq b on a.host_id = b.host_id and b.rn between a.rn + 1 and a.rn + 3 and a.log <> b.log),
two as (select a, b, count(distinct host_id) as hosts from ab group by a, b),
three as (select ab.a, ab.b, c.log as c, count(distinct ab.host_id) as hosts from ab join seq c on ab.host_id = c.host_id and c.rn between ab.rn + 1 and ab.rn + 3
          where c.log not in (ab.a, ab.b) group by 1, 2, 3)
"""


_WEIGHTS = f"""with {_SEQ},
c as (select host_id, log, count(*) as n from (select host_id, log from seq union all select host_id, log from loose where log <> '') group by 1, 2),
t as (select log, count(*) as records, sum(n) as term_total from c group by 1),
h as (select host_id, sum(n) as record_total from c group by 1),
g as (select count(*) as hosts, sum(record_total) as every from h),
x as (select c.host_id, c.log, n::double as k11, record_total::double as r, term_total::double as t, every::double as e, records,
      (1 + ln(n)) * (ln((1 + hosts) / (1e0 + records)) + 1) as w from c join t using (log) join h using (host_id), g),
y as (select *, r - k11 as k12, t - k11 as k21, e - r - t + k11 as k22, w / sqrt(sum(w * w) over (partition by host_id)) as weight from x)
"""
_RUNS = f"""with {_SEQ},
m as (select *, case when log = lag(log) over (partition by host_id order by pos) then 0 else 1 end as first from seq),
g as (select *, sum(first) over (partition by host_id order by pos) as run from m),
r as (select host_id, min(pos) as start_pos, max(pos) as end_pos, min(log) as log, count(*) as n, min(ts) as first_ts, max(ts) as last_ts, date_diff('microsecond', min(ts), max(ts)) / 1e6 as duration from g group by host_id, run)
"""


def oracle_sql() -> dict[str, str]:
    cell = lambda k, a, b: f"case when {k} > 0 then {k} * ln({k} * e / (({a}) * ({b}))) else 0 end"
    llr = f"greatest(0, 2 * ({cell('k11', 'r', 't')} + {cell('k12', 'r', 'e - t')} + {cell('k21', 'e - r', 't')} + {cell('k22', 'e - r', 'e - t')}))"
    return {
        "p1_found": _GRAMS + "select log from (select gram as log, records, hosts from c where n = 1) where records < 3 or records > 0.6 * hosts",
        "p1_terms": _GRAMS + "select gram, n, total, records, records < 3 as too_rare, records > 0.6 * hosts as too_common from c",
        "p2_found": _ITEMS + "select item_a, item_b from pairs where n_ab >= 5 and n_ab >= 0.005 * n and n_ab * n >= 3 * n_a * n_b",
        "p2_pairs": _ITEMS + """select item_a, item_b, n_a, n_b, n_ab, round(lift, 6) as lift, round(log2(lift), 6) as pmi,
            round(case when n_ab >= n then 1 else log2(lift) / -log2(n_ab / (n * 1e0)) end, 6) as npmi, round(n_ab / (n_a + n_b - n_ab * 1e0), 6) as jaccard from pairs""",
        "p3_found": _sub("0.1") + "select a as step1, b as step2, c as step3 from three, h where hosts >= least",
        "p3_subsequences": _sub("0.05") + """select concat(a, '>', b) as steps, 2 as n, hosts from two, h where hosts >= least
            union all select concat(a, '>', b, '>', c), 3, hosts from three, h where hosts >= least""",
        "p4_found": _WEIGHTS + "select host_id, log from y where records >= 2 and round(weight, 6) >= 0.5",
        "p4_weights": _WEIGHTS + f"select host_id, log, k11::bigint as n, records, k11 * e > r * t as over, round({llr}, 4) as llr, round(weight, 6) as weight from y",
        "p7_found": _RUNS + "select host_id, start_pos, end_pos from r where n >= 3",
        "p7_runs": _RUNS + "select * from r",
    }
