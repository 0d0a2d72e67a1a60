"""Counts, weights, item sets and encodings of event sequences, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features, itemsets, sequences
from ..staging import stage
from .base import BASKETS, SEQ, r6, user_days
from .base import sequences as seq_of


def count_logs(spark: SparkSession, d: str) -> DataFrame:
    return features.count_logs(seq_of(spark, d))


def ngram_counts(spark: SparkSession, d: str) -> DataFrame:
    return features.count_logs(seq_of(spark, d), 3)


def host_frequency(spark: SparkSession, d: str) -> DataFrame:
    return features.log_totals(features.count_logs(seq_of(spark, d), 2))


def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return features.vocabulary(features.log_totals(features.count_logs(seq_of(spark, d), 2)))


def vocab_pruned(spark: SparkSession, d: str) -> DataFrame:
    seq = seq_of(spark, d)
    kept, unused = features.prune(stage(features.count_logs(seq, 3), "counts"), seq.select("host").distinct().count(), features.CountSpec(0.9, 0.2, 40, 3))
    return kept.withColumn("used", F.lit(True)).unionByName(unused.withColumn("used", F.lit(False)))


def _weighted(spark: SparkSession, d: str, n: int = 2, **how) -> DataFrame:
    seq = seq_of(spark, d)
    counts = stage(features.count_logs(seq, n), "counts")
    return features.weights(counts, counts.select("host").distinct().count(), **how).select("host", "log", r6("value"))


def lfihf_l2(spark: SparkSession, d: str) -> DataFrame:
    return _weighted(spark, d)


def lfihf_l1_log(spark: SparkSession, d: str) -> DataFrame:
    return _weighted(spark, d, norm="l1", lf_type="log")


def lfihf_pct(spark: SparkSession, d: str) -> DataFrame:
    return _weighted(spark, d, norm=None, lf_type="pct", smooth=False)


def lfihf_bool(spark: SparkSession, d: str) -> DataFrame:
    return _weighted(spark, d, lf_type="bool")


def lfihf_no_ihf(spark: SparkSession, d: str) -> DataFrame:
    return _weighted(spark, d, use_ihf=False)


def ihf_weights(spark: SparkSession, d: str) -> DataFrame:
    return features.LogVectorizer(features.CountSpec(ngram=2), weighted=True).fit(seq_of(spark, d)).ihf_.select("log", r6("ihf"))


def vectorizer_transform(spark: SparkSession, d: str) -> DataFrame:
    """Fitted on all users, and applied to all."""
    seq = seq_of(spark, d)
    fitted = features.LogVectorizer(features.CountSpec(ngram=3, min_hf=2), weighted=True).fit(seq)
    return fitted.transform(seq).select("host", "idx", "log", r6("value"))


def vectorizer_fixed(spark: SparkSession, d: str) -> DataFrame:
    """Counts of a fixed vocabulary, of which one log never occurs."""
    spec = features.CountSpec(logs=("view", "click", "absent"))
    return features.LogVectorizer(spec).fit_transform(seq_of(spark, d))


def vectorizer_fit_transform(spark: SparkSession, d: str) -> DataFrame:
    """The ten commonest bigrams, weighted."""
    out = features.LogVectorizer(features.CountSpec(ngram=2, max_features=10), weighted=True, norm="l1").fit_transform(seq_of(spark, d))
    return out.select("host", "idx", "log", r6("value"))


def apriori_transform(spark: SparkSession, d: str) -> DataFrame:
    """Item sets of the users with even numbers, in the baskets of all."""
    baskets = stage(user_days(spark, d), "user-days")
    even = baskets.where("cast(substring_index(txn, '@', 1) as bigint) % 2 = 0")
    return itemsets.ItemsetEncoder(3, 2, 0.04).fit(even).transform(baskets)


def apriori_itemsets(spark: SparkSession, d: str) -> DataFrame:
    sets = itemsets.frequent_itemsets(user_days(spark, d), 3, 2, 0.04)
    return sets.select(F.concat_ws("|", "items").alias("itemset"), "size", "support")


def apriori_encode(spark: SparkSession, d: str) -> DataFrame:
    baskets = stage(user_days(spark, d), "user-days")
    return itemsets.encode_itemsets(baskets, itemsets.frequent_itemsets(baskets, 2, 2, 0.1))


def embed_codes(spark: SparkSession, d: str) -> DataFrame:
    seq = seq_of(spark, d)
    return features.SequenceEncoder().fit(seq).transform(seq).select("host", F.array_join("codes", ",").alias("codes"))


def embed_one_hot(spark: SparkSession, d: str) -> DataFrame:
    seq = seq_of(spark, d)
    hot = features.SequenceEncoder(include_constant=True).fit(seq).one_hot(seq)
    return hot.select("host", F.array_join(F.transform("rows", lambda r: F.array_join(r.cast("array<string>"), "")), ",").alias("rows"))


def unique_items(spark: SparkSession, d: str) -> DataFrame:
    arrays = seq_of(spark, d).groupBy("host").agg(F.collect_list("log").alias("logs"))
    return sequences.unique_items(arrays, "logs")


def sliding_window(spark: SparkSession, d: str) -> DataFrame:
    arrays = seq_of(spark, d).groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "log"))), lambda x: x["log"]).alias("a"))
    return arrays.select("host", F.posexplode(sequences.sliding_windows(F.col("a"), 4, F.lit("!"), 3)).alias("i", "w")).select("host", "i", F.array_join("w", ",").alias("w"))


def batch(spark: SparkSession, d: str) -> DataFrame:
    arrays = seq_of(spark, d).groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "log"))), lambda x: x["log"]).alias("a"))
    return arrays.select("host", F.posexplode(sequences.batches(F.col("a"), 4)).alias("i", "w")).select("host", "i", F.array_join("w", ",").alias("w"))


def flat_map(spark: SparkSession, d: str) -> DataFrame:
    arrays = seq_of(spark, d).groupBy("host").agg(F.collect_list("log").alias("a"))
    split = sequences.flat_map(F.col("a"), lambda x: F.array(x, F.upper(x)))
    return arrays.select(F.explode(split).alias("item")).groupBy("item").agg(F.count("*").alias("n"))


def queries() -> dict:
    names = (
        "count_logs ngram_counts host_frequency vocabulary vocab_pruned lfihf_l2 lfihf_l1_log lfihf_pct lfihf_bool lfihf_no_ihf ihf_weights vectorizer_transform "
        "vectorizer_fixed vectorizer_fit_transform apriori_itemsets apriori_encode apriori_transform embed_codes embed_one_hot unique_items sliding_window batch flat_map"
    ).split()
    return {n: globals()[n] for n in names}


_N2 = f"""with {SEQ}, g as (select host, log || '|' || lead(log) over (partition by host order by pos) as log from seq),
c as (select host, log, count(*) as cnt from g where log is not null group by all union all select distinct host, 'const', 1 from seq),
n as (select count(distinct host)::double as n from c)
"""
_N3 = f"""with {SEQ}, g as (select host, log || '|' || lead(log) over w || '|' || lead(log, 2) over w as log from seq window w as (partition by host order by pos)),
c as (select host, log, count(*) as cnt from g where log is not null group by all union all select distinct host, 'const', 1 from seq),
n as (select count(distinct host)::double as n from c)
"""


def _weight_sql(lf: str, ihf: str, norm: str) -> str:
    return _N2 + f""", hf as (select log, count(*)::double as hf from c group by log),
    w as (select host, log, ({lf}) * ({ihf}) as w from c join hf using (log), n)
    select host, log, round(w / ({norm}), 6) as value from w"""


def oracle_sql() -> dict[str, str]:
    l2 = "sqrt(sum(w * w) over (partition by host))"
    smooth = "ln((1 + n) / (1 + hf)) + 1"
    return {
        "count_logs": f"with {SEQ} select host, log, count(*) as cnt from seq group by all",
        "ngram_counts": _N3 + "select * from c",
        "host_frequency": _N2 + "select log, count(*) as hf, sum(cnt)::bigint as total from c group by log",
        "vocabulary": _N2 + "select log, row_number() over (order by log) - 1 as idx from (select distinct log from c)",
        "vocab_pruned": _N3 + """, t as (select log, count(*) as hf, sum(cnt)::bigint as total from c group by log),
            k as (select t.* from t, n where hf between 0.2 * n and 0.9 * n order by total desc, log limit 40)
            select *, true as used from k union all select *, false from t where log not in (select log from k)""",
        "lfihf_l2": _weight_sql("cnt", smooth, l2),
        "lfihf_l1_log": _weight_sql("1 + ln(cnt)", smooth, "sum(w) over (partition by host)"),
        "lfihf_pct": _weight_sql("cnt / (sum(cnt) over (partition by host))::double", "ln(n / hf) + 1", "1"),
        "lfihf_bool": _weight_sql("1", smooth, l2),
        "lfihf_no_ihf": _weight_sql("cnt", "1", l2),
        "ihf_weights": _N2 + "select log, round(ln((1 + any_value(n)) / (1 + count(*))) + 1, 6) as ihf from c, n group by log",
        "vectorizer_transform": _N3 + f""", f as (select log, count(*) as hf from c group by log having count(*) >= 2),
            v as (select log, row_number() over (order by log) - 1 as idx, ln((1 + (select count(distinct host) from c)) / (1e0 + hf)) + 1 as ihf from f),
            w as (select host, idx, log, cnt * ihf as w from c join v using (log))
            select host, idx, log, round(w / {l2}, 6) as value from w""",
        "vectorizer_fixed": f"""with {SEQ}, v as (select * from (values ('absent', 0::bigint), ('click', 1), ('view', 2)) v(log, idx)) select host, idx, log, count(*) as value from seq join v using (log) group by all""",
        "vectorizer_fit_transform": _N2 + f""", f as (select log, count(*) as hf, sum(cnt) as total from c group by log order by total desc, log limit 10),
            v as (select log, row_number() over (order by log) - 1 as idx, ln((1 + any_value(n)) / (1 + any_value(hf))) + 1 as ihf from f, n group by log),
            w as (select host, idx, log, cnt * ihf as w from c join v using (log)) select host, idx, log, round(w / sum(w) over (partition by host), 6) as value from w""",
        "apriori_transform": f"""with {BASKETS}, e as (select * from b where split_part(txn, '@', 1)::bigint % 2 = 0), n as (select greatest(1, floor(count(distinct txn) * 0.04)) as least from e),
            s as (select x.txn, x.item || '|' || y.item as itemset, 2 as size from b x join b y on x.txn = y.txn and x.item < y.item
                  union all select x.txn, x.item || '|' || y.item || '|' || z.item, 3 from b x join b y on x.txn = y.txn and x.item < y.item join b z on x.txn = z.txn and y.item < z.item),
            k as (select itemset, size from s where split_part(txn, '@', 1)::bigint % 2 = 0 group by all having count(*) >= (select least from n)),
            m as (select itemset, row_number() over (order by size, itemset) - 1 as idx from k) select txn, idx, itemset from s join m using (itemset)""",
        "apriori_itemsets": f"""with {BASKETS}, n as (select greatest(1, floor(count(distinct txn) * 0.04)) as least from b),
            p as (select x.item || '|' || y.item as itemset, 2 as size, count(*) as support from b x join b y on x.txn = y.txn and x.item < y.item group by 1
                  union all select x.item || '|' || y.item || '|' || z.item, 3, count(*) from b x join b y on x.txn = y.txn and x.item < y.item join b z on x.txn = z.txn and y.item < z.item group by 1)
            select p.* from p, n where support >= least""",
        "apriori_encode": f"""with {BASKETS}, n as (select greatest(1, floor(count(distinct txn) * 0.1)) as least from b),
            t as (select x.txn, x.item || '|' || y.item as itemset from b x join b y on x.txn = y.txn and x.item < y.item)
            select txn, itemset from t, n qualify count(*) over (partition by itemset) >= least""",
        "embed_codes": f"""with {SEQ}, v as (select log, row_number() over (order by log) - 1 as code from (select distinct log from seq)),
            m as (select max(pos) as len from seq), a as (select host, list(code order by pos) as codes from seq join v using (log) group by host)
            select host, array_to_string(list_concat(list_transform(range(len - len(codes)), lambda x: 0), codes), ',') as codes from a, m""",
        "embed_one_hot": f"""with {SEQ}, v as (select log, row_number() over (order by log) - 1 as code from (select distinct log from seq)),
            m as (select max(pos) as len, (select count(*) from v) as wide from seq), a as (select host, list(code order by pos) as codes from seq join v using (log) group by host)
            select host, array_to_string(list_concat(list_transform(range(len - len(codes)), lambda x: repeat('0', wide) || '1'),
              list_transform(codes, lambda c: repeat('0', c::bigint) || '1' || repeat('0', (wide - 1 - c)::bigint) || '1')), ',') as rows from a, m""",
        "unique_items": "select distinct event_type as item from events",
        "sliding_window": f"""with {SEQ}, a as (select host, list(log order by pos) as a, count(*) as n from seq group by host),
            s as (select *, unnest(range(0, case when n <= 4 then 1 else (n - 4) // 3 + 1 + case when (n - 4) % 3 > 0 and 3 - (n - 4) % 3 < 4 then 1 else 0 end end)) as i from a)
            select host, i::int as i, array_to_string(list_concat(a[i * 3 + 1:i * 3 + 4], list_transform(range(4 - len(a[i * 3 + 1:i * 3 + 4])), lambda x: '!')), ',') as w from s""",
        "batch": f"""with {SEQ} select host, ((pos - 1) // 4)::int as i, string_agg(log, ',' order by pos) as w from seq group by 1, 2""",
        "flat_map": "select item, count(*) as n from (select event_type as item from events union all select upper(event_type) from events) group by 1",
    }
