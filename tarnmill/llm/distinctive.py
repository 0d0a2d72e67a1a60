"""How distinctive a term is per record: log-likelihood ratio and inverse-frequency weight.

Counts of (record, term) are made once and staged. Statistics of terms and of records are joined to
them; each is sent to all executors only if its counted size allows it, else the join shuffles, with a
term of very many records, or a record of very many terms, spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import skew_join
from ..staging import small, stage


def _cell(k: Column, row: Column, col: Column, n: Column) -> Column:
    """k ln(k n / (row col)), 0 for an empty cell."""
    d = lambda c: c.cast("double")
    return F.when(k > 0, d(k) * F.log(d(k) * d(n) / (d(row) * d(col)))).otherwise(F.lit(0.0))


def log_likelihood_ratio(k11: Column, row: Column, col: Column, n: Column) -> Column:
    """G2 of the two-by-two table: a term in a record (k11), all terms of the record (row), the term
    in the collection (col), all terms of the collection (n). Never below 0."""
    k12, k21 = row - k11, col - k11
    k22 = n - row - col + k11
    g = F.lit(2.0) * (_cell(k11, row, col, n) + _cell(k12, row, n - col, n) + _cell(k21, n - row, col, n) + _cell(k22, n - row, n - col, n))
    return F.greatest(g, F.lit(0.0))


def _join_statistics(counts: DataFrame, stats: DataFrame, key: str, rows: int, row_bytes: int) -> DataFrame:
    one = small(stats, rows, row_bytes)
    return counts.join(one, key) if one is not stats else skew_join(counts, stats, [key])


def term_weights(pairs: DataFrame, record: str = "host_id", term: str = "log", ratio: bool = True) -> DataFrame:
    """(record, term, n, records, n_records, llr, over, weight) of every record and term.

    `pairs` has one row for each occurrence; rows with a null record or term don't count. `llr` tests the term's count in the
    record against the rest of the collection; `over` says that it is more frequent there than in
    the collection. `weight` is the l2-normalised (1 + ln n) (ln((1 + R) / (1 + r)) + 1) with R
    records, r of them with the term. The only term of a record has weight 1; a collection of one
    record has llr 0 throughout. Without `ratio`, llr and over are left out, and so are the totals they need.
    """
    counts = stage(pairs.where(F.col(record).isNotNull() & F.col(term).isNotNull()).groupBy(record, term).agg(F.count("*").alias("n")), "record-terms")
    total = lambda name: [F.sum("n").alias(name)] if ratio else []
    terms = stage(counts.groupBy(term).agg(F.count("*").alias("records"), *total("term_total")), "term-stats")
    n_terms, width = terms.agg(F.count("*"), F.max(F.length(term))).first()
    hosts = stage(counts.groupBy(record).agg(F.max(F.length(record)).alias("width"), *total("record_total")), "record-totals")
    n_records, host_width, *all_terms = hosts.agg(F.count("*"), F.max("width"), *([F.sum("record_total")] if ratio else [])).first()
    weighted = _join_statistics(counts, terms, term, n_terms, 4 * (width or 0) + 48).withColumn(
        "w", (F.lit(1.0) + F.log(F.col("n").cast("double"))) * (F.log(F.lit(1.0 + n_records) / (F.lit(1.0) + F.col("records"))) + F.lit(1.0))
    )
    norms = weighted.groupBy(record).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), *total("record_total"))
    norms = stage(norms, "norms")
    tests = []
    if ratio:
        every = F.lit(int(all_terms[0] or 0))
        tests = [
            log_likelihood_ratio(F.col("n"), F.col("record_total"), F.col("term_total"), every).alias("llr"),
            (F.col("n").cast("double") * every.cast("double") > F.col("record_total").cast("double") * F.col("term_total").cast("double")).alias("over"),
        ]
    return _join_statistics(weighted, norms, record, n_records, 4 * (host_width or 0) + 48).select(
        record,
        term,
        "n",
        "records",
        F.lit(n_records).cast("long").alias("n_records"),
        *tests,
        (F.col("w") / F.col("norm")).alias("weight"),
    )
