"""Frequency of every distinct value, and of every n-gram of values (suffix-sorted counting).

Each position of a sequence gives one suffix, truncated to `max_n` terms. Suffixes are routed by
their first term, sorted in reverse lexicographic order within a task, and one pass with a stack
gives the counts and record sets of all their prefixes: when the next suffix no longer shares a
prefix, that prefix is complete, is given out, and passes its count and records to the one below.

A first term that holds a large share of all rows is spread by a hash of the record, so record sets
of its parts are disjoint and its counts add up exactly. A record that holds a large share of all rows
is spread as well, by a hash of the suffix. Such a record's suffixes are counted apart, under its own
label: each part gives 0 or 1 record, of which the greatest counts, so its parts add up exactly too.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import shuffle_partitions
from .logs import hot_salts, plain_log, with_following

_OUT = "gram array<string>, total bigint, records bigint, label string"


def prefixes_by_stack(rows: Iterator[tuple], max_n: int) -> Iterator[tuple[tuple, int, int]]:
    """(prefix, count, number of records) of all prefixes of the sorted (suffix, record, count).

    `suffix` is a tuple of 1 to max_n terms; rows come in reverse lexicographic order, a longer
    suffix before its own prefixes. The stack holds at most max_n open prefixes.
    """
    path: tuple = ()
    counts: list[int] = []
    records: list[set] = []
    for suffix, record, n in rows:
        if suffix != path:
            shared = 0
            for x, y in zip(suffix, path):
                if x != y:
                    break
                shared += 1
            while len(counts) > shared:
                c, r = counts.pop(), records.pop()
                yield path[: len(counts) + 1], c, len(r)
                if counts:
                    counts[-1] += c
                    records[-1] |= r
            while len(counts) < len(suffix):
                counts.append(0)
                records.append(set())
            path = suffix
        counts[-1] += n
        records[-1].add(record)
    while counts:
        c, r = counts.pop(), records.pop()
        yield path[: len(counts) + 1], c, len(r)
        if counts:
            counts[-1] += c
            records[-1] |= r


def _count_partition(max_n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, totals, recs, labels = [], [], [], []

        def rows():
            for b in batches:
                cols = [b.column(i).to_pylist() for i in range(max_n)]
                hosts, ns, marks = (b.column(max_n + i).to_pylist() for i in range(3))
                suffixes = zip(*cols)
                for suffix, host, n, mark in zip(suffixes, hosts, ns, marks):
                    if suffix[-1] is None:
                        suffix = tuple(x for x in suffix if x is not None)
                    yield mark, suffix, host, n

        # Rows come label by label, so each label has a stack of its own.
        for mark, group in groupby(rows(), itemgetter(0)):
            for g, c, r in prefixes_by_stack((x[1:] for x in group), max_n):
                grams.append(g)
                totals.append(c)
                recs.append(r)
                labels.append(mark)
                if len(grams) == 20_000:
                    yield _batch(grams, totals, recs, labels)
                    grams, totals, recs, labels = [], [], [], []
        yield _batch(grams, totals, recs, labels)

    return run


def _batch(grams, totals, recs, labels) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(grams, pa.list_(pa.string())), pa.array(totals, pa.int64()), pa.array(recs, pa.int64()), pa.array(labels, pa.string())], names=["gram", "total", "records", "label"]
    )


def gram_counts(seq: DataFrame, max_n: int = 1, term_rows: DataFrame | None = None, loose: DataFrame | None = None) -> DataFrame:
    """(gram, n, total, records): count and number of hosts of every n-gram of 1 to max_n terms.

    `seq` is staged (host_id, block, pos, log). `term_rows` (log, total) are rough counts of single
    terms, from which hot first terms are found; without them they are counted from `seq`. They only
    steer the spreading, never a result. `loose` (host_id, log) are occurrences without a place, which
    count as single terms only. An empty table gives no rows; n-grams never reach over the end of a
    host's sequence, so a host with fewer terms gives only shorter ones.
    """
    spark = seq.sparkSession
    seq = seq.select("host_id", "block", "pos", "log")
    terms = [f"t{i}" for i in range(max_n)]
    if max_n > 1:
        nxt = with_following(seq, max_n - 1, ["log"])
        suffixes = nxt.select("host_id", "block", F.col("log").alias("t0"), *[F.get(F.col("nexts")["log"], i - 1).alias(f"t{i}") for i in range(1, max_n)])
    else:
        suffixes = seq.select("host_id", "block", F.col("log").alias("t0"))
    if term_rows is None:
        term_rows = seq.groupBy("log").agg(F.count("*").alias("total"))
    salts = hot_salts(term_rows, "log", "total")
    hosts = hot_salts(seq.groupBy("host_id").agg(F.count("*").alias("total")), "host_id", "total").select("host_id", F.col("salts").alias("host_salts"))
    # Suffixes lie by (host_id, block) already, so these are merged where they are.
    merged = suffixes.groupBy("host_id", "block", *terms).agg(F.count("*").alias("n")).drop("block")
    if loose is not None:
        merged = merged.unionByName(loose.groupBy("host_id", F.col("log").alias("t0")).agg(F.count("*").alias("n")), allowMissingColumns=True)
    own = F.col("host_salts").isNotNull()
    routed = (
        merged.join(F.broadcast(salts), merged["t0"] == salts["log"], "left")
        .join(F.broadcast(hosts), "host_id", "left")
        .withColumn("label", F.when(own, F.col("host_id")))
        .withColumn("salt", F.when(own, F.pmod(F.xxhash64(*terms), F.col("host_salts"))).otherwise(F.pmod(F.xxhash64("host_id"), F.coalesce("salts", F.lit(1)))))
        .repartition(shuffle_partitions(spark), "t0", "label", "salt")
        .sortWithinPartitions("label", *[F.desc_nulls_last(t) for t in terms])
        .select(*terms, "host_id", "n", "label")
    )
    parts = routed.mapInArrow(_count_partition(max_n), _OUT)
    # Without label the parts' records are disjoint; those of one label are the same record.
    apart = parts.groupBy("gram", "label").agg(F.sum("total").alias("total"), F.when(F.col("label").isNull(), F.sum("records")).otherwise(F.max("records")).alias("records"))
    return (
        apart.groupBy("gram")
        .agg(F.sum("total").alias("total"), F.sum("records").alias("records"))
        .select("gram", F.size("gram").alias("n"), "total", "records")
    )


def raw_term_rows(rows: DataFrame) -> DataFrame:
    """Rough counts of plain logs over all raw rows: one column, merged before its small shuffle."""
    return rows.groupBy("log").agg(F.count("*").alias("n")).groupBy(plain_log(F.col("log")).alias("log")).agg(F.sum("n").alias("total"))


def mark_unused(counts: DataFrame, n_records: int, min_records: float = 3, max_records: float = 0.6) -> DataFrame:
    """`counts` with `too_rare` and `too_common`. Numbers below 1 (or 1.0) are shares of n_records.

    A term on exactly the bound is kept, as is every term if n_records is 0.
    """
    def bound(x: float) -> float:
        return x * n_records if isinstance(x, float) and x <= 1 else x

    return counts.withColumn("too_rare", F.col("records") < F.lit(bound(min_records))).withColumn("too_common", F.col("records") > F.lit(bound(max_records)))
