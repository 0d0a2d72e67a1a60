"""Host-by-log features: counts, vocabulary pruning, inverse-host-frequency weights, encodings."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import stage
from .indexing import number_rows
from .skew import skew_join
from .sequences import ngrams

CONST = "const"


@dataclass(frozen=True)
class CountSpec:
    """Bounds for counting. Integers are numbers of hosts, floats shares of all hosts."""

    max_hf: float = 1.0
    min_hf: float = 1
    max_features: int | None = None
    ngram: int = 1
    logs: tuple[str, ...] | None = None

    def __post_init__(self):
        if self.max_hf < 0 or self.min_hf < 0:
            raise ValueError("max_hf and min_hf must not be negative")
        if self.max_features is not None and (not isinstance(self.max_features, int) or self.max_features <= 0):
            raise ValueError("max_features must be a positive integer or None")
        if not isinstance(self.ngram, int) or self.ngram < 1:
            raise ValueError("ngram must be a positive integer")
        if self.logs is not None and (not self.logs or len(set(self.logs)) != len(self.logs)):
            raise ValueError("a fixed vocabulary must have different logs")

    def bounds(self, hosts: int) -> tuple[float, float]:
        low = self.min_hf * hosts if isinstance(self.min_hf, float) else self.min_hf
        high = self.max_hf * hosts if isinstance(self.max_hf, float) else self.max_hf
        if high < low:
            raise ValueError("max_hf gives fewer hosts than min_hf")
        return low, high


def count_logs(seq: DataFrame, ngram: int = 1) -> DataFrame:
    """(host, log, cnt). For n-grams above 1 every host also has the constant log `const` once."""
    counts = ngrams(seq, ngram).groupBy("host", "log").agg(F.count("*").alias("cnt"))
    if ngram == 1:
        return counts
    return counts.unionByName(seq.select("host").distinct().select("host", F.lit(CONST).alias("log"), F.lit(1).cast("long").alias("cnt")))


def log_totals(counts: DataFrame) -> DataFrame:
    """(log, hf, total): hosts that have the log, and its count over all hosts."""
    return counts.groupBy("log").agg(F.count("*").alias("hf"), F.sum("cnt").alias("total"))


def prune(counts: DataFrame, hosts: int, spec: CountSpec) -> tuple[DataFrame, DataFrame]:
    """(kept, unused) logs with hf and total. The top `max_features` go by total, then by log."""
    totals = log_totals(counts)
    if spec.logs is not None:
        fixed = counts.sparkSession.createDataFrame([(x,) for x in spec.logs], "log string")
        return fixed.join(totals, "log", "left").na.fill(0, ["hf", "total"]), totals.join(fixed, "log", "left_anti")
    low, high = spec.bounds(hosts)
    inside = F.col("hf").between(F.lit(low), F.lit(high))
    kept = totals.where(inside)
    if spec.max_features is not None:
        kept = kept.orderBy(F.desc("total"), "log").limit(spec.max_features)
    return kept, totals.join(kept.select("log"), "log", "left_anti")


def vocabulary(logs: DataFrame) -> DataFrame:
    """(log, idx): numbers from 0 in the order of the logs."""
    return number_rows(logs.select("log"), "log")


def weights(counts: DataFrame, hosts: int, norm: str | None = "l2", use_ihf: bool = True, smooth: bool = True, lf_type: str = "natural") -> DataFrame:
    """(host, log, value): log frequency times inverse host frequency, normalised per host.

    lf_type is natural, log (1 + ln), bool, or pct (share of the host's count; 0 for a host without
    any). ihf = ln((n + s) / (hf + s)) + 1 with s = 1 if smooth.
    """
    if norm not in ("l1", "l2", None) or lf_type not in ("natural", "log", "bool", "pct"):
        raise ValueError("unknown norm or lf_type")
    cnt = F.col("cnt").cast("double")
    if lf_type == "pct":
        rows = counts.groupBy("host").agg(F.sum(cnt).alias("row"))
        out = counts.join(rows, "host").withColumn("lf", F.when(F.col("row") > 0, cnt / F.col("row")).otherwise(0.0))
    else:
        out = counts.withColumn("lf", {"natural": cnt, "log": F.when(cnt > 0, 1 + F.log(cnt)).otherwise(0.0), "bool": F.when(cnt > 0, 1.0).otherwise(0.0)}[lf_type])
    if use_ihf:
        s = 1.0 if smooth else 0.0
        hf = counts.where("cnt > 0").groupBy("log").agg((F.log(F.lit(hosts + s) / (F.count("*") + F.lit(s))) + 1).alias("ihf"))
        out = skew_join(out, hf, ["log"]).withColumn("w", F.col("lf") * F.col("ihf"))
    else:
        out = out.withColumn("w", F.col("lf"))
    return _normalised(out, norm).select("host", "log", "value")


def _normalised(weighted: DataFrame, norm: str | None) -> DataFrame:
    """`weighted` with `value`, w over the size of the host's row. Sizes are merged before the
    shuffle and joined back, so a host with very many logs is not one task."""
    if norm is None:
        return weighted.withColumn("value", F.col("w"))
    size = F.sqrt(F.sum(F.col("w") * F.col("w"))) if norm == "l2" else F.sum(F.abs("w"))
    sizes = weighted.groupBy("host").agg(size.alias("size"))
    return skew_join(weighted, sizes, ["host"]).withColumn("value", F.when(F.col("size") > 0, F.col("w") / F.col("size")).otherwise(0.0))


class LogVectorizer:
    """Counts with a learned or fixed vocabulary; with `weighted`, inverse-host-frequency weights.

    fit learns the vocabulary (and the weights) and stages them; transform uses them on other hosts,
    ignoring logs it does not know. Works on (host, pos, log).
    """

    def __init__(self, spec: CountSpec = CountSpec(), weighted: bool = False, norm: str | None = "l2", smooth: bool = True, lf_type: str = "natural"):
        self.spec, self.weighted, self.norm, self.smooth, self.lf_type = spec, weighted, norm, smooth, lf_type
        self.logs_: DataFrame | None = None
        self.unused_logs_: DataFrame | None = None
        self.ihf_: DataFrame | None = None

    def fit(self, seq: DataFrame) -> LogVectorizer:
        counts = stage(count_logs(seq, self.spec.ngram), "counts")
        hosts = seq.select("host").distinct().count()
        kept, unused = prune(counts, hosts, self.spec)
        self.logs_, self.unused_logs_ = vocabulary(kept), stage(unused, "unused-logs")
        if not self.logs_.take(1):
            raise ValueError("no log is left; widen min_hf and max_hf")
        s = 1.0 if self.smooth else 0.0
        hf = counts.groupBy("log").agg(F.count("*").alias("hf"))
        self.ihf_ = stage(self.logs_.join(hf, "log", "left").select("log", (F.log(F.lit(hosts + s) / (F.coalesce("hf", F.lit(0)) + F.lit(s))) + 1).alias("ihf")), "ihf")
        return self

    def transform(self, seq: DataFrame) -> DataFrame:
        """(host, idx, log, value) of known logs; hosts without any have no row."""
        if self.logs_ is None:
            raise ValueError("fit first")
        counts = count_logs(seq, self.spec.ngram).join(self.logs_, "log")
        if not self.weighted:
            return counts.select("host", "idx", "log", F.col("cnt").alias("value"))
        lf = weights(counts.select("host", "log", "cnt"), 1, None, False, self.smooth, self.lf_type)
        w = lf.join(self.ihf_, "log").withColumn("w", F.col("value") * F.col("ihf"))
        return _normalised(w.select("host", "log", "w"), self.norm).join(self.logs_, "log").select("host", "idx", "log", "value")

    def fit_transform(self, seq: DataFrame) -> DataFrame:
        return self.fit(seq).transform(seq)


@dataclass
class SequenceEncoder:
    """Sequences to left-padded codes or one-hot rows. Codes are 0.. in the order of the items."""

    embedding_len: int | None = None
    sequence_len: int | None = None
    include_constant: bool = False
    codes_: DataFrame | None = None
    width_: int = 0
    length_: int = 0

    def fit(self, seq: DataFrame) -> SequenceEncoder:
        self.codes_ = number_rows(seq.select(F.col("log").alias("item")).distinct(), "item", name="code")
        items = self.codes_.count()
        longest = seq.agg(F.max("pos")).first()[0] or 0
        if self.embedding_len is not None and self.embedding_len < items:
            raise ValueError("embedding_len is too small")
        if self.sequence_len is not None and self.sequence_len < longest:
            raise ValueError("sequence_len is too small")
        self.width_ = (self.embedding_len or items) + int(self.include_constant)
        self.length_ = self.sequence_len or longest
        return self

    def transform(self, seq: DataFrame) -> DataFrame:
        """(host, codes array<int>): left-padded with 0 to sequence_len; raises on unknown items and
        on longer sequences. One row is one host's whole sequence."""
        if self.codes_ is None:
            raise ValueError("fit first")
        known = seq.join(self.codes_, seq["log"] == self.codes_["item"], "left").withColumn(
            "code", F.coalesce(F.col("code").cast("int"), F.raise_error(F.lit("unknown item")).cast("int"))
        )
        codes = F.transform(F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda x: x["code"])
        size = F.lit(self.length_) - F.size("codes")
        padded = F.concat(F.array_repeat(F.lit(0), size), F.col("codes"))
        return known.groupBy("host").agg(codes.alias("codes")).select("host", F.when(size >= 0, padded).otherwise(F.raise_error(F.lit("sequence too long")).cast("array<int>")).alias("codes"), size.alias("padding"))

    def one_hot(self, seq: DataFrame) -> DataFrame:
        """(host, rows array<array<tinyint>>): one-hot rows, zero rows as padding, the constant last."""
        width = self.width_ - int(self.include_constant)
        end = F.array(F.lit(1).cast("tinyint")) if self.include_constant else F.array().cast("array<tinyint>")

        def row(code: Any, i: Any):
            hot = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda e: ((e == code) & (i >= F.col("padding"))).cast("tinyint"))
            return F.concat(hot, end)

        return self.transform(seq).select("host", F.transform("codes", row).alias("rows"))
