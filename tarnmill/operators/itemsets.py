"""Frequent item sets, level by level."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import stage
from .indexing import number_rows
from .skew import skew_join


#: Items of a basket that are paired within one row.
CHUNK = 64


def _plain(baskets: DataFrame) -> DataFrame:
    return baskets.where("txn is not null and item is not null").select("txn", F.col("item").cast("string").alias("item")).distinct()


def _pair_support(rows: DataFrame) -> DataFrame:
    """(items of two, support). A basket's items are cut into chunks by hash; each pair of chunks is a
    unit of work, so a huge basket is spread, and pairs are counted before any shuffle of them."""
    sized = skew_join(rows, rows.groupBy("txn").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")), ["txn"])
    mine = F.pmod(F.xxhash64("item"), F.col("chunks")).cast("int")
    placed = sized.withColumn("c", mine).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    blocks = placed.groupBy("txn", F.least("c", "o").alias("c1"), F.greatest("c", "o").alias("c2")).agg(
        F.collect_list(F.when(F.col("c") == F.least("c", "o"), F.col("item"))).alias("one"), F.collect_list(F.when(F.col("c") == F.greatest("c", "o"), F.col("item"))).alias("two")
    )
    pairs = blocks.select("c1", "c2", F.explode("one").alias("a"), "two").select("c1", "c2", "a", F.explode("two").alias("b")).where((F.col("c1") != F.col("c2")) | (F.col("a") < F.col("b")))
    return pairs.groupBy(F.array_sort(F.array("a", "b")).alias("items")).agg(F.count("*").alias("support"))


def _candidates(kept: DataFrame, size: int) -> DataFrame:
    """(items, prefix, item) of size + 1 items, all of whose subsets of `size` items are in `kept`: two
    kept sets that differ in their last item only are joined, then the other subsets are looked up."""
    start = F.slice("items", 1, size - 1)
    first = kept.select(start.alias("start"), F.element_at("items", -1).alias("x"), F.col("items").alias("prefix"))
    grown = first.join(kept.select(start.alias("start"), F.element_at("items", -1).alias("item")), "start").where("x < item")
    grown = grown.select(F.concat("prefix", F.array("item")).alias("items"), "prefix", "item")
    every = F.transform(F.sequence(F.lit(1), F.lit(size + 1)), lambda i: F.concat(F.slice("items", 1, i - 1), F.slice("items", i + 1, F.lit(size + 1))))
    found = grown.select(F.col("items").alias("whole"), F.explode(every).alias("items")).join(kept.select("items"), "items").groupBy("whole").agg(F.count("*").alias("n"))
    return grown.join(found.where(F.col("n") == size + 1).select(F.col("whole").alias("items")), "items", "left_semi")


def frequent_itemsets(baskets: DataFrame, max_size: int = 5, min_size: int = 2, threshold: float = 0.25) -> DataFrame:
    """(items array<string> sorted, size, support) of the sets in at least floor(n * threshold), and
    at least one, of the n baskets. `baskets` is (txn, item), repeats allowed.

    Pairs are counted in blocks of items. Sets of size k + 1 are made of frequent sets of size k, and
    left out if any subset isn't frequent, before a basket is looked at; baskets then carry candidates
    only. A level without frequent sets ends the search.
    """
    if min_size < 2 or max_size < 2:
        raise ValueError("set sizes start at 2")
    rows = stage(_plain(baskets), "baskets")
    least = max(1, int(rows.select("txn").distinct().count() * threshold))
    single = rows.groupBy("item").agg(F.count("*").alias("support")).where(F.col("support") >= least).select("item")
    rows = stage(skew_join(rows, single, ["item"], "left_semi"), "frequent-items")
    frequent = lambda sets: stage(sets.where(F.col("support") >= least), "itemsets")
    kept, levels, holds = frequent(_pair_support(rows)), [], None
    for size in range(2, max_size + 1):
        if not kept.take(1):
            break
        if size >= min_size:
            levels.append(kept.select("items", F.lit(size).alias("size"), "support"))
        if size == max_size:
            break
        if holds is None:  # the baskets of each frequent pair, by its first item, then by its second
            with_first = stage(skew_join(rows, kept.select(F.col("items")[0].alias("item"), "items"), ["item"]).select("txn", F.col("items")[1].alias("item"), "items"), "held-sets")
            holds = stage(with_first.join(rows, ["txn", "item"]).select("txn", F.col("items").alias("prefix")), "held-sets")
        grown = skew_join(holds, stage(_candidates(kept, size), "candidates"), ["prefix"]).join(rows, ["txn", "item"])
        grown = stage(grown.select("txn", "items"), "held-sets")
        kept = frequent(grown.groupBy("items").agg(F.count("*").alias("support")))
        holds = stage(grown.join(kept.select("items"), "items", "left_semi").select("txn", F.col("items").alias("prefix")), "held-sets")
    if not levels:
        return baskets.sparkSession.createDataFrame([], "items array<string>, size int, support bigint")
    return reduce(DataFrame.unionByName, levels)


class ItemsetEncoder:
    """Frequent item sets learned from one table of baskets, and looked up in others."""

    def __init__(self, max_size: int = 5, min_size: int = 2, threshold: float = 0.25):
        self.max_size, self.min_size, self.threshold = max_size, min_size, threshold
        self.sets_: DataFrame | None = None

    def fit(self, baskets: DataFrame) -> ItemsetEncoder:
        sets = frequent_itemsets(baskets, self.max_size, self.min_size, self.threshold).withColumn("itemset", F.concat_ws("|", "items"))
        self.sets_ = number_rows(sets, "size", "itemset")
        return self

    def mapping(self) -> DataFrame:
        """(idx, itemset): numbers from 0 by size, then by name."""
        if self.sets_ is None:
            raise ValueError("fit first")
        return self.sets_.select("idx", "itemset")

    def transform(self, baskets: DataFrame) -> DataFrame:
        """(txn, idx, itemset) of the learned sets that each basket holds."""
        names = self.mapping()
        return encode_itemsets(baskets, self.sets_).join(names, "itemset").select("txn", "idx", "itemset")

    def fit_transform(self, baskets: DataFrame) -> DataFrame:
        return self.fit(baskets).transform(baskets)


def encode_itemsets(baskets: DataFrame, sets: DataFrame) -> DataFrame:
    """(txn, itemset): the item sets that each basket holds, as items joined by a vertical bar.

    Relational division: a basket holds a set if it has as many of its items as the set has.
    """
    parts = sets.select(F.concat_ws("|", "items").alias("itemset"), F.size("items").alias("size"), F.explode("items").alias("item"))
    rows = _plain(baskets)
    return rows.join(parts, "item").groupBy("txn", "itemset", "size").agg(F.count("*").alias("n")).where("n = size").select("txn", "itemset")
