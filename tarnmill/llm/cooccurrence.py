"""Items that appear together: pair counts and association scores by large-basket blocking.

Items below the support that a pair must reach are left out first (a pair is never more frequent
than its items). A basket of at most `chunk` items gives its pairs in one row. A larger one is cut
into chunks of about `chunk` items by a hash of the item; each pair of chunks is a unit of work of
its own, spread over tasks, so no task ever holds all pairs of a huge basket. Pairs of both kinds
are counted together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import skew_join
from ..staging import shuffle_partitions, stage


def plain_item(item: Column) -> Column:
    return F.lower(F.trim(item))


def baskets(rows: DataFrame) -> DataFrame:
    """Distinct (txn, item) with plain items; rows with a null txn or a null or blank item are left out."""
    return rows.select("txn", plain_item(F.col("item")).alias("item")).where(F.col("txn").isNotNull() & (F.col("item") != "")).distinct()


def pair_counts(items: DataFrame, min_count: int = 1, chunk: int = 64) -> DataFrame:
    """(item_a, item_b, n_a, n_b, n_ab), item_a < item_b, with n_ab >= min_count.

    `items` is distinct (txn, item), staged, as it is read for the item counts and for the baskets.
    """
    parts = shuffle_partitions(items.sparkSession)
    items = items.select("txn", "item").where("txn is not null and item is not null")
    support = stage(items.groupBy("item").agg(F.count("*").alias("n")).where(F.col("n") >= min_count), "item-support")
    # An item in very many baskets, and a basket of very many items, are spread.
    kept = stage(skew_join(items, support.select("item"), ["item"], "left_semi"), "frequent-items") if min_count > 1 else items
    sizes = kept.groupBy("txn").agg(F.count("*").alias("size"))
    sized = skew_join(kept, sizes, ["txn"]).withColumn("chunks", F.ceil(F.col("size") / chunk).cast("int"))
    ordinary = sized.where("chunks = 1").groupBy("txn").agg(F.array_sort(F.collect_list("item")).alias("items"))
    pairs_in = F.flatten(
        F.transform("items", lambda a, i: F.transform(F.slice("items", i + 2, F.size("items")), lambda b: F.struct(a.alias("item_a"), b.alias("item_b"))))
    )
    small = ordinary.select(F.explode(pairs_in).alias("p")).select("p.*")
    # Each item of a huge basket goes to the chunk pairs that its chunk is part of.
    c = F.pmod(F.xxhash64("item"), F.col("chunks")).cast("int")
    blocks = (
        sized.where("chunks > 1")
        .withColumn("c", c)
        .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("txn", F.least("c", "o").alias("c1"), F.greatest("c", "o").alias("c2"), "item", F.col("c").alias("of"))
        .repartition(parts, "txn", "c1", "c2")
        .groupBy("txn", "c1", "c2")
        .agg(
            F.collect_list(F.when(F.col("of") == F.col("c1"), F.col("item"))).alias("left"),
            F.collect_list(F.when((F.col("of") == F.col("c2")), F.col("item"))).alias("right"),
        )
    )
    large = (
        blocks.select("c1", "c2", F.explode("left").alias("a"), "right")
        .select("c1", "c2", "a", F.explode("right").alias("b"))
        .where((F.col("c1") != F.col("c2")) | (F.col("a") < F.col("b")))
        .select(F.least("a", "b").alias("item_a"), F.greatest("a", "b").alias("item_b"))
    )
    counted = stage(small.unionByName(large).groupBy("item_a", "item_b").agg(F.count("*").alias("n_ab")).where(F.col("n_ab") >= min_count), "pair-counts")
    rows = counted.count()
    with_a = skew_join(counted, support.select(F.col("item").alias("item_a"), F.col("n").alias("n_a")), ["item_a"], "inner", rows)
    return skew_join(with_a, support.select(F.col("item").alias("item_b"), F.col("n").alias("n_b")), ["item_b"], "inner", rows).select("item_a", "item_b", "n_a", "n_b", "n_ab")


def association(pairs: DataFrame, n: int) -> DataFrame:
    """Adds lift, pointwise mutual information (log 2, and normalised) and Jaccard similarity.

    A pair in every basket has a normalised information of 1.
    """
    ab = F.col("n_ab").cast("double")
    lift = ab * F.lit(float(n)) / (F.col("n_a").cast("double") * F.col("n_b").cast("double"))
    p = ab / F.lit(float(max(n, 1)))
    return (
        pairs.withColumn("n", F.lit(n).cast("long"))
        .withColumn("lift", lift)
        .withColumn("pmi", F.log2(lift))
        .withColumn("npmi", F.when(p >= 1, F.lit(1.0)).otherwise(F.log2(lift) / -F.log2(p)))
        .withColumn("jaccard", ab / (F.col("n_a") + F.col("n_b") - F.col("n_ab")).cast("double"))
    )
