from pathlib import Path

from pyspark.sql import functions as F

from tarnmill import staging


def test_small_goes_by_counted_size(spark):
    df = spark.range(5)
    hinted = lambda d: "ResolvedHint" in d._jdf.queryExecution().analyzed().toString()
    assert hinted(staging.small(df, 5, 8)) and not hinted(staging.small(df, 1 << 30, 8))


def test_stage_and_clear(spark):
    df = staging.stage(spark.range(7).withColumn("x", F.array("id")), "t")
    path = Path(df._tarnmill_path.removeprefix("file://"))
    assert path.exists() and df.count() == 7 and df.schema["x"].dataType.simpleString() == "array<bigint>"
    staging.drop_staged(df)
    assert not path.exists()
    staging.drop_staged(spark.range(1))


def test_spread_leaves_shuffles_alone(spark):
    one = spark.range(100, numPartitions=1)
    assert staging.spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    grouped = spark.range(100, numPartitions=3).groupBy((F.col("id") % 7).alias("k")).count()
    assert staging.spread(grouped) is grouped
