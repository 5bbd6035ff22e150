from pyspark.sql import functions as F

from leafwise.operators.scan import range_partitioned, row_index


def _skewed(spark):
    # one key holds three quarters of all rows
    return spark.range(0, 20000).select(
        F.when(F.col("id") < 15000, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("g"),
        F.col("id").alias("o"),
    )


def test_hot_group_is_cut_across_partitions(spark):
    ranged = range_partitioned(_skewed(spark), ["g", "o"], 8)
    parts = ranged.where("g = 'hot'").groupBy("_pid").count().collect()
    assert len(parts) >= 4
    assert max(r["count"] for r in parts) <= 15000 * 0.5


def test_row_index_exact_under_skew(spark):
    idx = row_index(_skewed(spark), ["g"], ["o"], name="i", num_partitions=8)
    hot = idx.where("g = 'hot'").select((F.col("i") == F.col("o")).alias("ok"), "i")
    assert hot.where(~F.col("ok")).count() == 0 and hot.count() == 15000
    small = idx.where("g = 'k7'").orderBy("o").select("i").collect()
    assert [r[0] for r in small] == list(range(len(small)))


def test_partition_sizing_helpers(spark):
    from leafwise.operators.scan import spread, target_partitions

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert target_partitions(docs) >= int(spark.conf.get("spark.sql.shuffle.partitions"))
    slots = spark.sparkContext.defaultParallelism
    assert docs.rdd.getNumPartitions() < slots
    assert spread(docs).rdd.getNumPartitions() == slots
    wide = docs.repartition(slots * 2)
    assert spread(wide) is wide            # enough splits: unchanged
