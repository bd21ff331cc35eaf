import pytest
from pyspark.sql import functions as F

from recordweave.session import FREE_SHUFFLES, PARTITIONS, run_dir, stage


def shuffle_files(spark):
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_a_written_stage_leaves_no_shuffle_files(spark):
    rows = spark.range(20_000).select("id", (F.col("id") % 500).alias("k"))
    sums = rows.groupBy("k").agg(F.sum("id").alias("s"), F.count("*").alias("n")).repartition(3, "s")
    before = shuffle_files(spark)
    sums.write.parquet(run_dir(spark, "kept"))
    assert shuffle_files(spark) - before  # a plain write keeps them until the driver collects garbage
    before = shuffle_files(spark)
    out = stage(sums, "freed")
    assert not shuffle_files(spark) - before
    assert out.count() == 500 and out.agg(F.sum("s")).first()[0] == sum(range(20_000))


@pytest.mark.parametrize("setting", [None, "false", "true"])
def test_the_session_keeps_its_own_setting(spark, setting):
    try:
        if setting is not None:
            spark.conf.set(FREE_SHUFFLES, setting)
        stage(spark.range(3), "three")
        assert spark.conf.get(FREE_SHUFFLES, None) == setting
        with pytest.raises(Exception):
            stage(spark.range(3).select(F.raise_error(F.lit("no"))), "none")
        assert spark.conf.get(FREE_SHUFFLES, None) == setting
    finally:
        spark.conf.unset(FREE_SHUFFLES)


def test_a_stage_is_cut_into_the_tasks_it_asks_for(spark):
    own, merge = spark.conf.get(PARTITIONS), "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(merge)
    part = F.spark_partition_id().alias("part")
    sums = spark.range(5_000).groupBy((F.col("id") % 1_000).alias("k")).count().select("k", part)
    try:
        spark.conf.set(merge, "false")
        assert stage(sums, "many", int(own) * 3).agg(F.count_distinct("part")).first()[0] == int(own) * 3
        assert stage(sums, "few", 1).agg(F.count_distinct("part")).first()[0] == int(own)
        with pytest.raises(Exception):
            stage(spark.range(3).select(F.raise_error(F.lit("no"))), "none", int(own) * 3)
        assert spark.conf.get(PARTITIONS) == own
    finally:
        spark.conf.set(merge, before)
