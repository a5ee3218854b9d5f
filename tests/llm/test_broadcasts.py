"""What the driver builds for broadcasts doesn't grow with the tables."""

from pyspark.sql import functions as F

from codeweft.llm import common, simhash


def test_staged_tables_broadcast_little(spark):
    name, seen = "spark.sql.autoBroadcastJoinThreshold", []

    class Watched:
        sparkSession, schema, write = spark, spark.range(3).schema, property(lambda self: self)

        def parquet(self, path):
            seen.append(int(spark.conf.get(name)))
            spark.range(3).write.parquet(path)

    before = spark.conf.get(name)
    assert common.staged(Watched(), "watched").count() == 3
    try:
        spark.conf.set(name, "-1")  # a lower one stays
        common.staged(Watched(), "watched")
    finally:
        spark.conf.set(name, before)
    assert seen == [common.MOST_BROADCAST, -1] and spark.conf.get(name) == before


def test_files_and_look_ups_are_not_broadcast(spark):
    fps = spark.range(2_000).select(F.xxhash64("id").alias("fp"))
    met = simhash.leaders(fps.select("fp", F.col("fp").alias("root")), simhash.segments(2_000), simhash.RADIUS)
    assert "BroadcastHashJoin" not in met._jdf.queryExecution().executedPlan().toString()


def test_rare_names_are_not_broadcast(spark):
    rows = spark.range(2_000).select("id", F.xxhash64("id").alias("key"))
    found = common.looked_up(rows, rows.select("key", F.col("id").alias("to"), F.lit(1).alias("n")), "key", "n")
    assert "SortMergeJoin" in found._jdf.queryExecution().executedPlan().toString() and found.where("id = to").count() == 2_000
