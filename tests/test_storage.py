from quietlake.storage import lookup, partitions_for, spread


def test_tasks_by_size(spark, tmp_path):
    spark.range(100_000).selectExpr("id", "sha2(cast(id as string), 256) as s").coalesce(1).write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    assert partitions_for(stored, 1 << 20) >= 4 and partitions_for(stored, 1 << 40) == 4 and partitions_for(stored, 1024, 50) == 50
    assert partitions_for(spark.createDataFrame([(1,)], "a int").repartition(2).persist(), 1024) == 4
    assert spread(stored).rdd.getNumPartitions() == 4 and spread(stored).count() == 100_000


def test_lookup_of_a_hot_key(spark):
    rows = spark.range(9000).selectExpr("if(id % 3 = 0, 0, id) as k", "id")
    values = spark.range(0, 9000, 2).selectExpr("id as k", "id * 10 as v")
    got = {(r["k"], r["id"], r["v"]) for r in lookup(rows, values, "k", hot=2, least=10).collect()}
    assert got == {(k, i, 10 * k) for i in range(9000) for k in [0 if i % 3 == 0 else i] if k % 2 == 0}
