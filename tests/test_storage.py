from sourcemine.storage import drop_scratch, materialize, new_scratch_path, partition_count, scratch_dir, spread


def test_scratch_follows_the_session_setting(spark):
    assert scratch_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert new_scratch_path(spark, "x").startswith(scratch_dir(spark))


def test_materialize_reads_back_the_same_rows(spark):
    df = spark.range(100).selectExpr("id", "array(named_struct('a', id)) as v")
    again = materialize(df, "t")
    assert again.schema["v"].dataType.simpleString() == "array<struct<a:bigint>>"
    assert sorted(again.collect()) == sorted(df.collect())


def test_spread_splits_narrow_inputs_only(spark):
    cores = spark.sparkContext.defaultParallelism
    assert spread(spark.range(0, 100, 1, 1), "id").rdd.getNumPartitions() == cores
    wide = spark.range(0, 100, 1, cores + 3)
    assert spread(wide, "id") is wide


def test_counting_partitions_runs_no_shuffle(spark, tmp_path):
    log = str(tmp_path)

    def leave_a_trace(batches):
        import os
        import uuid

        open(os.path.join(log, uuid.uuid4().hex), "w").close()
        yield from batches

    df = spark.range(100).mapInArrow(leave_a_trace, "id long").repartition(3, "id").distinct()
    assert partition_count(df.repartition(5, "id")) == 5
    assert spread(df, "id") is not None
    assert list(tmp_path.iterdir()) == []
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"


def test_tables_by_value_keep_all_rows(spark):
    df = spark.range(50).selectExpr("id", "case when id % 3 = 0 then 'a' when id % 3 = 1 then 'b' end as kind")
    again = materialize(df, "t", by="kind")
    assert sorted(again.select("id", "kind").collect(), key=lambda r: r["id"]) == df.orderBy("id").collect()
    plan = again.filter("kind = 'a'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(kind" in plan


def test_dropping_scratch_removes_what_was_made(spark):
    import os

    kept = f"{scratch_dir(spark)}/other"
    spark.range(3).write.mode("overwrite").parquet(kept)
    path = new_scratch_path(spark, "t")
    spark.range(3).write.parquet(path)
    assert drop_scratch(spark) >= 1
    assert not os.path.exists(path) and os.path.exists(kept)
    assert drop_scratch(spark) == 0
