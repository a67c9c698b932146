from tripscope.plans import metrics


def test_changed_input_gives_a_changed_answer(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.range(3).write.parquet(f"{path}/t.parquet")
    count = lambda: metrics.kept(spark, path, "rows", lambda: spark.read.parquet(f"{path}/t.parquet")).count()
    assert count() == 3 and count() == 3
    spark.range(5).write.mode("overwrite").parquet(f"{path}/t.parquet")
    spark.range(1).write.parquet(f"{path}/u.parquet")
    assert count() == 5
