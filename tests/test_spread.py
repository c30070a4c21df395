"""Tables for costly work are dealt over the cores."""

from eviflow.plans.registry import PARTITIONS, TASKS_PER_CORE, Tables


def test_one_file_is_many_tasks(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    before = spark.conf.get(PARTITIONS, None)
    try:
        spark.conf.unset(PARTITIONS)
        dealt = Tables(spark, str(tmp_path)).spread("part")
        held = dealt.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    finally:
        if before is not None:
            spark.conf.set(PARTITIONS, before)
    assert sum(held) == 1000 and max(held) < 200
    assert len(held) >= TASKS_PER_CORE * spark.sparkContext.defaultParallelism
