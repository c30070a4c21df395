"""Streams are dealt over the cores as tables are; they have no splits that could be counted before a batch is there."""

import pytest

from eviflow.plans import name_queries, views
from eviflow.plans.registry import PARTITIONS, Tables


@pytest.fixture
def unset(spark):
    before = spark.conf.get(PARTITIONS, None)
    spark.conf.unset(PARTITIONS)
    yield
    if before is not None:
        spark.conf.set(PARTITIONS, before)


def streamed(spark, folder, name):
    """The tables of ``folder``, with table ``name`` read as a stream."""

    class Streamed(Tables):
        def __getattr__(self, table):
            read = self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet")
            return self.spark.readStream.schema(read.schema).parquet(f"{self.sf_dir}/{table}.parquet*") if table == name else read

    return Streamed(spark, str(folder))


def held(spark, stream, folder):
    """What a stream gives for the files that are there."""
    writer = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    return sorted(tuple(r) for r in spark.read.parquet(f"{folder}/out").collect())


def test_streamed_orders_are_dealt(spark, frame, unset, tmp_path):
    orders = "o_orderkey long, o_custkey long, o_totalprice double, o_orderpriority string, o_orderstatus string, o_orderdate timestamp"
    rows = [(k, k, 1000.0 * k, "1-URGENT", "O", None) for k in range(1, 8)]
    frame(orders, *rows).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    frame("l_orderkey long, l_extendedprice double", (1, 120000.5), (1, 3.0), (2, 7.0)).write.parquet(f"{tmp_path}/lineitem.parquet")
    columns = ["case_id", "declared", "attached", "revenue"]
    got = held(spark, views.money_figures(streamed(spark, tmp_path, "orders")).select(*columns), tmp_path / "got")
    assert got == sorted(tuple(r) for r in views.money_figures(Tables(spark, str(tmp_path))).select(*columns).collect())
    assert got[0] == (1, 1000, 120003, 3000) and len(got) == 7


def test_streamed_parts_are_dealt(spark, frame, unset, tmp_path):
    frame("p_partkey long, p_name string, p_size int", *[(k, f"one name {k}", 5 * k) for k in range(9)]).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    parties = name_queries._parties(streamed(spark, tmp_path, "part"))
    got = held(spark, parties.na.fill("none"), tmp_path / "got")
    assert [k for k, _, _ in got] == list(range(9)) and got[3][1] == "3 one"
