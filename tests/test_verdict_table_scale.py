"""The verdict table takes its changes from files, and a latest row is sent once."""

from conftest import rows

from eviflow.operators.common import latest_by_key
from eviflow.plans import registry, stream_queries

SF_DIR = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_verdict_table_takes_the_latest_lines_from_files(spark, monkeypatch):
    read = []
    plain = stream_queries.KeyedTable.merge
    monkeypatch.setattr(stream_queries.KeyedTable, "merge", lambda self, changes, *rest: read.append(plan_of(changes)) or plain(self, changes, *rest))
    stream_queries.verdict_table(registry.Tables(spark, SF_DIR))
    assert len(read) == 4 and not any("Exchange" in plan for plan in read)


def test_latest_row_is_sent_once_where_the_order_holds_it(frame):
    given = frame("k int, a int, b string", (1, 2, "x"), (1, 2, "y"), (1, None, "z"), (2, None, None), (None, 1, "q"), (None, 3, "p"))
    got = latest_by_key(given, ["k"], ["a", "b"])
    assert rows(got) == rows(frame("k int, a int, b string", (1, 2, "y"), (2, None, None), (None, 3, "p")))
    assert "max_by" not in plan_of(got)
