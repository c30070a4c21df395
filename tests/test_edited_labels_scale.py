"""The label sheet is made once, and tables as long as it are merged."""

from eviflow.plans import curate_queries, registry
from eviflow.plans import views as v

SF_DIR = "/root/testdata/sf0.001"


def test_label_sheet_is_made_once(spark, monkeypatch):
    calls, plain = [], v.lines
    monkeypatch.setattr(v, "lines", lambda t: calls.append(1) or plain(t))
    curate_queries.edited_labels(registry.Tables(spark, SF_DIR)).count()
    assert len(calls) == 1
