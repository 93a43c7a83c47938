"""The registry's contract on the smallest tables: flagship, names, a sample of queries against their SQL."""
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))
import __spark_entry__ as entry_point  # noqa: E402
from check import compare  # noqa: E402

SF = "/root/testdata/sf0.001"
SAMPLE = ["late_flag", "peer_windows", "labelled_windows", "packet_encoding", "capture_decode", "block_decisions",
          "undersample", "classification_report", "roc_points", "novelty_score", "knn_classify_cells", "totals",
          "mitigation_summary", "stream_windows", "stream_block_decisions"]


def test_contract(spark):
    queries, sql = entry_point.queries(), entry_point.oracle_sql()
    assert set(sql) <= set(queries) and entry_point.FLAGSHIP in sql
    assert entry_point.entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, name):
    problems, _ = compare(entry_point.queries()[name](spark, SF), SF, entry_point.oracle_sql()[name])
    assert not problems, problems
