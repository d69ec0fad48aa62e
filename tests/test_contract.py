import re
from pathlib import Path

import pytest

import __spark_entry__ as contract
from checks import oracle
from checks.compare import connect, difference
from conftest import SF
from wearline import catalog

ROWS_ONLY = {"train_gbt", "score_gbt", "model_metrics_gbt", "lead_time_gbt", "grouped_recurrence"}
SLOW = {"silver_stream", "risk_scores_stream", "health_current_stream", "serving_snapshot", "late_data_audit",
        "health_changes_stream", "work_orders_stream", "keyed_serving_stream", "sink_commits", "stream_progress", "stream_flow_rollup", "dq_rollup_stream", "score_consistency", "train_gbt", "score_gbt", "model_metrics_gbt"}


def test_every_query_has_sql_or_is_known_not_to():
    assert set(catalog.queries()) - set(contract.oracle_sql()) == ROWS_ONLY
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry_runs(spark):
    result = contract.entry(spark)
    assert result.count() > 0
    assert result.columns[:2] == ["station_id", "plant_id"]


@pytest.fixture(scope="session")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(set(oracle.statements()) - SLOW))
def test_query_equals_its_sql(spark, con, name):
    assert difference(contract.queries()[name](spark, SF), con, contract.oracle_sql()[name]) == ""


def test_library_holds_no_forbidden_calls():
    files = (p for p in (Path(__file__).parent.parent / "wearline").rglob("*.py") if "llm" not in p.parts)
    text = "".join(p.read_text() for p in files)
    for call in ("localCheckpoint", ".toPandas(", ".collect()", ".limit(1000", "crossJoin", "TABLESAMPLE", ".rdd.map"):
        assert call not in text, call
    assert not re.search(r"broadcast\((?!targets)", text)  # only the at most k wanted ranks carry a hint


def test_streams_agree_with_their_sql(spark, con):
    for name in ("silver_stream", "risk_scores_stream", "health_current_stream", "serving_snapshot", "late_data_audit",
                 "health_changes_stream", "work_orders_stream", "keyed_serving_stream", "sink_commits", "stream_progress", "stream_flow_rollup",
                 "dq_rollup_stream"):
        assert difference(contract.queries()[name](spark, SF), con, contract.oracle_sql()[name]) == ""
