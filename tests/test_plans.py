"""Physical-plan properties the design relies on."""

from ledgerlint.operators import weekly as W
from ledgerlint.operators.audit import audit
from ledgerlint.plans.queries import queries
from ledgerlint.schema import VIEW_COLUMNS as VC
from ledgerlint.schema import VIEW_RULES as VR
from ledgerlint.sources.tables import ROW_ID_COLUMNS, retail_text_view, retail_view, view_price_master
from tests.conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_reads_only_needed_columns(spark):
    plan = _plan(queries()["missing_report"](spark, SF_SMALL))
    scans = [line for line in plan.split("\n") if "lineitem.parquet" in line]
    assert scans and all("l_extendedprice" not in s and "l_tax" not in s for s in scans)


def test_price_master_is_broadcast(spark):
    out = audit(retail_text_view(spark, SF_SMALL), view_price_master(spark, SF_SMALL), VC, VR,
                order_cols=list(ROW_ID_COLUMNS))
    plan = _plan(out)
    # the grouped master (collect_list per item) is the broadcast side
    assert "BroadcastHashJoin" in plan
    assert any("BroadcastExchange" in line for line in plan.split("\n"))


def test_weekly_has_no_expand(spark):
    wk = W.weekly_aggregates(retail_view(spark, SF_SMALL), VC, checkpoint=False, persist_input=False)
    assert "Expand" not in _plan(wk)


def test_distinct_counts_has_no_expand(spark):
    assert "Expand" not in _plan(queries()["distinct_counts"](spark, SF_SMALL))


def test_uniqueness_aggregates_before_joining(spark):
    plan = _plan(queries()["row_uniqueness"](spark, SF_SMALL))
    assert "Window" not in plan
    assert "partial_min" in plan or "Aggregate" in plan
