"""Every query with SQL has the same rows in DuckDB."""

from __future__ import annotations

import pytest

import __spark_entry__

DATA = "/root/testdata/sf0.001"
SQL = __spark_entry__.oracle_sql()
#: One or two of each module: the others are their parts.
CHOSEN = "scan_states signal_jerk signal_ttc metric_samples requirement_results asof_current_state failure_intervals sensitivity_sweep threshold_sweep explanations evidence_confidence validation_rollup quality_annotations regression_gate regression_transitions lane_assoc polygon_distance signal_vru_crosswalk signal_red_stop_line signal_stop_sign_speed forecast_ensemble agent_scores change_counts comparison_gate bootstrap_ci paired_bootstrap_ci evidence point_in_polygon risk_evidence svg_projection tfrecord_scan scenario_scan scenario_json normalize_valid_states map_normalize manifest_duplicates external_invalid_modes external_identity risk_tags risk_counters".split()


@pytest.mark.parametrize("name", CHOSEN)
def test_same_rows(spark, duck, name):
    found = __spark_entry__.queries()[name](spark, DATA).toPandas()
    want = duck.sql(SQL[name]).to_df()
    columns = sorted(want.columns)
    assert columns == sorted(found.columns)
    both = [d[columns].astype(object).where(d[columns].notna(), None).astype(str).sort_values(columns).to_numpy().tolist() for d in (found, want)]
    assert both[0] == both[1]


def test_entry(spark):
    found = __spark_entry__.entry(spark)
    assert found.count() > 0 and "start_time_s" in found.columns
