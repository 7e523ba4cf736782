"""Queries against their SQL on the small tables. The full set runs with oracle_check.py."""

import pytest
from oracle_check import compare, connect

import __spark_entry__ as entry

SQL = entry.oracle_sql()
RUN = entry.queries()

SAMPLE = [
    "A1_assemble_tasks", "A1_assemble_chained", "A3_core_metrics_levels", "A10_waste_total",
    "A13_leaderboard", "A39_recommend_routing", "A14_output_contract", "A20_tool_order",
    "A24_gap_report", "A26_two_proportion_p", "A29_detect_drift", "A31_fleiss_kappa",
    "A32_combine_panel", "C2_density_clusters", "K3_representatives", "W9_optimisation_result",
    "W11_grading_tick", "J4_price_longest", "J11_effective_policy", "P8_resolve_verdicts",
    "P14_grade_outputs", "P2_scan_metadata_only", "S2_validate_events", "S4_normalize",
    "S15_parse_market", "S16_bundle", "T3_stream_stalls", "T3_stream_silence", "T6_stream_tasks", "T7_stream_windows",
]
# Results that must not change when keys are cut into slices.
ORDERED = [
    "W1_chain_attempts", "W1_chain_with_shingles", "J2_link_attempts", "W3_golden_set",
    "W6_stratified_sample", "W8_budget_prefix", "W12_stall_verdicts", "W13_state_changes",
    "W14_normalise_turns", "T5_metered_caps",
]


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_operator_has_a_query():
    assert set(SQL) <= set(RUN)
    assert len(SQL) >= 130


@pytest.mark.parametrize("name", SAMPLE)
def test_query(spark, con, sf_dir, name):
    n, problem = compare(spark, con, sf_dir, RUN[name], SQL[name])
    assert problem is None and n > 0


@pytest.mark.parametrize("name", ORDERED)
def test_sliced(sliced, con, sf_dir, name):
    n, problem = compare(sliced, con, sf_dir, RUN[name], SQL[name])
    assert problem is None and n > 0
