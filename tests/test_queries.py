"""Queries against their check SQL. TRACELAB_ALL=1 runs every query, otherwise some of each family."""

import os

import oracle
import pytest

from tracelab.plans import ORACLES, QUERIES

SOME = """
fc_assign fc_distribution fc_pattern al_correlations al_gates rp_threshold_sweep mc_validate mc_zone_by_category
mc_gated_step_reward sg_zero_signal sg_rescues_and_dead vd_case vd_pattern_v2 vd_filter_report vd_advantage_report
extract_answer_v5 extract_answer_train extract_rescore_legacy extract_extended_candidate normalize_answer verdict_remote
axis_verdicts score_relaxed_accuracy score_multichoice_match score_by_gold_type eval_rescore_diff pr_value_grounding
pr_anchored_grounding pr_qa_verify_reasons rw_multiplicative rw_vapv tr_quality_gates cl_jaccard cl_step_perception
ft_artifact_audit qa_core qa_type_quota qa_sci_panel tab_trim cp_contamination cp_distill_override src_jsonl_scan
sink_append_resume st_incremental_scoring
""".split()

NAMES = list(QUERIES) if os.environ.get("TRACELAB_ALL") else SOME


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf, con, name):
    rows = QUERIES[name](spark, sf)
    if name in ORACLES:
        assert oracle.compare(rows, con, ORACLES[name]) is None
    else:
        assert rows.count() > 0


def test_every_check_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark)
    assert rows.count() == 12
    assert set(entry.oracle_sql()) <= set(entry.queries())
