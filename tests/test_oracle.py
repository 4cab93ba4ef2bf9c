"""Every kind of query against its SQL on the smallest tables; tests/oracle.py runs all of them."""

import pytest

import __spark_entry__ as entry
from oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
CHECKED = [
    "r019_low_bidders_for_cpv", "r024_close_to_winner", "r025_low_win_rate", "r052_small_then_large", "r057_bid_rotation",
    "rule_quick_scan", "rule_summary", "agg_buyer_portrait", "agg_pair_portrait", "agg_global_quantile", "stat_bid_ks",
    "stat_benford_test", "net_cobid_edges", "net_clustering", "net_components", "net_rings", "ens_lof_rank", "eda_summary", "src_year_tag", "sc_first_digit", "sc_string_fmt",
    "profile_validate", "rule_catalog", "rule_explain", "net_degree", "net_buyer_supplier_edges", "net_collusion_edges",
    "agg_supplier_portrait", "agg_bid_stats", "ml_iforest", "ml_detect_tenders", "ml_detect_suppliers", "ml_detect_pairs", "ml_detect_pairs_iforest",
    "ml_feature_importances", "net_betweenness", "join_outer_methods", "ens_combine", "ens_summary", "ens_explanations", "ens_if_vote", "ens_lof_rank",
    "rep_critical_export", "rep_cross_method", "rep_high_consensus", "rep_algo_sets", "rep_algo_comparison", "val_detection_matrix",
]


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, con, name):
    verdict, _, _ = compare(spark, con, name, QUERIES[name], ORACLES[name], FOLDER)
    assert verdict == "ok"


def test_registry_is_consistent():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) > 200
