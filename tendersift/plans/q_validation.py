"""Validation queries. Scenarios are labels on rows of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tendersift.operators import validation as V
from tendersift.plans.ml_sql import BUYER_Z, PAIR_SQL, forest_sql, lof_sql, scaled_sql
from tendersift.plans.network_sql import NETWORKED
from tendersift.plans.q_ensemble import _models
from tendersift.plans.registry import query, rounded
from tendersift.plans.rules_sql import FLAGS, RULED
from tendersift.plans.screens_sql import SCREENED

# Scenarios, and the rules, screens and network signs that count for each.
RULES = {
    "1a_cartel_naive": ("bid_rotation", "cobidding_same_winner", "close_to_winner", "identical_bids", "low_win_rate"),
    "1b_cartel_sophisticated": ("bid_rotation", "cobidding_same_winner", "close_to_winner", "identical_bids", "low_win_rate"),
    "2_monopolist_buyer": ("single_bidder", "buyer_supplier_dominance", "single_bidder_low_discount", "no_enquiries", "high_limited_usage"),
    "3_weekend_price_manipulator": ("weekend_publication", "extreme_discount", "round_bid_prices"),
    "4_contract_splitter": ("threshold_manipulation", "contract_splitting", "multiple_near_threshold", "direct_awards_pattern",
                            "same_day_same_supplier", "high_limited_usage"),
    "5_exclusive_high_value": ("single_bidder", "single_bidder_low_discount", "buyer_supplier_dominance", "high_market_share",
                               "price_outlier", "value_zscore_outlier"),
    "6_gradual_capture": ("single_bidder", "single_bidder_low_discount", "buyer_supplier_dominance", "no_enquiries", "high_limited_usage"),
}
SCREENS = {
    "1a_cartel_naive": ("cv_anomaly", "bid_clustering", "bid_spread_anomaly", "ks_anomaly", "rdnor_anomaly", "skewness_anomaly",
                        "kurtosis_anomaly", "diffp_anomaly"),
    "1b_cartel_sophisticated": ("cv_anomaly", "bid_clustering", "bid_spread_anomaly", "ks_anomaly", "rdnor_anomaly", "skewness_anomaly",
                                "kurtosis_anomaly", "diffp_anomaly"),
    "2_monopolist_buyer": ("high_concentration", "monopoly"),
    "3_weekend_price_manipulator": ("zscore_discount", "iqr_discount", "round_price", "very_round_price"),
    "4_contract_splitter": ("high_concentration", "monopoly"),
    "5_exclusive_high_value": ("zscore_value", "zscore_value_cpv", "iqr_value_cpv", "high_concentration", "monopoly"),
    "6_gradual_capture": ("high_concentration", "monopoly"),
}
NETWORK = {
    "1a_cartel_naive": ("network_rotation", "network_suspicious_supplier"),
    "1b_cartel_sophisticated": ("network_rotation", "network_suspicious_supplier"),
    "2_monopolist_buyer": ("network_monopolistic",),
    "3_weekend_price_manipulator": (),
    "4_contract_splitter": ("network_monopolistic",),
    "5_exclusive_high_value": ("network_monopolistic",),
    "6_gradual_capture": ("network_monopolistic",),
}
#: Levels at which the outlier models are expected to find a scenario.
MODELS = {
    "1a_cartel_naive": ("pair",), "1b_cartel_sophisticated": ("pair",), "2_monopolist_buyer": ("buyer", "pair"), "3_weekend_price_manipulator": (),
    "4_contract_splitter": ("buyer", "pair"), "5_exclusive_high_value": ("buyer", "pair"), "6_gradual_capture": ("buyer", "pair"),
}
#: Given rows that look like a scenario; the first test that holds names a row.
_TESTS = {
    "4_contract_splitter": "procurement_method = 'limited' AND tender_value >= 40000 AND tender_value < 50000",
    "3_weekend_price_manipulator": "is_weekend = 1 AND price_change_pct > 40",
    "5_exclusive_high_value": "tender_value >= 10000000",
    "2_monopolist_buyer": "supplier_id BETWEEN 900000 AND 900002",
    "6_gradual_capture": "supplier_id = buyer_id + 200000",
    "1a_cartel_naive": "number_of_tenderers >= 4 AND supplier_id = buyer_id * 2",
    "1b_cartel_sophisticated": "number_of_tenderers >= 2 AND supplier_id = buyer_id * 2",
}
_CASE = "CASE " + " ".join(f"WHEN {t} THEN '{s}'" for s, t in _TESTS.items()) + " END"
_LAB = f", lab AS (SELECT * FROM (SELECT *, {_CASE} AS scenario FROM tenders) WHERE scenario IS NOT NULL)"


def _labelled(d):
    return d.tenders.withColumn("scenario", F.expr(_CASE)).where("scenario IS NOT NULL")


@query("val_inject", _LAB + """SELECT tender_id, buyer_id, 0 AS is_synthetic, CAST(NULL AS VARCHAR) AS scenario FROM tenders
UNION ALL SELECT tender_id + 1000000000, buyer_id, 1, scenario FROM lab""")
def _(d):
    copies = _labelled(d).withColumn("tender_id", F.col("tender_id") + 1_000_000_000).withColumn("only_here", F.lit(1))
    return V.inject(d.tenders, copies).select("tender_id", "buyer_id", "is_synthetic", "scenario")


@query("val_scenario_asserts", _LAB + """SELECT scenario, count(*) AS tenders, cast(sum(CASE WHEN award_value > tender_value * 1.01 THEN 1 ELSE 0 END) AS BIGINT) AS award_too_high,
round(avg(is_weekend), 6) AS weekend_share FROM lab GROUP BY 1""")
def _(d):
    return rounded(V.scenario_checks(_labelled(d)), weekend_share=6)


def _by_detector(name: str, cte: str, table: str, score: str, anomaly: str, results) -> None:
    @query(name, cte + _LAB + f"""SELECT lab.scenario, count(*) AS n, cast(sum({anomaly}) AS BIGINT) AS flagged, round(avg({anomaly}) * 100, 6) AS rate_pct, round(avg({score}), 6) AS mean_score
    FROM (SELECT tender_id, scenario FROM lab) lab JOIN {table} USING (tender_id) GROUP BY 1""")
    def _(d):
        return rounded(V.detection(results(d), _labelled(d), score, "a0"), rate_pct=6, mean_score=6)


_by_detector("val_detection_by_scenario", RULED, "ruled", "rule_risk_score", "cast(rule_risk_score >= 6 AS INT)",
             lambda d: d.ruled.withColumn("a0", (F.col("rule_risk_score") >= 6).cast("int")))
_by_detector("val_detection_by_scenario_stat", SCREENED, "screened", "stat_score", "stat_anomaly",
             lambda d: d.screened.withColumn("a0", F.col("stat_anomaly")))
_by_detector("val_detection_by_scenario_network", NETWORKED, "networked", "network_score", "network_anomaly",
             lambda d: d.networked.withColumn("a0", F.col("network_anomaly")))


@query("val_fired_flags", RULED + _LAB + f""", up AS (UNPIVOT (SELECT lab.scenario, {', '.join('flag_' + n for n in FLAGS)} FROM ruled JOIN (SELECT tender_id, scenario FROM lab) lab USING (tender_id))
ON {', '.join('flag_' + n for n in FLAGS)} INTO NAME flag VALUE v) SELECT scenario, flag, cast(sum(v) AS BIGINT) AS fired FROM up GROUP BY 1, 2 HAVING sum(v) > 0""")
def _(d):
    return V.fired_flags(d.ruled, _labelled(d), [c for c in d.ruled.columns if c.startswith("flag_")])


_FAMILIES = {"rule": ("flag_", RULES, "ruled"), "stat": ("stat_", SCREENS, "screened"), "network": ("", NETWORK, "net_0")}


def _share(family: str) -> str:
    """Share of a scenario's rows with a relevant sign; null where none is expected."""
    prefix, relevant, _ = _FAMILIES[family]
    hit = " ".join(f"WHEN '{s}' THEN greatest({', '.join(prefix + n for n in names)})" for s, names in relevant.items() if names)
    return f"round(avg(CASE scenario {hit} END) * 100, 1) AS {family}_pct"


def _columns(family: str) -> list[str]:
    prefix, relevant, _ = _FAMILIES[family]
    return sorted({prefix + n for names in relevant.values() for n in names})


_BY_BUYER = ", ".join(f"'{s}'" for s in ("1a_cartel_naive", "1b_cartel_sophisticated"))
_FOUND = ", found AS (" + " UNION ALL ".join(
    f"""SELECT scenario, '{algorithm}' AS algorithm, 'buyer' AS level, max(anomaly) AS hit FROM lab JOIN {table}_buyer USING (buyer_id) GROUP BY 1
UNION ALL SELECT scenario, '{algorithm}', 'pair', max(p.anomaly) FROM lab JOIN {table}_pair p ON p.buyer_id = lab.buyer_id AND (scenario IN ({_BY_BUYER}) OR p.supplier_id = lab.supplier_id) GROUP BY 1"""
    for algorithm, table in (("iforest", "if"), ("lof", "lof"))) + ")"


def _model(algorithm: str) -> str:
    """B:Y P:N where a model is expected to find the buyer and the pair, P:Y for the pair only, else null."""
    def seen(level: str) -> str:
        return (f"'{level[0].upper()}:' || CASE WHEN coalesce((SELECT max(hit) FROM found f WHERE f.scenario = p.scenario AND f.algorithm = '{algorithm}' "
                f"AND f.level = '{level}'), 0) = 1 THEN 'Y' ELSE 'N' END")
    cases = " ".join(f"WHEN '{s}' THEN {' || chr(32) || '.join(seen(x) for x in levels)}" for s, levels in MODELS.items() if levels)
    return f"CASE scenario {cases} END AS {algorithm}"


_PARTS = [*[f"{f}_pct" for f in _FAMILIES], "iforest", "lof"]
_MODELS_SQL = BUYER_Z + lof_sql("buyer") + forest_sql("buyer") + PAIR_SQL + scaled_sql("pair") + lof_sql("pair") + forest_sql("pair")


@query("val_detection_matrix", RULED + SCREENED + NETWORKED + _MODELS_SQL + _LAB + _FOUND + f""", per AS (SELECT scenario, count(*) AS n, {', '.join(_share(f) for f in _FAMILIES)}
FROM (SELECT tender_id, scenario FROM lab) lab """ + " ".join(f"JOIN (SELECT tender_id, {', '.join(_columns(f))} FROM {_FAMILIES[f][2]}) USING (tender_id)" for f in _FAMILIES) + f""" GROUP BY 1)
, matrix AS (SELECT *, {_model('iforest')}, {_model('lof')} FROM per p)
SELECT *, {' + '.join(f"coalesce(({c} > 0)::INT, 0)" for c in _PARTS[:3])} + coalesce((iforest LIKE '%Y%')::INT, 0) + coalesce((lof LIKE '%Y%')::INT, 0) AS detected,
{' + '.join(f"({c} IS NOT NULL)::INT" for c in _PARTS)} AS expected FROM matrix""")
def _(d):
    results = {"rule": d.ruled, "stat": d.screened, "network": d.networked}
    signals = {f: (results[f], {s: [prefix + n for n in names] for s, names in relevant.items()}) for f, (prefix, relevant, _) in _FAMILIES.items()}
    models = {key: df for key, df in _models(d).items() if key[0] != "supplier"}
    return V.detection_matrix(_labelled(d), signals, models, MODELS, ("1a_cartel_naive", "1b_cartel_sophisticated"))
