"""All statistical screens as one SQL statement."""

from tendersift.plans.rules_sql import level_sql

_EXPECTED = {1: 0.301, 2: 0.176, 3: 0.125, 4: 0.097, 5: 0.079, 6: 0.067, 7: 0.058, 8: 0.051, 9: 0.046}
DIGIT = "cast(left(cast(cast(floor({0}) AS BIGINT) AS VARCHAR), 1) AS INT)"


def chi2(digit: str = "digit") -> str:
    terms = [f"pow(avg(CASE WHEN {digit} = {d} THEN 1.0::DOUBLE ELSE 0 END) - {e}, 2) / {e}" for d, e in _EXPECTED.items()]
    return "count(*) * (" + " + ".join(terms) + ")"


SCORED = {
    "stat_zscore_value": "1", "stat_iqr_value": "1", "stat_zscore_value_cpv": "2", "stat_iqr_value_cpv": "2",
    "stat_zscore_discount": "1", "stat_iqr_discount": "1", "stat_99_ending": "0.5::DOUBLE", "stat_award_ratio_suspicious": "1",
    "stat_cv_anomaly": "2", "stat_diffp_anomaly": "2", "stat_rdnor_anomaly": "2", "stat_ks_anomaly": "1.5::DOUBLE",
    "stat_skewness_anomaly": "1", "stat_kurtosis_anomaly": "1", "stat_bid_spread_anomaly": "2", "stat_bid_clustering": "2",
    "stat_bid_spread_high": "1", "stat_high_concentration": "1", "stat_monopoly": "2",
}
_FAIR = "procurement_method IN ('open', 'selective') AND bid_count >= 3"
FLAGS = {
    "stat_zscore_value": "abs(tender_value - g.tm) / nullif(g.ts, 0) > 3",
    "stat_iqr_value": "g.t3 <> g.t1 AND (tender_value < g.t1 - 1.5 * (g.t3 - g.t1) OR tender_value > g.t3 + 1.5 * (g.t3 - g.t1))",
    "stat_zscore_discount": "abs(price_change_pct - g.pm) / nullif(g.ps, 0) > 3",
    "stat_iqr_discount": "g.p3 <> g.p1 AND (price_change_pct < g.p1 - 1.5 * (g.p3 - g.p1) OR price_change_pct > g.p3 + 1.5 * (g.p3 - g.p1))",
    "stat_round_price": "tender_value > 0 AND tender_value % 1000 = 0",
    "stat_very_round_price": "tender_value > 0 AND tender_value % 100000 = 0",
    "stat_99_ending": "tender_value > 0 AND cast(floor(tender_value) AS BIGINT) % 100 = 99",
    "stat_award_ratio_suspicious": "procurement_method IN ('open', 'selective') AND number_of_tenderers >= 3 AND award_value / nullif(tender_value, 0) > 0.99 AND award_value / nullif(tender_value, 0) <= 1.0",
    "stat_benford_buyer": "t.buyer_id IN (SELECT buyer_id FROM bfb WHERE n >= 30 AND chi > 15.51)",
    "stat_benford_supplier": "t.tender_id IN (SELECT tender_id FROM bids WHERE is_winner = 1 AND bidder_id IN (SELECT bidder_id FROM bfs WHERE n >= 30 AND chi > 15.51))",
    "stat_cv_anomaly": f"{_FAIR} AND bid_cv < 0.05",
    "stat_diffp_anomaly": f"{_FAIR} AND bid_diffp > 0.05",
    "stat_rdnor_anomaly": f"{_FAIR} AND bid_rdnor > 1.5",
    "stat_ks_anomaly": f"{_FAIR} AND bid_ks_stat > 0.3",
    "stat_skewness_anomaly": f"{_FAIR} AND abs(bid_skewness) > 0.5",
    "stat_kurtosis_anomaly": f"{_FAIR} AND bid_kurtosis > 2",
    "stat_bid_spread_anomaly": f"{_FAIR} AND bid_spread < 1.01",
    "stat_bid_clustering": f"{_FAIR} AND bid_cv < 0.01",
    "stat_bid_spread_high": f"{_FAIR} AND bid_spread > 10",
    "stat_high_concentration": "buyer_hhi > 0.5",
    "stat_monopoly": "buyer_hhi > 0.9",
}
CPV_FLAGS = {
    "stat_zscore_value_cpv": "abs(tender_value - cv.m) / nullif(cv.s, 0) > 3",
    "stat_iqr_value_cpv": "cv.q3 <> cv.q1 AND (tender_value < cv.q1 - 1.5 * (cv.q3 - cv.q1) OR tender_value > cv.q3 + 1.5 * (cv.q3 - cv.q1))",
}

BIDSTAT = """
, ob AS (SELECT tender_id, bid_amount AS x, row_number() OVER (PARTITION BY tender_id ORDER BY bid_amount, bid_id) AS i,
                count(*) OVER (PARTITION BY tender_id) AS n, min(bid_amount) OVER (PARTITION BY tender_id) AS lo,
                max(bid_amount) OVER (PARTITION BY tender_id) AS hi, avg(bid_amount) OVER (PARTITION BY tender_id) AS mu,
                stddev_pop(bid_amount) OVER (PARTITION BY tender_id) AS sd FROM bids WHERE bid_amount IS NOT NULL)
, bst AS (SELECT tender_id, max(n) AS bid_count, stddev_samp(x) / nullif(avg(x), 0) AS bid_cv, max(x) / nullif(min(x), 0) AS bid_spread,
   CASE WHEN max(n) >= 3 AND min(x) > 0 THEN (max(x) FILTER (i = 2) - min(x)) / min(x) END AS bid_diffp,
   CASE WHEN max(n) >= 3 AND max(x) > min(x) THEN (max(x) FILTER (i = 2) - min(x)) * (max(n) - 1) / (max(x) - min(x)) END AS bid_rdnor,
   CASE WHEN max(n) >= 3 AND max(x) > min(x) THEN max(greatest(i::DOUBLE / n - (x - lo) / nullif(hi - lo, 0), (x - lo) / nullif(hi - lo, 0) - (i - 1)::DOUBLE / n)) END AS bid_ks_stat,
   CASE WHEN max(n) >= 3 AND max(sd) / max(mu) > 0.001 THEN avg(pow((x - mu) / nullif(sd, 0), 3)) END AS bid_skewness,
   CASE WHEN max(n) >= 3 AND max(sd) / max(mu) > 0.001 THEN avg(pow((x - mu) / nullif(sd, 0), 4)) - 3 END AS bid_kurtosis
  FROM ob GROUP BY 1)
"""
BENFORD = f"""
, dig AS (SELECT tender_id, bidder_id, {DIGIT.format('bid_amount')} AS digit FROM bids WHERE bid_amount >= 1)
, bfb AS (SELECT buyer_id, count(*) AS n, {chi2()} AS chi FROM dig JOIN tenders USING (tender_id) GROUP BY 1)
, bfs AS (SELECT bidder_id, count(*) AS n, {chi2()} AS chi FROM dig GROUP BY 1)
"""
_VALUES = """
, g AS (SELECT avg(tender_value) AS tm, stddev_samp(tender_value) AS ts, quantile_cont(tender_value, 0.25) AS t1, quantile_cont(tender_value, 0.75) AS t3,
               avg(price_change_pct) AS pm, stddev_samp(price_change_pct) AS ps, quantile_cont(price_change_pct, 0.25) AS p1, quantile_cont(price_change_pct, 0.75) AS p3 FROM tenders)
, cv AS (SELECT main_cpv_2_digit AS cpv, avg(tender_value) AS m, stddev_samp(tender_value) AS s, quantile_cont(tender_value, 0.25) AS q1,
                quantile_cont(tender_value, 0.75) AS q3 FROM tenders WHERE main_cpv_2_digit IS NOT NULL GROUP BY 1)
, vs AS (SELECT buyer_id, supplier_id, sum(tender_value) AS v FROM tenders WHERE supplier_id IS NOT NULL GROUP BY 1, 2)
, bh AS (SELECT buyer_id, sum(v * v) / pow(sum(v), 2) AS buyer_hhi FROM vs GROUP BY 1)
"""
_ALL = {**FLAGS, **CPV_FLAGS}
_SCORE = " + ".join(f"{w} * coalesce({c}, 0)" for c, w in SCORED.items())
SCREENED = BIDSTAT + BENFORD + _VALUES + ", stat_0 AS (SELECT t.*, bst.* EXCLUDE (tender_id), bh.buyer_hhi, " + ", ".join(
    f"cast(coalesce(({c}), false) AS INT) AS {n}" for n, c in FLAGS.items()
) + ", " + ", ".join(
    f"CASE WHEN cv.cpv IS NOT NULL THEN cast(coalesce(({c}), false) AS INT) END AS {n}" for n, c in CPV_FLAGS.items()
) + """ FROM tenders t CROSS JOIN g LEFT JOIN cv ON t.main_cpv_2_digit = cv.cpv LEFT JOIN bst ON t.tender_id = bst.tender_id
LEFT JOIN bh ON t.buyer_id = bh.buyer_id)
, stat_1 AS (SELECT *, """ + f"cast({_SCORE} AS DOUBLE) AS stat_score, " + " + ".join(f"coalesce({c}, 0)" for c in SCORED) + """ AS stat_flags_count FROM stat_0)
, screened AS (SELECT *, """ + level_sql("stat_score", (-0.1, 1, 4, 8, 100)) + """ AS stat_risk_level,
cast(stat_score >= 4 AS INT) AS stat_anomaly FROM stat_1)
"""
