"""All rules as one SQL statement, written independently of the Spark expressions."""

FLAGS = {
    "missing_documents": "number_of_documents = 0",
    "high_limited_usage": "lim_rate > 0.95",
    "no_enquiries": "procurement_method = 'open' AND has_enquiries = 0",
    "single_bidder": "is_single_bidder = 1 AND procurement_method IN ('open', 'selective')",
    "low_bidders_for_cpv": "number_of_tenderers > 0 AND number_of_tenderers < cpv_tm * 0.5",
    "buyer_supplier_dominance": "pair_n::DOUBLE / buyer_n > 0.5 AND pair_n >= 5",
    "high_market_share": "cs_v / cpv_total > 0.3",
    "market_concentration": "cpv_hhi > 0.25",
    "price_outlier": "abs(tender_value - cpv_mean) / nullif(cpv_std, 0) > 3",
    "wide_bid_disparity": "(bmax - bmin) / bmean > 1.0",
    "round_bid_prices": "round_rate > 0.8",
    "close_to_winner": "(b2 - b1) / nullif(b1, 0) >= 0 AND (b2 - b1) / nullif(b1, 0) < 0.01",
    "low_win_rate": "tender_id IN (SELECT tender_id FROM bids WHERE bidder_id IN (SELECT bidder_id FROM bids "
                    "GROUP BY bidder_id HAVING count(*) >= 10 AND sum(is_winner)::DOUBLE / count(*) < 0.05))",
    "identical_bids": "tender_id IN (SELECT tender_id FROM bids GROUP BY tender_id, bid_amount HAVING count(*) > 1)",
    "same_bid_order": "bid_n > 1 AND hours < 1 AND number_of_bids > 1",
    "cobidding_same_winner": "tender_id IN (SELECT d.tender_id FROM duels d JOIN fixed_pairs p ON d.lo = p.lo AND d.hi = p.hi)",
    "bid_rotation": "main_cpv_2_digit IN (SELECT cpv FROM rotating)",
    "extreme_discount": "price_change_pct > 50",
    "threshold_manipulation": "(tender_value >= 50000 * 0.95::DOUBLE AND tender_value < 50000) OR (tender_value >= 200000 * 0.95::DOUBLE AND tender_value < 200000) "
                              "OR (tender_value >= 1000000 * 0.95::DOUBLE AND tender_value < 1000000) OR (tender_value >= 5000000 * 0.95::DOUBLE AND tender_value < 5000000)",
    "contract_splitting": "day_cpv_n >= 3 AND day_cpv_mean >= 40000 AND day_cpv_mean < 50000",
    "value_zscore_outlier": "abs(tender_value - cpv_mean) / nullif(cpv_std, 0) > 3",
    "discretionary_criteria": "award_criteria IS DISTINCT FROM 'lowestCost' AND procurement_method = 'open'",
    "benford_violation": "bid_n >= 10 AND bf > 15.51",
    "bid_near_estimate": "procurement_method IN ('open', 'selective') AND award_value / nullif(tender_value, 0) >= 0.995",
    "all_except_winner_disqualified": "dq = bid_n - 1 AND bid_n > 1",
    "lowest_bid_disqualified": "low_status = 'disqualified'",
    "excessive_disqualifications": "dq::DOUBLE / bid_n > 0.5",
    "direct_awards_pattern": "near_n >= 5 AND tender_value >= 40000 AND tender_value < 50000",
    "small_then_large": "tender_id IN (SELECT s.tender_id FROM seq s JOIN growing g USING (buyer_id, supplier_id))",
    "multiple_near_threshold": "pair_near >= 3 AND tender_value >= 40000 AND tender_value < 50000",
    "award_contract_difference": "price_change_pct < -10",
    "heterogeneous_supplier": "sup_cpv > 10",
    "price_increase": "price_change_pct < 0",
    "weekend_publication": "is_weekend = 1",
    "q4_rush": "is_q4 = 1 AND tender_value > 2 * (SELECT median(tender_value) FROM tenders)",
    "december_rush": "is_december = 1 AND tender_value > 2 * (SELECT median(tender_value) FROM tenders)",
    "cross_region_single_bidder": "is_single_bidder = 1 AND is_cross_region = 1",
    "masked_data": "is_buyer_masked = 1 OR is_supplier_masked = 1",
    "award_issues": "has_unsuccessful_awards = 1 OR has_cancelled_awards = 1",
    "new_supplier_large_contract": "sup_n <= 2 AND tender_value > (SELECT quantile_cont(tender_value, 0.9) FROM tenders)",
    "captive_supplier": "sup_buyers = 1 AND sup_n >= 5",
    "single_bidder_low_discount": "is_single_bidder = 1 AND coalesce(discount_percentage_avg, 0) < 2",
    "same_day_same_supplier": "day_sup_n >= 3",
    "high_value_limited": "procurement_method = 'limited' AND award_value >= 10000000 AND cast(supplier_id AS VARCHAR) IN ('88888888', '99999999', '00000000')",
}
# Same order as FLAGS.
WEIGHTS = {
    "missing_documents": 1, "high_limited_usage": 2, "no_enquiries": 1, "single_bidder": 2, "low_bidders_for_cpv": 1,
    "buyer_supplier_dominance": 2, "high_market_share": 1, "market_concentration": 1, "price_outlier": 2,
    "wide_bid_disparity": 1, "round_bid_prices": 1, "close_to_winner": 1, "low_win_rate": 1, "identical_bids": 3,
    "same_bid_order": 2, "cobidding_same_winner": 3, "bid_rotation": 3, "extreme_discount": 1,
    "threshold_manipulation": 2, "contract_splitting": 3, "value_zscore_outlier": 1, "discretionary_criteria": 1,
    "benford_violation": 1, "bid_near_estimate": 2, "all_except_winner_disqualified": 3, "lowest_bid_disqualified": 2,
    "excessive_disqualifications": 2, "direct_awards_pattern": 2, "small_then_large": 2, "multiple_near_threshold": 2,
    "award_contract_difference": 2, "heterogeneous_supplier": 1, "price_increase": 3, "weekend_publication": 1,
    "q4_rush": 1, "december_rush": 1, "cross_region_single_bidder": 2, "masked_data": 1, "award_issues": 1,
    "new_supplier_large_contract": 2, "captive_supplier": 2, "single_bidder_low_discount": 3,
    "same_day_same_supplier": 2, "high_value_limited": 3,
}

_BENFORD = {1: 0.301, 2: 0.176, 3: 0.125, 4: 0.097, 5: 0.079, 6: 0.067, 7: 0.058, 8: 0.051, 9: 0.046}
_BF = " + ".join(
    f"pow(avg(CASE WHEN left(cast(bid_amount AS VARCHAR), 1) = '{d}' THEN 1.0 ELSE 0.0 END) - {e}, 2) / {e}"
    for d, e in _BENFORD.items()
)

GRAINS = f"""
, cpv_s AS (SELECT main_cpv_2_digit AS cpv, avg(tender_value) AS cpv_mean, stddev_samp(tender_value) AS cpv_std,
                   median(number_of_tenderers) AS cpv_tm, sum(tender_value) AS cpv_total
            FROM tenders WHERE main_cpv_2_digit IS NOT NULL GROUP BY 1)
, cs AS (SELECT main_cpv_2_digit AS cpv, supplier_id, sum(tender_value) AS cs_v FROM tenders
         WHERE main_cpv_2_digit IS NOT NULL AND supplier_id IS NOT NULL GROUP BY 1, 2)
, mh AS (SELECT cpv, sum(pow(cs_v / cpv_total, 2)) AS cpv_hhi FROM cs JOIN cpv_s USING (cpv) GROUP BY 1)
, bs AS (SELECT buyer_id, count(*) AS buyer_n, avg(CASE WHEN procurement_method = 'limited' THEN 1.0 ELSE 0 END) AS lim_rate,
                sum(CASE WHEN procurement_method = 'limited' AND tender_value >= 40000 AND tender_value < 50000 THEN 1 ELSE 0 END) AS near_n
         FROM tenders GROUP BY 1)
, ss AS (SELECT supplier_id, count(*) AS sup_n, count(DISTINCT main_cpv_2_digit) AS sup_cpv, count(DISTINCT buyer_id) AS sup_buyers
         FROM tenders WHERE supplier_id IS NOT NULL GROUP BY 1)
, ps AS (SELECT buyer_id, supplier_id, count(*) AS pair_n,
                sum(CASE WHEN procurement_method = 'limited' AND tender_value >= 40000 AND tender_value < 50000 THEN 1 ELSE 0 END) AS pair_near
         FROM tenders WHERE supplier_id IS NOT NULL GROUP BY 1, 2)
, dc AS (SELECT buyer_id, main_cpv_2_digit AS cpv, cast(published_date AS DATE) AS d, count(*) AS day_cpv_n, avg(tender_value) AS day_cpv_mean
         FROM tenders WHERE main_cpv_2_digit IS NOT NULL GROUP BY 1, 2, 3)
, ds AS (SELECT buyer_id, supplier_id, cast(published_date AS DATE) AS d, count(*) AS day_sup_n
         FROM tenders WHERE supplier_id IS NOT NULL GROUP BY 1, 2, 3)
, ranked_bids AS (SELECT *, row_number() OVER (PARTITION BY tender_id ORDER BY bid_amount, bid_id) AS pos FROM bids)
, tb AS (SELECT tender_id, count(*) AS bid_n, min(bid_amount) AS bmin, max(bid_amount) AS bmax, avg(bid_amount) AS bmean,
                max(CASE WHEN pos = 1 THEN bid_amount END) AS b1, max(CASE WHEN pos = 2 THEN bid_amount END) AS b2,
                max(CASE WHEN pos = 1 THEN bid_status END) AS low_status,
                sum(CASE WHEN bid_status = 'disqualified' THEN 1 ELSE 0 END) AS dq,
                avg(CASE WHEN bid_amount % 1000 = 0 THEN 1.0 ELSE 0.0 END) AS round_rate,
                (epoch(max(bid_date)) - epoch(min(bid_date))) / 3600.0 AS hours,
                {_BF} AS bf
         FROM ranked_bids GROUP BY 1)
, duels AS (SELECT tender_id, min(bidder_id) AS lo, max(bidder_id) AS hi, max(CASE WHEN is_winner = 1 THEN bidder_id END) AS won
            FROM bids GROUP BY 1 HAVING count(*) = 2)
, duel_wins AS (SELECT lo, hi, won, count(*) AS n FROM duels WHERE won IS NOT NULL GROUP BY 1, 2, 3)
, fixed_pairs AS (SELECT lo, hi FROM duel_wins GROUP BY 1, 2 HAVING sum(n) >= 5 AND max(n)::DOUBLE / sum(n) >= 0.8)
, seq AS (SELECT tender_id, buyer_id, supplier_id, tender_value,
                 row_number() OVER (PARTITION BY buyer_id, supplier_id ORDER BY published_date, tender_id) AS pos
          FROM tenders WHERE supplier_id IS NOT NULL)
, growing AS (SELECT buyer_id, supplier_id FROM seq GROUP BY 1, 2
              HAVING count(*) >= 3 AND max(CASE WHEN pos = 1 THEN tender_value END) > 0
                 AND max(CASE WHEN pos = 1 THEN tender_value END) < 0.2 * avg(CASE WHEN pos > 1 THEN tender_value END)
                 AND max(CASE WHEN pos > 1 THEN tender_value END) > 5 * max(CASE WHEN pos = 1 THEN tender_value END))
, wins AS (SELECT main_cpv_2_digit AS cpv, supplier_id,
                  row_number() OVER (PARTITION BY main_cpv_2_digit ORDER BY published_date, tender_id) AS pos,
                  lag(supplier_id) OVER (PARTITION BY main_cpv_2_digit ORDER BY published_date, tender_id) AS prev
           FROM tenders WHERE main_cpv_2_digit IS NOT NULL AND supplier_id IS NOT NULL)
, rotating AS (SELECT cpv FROM wins GROUP BY 1
               HAVING count(*) >= 10 AND count(DISTINCT CASE WHEN pos <= 20 THEN supplier_id END) BETWEEN 2 AND 3
                  AND sum(CASE WHEN prev <> supplier_id THEN 1 ELSE 0 END)::DOUBLE / (count(*) - 1) > 0.6)
, wide AS (
  SELECT t.*, cpv_s.*, cs.cs_v, mh.cpv_hhi, bs.buyer_n, bs.lim_rate, bs.near_n, ss.sup_n, ss.sup_cpv, ss.sup_buyers,
         ps.pair_n, ps.pair_near, dc.day_cpv_n, dc.day_cpv_mean, ds.day_sup_n, tb.bid_n, tb.bmin, tb.bmax, tb.bmean, tb.b1, tb.b2,
         tb.low_status, tb.dq, tb.round_rate, tb.hours, tb.bf
  FROM tenders t
  LEFT JOIN cpv_s ON t.main_cpv_2_digit = cpv_s.cpv
  LEFT JOIN cs ON t.main_cpv_2_digit = cs.cpv AND t.supplier_id = cs.supplier_id
  LEFT JOIN mh ON t.main_cpv_2_digit = mh.cpv
  LEFT JOIN bs ON t.buyer_id = bs.buyer_id
  LEFT JOIN ss ON t.supplier_id = ss.supplier_id
  LEFT JOIN ps ON t.buyer_id = ps.buyer_id AND t.supplier_id = ps.supplier_id
  LEFT JOIN dc ON t.buyer_id = dc.buyer_id AND t.main_cpv_2_digit = dc.cpv AND cast(t.published_date AS DATE) = dc.d
  LEFT JOIN ds ON t.buyer_id = ds.buyer_id AND t.supplier_id = ds.supplier_id AND cast(t.published_date AS DATE) = ds.d
  LEFT JOIN tb ON t.tender_id = tb.tender_id)
"""


def flag_sql(name: str, condition: str | None = None) -> str:
    return f"cast(coalesce(({condition or FLAGS[name]}), false) AS INT)"


def level_sql(score: str, edges: tuple[float, ...], names: tuple[str, ...] = ("low", "medium", "high", "critical")) -> str:
    cases = " ".join(f"WHEN {score} > {lo} AND {score} <= {hi} THEN '{n}'" for lo, hi, n in zip(edges[:-1], edges[1:], names))
    return f"CASE {cases} END"


RULED = GRAINS + ", flagged0 AS (SELECT * EXCLUDE (cpv), " + ", ".join(
    f"{flag_sql(n)} AS flag_{n}" for n in FLAGS
) + " FROM wide), ruled AS (SELECT *, " + " + ".join(
    f"{w} * flag_{n}" for n, w in WEIGHTS.items()
) + " AS rule_risk_score, " + " + ".join(f"flag_{n}" for n in FLAGS) + """ AS rule_flags_count,
""" + level_sql("(" + " + ".join(f"{w} * flag_{n}" for n, w in WEIGHTS.items()) + ")", (-1, 2, 5, 10, 1000)) + """ AS rule_risk_level
FROM flagged0)
"""
