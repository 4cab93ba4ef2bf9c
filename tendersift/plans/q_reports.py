"""Report queries on tenders, bids and rule results."""

from __future__ import annotations

from pyspark.sql import functions as F

from tendersift.functions import expr as E
from tendersift.operators.rules import flag_columns, unpivot_sums
from tendersift.plans import reports as R
from tendersift.plans.q_portraits import BUYER_SQL
from tendersift.plans.registry import query, rounded
from tendersift.plans.rules_sql import FLAGS, RULED
from tendersift.plans.screens_sql import DIGIT, SCREENED


@query("eda_by_year", "SELECT year, count(*) AS tenders FROM tenders GROUP BY 1")
def _(d):
    return R.counts_by(d.tenders, F.col("year"), "year")


@query("eda_by_month", "SELECT strftime(published_date, '%Y-%m') AS month, count(*) AS tenders FROM tenders GROUP BY 1")
def _(d):
    return R.counts_by(d.tenders, F.date_format("published_date", "yyyy-MM"), "month")


@query("eda_by_quarter", "SELECT quarter, count(*) AS tenders FROM tenders GROUP BY 1")
def _(d):
    return R.counts_by(d.tenders, F.col("quarter"), "quarter")


@query("eda_by_weekday", "SELECT day_of_week, count(*) AS tenders FROM tenders GROUP BY 1")
def _(d):
    return R.counts_by(d.tenders, F.col("day_of_week"), "day_of_week")


_RATES = {"weekend_pct": "is_weekend", "q4_pct": "is_q4", "december_pct": "is_december", "cross_region_pct": "is_cross_region",
          "competitive_pct": "is_competitive", "single_bidder_pct": "is_single_bidder", "masked_buyer_pct": "is_buyer_masked",
          "masked_supplier_pct": "is_supplier_masked"}
_RATE_SQL = ", ".join(f"round(avg({c}) * 100, 6) AS {n}" for n, c in _RATES.items()) + ", round(avg(number_of_tenderers), 6) AS avg_tenderers"


@query("eda_rates", f"SELECT {_RATE_SQL} FROM tenders")
def _(d):
    return rounded(R.headline_rates(d.tenders), avg_tenderers=6, **{n: 6 for n in _RATES})


@query("eda_rates_by_year", f"SELECT year, {_RATE_SQL} FROM tenders GROUP BY 1")
def _(d):
    return rounded(R.headline_rates(d.tenders, "year"), avg_tenderers=6, **{n: 6 for n in _RATES})


@query("eda_region_count", "SELECT 'region ' || buyer_id % 5 AS buyer_region, count(*) AS total_tenders FROM tenders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def _(d):
    return R.region_totals(d.buyers, "total_tenders")


@query("eda_region_value", "SELECT 'region ' || buyer_id % 5 AS buyer_region, round(sum(tender_value), 2) AS total_value FROM tenders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def _(d):
    return rounded(R.region_totals(d.buyers, "total_value"), total_value=2)


@query("eda_tenderers_dist", "SELECT number_of_tenderers, count(*) AS tenders FROM tenders GROUP BY 1 ORDER BY 1 LIMIT 10")
def _(d):
    return R.counts_by(d.tenders, F.col("number_of_tenderers"), "number_of_tenderers").orderBy("number_of_tenderers").limit(10)


@query("eda_top_single_bidder_buyers", "SELECT buyer_id, count(*) AS total_tenders, round(avg(is_single_bidder), 6) AS single_bidder_rate FROM tenders GROUP BY 1 HAVING count(*) >= 100 ORDER BY avg(is_single_bidder) DESC, 1 LIMIT 10")
def _(d):
    out = R.top_by(d.buyers.where("total_tenders >= 100"), "single_bidder_rate", "buyer_id", 10)
    return rounded(out.select("buyer_id", "total_tenders", "single_bidder_rate"), single_bidder_rate=6)


@query("eda_value_bands", """SELECT CASE WHEN tender_value < 50000 THEN '<50K' WHEN tender_value < 200000 THEN '50K-200K' WHEN tender_value < 1000000 THEN '200K-1M'
WHEN tender_value < 10000000 THEN '1M-10M' ELSE '>10M' END AS band, count(*) AS tenders FROM tenders WHERE tender_value > 0 GROUP BY 1""")
def _(d):
    return R.counts_by(d.tenders.where("tender_value > 0"), E.value_band(F.col("tender_value")), "band")


@query("eda_price_change", """SELECT count(*) AS n, round(avg(p), 6) AS mean_change, count(*) FILTER (p > 0) AS savings, round(avg(p) FILTER (p > 0), 6) AS mean_saving, count(*) FILTER (p < 0) AS overpay,
round(avg(p) FILTER (p < 0), 6) AS mean_overpay, count(*) FILTER (p = 0) AS no_change, count(*) FILTER (p > 50) AS extreme_discount, count(*) FILTER (p < -20) AS extreme_overpay
FROM (SELECT price_change_pct AS p FROM tenders WHERE tender_value > 0 AND award_value > 0)""")
def _(d):
    return rounded(R.price_change(d.tenders), mean_change=6, mean_saving=6, mean_overpay=6)


@query("eda_top_bidders", """SELECT bidder_id, count(*) AS total_bids, count(DISTINCT tender_id) AS unique_tenders, count(DISTINCT buyer_id) AS unique_buyers
FROM bids JOIN tenders USING (tender_id) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def _(d):
    return R.top_by(d.bidders, "total_bids", "bidder_id", 10).select("bidder_id", "total_bids", "unique_tenders", "unique_buyers")


@query("eda_top_suppliers", "SELECT supplier_id, count(*) AS total_awards, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM tenders), 6) AS share_pct FROM tenders WHERE supplier_id IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def _(d):
    return rounded(R.supplier_shares(d.suppliers), share_pct=6)


@query("eda_low_diversity_buyers", BUYER_SQL + "SELECT buyer_id, total_tenders, round(supplier_diversity_index, 6) AS supplier_diversity_index FROM buyer_p WHERE total_tenders >= 10 AND supplier_diversity_index < 0.1")
def _(d):
    low = d.buyers.where("total_tenders >= 10 AND supplier_diversity_index < 0.1")
    return rounded(low.select("buyer_id", "total_tenders", "supplier_diversity_index").orderBy("supplier_diversity_index"), supplier_diversity_index=6)


@query("eda_fraud_score", """, f AS (SELECT 2 * is_single_bidder + is_weekend + is_buyer_masked + is_supplier_masked + CASE WHEN price_change_pct < -20 THEN 2 ELSE 0 END AS fraud_score FROM tenders)
SELECT fraud_score, count(*) AS tenders, cast(fraud_score >= 4 AS INT) AS high_risk FROM f GROUP BY 1""")
def _(d):
    out = R.counts_by(R.fraud_points(d.tenders), F.col("fraud_score"), "fraud_score")
    return out.withColumn("high_risk", E.flag(F.col("fraud_score") >= 4))


@query("eda_cpv_top", "SELECT main_cpv_2_digit, count(*) AS n FROM tenders WHERE main_cpv_2_digit IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
def _(d):
    counts = R.value_counts(d.tenders.where("main_cpv_2_digit IS NOT NULL"), "main_cpv_2_digit")
    return R.top_by(counts.select("main_cpv_2_digit", "n"), "n", "main_cpv_2_digit", 15)


@query("eda_cpv_competition", "SELECT main_cpv_2_digit, count(*) AS tenders, round(avg(is_single_bidder) * 100, 6) AS single_bidder_pct FROM tenders WHERE main_cpv_2_digit IS NOT NULL GROUP BY 1 HAVING count(*) >= 500")
def _(d):
    return rounded(R.cpv_competition(d.tenders, 500), single_bidder_pct=6)


@query("eda_date_range", "SELECT min(published_date) AS first, max(published_date) AS last FROM tenders")
def _(d):
    return d.tenders.agg(F.min("published_date").alias("first"), F.max("published_date").alias("last"))


@query("eda_summary", """SELECT count(*) AS total_tenders, count(DISTINCT buyer_id) AS total_buyers, count(DISTINCT supplier_id) + 1 AS total_suppliers, (SELECT count(DISTINCT bidder_id) FROM bids) AS total_bidders,
round(sum(tender_value) / 1e12, 9) AS total_value_trillion, round(avg(is_competitive) * 100, 6) AS competitive_rate, round(avg(is_single_bidder) * 100, 6) AS single_bidder_rate,
round(avg(number_of_tenderers), 6) AS avg_tenderers, round(median(tender_value), 3) AS median_tender_value, round(avg(price_change_pct), 6) AS avg_price_change_pct FROM tenders""")
def _(d):
    out = R.headline_summary(d.tenders, d.buyers, d.suppliers, d.bidders)
    return rounded(out, total_value_trillion=9, competitive_rate=6, single_bidder_rate=6, avg_tenderers=6, median_tender_value=3, avg_price_change_pct=6)


# --- rule reports -------------------------------------------------------------------------------------------

_LV = ("low", "medium", "high", "critical")


@query("rep_risk_by_method", RULED + "SELECT procurement_method, " + ", ".join(f"count(*) FILTER (rule_risk_level = '{x}') AS {x}, round(count(*) FILTER (rule_risk_level = '{x}') * 100.0::DOUBLE / count(*), 4) AS {x}_pct" for x in _LV)
       + ", round(avg(rule_risk_score), 6) AS mean_score, median(rule_risk_score) AS median_score, max(rule_risk_score) AS max_score FROM ruled GROUP BY 1")
def _(d):
    return rounded(R.risk_by_method(d.ruled), mean_score=6, **{f"{x}_pct": 4 for x in _LV})


@query("rep_open_flags", RULED + f""", up AS (UNPIVOT (SELECT {', '.join('flag_' + n for n in FLAGS)} FROM ruled WHERE procurement_method = 'open') ON COLUMNS(*) INTO NAME flag VALUE v)
SELECT flag, cast(sum(v) AS BIGINT) AS count FROM up GROUP BY 1 HAVING sum(v) > 0 ORDER BY 2 DESC, 1 LIMIT 15""")
def _(d):
    flags = unpivot_sums(d.ruled.where("procurement_method = 'open'"), flag_columns(d.ruled)).select("flag", "count")
    return flags.where("count > 0").orderBy(F.desc("count"), "flag").limit(15)


def _group(name: str, key: str, least: int) -> None:
    @query(name, RULED + f"""SELECT {key}, count(*) AS tenders, round(avg(rule_risk_score), 6) AS avg_risk, round(avg(rule_flags_count), 6) AS avg_flags,
    round(avg(CASE WHEN rule_risk_score >= 6 THEN 100.0::DOUBLE ELSE 0 END), 6) AS high_risk_pct FROM ruled WHERE {key} IS NOT NULL GROUP BY 1 HAVING count(*) >= {least}""")
    def _(d):
        return rounded(R.group_risk(d.ruled, key, least), avg_risk=6, avg_flags=6, high_risk_pct=6)


_group("rep_cpv_risk", "main_cpv_2_digit", 500)
_group("rep_month_risk", "month", 0)
_group("rep_q4_effect", "is_q4", 0)


@query("rep_buyer_risk", RULED + """SELECT buyer_id, count(*) AS tenders, round(avg(rule_risk_score), 6) AS avg_risk, cast(sum(rule_risk_score) AS BIGINT) AS total_risk, round(avg(rule_flags_count), 6) AS avg_flags,
round(sum(tender_value), 2) AS total_value, 'buyer ' || buyer_id AS buyer_name, 'region ' || buyer_id % 5 AS buyer_region FROM ruled GROUP BY buyer_id HAVING count(*) >= 50 ORDER BY avg(rule_risk_score) DESC, buyer_id LIMIT 15""")
def _(d):
    return rounded(R.buyer_risk(d.ruled, d.buyers), avg_risk=6, avg_flags=6, total_value=2)


_FL = [f"flag_{n}" for n in FLAGS]
_PAIRS = [(a, b) for i, a in enumerate(_FL) for b in _FL[i + 1:]]


@query("rep_flag_corr", RULED + f""", up AS (UNPIVOT (SELECT {', '.join(_FL)} FROM ruled) ON COLUMNS(*) INTO NAME flag VALUE v)
, tot AS (SELECT flag, sum(v) AS s FROM up GROUP BY 1), fr AS (SELECT flag FROM (SELECT flag, row_number() OVER (ORDER BY s DESC, flag) AS rk FROM tot) WHERE rk <= 15)
, cc AS (SELECT unnest([{', '.join(f"{{'a': '{a}', 'b': '{b}', 'r': CASE WHEN stddev_pop({a}) > 0 AND stddev_pop({b}) > 0 THEN corr({a}, {b}) END}}" for a, b in _PAIRS)}]) AS e FROM ruled)
SELECT e.a AS a, e.b AS b, round(e.r, 5) AS r FROM cc WHERE abs(e.r) > 0.3 AND e.a IN (FROM fr) AND e.b IN (FROM fr)""")
def _(d):
    return rounded(R.flag_correlations(d.ruled), r=5)


_EXP = " ".join(f"WHEN {k} THEN {v}::DOUBLE" for k, v in {1: 0.301, 2: 0.176, 3: 0.125, 4: 0.097, 5: 0.079, 6: 0.067, 7: 0.058, 8: 0.051, 9: 0.046}.items())


@query("rep_benford_global", f""", dg AS (SELECT {DIGIT.format('tender_value')} AS digit FROM tenders WHERE tender_value >= 1)
SELECT digit, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM dg), 6) AS observed, CASE digit {_EXP} END AS expected FROM dg GROUP BY 1""")
def _(d):
    return rounded(R.digit_shares(d.tenders, "tender_value"), observed=6)


@query("rep_benford_global_bids", f""", dg AS (SELECT {DIGIT.format('bid_amount')} AS digit FROM bids WHERE bid_amount >= 1)
SELECT digit, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM dg), 6) AS observed, CASE digit {_EXP} END AS expected FROM dg GROUP BY 1""")
def _(d):
    return rounded(R.digit_shares(d.bids, "bid_amount"), observed=6)


@query("rep_value_outliers", """, s AS (SELECT avg(tender_value) AS m, stddev_samp(tender_value) AS sd, quantile_cont(tender_value, 0.25) AS q1, quantile_cont(tender_value, 0.75) AS q3 FROM tenders WHERE tender_value > 0)
SELECT count(*) AS n, count(*) FILTER (abs(tender_value - m) / sd > 3) AS over_3_sigma, count(*) FILTER (abs(tender_value - m) / sd > 4) AS over_4_sigma, round(max(q1 - 1.5 * (q3 - q1)), 3) AS lower,
round(max(q3 + 1.5 * (q3 - q1)), 3) AS upper, count(*) FILTER (tender_value < q1 - 1.5 * (q3 - q1) OR tender_value > q3 + 1.5 * (q3 - q1)) AS iqr_outliers FROM tenders, s WHERE tender_value > 0""")
def _(d):
    return rounded(R.value_outlier_counts(d.tenders), lower=3, upper=3)


@query("rep_bid_spread", """, s AS (SELECT max(bid_amount) / nullif(min(bid_amount), 0) AS spread FROM bids GROUP BY tender_id HAVING count(bid_amount) >= 2)
SELECT count(*) AS tenders, count(*) FILTER (spread = 1) AS identical, count(*) FILTER (spread < 1.01) AS very_close, count(*) FILTER (spread > 10) AS very_spread FROM s""")
def _(d):
    return R.bid_spread_report(d.bids)


@query("rep_stat_by_method", SCREENED + "SELECT procurement_method, round(avg(stat_score), 6) AS mean_score FROM screened GROUP BY 1")
def _(d):
    return d.screened.groupBy("procurement_method").agg(F.round(F.avg("stat_score"), 6).alias("mean_score"))
