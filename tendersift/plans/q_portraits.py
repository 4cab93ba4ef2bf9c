"""Queries of the aggregations and portraits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tendersift.functions import expr as E
from tendersift.operators import ensemble, portraits
from tendersift.operators.bidstats import tender_bid_stats
from tendersift.operators.quantiles import exact_quantiles
from tendersift.plans.registry import exact_round, exact_round_sql, query, rounded

_DAYS = "cast(trunc((epoch(award_date) - epoch(published_date)) / 86400) AS BIGINT)"
_HHI = """, cpc AS (SELECT buyer_id, main_cpv_2_digit, count(*) AS c FROM tenders WHERE main_cpv_2_digit IS NOT NULL GROUP BY 1, 2)
, ch AS (SELECT buyer_id, sum(pow(c, 2)) / pow(sum(c), 2) AS cpv_concentration FROM cpc GROUP BY 1)
"""
BUYER_SQL = _HHI + f""", buyer_p AS (SELECT t.buyer_id, count(*) AS total_tenders, sum(tender_value) AS total_value,
  avg(tender_value) AS avg_value, median(tender_value) AS median_value,
  avg(is_single_bidder) AS single_bidder_rate, avg(is_competitive) AS competitive_rate, avg(price_change_pct) AS avg_discount_pct,
  count(DISTINCT supplier_id) + max(CASE WHEN supplier_id IS NULL THEN 1 ELSE 0 END) AS unique_suppliers,
  avg(number_of_tenderers) AS avg_tenderers, avg({_DAYS}) AS avg_award_days, avg(is_weekend) AS weekend_rate,
  avg(is_q4) AS q4_rate, (count(DISTINCT supplier_id) + max(CASE WHEN supplier_id IS NULL THEN 1 ELSE 0 END))::DOUBLE / count(*) AS supplier_diversity_index,
  stddev_samp(tender_value) / greatest(avg(tender_value), 1) AS value_variance_coeff, max(cpv_concentration) AS cpv_concentration
FROM tenders t LEFT JOIN ch USING (buyer_id) GROUP BY 1)
"""
SUPPLIER_SQL = """, supplier_p AS (SELECT supplier_id, count(*) AS total_awards, sum(tender_value) AS total_value, avg(tender_value) AS avg_award_value,
  count(DISTINCT buyer_id) + max(CASE WHEN buyer_id IS NULL THEN 1 ELSE 0 END) AS buyer_count, avg(is_single_bidder) AS single_bidder_rate,
  avg(number_of_tenderers) AS avg_competitors,
  count(DISTINCT main_cpv_2_digit) + max(CASE WHEN main_cpv_2_digit IS NULL THEN 1 ELSE 0 END) AS cpv_diversity FROM tenders GROUP BY 1)
"""
PAIR_SQL = """, pair_gaps AS (SELECT buyer_id, supplier_id, trunc((epoch(award_date) - epoch(lag(award_date) OVER (PARTITION BY buyer_id, supplier_id ORDER BY award_date NULLS FIRST, tender_id))) / 86400) AS gap FROM tenders)
, pair_tc AS (SELECT buyer_id, supplier_id, stddev_samp(gap) AS temporal_concentration FROM pair_gaps GROUP BY 1, 2)
, pair_b AS (SELECT buyer_id, count(*) AS b FROM tenders GROUP BY 1), pair_s AS (SELECT supplier_id, count(*) AS s FROM tenders GROUP BY 1)
, pair_0 AS (SELECT buyer_id, supplier_id, count(*) AS contracts_count, sum(tender_value) AS total_value, avg(tender_value) AS avg_value,
  avg(is_single_bidder) AS single_bidder_rate FROM tenders GROUP BY 1, 2)
, pair_p AS (SELECT pair_0.*, contracts_count::DOUBLE / b AS exclusivity_buyer, contracts_count::DOUBLE / s AS exclusivity_supplier, temporal_concentration
FROM pair_0 LEFT JOIN pair_b USING (buyer_id) LEFT JOIN pair_s USING (supplier_id) LEFT JOIN pair_tc USING (buyer_id, supplier_id))
"""


def _money(column: str) -> bool:
    return column.endswith("value")


def _sql_round(columns: dict[str, int | None]) -> str:
    return ", ".join(c if n is None else exact_round_sql(c, n) if _money(c) else f"round({c}, {n}) AS {c}" for c, n in columns.items())


def _pick(df, columns):
    return df.select(*[F.col(c) if n is None else exact_round(c, n) if _money(c) else F.round(c, n).alias(c) for c, n in columns.items()])


_BUYER = {
    "buyer_id": None, "total_tenders": None, "total_value": 2, "avg_value": 3, "median_value": 3, "single_bidder_rate": 6,
    "competitive_rate": 6, "avg_discount_pct": 6, "unique_suppliers": None, "avg_tenderers": 6, "avg_award_days": 6,
    "weekend_rate": 6, "q4_rate": 6, "supplier_diversity_index": 6, "value_variance_coeff": 6, "cpv_concentration": 6,
}
_SUPPLIER = {"supplier_id": None, "total_awards": None, "total_value": 2, "avg_award_value": 3, "buyer_count": None,
             "single_bidder_rate": 6, "avg_competitors": 6, "cpv_diversity": None}
_PAIR = {"buyer_id": None, "supplier_id": None, "contracts_count": None, "total_value": 2, "avg_value": 3,
         "single_bidder_rate": 6, "exclusivity_buyer": 6, "exclusivity_supplier": 6, "temporal_concentration": 6}


@query("agg_buyer_portrait", BUYER_SQL + f"SELECT {_sql_round(_BUYER)} FROM buyer_p")
def _(d):
    return _pick(portraits.buyer_portrait(d.tenders), _BUYER)


@query("agg_cpv_hhi", _HHI + "SELECT buyer_id, round(cpv_concentration, 6) AS cpv_concentration FROM ch")
def _(d):
    return rounded(portraits.cpv_count_hhi(d.tenders), cpv_concentration=6)


@query("agg_supplier_portrait", SUPPLIER_SQL + f"SELECT {_sql_round(_SUPPLIER)} FROM supplier_p")
def _(d):
    return _pick(portraits.supplier_portrait(d.tenders), _SUPPLIER)


@query("agg_pair_portrait", PAIR_SQL + f"SELECT {_sql_round(_PAIR)} FROM pair_p")
def _(d):
    return _pick(portraits.pair_portrait(d.tenders, 1), _PAIR)


@query("agg_temporal_concentration", PAIR_SQL + "SELECT buyer_id, supplier_id, round(temporal_concentration, 6) AS temporal_concentration FROM pair_tc WHERE temporal_concentration IS NOT NULL")
def _(d):
    return rounded(portraits.award_gap_spread(d.tenders).where("temporal_concentration IS NOT NULL"), temporal_concentration=6)


@query("agg_cpv_stats", """SELECT main_cpv_2_digit, round(avg(tender_value), 3) AS cpv_value_mean, round(stddev_samp(tender_value), 3) AS cpv_value_std,
count(tender_value) AS cpv_count, round(avg(number_of_tenderers), 6) AS cpv_tenderers_mean, round(avg(price_change_pct), 6) AS cpv_discount_mean,
round(median(tender_value), 3) AS cpv_value_median, median(number_of_tenderers) AS cpv_tenderers_median, round(median(price_change_pct), 6) AS cpv_discount_median
FROM tenders WHERE main_cpv_2_digit IS NOT NULL GROUP BY 1""")
def _(d):
    return rounded(portraits.cpv_stats(d.tenders), cpv_value_mean=3, cpv_value_std=3, cpv_tenderers_mean=6,
                   cpv_discount_mean=6, cpv_value_median=3, cpv_discount_median=6)


@query("agg_buyer_stats", """SELECT buyer_id, count(*) AS buyer_tender_count, round(avg(is_single_bidder), 6) AS buyer_single_bidder_rate,
round(avg(CASE WHEN procurement_method = 'limited' THEN 1.0 ELSE 0 END), 6) AS buyer_limited_rate, round(sum(tender_value), 2) AS buyer_total_value FROM tenders GROUP BY 1""")
def _(d):
    return rounded(portraits.buyer_stats(d.tenders), buyer_single_bidder_rate=6, buyer_limited_rate=6, buyer_total_value=2)


@query("agg_supplier_stats", """SELECT supplier_id, count(*) AS supplier_win_count, round(sum(tender_value), 2) AS supplier_total_value,
count(DISTINCT main_cpv_2_digit) AS supplier_cpv_count, count(DISTINCT buyer_id) AS supplier_buyer_count FROM tenders WHERE supplier_id IS NOT NULL GROUP BY 1""")
def _(d):
    return rounded(portraits.supplier_stats(d.tenders), supplier_total_value=2)


@query("agg_pair_stats", """SELECT buyer_id, supplier_id, count(*) AS pair_count, round(sum(tender_value), 2) AS pair_value
FROM tenders WHERE supplier_id IS NOT NULL GROUP BY 1, 2""")
def _(d):
    return rounded(portraits.pair_stats(d.tenders), pair_value=2)


_BID = {"bid_min": 6, "bid_max": 6, "bid_mean": 6, "bid_std": 6, "bid_cv": 6, "bid_spread": 6}


@query("agg_bid_stats", """, bs AS (SELECT tender_id, count(bid_amount) AS bid_count, min(bid_amount) AS bid_min, max(bid_amount) AS bid_max,
avg(bid_amount) AS bid_mean, stddev_samp(bid_amount) AS bid_std, stddev_samp(bid_amount) / nullif(avg(bid_amount), 0) AS bid_cv,
max(bid_amount) / nullif(min(bid_amount), 0) AS bid_spread FROM bids GROUP BY 1)
SELECT tender_id, bid_count, """ + ", ".join(exact_round_sql(c, n) for c, n in _BID.items()) + " FROM bs")
def _(d):
    return tender_bid_stats(d.bids).select("tender_id", "bid_count", *[exact_round(c, n) for c, n in _BID.items()])


@query("agg_buyer_hhi", """, v AS (SELECT buyer_id, supplier_id, sum(tender_value) AS v FROM tenders WHERE supplier_id IS NOT NULL GROUP BY 1, 2)
, t AS (SELECT buyer_id, sum(v) AS total FROM v GROUP BY 1)
SELECT buyer_id, round(sum(pow(v / total, 2)), 6) AS buyer_hhi FROM v JOIN t USING (buyer_id) GROUP BY 1""")
def _(d):
    return rounded(portraits.buyer_value_hhi(d.tenders), buyer_hhi=6)


@query("agg_market_hhi", """, v AS (SELECT main_cpv_2_digit, supplier_id, sum(tender_value) AS v FROM tenders WHERE supplier_id IS NOT NULL AND main_cpv_2_digit IS NOT NULL GROUP BY 1, 2)
, t AS (SELECT main_cpv_2_digit, sum(tender_value) AS total FROM tenders GROUP BY 1)
SELECT main_cpv_2_digit, round(sum(pow(v / total, 2)), 6) AS hhi FROM v JOIN t USING (main_cpv_2_digit) GROUP BY 1""")
def _(d):
    return rounded(portraits.market_hhi(d.tenders), hhi=6)


@query("agg_hhi_index", """, s AS (SELECT procurement_method, count(*)::DOUBLE / (SELECT count(*) FROM tenders) AS share FROM tenders GROUP BY 1)
SELECT round(sum(share * share), 6) AS hhi FROM s""")
def _(d):
    counts = d.tenders.groupBy("procurement_method").agg(F.count("*").alias("c"))
    total = counts.agg(F.sum("c")).scalar()
    return rounded(portraits.hhi_index(counts.select((F.col("c") / total).alias("share")), "share"), hhi=6)


@query("agg_global_quantile", """SELECT round(median(tender_value), 3) AS p50, round(quantile_cont(tender_value, 0.9), 3) AS p90,
round(quantile_cont(tender_value, 0.01), 3) AS p01, round(quantile_cont(tender_value, 0.99), 3) AS p99,
round(quantile_cont(price_change_pct, 0.25), 6) AS q1, round(quantile_cont(price_change_pct, 0.75), 6) AS q3 FROM tenders""")
def _(d):
    v, p = F.col("tender_value"), F.col("price_change_pct")
    out = exact_quantiles(d.tenders, [], {"p50": (v, 0.5), "p90": (v, 0.9), "p01": (v, 0.01), "p99": (v, 0.99), "q1": (p, 0.25), "q3": (p, 0.75)})
    return rounded(out, p50=3, p90=3, p01=3, p99=3, q1=6, q3=6)


_FLAGS = ["is_single_bidder", "is_weekend", "is_q4", "has_enquiries"]


@query("agg_corr", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM tenders" for a in _FLAGS for b in _FLAGS) + ")")
def _(d):
    return rounded(ensemble.correlation(d.tenders, _FLAGS), r=6)


@query("agg_jaccard", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(coalesce(sum({a} * {b})::DOUBLE / nullif(sum(greatest({a}, {b})), 0), 0), 6) AS j FROM tenders"
    for a in _FLAGS for b in _FLAGS) + ")")
def _(d):
    return rounded(ensemble.jaccard(d.tenders, _FLAGS), j=6)


@query("agg_describe", """SELECT count(price_change_pct) AS n, round(avg(price_change_pct), 6) AS mean, round(stddev_samp(price_change_pct), 6) AS std,
round(min(price_change_pct), 6) AS lowest, round(quantile_cont(price_change_pct, 0.25), 6) AS q1, round(median(price_change_pct), 6) AS q2,
round(quantile_cont(price_change_pct, 0.75), 6) AS q3, round(max(price_change_pct), 6) AS highest FROM tenders""")
def _(d):
    from tendersift.plans.reports import describe
    out = describe(d.tenders, "price_change_pct")
    return rounded(out, mean=6, std=6, lowest=6, q1=6, q2=6, q3=6, highest=6)


@query("agg_value_counts", """SELECT procurement_method, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM tenders), 6) AS share FROM tenders GROUP BY 1""")
def _(d):
    from tendersift.plans.reports import value_counts
    return rounded(value_counts(d.tenders, "procurement_method"), share=6)


@query("agg_pivot", """SELECT procurement_method, count(*) FILTER (WHERE award_criteria = 'lowestCost') AS lowestCost,
count(*) FILTER (WHERE award_criteria = 'ratedCriteria') AS ratedCriteria,
round(count(*) FILTER (WHERE award_criteria = 'lowestCost') * 100.0::DOUBLE / count(award_criteria), 4) AS lowest_pct FROM tenders GROUP BY 1""")
def _(d):
    wide = d.tenders.groupBy("procurement_method").pivot("award_criteria", ["lowestCost", "ratedCriteria"]).count().fillna(0)
    share = F.col("lowestCost") * 100.0 / (F.col("lowestCost") + F.col("ratedCriteria"))
    return wide.withColumn("lowest_pct", F.round(share, 4))
