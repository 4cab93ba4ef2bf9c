"""Queries of the statistical screens."""

from __future__ import annotations

from pyspark.sql import functions as F

from tendersift.functions import expr as E
from tendersift.operators import screens
from tendersift.operators.bidstats import tender_bid_stats
from tendersift.plans.registry import query, rounded
from tendersift.plans.screens_sql import BENFORD, BIDSTAT, CPV_FLAGS, DIGIT, FLAGS, SCORED, SCREENED, chi2

_ALL = [*FLAGS, *CPV_FLAGS]


def _single(name: str, build) -> None:
    query(name, f"{SCREENED} SELECT tender_id, {name} AS flag FROM screened")(
        lambda d: build(d).select("tender_id", F.col(name).alias("flag")))


for _n in ("stat_zscore_value", "stat_zscore_discount", "stat_iqr_value", "stat_iqr_discount"):
    _single(_n, lambda d: screens.value_outliers(d.tenders, group_by_cpv=False))
for _n in ("stat_zscore_value_cpv", "stat_iqr_value_cpv"):
    _single(_n, lambda d: screens.value_outliers(d.tenders))
for _n in ("stat_round_price", "stat_very_round_price", "stat_99_ending", "stat_award_ratio_suspicious"):
    _single(_n, lambda d: screens.price_patterns(d.tenders))
for _n in ("stat_benford_buyer", "stat_benford_supplier"):
    _single(_n, lambda d: screens.benford_flags(d.tenders, d.bids))
for _n in ("stat_cv_anomaly", "stat_bid_spread_anomaly", "stat_bid_clustering", "stat_bid_spread_high"):
    _single(_n, lambda d: screens.bid_screens(d.tenders, d.bids))
for _n in ("stat_high_concentration", "stat_monopoly"):
    _single(_n, lambda d: screens.concentration(d.tenders))


@query("stat_monopoly_low_cut", f"{SCREENED} SELECT tender_id, cast(coalesce(buyer_hhi > 0.4, false) AS INT) AS flag FROM screened")
def _(d):
    return screens.concentration(d.tenders, monopoly=0.4).select("tender_id", F.col("stat_monopoly").alias("flag"))


# Screens of the bid distribution return the statistic next to the flag, moved off exact rounding ties.
for _key, _stat, _flag in (
    ("stat_bid_diffp", "bid_diffp", "stat_diffp_anomaly"), ("stat_bid_rdnor", "bid_rdnor", "stat_rdnor_anomaly"),
    ("stat_bid_ks", "bid_ks_stat", "stat_ks_anomaly"), ("stat_bid_skew", "bid_skewness", "stat_skewness_anomaly"),
    ("stat_bid_kurtosis", "bid_kurtosis", "stat_kurtosis_anomaly"),
):
    def _statistic(key: str, stat: str, flag: str) -> None:
        @query(key, f"{SCREENED} SELECT tender_id, round({stat} + 0.00000003, 6) AS statistic, {flag} AS flag FROM screened")
        def _(d):
            out = screens.bid_screens(d.tenders, d.bids)
            return out.select("tender_id", F.round(F.col(stat) + 0.00000003, 6).alias("statistic"), F.col(flag).alias("flag"))

    _statistic(_key, _stat, _flag)


@query("stat_competitive_mask", f"""{BIDSTAT} SELECT t.tender_id, cast(procurement_method IN ('open', 'selective') AND coalesce(bid_count, 0) >= 3 AS INT) AS mask
FROM tenders t LEFT JOIN bst ON t.tender_id = bst.tender_id""")
def _(d):
    counts = tender_bid_stats(d.bids).select("tender_id", "bid_count")
    return d.tenders.join(counts, "tender_id", "left").select(
        "tender_id", E.flag(E.competitive_method() & (F.col("bid_count") >= 3)).alias("mask"))


@query("stat_detect", f"{SCREENED} SELECT tender_id, {', '.join(_ALL)}, stat_score, cast(stat_flags_count AS INT) AS stat_flags_count, stat_risk_level, stat_anomaly FROM screened")
def _(d):
    return d.screened.select("tender_id", *_ALL, "stat_score", "stat_flags_count", "stat_risk_level", "stat_anomaly")


_NO_BIDS = ["stat_zscore_value", "stat_iqr_value", "stat_zscore_discount", "stat_iqr_discount", "stat_99_ending",
            "stat_award_ratio_suspicious", "stat_high_concentration", "stat_monopoly"]


@query("stat_detect_without_bids", f"""{SCREENED} SELECT tender_id,
cast({' + '.join(f'{SCORED[c]} * {c}' for c in _NO_BIDS)} AS DOUBLE) AS stat_score FROM screened""")
def _(d):
    return screens.detect(d.tenders, group_by_cpv=False).select("tender_id", "stat_score")


@query("stat_score", f"{SCREENED} SELECT tender_id, stat_score, stat_risk_level FROM screened")
def _(d):
    flags = d.screened.select("tender_id", *SCORED)
    return screens.score(flags).select("tender_id", "stat_score", "stat_risk_level")


@query("stat_summary", f"""{SCREENED}, up AS (UNPIVOT (SELECT {', '.join(_ALL)} FROM (SELECT {', '.join(f'coalesce({c}, 0) AS {c}' for c in _ALL)} FROM screened)) ON COLUMNS(*) INTO NAME flag VALUE v)
SELECT substring(flag, 6) AS flag, cast(sum(v) AS BIGINT) AS count, round(sum(v) * 100.0::DOUBLE / count(*), 2) AS percentage FROM up GROUP BY 1""")
def _(d):
    return screens.summary(d.screened)


@query("stat_risk_distribution", f"""{SCREENED} SELECT stat_risk_level AS risk_level, count(*) AS count,
round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM screened), 2) AS percentage FROM screened WHERE stat_risk_level IS NOT NULL GROUP BY 1""")
def _(d):
    return screens.risk_distribution(d.screened)


@query("stat_get_anomalies", f"{SCREENED} SELECT tender_id, stat_score FROM screened WHERE stat_score >= 3")
def _(d):
    return screens.anomalies(d.screened).select("tender_id", "stat_score")


@query("stat_benford_test", f""", digs AS (SELECT {DIGIT.format('bid_amount')} AS digit FROM bids WHERE bid_amount >= 1)
, c2 AS (SELECT {chi2()} AS x FROM digs)
SELECT 'Benford''s Law' AS name, round(x, 4) AS statistic,
round(exp(-x / 2) * (1 + x / 2 + pow(x / 2, 2) / 2 + pow(x / 2, 3) / 6), 6) AS p_value, cast(x > 15.51 AS INT) AS is_anomaly, 15.51::DOUBLE AS threshold,
printf('Chi-square = %.2f, critical = 15.51', x) AS description FROM c2""")
def _(d):
    return rounded(screens.benford_test(d.bids, "bid_amount"), statistic=4, p_value=6)


@query("stat_outliers_zscore", """, m AS (SELECT avg(tender_value) AS mean, stddev_samp(tender_value) AS std FROM tenders)
SELECT tender_id, cast(coalesce(abs(tender_value - mean) / nullif(std, 0) > 3, false) AS INT) AS is_outlier, round(mean, 3) AS mean, round(std, 3) AS std FROM tenders, m""")
def _(d):
    out = screens.outliers_zscore(d.tenders, "tender_value").select("tender_id", "is_outlier", "mean", "std")
    return rounded(out, mean=3, std=3)


@query("stat_outliers_iqr", """, q AS (SELECT quantile_cont(tender_value, 0.25) AS q1, quantile_cont(tender_value, 0.75) AS q3 FROM tenders)
SELECT tender_id, cast(tender_value < q1 - 1.5 * (q3 - q1) OR tender_value > q3 + 1.5 * (q3 - q1) AS INT) AS is_outlier,
round(q1 - 1.5 * (q3 - q1), 3) AS lower, round(q3 + 1.5 * (q3 - q1), 3) AS upper FROM tenders, q""")
def _(d):
    out = screens.outliers_iqr(d.tenders, "tender_value").select("tender_id", "is_outlier", "lower", "upper")
    return rounded(out, lower=3, upper=3)
