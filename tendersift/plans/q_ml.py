"""Queries of the outlier models."""

from __future__ import annotations

from pyspark.sql import functions as F

from tendersift.functions import expr as E
from tendersift.operators import anomaly, iforest, scaling
from tendersift.operators.lof import lof_scores
from tendersift.plans.ml_sql import BUYER_FOREST, BUYER_Z, FOREST, LOF, PAIR_FOREST, PAIR_LOF, SUPPLIER_FOREST, SUPPLIER_LOF, WIDE_FOREST, importance_sql
from tendersift.plans.registry import query, rounded
from tendersift.schemas import ML_FEATURES


@query("ml_value_vs_cpv_median", """, m AS (SELECT main_cpv_2_digit AS cpv, median(award_value) AS md FROM tenders WHERE main_cpv_2_digit IS NOT NULL GROUP BY 1)
SELECT tender_id, round(CASE WHEN md IS NOT NULL THEN coalesce(award_value, 0) / greatest(md, 1) END, 6) AS value_vs_cpv_median FROM tenders LEFT JOIN m ON main_cpv_2_digit = cpv""")
def _(d):
    return rounded(scaling.value_vs_cpv_median(d.tenders).select("tender_id", "value_vs_cpv_median"), value_vs_cpv_median=6)


@query("ml_tender_features", """, m AS (SELECT main_cpv_2_digit AS cpv, median(award_value) AS md FROM tenders WHERE main_cpv_2_digit IS NOT NULL GROUP BY 1)
, bp AS (SELECT buyer_id, avg(is_single_bidder) AS sbr, count(*) AS n FROM tenders GROUP BY 1)
SELECT tender_id, round(CASE WHEN md IS NOT NULL THEN coalesce(award_value, 0) / greatest(md, 1) END, 6) AS value_vs_cpv_median, number_of_tenderers, is_weekend, round(sbr, 6) AS single_bidder_rate, n AS total_tenders
FROM tenders LEFT JOIN m ON main_cpv_2_digit = cpv LEFT JOIN bp USING (buyer_id)""")
def _(d):
    wide, _ = scaling.tender_features(d.tenders, d.buyers, d.suppliers)
    out = wide.select("tender_id", "value_vs_cpv_median", "number_of_tenderers", "is_weekend", "single_bidder_rate", "total_tenders")
    return rounded(out, value_vs_cpv_median=6, single_bidder_rate=6)


@query("ml_preprocess", BUYER_Z + ", e AS (SELECT buyer_id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS pos FROM z_buyer) SELECT buyer_id, cast(pos AS INT) AS pos, round(x, 6) AS x FROM e")
def _(d):
    ready = scaling.preprocess(d.buyers, ML_FEATURES["buyer"], ["buyer_id"])
    return ready.select("buyer_id", F.posexplode("features").alias("pos", "x")).withColumn("x", F.round("x", 6))


@query("ml_lof", LOF + "SELECT buyer_id, round(raw, 5) AS raw_score FROM lof")
def _(d):
    ready = scaling.preprocess(d.buyers, ML_FEATURES["buyer"], ["buyer_id"])
    return rounded(lof_scores(ready, ["buyer_id"]), raw_score=5)


def _lof(d):
    return d.staged("lof_buyers", lambda: anomaly.detect_buyers(d.tenders, d.buyers))


def _iforest(d):
    return d.staged("iforest", lambda: anomaly.detect_tenders(d.tenders))


@query("ml_detect_buyers", LOF + "SELECT buyer_id, round(score, 5) AS score, anomaly, risk_level FROM lof")
def _(d):
    return rounded(_lof(d).select("buyer_id", "score", "anomaly", "risk_level"), score=5)


@query("ml_score_norm", LOF + "SELECT buyer_id, round(score, 5) AS score FROM lof")
def _(d):
    return rounded(_lof(d).select("buyer_id", "score"), score=5)


@query("ml_label", FOREST + "SELECT tender_id, anomaly FROM if_tender")
def _(d):
    return _iforest(d).select("tender_id", "anomaly")


@query("ml_risk_level", FOREST + "SELECT tender_id, risk_level FROM if_tender")
def _(d):
    return _iforest(d).select("tender_id", E.ml_level(F.col("score")).alias("risk_level"))


@query("ml_iforest", FOREST + "SELECT tender_id, round(raw, 6) AS raw_score, round(score, 5) AS score, anomaly FROM if_tender")
def _(d):
    scored = d.staged("iforest_raw", lambda: anomaly.detect_tenders(d.tenders, raw=True))
    return rounded(scored.select("tender_id", "raw_score", "score", "anomaly"), raw_score=6, score=5)


@query("ml_detect_tenders", WIDE_FOREST + "SELECT tender_id, round(score, 5) AS score, anomaly, risk_level FROM if_wide")
def _(d):
    return rounded(anomaly.detect_tenders(d.tenders, d.buyers, d.suppliers).select("tender_id", "score", "anomaly", "risk_level"), score=5)


def _portrait_query(name: str, sql: str, keys: str, staged: str, build) -> None:
    @query(name, sql + f"SELECT {keys}, round(score, 5) AS score, anomaly, risk_level FROM {'if' if 'iforest' in staged else 'lof'}_{staged.split('_')[1][:-1]}")
    def _(d):
        return rounded(d.staged(staged, lambda: build(d)).select(*keys.split(", "), "score", "anomaly", "risk_level"), score=5)


_portrait_query("ml_detect_suppliers", SUPPLIER_LOF, "supplier_id", "lof_suppliers", lambda d: anomaly.detect_suppliers(d.tenders))
_portrait_query("ml_detect_pairs", PAIR_LOF, "buyer_id, supplier_id", "lof_pairs", lambda d: anomaly.detect_pairs(d.tenders))
_portrait_query("ml_detect_buyers_iforest", BUYER_FOREST, "buyer_id", "iforest_buyers", lambda d: anomaly.detect_buyers(d.tenders, d.buyers, "iforest"))
_portrait_query("ml_detect_suppliers_iforest", SUPPLIER_FOREST, "supplier_id", "iforest_suppliers", lambda d: anomaly.detect_suppliers(d.tenders, "iforest"))
_portrait_query("ml_detect_pairs_iforest", PAIR_FOREST, "buyer_id, supplier_id", "iforest_pairs", lambda d: anomaly.detect_pairs(d.tenders, algorithm="iforest"))


@query("ml_feature_importances", FOREST + importance_sql("tender"))
def _(d):
    wide, features = scaling.tender_features(d.tenders)
    _, trees = iforest.fit_score(scaling.preprocess(wide, features, ["tender_id"]), ["tender_id"])
    return rounded(iforest.importances(trees, features), importance=6)


@query("ml_summary", LOF + """SELECT 'lof' AS algorithm, 'total' AS metric, count(*)::DOUBLE AS value FROM lof
UNION ALL SELECT 'lof', 'anomalies', sum(anomaly) FROM lof UNION ALL SELECT 'lof', 'anomaly_rate', avg(anomaly) * 100 FROM lof
UNION ALL SELECT 'lof', 'risk_critical', count(*) FROM lof WHERE risk_level = 'critical' UNION ALL SELECT 'lof', 'risk_high', count(*) FROM lof WHERE risk_level = 'high'
UNION ALL SELECT 'lof', 'risk_medium', count(*) FROM lof WHERE risk_level = 'medium' UNION ALL SELECT 'lof', 'risk_low', count(*) FROM lof WHERE risk_level = 'low'""")
def _(d):
    return anomaly.summary(_lof(d), "lof")


@query("ml_get_anomalies", LOF + "SELECT buyer_id, anomaly FROM lof WHERE score >= 0.5")
def _(d):
    return anomaly.above(_lof(d), 0.5).select("buyer_id", "anomaly")


@query("ml_map_to_tenders", LOF + "SELECT tender_id, round(coalesce(score, 0), 5) AS lof_score, coalesce(anomaly, 0) AS lof_anomaly FROM tenders LEFT JOIN lof USING (buyer_id)")
def _(d):
    return rounded(anomaly.map_to_tenders(d.tenders, _lof(d)), lof_score=5)
