"""Queries of the vote of all five methods and of the comparisons of methods."""

from __future__ import annotations

from pyspark.sql import functions as F

from tendersift.functions import expr as E
from tendersift.operators import anomaly, ensemble as V, portraits
from tendersift.plans import reports as R
from tendersift.plans.ml_sql import BUYER_Z, FOREST, LOF, PAIR_SQL, SUPPLIER_SQL, forest_sql, lof_sql, scaled_sql
from tendersift.plans.network_sql import NETWORKED
from tendersift.plans.q_ml import _iforest, _lof
from tendersift.plans.registry import also, query, rounded
from tendersift.plans.rules_sql import FLAGS, RULED
from tendersift.plans.screens_sql import SCREENED
from tendersift.operators.anomaly import map_to_tenders

_M = V.METHODS
_VOTES = " + ".join(f"{m}_anomaly" for m in _M)
_RANKED = """
, lt AS (SELECT tender_id, coalesce(score, 0) AS s, coalesce(anomaly, 0) AS lof_anomaly FROM tenders LEFT JOIN lof USING (buyer_id))
, lr AS (SELECT tender_id, (rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0::DOUBLE) / count(*) OVER () AS lof_score, lof_anomaly FROM lt)
"""
COMBINED = RULED + SCREENED + NETWORKED + LOF + _RANKED + FOREST + f"""
, e0 AS (SELECT tender_id, rule_risk_score::DOUBLE / greatest((SELECT max(rule_risk_score) FROM ruled), 1) AS rule_score,
  cast(rule_risk_level IN ('high', 'critical') AS INT) AS rule_anomaly, stat_score / greatest((SELECT max(stat_score) FROM screened), 1) AS stat_score, stat_anomaly,
  if_score, if_anomaly, lof_score, lof_anomaly, network_score, network_anomaly
  FROM ruled JOIN (SELECT tender_id, stat_score, stat_anomaly FROM screened) USING (tender_id) JOIN lr USING (tender_id)
  JOIN (SELECT tender_id, score AS if_score, anomaly AS if_anomaly FROM if_tender) USING (tender_id)
  JOIN (SELECT tender_id, network_score, network_anomaly FROM networked) USING (tender_id))
, e1 AS (SELECT *, (rule_score + 0.8 * stat_score + if_score + 0.8 * lof_score + network_score) / 4.6 AS ensemble_score, {_VOTES} AS consensus_count,
  ({_VOTES}) / 5.0::DOUBLE AS consensus_pct FROM e0)
, ens AS (SELECT *, cast(consensus_count >= 2 AS INT) AS ensemble_anomaly, CASE WHEN consensus_pct >= 0.75 THEN 'critical' WHEN consensus_pct >= 0.5 THEN 'high'
  WHEN consensus_pct >= 0.25 THEN 'medium' ELSE 'low' END AS ensemble_risk_level FROM e1)
"""


def _results(d) -> dict:
    lof = map_to_tenders(d.tenders, _lof(d))
    return {"rule": d.ruled, "stat": d.screened, "if": _iforest(d), "lof": lof, "network": d.networked}


def combined(d):
    return d.staged("ensemble", lambda: V.combine(_results(d)))


@query("ens_norm_max", RULED + "SELECT tender_id, round(rule_risk_score::DOUBLE / greatest((SELECT max(rule_risk_score) FROM ruled), 1), 6) AS rule_score FROM ruled")
def _(d):
    return rounded(V.scale_by_max(d.ruled.select("tender_id", F.col("rule_risk_score").alias("rule_score")), "rule_score"), rule_score=6)


@query("ens_rule_vote", RULED + """SELECT tender_id, cast(rule_risk_level IN ('high', 'critical') AS INT) AS by_level, cast(rule_risk_score >= 6 AS INT) AS by_score,
cast(rule_flags_count >= 3 AS INT) AS by_flags FROM ruled""")
def _(d):
    base = d.ruled.select("tender_id", "rule_risk_score", "rule_flags_count", "rule_risk_level")
    level = V.rule_vote(base).select("tender_id", F.col("rule_anomaly").alias("by_level"))
    points = V.rule_vote(base.drop("rule_risk_level")).select("tender_id", F.col("rule_anomaly").alias("by_score"))
    flags = V.rule_vote(base.drop("rule_risk_level", "rule_risk_score")).select("tender_id", F.col("rule_anomaly").alias("by_flags"))
    return level.join(points, "tender_id").join(flags, "tender_id")


@query("ens_stat_vote", SCREENED + "SELECT tender_id, stat_anomaly AS by_anomaly, cast(stat_flags_count > 0 AS INT) AS by_flags FROM screened")
def _(d):
    base = d.screened.select("tender_id", "stat_score", "stat_flags_count", "stat_anomaly")
    own = V.stat_vote(base).select("tender_id", F.col("stat_anomaly").alias("by_anomaly"))
    flags = V.stat_vote(base.drop("stat_anomaly")).select("tender_id", F.col("stat_anomaly").alias("by_flags"))
    return own.join(flags, "tender_id")


@query("ens_if_vote", FOREST + "SELECT tender_id, round(score, 5) AS if_score, anomaly AS if_anomaly FROM if_tender")
def _(d):
    return rounded(V.if_vote(_iforest(d)), if_score=5)


@query("ens_lof_rank", LOF + _RANKED + "SELECT tender_id, round(lof_score, 6) AS pct_rank FROM lr")
def _(d):
    scores = map_to_tenders(d.tenders, _lof(d)).select("tender_id", "lof_score")
    return rounded(scores.join(V.average_rank(scores, "lof_score"), "lof_score").select("tender_id", "pct_rank"), pct_rank=6)


_COLS = [f"{m}_{k}" for m in _M for k in ("score", "anomaly")]


@query("ens_combine", COMBINED + "SELECT tender_id, " + ", ".join(f"round({c}, 9) AS {c}" if c.endswith("score") else c for c in _COLS)
       + ", round(ensemble_score, 9) AS ensemble_score, consensus_count, consensus_pct, ensemble_anomaly, ensemble_risk_level FROM ens")
def _(d):
    out = combined(d).select("tender_id", *_COLS, "ensemble_score", "consensus_count", "consensus_pct", "ensemble_anomaly", "ensemble_risk_level")
    return rounded(out, ensemble_score=9, **{c: 9 for c in _COLS if c.endswith("score")})


@query("ens_risk_level", COMBINED + "SELECT tender_id, ensemble_risk_level AS level FROM ens")
def _(d):
    return combined(d).select("tender_id", E.consensus_level(F.col("consensus_pct")).alias("level"))


@query("ens_method_stats", COMBINED + " UNION ALL ".join(
    f"SELECT '{m}' AS method, cast(sum({m}_anomaly) AS BIGINT) AS anomalies, round(avg({m}_anomaly) * 100, 2) AS anomaly_pct, round(avg({m}_score), 4) AS mean_score, round(median({m}_score), 4) AS median_score FROM ens"
    for m in _M))
def _(d):
    return V.method_stats(combined(d))


@query("ens_consensus_filter", COMBINED + "SELECT tender_id, consensus_count FROM ens WHERE consensus_count >= 2")
def _(d):
    return V.consensus(combined(d), 2).select("tender_id", "consensus_count")


@query("ens_critical", COMBINED + "SELECT tender_id, consensus_count FROM ens WHERE ensemble_risk_level = 'critical'")
def _(d):
    return V.critical(combined(d)).select("tender_id", "consensus_count")


@query("ens_correlation", COMBINED + " UNION ALL ".join(
    f"SELECT '{a}_score' AS a, '{b}_score' AS b, round(corr({a}_score, {b}_score), 5) AS r FROM ens" for a in _M for b in _M))
def _(d):
    return rounded(V.correlation(combined(d), [f"{m}_score" for m in _M]), r=5)


@query("ens_agreement", COMBINED + " UNION ALL ".join(
    f"SELECT '{a}_anomaly' AS a, '{b}_anomaly' AS b, round(coalesce(sum({a}_anomaly * {b}_anomaly)::DOUBLE / nullif(sum(greatest({a}_anomaly, {b}_anomaly)), 0), 0), 6) AS j FROM ens"
    for a in _M for b in _M))
def _(d):
    return rounded(V.agreement(combined(d)), j=6)


_SUMMARY = [("total_tenders", "true"), *[(f"risk_{r}", f"ensemble_risk_level = '{r}'") for r in ("critical", "high", "medium", "low")],
            *[(f"consensus_{i}_methods", f"consensus_count = {i}") for i in range(6)]]


@query("ens_summary", COMBINED + " UNION ALL ".join(
    f"SELECT '{n}' AS metric, count(*) FILTER ({t}) AS value, round(count(*) FILTER ({t}) * 100.0::DOUBLE / count(*), 2) AS percentage FROM ens" for n, t in _SUMMARY))
def _(d):
    return V.summary(combined(d))


_SHOWN = ", ".join(f"CASE WHEN {m}_anomaly = 1 THEN printf('{n}(%.2f)', floor({m}_score * 100 + 0.5 + 1e-7) / 100) END" for m, n in V.METHOD_NAMES.items())
_FIRED = "list_filter([" + ", ".join(f"CASE WHEN flag_{n} = 1 THEN '{n}' END" for n in FLAGS) + "], lambda x: x IS NOT NULL)"
_SIGNS = ", ".join(f"CASE WHEN {c} = 1 THEN {{}} END".format("'" + n.replace("'", "''") + "'") for c, n in V.NETWORK_LABELS.items())
EXPLAINED = COMBINED + f""", ex0 AS (SELECT e.*, r.fired, n.network_rotation, n.network_monopolistic, n.network_suspicious_supplier, p.single_bidder_rate AS sbr, p.supplier_diversity_index AS div, p.competitive_rate AS cr
  FROM ens e JOIN (SELECT tender_id, buyer_id, {_FIRED} AS fired FROM ruled) r USING (tender_id) JOIN net_0 n USING (tender_id) LEFT JOIN buyer_p p ON p.buyer_id = r.buyer_id)
, explained AS (SELECT tender_id, consensus_count, CASE WHEN consensus_count < 2 THEN '' ELSE concat_ws(' | ',
   'Консенсус: ' || consensus_count || '/5 (' || concat_ws(', ', {_SHOWN}) || ')',
   CASE WHEN len(fired) > 0 THEN 'Правила: ' || array_to_string(fired[1:8], ', ') || CASE WHEN len(fired) > 8 THEN ' (+' || (len(fired) - 8) || ')' ELSE '' END END,
   CASE WHEN network_rotation + network_monopolistic + network_suspicious_supplier > 0 THEN 'Мережа: ' || concat_ws(', ', {_SIGNS}) END,
   CASE WHEN sbr > 0.5 OR div < 0.3 OR cr < 0.1 THEN 'Портрет: ' || concat_ws(', ', CASE WHEN sbr > 0.5 THEN printf('single_bidder=%.0f%%', sbr * 100) END,
     CASE WHEN div < 0.3 THEN printf('diversity=%.2f', div) END, CASE WHEN cr < 0.1 THEN printf('competitive=%.0f%%', cr * 100) END) END) END AS explanation FROM ex0)
"""


def _explained(d):
    return V.explanations(combined(d), d.tenders, d.ruled, d.networked, d.buyers)


@query("ens_explanations", EXPLAINED + "SELECT tender_id, consensus_count, explanation FROM explained")
def _(d):
    return _explained(d)


# --- reports on the vote ------------------------------------------------------------------------------------

@query("rep_critical_vs_normal", COMBINED + """, grp AS (SELECT CASE WHEN ensemble_risk_level = 'critical' THEN 'critical' ELSE 'normal' END AS grp, t.* FROM ens JOIN tenders t USING (tender_id)
WHERE ensemble_risk_level = 'critical' OR consensus_count = 0)
SELECT grp, count(*) AS tenders, round(avg(tender_value), 3) AS mean_value, round(median(tender_value), 3) AS median_value, round(avg(is_single_bidder), 6) AS single_bidder_rate,
round(avg(is_competitive), 6) AS competitive_rate, round(avg(CASE WHEN procurement_method = 'open' THEN 100.0::DOUBLE ELSE 0 END), 4) AS open_pct,
round(avg(CASE WHEN procurement_method = 'limited' THEN 100.0::DOUBLE ELSE 0 END), 4) AS limited_pct, round(avg(CASE WHEN procurement_method = 'selective' THEN 100.0::DOUBLE ELSE 0 END), 4) AS selective_pct FROM grp GROUP BY 1""")
def _(d):
    out = R.critical_vs_normal(combined(d), d.tenders)
    return rounded(out, mean_value=3, median_value=3, single_bidder_rate=6, competitive_rate=6, open_pct=4, limited_pct=4, selective_pct=4)


@query("rep_consensus_dist", COMBINED + "SELECT consensus_count, count(*) AS tenders, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM ens), 4) AS pct FROM ens GROUP BY 1")
def _(d):
    counts = R.value_counts(combined(d), "consensus_count")
    return counts.select("consensus_count", F.col("n").alias("tenders"), F.round(F.col("share") * 100, 4).alias("pct"))


@query("rep_critical_by_year", COMBINED + """SELECT year, count(*) FILTER (ensemble_risk_level = 'critical') AS critical, count(*) AS tenders,
round(count(*) FILTER (ensemble_risk_level = 'critical') * 100.0::DOUBLE / count(*), 4) AS pct FROM tenders JOIN ens USING (tender_id) GROUP BY 1 HAVING count(*) FILTER (ensemble_risk_level = 'critical') > 0""")
def _(d):
    return rounded(R.critical_by_year(combined(d), d.tenders), pct=4)


for _side in ("buyer", "supplier"):
    def _risky(side: str) -> None:
        @query("rep_top_risky_entities" if side == "buyer" else "rep_top_risky_suppliers", COMBINED + f"""SELECT {side}_id, count(*) AS critical, round(sum(tender_value), 2) AS total_value, round(avg(ensemble_score), 5) AS avg_score, '{side} ' || {side}_id AS {side}_name
        FROM ens JOIN tenders USING (tender_id) WHERE ensemble_risk_level = 'critical' AND {side}_id IS NOT NULL GROUP BY {side}_id ORDER BY critical DESC, {side}_id LIMIT 10""")
        def _(d):
            names = getattr(d, f"{side}s").select(f"{side}_id", f"{side}_name")
            return rounded(R.top_risky(combined(d), d.tenders, f"{side}_id", names), total_value=2, avg_score=5)

    _risky(_side)


@query("rep_critical_export", EXPLAINED + """SELECT tender_id, consensus_count, explanation, 'buyer ' || t.buyer_id AS buyer_name,
'supplier ' || t.supplier_id AS supplier_name, procurement_method, published_date FROM explained JOIN ens USING (tender_id, consensus_count) JOIN tenders t USING (tender_id) WHERE ensemble_risk_level = 'critical'""")
def _(d):
    out = R.critical_export(combined(d), _explained(d), d.tenders, d.buyers, d.suppliers)
    return out.select("tender_id", "consensus_count", "explanation", "buyer_name", "supplier_name", "procurement_method", "published_date")


# Names under which the vote of five was first registered.
for _name in ("ens_combine", "ens_method_stats", "ens_consensus_filter", "ens_critical", "ens_correlation", "ens_agreement", "ens_summary", "ens_explanations",
              "rep_critical_vs_normal", "rep_consensus_dist", "rep_critical_by_year", "rep_top_risky_entities", "rep_top_risky_suppliers", "rep_critical_export"):
    also(f"{_name}_five", _name)


# --- comparisons of methods on entity sets ------------------------------------------------------------------

_LEVELS = {"buyer": ("buyer_id",), "supplier": ("supplier_id",), "pair": ("buyer_id", "supplier_id")}
_ML = BUYER_Z + lof_sql("buyer") + forest_sql("buyer") + "".join(
    base + scaled_sql(level) + lof_sql(level) + forest_sql(level) for base, level in ((SUPPLIER_SQL, "supplier"), (PAIR_SQL, "pair")))
_ENTITY = {level: f"concat_ws('|', {', '.join(keys)})" for level, keys in _LEVELS.items()}
_NET = {"buyer": "network_monopolistic", "supplier": "network_suspicious_supplier", "pair": "network_monopolistic"}
_SETS = NETWORKED + _ML + ", named AS (" + " UNION ALL ".join(
    f"SELECT '{level}' AS level, {bit} AS bit, {_ENTITY[level]} AS entity FROM {table}_{level} WHERE anomaly = 1"
    for level in _LEVELS for bit, table in ((1, "if"), (2, "lof"))) + "".join(
    f" UNION SELECT DISTINCT '{level}', 4, {_ENTITY[level]} FROM networked JOIN (SELECT tender_id, buyer_id, supplier_id FROM tenders) USING (tender_id) WHERE {flag} = 1"
    for level, flag in _NET.items()) + """)
, marked AS (SELECT level, entity, bit_or(bit) AS mask, count(DISTINCT bit) AS methods FROM named GROUP BY 1, 2)
"""


def _models(d) -> dict:
    """Results by (level, algorithm) for both models at all three levels."""
    run = {"buyer": lambda a: anomaly.detect_buyers(d.tenders, d.buyers, a), "supplier": lambda a: anomaly.detect_suppliers(d.tenders, a),
           "pair": lambda a: anomaly.detect_pairs(d.tenders, algorithm=a)}
    return {(level, a): d.staged(f"{a}_{level}s", lambda level=level, a=a: run[level](a)) for level in run for a in ("iforest", "lof")}


def _marked(d):
    """(level, entity, mask, methods): bit 1 forest, 2 LOF, 4 network."""
    named = {key: df.where("anomaly = 1") for key, df in _models(d).items()}
    flagged = d.networked.join(d.tenders.select("tender_id", "buyer_id", "supplier_id"), "tender_id")
    named |= {(level, "network"): flagged.where(f"{flag} = 1").dropna(subset=list(_LEVELS[level])) for level, flag in _NET.items()}
    return d.staged("marked", lambda: R.method_masks(named, _LEVELS))


@query("rep_algo_sets", _SETS + """SELECT level, count(*) FILTER (mask & 3 = 1) AS iforest_only, count(*) FILTER (mask & 3 = 2) AS lof_only, count(*) FILTER (mask & 3 = 3) AS both,
round(coalesce(count(*) FILTER (mask & 3 = 3)::DOUBLE / nullif(count(*) FILTER (mask & 3 > 0), 0), 0), 6) AS jaccard
FROM (VALUES ('buyer'), ('supplier'), ('pair')) l(level) LEFT JOIN marked USING (level) GROUP BY 1""")
def _(d):
    return rounded(R.algorithm_sets(_marked(d)), jaccard=6)


@query("rep_high_consensus", _SETS + """SELECT level, entity, methods, concat_ws(',', CASE WHEN mask & 1 > 0 THEN 'iforest' END, CASE WHEN mask & 2 > 0 THEN 'lof' END, CASE WHEN mask & 4 > 0 THEN 'network' END) AS named_by,
round(coalesce(b.total_value, s.total_value, p.total_value), 2) AS total_value, CASE WHEN level <> 'supplier' THEN 'buyer ' || split_part(entity, '|', 1) END AS buyer_name,
CASE WHEN level <> 'buyer' THEN 'supplier ' || split_part(entity, '|', -1) END AS supplier_name
FROM marked LEFT JOIN buyer_p b ON level = 'buyer' AND entity = b.buyer_id::VARCHAR LEFT JOIN supplier_p s ON level = 'supplier' AND entity = s.supplier_id::VARCHAR
LEFT JOIN pair_p p ON level = 'pair' AND entity = p.buyer_id || '|' || p.supplier_id WHERE methods >= 2""")
def _(d):
    return rounded(R.high_consensus(_marked(d), d.buyers, d.suppliers, portraits.pair_portrait(d.tenders)), total_value=2)


_METRICS = {"iforest": "mask & 1 > 0", "lof": "mask & 2 > 0", "network": "mask & 4 > 0", "two_or_more": "methods >= 2", "all_three": "methods = 3"}


@query("rep_cross_method", _SETS + " UNION ALL ".join(
    f"SELECT '{level}' AS level, '{n}' AS metric, count(*) FILTER ({t}) AS value FROM marked WHERE level = '{level}'" for level in _LEVELS for n, t in _METRICS.items()))
def _(d):
    return R.cross_method(_marked(d))


@query("rep_algo_comparison", _ML + " UNION ALL ".join(
    f"SELECT '{level}' AS level, '{name}' AS algorithm, count(*) AS n, cast(sum(anomaly) AS BIGINT) AS anomalies, round(avg(anomaly) * 100, 6) AS rate_pct, round(avg(score), 5) AS mean_score, round(max(score), 5) AS max_score FROM {table}_{level}"
    for level in _LEVELS for name, table in (("iforest", "if"), ("lof", "lof"))))
def _(d):
    return rounded(R.algorithm_table(_models(d)), rate_pct=6, mean_score=5, max_score=5)
