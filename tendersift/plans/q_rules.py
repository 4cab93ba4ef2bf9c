"""Queries of the rule set (and the rule reports' base)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tendersift.functions import expr as E
from tendersift.operators import rules
from tendersift.plans.registry import query
from tendersift.plans.rules_sql import FLAGS, GRAINS, RULED, WEIGHTS, flag_sql, level_sql


def _one_rule(rule: rules.Rule) -> None:
    @query(
        f"{rule.id.lower()}_{rule.name}",
        f"{GRAINS} SELECT tender_id, {flag_sql(rule.name)} AS flag FROM wide",
    )
    def _(d):
        bids = d.bids if rule.requires_bids else None
        out = rules.detect(d.tenders, bids, enabled=[rule.id])
        return out.select("tender_id", F.col(rule.column).alias("flag"))


for _rule in rules.RULES:
    if _rule.test is not None:
        _one_rule(_rule)


@query("r013_high_limited_usage_low_cut", f"""{GRAINS}
SELECT tender_id, {flag_sql('', 'lim_rate > 0.2')} AS flag FROM wide""")
def _(d):
    wide = rules.enrich(d.tenders, None, ["buyer"])
    return wide.select("tender_id", E.flag(F.col("buyer_limited_rate") > 0.2).alias("flag"))


_RESULT = "tender_id, rule_risk_score, rule_flags_count, rule_risk_level"


@query("rule_detect", f"{RULED} SELECT {_RESULT}, " + ", ".join(f"flag_{n}" for n in FLAGS) + " FROM ruled")
def _(d):
    return d.ruled.select(*_RESULT.split(", "), *rules.flag_columns(d.ruled))


@query("rule_full_scan", f"{RULED} SELECT {_RESULT} FROM ruled")
def _(d):
    return rules.full_scan(d.tenders, d.bids, d.buyers, d.suppliers).select(*_RESULT.split(", "))


_PICK = ("missing_documents", "price_increase", "weekend_publication", "round_bid_prices")
_PICK_SCORE = " + ".join(f"{WEIGHTS[n]} * {flag_sql(n)}" for n in _PICK)


@query("rule_select", f"""{GRAINS} SELECT tender_id, {_PICK_SCORE} AS rule_risk_score,
{' + '.join(flag_sql(n) for n in _PICK)} AS rule_flags_count FROM wide""")
def _(d):
    out = rules.detect(d.tenders, d.bids, enabled=["R005", "R069", "X001", "R023", "X003"], disabled=["X003"])
    return out.select("tender_id", "rule_risk_score", "rule_flags_count")


@query("rule_risk_level", f"{RULED} SELECT tender_id, rule_risk_level FROM ruled")
def _(d):
    return d.ruled.select("tender_id", E.rule_level(F.col("rule_risk_score")).alias("rule_risk_level"))


_CATALOG = ", ".join("('{}', {}, {}, {}, '{}')".format(r.name, r.weight, r.requires_bids, r.requires_aggregation, rules.DESCRIPTIONS[r.id].replace("'", "''"))
                     for r in rules.RULES)


@query("rule_catalog", f"""{RULED}
, up AS (UNPIVOT (SELECT {', '.join('flag_' + n for n in FLAGS)} FROM ruled) ON COLUMNS(*) INTO NAME flag VALUE v)
, rw(name, weight, needs_bids, needs_groups, description) AS (VALUES {_CATALOG})
SELECT substring(flag, 6) AS name, rw.weight, rw.needs_bids AS requires_bids, rw.needs_groups AS requires_aggregation, rw.description,
cast(sum(v) AS BIGINT) AS fired, cast(sum(v) * rw.weight AS BIGINT) AS points
FROM up JOIN rw ON rw.name = substring(flag, 6) GROUP BY 1, 2, 3, 4, 5""")
def _(d):
    counts = rules.unpivot_sums(d.ruled, rules.flag_columns(d.ruled)).select(
        F.expr("substring(flag, 6)").alias("name"), F.col("count").alias("fired"))
    return counts.join(rules.catalog(d.spark), "name").select(
        "name", "weight", "requires_bids", "requires_aggregation", "description", "fired", (F.col("fired") * F.col("weight")).alias("points"))


_META = ", ".join(
    f"('{r.id}', '{r.name}', '{r.title.replace(chr(39), chr(39) * 2)}', '{r.category}', '{r.severity}')"
    for r in rules.RULES
)
_SUMMARY = f"""{RULED}
, up AS (UNPIVOT (SELECT {', '.join('flag_' + n for n in FLAGS)} FROM ruled) ON COLUMNS(*) INTO NAME flag VALUE v)
, meta(id, name, name_ua, category, severity) AS (VALUES {_META})
, summary AS (
  SELECT m.id, m.name, m.name_ua, m.category, m.severity, cast(sum(v) AS BIGINT) AS count,
         round(sum(v) * 100.0::DOUBLE / count(*), 2) AS percentage
  FROM up JOIN meta m ON 'flag_' || m.name = flag GROUP BY ALL)
"""


@query("rule_summary", _SUMMARY + "SELECT * FROM summary")
def _(d):
    return rules.summary(d.ruled)


for _by in ("category", "severity"):
    def _register(by: str) -> None:
        @query(f"rule_summary_by_{by}", _SUMMARY + f"""SELECT {by}, cast(sum(count) AS BIGINT) AS count,
        count(id) AS rules_triggered FROM summary GROUP BY 1""")
        def _(d):
            return rules.summary_by(d.ruled, by)

    _register(_by)


@query("rule_risk_distribution", f"""{RULED} SELECT rule_risk_level AS risk_level, count(*) AS count,
round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM ruled), 2) AS percentage FROM ruled GROUP BY 1""")
def _(d):
    return rules.distribution(d.ruled, "rule_risk_level")


@query("rule_get_flagged", f"""{RULED} SELECT {_RESULT} FROM ruled
WHERE rule_risk_score >= 4 AND rule_flags_count >= 3 AND rule_risk_level = 'high'""")
def _(d):
    return rules.flagged(d.ruled, min_score=4, min_flags=3, level="high").select(*_RESULT.split(", "))


@query("rule_get_critical", f"{RULED} SELECT {_RESULT} FROM ruled WHERE rule_risk_level = 'critical'")
def _(d):
    return rules.flagged(d.ruled, level="critical").select(*_RESULT.split(", "))


@query("rule_get_high_risk", f"{RULED} SELECT {_RESULT} FROM ruled WHERE rule_risk_score >= 6")
def _(d):
    return rules.flagged(d.ruled, min_score=6).select(*_RESULT.split(", "))


_BY_NAME = {r.name: r for r in rules.RULES}
_QUOTED = {n: rules.DESCRIPTIONS[r.id].replace("'", "''") for n, r in _BY_NAME.items()}
_FIRED = " || ".join(f"CASE WHEN flag_{n} = 1 THEN '{_BY_NAME[n].id}:{_BY_NAME[n].severity}:{_QUOTED[n]};' ELSE '' END" for n in FLAGS)


@query("rule_explain", f"""{RULED} SELECT tender_id, rule_risk_score AS risk_score, rule_risk_level AS risk_level,
rule_flags_count AS flags_count, {_FIRED} AS fired FROM ruled""")
def _(d):
    out = rules.explain(d.ruled)
    text = F.transform("flags", lambda s: F.concat(s["id"], F.lit(":"), s["severity"], F.lit(":"), s["description"], F.lit(";")))
    return out.select("tender_id", "risk_score", "risk_level", "flags_count", F.array_join(text, "").alias("fired"))


_QUICK = [rules.BY_ID[i].name for i in rules.QUICK]
_QUICK_SCORE = "(" + " + ".join(f"{WEIGHTS[n]} * {flag_sql(n)}" for n in _QUICK) + ")"


@query("rule_quick_scan", f"""SELECT tender_id, {', '.join(f"{flag_sql(n)} AS flag_{n}" for n in _QUICK)},
{_QUICK_SCORE} AS rule_risk_score, {level_sql(_QUICK_SCORE, (-1, 2, 5, 10, 1000))} AS rule_risk_level FROM tenders""")
def _(d):
    out = rules.quick_scan(d.tenders)
    return out.select("tender_id", *rules.flag_columns(out), "rule_risk_score", "rule_risk_level")
