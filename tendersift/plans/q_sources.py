"""Queries of the loaders, scalar functions and joins."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from tendersift import schemas as S
from tendersift.functions import expr as E
from tendersift.plans.network_sql import NETWORKED
from tendersift.plans.registry import Data, query, rounded
from tendersift.plans.rules_sql import RULED
from tendersift.plans.screens_sql import SCREENED
from tendersift.sources import readers
from tendersift.staging import stage_folder

# --- sources and sinks ------------------------------------------------------------------------------------


def _export(d: Data, root: str) -> None:
    tagged = d.bids.join(d.tenders.select("tender_id", "year"), "tender_id")
    readers.write_result(d.tenders, f"{root}/tenders", "csv", ["year"])
    readers.write_result(tagged, f"{root}/bids", "csv", ["year"])
    for name in ("buyers", "suppliers", "bidders"):
        readers.write_result(getattr(d, name), f"{root}/{name}.csv", "csv")


def _exported(d: Data) -> str:
    """The derived tables written in the CSV layout the loaders read: years as partitions."""
    return stage_folder(d.spark, d.folder, "csv", lambda root: _export(d, root))


def _years(d: Data) -> list[int]:
    return sorted(r.year for r in d.tenders.select("year").distinct().collect())


_T = "CAST(tender_id AS VARCHAR) AS tender_id, CAST(buyer_id AS VARCHAR) AS buyer_id, procurement_method"
_TCOLS = ["tender_id", "buyer_id", "procurement_method", "tender_value", "is_weekend", "published_date"]


@query("src_tenders", f"""SELECT {_T}, round(tender_value, 6) AS tender_value, is_weekend, published_date FROM tenders""")
def _(d):
    out = readers.load_tenders(d.spark, _exported(d), years=[*_years(d), 1900], columns=[*_TCOLS, "unknown"])
    return rounded(out, tender_value=6).withColumn("is_weekend", F.col("is_weekend").cast("int"))


@query("src_tenders_sampled")
def _(d):
    return readers.load_tenders(d.spark, _exported(d), years=_years(d), columns=_TCOLS, sample_frac=0.25)


@query("src_bids", """SELECT CAST(tender_id AS VARCHAR) AS tender_id, bid_id, round(bid_amount, 6) AS bid_amount,
bid_status, bid_date, is_winner FROM bids""")
def _(d):
    out = readers.load_bids(d.spark, _exported(d), years=_years(d),
                            columns=["tender_id", "bid_id", "bid_amount", "bid_status", "bid_date", "is_winner"])
    return rounded(out, bid_amount=6).withColumn("is_winner", F.col("is_winner").cast("int"))


@query("src_buyers", """SELECT CAST(buyer_id AS VARCHAR) AS buyer_id, 'region ' || buyer_id % 5 AS buyer_region,
count(*) AS total_tenders, round(sum(tender_value), 2) AS total_value FROM tenders GROUP BY buyer_id""")
def _(d):
    out = readers.load_buyers(d.spark, _exported(d)).select("buyer_id", "buyer_region", "total_tenders", "total_value")
    return rounded(out, total_value=2)


@query("src_suppliers", """SELECT CAST(supplier_id AS VARCHAR) AS supplier_id, count(*) AS total_awards,
round(sum(tender_value), 2) AS total_value FROM tenders GROUP BY supplier_id""")
def _(d):
    out = readers.load_suppliers(d.spark, _exported(d)).select("supplier_id", "total_awards", "total_value")
    return rounded(out, total_value=2)


@query("src_bidders", """SELECT CAST(bidder_id AS VARCHAR) AS bidder_id, count(*) AS total_bids,
count(DISTINCT tender_id) AS unique_tenders, count(DISTINCT buyer_id) AS unique_buyers,
min(bid_date) AS first_bid_date, max(bid_date) AS last_bid_date
FROM bids JOIN tenders USING (tender_id) GROUP BY bidder_id""")
def _(d):
    return readers.load_bidders(d.spark, _exported(d))


for _method in (S.OPEN, S.LIMITED, S.SELECTIVE):
    def _by_method(method: str) -> None:
        @query(f"src_{method}", f"SELECT {_T} FROM tenders WHERE procurement_method = '{method}'")
        def _(d):
            load = getattr(readers, f"load_{method}_tenders")
            return load(d.spark, _exported(d), years=_years(d), columns=_TCOLS[:3])

    _by_method(_method)


@query("src_missing_year", "SELECT count(*) AS n FROM tenders WHERE year = (SELECT min(year) FROM tenders)")
def _(d):
    first = _years(d)[0]
    out = readers.load_tenders(d.spark, _exported(d), years=[first - 100, first])
    return out.agg(F.count("*").alias("n"))


@query("src_year_tag", "SELECT tender_id, year FROM tenders")
def _(d):
    frames = {y: d.tenders.where(F.col("year") == y).select("tender_id") for y in _years(d)}
    return readers.tag_year(frames)


@query("src_overview")
def _(d):
    return readers.overview(d.spark, _exported(d))


_MAPPED = ("tender_id buyer_id supplier_id procurement_method award_criteria main_cpv_2_digit tender_value award_value published_date "
           "award_date year month quarter day_of_week is_weekend is_q4 is_december number_of_bids number_of_tenderers "
           "has_unsuccessful_awards has_cancelled_awards has_enquiries number_of_documents is_single_bidder is_competitive "
           "is_cross_region is_buyer_masked is_supplier_masked price_change_pct discount_percentage_avg").split()
_NULLS = " + ".join(f"avg(CASE WHEN {c} IS NULL THEN 1.0::DOUBLE ELSE 0 END)" for c in _MAPPED)


@query("profile_validate", f"SELECT 'tenders' AS name, count(*) AS rows, round(({_NULLS}) / {len(_MAPPED)}, 6) AS mean_null_rate FROM tenders")
def _(d):
    return rounded(readers.validate(d.tenders.select(*_MAPPED), ["tender_id", "supplier_id"], "tenders"), mean_null_rate=6)


@query("src_require", "SELECT count(*) AS n FROM bids")
def _(d):
    root = _exported(d)
    for y in _years(d):
        readers.require_file(d.spark, f"{root}/bids/year={y}", "run the export first")
    return readers.load_bids(d.spark, root, years=_years(d)).agg(F.count("*").alias("n"))


@query("sink_csv", """SELECT procurement_method, count(*) AS n, round(sum(tender_value), 2) AS total_value
FROM tenders GROUP BY 1""")
def _(d):
    path = os.path.join(_exported(d), "method_summary_parquet")
    readers.write_result(d.tenders.groupBy("procurement_method").agg(
        F.count("*").alias("n"), F.sum("tender_value").alias("total_value")), path)
    return rounded(d.spark.read.parquet(path), total_value=2)


# --- projections, filters and scalar functions --------------------------------------------------------------

@query("prj_columns", "SELECT tender_id, tender_value FROM tenders")
def _(d):
    return readers.pick(d.tenders, ["tender_id", "no_such_column", "tender_value"])


@query("flt_equals", "SELECT tender_id FROM tenders WHERE procurement_method = 'open' AND is_weekend = 1")
def _(d):
    return d.tenders.where((F.col("procurement_method") == "open") & (F.col("is_weekend") == 1)).select("tender_id")


@query("flt_isin", "SELECT tender_id FROM tenders WHERE procurement_method IN ('open', 'selective')")
def _(d):
    return d.tenders.where(E.competitive_method()).select("tender_id")


@query("flt_range", "SELECT tender_id FROM tenders WHERE tender_value >= 40000 AND tender_value < 50000")
def _(d):
    return d.tenders.where(E.between_open(F.col("tender_value"), 40000, 50000)).select("tender_id")


@query("flt_prefix", "SELECT bid_id FROM bids WHERE starts_with(bid_id, '12')")
def _(d):
    return d.bids.where(F.coalesce(F.startswith("bid_id", F.lit("12")), F.lit(False))).select("bid_id")


@query("sc_fillna", "SELECT tender_id, coalesce(award_criteria, 'none') AS criteria, coalesce(supplier_id, -1) AS supplier FROM tenders")
def _(d):
    return d.tenders.select("tender_id", F.coalesce("award_criteria", F.lit("none")).alias("criteria"),
                            F.coalesce("supplier_id", F.lit(-1)).alias("supplier"))


@query("sc_nullif_zero", """SELECT tender_id, round(tender_value / nullif(number_of_documents, 0), 6) AS per_document,
CASE WHEN number_of_documents = 0 THEN 1 ELSE 0 END AS no_documents FROM tenders""")
def _(d):
    return d.tenders.select(
        "tender_id", F.round(E.ratio(F.col("tender_value"), F.col("number_of_documents")), 6).alias("per_document"),
        E.flag(F.col("number_of_documents") == 0).alias("no_documents"))


@query("sc_mod_round", """SELECT tender_id, CASE WHEN tender_value % 1000 = 0 THEN 1 ELSE 0 END AS r1000,
CASE WHEN tender_value % 10000 = 0 THEN 1 ELSE 0 END AS r10000,
CASE WHEN tender_value % 100000 = 0 THEN 1 ELSE 0 END AS r100000,
CASE WHEN cast(floor(tender_value) AS BIGINT) % 100 = 99 THEN 1 ELSE 0 END AS ends99 FROM tenders""")
def _(d):
    v = F.col("tender_value")
    steps = [E.flag(E.divisible(v, s)).alias(f"r{s}") for s in (1000, 10000, 100000)]
    return d.tenders.select("tender_id", *steps, E.flag(E.ends_with_99(v)).alias("ends99"))


@query("sc_first_digit", """SELECT bid_id, cast(left(cast(cast(floor(bid_amount) AS BIGINT) AS VARCHAR), 1) AS INT) AS digit
FROM bids""")
def _(d):
    return d.bids.select("bid_id", E.first_digit(F.col("bid_amount")).alias("digit"))


@query("sc_abs_pow_clip", """SELECT tender_id, round(abs(price_change_pct), 4) AS a, round(pow(price_change_pct, 2), 2) AS sq,
round(greatest(least(price_change_pct, 100), -50), 4) AS clipped FROM tenders WHERE price_change_pct IS NOT NULL""")
def _(d):
    p = F.col("price_change_pct")
    return d.tenders.where(p.isNotNull()).select(
        "tender_id", F.round(F.abs(p), 4).alias("a"), F.round(F.pow(p, 2), 2).alias("sq"),
        F.round(F.greatest(F.least(p, F.lit(100.0)), F.lit(-50.0)), 4).alias("clipped"))


@query("sc_log", """SELECT tender_id, round(ln(1 + greatest(price_change_pct, 0)), 6) AS l1p, round(log10(tender_value), 6) AS l10
FROM tenders WHERE tender_value > 0 AND price_change_pct IS NOT NULL""")
def _(d):
    return d.tenders.where("tender_value > 0 AND price_change_pct IS NOT NULL").select(
        "tender_id", F.round(E.log1p_clipped(F.col("price_change_pct")), 6).alias("l1p"),
        F.round(F.log10("tender_value"), 6).alias("l10"))


@query("sc_round", """SELECT tender_id, round_even(cast(number_of_bids AS DOUBLE) / 8, 2) AS half_even FROM tenders""")
def _(d):
    return d.tenders.select("tender_id", F.bround(F.col("number_of_bids") / 8, 2).alias("half_even"))


@query("sc_bucket", """SELECT tender_id, CASE WHEN tender_value < 50000 THEN '<50K' WHEN tender_value < 200000 THEN '50K-200K'
WHEN tender_value < 1000000 THEN '200K-1M' WHEN tender_value < 10000000 THEN '1M-10M' ELSE '>10M' END AS band,
CASE WHEN number_of_bids > 1 AND number_of_bids <= 4 THEN 'medium' WHEN number_of_bids > 4 AND number_of_bids <= 8 THEN 'high'
WHEN number_of_bids > 8 AND number_of_bids <= 100 THEN 'critical' WHEN number_of_bids > -0.1 AND number_of_bids <= 1 THEN 'low' END AS level
FROM tenders""")
def _(d):
    return d.tenders.select("tender_id", E.value_band(F.col("tender_value")).alias("band"),
                            E.stat_level(F.col("number_of_bids")).alias("level"))


@query("sc_to_ts", """SELECT tender_id, published_date AS parsed, CAST(NULL AS TIMESTAMP) AS broken FROM tenders""")
def _(d):
    text = F.date_format("published_date", "yyyy-MM-dd'T'HH:mm:ss")
    return d.tenders.select("tender_id", E.lenient_timestamp(text).alias("parsed"),
                            E.lenient_timestamp(F.concat(F.lit("n/a "), text)).alias("broken"))


@query("sc_date_parts", """SELECT tender_id, cast(published_date AS DATE)::VARCHAR AS d, strftime(published_date, '%Y-%m') AS ym,
month, quarter, day_of_week FROM tenders""")
def _(d):
    p = F.col("published_date")
    return d.tenders.select(
        "tender_id", F.to_date(p).cast("string").alias("d"), F.date_format(F.date_trunc("month", p), "yyyy-MM").alias("ym"),
        F.month(p).alias("month"), F.quarter(p).alias("quarter"), F.weekday(p).alias("day_of_week"))


@query("sc_duration", """SELECT tender_id, cast(trunc((epoch(award_date) - epoch(published_date)) / 86400) AS BIGINT) AS days
FROM tenders WHERE award_date IS NOT NULL""")
def _(d):
    return d.tenders.where("award_date IS NOT NULL").select(
        "tender_id", E.whole_days(F.col("published_date"), F.col("award_date")).alias("days"))


_NAMES = " ".join(f"WHEN {k} THEN '{v}'" for k, v in S.CPV_NAMES.items())


@query("sc_lookup", f"SELECT tender_id, CASE main_cpv_2_digit {_NAMES} ELSE 'Інше' END AS cpv_name FROM tenders")
def _(d):
    return d.tenders.select(
        "tender_id", E.lookup(F.col("main_cpv_2_digit").cast("int"), S.CPV_NAMES, "Інше").alias("cpv_name"))


@query("sc_string_fmt", """SELECT tender_id, concat_ws(', ', 'B_' || buyer_id, 'S_' || supplier_id) AS nodes,
printf('%.1f%%', number_of_documents * 100.0 / 8) AS share, left(procurement_method, 3) AS short,
replace('B_' || buyer_id, 'B_', '') AS bare FROM tenders""")
def _(d):
    node = F.concat(F.lit("B_"), F.col("buyer_id"))
    return d.tenders.select(
        "tender_id", F.concat_ws(", ", node, F.concat(F.lit("S_"), F.col("supplier_id"))).alias("nodes"),
        F.format_string("%.1f%%", F.col("number_of_documents") * 100.0 / 8).alias("share"),
        F.substring("procurement_method", 1, 3).alias("short"),
        F.regexp_replace(node, "^B_", "").alias("bare"))


@query("sc_filter_list", """SELECT tender_id, array_to_string(list_slice(list_sort(list_distinct(list(bidder_id) FILTER (bidder_id % 2 = 0))), 1, 8), ',') AS even_bidders,
len(list_distinct(list(bidder_id) FILTER (bidder_id % 2 = 0))) AS n FROM bids GROUP BY 1 HAVING count(*) FILTER (bidder_id % 2 = 0) > 0""")
def _(d):
    # A tender has at most a 16-bit number of bids, so its list is bounded.
    lists = d.bids.groupBy("tender_id").agg(F.collect_list("bidder_id").alias("b"))
    even = F.array_distinct(F.filter("b", lambda x: x.isNotNull() & (x % 2 == 0)))
    return lists.where(F.size(even) > 0).select(
        "tender_id", F.array_join(F.transform(F.slice(F.array_sort(even), 1, 8), lambda x: x.cast("string")), ",").alias("even_bidders"),
        F.size(even).cast("long").alias("n"))


# --- joins ------------------------------------------------------------------------------------------------

@query("join_tenders_buyers", """, bp AS (SELECT buyer_id, count(*) AS total_tenders, avg(is_single_bidder) AS sbr FROM tenders GROUP BY 1)
SELECT tender_id, 'buyer ' || t.buyer_id AS buyer_name, total_tenders, round(sbr, 6) AS single_bidder_rate, year
FROM tenders t LEFT JOIN bp USING (buyer_id)""")
def _(d):
    out = readers.merge_with_buyers(d.tenders, d.buyers)
    return out.select("tender_id", "buyer_name", "total_tenders", F.round("single_bidder_rate", 6).alias("single_bidder_rate"), "year")


@query("join_tenders_suppliers", """, sp AS (SELECT supplier_id, count(*) AS total_awards, sum(tender_value) AS v FROM tenders GROUP BY 1)
SELECT tender_id, CASE WHEN t.supplier_id IS NOT NULL THEN 'supplier ' || t.supplier_id END AS supplier_name, total_awards,
round(v, 2) AS total_value FROM tenders t LEFT JOIN sp ON t.supplier_id = sp.supplier_id""")
def _(d):
    out = readers.merge_with_suppliers(d.tenders, d.suppliers)
    return rounded(out.select("tender_id", "supplier_name", "total_awards", "total_value"), total_value=2)


@query("join_rule_buyers", """, bp AS (SELECT buyer_id, avg(is_single_bidder) AS sbr, avg(is_competitive) AS cr,
(count(DISTINCT supplier_id) + max(CASE WHEN supplier_id IS NULL THEN 1 ELSE 0 END))::DOUBLE / count(*) AS div FROM tenders GROUP BY 1)
SELECT tender_id, round(sbr, 6) AS single_bidder_rate, round(cr, 6) AS competitive_rate, round(div, 6) AS supplier_diversity_index,
'region ' || t.buyer_id % 5 AS buyer_region FROM tenders t LEFT JOIN bp USING (buyer_id)""")
def _(d):
    from tendersift.operators.rules import attach_buyers
    out = attach_buyers(d.tenders, d.buyers).select(
        "tender_id", "single_bidder_rate", "competitive_rate", "supplier_diversity_index", "buyer_region")
    return rounded(out, single_bidder_rate=6, competitive_rate=6, supplier_diversity_index=6)


@query("join_rule_suppliers", """, sp AS (SELECT supplier_id, count(*) AS n, sum(tender_value) AS v FROM tenders WHERE supplier_id IS NOT NULL GROUP BY 1)
SELECT tender_id, n AS total_awards, round(v, 2) AS total_value FROM tenders t LEFT JOIN sp USING (supplier_id)""")
def _(d):
    from tendersift.operators.rules import attach_suppliers
    return rounded(attach_suppliers(d.tenders, d.suppliers).select("tender_id", "total_awards", "total_value"), total_value=2)


@query("join_tenders_with_bids", """, n AS (SELECT tender_id, count(*) AS actual_bid_count FROM bids GROUP BY 1)
SELECT tender_id, procurement_method, actual_bid_count FROM tenders JOIN n USING (tender_id) WHERE actual_bid_count >= 4""")
def _(d):
    return readers.tenders_with_bids(d.tenders, d.bids, 4).select("tender_id", "procurement_method", "actual_bid_count")


@query("join_stat_lookup", """, s AS (SELECT main_cpv_2_digit AS cpv, avg(tender_value) AS m, count(*) AS n FROM tenders WHERE main_cpv_2_digit IS NOT NULL GROUP BY 1)
SELECT tender_id, round(m, 2) AS cpv_value_mean, n AS cpv_count FROM tenders LEFT JOIN s ON main_cpv_2_digit = cpv""")
def _(d):
    stats = d.tenders.where("main_cpv_2_digit IS NOT NULL").groupBy("main_cpv_2_digit").agg(
        F.round(F.avg("tender_value"), 2).alias("cpv_value_mean"), F.count("*").alias("cpv_count"))
    return d.tenders.join(stats, "main_cpv_2_digit", "left").select("tender_id", "cpv_value_mean", "cpv_count")


@query("join_semi_flag", """SELECT tender_id, CASE WHEN tender_id IN (SELECT tender_id FROM bids WHERE bid_status = 'disqualified') THEN 1 ELSE 0 END AS flag
FROM tenders""")
def _(d):
    marked = d.bids.where("bid_status = 'disqualified'").select("tender_id").distinct().withColumn("m", F.lit(1))
    return d.tenders.join(marked, "tender_id", "left").select("tender_id", F.coalesce("m", F.lit(0)).alias("flag"))


@query("join_cobid_self", """, x AS (SELECT DISTINCT tender_id, bidder_id FROM bids)
SELECT a.bidder_id AS src, b.bidder_id AS dst, count(*) AS n FROM x a JOIN x b ON a.tender_id = b.tender_id AND a.bidder_id < b.bidder_id GROUP BY 1, 2""")
def _(d):
    from tendersift.operators.edges import bidder_pairs
    return bidder_pairs(d.bids, 1).select("src", "dst", F.col("weight").alias("n"))


@query("join_reciprocal", """, pr AS (SELECT supplier_id AS w, bidder_id AS l, count(*) AS n FROM (SELECT DISTINCT t.tender_id, supplier_id, bidder_id
 FROM tenders t JOIN bids b USING (tender_id) WHERE supplier_id <> bidder_id) GROUP BY 1, 2)
SELECT a.w AS bidder_1, a.l AS bidder_2, a.n AS n12, b.n AS n21 FROM pr a JOIN pr b ON a.w = b.l AND a.l = b.w WHERE a.w < a.l""")
def _(d):
    from tendersift.operators.edges import reciprocal, winner_loser_edges
    out = reciprocal(winner_loser_edges(d.bids, d.tenders, 1))
    return out.select("bidder_1", "bidder_2", F.col("wins_1_over_2").alias("n12"), F.col("wins_2_over_1").alias("n21"))


@query("join_outer_methods", RULED + SCREENED + NETWORKED + """, a AS (SELECT tender_id, rule_risk_score AS rule_score FROM ruled WHERE rule_risk_score >= 6)
, s AS (SELECT tender_id, stat_score FROM screened WHERE stat_anomaly = 1), n AS (SELECT tender_id, network_score FROM networked WHERE network_anomaly = 1)
SELECT tender_id, coalesce(rule_score, 0)::DOUBLE AS rule_score, (rule_score IS NOT NULL)::INT AS rule_anomaly, round(coalesce(stat_score, 0)::DOUBLE, 6) AS stat_score, (stat_score IS NOT NULL)::INT AS stat_anomaly,
round(coalesce(network_score, 0)::DOUBLE, 6) AS network_score, (network_score IS NOT NULL)::INT AS network_anomaly FROM a FULL OUTER JOIN s USING (tender_id) FULL OUTER JOIN n USING (tender_id)""")
def _(d):
    from tendersift.operators.ensemble import union_methods
    found = {"rule": d.ruled.where("rule_risk_score >= 6").withColumnRenamed("rule_risk_score", "rule_score"),
             "stat": d.screened.where("stat_anomaly = 1"), "network": d.networked.where("network_anomaly = 1")}
    frames = {m: df.select("tender_id", F.col(f"{m}_score").cast("double").alias(f"{m}_score"), F.lit(1).alias(f"{m}_anomaly")) for m, df in found.items()}
    return rounded(union_methods(frames), stat_score=6, network_score=6)


@query("join_report_names", """SELECT buyer_id, 'buyer ' || buyer_id AS buyer_name, supplier_id, 'supplier ' || supplier_id AS supplier_name, count(*) AS n
FROM tenders WHERE supplier_id IS NOT NULL GROUP BY buyer_id, supplier_id HAVING count(*) >= 3""")
def _(d):
    from tendersift.operators.portraits import pair_stats
    pairs = pair_stats(d.tenders).where("pair_count >= 3")
    named = pairs.join(d.buyers.select("buyer_id", "buyer_name"), "buyer_id", "left").join(
        d.suppliers.select("supplier_id", "supplier_name"), "supplier_id", "left")
    return named.select("buyer_id", "buyer_name", "supplier_id", "supplier_name", F.col("pair_count").alias("n"))
