"""Report queries over tenders and detector results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tendersift.functions import expr as E
from tendersift.operators.quantiles import exact_quantiles, one_row
from tendersift.operators.rules import unpivot_sums


def value_counts(df: DataFrame, column: str) -> DataFrame:
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    total = one_row(counts.agg(F.sum("n").alias("t")), "t")["t"]
    return counts.select(column, "n", (F.col("n") / total).alias("share"))


def describe(df: DataFrame, column: str) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles as one row."""
    c = F.col(column)
    base = df.agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
                  F.min(c).alias("lowest"), F.max(c).alias("highest"))
    q = exact_quantiles(df, [], {"q1": (c, 0.25), "q2": (c, 0.5), "q3": (c, 0.75)})
    return base.withColumn("_q", one_row(q, "q1", "q2", "q3")).select("*", "_q.*").drop("_q")


def counts_by(df: DataFrame, column: Column, name: str) -> DataFrame:
    return df.groupBy(column.alias(name)).agg(F.count("*").alias("tenders"))


def percent(column: str, name: str) -> Column:
    return (F.avg(column) * 100).alias(name)


def headline_rates(tenders: DataFrame, *keys: str) -> DataFrame:
    grouped = tenders.groupBy(*keys) if keys else tenders.groupBy()
    return grouped.agg(
        percent("is_weekend", "weekend_pct"), percent("is_q4", "q4_pct"), percent("is_december", "december_pct"),
        percent("is_cross_region", "cross_region_pct"), percent("is_competitive", "competitive_pct"),
        percent("is_single_bidder", "single_bidder_pct"), percent("is_buyer_masked", "masked_buyer_pct"),
        percent("is_supplier_masked", "masked_supplier_pct"), F.avg("number_of_tenderers").alias("avg_tenderers"))


def region_totals(buyers: DataFrame, column: str, top: int = 20) -> DataFrame:
    return buyers.groupBy("buyer_region").agg(F.sum(column).alias(column)).orderBy(F.desc(column), "buyer_region").limit(top)


def top_by(df: DataFrame, column: str, key: str, top: int) -> DataFrame:
    return df.orderBy(F.desc(column), key).limit(top)


def price_change(tenders: DataFrame) -> DataFrame:
    """Savings, overpayments and extremes of tenders with a positive value and award."""
    p = F.col("price_change_pct")
    valid = tenders.where((F.col("tender_value") > 0) & (F.col("award_value") > 0))
    count = lambda t: F.sum(E.flag(t))
    mean = lambda t: F.avg(F.when(t, p))
    return valid.agg(
        F.count("*").alias("n"), F.avg(p).alias("mean_change"), count(p > 0).alias("savings"), mean(p > 0).alias("mean_saving"),
        count(p < 0).alias("overpay"), mean(p < 0).alias("mean_overpay"), count(p == 0).alias("no_change"),
        count(p > 50).alias("extreme_discount"), count(p < -20).alias("extreme_overpay"))


def fraud_points(tenders: DataFrame) -> DataFrame:
    points = (
        F.col("is_single_bidder") * 2 + F.col("is_weekend") + F.col("is_buyer_masked") + F.col("is_supplier_masked")
        + E.flag(F.col("price_change_pct") < -20) * 2
    )
    return tenders.withColumn("fraud_score", points)


def supplier_shares(suppliers: DataFrame, top: int = 20) -> DataFrame:
    total = one_row(suppliers.agg(F.sum("total_awards").alias("t")), "t")["t"]
    known = suppliers.where("supplier_id IS NOT NULL")
    return top_by(known, "total_awards", "supplier_id", top).select(
        "supplier_id", "total_awards", (F.col("total_awards") / total * 100).alias("share_pct"))


def cpv_competition(tenders: DataFrame, min_tenders: int = 10_000) -> DataFrame:
    return (
        tenders.where("main_cpv_2_digit IS NOT NULL").groupBy("main_cpv_2_digit")
        .agg(F.count("*").alias("tenders"), percent("is_single_bidder", "single_bidder_pct"))
        .where(F.col("tenders") >= min_tenders).orderBy(F.desc("single_bidder_pct"), "main_cpv_2_digit")
    )


def headline_summary(tenders: DataFrame, buyers: DataFrame, suppliers: DataFrame, bidders: DataFrame) -> DataFrame:
    """Ten headline numbers in one row."""
    base = tenders.agg(
        F.count("*").alias("total_tenders"), F.sum("tender_value").alias("total_value"),
        percent("is_competitive", "competitive_rate"), percent("is_single_bidder", "single_bidder_rate"),
        F.avg("number_of_tenderers").alias("avg_tenderers"), F.avg("price_change_pct").alias("avg_price_change_pct"))
    median = exact_quantiles(tenders, [], {"median_tender_value": (F.col("tender_value"), 0.5)})
    n = lambda df: df.agg(F.count("*")).scalar()
    return base.select(
        "total_tenders", n(buyers).alias("total_buyers"), n(suppliers).alias("total_suppliers"), n(bidders).alias("total_bidders"),
        (F.col("total_value") / 1e12).alias("total_value_trillion"), "competitive_rate", "single_bidder_rate", "avg_tenderers",
        median.scalar().alias("median_tender_value"), "avg_price_change_pct")


# --- rule results -------------------------------------------------------------------------------------------

def risk_by_method(results: DataFrame) -> DataFrame:
    """Levels per procurement method with row percentages, and mean, median and largest score."""
    wide = results.groupBy("procurement_method").pivot("rule_risk_level", list(E.LEVELS)).count().fillna(0)
    total = sum((F.col(x) for x in E.LEVELS[1:]), F.col(E.LEVELS[0]))
    scores = results.groupBy("procurement_method").agg(
        F.avg("rule_risk_score").alias("mean_score"), F.median("rule_risk_score").alias("median_score"),
        F.max("rule_risk_score").alias("max_score"))
    shares = [(F.col(x) / total * 100).alias(f"{x}_pct") for x in E.LEVELS]
    return wide.select("procurement_method", *E.LEVELS, *shares).join(scores, "procurement_method")


def group_risk(results: DataFrame, key: str, min_tenders: int = 0) -> DataFrame:
    """Tenders, mean score, mean flags and share of high risk per group."""
    return results.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count("*").alias("tenders"), F.avg("rule_risk_score").alias("avg_risk"), F.avg("rule_flags_count").alias("avg_flags"),
        (F.avg(E.flag(F.col("rule_risk_score") >= 6)) * 100).alias("high_risk_pct")
    ).where(F.col("tenders") >= min_tenders)


def buyer_risk(results: DataFrame, buyers: DataFrame, min_tenders: int = 50, top: int = 15) -> DataFrame:
    per = results.groupBy("buyer_id").agg(
        F.count("*").alias("tenders"), F.avg("rule_risk_score").alias("avg_risk"), F.sum("rule_risk_score").alias("total_risk"),
        F.avg("rule_flags_count").alias("avg_flags"), F.sum("tender_value").alias("total_value"))
    best = per.where(F.col("tenders") >= min_tenders).orderBy(F.desc("avg_risk"), "buyer_id").limit(top)
    return best.join(buyers.select("buyer_id", "buyer_name", "buyer_region"), "buyer_id", "left")


def _later_pairs(items: str) -> Column:
    """All (earlier, later) pairs of a short array."""
    after = lambda x, i: F.transform(F.slice(items, i + 2, F.greatest(F.size(items) - i - 1, F.lit(0))), lambda y: F.struct(x.alias("x"), y.alias("y")))
    return F.flatten(F.transform(items, after))


def flag_correlations(results: DataFrame, top: int = 15, min_abs: float = 0.3) -> DataFrame:
    """Pairs among the most frequent flags with a strong correlation.

    A tender reports the pairs of flags it fired; counts of single flags and of pairs give every coefficient.
    """
    flags = [c for c in results.columns if c.startswith("flag_")]
    fired = F.filter(F.array(*[F.when(F.col(c) == 1, F.lit(i)) for i, c in enumerate(flags)]), lambda v: v.isNotNull())
    together = results.select(fired.alias("f")).select(F.explode(_later_pairs("f")).alias("p")).groupBy(
        F.col("p.x").alias("ia"), F.col("p.y").alias("ib")).agg(F.count("*").alias("both"))
    sums = unpivot_sums(results, flags)
    index = F.array_position(F.array(*[F.lit(c) for c in flags]), F.col("flag")).cast("int") - 1
    best = sums.orderBy(F.desc("count"), "flag").limit(top).agg(
        F.sort_array(F.collect_list(F.struct(index.alias("i"), "flag", "count", "total"))).alias("t"))
    spine = best.select(F.explode(_later_pairs("t")).alias("p")).select(
        F.col("p.x.i").alias("ia"), F.col("p.y.i").alias("ib"), F.col("p.x.flag").alias("a"), F.col("p.y.flag").alias("b"),
        F.col("p.x.count").cast("double").alias("sa"), F.col("p.y.count").cast("double").alias("sb"), F.col("p.x.total").cast("double").alias("n"))
    sa, sb, n = F.col("sa"), F.col("sb"), F.col("n")
    r = E.ratio(n * F.coalesce("both", F.lit(0)) - sa * sb, F.sqrt(sa * (n - sa)) * F.sqrt(sb * (n - sb)))
    return spine.join(together, ["ia", "ib"], "left").select("a", "b", r.alias("r")).where(
        F.abs("r") > min_abs).orderBy(F.desc(F.abs("r")), "a", "b")


def digit_shares(df: DataFrame, column: str) -> DataFrame:
    """Observed and expected share of each first digit."""
    from tendersift.operators.bidstats import BENFORD

    digits = df.where(F.col(column) > 0).select(E.first_digit(F.col(column)).alias("digit")).where(F.col("digit").between(1, 9))
    counts = digits.groupBy("digit").agg(F.count("*").alias("n"))
    total = one_row(counts.agg(F.sum("n").alias("t")), "t")["t"]
    expected = E.lookup(F.col("digit"), {k: str(v) for k, v in BENFORD.items()}, "0").cast("double")
    return counts.select("digit", "n", (F.col("n") / total).alias("observed"), expected.alias("expected"))


def value_outlier_counts(tenders: DataFrame) -> DataFrame:
    from tendersift.operators.screens import global_cuts

    values = tenders.where("tender_value > 0")
    cuts = global_cuts(values, ("tender_value",))
    g = lambda n: F.col("_g")[f"tender_value_{n}"]
    v = F.col("tender_value")
    width = g("q3") - g("q1")
    lower, upper = g("q1") - 1.5 * width, g("q3") + 1.5 * width
    z = F.abs(E.ratio(v - g("mean"), g("std")))
    return values.withColumn("_g", one_row(cuts, *cuts.columns)).agg(
        F.count("*").alias("n"), F.sum(E.flag(z > 3)).alias("over_3_sigma"), F.sum(E.flag(z > 4)).alias("over_4_sigma"),
        F.max(lower).alias("lower"), F.max(upper).alias("upper"), F.sum(E.flag((v < lower) | (v > upper))).alias("iqr_outliers"))


def bid_spread_report(bids: DataFrame) -> DataFrame:
    per = bids.groupBy("tender_id").agg(F.count("bid_amount").alias("n"), F.min("bid_amount").alias("lo"), F.max("bid_amount").alias("hi"))
    spread = per.where("n >= 2").withColumn("spread", E.ratio(F.col("hi"), F.col("lo")))
    return spread.agg(
        F.count("*").alias("tenders"), F.sum(E.flag(F.col("spread") == 1)).alias("identical"),
        F.sum(E.flag(F.col("spread") < 1.01)).alias("very_close"), F.sum(E.flag(F.col("spread") > 10)).alias("very_spread"))


# --- ensemble results ---------------------------------------------------------------------------------------

def critical_vs_normal(ensemble: DataFrame, tenders: DataFrame) -> DataFrame:
    """Value and competition of critical tenders against tenders no method flags."""
    group = F.when(F.col("ensemble_risk_level") == "critical", "critical").when(F.col("consensus_count") == 0, "normal")
    rows = ensemble.withColumn("grp", group).where(F.col("grp").isNotNull()).select("tender_id", "grp").join(
        tenders.select("tender_id", "tender_value", "is_single_bidder", "is_competitive", "procurement_method"), "tender_id")
    share = lambda m: F.avg(E.flag(F.col("procurement_method") == m)) * 100
    base = rows.groupBy("grp").agg(
        F.count("*").alias("tenders"), F.avg("tender_value").alias("mean_value"), F.avg("is_single_bidder").alias("single_bidder_rate"),
        F.avg("is_competitive").alias("competitive_rate"), share("open").alias("open_pct"), share("limited").alias("limited_pct"),
        share("selective").alias("selective_pct"))
    medians = exact_quantiles(rows, ["grp"], {"median_value": (F.col("tender_value"), 0.5)})
    return base.join(medians, "grp")


def critical_by_year(ensemble: DataFrame, tenders: DataFrame) -> DataFrame:
    joined = tenders.select("tender_id", "year").join(ensemble.select("tender_id", "ensemble_risk_level"), "tender_id", "left")
    per = joined.groupBy("year").agg(
        F.sum(E.flag(F.col("ensemble_risk_level") == "critical")).alias("critical"), F.count("*").alias("tenders"))
    return per.where("critical > 0").withColumn("pct", F.col("critical") / F.col("tenders") * 100)


def top_risky(ensemble: DataFrame, tenders: DataFrame, key: str, names: DataFrame, top: int = 10) -> DataFrame:
    rows = ensemble.where("ensemble_risk_level = 'critical'").select("tender_id", "ensemble_score").join(
        tenders.select("tender_id", key, "tender_value"), "tender_id").where(F.col(key).isNotNull())
    per = rows.groupBy(key).agg(F.count("*").alias("critical"), F.sum("tender_value").alias("total_value"),
                                F.avg("ensemble_score").alias("avg_score"))
    return per.orderBy(F.desc("critical"), key).limit(top).join(names, key, "left")


def critical_export(ensemble: DataFrame, explanations: DataFrame, tenders: DataFrame, buyers: DataFrame, suppliers: DataFrame) -> DataFrame:
    rows = ensemble.where("ensemble_risk_level = 'critical'").join(explanations.select("tender_id", "explanation"), "tender_id", "left")
    details = tenders.select("tender_id", "buyer_id", "supplier_id", "tender_value", "award_value", "procurement_method",
                             "main_cpv_2_digit", "published_date")
    return (
        rows.join(details, "tender_id", "left").join(buyers.select("buyer_id", "buyer_name"), "buyer_id", "left")
        .join(suppliers.select("supplier_id", "supplier_name"), "supplier_id", "left")
    )


# --- comparison of methods on sets of entities --------------------------------------------------------------

#: Bit of each method in a mask.
BITS = {"iforest": 1, "lof": 2, "network": 4}


def method_masks(named: dict[tuple[str, str], DataFrame], keys: dict[str, tuple[str, ...]]) -> DataFrame:
    """(level, entity, mask, methods) of all entities that some method names, one union and one aggregate for all levels."""
    union = None
    for (level, method), df in named.items():
        part = df.select(F.lit(level).alias("level"), F.lit(BITS[method]).alias("bit"), F.concat_ws("|", *[F.col(k).cast("string") for k in keys[level]]).alias("entity"))
        union = part if union is None else union.unionByName(part)
    masks = union.groupBy("level", "entity").agg(F.bit_or("bit").alias("mask"))
    return masks.withColumn("methods", F.bit_count("mask").cast("long"))


def _levels(marked: DataFrame) -> DataFrame:
    return marked.sparkSession.createDataFrame([("buyer",), ("supplier",), ("pair",)], "level string")


def algorithm_sets(marked: DataFrame) -> DataFrame:
    """Per level the entities that only the forest, only LOF or both name, and their Jaccard index."""
    both = F.col("mask").bitwiseAND(3)
    n = lambda test: F.coalesce(F.sum(E.flag(test)), F.lit(0)).cast("long")
    per = _levels(marked).join(marked, "level", "left").groupBy("level").agg(
        n(both == 1).alias("iforest_only"), n(both == 2).alias("lof_only"), n(both == 3).alias("both"), n(both > 0).alias("any"))
    return per.select("level", "iforest_only", "lof_only", "both", F.coalesce(E.ratio(F.col("both"), F.col("any")), F.lit(0.0)).alias("jaccard"))


def cross_method(marked: DataFrame) -> DataFrame:
    """Fifteen rows (level, metric, value): entities named by each method, by two or more, by all three."""
    tests = {m: F.col("mask").bitwiseAND(bit) > 0 for m, bit in BITS.items()} | {"two_or_more": F.col("methods") >= 2, "all_three": F.col("methods") == 3}
    cells = [F.struct(F.lit(m).alias("metric"), F.coalesce(F.sum(E.flag(t)), F.lit(0)).cast("long").alias("value")) for m, t in tests.items()]
    return _levels(marked).join(marked, "level", "left").groupBy("level").agg(F.array(*cells).alias("m")).select("level", F.inline("m"))


def high_consensus(marked: DataFrame, buyers: DataFrame, suppliers: DataFrame, pairs: DataFrame) -> DataFrame:
    """Entities that two or more methods name, with names and value, the most agreed and valuable first."""
    text = lambda *c: F.concat_ws("|", *[F.col(x).cast("string") for x in c]).alias("entity")
    values = (buyers.select(F.lit("buyer").alias("level"), text("buyer_id"), "total_value")
              .unionByName(suppliers.select(F.lit("supplier").alias("level"), text("supplier_id"), "total_value"))
              .unionByName(pairs.select(F.lit("pair").alias("level"), text("buyer_id", "supplier_id"), "total_value")))
    ends = F.split("entity", r"\|")
    some = marked.where("methods >= 2").select(
        "*", F.when(F.col("level") != "supplier", ends[0]).alias("b"), F.when(F.col("level") != "buyer", F.element_at(ends, -1)).alias("s"),
        F.concat_ws(",", *[F.when(F.col("mask").bitwiseAND(bit) > 0, F.lit(m)) for m, bit in BITS.items()]).alias("named_by"))
    return (some.join(values, ["level", "entity"], "left")
            .join(buyers.select(F.col("buyer_id").cast("string").alias("b"), "buyer_name"), "b", "left")
            .join(suppliers.select(F.col("supplier_id").cast("string").alias("s"), "supplier_name"), "s", "left")
            .select("level", "entity", "methods", "named_by", "total_value", "buyer_name", "supplier_name")
            .orderBy("level", F.desc("methods"), F.desc("total_value"), "entity"))


def algorithm_table(results: dict[tuple[str, str], DataFrame]) -> DataFrame:
    """Anomalies, rate, mean and largest score per (level, algorithm)."""
    out = None
    for (level, algorithm), df in results.items():
        part = df.agg(
            F.count("*").alias("n"), F.sum("anomaly").alias("anomalies"), (F.avg("anomaly") * 100).alias("rate_pct"),
            F.avg("score").alias("mean_score"), F.max("score").alias("max_score")
        ).select(F.lit(level).alias("level"), F.lit(algorithm).alias("algorithm"), "*")
        out = part if out is None else out.unionByName(part)
    return out
