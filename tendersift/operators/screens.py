"""Statistical screens on values, price patterns, bids, first digits and concentration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tendersift.functions import expr as E
from tendersift.operators import portraits
from tendersift.operators.bidstats import CHI2_LIMITS, benford_distance, digit_counts, tender_bid_stats
from tendersift.operators.quantiles import exact_quantiles, one_row
from tendersift.operators.rules import distribution, unpivot_sums
from tendersift.session import cut_lineage

# Scored flags and their weights; first-digit and round-price flags are not scored.
STAT_WEIGHTS = {
    "stat_zscore_value": 1.0,
    "stat_iqr_value": 1.0,
    "stat_zscore_value_cpv": 2.0,
    "stat_iqr_value_cpv": 2.0,
    "stat_zscore_discount": 1.0,
    "stat_iqr_discount": 1.0,
    "stat_99_ending": 0.5,
    "stat_award_ratio_suspicious": 1.0,
    "stat_cv_anomaly": 2.0,
    "stat_diffp_anomaly": 2.0,
    "stat_rdnor_anomaly": 2.0,
    "stat_ks_anomaly": 1.5,
    "stat_skewness_anomaly": 1.0,
    "stat_kurtosis_anomaly": 1.0,
    "stat_bid_spread_anomaly": 2.0,
    "stat_bid_clustering": 2.0,
    "stat_bid_spread_high": 1.0,
    "stat_high_concentration": 1.0,
    "stat_monopoly": 2.0,
}
BID_COLUMNS = ("bid_count", "bid_min", "bid_max", "bid_mean", "bid_std", "bid_cv", "bid_spread", "bid_diffp",
               "bid_rdnor", "bid_ks_stat", "bid_skewness", "bid_kurtosis")


def zscore_test(value: Column, mean: Column, std: Column, threshold: float) -> Column:
    return F.abs(E.ratio(value - mean, std)) > threshold


def iqr_test(value: Column, q1: Column, q3: Column, multiplier: float) -> Column:
    width = q3 - q1
    return (width != 0) & ((value < q1 - multiplier * width) | (value > q3 + multiplier * width))


def global_cuts(tenders: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """One row: mean, deviation and quartiles of each column."""
    wanted = {f"{c}_{q}": (v, p) for c, v in ((c, F.col(c)) for c in columns) for q, p in (("q1", 0.25), ("q3", 0.75))}
    quartiles = exact_quantiles(tenders, [], wanted)
    moments = tenders.agg(*[f(c).alias(f"{c}_{n}") for c in columns for f, n in ((F.avg, "mean"), (F.stddev_samp, "std"))])
    return moments.withColumn("_q", one_row(quartiles, *wanted)).select("*", "_q.*").drop("_q")


def value_outliers(df: DataFrame, zscore: float = 3.0, iqr: float = 1.5, group_by_cpv: bool = True,
                   source: DataFrame | None = None) -> DataFrame:
    """Global and per-group outlier flags of the value, global ones of the price change.

    Statistics are taken from ``source``, by default the frame itself; a pipeline passes its narrow input.
    """
    tenders = source if source is not None else df
    has_change = "price_change_pct" in tenders.columns
    columns = ("tender_value", "price_change_pct") if has_change else ("tender_value",)
    cuts = global_cuts(tenders, columns)
    out = df.withColumn("_g", one_row(cuts, *cuts.columns))
    flags = {}
    for column, name in zip(columns, ("value", "discount"), strict=False):
        g = lambda part: F.col("_g")[f"{column}_{part}"]  # noqa: B023, E731
        flags[f"stat_zscore_{name}"] = E.flag(zscore_test(F.col(column), g("mean"), g("std"), zscore))
        flags[f"stat_iqr_{name}"] = E.flag(iqr_test(F.col(column), g("q1"), g("q3"), iqr))
    out = out.withColumns(flags).drop("_g")
    if group_by_cpv and "main_cpv_2_digit" in tenders.columns:
        value = F.col("tender_value")
        known = tenders.where(F.col("main_cpv_2_digit").isNotNull())
        moments = known.groupBy("main_cpv_2_digit").agg(
            F.avg("tender_value").alias("_m"), F.stddev_samp("tender_value").alias("_s"), F.lit(1).alias("_known"))
        quartiles = exact_quantiles(known, ["main_cpv_2_digit"], {
            "_q1": (value, 0.25), "_q3": (value, 0.75)})
        stats = cut_lineage(moments.join(quartiles, "main_cpv_2_digit", "left"))
        out = out.join(stats, "main_cpv_2_digit", "left").withColumns({
            "stat_zscore_value_cpv": F.when(F.col("_known") == 1, E.flag(zscore_test(value, F.col("_m"), F.col("_s"), zscore))),
            "stat_iqr_value_cpv": F.when(F.col("_known") == 1, E.flag(iqr_test(value, F.col("_q1"), F.col("_q3"), iqr))),
        }).drop("_m", "_s", "_q1", "_q3", "_known")
    return out


def price_patterns(tenders: DataFrame) -> DataFrame:
    value = F.col("tender_value")
    share = E.ratio(F.col("award_value"), value)
    fair = E.competitive_method() & (F.col("number_of_tenderers") >= 3)
    return tenders.withColumns({
        "stat_round_price": E.flag((value > 0) & E.divisible(value, 1000)),
        "stat_very_round_price": E.flag((value > 0) & E.divisible(value, 100000)),
        "stat_99_ending": E.flag((value > 0) & E.ends_with_99(value)),
        "stat_award_ratio_suspicious": E.flag(fair & (share > 0.99) & (share <= 1.0))
        if "award_value" in tenders.columns else F.lit(0),
    })


def benford_by(rows: DataFrame, key: str, alpha: float = 0.05, min_samples: int = 30) -> DataFrame:
    """Per key, chi-square of the first digits of ``bid_amount`` against the expected shares."""
    counts = (
        rows.where(F.col(key).isNotNull() & F.col("_digit").between(1, 9)).groupBy(key)
        .agg(F.count("*").alias("n"), *digit_counts(F.col("_digit")))
    )
    chi = benford_distance(F.col("n")) * F.col("n")
    hit = (F.col("n") >= min_samples) & (chi > CHI2_LIMITS[alpha])
    return counts.select(key, "n", chi.alias("chi2"), E.flag(hit).alias("violates"))


def benford_flags(df: DataFrame, bids: DataFrame, alpha: float = 0.05, min_samples: int = 30,
                  source: DataFrame | None = None) -> DataFrame:
    """Tenders whose buyer's bids, or whose winner's bids, break the first-digit law; one row per tender.

    With several winning bids the tender is flagged when any of its winners is.
    """
    digits = bids.where(F.col("bid_amount") > 0).withColumn("_digit", E.first_digit(F.col("bid_amount")))
    owners = (source if source is not None else df).select("tender_id", "buyer_id")
    by_buyer = cut_lineage(benford_by(digits.select("tender_id", "_digit").join(owners, "tender_id", "left"), "buyer_id", alpha, min_samples))
    by_bidder = benford_by(digits.select("bidder_id", "_digit"), "bidder_id", alpha, min_samples)
    bad_winners = (
        bids.where(F.col("is_winner") == 1).select("tender_id", "bidder_id")
        .join(by_bidder.where(F.col("violates") == 1).select("bidder_id"), "bidder_id", "left_semi")
        .select("tender_id").distinct().withColumn("_s", F.lit(1))
    )
    return (
        df.join(by_buyer.select("buyer_id", F.col("violates").alias("_b")), "buyer_id", "left")
        .join(bad_winners, "tender_id", "left")
        .withColumns({"stat_benford_buyer": F.coalesce("_b", F.lit(0)), "stat_benford_supplier": F.coalesce("_s", F.lit(0))})
        .drop("_b", "_s")
    )


def bid_screens(df: DataFrame, bids: DataFrame) -> DataFrame:
    """Nine flags on the spread of the bids, for open and selective tenders with three or more bids."""
    stats = tender_bid_stats(bids).select("tender_id", *BID_COLUMNS)
    fair = E.competitive_method() & (F.col("bid_count") >= 3)
    on = lambda test: E.flag(fair & test)
    return df.join(stats, "tender_id", "left").withColumns({
        "stat_cv_anomaly": on(F.col("bid_cv") < 0.05),
        "stat_diffp_anomaly": on(F.col("bid_diffp") > 0.05),
        "stat_rdnor_anomaly": on(F.col("bid_rdnor") > 1.5),
        "stat_ks_anomaly": on(F.col("bid_ks_stat") > 0.3),
        "stat_skewness_anomaly": on(F.abs("bid_skewness") > 0.5),
        "stat_kurtosis_anomaly": on(F.col("bid_kurtosis") > 2),
        "stat_bid_spread_anomaly": on(F.col("bid_spread") < 1.01),
        "stat_bid_clustering": on(F.col("bid_cv") < 0.01),
        "stat_bid_spread_high": on(F.col("bid_spread") > 10),
    })


def concentration(df: DataFrame, high: float = 0.5, monopoly: float = 0.9, source: DataFrame | None = None) -> DataFrame:
    shares = cut_lineage(portraits.buyer_value_hhi(source if source is not None else df))
    return df.join(shares, "buyer_id", "left").withColumns({
        "stat_high_concentration": E.flag(F.col("buyer_hhi") > high),
        "stat_monopoly": E.flag(F.col("buyer_hhi") > monopoly),
    })


def score(df: DataFrame) -> DataFrame:
    known = [(c, w) for c, w in STAT_WEIGHTS.items() if c in df.columns]
    points = sum((F.coalesce(F.col(c), F.lit(0)) * w for c, w in known), F.lit(0.0))
    count = sum((F.coalesce(F.col(c), F.lit(0)) for c, _ in known), F.lit(0))
    return df.withColumns({"stat_score": points, "stat_flags_count": count}).withColumns({
        "stat_risk_level": E.stat_level(F.col("stat_score")), "stat_anomaly": E.flag(F.col("stat_score") >= 4)})


def detect(
    tenders: DataFrame,
    bids: DataFrame | None = None,
    group_by_cpv: bool = True,
    zscore_threshold: float = 3.0,
    iqr_multiplier: float = 1.5,
    benford_alpha: float = 0.05,
    min_samples: int = 30,
) -> DataFrame:
    """All screens, their weighted score, level and anomaly flag. Bid screens need bids."""
    # Statistics come from the input itself and are written, so that joins are planned by their sizes; each step adds its flags to the growing row.
    out = value_outliers(price_patterns(tenders), zscore_threshold, iqr_multiplier, group_by_cpv, tenders)
    if bids is not None:
        out = benford_flags(out, bids, benford_alpha, min_samples, tenders)
        out = bid_screens(out, bids)
    else:
        out = out.withColumns({c: F.lit(0) for c in (
            "stat_benford_buyer", "stat_benford_supplier", "stat_bid_spread_anomaly", "stat_bid_clustering")})
    return score(concentration(out, source=tenders))


# --- reports and single tests -------------------------------------------------------------------------------

def flag_columns(results: DataFrame) -> list[str]:
    skip = {"stat_score", "stat_flags_count", "stat_risk_level", "stat_anomaly"}
    return [c for c in results.columns if c.startswith("stat_") and c not in skip]


def summary(results: DataFrame) -> DataFrame:
    """Count and percentage per flag. The combined anomaly is not a flag and is left out."""
    return unpivot_sums(results, flag_columns(results)).select(
        F.expr("substring(flag, 6)").alias("flag"), "count",
        F.bround(F.col("count") / F.col("total") * 100, 2).alias("percentage")).orderBy(F.desc("count"), "flag")


def risk_distribution(results: DataFrame) -> DataFrame:
    return distribution(results, "stat_risk_level")


def anomalies(results: DataFrame, min_score: float = 3.0) -> DataFrame:
    return results.where(F.col("stat_score") >= min_score)


def benford_test(df: DataFrame, column: str, alpha: float = 0.05, min_samples: int = 30) -> DataFrame:
    """Statistic, p-value, verdict and text of the first-digit test on one column, as one row."""
    digit = E.first_digit(F.col(column))
    counts = df.where(F.col(column) > 0).withColumn("_digit", digit).where(F.col("_digit").between(1, 9)).agg(
        F.count("*").alias("n"), *digit_counts(F.col("_digit")))
    chi, limit = benford_distance(F.col("n")) * F.col("n"), CHI2_LIMITS[alpha]
    enough = F.col("n") >= min_samples
    tested = counts.select("n", enough.alias("ok"), F.when(enough, chi).otherwise(0.0).alias("statistic"))
    return tested.select(
        F.lit("Benford's Law").alias("name"), "statistic",
        F.when(F.col("ok"), E.chi2_sf_df8(F.col("statistic"))).alias("p_value"),
        E.flag(F.col("ok") & (F.col("statistic") > limit)).alias("is_anomaly"), F.lit(limit).alias("threshold"),
        F.when(F.col("ok"), F.format_string(f"Chi-square = %.2f, critical = {limit:.2f}", F.col("statistic")))
        .otherwise("Insufficient data (need at least 30 samples)").alias("description"))


def outliers_zscore(df: DataFrame, column: str, threshold: float = 3.0) -> DataFrame:
    """The frame with an ``is_outlier`` mask and the mean and deviation it used."""
    cuts = one_row(df.agg(F.avg(column).alias("mean"), F.stddev_samp(column).alias("std")), "mean", "std")
    out = df.withColumn("_c", cuts).select("*", "_c.mean", "_c.std").drop("_c")
    return out.withColumn("is_outlier", E.flag(zscore_test(F.col(column), F.col("mean"), F.col("std"), threshold)))


def outliers_iqr(df: DataFrame, column: str, multiplier: float = 1.5) -> DataFrame:
    """The frame with an ``is_outlier`` mask and the bounds it used."""
    q = exact_quantiles(df, [], {"q1": (F.col(column), 0.25), "q3": (F.col(column), 0.75)})
    width = F.col("q3") - F.col("q1")
    bounds = q.select((F.col("q1") - multiplier * width).alias("lower"), (F.col("q3") + multiplier * width).alias("upper"))
    out = df.withColumn("_c", one_row(bounds, "lower", "upper")).select("*", "_c.lower", "_c.upper").drop("_c")
    return out.withColumn("is_outlier", E.flag((F.col(column) < F.col("lower")) | (F.col(column) > F.col("upper"))))
