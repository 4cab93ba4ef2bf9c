"""One pass over the bids of a tender.

Every bid rule and bid screen reads this table, so the bids are shuffled by tender once. The number of
bids of a tender is a 16-bit count, which bounds the sorted list kept per tender.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tendersift.functions import expr as E

DIGITS = range(1, 10)
# Expected shares of the first digits 1 to 9 and chi-square limits for 8 degrees of freedom.
BENFORD = {1: 0.301, 2: 0.176, 3: 0.125, 4: 0.097, 5: 0.079, 6: 0.067, 7: 0.058, 8: 0.051, 9: 0.046}
CHI2_LIMITS = {0.10: 13.36, 0.05: 15.51, 0.01: 20.09, 0.001: 26.12}


def digit_counts(digit):
    return [F.sum(F.when(digit == d, 1).otherwise(0)).alias(f"d{d}") for d in DIGITS]


def benford_distance(total):
    """Sum of squared relative deviations from the expected digit shares, on proportions."""
    terms = [
        (E.ratio(F.col(f"d{d}"), total) - F.lit(BENFORD[d])) ** 2 / F.lit(BENFORD[d]) for d in DIGITS
    ]
    out = terms[0]
    for term in terms[1:]:
        out = out + term
    return out


def tender_bid_stats(bids: DataFrame) -> DataFrame:
    amount = F.col("bid_amount")
    disqualified = F.coalesce(F.col("bid_status") == "disqualified", F.lit(False))
    has_date = "bid_date" in bids.columns
    hours = E.hours_between(F.min("bid_date"), F.max("bid_date")) if has_date else F.lit(None).cast("double")
    lowest = F.struct(amount.alias("a"), F.col("bid_id").alias("i"))
    grouped = bids.where(F.col("tender_id").isNotNull()).groupBy("tender_id").agg(
        F.count("*").alias("bid_rows"),
        F.count("bid_id").alias("bid_ids"),
        F.count(amount).alias("bid_count"),
        F.min(amount).alias("bid_min"),
        F.max(amount).alias("bid_max"),
        F.avg(amount).alias("bid_mean"),
        F.stddev_samp(amount).alias("bid_std"),
        F.stddev_pop(amount).alias("_std_pop"),
        F.skewness(amount).alias("_skew"),
        F.kurtosis(amount).alias("_kurt"),
        F.sum(disqualified.cast("int")).alias("disqualified_count"),
        F.avg(F.coalesce(E.divisible(amount, 1000), F.lit(False)).cast("int")).alias("round_rate"),
        F.min_by(disqualified, F.when(amount.isNotNull(), lowest)).alias("_lowest_disqualified"),
        F.max(F.when(amount.isNotNull(), 1)).alias("_any"),
        hours.alias("hours_spread"),
        F.array_sort(F.collect_list(amount)).alias("_sorted"),
        *digit_counts(E.leading_digit(amount)),
    )
    n, first = F.col("bid_count"), F.col("bid_min")
    second = F.try_element_at("_sorted", F.lit(2))
    width = F.col("bid_max") - first
    steps = F.transform(
        "_sorted",
        lambda b, i: F.greatest(
            (i + 1) / n - E.ratio(b - first, width), E.ratio(b - first, width) - i / n
        ),
    )
    varied = (n >= 3) & (F.when(F.col("bid_mean") > 0, F.col("_std_pop") / F.col("bid_mean")).otherwise(0.0) > 0.001)
    return grouped.select(
        "tender_id", "bid_rows", "bid_ids", "bid_count", "bid_min", "bid_max", "bid_mean", "bid_std",
        "disqualified_count", "round_rate", "hours_spread",
        E.ratio(F.col("bid_std"), F.col("bid_mean")).alias("bid_cv"),
        E.ratio(F.col("bid_max"), first).alias("bid_spread"),
        E.ratio(width, F.col("bid_mean")).alias("bid_range_ratio"),
        E.ratio(second - first, first).alias("second_gap"),
        F.when((n >= 3) & (first > 0), E.ratio(second - first, first)).alias("bid_diffp"),
        F.when((n >= 3) & (width > 0), E.ratio((second - first) * (n - 1), width)).alias("bid_rdnor"),
        F.when((n >= 3) & (width > 0), F.array_max(steps)).alias("bid_ks_stat"),
        F.when(varied, F.col("_skew")).alias("bid_skewness"),
        F.when(varied, F.col("_kurt")).alias("bid_kurtosis"),
        (F.size("_sorted") > F.size(F.array_distinct("_sorted"))).alias("has_identical"),
        (F.col("_any").isNotNull() & F.col("_lowest_disqualified")).alias("lowest_disqualified"),
        benford_distance(n).alias("benford_distance"),
    )
