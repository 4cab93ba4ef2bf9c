"""Buyer, supplier, pair and product-group portraits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tendersift.functions import expr as E
from tendersift.operators.quantiles import exact_quantiles


def cpv_count_hhi(tenders: DataFrame) -> DataFrame:
    """Per buyer, the sum of squared shares of its product groups by count."""
    counts = (
        tenders.where(F.col("main_cpv_2_digit").isNotNull())
        .groupBy("buyer_id", "main_cpv_2_digit").agg(F.count("*").cast("double").alias("c"))
    )
    return counts.groupBy("buyer_id").agg(E.hhi(F.col("c"), F.col("c")).alias("cpv_concentration"))


def buyer_portrait(tenders: DataFrame) -> DataFrame:
    """Fifteen buyer features. The null buyer, if any, is a group of its own."""
    days = E.whole_days(F.col("published_date"), F.col("award_date"))
    base = tenders.groupBy("buyer_id").agg(
        F.count("*").alias("total_tenders"),
        F.sum("tender_value").alias("total_value"),
        F.avg("tender_value").alias("avg_value"),
        F.avg("is_single_bidder").alias("single_bidder_rate"),
        F.avg("is_competitive").alias("competitive_rate"),
        F.avg("price_change_pct").alias("avg_discount_pct"),
        E.distinct_with_null("supplier_id").alias("unique_suppliers"),
        F.avg("number_of_tenderers").alias("avg_tenderers"),
        F.avg(days).alias("avg_award_days"),
        F.avg("is_weekend").alias("weekend_rate"),
        F.avg("is_q4").alias("q4_rate"),
        F.stddev_samp("tender_value").alias("_std"),
    ).withColumns({
        "supplier_diversity_index": F.col("unique_suppliers") / F.col("total_tenders"),
        "value_variance_coeff": F.col("_std") / F.greatest("avg_value", F.lit(1.0)),
    }).drop("_std")
    out = base.join(cpv_count_hhi(tenders), "buyer_id", "left")
    medians = exact_quantiles(tenders, ["buyer_id"], {"median_value": (F.col("tender_value"), 0.5)})
    return out.join(medians, "buyer_id", "left")


def supplier_portrait(tenders: DataFrame) -> DataFrame:
    return tenders.groupBy("supplier_id").agg(
        F.count("*").alias("total_awards"),
        F.sum("tender_value").alias("total_value"),
        F.avg("tender_value").alias("avg_award_value"),
        E.distinct_with_null("buyer_id").alias("buyer_count"),
        F.avg("is_single_bidder").alias("single_bidder_rate"),
        F.avg("number_of_tenderers").alias("avg_competitors"),
        E.distinct_with_null("main_cpv_2_digit").alias("cpv_diversity"),
    )


def award_gap_spread(tenders: DataFrame) -> DataFrame:
    """Per pair, sample deviation of the whole-day gaps between consecutive awards.

    Equal award times are counted before ordering, and each pair's timeline is cut into months, so even
    a pair that holds a large part of the table is ordered by many tasks. Gaps across a month boundary
    come from the last award of the previous month with one. Gap sums are exact integers.
    """
    keys = ["buyer_id", "supplier_id"]
    moments = (
        tenders.where(F.col("award_date").isNotNull())
        .groupBy(*[F.col(k) for k in keys], "award_date").agg(F.count("*").alias("c"))
        .withColumn("part", F.date_trunc("month", "award_date"))
    )
    inside = Window.partitionBy(*keys, "part").orderBy("award_date")
    months = moments.groupBy(*keys, "part").agg(F.max("award_date").alias("last"))
    previous = months.select(
        *keys, "part", F.lag("last").over(Window.partitionBy(*keys).orderBy("part")).alias("before")
    )
    null_safe = [F.col(f"m.{k}").eqNullSafe(F.col(f"p.{k}")) for k in keys]
    gaps = (
        moments.withColumn("prev", F.lag("award_date").over(inside)).alias("m")
        .join(previous.alias("p"), [*null_safe, F.col("m.part") == F.col("p.part")], "left")
        .select(
            *[F.col(f"m.{k}").alias(k) for k in keys],
            E.whole_days(F.coalesce("m.prev", "p.before"), F.col("m.award_date")).alias("gap"),
            "m.c",
        )
    )
    # c equal moments give c - 1 gaps of zero days besides the gap to the moment before.
    g = F.col("gap").cast("double")
    n = F.sum(F.col("c") - 1 + F.col("gap").isNotNull().cast("int"))
    spread = F.sqrt(F.try_divide(F.sum(g * g) - F.sum(g) * F.sum(g) / n, n - 1))
    return gaps.groupBy(*keys).agg(
        F.when(n >= 2, F.coalesce(spread, F.lit(0.0))).alias("temporal_concentration")
    )


def pair_portrait(tenders: DataFrame, min_contracts: int = 1) -> DataFrame:
    """Seven buyer-supplier features; totals count all tenders, only pairs are filtered."""
    keys = ["buyer_id", "supplier_id"]
    pairs = tenders.groupBy(*keys).agg(
        F.count("*").alias("contracts_count"),
        F.sum("tender_value").alias("total_value"),
        F.avg("tender_value").alias("avg_value"),
        F.avg("is_single_bidder").alias("single_bidder_rate"),
    )
    # Totals are sums of the pair counts, so the tenders are read once for all three grains.
    buyers = pairs.groupBy("buyer_id").agg(F.sum("contracts_count").alias("_b"))
    suppliers = pairs.groupBy("supplier_id").agg(F.sum("contracts_count").alias("_s"))
    return (
        pairs.where(F.col("contracts_count") >= min_contracts)
        .join(buyers, "buyer_id", "left").join(suppliers, "supplier_id", "left")
        .join(award_gap_spread(tenders), keys, "left")
        .select(
            *keys, "contracts_count", "total_value", "avg_value", "single_bidder_rate",
            (F.col("contracts_count") / F.col("_b")).alias("exclusivity_buyer"),
            (F.col("contracts_count") / F.col("_s")).alias("exclusivity_supplier"),
            "temporal_concentration",
        )
    )


def cpv_stats(tenders: DataFrame) -> DataFrame:
    """Per product group: moments of the value and of competition, and three exact medians."""
    known = tenders.where(F.col("main_cpv_2_digit").isNotNull())
    base = known.groupBy("main_cpv_2_digit").agg(
        F.avg("tender_value").alias("cpv_value_mean"),
        F.stddev_samp("tender_value").alias("cpv_value_std"),
        F.count("tender_value").alias("cpv_count"),
        F.avg("number_of_tenderers").alias("cpv_tenderers_mean"),
        F.avg("price_change_pct").alias("cpv_discount_mean"),
    )
    medians = exact_quantiles(known, ["main_cpv_2_digit"], {
        "cpv_value_median": (F.col("tender_value"), 0.5),
        "cpv_tenderers_median": (F.col("number_of_tenderers"), 0.5),
        "cpv_discount_median": (F.col("price_change_pct"), 0.5),
    })
    return base.join(medians, "main_cpv_2_digit", "left")


def buyer_stats(tenders: DataFrame) -> DataFrame:
    return tenders.where(F.col("buyer_id").isNotNull()).groupBy("buyer_id").agg(
        F.count("tender_id").alias("buyer_tender_count"),
        F.avg("is_single_bidder").alias("buyer_single_bidder_rate"),
        F.avg(F.coalesce(F.col("procurement_method") == "limited", F.lit(False)).cast("int")).alias("buyer_limited_rate"),
        F.sum("tender_value").alias("buyer_total_value"),
    )


def supplier_stats(tenders: DataFrame) -> DataFrame:
    return tenders.where(F.col("supplier_id").isNotNull()).groupBy("supplier_id").agg(
        F.count("tender_id").alias("supplier_win_count"),
        F.sum("tender_value").alias("supplier_total_value"),
        F.count_distinct("main_cpv_2_digit").alias("supplier_cpv_count"),
        F.count_distinct("buyer_id").alias("supplier_buyer_count"),
    )


def pair_stats(tenders: DataFrame) -> DataFrame:
    return (
        tenders.where(F.col("buyer_id").isNotNull() & F.col("supplier_id").isNotNull())
        .groupBy("buyer_id", "supplier_id")
        .agg(F.count("tender_id").alias("pair_count"), F.sum("tender_value").alias("pair_value"))
    )


def buyer_value_hhi(tenders: DataFrame) -> DataFrame:
    """Per buyer, the sum of squared supplier shares by value; unknown suppliers are left out of the total."""
    sums = (
        tenders.where(F.col("buyer_id").isNotNull() & F.col("supplier_id").isNotNull())
        .groupBy("buyer_id", "supplier_id").agg(F.coalesce(F.sum("tender_value"), F.lit(0.0)).alias("v"))
    )
    return sums.groupBy("buyer_id").agg(F.coalesce(E.hhi(F.col("v"), F.col("v")), F.lit(0.0)).alias("buyer_hhi"))


def market_sums(tenders: DataFrame) -> DataFrame:
    """Value per product group and supplier, including the null supplier."""
    return (
        tenders.where(F.col("main_cpv_2_digit").isNotNull())
        .groupBy("main_cpv_2_digit", "supplier_id")
        .agg(F.coalesce(F.sum("tender_value"), F.lit(0.0)).alias("v"))
    )


def market_hhi(tenders: DataFrame) -> DataFrame:
    """Per product group, squared supplier shares of a total that includes unknown suppliers."""
    known = F.when(F.col("supplier_id").isNotNull(), F.col("v"))
    return market_sums(tenders).groupBy("main_cpv_2_digit").agg(
        F.coalesce(E.hhi(known, F.col("v")), F.lit(0.0)).alias("hhi")
    )


def hhi_index(shares: DataFrame, column: str) -> DataFrame:
    return shares.agg(F.sum(F.col(column) * F.col(column)).alias("hhi"))
