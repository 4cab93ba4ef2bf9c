"""Feature preparation and score post-processing of the two outlier models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tendersift.functions import expr as E
from tendersift.operators.quantiles import exact_quantiles, one_row
from tendersift.schemas import CONTAMINATION, LOG_FEATURES, ML_FEATURES
from tendersift.session import cut_lineage


def value_vs_cpv_median(tenders: DataFrame) -> DataFrame:
    """Award value (null = 0) over the median award of its product group, at least 1."""
    medians = cut_lineage(exact_quantiles(tenders, ["main_cpv_2_digit"], {"_median": (F.col("award_value"), 0.5)}))
    value = F.coalesce("award_value", F.lit(0.0)) / F.greatest("_median", F.lit(1.0))
    return tenders.join(medians, "main_cpv_2_digit", "left").withColumn(
        "value_vs_cpv_median", F.when(F.col("_median").isNotNull(), value)).drop("_median")


def tender_features(tenders: DataFrame, buyers: DataFrame | None = None, suppliers: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """Tender features and, where portraits are given, those of the buyer and the supplier."""
    out = value_vs_cpv_median(tenders)
    names = [c for c in ML_FEATURES["tender"] if c in out.columns]
    out = out.select("tender_id", "buyer_id", "supplier_id", *names)
    for table, key, level in ((buyers, "buyer_id", "buyer"), (suppliers, "supplier_id", "supplier")):
        if table is not None:
            new = [c for c in ML_FEATURES[level] if c in table.columns and c not in names]
            out = out.join(table.select(key, *new), key, "left")
            names += new
    return out, names


def preprocess(df: DataFrame, features: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Keys and one ``features`` array: logarithm of skewed columns, median for nulls, (x - median) / IQR."""
    logged = df.select(*keys, *[
        (E.log1p_clipped(F.col(f)) if f in LOG_FEATURES else F.col(f).cast("double")).alias(f) for f in features])
    medians = one_row(exact_quantiles(logged, [], {f: (F.col(f), 0.5) for f in features}), *features)
    filled = logged.withColumn("_m", medians).select(
        *keys, *[F.coalesce(F.col(f), F.col("_m")[f], F.lit(0.0)).alias(f) for f in features])
    wanted = {f"{f}_{n}": (c, p) for f, c in ((f, F.col(f)) for f in features) for n, p in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75))}
    cuts = one_row(exact_quantiles(filled, [], wanted), *wanted)

    def scaled(f: str):
        width = F.col("_q")[f"{f}_q3"] - F.col("_q")[f"{f}_q1"]
        return (F.col(f) - F.col("_q")[f"{f}_q2"]) / F.when(width == 0, 1.0).otherwise(width)

    return filled.withColumn("_q", cuts).select(*keys, F.array(*[scaled(f) for f in features]).alias("features"))


def finish(scored: DataFrame, contamination: float = CONTAMINATION) -> DataFrame:
    """From raw scores: scale between the 1st and 99th percentile, label the top share, add the level.

    The scores are written first: the percentiles read them twice and the result once more, and a model would score its rows each time.
    """
    scored = cut_lineage(scored)
    raw = F.col("raw_score")
    cuts = exact_quantiles(scored, [], {"lo": (raw, 0.01), "hi": (raw, 0.99), "limit": (raw, 1 - contamination)})
    c = F.col("_c")
    clipped = F.least(F.greatest(raw, c["lo"]), c["hi"])
    return (
        scored.withColumn("_c", one_row(cuts, "lo", "hi", "limit"))
        .withColumns({"score": (clipped - c["lo"]) / (c["hi"] - c["lo"] + 1e-10), "anomaly": (raw > c["limit"]).cast("int")})
        .drop("_c").withColumn("risk_level", E.ml_level(F.col("score")))
    )
