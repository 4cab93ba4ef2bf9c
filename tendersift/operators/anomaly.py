"""Outlier detection on tenders and on buyer, supplier and pair portraits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tendersift.operators import iforest, lof, portraits, scaling
from tendersift.schemas import CONTAMINATION, ML_FEATURES
from tendersift.session import cut_lineage
from tendersift.sources.readers import sample_exact


def _detect(df: DataFrame, features: Sequence[str], keys: Sequence[str], algorithm: str, contamination: float) -> DataFrame:
    ready = scaling.preprocess(df, features, keys)
    if algorithm == "lof":
        raw = lof.lof_scores(ready, keys)
    elif algorithm == "iforest":
        raw, _ = iforest.fit_score(ready, keys)
    else:
        raise ValueError(f"Unknown algorithm: {algorithm}")
    return scaling.finish(raw, contamination)


def detect_tenders(tenders: DataFrame, buyers: DataFrame | None = None, suppliers: DataFrame | None = None,
                   sample_size: int | None = None, contamination: float = CONTAMINATION, raw: bool = False) -> DataFrame:
    """Isolation forest on tender features; with ``sample_size`` on that many rows chosen by hash, with ``raw`` also the unscaled score."""
    rows = sample_exact(tenders, sample_size, "tender_id") if sample_size else tenders
    wide, features = scaling.tender_features(rows, buyers, suppliers)
    scored = _detect(wide, features, ["tender_id"], "iforest", contamination)
    return scored if raw else scored.drop("raw_score")


def _portrait_result(portrait: DataFrame, level: str, keys: list[str], algorithm: str, contamination: float) -> DataFrame:
    features = [c for c in ML_FEATURES[level] if c in portrait.columns]
    base = cut_lineage(portrait.select(*keys, *features))
    scored = _detect(base, features, keys, algorithm, contamination)
    return scored.drop("raw_score").join(base, keys)


def detect_buyers(tenders: DataFrame, buyers: DataFrame | None = None, algorithm: str = "lof",
                  contamination: float = CONTAMINATION) -> DataFrame:
    """A buyer table with the three ratio columns is used as it is, otherwise portraits are built."""
    ratios = ("single_bidder_rate", "competitive_rate", "supplier_diversity_index")
    given = buyers is not None and all(c in buyers.columns for c in ratios)
    portrait = buyers if given else portraits.buyer_portrait(tenders)
    return _portrait_result(portrait.where("buyer_id IS NOT NULL"), "buyer", ["buyer_id"], algorithm, contamination)


def detect_suppliers(tenders: DataFrame, algorithm: str = "lof", contamination: float = CONTAMINATION) -> DataFrame:
    portrait = portraits.supplier_portrait(tenders).where("supplier_id IS NOT NULL")
    return _portrait_result(portrait, "supplier", ["supplier_id"], algorithm, contamination)


def detect_pairs(tenders: DataFrame, min_contracts: int = 3, algorithm: str = "lof",
                 contamination: float = CONTAMINATION) -> DataFrame:
    """Fewer than ten pairs give an empty result."""
    keys = ["buyer_id", "supplier_id"]
    portrait = cut_lineage(portraits.pair_portrait(tenders, min_contracts).dropna(subset=keys))
    if portrait.limit(10).count() < 10:
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in portrait.select(*keys).schema)
        feats = ", ".join(f"{c} double" for c in ML_FEATURES["pair"])
        return tenders.sparkSession.createDataFrame([], f"{kinds}, score double, anomaly int, risk_level string, {feats}")
    return _portrait_result(portrait, "pair", keys, algorithm, contamination)


def summary(results: DataFrame, algorithm: str) -> DataFrame:
    """Metric and value rows: number, anomalies, rate and levels."""
    level = lambda x: F.sum((F.col("risk_level") == x).cast("int"))
    entries = [("total", F.count("*")), ("anomalies", F.sum("anomaly")), ("anomaly_rate", F.avg("anomaly") * 100),
               *[(f"risk_{x}", F.coalesce(level(x), F.lit(0))) for x in ("critical", "high", "medium", "low")]]
    cells = [F.struct(F.lit(algorithm).alias("algorithm"), F.lit(n).alias("metric"), v.cast("double").alias("value")) for n, v in entries]
    return results.agg(F.array(*cells).alias("m")).select(F.inline("m"))


def above(results: DataFrame, min_score: float) -> DataFrame:
    return results.where(F.col("score") >= min_score)


def map_to_tenders(tenders: DataFrame, buyers: DataFrame) -> DataFrame:
    """Buyer label and score on each tender of the buyer; a missing score is 0."""
    own = buyers.select("buyer_id", "score", "anomaly")
    return tenders.select("tender_id", "buyer_id").join(own, "buyer_id", "left").select(
        "tender_id", F.coalesce("score", F.lit(0.0)).alias("lof_score"), F.coalesce("anomaly", F.lit(0)).alias("lof_anomaly"))
