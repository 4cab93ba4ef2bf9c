"""Vote of the detectors, its reports and the explanation text."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from tendersift.functions import expr as E
from tendersift.operators.quantiles import exact_quantiles, one_row
from tendersift.session import cut_lineage

# Methods in their order, their weights and names.
METHODS = ("rule", "stat", "if", "lof", "network")
WEIGHTS = {"rule": 1.0, "stat": 0.8, "if": 1.0, "lof": 0.8, "network": 1.0}
METHOD_NAMES = {"rule": "Правила", "stat": "Статистика", "if": "IForest", "lof": "LOF", "network": "Мережа"}
NETWORK_LABELS = {
    "network_rotation": "ротація перемог",
    "network_monopolistic": "монополія",
    "network_suspicious_supplier": "підозріла зв'язність",
}


def _first_present(df: DataFrame, *names: str) -> Column | None:
    return next((F.col(n) for n in names if n in df.columns), None)


def scale_by_max(df: DataFrame, score: str) -> DataFrame:
    """Divide a score by its maximum when that exceeds 1."""
    top = one_row(df.agg(F.max(score).alias("m")), "m")["m"]
    return df.withColumn(score, F.col(score).cast("double") / F.when(top > 1, top).otherwise(1.0))


def average_rank(df: DataFrame, column: str, parts: int | None = None) -> DataFrame:
    """Percentile rank with average ties, as (column, rank) rows of the distinct values.

    Distinct values are ranked inside ranges cut at sketched quantiles and then shifted by the counts of
    the ranges before, so no task orders the whole column. Cuts only spread the work, ranks are exact; there are as
    many ranges as shuffle partitions unless ``parts`` says otherwise.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("c"))
    cuts = one_row(counts.agg(F.percentile_approx(column, [i / parts for i in range(1, parts)], 10_000).alias("q")), "q")["q"]
    placed = counts.withColumn("_q", cuts).select(
        column, "c", F.size(F.filter("_q", lambda q: q < F.col(column))).alias("part"))
    before = Window.partitionBy("part").orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
    # At most ``parts`` rows.
    sums = placed.groupBy("part").agg(F.sum("c").alias("s"))
    shifted = sums.select(
        "part", F.coalesce(F.sum("s").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("shift"))
    total = one_row(sums.agg(F.sum("s").alias("n")), "n")["n"]
    rank = F.coalesce(F.sum("c").over(before), F.lit(0)) + (F.col("c") + 1) / 2
    return (
        placed.withColumn("rank", rank).join(shifted, "part")
        .select(column, ((F.col("rank") + F.col("shift")) / total).alias("pct_rank"))
    )


def rule_vote(results: DataFrame) -> DataFrame:
    score = _first_present(results, "rule_risk_score", "rule_score")
    base = results.withColumn("rule_score", (score if score is not None else F.lit(0)).cast("double"))
    scaled = scale_by_max(base, "rule_score")
    if "rule_risk_level" in results.columns:
        vote = F.col("rule_risk_level").isin("high", "critical")
    elif "rule_risk_score" in results.columns:
        vote = F.col("rule_risk_score") >= 6
    elif "rule_flags_count" in results.columns:
        vote = F.col("rule_flags_count") >= 3
    else:
        vote = F.col("rule_score") > 0.5
    return scaled.select("tender_id", "rule_score", E.flag(vote).alias("rule_anomaly"))


def stat_vote(results: DataFrame) -> DataFrame:
    score = _first_present(results, "stat_score")
    base = results.withColumn("stat_score", (score if score is not None else F.lit(0)).cast("double"))
    scaled = scale_by_max(base, "stat_score")
    if "stat_anomaly" in results.columns:
        vote = F.col("stat_anomaly") == 1
    elif "stat_flags_count" in results.columns:
        vote = F.col("stat_flags_count") > 0
    else:
        vote = F.col("stat_score") > 0.3
    return scaled.select("tender_id", "stat_score", E.flag(vote).alias("stat_anomaly"))


def _score_and_label(results: DataFrame, method: str) -> DataFrame:
    score = _first_present(results, f"{method}_score", "score")
    label = _first_present(results, f"{method}_anomaly", "anomaly")
    zero = F.lit(0)
    return results.select(
        "tender_id", (score if score is not None else zero).cast("double").alias(f"{method}_score"),
        (label if label is not None else zero).cast("int").alias(f"{method}_anomaly"))


def if_vote(results: DataFrame) -> DataFrame:
    return _score_and_label(results, "if")


def lof_vote(results: DataFrame) -> DataFrame:
    """LOF scores crowd near zero, so their percentile rank is used instead."""
    base = _score_and_label(results, "lof")
    ranks = cut_lineage(average_rank(base, "lof_score"))
    return base.join(ranks, "lof_score", "left").select("tender_id", F.col("pct_rank").alias("lof_score"), "lof_anomaly")


def network_vote(results: DataFrame) -> DataFrame:
    return scale_by_max(_score_and_label(results, "network"), "network_score")


VOTES = {"rule": rule_vote, "stat": stat_vote, "if": if_vote, "lof": lof_vote, "network": network_vote}


def union_methods(frames: Mapping[str, DataFrame]) -> DataFrame:
    """Full outer join of per-method (tender_id, score, anomaly) tables; a tender missing from a method counts as 0 there.

    Rows that repeat a tender meet each other, rows without a tender meet none, as in any join.
    """
    columns = {f"{m}_{k}": kind for m in frames for k, kind in (("score", "double"), ("anomaly", "int"))}
    out = None
    for method, df in frames.items():
        own = df.select("tender_id", f"{method}_score", f"{method}_anomaly")
        out = own if out is None else out.join(own, "tender_id", "full_outer")
    return out.select("tender_id", *[F.coalesce(F.col(c).cast(kind), F.lit(0)).alias(c) for c, kind in columns.items()])


def combine(results: Mapping[str, DataFrame], weights: Mapping[str, float] | None = None,
            consensus_threshold: int = 2) -> DataFrame:
    """Weighted score, number and share of agreeing methods, anomaly flag and level per tender."""
    used = [m for m in METHODS if m in results and "tender_id" in results[m].columns]
    if not used:
        raise ValueError("No valid results provided")
    weights = WEIGHTS | dict(weights or {})
    joined = union_methods({m: VOTES[m](results[m]) for m in used})
    total = sum(weights[m] for m in used)
    score = sum((F.col(f"{m}_score") * weights[m] for m in used), F.lit(0.0))
    votes = sum((F.col(f"{m}_anomaly") for m in used), F.lit(0))
    return (
        joined.withColumns({"ensemble_score": score / total if total > 0 else F.lit(0.0), "consensus_count": votes})
        .withColumn("consensus_pct", F.col("consensus_count") / len(used))
        .withColumn("ensemble_anomaly", E.flag(F.col("consensus_count") >= consensus_threshold))
        .withColumn("ensemble_risk_level", E.consensus_level(F.col("consensus_pct")))
    )


def methods_of(ensemble: DataFrame) -> list[str]:
    return [m for m in METHODS if f"{m}_anomaly" in ensemble.columns]


def consensus(ensemble: DataFrame, at_least: int = 2) -> DataFrame:
    return ensemble.where(F.col("consensus_count") >= at_least)


def critical(ensemble: DataFrame) -> DataFrame:
    return ensemble.where(F.col("ensemble_risk_level") == "critical")


def method_stats(ensemble: DataFrame) -> DataFrame:
    used = methods_of(ensemble)
    medians = exact_quantiles(ensemble, [], {m: (F.col(f"{m}_score"), 0.5) for m in used})
    entry = lambda m: F.struct(
        F.lit(m).alias("method"), F.sum(f"{m}_anomaly").alias("anomalies"),
        F.round(F.avg(f"{m}_anomaly") * 100, 2).alias("anomaly_pct"), F.round(F.avg(f"{m}_score"), 4).alias("mean_score"))
    base = ensemble.agg(F.array(*[entry(m) for m in used]).alias("a")).select(F.inline("a"))
    middle = medians.unpivot([], used, "method", "median_score")
    return base.join(middle, "method").withColumn("median_score", F.round("median_score", 4))


def correlation(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson matrix as (a, b, r) rows out of one aggregate."""
    cells = [(a, b) for a in columns for b in columns]
    entries = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("r")) for a, b in cells]
    return df.agg(F.array(*entries).alias("m")).select(F.inline("m"))


def jaccard(df: DataFrame, columns: list[str], unit_diagonal: bool = False) -> DataFrame:
    """Jaccard matrix of 0/1 columns as (a, b, j) rows; two empty sets give 0."""
    entries = []
    for a in columns:
        for b in columns:
            both, any_ = F.sum(F.col(a) * F.col(b)), F.sum(F.greatest(a, b))
            value = F.lit(1.0) if unit_diagonal and a == b else F.coalesce(F.try_divide(both.cast("double"), any_), F.lit(0.0))
            entries.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), value.alias("j")))
    return df.agg(F.array(*entries).alias("m")).select(F.inline("m"))


def agreement(ensemble: DataFrame) -> DataFrame:
    return jaccard(ensemble, [f"{m}_anomaly" for m in methods_of(ensemble)])


def summary(ensemble: DataFrame) -> DataFrame:
    """Totals by level and by number of agreeing methods, with zero rows for empty groups."""
    used = methods_of(ensemble)
    names = ["total_tenders", *[f"risk_{r}" for r in ("critical", "high", "medium", "low")],
             *[f"consensus_{i}_methods" for i in range(len(used) + 1)]]
    tests = [F.lit(True), *[F.col("ensemble_risk_level") == r for r in ("critical", "high", "medium", "low")],
             *[F.col("consensus_count") == i for i in range(len(used) + 1)]]
    n = F.count("*")
    entries = [
        F.struct(F.lit(name).alias("metric"), F.coalesce(F.sum(E.flag(t)), F.lit(0)).cast("long").alias("value"),
                 F.round(F.coalesce(F.sum(E.flag(t)), F.lit(0)) / n * 100, 2).alias("percentage"))
        for name, t in zip(names, tests, strict=True)
    ]
    return ensemble.agg(F.array(*entries).alias("m")).select(F.inline("m"))


def explanations(ensemble: DataFrame, tenders: DataFrame | None = None, rule_results: DataFrame | None = None,
                 network_results: DataFrame | None = None, portraits: DataFrame | None = None) -> DataFrame:
    """Text per tender: agreeing methods, fired rules, network signs and buyer portrait; empty below two votes."""
    rows = consensus(ensemble, 2)
    shown = [
        # Half up, also where the last bit of a score leaves it just below the half.
        F.when(F.col(f"{m}_anomaly") == 1, F.format_string(f"{METHOD_NAMES[m]}(%.2f)", F.floor(F.col(f"{m}_score") * 100 + 0.5 + 1e-7) / 100))
        for m in methods_of(ensemble)
    ]
    present = lambda items: F.filter(F.array(*items), lambda x: x.isNotNull())
    line = F.format_string("Консенсус: %d/5 (%s)", F.col("consensus_count"), F.array_join(present(shown), ", "))
    parts = [line]
    if rule_results is not None:
        flags = [c for c in rule_results.columns if c.startswith("flag_")]
        fired = rule_results.select("tender_id", present(
            [F.when(F.col(c) == 1, F.lit(c.removeprefix("flag_"))) for c in flags]).alias("_fired"))
        rows = rows.join(fired, "tender_id", "left")
        rest = F.when(F.size("_fired") > 8, F.format_string(" (+%d)", F.size("_fired") - 8)).otherwise("")
        parts.append(F.when(F.size("_fired") > 0, F.concat(
            F.lit("Правила: "), F.array_join(F.slice("_fired", 1, 8), ", "), rest)))
    if network_results is not None:
        names = [n for n in NETWORK_LABELS if n in network_results.columns]
        signs = network_results.select("tender_id", present(
            [F.when(F.col(n) == 1, F.lit(NETWORK_LABELS[n])) for n in names]).alias("_signs"))
        rows = rows.join(signs, "tender_id", "left")
        parts.append(F.when(F.size("_signs") > 0, F.concat(F.lit("Мережа: "), F.array_join("_signs", ", "))))
    if portraits is not None and tenders is not None:
        wanted = [c for c in ("single_bidder_rate", "supplier_diversity_index", "competitive_rate") if c in portraits.columns]
        own = portraits.select("buyer_id", *[F.col(c).alias(f"_p_{c}") for c in wanted])
        rows = rows.join(tenders.select("tender_id", "buyer_id"), "tender_id", "left").join(own, "buyer_id", "left")
        items = []
        if "single_bidder_rate" in wanted:
            v = F.col("_p_single_bidder_rate")
            items.append(F.when(v > 0.5, F.format_string("single_bidder=%.0f%%", v * 100)))
        if "supplier_diversity_index" in wanted:
            v = F.col("_p_supplier_diversity_index")
            items.append(F.when(v < 0.3, F.format_string("diversity=%.2f", v)))
        if "competitive_rate" in wanted:
            v = F.col("_p_competitive_rate")
            items.append(F.when(v < 0.1, F.format_string("competitive=%.0f%%", v * 100)))
        if items:
            rows = rows.withColumn("_portrait", present(items))
            parts.append(F.when(F.size("_portrait") > 0, F.concat(F.lit("Портрет: "), F.array_join("_portrait", ", "))))
    texts = rows.select("tender_id", F.concat_ws(" | ", *parts).alias("explanation"))
    return ensemble.join(texts, "tender_id", "left").select(
        "tender_id", "consensus_count", F.coalesce("explanation", F.lit("")).alias("explanation"))
