"""Labelled scenarios among real rows and how well the detectors find them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from tendersift.functions import expr as E


def inject(real: DataFrame, labelled: DataFrame) -> DataFrame:
    """Real rows followed by labelled ones, on the columns both have; real rows have no scenario."""
    common = [c for c in real.columns if c in labelled.columns and c not in ("is_synthetic", "scenario")]
    mark = lambda df, s, y: df.select(*common, F.lit(y).alias("is_synthetic"), s.alias("scenario"))
    return mark(real, F.lit(None).cast("string"), 0).unionByName(mark(labelled, F.col("scenario"), 1))


def scenario_checks(labelled: DataFrame) -> DataFrame:
    """Per scenario: rows whose award exceeds 101 % of the value, and the share of weekend rows."""
    over = F.col("award_value") > F.col("tender_value") * 1.01
    return labelled.groupBy("scenario").agg(
        F.count("*").alias("tenders"), F.sum(E.flag(over)).alias("award_too_high"), F.avg("is_weekend").alias("weekend_share"))


def fired_flags(results: DataFrame, scenarios: DataFrame, flags: Sequence[str]) -> DataFrame:
    """(scenario, flag, fired) with fired > 0: one aggregate per scenario, then an unpivot."""
    joined = results.select("tender_id", *flags).join(scenarios.select("tender_id", "scenario"), "tender_id")
    sums = joined.groupBy("scenario").agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in flags])
    return sums.unpivot(["scenario"], list(flags), "flag", "fired").where("fired > 0")


def detection(results: DataFrame, scenarios: DataFrame, score: str, anomaly: str) -> DataFrame:
    """Per scenario: rows, flagged rows, rate and mean score of one detector."""
    joined = scenarios.select("tender_id", "scenario").join(
        results.select("tender_id", F.col(score).alias("s"), F.col(anomaly).alias("a")), "tender_id", "left")
    return joined.groupBy("scenario").agg(
        F.count("*").alias("n"), F.sum(F.coalesce("a", F.lit(0))).alias("flagged"),
        (F.avg(F.coalesce("a", F.lit(0))) * 100).alias("rate_pct"), F.avg("s").alias("mean_score"))


def _fired(signals: Mapping[str, tuple[DataFrame, Mapping[str, Sequence[str]]]]) -> tuple[DataFrame, list[tuple[str, str, str]]]:
    """Signs that stand, as (tender_id, family, signal), and which of them count: (scenario, family, signal)."""
    spec, fired = [], None
    for family, (results, relevant) in signals.items():
        spec += [(scenario, family, name) for scenario, names in relevant.items() for name in names]
        names = sorted({n for group in relevant.values() for n in group if n in results.columns})
        part = results.select("tender_id", *[F.col(n).cast("int").alias(n) for n in names]).unpivot("tender_id", names, "signal", "v")
        part = part.where("v > 0").select("tender_id", F.lit(family).alias("family"), "signal")
        fired = part if fired is None else fired.unionByName(part)
    return fired, spec


def detection_matrix(labelled: DataFrame, signals: Mapping[str, tuple[DataFrame, Mapping[str, Sequence[str]]]],
                     models: Mapping[tuple[str, str], DataFrame], expected: Mapping[str, Sequence[str]], by_buyer: Sequence[str]) -> DataFrame:
    """One row per scenario: share of rows with a sign that counts for it (by family), what the models name, and the coverage.

    ``signals``: family -> (results, scenario -> signs). ``models``: (buyer or pair, algorithm) -> results with ``anomaly``.
    A model is read at the levels where the scenario is ``expected``; scenarios in ``by_buyer`` are found by any pair of their buyer.
    Shares are null where no sign of the family counts, models where none is expected; ``detected`` of ``expected`` parts see a scenario.
    """
    spark = labelled.sparkSession
    rows = labelled.select("tender_id", "scenario", "buyer_id", "supplier_id")
    fired, spec = _fired(signals)
    # The table of what counts has one row per scenario and sign.
    counts = spark.createDataFrame(spec, "scenario string, family string, signal string")
    hits = rows.join(fired, "tender_id").join(F.broadcast(counts), ["scenario", "family", "signal"]).select("scenario", "family", "tender_id").distinct()
    per = hits.groupBy("scenario").agg(*[F.sum(E.flag(F.col("family") == f)).alias(f) for f in signals])
    out = rows.groupBy("scenario").agg(F.count("*").alias("n")).join(per, "scenario", "left")
    for family in signals:
        known = sorted({s for s, f, _ in spec if f == family})
        out = out.withColumn(f"{family}_pct", F.when(F.col("scenario").isin(known), F.round(F.coalesce(family, F.lit(0)) / F.col("n") * 100, 1))).drop(family)
    entities = rows.select("scenario", "buyer_id", "supplier_id").distinct()
    algorithms = list(dict.fromkeys(a for _, a in models))
    for (level, algorithm), results in models.items():
        named = results.where("anomaly = 1")
        any_pair = F.col("e.scenario").isin(list(by_buyer)) | (F.col("e.supplier_id") == F.col("m.supplier_id")) if level == "pair" else F.lit(True)
        found = entities.alias("e").join(named.alias("m"), (F.col("e.buyer_id") == F.col("m.buyer_id")) & any_pair, "left_semi")
        mark = found.select("scenario").distinct().withColumn(f"_{algorithm}_{level}", F.lit(True))
        out = out.join(mark, "scenario", "left")
    for algorithm in algorithms:
        text = F.lit(None).cast("string")
        for scenario, levels in expected.items():
            seen = [F.concat(F.lit(f"{x[0].upper()}:"), F.when(F.col(f"_{algorithm}_{x}"), "Y").otherwise("N")) for x in levels]
            if seen:
                text = F.when(F.col("scenario") == scenario, F.concat_ws(" ", *seen)).otherwise(text)
        out = out.withColumn(algorithm, text)
    tests = [F.col(f"{f}_pct") > 0 for f in signals] + [F.col(a).contains("Y") for a in algorithms]
    parts = [f"{f}_pct" for f in signals] + algorithms
    total = lambda flags: sum((E.flag(t) for t in flags), F.lit(0))
    return out.select("scenario", "n", *parts, total(F.coalesce(t, F.lit(False)) for t in tests).alias("detected"),
                      total(F.col(c).isNotNull() for c in parts).alias("expected"))
