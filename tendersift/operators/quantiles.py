"""Exact quantiles with linear interpolation that never gather a whole group.

``percentile`` keeps every distinct value of a group in one aggregation buffer, so one hot group decides
the memory of a task. Here a bounded sketch first brackets each quantile, a second pass counts the rows
below the bracket, and only the few distinct values inside it are ordered. The result is exact: the rank
of every candidate is known from the counts, the sketch only decides how many candidates there are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame, Window, functions as F

from tendersift.session import cut_lineage

ACCURACY = 10_000
MARGIN = 3.0 / ACCURACY


def exact_quantiles(df: DataFrame, keys: Sequence[str], wanted: Mapping[str, tuple[Column, float]]) -> DataFrame:
    """One row per key with a column per entry of ``wanted`` (name -> (value column, probability)).

    Nulls are ignored. With no keys the result is a single row. Null keys are dropped.
    """
    names = list(wanted)
    probs = [wanted[n][1] for n in names]
    # Entries that share a column share its sketch (a few kilobytes per column and group) and its row below.
    values = list({id(wanted[n][0]): wanted[n][0] for n in names}.values())
    own = [next(j for j, v in enumerate(values) if v is wanted[n][0]) for n in names]
    source = df.select(*keys, *[v.cast("double").alias(f"_x{j}") for j, v in enumerate(values)])
    for key in keys:
        source = source.where(F.col(key).isNotNull())
    # In the order of their probabilities, brackets of a column leave gaps; all rows of a gap are on the same side of each bracket.
    order = [sorted((i for i in range(len(names)) if own[i] == j), key=lambda i: probs[i]) for j in range(len(values))]
    cuts = [[c for i in o for c in (max(probs[i] - MARGIN, 0.0), min(probs[i] + MARGIN, 1.0))] for o in order]
    sketch = F.array(*[F.percentile_approx(f"_x{j}", c, ACCURACY) for j, c in enumerate(cuts)])
    one_by_one = F.posexplode(F.array(*[F.col(f"_x{j}") for j in range(len(values))])).alias("j", "x")
    if keys:
        # Written, so that the join is planned by their size and not by that of the rows.
        brackets = cut_lineage(source.groupBy(*keys).agg(sketch.alias("_b")))
        rows = source.join(brackets, list(keys)).select(*keys, one_by_one, "_b")
    else:
        rows = source.select(one_by_one).withColumn("_b", source.agg(sketch.alias("_b")).scalar())
    bound = lambda k: F.get(F.get("_b", F.col("j")), F.lit(k))
    most = max(map(len, order), default=0)
    inside = [F.coalesce((F.col("x") >= bound(2 * k)) & (F.col("x") <= bound(2 * k + 1)), F.lit(False)) for k in range(most)]
    above = [F.coalesce((F.col("x") > bound(2 * k + 1)).cast("int"), F.lit(0)) for k in range(most)]
    counted = (
        rows.where(F.col("x").isNotNull())
        .select(*keys, "j", "x", F.when(reduce(or_, inside), F.col("x")).alias("candidate"), reduce(add, above).alias("gap"))
        .groupBy(*keys, "j", "candidate", F.when(F.col("candidate").isNull(), F.col("gap")).alias("gap"))
        .agg(F.count("*").alias("c"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    )
    # The nearest value stands for a gap: its largest for the brackets above it, its smallest for those below.
    each = F.posexplode(F.element_at(F.array(*[F.array(*map(F.lit, o)) for o in order]), F.col("j") + 1)).alias("r", "q")
    ordered = counted.select(*keys, each, "gap", "c", "lo", "hi").withColumn("x", F.when(F.col("gap") > F.col("r"), F.col("lo")).otherwise(F.col("hi")))
    group = Window.partitionBy(*keys, "q")
    running = group.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    ranked = ordered.withColumn("upto", F.sum("c").over(running)).withColumn("n", F.sum("c").over(group))
    position = (F.col("n") - 1) * F.element_at(F.array(*[F.lit(p) for p in probs]), F.col("q") + 1)
    # Floating error must not push a whole position such as 0.1 * 10 to the next rank.
    nearest = F.round(position)
    position = F.when(F.abs(position - nearest) < 1e-9, nearest).otherwise(position)
    at = ranked.withColumn("h", position)
    first_at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("x")))
    picked = at.groupBy(*keys, "q").agg(
        first_at(F.floor("h")).alias("v0"), first_at(F.ceil("h")).alias("v1"),
        F.max(F.col("h") - F.floor("h")).alias("w"),
    ).withColumn("v", F.col("v0") + (F.col("v1") - F.col("v0")) * F.col("w"))
    return (picked.groupBy(*keys) if keys else picked.groupBy()).agg(
        *[F.max(F.when(F.col("q") == i, F.col("v"))).alias(n) for i, n in enumerate(names)]
    )


def one_row(df: DataFrame, *columns: Column | str) -> Column:
    """A one-row result as a struct literal: a scalar subquery, planned once and reused."""
    return df.select(F.struct(*columns).alias("s")).scalar()
