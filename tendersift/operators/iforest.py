"""Isolation forest (Liu, Ting, Zhou 2008) grown level by level with window aggregates, scored in Arrow batches.

Draws, features and cuts come from arithmetic on a number of the key and from MD5 of (tree, node), so a forest depends on the rows and
the seed only, and SQL can grow the same one. One sampling law holds at all sizes: every tree takes the ``sample`` rows with the
smallest hash of (key, tree). Rows meet a tree only if that hash is below a bound that lets about six times the sample
through, so no more than that is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tendersift.schemas import SEED
from tendersift.session import cut_lineage

#: A prime below 2^31: products of two remainders fit a long.
PRIME = 2147483647
#: Targets and cuts are fractions of these, exact in binary.
Y_STEPS, CUT_STEPS, FIXED = 1 << 20, 1 << 30, 1 << 32


def key_number(keys: Sequence[str]) -> Column:
    """60 bits of the MD5 of the keys joined by bars."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).cast("binary")), 1, 15), 16, 10).cast("long")


def draw(k: Column, t: Column | int, seed: int) -> Column:
    """A number below PRIME from a row's number and a tree's."""
    x = (k % PRIME * 48271 + t * 69621 + seed) % PRIME
    x = (x * x + k % 1000003 + 7) % PRIME
    x = (x * 16807 + t * 31 + 11) % PRIME
    return (x * x + x) % PRIME


def _node_number(t: Column, node: Column, use: str, seed: int) -> Column:
    text = F.concat_ws("|", F.lit(seed), t, node, F.lit(use)).cast("binary")
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _path_rest(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search among n values."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    out[n == 2] = 1.0
    big = n > 2
    out[big] = 2 * (np.log(n[big] - 1) + np.euler_gamma) - 2 * (n[big] - 1) / n[big]
    return out


def height_of(sample: int) -> int:
    return int(np.ceil(np.log2(max(sample, 2))))


def fit(df: DataFrame, key: str, n_trees: int = 100, sample: int = 256, seed: int = SEED) -> DataFrame:
    """Nodes (t, node, depth, n, variance, feature, cut) of a forest on (key number, features).

    Node i has the children 2 i (up to the cut) and 2 i + 1; leaves have no feature. ``variance`` is that of a target drawn per row, the
    measure by which the importance of a feature is taken. All levels are one job: a tree's rows are shuffled once.
    """
    head = df.agg(F.count("*").alias("n"), F.max(F.size("features")).alias("m")).first()
    n, m = head["n"], head["m"] or 0
    sample = min(sample, max(n, 1))
    height = height_of(sample)
    chance = min(1.0, 6 * sample / max(n, 1))
    rows = df.select(F.col(key).alias("k"), "features").withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))))
    drawn = rows.withColumn("h", draw(F.col("k"), F.col("t"), seed)).where(F.col("h") < int(PRIME * chance))
    picked = drawn.withColumn("rn", F.row_number().over(Window.partitionBy("t").orderBy("h", "k"))).where(F.col("rn") <= sample)
    target = (draw(F.col("k"), n_trees, seed) % Y_STEPS) / float(Y_STEPS)
    level = picked.select("t", target.alias("y"), *[F.col("features")[i].alias(f"f{i}") for i in range(m)], F.lit(1).cast("long").alias("node"))
    level = level.withColumn("path", F.array().cast("array<struct<node:bigint,depth:int,n:bigint,variance:double,feature:int,cut:double>>"))
    each = [f"f{i}" for i in range(m)]
    for depth in range(height + 1):
        own = Window.partitionBy("t", "node")
        level = level.withColumns({
            "n": F.count("*").over(own), "sy": F.sum("y").over(own), "syy": F.sum(F.col("y") * F.col("y")).over(own),
            "lo": F.array(*[F.min(c).over(own) for c in each]), "hi": F.array(*[F.max(c).over(own) for c in each])})
        open_ = F.filter(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.get("hi", i) > F.get("lo", i)) if m else F.array().cast("array<int>")
        level = level.withColumn("open", open_).withColumn("feature", F.when(
            (F.lit(depth) < height) & (F.col("n") >= 2) & (F.size("open") > 0),
            F.get("open", (_node_number(F.col("t"), F.col("node"), "f", seed) % F.greatest(F.size("open"), F.lit(1))).cast("int"))))
        share = (_node_number(F.col("t"), F.col("node"), "u", seed) % CUT_STEPS) / float(CUT_STEPS)
        low, high = F.get("lo", "feature"), F.get("hi", "feature")
        level = level.withColumn("cut", low + (high - low) * share)
        mean = F.col("sy") / F.col("n")
        entry = F.struct("node", F.lit(depth).alias("depth"), "n", (F.col("syy") / F.col("n") - mean * mean).alias("variance"), "feature", "cut")
        value = F.get(F.array(*[F.col(c) for c in each]), F.col("feature")) if m else F.lit(0.0)
        child = F.when(F.col("feature").isNotNull(), 2 * F.col("node") + (value > F.col("cut")).cast("long"))
        path = F.when(F.col("node").isNotNull(), F.concat("path", F.array(entry))).otherwise(F.col("path"))
        level = level.select("t", "y", *each, child.alias("node"), path.alias("path"))
    nodes = level.select("t", F.inline("path"))
    return nodes.groupBy("t", "node").agg(*[F.first(c).alias(c) for c in ("depth", "n", "variance", "feature", "cut")])


def score(df: DataFrame, trees: DataFrame, keys: Sequence[str], n_trees: int = 100) -> DataFrame:
    """``raw_score`` = 2^(-mean path / expected path). The nodes are at most ``n_trees`` times twice the sample.

    Path lengths are summed in fixed point, so equal rows have equal scores whatever the order of the trees.
    """
    nodes = trees.toPandas()
    if not len(nodes):
        return df.select(*keys, F.lit(None).cast("double").alias("raw_score"))
    sample = int(nodes.loc[nodes["node"] == 1, "n"].max())
    norm = float(_path_rest(np.array([sample]))[0]) or 1.0
    width = int(nodes["node"].max()) + 1
    shape = (int(nodes["t"].max()) + 1, width)
    feature, cut, rest = np.full(shape, -1, np.int16), np.zeros(shape), np.zeros(shape, np.int64)
    at = nodes["t"].to_numpy(), nodes["node"].to_numpy()
    feature[at] = nodes["feature"].fillna(-1).to_numpy(np.int16)
    cut[at] = nodes["cut"].fillna(0.0).to_numpy()
    rest[at] = nodes["depth"].to_numpy(np.int64) * FIXED + np.round(_path_rest(nodes["n"].to_numpy()) * FIXED).astype(np.int64)
    # One table per tree: a leaf leads to itself, whatever the value, so that all rows take the same steps.
    nodes_at, inner = np.arange(width, dtype=np.int64), feature >= 0
    child = np.where(inner[..., None], 2 * nodes_at[None, :, None] + np.arange(2), nodes_at[None, :, None])
    steps = [int(depth) for depth in nodes.groupby("t")["depth"].max().reindex(range(shape[0]), fill_value=0)]
    first, second = np.maximum(feature, 0).astype(np.int64), child.reshape(shape[0], -1)
    shared = df.sparkSession.sparkContext.broadcast((first, cut, second, rest, steps))

    @F.pandas_udf("double")
    def isolation(features: pd.Series) -> pd.Series:
        first, cut, second, rest, steps = shared.value
        x = np.stack(features.to_numpy())
        total, at = np.zeros(len(x), np.int64), np.arange(len(x)) * x.shape[1]
        flat = np.ascontiguousarray(x).ravel()
        for t, depth in enumerate(steps):
            node = np.ones(len(x), np.int64)
            for _ in range(depth):
                right = flat.take(at + first[t].take(node)) > cut[t].take(node)
                node = second[t].take(2 * node + right)
            total += rest[t].take(node)
        return pd.Series(np.power(2.0, -total / float(FIXED) / len(steps) / norm))

    return df.select(*keys, isolation("features").alias("raw_score"))


def importances(trees: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean over the trees of a feature's share of the variance that a tree's splits take away."""
    child = trees.select("t", F.floor(F.col("node") / 2).alias("node"), (F.col("n") * F.col("variance")).alias("left_over"))
    below = child.groupBy("t", "node").agg(F.sum("left_over").alias("below"))
    gains = trees.where("feature IS NOT NULL").join(below, ["t", "node"]).select(
        "t", "feature", (F.col("n") * F.col("variance") - F.col("below")).alias("gain"))
    per = gains.groupBy("t", "feature").agg(F.sum("gain").alias("gain"))
    share = F.try_divide(F.col("gain"), F.sum("gain").over(Window.partitionBy("t")))
    total = trees.agg(F.count_distinct("t")).scalar()
    mean = per.withColumn("share", share).groupBy("feature").agg(F.sum("share").alias("s"))
    names = reduce(lambda a, b: a.unionByName(b), [trees.sparkSession.range(1).select(F.lit(i).alias("feature"), F.lit(f).alias("name"))
                                                  for i, f in enumerate(features)])
    return names.join(mean, "feature", "left").select(F.col("name").alias("feature"), (F.coalesce("s", F.lit(0.0)) / total).alias("importance")).orderBy(
        F.desc("importance"), "feature")


def fit_score(df: DataFrame, keys: Sequence[str], **options) -> tuple[DataFrame, DataFrame]:
    """Raw scores and the nodes they come from."""
    base = cut_lineage(df.withColumn("_key", key_number(keys)))
    trees = cut_lineage(fit(base, "_key", **options))
    return score(base, trees, keys), trees
