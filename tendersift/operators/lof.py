"""Exact local outlier factor by a join with the nearest neighbours whose both sides are split.

Equal vectors are kept once with their count. Pivots of two levels, both chosen by hash, cut the space into cells of about
``CELL`` vectors: every vector belongs to its nearest top pivot and to the nearest sub-pivot below that one. A vector is first
compared with its own cell, which bounds the distance of its k-th neighbour. Then it asks the cells that can hold a nearer one:
the triangle inequality and the bisecting planes of the pivots (vectors of a cell lie on their pivot's side) rule out the rest.

Askers and stored vectors of a cell are both dealt into blocks by hash, and every pair of blocks is one group, so no group
holds more than about ``BLOCK`` rows of either side, however many vectors one cell holds or is asked by. A group gives its k + 1
best per asker; these lists are merged in a second step. Neighbours at equal distance are taken in the order of their
smallest id. (Breunig et al. 2000.)
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tendersift.session import cut_lineage

MAX_TOP, MAX_SUB, CELL = 1024, 256, 512
BLOCK = 1024
CHUNK = 256


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, 0))


@dataclass
class Cells:
    """Pivots of both levels and what is known of their cells; its size is bounded by MAX_TOP x MAX_SUB pivots."""

    tops: np.ndarray
    subs: np.ndarray
    first: np.ndarray
    """Cells of top j have the numbers first[j] to first[j + 1]."""
    top_radius: np.ndarray | None = None
    radius: np.ndarray | None = None
    reach: np.ndarray | None = None
    """Distance from the pivot within which a cell has k + 1 vectors."""

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cell, distance to its sub-pivot and to its top pivot."""
        d = _distances(x, self.tops)
        top = d.argmin(axis=1)
        cell, near = np.zeros(len(x), np.int64), np.zeros(len(x))
        for j in np.unique(top):
            rows = np.flatnonzero(top == j)
            inner = _distances(x[rows], self.subs[self.first[j]:self.first[j + 1]])
            cell[rows] = self.first[j] + inner.argmin(axis=1)
            near[rows] = inner.min(axis=1)
        return cell, near, d[np.arange(len(x)), top]

    def open(self, x: np.ndarray, own: np.ndarray, limit: np.ndarray) -> list[np.ndarray]:
        """Numbers of the cells other than the own one that can hold a vector within ``limit``; limits may be infinite."""
        d = _distances(x, self.tops)
        least = d.argmin(axis=1)
        # A bound from any cell with enough vectors may be better than the one from the own cell.
        slack = 1e-9 * (1 + d.max(axis=1))
        bisect = _bisecting(d, least, self.tops)
        lower = np.maximum(d - self.top_radius, bisect)
        found: list[list[np.ndarray]] = [[] for _ in x]
        order = np.argsort(lower.min(axis=0))
        for j in order.tolist():
            cells = slice(self.first[j], self.first[j + 1])
            rows = np.flatnonzero(lower[:, j] <= limit + slack)
            if not len(rows):
                continue
            inner = _distances(x[rows], self.subs[cells])
            limit[rows] = np.minimum(limit[rows], (inner + self.reach[cells]).min(axis=1))
            edge = np.maximum(inner - self.radius[cells], _bisecting(inner, inner.argmin(axis=1), self.subs[cells]))
            near = edge <= limit[rows, None] + slack[rows, None]
            for r, keep in zip(rows.tolist(), near):
                found[r].append(self.first[j] + np.flatnonzero(keep))
        out = []
        for r, parts in enumerate(found):
            cells_ = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            out.append(cells_[cells_ != own[r]])
        return out


def _bisecting(d: np.ndarray, near: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distance to the plane between the nearest pivot and each other one: all that is nearer to the other lies beyond it."""
    between = _distances(pivots, pivots)[near]
    own = d[np.arange(len(d)), near][:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        plane = (d**2 - own**2) / (2 * between)
    return np.where(between > 0, plane, 0.0)


def _cells(points: DataFrame, k: int) -> tuple[Cells, DataFrame]:
    """The cells, and the points with their cell."""
    n = points.count()
    id_type = points.schema["id"].dataType.simpleString()
    by_hash = [F.xxhash64("id", F.lit(7)), F.col("id")]
    width = int(min(MAX_TOP, max(1, np.ceil(np.sqrt(n / CELL)))))
    tops = _matrix(points.orderBy(*by_hash).limit(width).select("features").toPandas()["features"])
    level = Cells(tops, tops, np.arange(len(tops) + 1))

    def nearest(batches):
        for pdf in batches:
            cells = [level.place(_matrix(part["features"]))[0] for part in _chunks(pdf)]
            yield pdf.assign(top=np.concatenate(cells).astype("int32"))

    topped = cut_lineage(points.select("id", "m", "features").mapInPandas(nearest, f"id {id_type}, m long, features array<double>, top int"))
    wanted = F.least(F.ceil(F.col("size") / CELL), F.lit(MAX_SUB))
    first = topped.withColumn("rn", F.row_number().over(Window.partitionBy("top").orderBy(*by_hash))).where(F.col("rn") <= MAX_SUB)
    sizes = topped.groupBy("top").agg(F.count("*").alias("size"))
    subs = first.join(sizes, "top").where(F.col("rn") <= wanted).select("top", "rn", "features").orderBy("top", "rn").toPandas()
    number = np.bincount(subs["top"].to_numpy(), minlength=len(tops))
    cells = Cells(tops, _matrix(subs["features"]), np.concatenate(([0], np.cumsum(number))))

    def assign(batches):
        for pdf in batches:
            cell, near, far = (np.concatenate(c) for c in zip(*(cells.place(_matrix(part["features"])) for part in _chunks(pdf))))
            yield pdf.assign(cell=cell.astype("int32"), to_pivot=near, to_top=far)

    placed = cut_lineage(topped.mapInPandas(assign, f"id {id_type}, m long, features array<double>, top int, cell int, to_pivot double, to_top double"))
    ranked = placed.withColumn("rn", F.row_number().over(Window.partitionBy("cell").orderBy("to_pivot", "id"))).where(F.col("rn") <= k + 1)
    near = ranked.groupBy("cell").agg(F.count("*").alias("held"), F.max("to_pivot").alias("near"))
    stats = placed.groupBy("cell").agg(F.max("to_pivot").alias("radius")).join(near, "cell").toPandas()
    outer = placed.groupBy("top").agg(F.max("to_top").alias("radius")).toPandas()
    cells.radius, cells.reach = np.full(len(cells.subs), -np.inf), np.full(len(cells.subs), np.inf)
    cells.top_radius = np.full(len(tops), -np.inf)
    cells.radius[stats["cell"]] = stats["radius"]
    full = stats[stats["held"] > k]
    cells.reach[full["cell"]] = full["near"]
    cells.top_radius[outer["top"]] = outer["radius"]
    return cells, placed


def _chunks(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
    for start in range(0, len(pdf), CHUNK):
        yield pdf.iloc[start:start + CHUNK]


def dealt(asked: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with (cell, a, s): askers' block a meets the stored block s in one group."""
    sizes = cut_lineage(asked.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("na"))
                        .join(stored.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("ns")), "cell"))

    def deal(rows: DataFrame, own: str, other: str) -> DataFrame:
        of, others = f"n{own}", f"n{other}"
        # Dealt by another hash than the exchange's own.
        return rows.join(sizes, "cell").withColumn(own, F.pmod(F.xxhash64("id", F.lit(11)), F.col(of))).withColumn(
            other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(others) - 1))).drop("na", "ns")

    return deal(asked, "a", "s"), deal(stored, "s", "a")


def _best(x: np.ndarray, limit: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and distance of the k + 1 nearest columns within each row's limit, columns in order at equal distance."""
    square = (x**2).sum(axis=1)[:, None] + (y**2).sum(axis=1) - 2 * (x @ y.T)
    slack = 1e-10 * ((x**2).sum(axis=1).max(initial=0) + (y**2).sum(axis=1).max(initial=0)) + 1e-300
    most = np.minimum(limit**2 * (1 + 1e-9), np.partition(square, k, axis=1)[:, k] if y.shape[0] > k + 1 else np.inf)
    row, col = np.nonzero(square <= most[:, None] + 2 * slack)
    d = np.sqrt(((x[row] - y[col]) ** 2).sum(axis=1))
    order = np.lexsort((col, d, row))
    row, col, d = row[order], col[order], d[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) <= k
    return row[keep], col[keep], d[keep]


def _search(asked: DataFrame, stored: DataFrame, k: int) -> DataFrame:
    """(id, other, distance, m) for asked (id, features, ub, cell) among stored (id, m, features, cell): partial lists."""
    id_type = stored.schema["id"].dataType.simpleString()
    left, right = dealt(asked.toDF(*asked.columns), stored)  # both may come from one table, so one side gets columns of its own

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"id": a["id"].iloc[:0], "other": b["id"].iloc[:0], "distance": np.zeros(0), "m": np.zeros(0, np.int64)})]
        if len(a) and len(b):
            b = b.sort_values("id")
            y, ids, copies = _matrix(b["features"]), b["id"].to_numpy(), b["m"].to_numpy()
            for part in _chunks(a):
                row, col, d = _best(_matrix(part["features"]), part["ub"].to_numpy(), y, k)
                out.append(pd.DataFrame({"id": part["id"].to_numpy()[row], "other": ids[col], "distance": d, "m": copies[col]}))
        return pd.concat(out[1:] or out)

    groups = ["cell", "a", "s"]
    return left.groupBy(*groups).cogroup(right.groupBy(*groups)).applyInPandas(search, f"id {id_type}, other {id_type}, distance double, m long")


def neighbours(points: DataFrame, k: int) -> DataFrame:
    """For points (id, m, features): rows (id, other, distance, weight) of the k nearest others, counting copies.

    ``weight`` is the number of copies of ``other`` among the k. A point's own copies come first.
    """
    id_type = points.schema["id"].dataType.simpleString()
    cells, placed = _cells(points, k)
    stored = placed.select("id", "m", "features", "cell")
    own = cut_lineage(_search(placed.select("id", "features", F.lit(float("inf")).alias("ub"), "cell"), stored, k))
    nearest = Window.partitionBy("id").orderBy("distance", "other")
    bound = (own.withColumn("rn", F.row_number().over(nearest)).where(F.col("rn") <= k + 1)
             .groupBy("id").agg(F.max("distance").alias("far"), F.count("*").alias("held")))
    limited = placed.select("id", "features", "cell").join(bound, "id").select(
        "id", "features", "cell", F.when(F.col("held") > k, F.col("far")).otherwise(float("inf")).alias("ub"))

    def route(batches):
        for pdf in batches:
            targets, limits = [], []
            for part in _chunks(pdf):
                limit = part["ub"].to_numpy(copy=True)
                targets += [t.astype("int32") for t in cells.open(_matrix(part["features"]), part["cell"].to_numpy(), limit)]
                limits.append(limit)
            yield pd.DataFrame({"id": pdf["id"], "features": pdf["features"], "ub": np.concatenate(limits), "targets": targets})

    routed = cut_lineage(limited.mapInPandas(route, f"id {id_type}, features array<double>, ub double, targets array<int>").where(F.size("targets") > 0))
    more = _search(routed.select("id", "features", "ub", F.explode("targets").alias("cell")), stored, k)
    found = own.unionByName(more)
    order = [F.col("distance"), (F.col("other") != F.col("id")).cast("int"), F.col("other")]
    by_id = Window.partitionBy("id").orderBy(*order)
    copies = F.when(F.col("other") == F.col("id"), F.col("m") - 1).otherwise(F.col("m"))
    top = found.withColumn("rn", F.row_number().over(by_id)).where(F.col("rn") <= k + 1).withColumn("m", copies)
    before = F.coalesce(F.sum("m").over(by_id.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    used = F.least(F.col("m"), F.lit(k) - F.col("before"))
    return top.withColumn("before", before).withColumn("weight", used).where("weight > 0").select("id", "other", "distance", "weight")


def lof_scores(df: DataFrame, keys: Sequence[str], k: int = 20) -> DataFrame:
    """``raw_score`` = local outlier factor of each row's ``features`` array."""
    rows = cut_lineage(df.select(*keys, "features"))
    total = rows.count()
    k = max(1, min(k, total - 1))
    name = F.col(keys[0]) if len(keys) == 1 else F.concat_ws("|", *keys)
    points = cut_lineage(rows.groupBy("features").agg(F.min(name).alias("id"), F.count("*").alias("m")).where("id IS NOT NULL"))
    if total < 2:
        return rows.withColumn("raw_score", F.lit(1.0))
    near = cut_lineage(neighbours(points, k))
    reach = near.groupBy("id").agg(F.max("distance").alias("kdist"))
    density = cut_lineage(
        near.join(reach.select(F.col("id").alias("other"), "kdist"), "other").groupBy("id").agg(
            (1 / (F.sum(F.greatest("distance", "kdist") * F.col("weight")) / F.sum("weight") + 1e-10)).alias("lrd")))
    scores = near.join(density.select(F.col("id").alias("other"), F.col("lrd").alias("lrd_other")), "other").groupBy("id").agg(
        (F.sum(F.col("lrd_other") * F.col("weight")) / F.sum("weight")).alias("around")
    ).join(density, "id").select("id", (F.col("around") / F.col("lrd")).alias("raw_score"))
    named = points.join(scores, "id").select("features", "raw_score")
    return rows.join(named, "features").select(*keys, "raw_score")
