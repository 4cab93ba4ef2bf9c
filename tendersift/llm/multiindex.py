"""Hard negatives by an inverted multi-index.

Vectors are cut into two halves with a codebook each; a pair of codes is a cell of the index. A query has a half score for
every code: its inner product with the code plus its length times the code's radius, which no vector of the code exceeds
in that half. A multi-sequence heap pops cells by the sum of both half scores, so the bound of the next cell holds for
all that are left. A window of scores is certified when the next bound is below its last place: no cell left can
change it. Cells whose lower bounds are above all windows of a query are passed over.

Queries go in blocks of ``BLOCK_BYTES`` of vectors, whatever their number. For a block the heaps run in tasks; the cells
they name are read from the written index by all tasks, scores are matrix products, and tasks keep what the windows of a
query need. The first visit reads about ``FIRST`` rows for each query to find floors, the second one all cells whose bounds reach
these floors. Each vector is read by one task of a visit, whatever its cell, so a cell with a third of all rows is no
hot spot; nothing but candidates is shuffled.

The codebooks are fitted on at most ``SAMPLE`` rows, those with the least hash of their id; every row is indexed, and bounds
hold for every row, so results are exact (recall 1). Codes per half: sqrt(rows / 256), between 2 and 64.

On data without clusters bounds in so many dimensions exclude next to nothing, and the work is queries times rows.

Defined cases: rows with a null id, label or vector, with null or non-finite components, with components too large for 64-bit
scores (2^20 at 64 dimensions), or with another than the most frequent number of components (the larger if equal) take no
part. Of rows that share an id, the one with the least label and vector stays. Equal scores are ordered by id. An empty table,
or one without queries, gives no rows. Only vec_id, embedding and label are read: other columns do not matter.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tendersift.llm.common import arrow_schema, in_arrays, parts, prepare, staged, table

SAMPLE, BLOCK_BYTES, FIRST, PIECE = 16384, 1 << 21, 4096, 1 << 20
EVER = (1 << 62) - 1


def integral(embeddings: DataFrame, label: Column) -> tuple[DataFrame, int]:
    """(vec_id, label, v array of long) of the rows that take part, and the number of components."""
    x = F.transform("embedding", lambda e: F.floor(256 * e.cast("double")))
    finite = F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf")))
    given = embeddings.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").where(finite)
    sizes = given.groupBy(F.size("embedding").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if sizes is None or sizes["dims"] < 1:
        return given.limit(0).select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), x.alias("v")), 0
    dims = sizes["dims"]
    most = float(1 << ((62 - (dims - 1).bit_length()) // 2))
    fits = F.forall("embedding", lambda e: F.abs(256 * e.cast("double")) < most)
    rows = given.where(F.size("embedding") == dims).where(fits).select(
        F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), x.alias("v"))
    twice = staged(rows.groupBy("vec_id").count().where("count > 1").select("vec_id"))
    if not twice.isEmpty():
        one = rows.join(twice, "vec_id", "left_semi").groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r"))
        rows = rows.join(twice, "vec_id", "left_anti").unionByName(one.select("vec_id", "r.label", "r.v"))
    return rows, dims


def codebook(points: np.ndarray, codes: int, rounds: int = 10) -> np.ndarray:
    """Centres of ``codes`` groups of points by Lloyd's rounds, from evenly spaced points on."""
    centres = points[np.linspace(0, len(points) - 1, min(codes, len(points))).astype(int)]
    for _ in range(rounds):
        own = nearest(points, centres)[0]
        number = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, points)
        centres = np.where(number[:, None] > 0, total / np.maximum(number, 1)[:, None], centres)
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centre and the distance from it."""
    own = ((centres**2).sum(axis=1) - 2 * (points @ centres.T)).argmin(axis=1)
    return own, np.sqrt(((points - centres[own]) ** 2).sum(axis=1))


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int32).reshape(-1, dims)


@dataclass
class Index:
    """``rows``: cell, vec_id, label, v; cells by number: their codes, row counts and radii in both halves."""

    rows: DataFrame
    dims: int
    halves: tuple[np.ndarray, np.ndarray]
    codes: np.ndarray
    count: np.ndarray
    radius: np.ndarray

    def split(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : self.dims // 2], x[:, self.dims // 2 :]


def build(rows: DataFrame, dims: int, sample: int = SAMPLE) -> Index:
    """Index every row of (vec_id, label, v)."""
    spark = rows.sparkSession
    rows = staged(rows)
    total = rows.count()
    codes = int(min(64, max(2, np.ceil(np.sqrt(total / 256)))))
    drawn = rows.select("v", F.xxhash64("vec_id").alias("h"), "vec_id").orderBy("h", "vec_id").limit(sample).toPandas()
    points = np.stack(drawn["v"].to_numpy()).astype(np.float64)
    half = dims // 2
    books = codebook(points[:, :half], codes), codebook(points[:, half:], codes)
    width = len(books[1])

    def place(batch: pa.RecordBatch):
        flat = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
        x = flat.astype(np.float64)
        (a, ra), (b, rb) = nearest(x[:, :half], books[0]), nearest(x[:, half:], books[1])
        yield [(a * width + b).astype(np.int32), batch.column(0), batch.column(1), [v.tobytes() for v in flat.astype(np.int32)], ra, rb]

    placed = in_arrays(rows.select("vec_id", "label", "v"), place, "cell int, vec_id bigint, label bigint, v binary, ra double, rb double")
    index = staged(placed.repartitionByRange(parts(spark), "cell", "vec_id").sortWithinPartitions("cell", "vec_id"))
    cells = (index.groupBy("cell").agg(F.count("*").alias("n"), F.max("ra").alias("ra"), F.max("rb").alias("rb"))
             .orderBy("cell").toPandas())  # at most 64 x 64 rows
    cell = cells["cell"].to_numpy(np.int64)
    return Index(index.drop("ra", "rb"), dims, books, np.stack([cell // width, cell % width]), cells["n"].to_numpy(np.int64),
                 np.stack([cells["ra"].to_numpy(), cells["rb"].to_numpy()]))


def visit_order(u: np.ndarray, w: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """Multi-sequence heap: pairs of codes by falling sum of their half scores."""
    left, right = np.argsort(-u, kind="stable"), np.argsort(-w, kind="stable")
    heap = [(-(u[left[0]] + w[right[0]]), 0, 0)]
    while heap:
        bound, i, j = heapq.heappop(heap)
        yield -bound, int(left[i]), int(right[j])
        if j + 1 < len(right):
            heapq.heappush(heap, (-(u[left[i]] + w[right[j + 1]]), i, j + 1))
        if j == 0 and i + 1 < len(left):
            heapq.heappush(heap, (-(u[left[i + 1]] + w[right[0]]), i + 1, 0))


def cells_to_visit(index: Index, vectors: np.ndarray, floors: np.ndarray, tops: np.ndarray, rows: int | None) -> Iterator[np.ndarray]:
    """For each query the numbers of cells that may hold a score from its floor to its top, best bounds first.

    With ``rows`` it ends as soon as the cells hold so many, else when no bound reaches the floor.
    """
    number = {pair: k for k, pair in enumerate(zip(*index.codes.tolist()))}
    ends = [np.zeros(len(book)) for book in index.halves]
    for e, c, r in zip(ends, index.codes, index.radius):
        np.maximum.at(e, c, r)
    halves = index.split(vectors.astype(np.float64))
    products = [h @ book.T for h, book in zip(halves, index.halves)]
    lengths = [np.sqrt((h**2).sum(axis=1)) for h in halves]
    for q in range(len(vectors)):
        # Rounding must not make a bound too small.
        slack = 1e-9 * sum(np.abs(p[q]).max(initial=0) + n[q] * e.max(initial=0) for p, n, e in zip(products, lengths, ends)) + 1e-6
        u, w = (p[q] + n[q] * e for p, n, e in zip(products, lengths, ends))
        found, held = [], 0
        for bound, i, j in visit_order(u, w):
            if bound + slack < floors[q] or (rows is not None and held >= rows):
                break
            k = number.get((i, j))
            if k is None:
                continue
            middle = products[0][q, i] + products[1][q, j]
            spread = lengths[0][q] * index.radius[0, k] + lengths[1][q] * index.radius[1, k] + slack
            if middle + spread >= floors[q] and middle - spread <= tops[q]:
                found.append(k)
                held += int(index.count[k])
        yield np.array(found, np.int64)


@dataclass
class Windows:
    """What each query of a block looks for: the ``want`` best scores in [low, high] of rows of its own label or of others."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    low: np.ndarray
    high: np.ndarray
    want: int
    own_label: bool

    def floors(self, best: np.ndarray) -> np.ndarray:
        """Least score that can still change a window, given the scores in the last places found (or -EVER)."""
        open_ = self.low <= self.high
        return np.where(open_, np.maximum(self.low, best), EVER).min(axis=1, initial=EVER)

    def tops(self) -> np.ndarray:
        return np.where(self.low <= self.high, self.high, -EVER).max(axis=1, initial=-EVER)

    def keep(self, q: np.ndarray, row: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the (query, row, score) that some window needs, and the score in the last place of each window."""
        order = np.lexsort((row, -score, q))
        q, score = q[order], score[order]
        needed = np.zeros(len(q), bool)
        last = np.full(self.low.shape, -EVER)
        for w in range(self.low.shape[1]):
            inside = np.flatnonzero((score >= self.low[q, w]) & (score <= self.high[q, w]))
            mine = q[inside]
            place = np.arange(len(mine)) - np.searchsorted(mine, mine)
            needed[inside[place < self.want]] = True
            full = place == self.want - 1
            last[mine[full], w] = score[inside[full]]
        return order[needed], last


def _products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact integer inner products, in floating point where that is exact too."""
    most = x.shape[1] * float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0))
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
    return (x.astype(kind) @ y.astype(kind).T).astype(np.int64)


def _scan(index: Index, windows: Windows, last: np.ndarray, visits: np.ndarray) -> DataFrame:
    """(query number, row_id, score) of the rows in visited cells that the windows may need. visits: bits, cell by query."""
    schema = "query int, row_id bigint, score bigint"
    arrow = arrow_schema(schema)
    dims = index.dims
    cells = index.codes[0] * len(index.halves[1]) + index.codes[1]
    total = len(windows.ids)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, tops = last.copy(), windows.tops()
        floors = windows.floors(seen)
        held = [np.zeros(0, np.int64)] * 3
        bits: dict[int, np.ndarray] = {}

        def look(cell: int, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> None:
            nonlocal held, floors, seen
            active = bits.get(cell)
            if active is None:
                k = int(np.searchsorted(cells, cell))
                active = bits[cell] = np.flatnonzero(np.unpackbits(visits[k], count=total))
            step = max(1, PIECE // max(1, len(active)))
            for at in range(0, len(ids) if len(active) else 0, step):
                part = slice(at, at + step)
                score = _products(x[part], windows.vectors[active])
                fit = (labels[part, None] == windows.labels[active]) == windows.own_label
                fit &= (score >= floors[active]) & (score <= tops[active]) & (ids[part, None] != windows.ids[active])
                row, q = np.nonzero(fit)
                held = [np.concatenate(p) for p in zip(held, (active[q], ids[part][row], score[row, q]))]
                if len(held[0]) > PIECE:
                    places, found = windows.keep(*held)
                    held = [h[places] for h in held]
                    seen = np.maximum(seen, found)
                    floors = windows.floors(seen)

        for batch in batches:
            cell, ids, labels = (batch.column(i).to_numpy() for i in range(3))
            cuts = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
            x = _vectors(batch.column(3), dims)
            for a, b in zip(cuts, cuts[1:]):
                if b > a:
                    look(int(cell[a]), ids[a:b], labels[a:b], x[a:b])
        places, _ = windows.keep(*held)
        yield pa.RecordBatch.from_arrays([pa.array(h[places], f.type) for h, f in zip(held, arrow)], schema=arrow)

    return index.rows.select("cell", "vec_id", "label", "v").mapInArrow(scan, schema)


def _visits(index: Index, queries: DataFrame, windows: Windows, floors: np.ndarray, rows: int | None) -> np.ndarray:
    """Bits, cell by query: the heaps of a block's queries run in tasks."""
    tops, total, cells = windows.tops(), len(windows.ids), len(index.count)

    def run(batch: pa.RecordBatch):
        ids = batch.column(0).to_numpy()
        at = np.searchsorted(windows.ids, ids)
        found = cells_to_visit(index_, windows.vectors[at], floors[at], tops[at], rows)
        yield [at.astype(np.int32), [np.packbits(np.bincount(f, minlength=cells).astype(bool)).tobytes() for f in found]]

    index_ = Index(None, index.dims, index.halves, index.codes, index.count, index.radius)
    got = in_arrays(queries.select("vec_id").repartition(parts(queries.sparkSession), "vec_id"), run, "query int, cells binary").toPandas()
    bits = np.zeros((total, cells), bool)
    for q, b in zip(got["query"], got["cells"]):
        bits[q] = np.unpackbits(np.frombuffer(b, np.uint8), count=cells)
    return np.packbits(bits.T, axis=1)


def search(index: Index, queries: DataFrame, windows: Windows, first: int = FIRST) -> DataFrame:
    """(query, row_id, score) with all that the windows of a block hold, and at most some rows more."""
    none = np.full(windows.low.shape, -EVER)
    visits = _visits(index, queries, windows, windows.floors(none), first)
    early = staged(_merged(_scan(index, windows, none, visits), windows))
    got = early.toPandas()  # at most all windows' places a query of the block
    q, row, score = (got[c].to_numpy(np.int64) for c in ("query", "row_id", "score"))
    _, last = windows.keep(q, row, score)
    rest = _visits(index, queries, windows, windows.floors(last), None) & ~visits
    return early.unionByName(staged(_merged(_scan(index, windows, last, rest), windows)))


def _merged(found: DataFrame, windows: Windows) -> DataFrame:
    """What the windows need of the finds of all tasks."""
    schema = "query int, row_id bigint, score bigint"
    arrow = arrow_schema(schema)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3

        def close() -> None:
            nonlocal held
            places, _ = windows.keep(*held)
            held = [h[places] for h in held]

        for batch in batches:
            held = [np.concatenate([h, c.to_numpy().astype(np.int64)]) for h, c in zip(held, batch.columns)]
            if len(held[0]) > PIECE:
                close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array(h, f.type) for h, f in zip(held, arrow)], schema=arrow)

    return found.repartition(parts(found.sparkSession), "query").mapInArrow(merge, schema)


def hard_negatives(embeddings: DataFrame, label: Column | None = None, anchor: Column | None = None, positives: int = 5,
                   negatives: int = 10, low: int = 30, high: int = 90, block_bytes: int = BLOCK_BYTES, first: int = FIRST) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    The anchors (all rows unless ``anchor`` says which) take their best ``positives`` rows of the same label, and for each the
    best ``negatives`` rows of other labels whose score is from low to high per cent of the positive's.
    """
    spark = prepare(embeddings.sparkSession)
    rows, dims = integral(embeddings, F.col("label") if label is None else label)
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if not dims or rows.isEmpty():
        return spark.createDataFrame([], schema)
    index = build(rows, dims)
    anchors = index.rows if anchor is None else index.rows.where(anchor)
    per_block = max(1, block_bytes // (8 * dims))
    blocks = -(-anchors.count() // per_block)
    dealt = staged(anchors.select("vec_id", "label", "v", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, blocks))).alias("block")))
    out = []
    for b in range(blocks):
        queries = dealt.where(F.col("block") == b)
        got = queries.select("vec_id", "label", "v").orderBy("vec_id").toPandas()
        if not len(got):
            continue
        ids, labels = got["vec_id"].to_numpy(np.int64), got["label"].to_numpy(np.int64)
        vectors = np.frombuffer(b"".join(got["v"]), np.int32).reshape(-1, dims)
        every = np.full((len(ids), 1), EVER)
        same = Windows(ids, labels, vectors, -every, every, positives, True)
        best = Window.partitionBy("query").orderBy(F.desc("score"), "row_id")
        found = search(index, queries, same, first).withColumn("place", F.row_number().over(best)).where(F.col("place") <= positives)
        pairs = found.toPandas()  # at most ``positives`` rows a query of the block
        low_, high_ = np.full((len(ids), positives), EVER), np.full((len(ids), positives), -EVER)
        q, place, score = (pairs[c].to_numpy(np.int64) for c in ("query", "place", "score"))
        low_[q, place - 1], high_[q, place - 1] = -(-low * score // 100), high * score // 100
        others = Windows(ids, labels, vectors, low_, high_, negatives, False)
        candidates = search(index, queries, others, first)
        named = spark.createDataFrame([(int(k), int(ids[k]), int(r), int(s)) for k, r, s in zip(q, pairs["row_id"], score)],
                                      "query int, anchor_id bigint, positive_id bigint, positive_score bigint")
        score_, base = F.col("score"), F.col("positive_score")
        inside = candidates.join(named, "query").where((100 * score_ >= low * base) & (100 * score_ <= high * base))
        rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "row_id"))
        out.append(staged(inside.withColumn("rank", rank).where(F.col("rank") <= negatives).select(
            "anchor_id", "positive_id", "rank", F.col("row_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))))
    if not out:
        return spark.createDataFrame([], schema)
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), moved, F.col("vec_id") % 100 == 0)


OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id))::INTEGER AS rank,
  other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id)
WHERE NOT same AND 100 * score >= 30 * positive_score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""
