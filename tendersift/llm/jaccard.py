"""N-gram Jaccard join with count-vector R-trees.

A document is its set of distinct word shingles. Shingles are hashed into ``GROUPS`` groups; the group counts are a
point, and two sets share at most the sum of the coordinate minima of their points. A box of points is bounded by its
largest coordinates, so a tree of boxes finds the pairs that may reach the threshold; these are verified on the sets.

A tree over a whole corpus would compare each point with most boxes, because unrelated long texts have similar counts.
Trees are therefore built per route. Shingles are ordered the same way for all documents: the ``FREQUENT`` most frequent ones
last, by frequency, all others by hash. A set of n shingles that reaches the threshold t with another shares one of its
first n - ceil(t n) + 1 with it, and one of its first n - ceil(2 t n / (1 + t)) + 1 if the other is not smaller (otherwise too
few are left to share). So documents meet under their first shingles, a larger one only with a smaller one's shorter list.
Routes with one document end at once.

Equal sets are one point. On each route first only neighbours by size are verified, which joins groups of near copies in
linear work. Then the trees are asked for pairs of documents that are not yet in one component: first for a forest, the
likeliest pairs that would join the components of a route, then, after these are verified and components merged, for
all that are left. No link between components is lost, and the links inside a component are not listed. Routes with many documents are dealt
into tiles of ``TILE``, and pairs of tiles are tasks of their own.

Defined cases: fewer words than a shingle give one shingle of all words; documents without words or with null text have
an empty set, link with nothing and are their own component; rows with a null id are not linked and have a null
component; rows that repeat an id are one node if their sets agree, else they are joined through the id. An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tendersift.llm.collapse import NO_ID, collapse
from tendersift.llm.common import arrow_schema, forget, in_arrays, in_batches, mix, parts, prepare, staged, table, unused
from tendersift.llm.hashing import Words, words_of
from tendersift.operators.graph import components

GROUPS, FINE, TILE, LEAF, FREQUENT, OF_TASK = 64, 512, 1024, 16, 1 << 20, 1 << 16


def needed(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Least intersection of sets of sizes a and b: 100 i >= percent (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def fine_point(text: np.ndarray, sh: np.ndarray, texts: int) -> np.ndarray:
    """``FINE`` group counts in a byte each. A row of only 255 stands for a set with a fuller group: it bounds nothing."""
    out = group_counts(text, sh, texts, FINE)
    out[out.max(axis=1, initial=0) >= 255] = 255
    return out.astype(np.uint8)


def fine_bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of coordinate minima of byte points; no bound where both sets are too full."""
    open_ = (a[:, 0] == 255) & (b[:, 0] == 255) & (a.min(axis=1) == 255) & (b.min(axis=1) == 255)
    return np.where(open_, np.iinfo(np.int64).max, np.minimum(a, b).sum(axis=1, dtype=np.int64))


def coarse_point(fine: np.ndarray) -> np.ndarray:
    """``GROUPS`` counts from the byte points; as good as unbounded for sets that are too full."""
    out = fine.reshape(len(fine), GROUPS, FINE // GROUPS).sum(axis=2, dtype=np.int32)
    out[fine.min(axis=1, initial=255) == 255] = 1 << 24
    return out


def group_counts(text: np.ndarray, sh: np.ndarray, texts: int, groups: int = GROUPS) -> np.ndarray:
    """One row of group counts per text; ``groups`` is a power of two."""
    place = text * groups + (sh >> np.uint64(65 - groups.bit_length())).astype(np.int64)
    return np.bincount(place, minlength=texts * groups).astype(np.int32).reshape(texts, groups)


def routes(text: np.ndarray, sh: np.ndarray, percent: int, frequent: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text and shingle of the first shingles of each text in the common order, and whether larger sets are met under it.

    ``frequent`` is sorted; ``rank`` is its order by frequency.
    """
    order = np.zeros(len(sh), np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, sh), len(frequent) - 1)
        order = np.where(frequent[at] == sh, rank[at] + 1, 0)
    number = np.bincount(text)
    begin = np.concatenate(([0], np.cumsum(number)))
    # The groups use the high bits of the hash itself, so the order is that of a scrambled one.
    sorted_ = np.lexsort((mix(sh), order, text))
    count = number - -(-percent * number // 100) + 1
    few = number - -(-2 * percent * number // (100 + percent)) + 1
    place = np.arange(len(sh)) - begin[text]
    first = place < count[text]
    keep = sorted_[first]
    return text[keep], sh[keep], (place < few[text])[first]


class Tree:
    """Boxes over points sorted by set size: largest coordinates, smallest and largest size, from the leaves up."""

    def __init__(self, sizes: np.ndarray, points: np.ndarray):
        self.sizes, self.points = sizes, points
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        top, low, high = points, sizes, sizes
        while len(top) > 1 or not self.levels:
            cuts = np.arange(0, len(top), LEAF)
            top, low, high = np.maximum.reduceat(top, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)
            self.levels.append((top, low, high))

    def level(self, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.levels[i] if i >= 0 else (self.points, self.sizes, self.sizes)


def _may(a: tuple, i: np.ndarray, b: tuple, j: np.ndarray, percent: int) -> np.ndarray:
    """Pairs of boxes that can hold linked points: by size, then by the sum of coordinate minima."""
    ok = (100 * a[2][i] >= percent * b[1][j]) & (100 * b[2][j] >= percent * a[1][i])
    i, j = i[ok], j[ok]
    bound = np.minimum(a[0][i], b[0][j]).sum(axis=1)
    out = np.flatnonzero(ok)
    return out[bound >= needed(a[1][i], b[1][j], percent)]


def tree_pairs(s: Tree, t: Tree, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of points of both trees whose bound reaches the threshold."""
    p, q = len(s.levels) - 1, len(t.levels) - 1
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)

    def children(x: np.ndarray, tree: Tree, level: int) -> tuple[np.ndarray, np.ndarray]:
        size = len(tree.level(level)[0])
        kids = x[:, None] * LEAF + np.arange(LEAF)
        which, _ = np.nonzero(kids < size)
        return which, kids[kids < size]

    while p >= 0 or q >= 0:
        if p >= q:
            p -= 1
            which, i = children(i, s, p)
            j = j[which]
        else:
            q -= 1
            which, j = children(j, t, q)
            i = i[which]
        keep = []
        for c in range(0, len(i), 65536):  # bounds are taken in pieces, to bound the memory
            keep.append(c + _may(s.level(p), i[c : c + 65536], t.level(q), j[c : c + 65536], percent))
        keep_ = np.concatenate(keep) if keep else np.zeros(0, np.int64)
        i, j = i[keep_], j[keep_]
    return i, j


def _frequent(texts: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """At most the ``FREQUENT`` most frequent shingles and their order by frequency, by ids sorted.

    Any order would be right, a good one has few documents meet: a task sends the ``OF_TASK`` most frequent shingles of its own
    documents, and the sums decide. All shingles of a count are in the list, or none.
    """
    schema = "shingle bigint, docs bigint"
    arrow = arrow_schema(schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        found: list[np.ndarray] = []

        def merge() -> tuple[np.ndarray, np.ndarray]:
            every = np.concatenate([values, *found])
            weight = np.concatenate([counts, np.ones(len(every) - len(values), np.int64)])
            distinct, inverse = np.unique(every, return_inverse=True)
            return distinct, np.bincount(inverse, weight, len(distinct)).astype(np.int64)

        for batch in batches:
            for words in words_of(batch.column(0), True):
                found.append(words.shingles(size)[1])
            if sum(map(len, found)) > max(len(values), 1 << 20):
                values, counts = merge()
                found = []
        values, counts = merge()
        # What a task has met once is not worth a place in the order.
        least = max(2, int(np.partition(counts, -OF_TASK)[-OF_TASK]) if len(counts) > OF_TASK else 0)
        keep = np.flatnonzero(counts >= least)
        keep = keep[np.argsort(-counts[keep], kind="stable")[:OF_TASK]]
        yield pa.RecordBatch.from_arrays([pa.array(values[keep].view(np.int64)), pa.array(counts[keep])], schema=arrow)

    sums = staged(texts.select("text").mapInArrow(count, schema).groupBy("shingle").agg(F.sum("docs").alias("docs")))
    # Lengths of the list by its least count: one row for each power of two.
    sizes = sums.groupBy(F.floor(F.log2("docs")).alias("bits")).count().orderBy(F.desc("bits")).collect()
    held, least = 0, 1 << 62
    for r in sizes:
        held += r["count"]
        if held > FREQUENT:
            break
        least = 1 << r["bits"]
    rows = sums.where(F.col("docs") >= least).toPandas()
    forget(sums)
    values = rows["shingle"].to_numpy(np.int64).view(np.uint64)
    docs = rows["docs"].to_numpy(np.int64)
    order = np.lexsort((values, docs))
    rank = np.empty(len(values), np.int64)
    rank[order] = np.arange(len(values))
    by = np.argsort(values)
    return values[by], rank[by]


def _verify(pairs: DataFrame, points: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs whose sets reach the threshold: first by the bound over ``FINE`` groups, what is left by the sets."""
    def bound(batch: pa.RecordBatch):
        a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, FINE) for i in (2, 3))
        keep = pa.array(fine_bound(a, b) >= needed(batch.column(4).to_numpy(), batch.column(5).to_numpy(), percent))
        yield [batch.column(0).filter(keep), batch.column(1).filter(keep)]

    def ends(rows: DataFrame, *columns: str) -> list[DataFrame]:
        return [rows.select(F.col("node").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in columns]) for k in ("src", "dst")]

    left, right = ends(points, "fine", "n")
    near = staged(in_arrays(pairs.join(left, "src").join(right, "dst").select("src", "dst", "fine_src", "fine_dst", "n_src", "n_dst"), bound,
                            "src bigint, dst bigint").distinct())
    some = near.select(F.explode(F.array("src", "dst")).alias("node")).distinct()

    def pack(batch: pa.RecordBatch):
        for words in words_of(batch.column(1), True):
            text, sh = words.shingles(size)
            bounds = np.searchsorted(text, np.arange(words.texts + 1))
            yield [batch.column(0).slice(words.first, words.texts), [sh[i:j].tobytes() for i, j in zip(bounds, bounds[1:])]]

    def check(r: dict[str, list]) -> dict[str, list]:
        keep = []
        for k, (a, b) in enumerate(zip(r["sh_src"], r["sh_dst"])):
            a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            both = np.intersect1d(a, b, assume_unique=True).size
            if 100 * both >= percent * (len(a) + len(b) - both):
                keep.append(k)
        return {c: [r[c][k] for k in keep] for c in ("src", "dst")}

    sets = staged(in_arrays(texts.join(some, "node", "left_semi").select("node", "text"), pack, "node bigint, sh binary").dropDuplicates(["node"]))
    left, right = ends(sets, "sh")
    found = staged(in_batches(near.join(left, "src").join(right, "dst").select("src", "dst", "sh_src", "sh_dst"), check,
                              "src bigint, dst bigint").distinct())
    forget(near, sets)
    return found


def pairs_within(grp: np.ndarray, side: np.ndarray, own: np.ndarray, n: np.ndarray, points: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs whose bound reaches the threshold; rows of a group stand together.

    Side 0 of a group is compared with its side 1 and, where ``own`` is set, with itself. Small groups are compared row by
    row, all at once; a tree of one leaf would do the same.
    """
    begin = np.flatnonzero(np.concatenate(([True], grp[1:] != grp[:-1])))
    size = np.diff(np.append(begin, len(grp)))
    small = np.repeat(size <= LEAF, size)
    out = []
    for d in range(1, LEAF):
        i = np.flatnonzero(small[:-d] & (grp[:-d] == grp[d:])) if len(grp) > d else np.zeros(0, np.int64)
        if not len(i):
            break
        j = i + d
        ok = (side[i] != side[j]) | ((side[i] == 0) & own[i])
        i, j = i[ok], j[ok]
        leaf = (points, n, n)
        ok = _may(leaf, i, leaf, j, percent)
        out.append((i[ok], j[ok]))
    for b, m in zip(begin[size > LEAF], size[size > LEAF]):
        rows = np.arange(b, b + m)
        rows = rows[np.argsort(n[rows], kind="stable")]
        x, y = rows[side[rows] == 0], rows[side[rows] == 1]
        for p, q in ([(x, x)] if own[b : b + m].any() and len(x) else []) + ([(x, y)] if len(x) and len(y) else []):
            i, j = tree_pairs(Tree(n[p], points[p]), Tree(n[q], points[q]), percent)
            out.append((p[i], q[j]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def forest_of(a: np.ndarray, b: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Numbers of the pairs that join components, the likeliest first: at most one less than there are components."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = x = parent.get(parent[x], parent[x])
        return x

    kept = []
    for k in np.argsort(-score, kind="stable").tolist():
        x, y = root(int(a[k])), root(int(b[k]))
        if x != y:
            parent[x] = y
            kept.append(k)
    return np.array(kept, np.int64)


def _tree_candidates(rows: DataFrame, percent: int, forest: bool) -> DataFrame:
    """Pairs of different components from rows (grp, side, own, node, comp, n, fine), or a forest of them per group."""
    schema = "src bigint, dst bigint"
    arrow = arrow_schema(schema)
    columns = ["grp", "side", "own", "node", "comp", "n", "fine"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            table_ = pa.Table.from_batches(held)
            grp, side, own, node, comp, n = (table_.column(c).to_numpy() for c in columns[:-1])
            fine, n = np.frombuffer(b"".join(table_.column("fine").to_pylist()), np.uint8).reshape(-1, FINE), n.astype(np.int64)
            i, j = pairs_within(grp, side, own, n, coarse_point(fine), percent)
            ok = comp[i] != comp[j]
            i, j = i[ok], j[ok]
            bound = np.concatenate([np.zeros(0, np.int64)] + [fine_bound(fine[i[c : c + 65536]], fine[j[c : c + 65536]]) for c in range(0, len(i), 65536)])
            least = needed(n[i], n[j], percent)
            ok = bound >= least
            i, j, score = i[ok], j[ok], bound[ok] / least[ok]
            if forest and len(i):
                order = np.argsort(grp[i], kind="stable")
                cuts = np.flatnonzero(np.diff(grp[i][order])) + 1
                keep = np.concatenate([part[forest_of(comp[i[part]], comp[j[part]], score[part])] for part in np.split(order, cuts)])
                i, j = i[keep], j[keep]
            a, b = node[i], node[j]
            both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(c) for c in both], schema=arrow)

        held: list[pa.RecordBatch] = []
        rows_held = 0
        for batch in batches:
            held.append(batch)
            rows_held += batch.num_rows
            if rows_held >= 4 * TILE:
                # All but the last group is complete.
                whole = pa.Table.from_batches(held).combine_chunks()
                grp = whole.column("grp").to_numpy()
                last = int(np.flatnonzero(grp != grp[-1])[-1]) + 1 if (grp != grp[-1]).any() else 0
                if last:
                    yield close(whole.slice(0, last).to_batches())
                held = whole.slice(last).to_batches()
                rows_held = whole.num_rows - last
        if rows_held:
            yield close(held)

    return (rows.select(*columns).repartition(parts(rows.sparkSession), "grp").sortWithinPartitions("grp")
            .mapInArrow(search, schema).distinct())


def links(texts: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """(src, dst) of nodes, enough links to give all components of the join over ``texts`` (node, n, text)."""
    spark = texts.sparkSession
    frequent, rank = _frequent(texts, size)
    order = spark.sparkContext.broadcast((frequent, rank))

    def route(batch: pa.RecordBatch):
        node = batch.column(0).to_numpy()
        for words in words_of(batch.column(1), True):
            text, sh = words.shingles(size)
            number = np.bincount(text, minlength=words.texts)
            text, sh, few = routes(text, sh, percent, *order.value)
            yield [sh.view(np.int64), node[words.first + text], np.where(few, number[text], -number[text])]

    # A negative size marks a row under which only smaller sets are met.
    routed = staged(in_arrays(texts.select("node", "text"), route, "key bigint, node bigint, n bigint").withColumn("n", F.col("n").cast("int")))
    least = F.min(F.when(F.col("n") > 0, F.col("n")))
    busy = (routed.groupBy("key").agg(F.count("*").alias("m"), F.min("node").alias("a"), F.max("node").alias("b"), least.alias("least"))
            .where("a < b AND least IS NOT NULL").select("key", "m", "least"))
    shared = staged(routed.join(busy, "key").where((F.col("n") > 0) | (-F.col("n") >= F.col("least"))).select("key", "node", F.abs("n").alias("n"), "m"))
    forget(routed)

    def pack(batch: pa.RecordBatch):
        for words in words_of(batch.column(1), True):
            text, sh = words.shingles(size)
            yield [batch.column(0).slice(words.first, words.texts), [p.tobytes() for p in fine_point(text, sh, words.texts)],
                   np.bincount(text, minlength=words.texts)]

    met = shared.select("node").distinct()
    points = staged(in_arrays(texts.join(met, "node", "left_semi").select("node", "text"), pack,
                              "node bigint, fine binary, n bigint").dropDuplicates(["node"]))

    # Neighbours by size. Other tiles on every route mix the tiles of a large group.
    tiles = F.ceil(F.col("m") / TILE)
    near = Window.partitionBy("key", "tile").orderBy("n", "node")
    chain = (shared.withColumn("tile", F.pmod(F.xxhash64("node", "key"), tiles))
             .withColumn("prev", F.lag("node").over(near)).withColumn("prev_n", F.lag("n").over(near))
             .where((F.col("prev") != F.col("node")) & (100 * F.col("prev_n") >= percent * F.col("n")))
             .select(F.least("prev", "node").alias("src"), F.greatest("prev", "node").alias("dst")).distinct())
    found = _verify(chain, points, texts, size, percent)
    for forest in (True, False):
        rows = _open_routes(shared, components(found)).join(points.select("node", "fine"), "node")
        found = staged(found.unionByName(_verify(_tree_candidates(rows, percent, forest), points, texts, size, percent)))
    forget(shared, points)
    return found


def _open_routes(shared: DataFrame, comp: DataFrame) -> DataFrame:
    """Rows (grp, side, own, node, comp, n) of the routes on which several components meet, dealt into tiles.

    The largest component of a route is side 1, all others are side 0 and are compared with it and with one another.
    """
    placed = staged(shared.join(comp, "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("comp")))
    sizes = placed.groupBy("key", "comp").agg(F.count("*").alias("c"))
    lead = (sizes.groupBy("key").agg(F.count("*").alias("comps"), F.sum("c").alias("m"), F.max(F.struct("c", "comp")).alias("top"))
            .where("comps > 1").select("key", (F.col("m") - F.col("top.c")).alias("few"), F.col("top.c").alias("many"), F.col("top.comp").alias("lead")))
    open_ = placed.join(lead, "key").withColumn("side", (F.col("comp") == F.col("lead")).cast("int"))
    few_tiles, many_tiles = F.ceil(F.col("few") / TILE), F.ceil(F.col("many") / TILE)
    own = F.pmod(F.xxhash64("node"), F.when(F.col("side") == 0, few_tiles).otherwise(many_tiles))
    open_ = open_.withColumn("at", own)
    # Tiles (few i, many j), numbered "x" i j; and (few i, few j) with i <= j, numbered "s" i j.
    cross = open_.select("key", "node", "n", "comp", "side", F.lit(False).alias("own"), F.explode(
        F.when(F.col("side") == 0, F.transform(F.sequence(F.lit(0), many_tiles - 1), lambda j: F.concat_ws(" ", F.lit("x"), F.col("at"), j)))
        .otherwise(F.transform(F.sequence(F.lit(0), few_tiles - 1), lambda i: F.concat_ws(" ", F.lit("x"), i, F.col("at"))))).alias("tile"))
    inner = open_.where((F.col("side") == 0) & (F.col("few") > 1)).select("key", "node", "n", "comp", "at", F.explode(
        F.sequence(F.lit(0), few_tiles - 1)).alias("other"))
    inner = inner.select("key", "node", "n", "comp", (F.col("at") > F.col("other")).cast("int").alias("side"),
                         (F.col("at") == F.col("other")).alias("own"),
                         F.concat_ws(" ", F.lit("s"), F.least("at", "other"), F.greatest("at", "other")).alias("tile"))
    # Two tiles whose names had one hash would only be compared in vain.
    return cross.unionByName(inner).withColumn("grp", F.xxhash64("key", "tile")).drop("key", "tile")


def near_duplicates(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles and component_id: the smallest id reached by links of ``percent`` Jaccard over ``size``-word shingles."""
    prepare(docs.sparkSession)

    def describe(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        text, sh = words.shingles(size)
        bounds = np.searchsorted(text, np.arange(words.texts + 1))
        # Sums of two scrambled forms stand for a set in any order.
        sums_ = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(sh ^ np.uint64(salt))))) for salt in (1, 0x5851F42D4C957F2D)]
        return (*((x[bounds[1:]] - x[bounds[:-1]]).view(np.int64) for x in sums_), np.diff(bounds))

    info, nodes, texts = collapse(docs, describe, lower=True)
    named = texts.where(F.col("id") != NO_ID)
    edges = links(named.select("node", "n", "text"), size, percent)
    # Rows that share an id and differ in text meet through the id.
    known = nodes.where(F.col("id") != NO_ID).select("k1", "k2", "node", "id")
    placed = info.select(F.col("id").alias("doc_id"), "k1", "k2", "n").join(known.drop("id"), ["k1", "k2"], "left")
    placed = placed.withColumn("node", F.when(F.col("doc_id") != NO_ID, F.col("node")))
    twice = (placed.where("node is not null").groupBy("doc_id").agg(F.min("node").alias("src"), F.max("node").alias("dst"))
             .where("src < dst").join(placed.where("node is not null").select("doc_id", F.col("node").alias("dst2")), "doc_id")
             .where("src <> dst2").select("src", F.col("dst2").alias("dst")).distinct())
    comp = components(edges.unionByName(twice))
    least = staged(known.join(comp, "node", "left").select("node", "id", F.coalesce("component", "node").alias("comp")))
    # Joined classes only: all others have themselves as component.
    label = least.join(least.groupBy("comp").agg(F.min("id").alias("component_id")), "comp").select("node", "component_id")
    return (placed.select("doc_id", "n", "node").join(label, "node", "left")
            .select(F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"),
                    F.coalesce("component_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id"))).alias("component_id")))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Of each component the row with the smallest id (of rows that share it, the one with the least text).

    Rows without an id are all kept.
    """
    found = near_duplicates(docs, size, percent).where("doc_id = component_id").select("doc_id").distinct()
    place, = unused(docs, "_place")
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    kept = docs.join(found, "doc_id", "left_semi").withColumn(place, first).where(F.col(place) == 1).select(*docs.columns)
    return kept.unionByName(docs.where("doc_id is null"))


def op7_jaccard(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
