"""Near-duplicate groups by SuperMinHash signatures.

Every shingle draws numbers r_0, r_1, ... and walks a permutation of the slots that a Fisher-Yates shuffle builds step by
step; at step j it offers j + r_j to its slot, and a slot keeps the least offer. The ranks of one shingle are correlated, no
slot gets two of them, so the share of equal slots varies less than that of independent minima. A text stops as
soon as all of its slots hold offers of earlier steps: later ones are larger. Steps run over all shingles of many texts at once.

``ROWS`` slots make a band; documents meet under equal bands. With 128 slots, bands of 4 and similarity 0.85 a pair meets
nowhere with a chance of 5e-11; ``rows_of`` picks the longest bands that keep this chance under ``MISS`` for other thresholds.
Pairs whose signatures agree in too few slots are dropped (chance under 1e-12 for a link); all others are verified on
their full sets of 64-bit shingle hashes. No bucket is capped:

1. In each bucket, dealt into tiles of ``TILE``, neighbours by set size are verified: linear work that joins groups of near copies.
2. Buckets that still hold several components: those of up to ``SMALL`` members list their likely pairs of different components.
   In larger ones the tiles of the largest component meet the tiles of all others, and these one another. A task bounds the
   overlap of two sets by the minima of their counts in ``FINE`` groups, which leaves few pairs that are no links.

Links are grouped by union-find: each task first reduces at most ``LINKS`` or so links to a forest. Forests of several tasks are
joined by contracting stars to the least node; that of a single task has the groups already.

Equal sets are one node from the start, so copies of any number cost one signature row each. Signatures, bands and the
names of sets come from one pass over the texts; a second one reads the texts of nodes that are to be verified.

Defined cases: fewer words than a shingle give one shingle of all words; documents without words or with null text have an
empty set and are their own component; rows with a null id are not linked, have a null component and are kept; rows that repeat
an id are joined through the id. Texts are read whole, of any length, their shingles some at a time. An empty table gives no rows.
Only doc_id and text are read: other columns of any name do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tendersift.llm.collapse import NO_ID
from tendersift.llm.common import arrow_schema, forget, in_arrays, in_batches, mix, parts, prepare, staged, table
from tendersift.llm.hashing import words_of
from tendersift.llm.jaccard import FINE, fine_bound, fine_point, needed
from tendersift.operators.graph import components

SLOTS, TILE, SMALL, MISS = 128, 1024, 16, 1e-9
#: Links that a task reduces to a forest.
LINKS = 1 << 17
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def signatures(text: np.ndarray, sh: np.ndarray, texts: int, slots: int = SLOTS, piece: int = 1 << 16) -> np.ndarray:
    """One row of ``slots`` offers (step in the high, fraction in the low 32 bits) per text; ``text`` is sorted."""
    out = np.full((texts, slots), EMPTY, np.uint64)
    flat = out.reshape(-1)
    for at in range(0, len(sh), piece):
        own, x, walk = text[at : at + piece], sh[at : at + piece], None
        for j in range(slots):
            open_ = np.zeros(texts, bool)
            seen = np.arange(own[0], own[-1] + 1)
            open_[seen] = out[seen].max(axis=1) >= np.uint64(j << 32)
            live = open_[own]
            if not live.all():
                own, x, walk = own[live], x[live], None if walk is None else walk[live]
                if not len(own):
                    break
            draw = mix(x + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            k = j + ((draw >> np.uint64(32)) * np.uint64(slots - j) >> np.uint64(32)).astype(np.int64)
            offer = (draw & np.uint64(0xFFFFFFFF)) | np.uint64(j << 32)
            rows = np.arange(len(x))
            if walk is None:  # at step 0 nobody has swapped anything yet
                walk = np.repeat(np.arange(slots, dtype=np.uint16)[None, :], len(x), axis=0)
            slot = walk[rows, k].astype(np.int64)
            walk[rows, k] = walk[:, j]
            walk[:, j] = slot
            np.minimum.at(flat, own * slots + slot, offer)
    return out


def rows_of(percent: int, slots: int = SLOTS, miss: float = MISS) -> int:
    """Longest band for which a pair at the threshold meets in no band with a chance of at most ``miss``."""
    p = percent / 100
    good = [r for r in range(1, slots + 1) if (1 - p**r) ** (slots // r) <= miss]
    return max(good, default=1)


def least_matches(percent: int, slots: int = SLOTS, miss: float = 1e-12) -> int:
    """A pair at the threshold agrees in fewer slots with a chance of at most ``miss`` (bound of Chernoff)."""
    p = percent / 100

    def rare(c: int) -> bool:
        q = c / slots
        far = (q * log(q / p) if q else 0.0) + ((1 - q) * log((1 - q) / (1 - p)) if q < 1 else 0.0)
        return q < p and slots * far >= -log(miss)

    return max((c for c in range(slots) if p < 1 and rare(c)), default=0)


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """Hash of each band; equal values of different bands have different hashes."""
    n = signature.shape[1] // rows
    cut = signature[:, : n * rows].reshape(len(signature), n, rows)
    out = np.broadcast_to(mix(np.arange(1, n + 1, dtype=np.uint64)), cut.shape[:2])
    for i in range(rows):
        out = mix(out + cut[:, :, i])
    return out.view(np.int64)


def _marks(signature: np.ndarray) -> np.ndarray:
    """A byte per slot; different offers agree by chance in one of 256."""
    return (mix(signature) >> np.uint64(56)).astype(np.uint8)


def _set_names(text: np.ndarray, sh: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes and the size of each set: sums of scrambled members do not depend on an order."""
    bounds = np.searchsorted(text, np.arange(texts + 1))
    found = []
    for salt in (0x2545F4914F6CDD1D, 0x6C8E9CF570932BD5):
        run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(sh ^ np.uint64(salt)))))
        found.append((run[bounds[1:]] - run[bounds[:-1]]).view(np.int64))
    return found[0], found[1], np.diff(bounds)


def _described(docs: DataFrame, size: int, rows: int, slots: int) -> DataFrame:
    """(id, k1, k2, n, marks, bands) of every document: one pass over the texts."""
    def tell(batch: pa.RecordBatch):
        for words in words_of(batch.column(1), True):
            text, sh = words.shingles(size)
            signature = signatures(text, sh, words.texts, slots)
            k1, k2, n = _set_names(text, sh, words.texts)
            keys = bands(signature, rows)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.reshape(-1)))
            yield [batch.column(0).slice(words.first, words.texts), k1, k2, n, [m.tobytes() for m in _marks(signature)], lists]

    return in_arrays(docs, tell, "id bigint, k1 bigint, k2 bigint, n bigint, marks binary, bands array<bigint>")


def _contents(docs: DataFrame, wanted: DataFrame, size: int, unique: bool, fine: bool = False) -> DataFrame:
    """(node, sh) of the nodes in ``wanted`` (node, id, k1, k2, n): sorted shingle hashes, or with ``fine`` their group counts."""
    def pack(batch: pa.RecordBatch):
        for words in words_of(batch.column(1), True):
            text, sh = words.shingles(size)
            bounds = np.searchsorted(text, np.arange(words.texts + 1))
            sets = [p.tobytes() for p in (fine_point(text, sh, words.texts) if fine else (sh[i:j] for i, j in zip(bounds, bounds[1:])))]
            given = batch.column(0).slice(words.first, words.texts)
            yield [given, sets] if unique else [given, *_set_names(text, sh, words.texts), sets]

    if unique:
        return staged(in_arrays(docs.join(wanted.select("id", "node"), "id").select("node", "text"), pack, "node bigint, sh binary"))
    # Rows that share an id may differ in text, so the node's own names decide.
    some = docs.join(wanted.select("id").distinct(), "id", "left_semi").select("id", "text")
    named = in_arrays(some, pack, "id bigint, k1 bigint, k2 bigint, n bigint, sh binary")
    return staged(named.join(wanted, ["id", "k1", "k2", "n"]).select("node", "sh").dropDuplicates(["node"]))


def _alike(a: bytes, b: bytes, percent: int) -> bool:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = np.intersect1d(x, y, assume_unique=True).size
    return 100 * both >= percent * (len(x) + len(y) - both)


def _ends(rows: DataFrame, *columns: str) -> list[DataFrame]:
    return [rows.select(F.col("node").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in columns]) for k in ("src", "dst")]


class Forest:
    """Union-find over any integers."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    def join(self, x: int, y: int) -> bool:
        """Whether the two were apart; the smaller root stays."""
        x, y = self.root(x), self.root(y)
        self.parent[max(x, y)] = min(x, y)
        return x != y


def grouped(links: DataFrame) -> DataFrame:
    """(node, component) of written links (src, dst): tasks reduce their links to forests, then stars are contracted."""
    schema = "src bigint, dst bigint"
    arrow = arrow_schema(schema)

    def reduce_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                forest.join(a, b)
        pairs = [(forest.root(x), x) for x in forest.parent if forest.root(x) != x]
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], schema=arrow)

    tasks = -(-links.count() // LINKS)
    reduced = links.select("src", "dst").coalesce(max(tasks, 1)).mapInArrow(reduce_, schema)
    if tasks > 1:
        return components(reduced)
    # The smaller root stays, so every root is the least node of its group.
    found = staged(reduced)
    roots = found.select(F.col("src").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return found.select(F.col("dst").alias("node"), F.col("src").alias("component")).unionByName(roots)


class Join:
    """Verification of node pairs: first by the marks, then on the sets of those that are left."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, size: int, percent: int, slots: int, unique: bool):
        self.docs, self.nodes, self.size, self.percent, self.slots, self.unique = docs, nodes, size, percent, slots, unique
        self.least = least_matches(percent, slots)

    def likely(self, pairs: DataFrame) -> DataFrame:
        left, right = _ends(self.nodes, "marks", "n")
        slots, least, percent = self.slots, self.least, self.percent

        def close(batch: pa.RecordBatch):
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, slots) for i in (2, 3))
            m, n = (batch.column(i).to_numpy() for i in (4, 5))
            keep = ((a == b).sum(axis=1) >= least) & (100 * m >= percent * n) & (100 * n >= percent * m)
            yield [batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))]

        rows = pairs.join(left, "src").join(right, "dst").select("src", "dst", "marks_src", "marks_dst", "n_src", "n_dst")
        return in_arrays(rows, close, "src bigint, dst bigint")

    def contents(self, some: DataFrame, fine: bool = False) -> DataFrame:
        wanted = self.nodes.join(some, "node", "left_semi").select("node", "id", "k1", "k2", "n")
        return _contents(self.docs, wanted, self.size, self.unique, fine)

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (src, dst) that are links, written."""
        percent = self.percent
        near = staged(self.likely(pairs))
        sets = self.contents(near.select(F.explode(F.array("src", "dst")).alias("node")).distinct())
        left, right = _ends(sets, "sh")

        def check(r: dict[str, list]) -> dict[str, list]:
            keep = [k for k, (a, b) in enumerate(zip(r["sh_src"], r["sh_dst"])) if _alike(a, b, percent)]
            return {c: [r[c][k] for k in keep] for c in ("src", "dst")}

        links = staged(in_batches(near.join(left, "src").join(right, "dst").select("src", "dst", "sh_src", "sh_dst"), check,
                                  "src bigint, dst bigint"))
        forget(near, sets)
        return links


def _small_pairs(rows: DataFrame, slots: int, least: int) -> DataFrame:
    """Likely pairs of different components within each key of rows (key, node, comp, marks); at most ``SMALL`` rows a key."""
    schema = "src bigint, dst bigint"
    arrow = arrow_schema(schema)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            now = now if rest is None else pa.concat_tables([rest, now])
            key, node, comp = (now.column(c).to_numpy() for c in ("key", "node", "comp"))
            marks = np.frombuffer(b"".join(now.column("marks").to_pylist()), np.uint8).reshape(-1, slots)
            # Rows carried over have met each other already.
            old = 0 if rest is None else len(rest)
            found = []
            for d in range(1, min(SMALL, len(key))):
                i = np.arange(max(0, old - d), len(key) - d)
                i = i[(key[i] == key[i + d]) & (comp[i] != comp[i + d])]
                i = i[(marks[i] == marks[i + d]).sum(axis=1) >= least]
                found.append(np.stack([np.minimum(node[i], node[i + d]), np.maximum(node[i], node[i + d])]))
            if found:
                both = np.unique(np.concatenate(found, axis=1), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in both], schema=arrow)
            rest = now.slice(max(0, len(now) - SMALL + 1)).combine_chunks()

    placed = rows.select("key", "node", "comp", "marks").repartition(parts(rows.sparkSession), "key").sortWithinPartitions("key")
    return placed.mapInArrow(pairs, schema).distinct()


def _tile_pairs(rows: DataFrame, least: int, percent: int) -> DataFrame:
    """Pairs of components that may link, from rows (key, tile, side, own, node, comp, n, marks, sh)."""
    schema = "src bigint, dst bigint"
    arrow = arrow_schema(schema)
    columns = ["key", "tile", "side", "own", "node", "comp", "n", "marks", "sh"]

    def close(held: pa.Table) -> pa.RecordBatch:
        side, node, comp, n = (held.column(c).to_numpy().astype(np.int64) for c in ("side", "node", "comp", "n"))
        marks, fine = (np.frombuffer(b"".join(held.column(c).to_pylist()), np.uint8).reshape(len(n), -1) for c in ("marks", "sh"))
        a = np.flatnonzero(side == 0)
        b = a if held.column("own")[0].as_py() else np.flatnonzero(side == 1)
        out = []
        for x in a.tolist():
            y = b[b > x] if b is a else b
            y = y[(comp[y] != comp[x]) & (100 * n[y] >= percent * n[x]) & (100 * n[x] >= percent * n[y])]
            same = (marks[y] == marks[x]).sum(axis=1)
            y = y[same >= least]
            y = y[fine_bound(np.broadcast_to(fine[x], (len(y), fine.shape[1])), fine[y]) >= needed(n[x], n[y], percent)]
            out += [(min(node[x], z), max(node[x], z)) for z in node[y].tolist()]
        return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in (0, 1)], schema=arrow)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        now = None
        for batch in batches:
            grp = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            start = 0
            for at in range(len(grp)):
                if grp[at] != now:
                    if at > start:
                        held.append(pa.Table.from_batches([batch.slice(start, at - start)]))
                    if held:
                        yield close(pa.concat_tables(held).combine_chunks())
                    held, start, now = [], at, grp[at]
            if len(grp) > start:
                held.append(pa.Table.from_batches([batch.slice(start)]))
        if held:
            yield close(pa.concat_tables(held).combine_chunks())

    placed = rows.select(*columns).repartition(parts(rows.sparkSession), "key", "tile").sortWithinPartitions("key", "tile")
    return placed.mapInArrow(found, schema).distinct()


def _tiles(rows: DataFrame) -> DataFrame:
    """Rows (key, node, comp, n) of keys with several components, dealt into (key, tile).

    The largest component of a key is side 1 and is not compared with itself; any other two rows meet in one tile.
    """
    sizes = rows.groupBy("key", "comp").agg(F.count("*").alias("c"))
    lead = (sizes.groupBy("key").agg(F.sum("c").alias("m"), F.max(F.struct("c", "comp")).alias("top"), F.count("*").alias("comps")).where("comps > 1")
            .select("key", F.col("top.comp").alias("lead"), F.ceil(F.col("top.c") / TILE).alias("many"), F.ceil((F.col("m") - F.col("top.c")) / TILE).alias("few")))
    first = F.lit(0).cast("long")
    at = rows.join(lead, "key").withColumn("lead", F.col("comp") == F.col("lead"))
    at = at.withColumn("at", F.pmod(F.xxhash64("node", "key"), F.when(F.col("lead"), F.col("many")).otherwise(F.col("few"))))
    kept = ["key", "node", "comp", "n", "at", "few", "many"]
    # Tiles (few i, many j) have the numbers i * many + j; tiles (few i, few j) follow as -1 - (i * few + j), i up to j.
    cross = at.select(*kept, "lead", F.explode(F.when(F.col("lead"), F.sequence(first, F.col("few") - 1)).otherwise(F.sequence(first, F.col("many") - 1))).alias("other"))
    cross = cross.select("key", "node", "comp", "n", F.col("lead").cast("int").alias("side"), F.lit(False).alias("own"), F.when(
        F.col("lead"), F.col("other") * F.col("many") + F.col("at")).otherwise(F.col("at") * F.col("many") + F.col("other")).alias("tile"))
    inner = at.where(~F.col("lead")).select(*kept, F.explode(F.sequence(first, F.col("few") - 1)).alias("other"))
    inner = inner.select("key", "node", "comp", "n", (F.col("at") > F.col("other")).cast("int").alias("side"), (F.col("at") == F.col("other")).alias("own"),
                         (-1 - F.least("at", "other") * F.col("few") - F.greatest("at", "other")).alias("tile"))
    return cross.unionByName(inner)


def links(join: Join) -> DataFrame:
    """(src, dst): enough links to give all components of the nodes that meet in a band."""
    keys = join.nodes.select("node", "n", F.explode("bands").alias("key"))
    busy = keys.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    shared = staged(keys.join(busy, "key"))
    near = Window.partitionBy("key", "tile").orderBy("n", "node")
    chain = staged(shared.withColumn("tile", F.pmod(F.xxhash64("node", "key"), F.ceil(F.col("m") / TILE)))
                   .withColumn("prev", F.lag("node").over(near)).where("prev IS NOT NULL")
                   .select(F.least("prev", "node").alias("src"), F.greatest("prev", "node").alias("dst")).distinct())
    found = join.verified(chain)
    placed = shared.join(grouped(found), "node", "left").select("key", "node", "n", "m", F.coalesce("component", "node").alias("comp"))
    placed = staged(placed)
    several = placed.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a < b").select("key")
    open_ = staged(placed.join(several, "key", "left_semi"))
    marks = join.nodes.select("node", "marks")
    pairs = _small_pairs(open_.where(F.col("m") <= SMALL).join(marks, "node"), join.slots, join.least)
    large = open_.where(F.col("m") > SMALL)
    if not large.isEmpty():
        points = marks.join(join.contents(large.select("node").distinct(), True), "node")
        dealt = _tiles(large.select("key", "node", "comp", "n")).join(points, "node")
        pairs = pairs.unionByName(_tile_pairs(dealt, join.least, join.percent)).distinct()
    more = join.verified(pairs.join(chain, ["src", "dst"], "left_anti"))
    forget(shared, placed, chain, open_)
    return found.unionByName(more)


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, slots: int = SLOTS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept: groups linked by Jaccard similarity of ``size``-word shingle sets."""
    prepare(docs.sparkSession)
    given = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), "text")
    rows = rows_of(percent, slots)
    told = staged(_described(given, size, rows, slots))
    info = told.select("id", "k1", "k2", "n")
    unique = info.groupBy("id").count().where("count > 1").isEmpty()
    nodes = staged(told.where("n > 0").groupBy("k1", "k2", "n").agg(F.min("id").alias("id"), F.first("marks").alias("marks"), F.first("bands").alias("bands"))
                   .where(F.col("id") != NO_ID).withColumn("node", F.monotonically_increasing_id()))
    edges = links(Join(given, nodes, size, percent, slots, unique))
    known = nodes.select("k1", "k2", "n", "node", "id")
    placed = info.join(known.drop("id"), ["k1", "k2", "n"], "left").select(
        "id", "n", F.when(F.col("id") != NO_ID, F.col("node")).alias("node"))
    if not unique:
        met = placed.where("node IS NOT NULL").distinct()
        least = met.groupBy("id").agg(F.min("node").alias("src"))
        edges = edges.unionByName(staged(met.join(least, "id").where("src < node").select("src", F.col("node").alias("dst")).distinct()))
    comp = grouped(edges)
    joined = staged(known.select("node", "id").join(comp, "node"))
    label = joined.join(joined.groupBy("component").agg(F.min("id").alias("least")), "component").select("node", "least")
    # A node that no link touches is its own component; its copies take its smallest id.
    named = staged(known.select("node", "id").join(label, "node", "left").select("node", F.coalesce("least", "id").alias("least")))
    own = F.when(F.col("id") != NO_ID, F.col("id"))
    component = F.coalesce("least", own)
    return placed.join(named, "node", "left").select(
        own.alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(own == component, F.lit(True)).alias("kept"))


def op12_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), 3, 85)
