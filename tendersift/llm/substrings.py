"""Substring dedup by recompression.

Word sequences are rewritten in rounds: runs of one symbol become a symbol, then the alphabet is parted in two by a
bit of each symbol's name and every pair (left part, right part) becomes a symbol. A name is a hash of what it
replaces, so equal runs and pairs get equal names in all tasks without exchanging a dictionary. What a round does to a
symbol depends on its neighbours only; inside a window all symbols that no outside neighbour can touch are therefore
the same wherever the window occurs. The first two symbols (or the only one) of the highest round that leaves any are
the window's anchor.

1. Anchors are counted over the corpus in Spark; anchors found once end the matter for their windows.
2. Windows with a shared anchor are compared by the 64 bits of the anchor and 64 of a hash of the window, both of the 64-bit hashes of
   their words: different windows are taken for equal only if words share a hash or both hashes meet (2^-64, 2^-128). The first occurrence of each, by id and start, stays; all words of later ones are removed.

Documents with equal word sequences are worked on once; their later copies are removed whole.

Defined cases: null and empty texts have no words; fewer words than a window remove nothing; a null id comes after all
others; rows that share id and text are one document and get the same result; rows that share an id and differ in text
are ordered by a hash of the words; windows are judged on the input. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tendersift.llm.collapse import NO_ID, collapse, described
from tendersift.llm.common import append, forget, in_arrays, in_batches, mix, parts, prepare, split_words, staged, table, unused
from tendersift.llm.hashing import SECOND, Words, slices, sums, words_of

WINDOW, ROUNDS = 20, 4


def anchors(words: np.ndarray, window: int = WINDOW, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Name and word position of the anchor of every window."""
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    sym, begin = words, np.arange(len(words))
    name, place = words[:n].copy(), np.arange(n)
    live, lo, hi = np.arange(n), np.arange(n), np.arange(n) + window  # symbols lo..hi-1 are the window's own

    def keep() -> None:
        """Drop the windows that have no symbol of their own left, and name the others anew."""
        nonlocal live, lo, hi
        ok = lo < hi
        live, lo, hi = live[ok], lo[ok], hi[ok]
        found = mix(sym[lo] + np.uint64(r))
        two = lo + 1 < hi
        found[two] = mix(found[two] * np.uint64(0xD1342543DE82EF95) + sym[lo[two] + 1])
        name[live], place[live] = found, begin[lo]

    # Runs. The first and the last run of a window may reach out of it.
    fresh = np.concatenate(([True], sym[1:] != sym[:-1]))
    run = np.cumsum(fresh) - 1
    first = np.flatnonzero(fresh)
    length = np.diff(np.append(first, len(sym))).astype(np.uint64)
    lo, hi = run[lo] + 1, run[hi - 1]
    sym = np.where(length > 1, mix(sym[first] + length * np.uint64(0x9E3779B97F4A7C15)), sym[first])
    begin = begin[first]
    for r in range(rounds):
        keep()
        # Pairs. A right symbol at the start may belong to what stands before, a left one at the end to what follows.
        left = (mix(sym ^ np.uint64((r + 1) * 0x2545F4914F6CDD1D & (1 << 64) - 1)) >> np.uint64(63)) == 0
        joined = np.zeros(len(sym), bool)
        joined[:-1] = left[:-1] & ~left[1:]
        lo, hi = lo + ~left[lo], hi - left[hi - 1]
        ok = lo < hi
        live, lo, hi = live[ok], lo[ok], hi[ok]
        starts = np.concatenate(([True], ~joined[:-1]))
        to = np.cumsum(starts) - 1
        lo, hi = to[lo], to[hi - 1] + 1
        at = np.flatnonzero(starts)
        pair = joined[at]
        new = sym[at].copy()
        new[pair] = mix(sym[at[pair]] * np.uint64(0xD1342543DE82EF95) + sym[at[pair] + 1] + np.uint64(r + 1))
        sym, begin = new, begin[at]
    r = rounds
    keep()
    return name, place


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _ordered(nodes: DataFrame) -> DataFrame:
    """Add ``base``: the words of all documents before, by (id, k1). base + start orders all windows of the corpus."""
    ranged = staged(nodes.repartitionByRange(parts(nodes.sparkSession), "id", "k1").withColumn("part", F.spark_partition_id()))
    # One row per task is ordered in one place.
    totals = ranged.groupBy("part").agg(F.sum("n").alias("words"))
    before = totals.select("part", F.coalesce(F.sum("words").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("part").orderBy("id", "k1").rowsBetween(Window.unboundedPreceding, -1)
    based = staged(ranged.withColumn("own", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(before, "part")
                   .select("node", (F.col("own") + F.col("offset")).alias("base")))
    forget(ranged)
    return based


def repeats(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """What ``collapse`` gives, and (node, starts): the windows of each class text that occur earlier."""
    prepare(docs.sparkSession)
    info, nodes, texts = collapse(docs, Words.wholes, extra=lambda t: _digest(split_words(t)))
    long = texts.where(F.col("n") >= window)

    def name(batch: pa.RecordBatch):
        node = batch.column(0).to_numpy()
        for words in words_of(batch.column(1)):
            at = words.runs(window)
            names, places = anchors(words.hashes, window)
            names, places, text = names[at], places[at], words.text[at]
            # Neighbouring windows mostly have the anchor in common; an anchor met again is only looked at closer.
            fresh = np.ones(len(at), bool)
            fresh[1:] = (places[1:] != places[:-1]) | (names[1:] != names[:-1]) | (text[1:] != text[:-1])
            names, text = names[fresh], text[fresh]
            order = np.lexsort((names, text))
            names, text = names[order], text[order]
            begin = np.ones(len(names), bool)
            begin[1:] = (names[1:] != names[:-1]) | (text[1:] != text[:-1])
            begin = np.flatnonzero(begin)
            yield [names[begin].view(np.int64), node[words.first + text[begin]], np.diff(np.append(begin, len(names))) > 1]

    named = in_arrays(long.select("node", "text"), name, "anchor bigint, node bigint, twice boolean")
    # Both sides of the joins below are exchanges of their own, so that a hot key can be split.
    shared = staged(named.groupBy("anchor").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.max("twice").alias("twice"))
                    .where("a < b or twice").select("anchor"))
    # A list of anchors of one document: bounded by its length.
    hits = staged(named.join(shared, "anchor").groupBy("node").agg(F.collect_list("anchor").alias("anchors")))

    def compare(batch: pa.RecordBatch):
        base, wanted = batch.column(0).to_numpy(), batch.column(2)
        wanted_from, wanted = wanted.offsets.to_numpy(), wanted.values.to_numpy().view(np.uint64)
        for words in words_of(batch.column(1)):
            at = words.runs(window)
            names = anchors(words.hashes, window)[0][at]
            text = words.text[at]
            limits = np.searchsorted(text, np.arange(words.texts + 1))
            hit = [np.isin(names[limits[i] : limits[i + 1]], wanted[wanted_from[words.first + i] : wanted_from[words.first + i + 1]])
                   for i in range(words.texts)]
            hit = np.flatnonzero(np.concatenate(hit))
            at, text = at[hit], text[hit]
            content = slices(sums(words.hashes, SECOND), SECOND, at, at + window)
            yield [names[hit].view(np.int64), content.view(np.int64), base[words.first + text], at - words.bounds[text]]

    order = _ordered(nodes)
    rows = in_arrays(long.join(hits, "node").join(order, "node").select("base", "text", "anchors"), compare,
                     "anchor bigint, content bigint, base bigint, start bigint").withColumn("start", F.col("start").cast("int"))
    windows = staged(rows)
    forget(shared, hits)
    place = F.col("base") + F.col("start")
    first = staged(windows.groupBy("anchor", "content").agg(F.min(place).alias("first"), F.count("*").alias("times")).where("times > 1").drop("times"))
    later = (windows.join(first, ["anchor", "content"]).where(place > F.col("first"))
             .groupBy("base").agg(F.collect_set("start").alias("starts")))
    later = staged(later.join(order, "base").select("node", "starts"))
    forget(windows, first, order)
    return info, nodes, texts, later


def covered(n: int, starts: list[int], window: int) -> np.ndarray:
    edges = np.zeros(n + 1, np.int64)
    starts_ = np.array(starts, np.int64)
    np.add.at(edges, starts_, 1)
    np.add.at(edges, starts_ + window, -1)
    return np.cumsum(edges)[:n] > 0


def _cuts(docs: DataFrame, window: int, keep_text: bool) -> tuple[DataFrame, DataFrame]:
    """``info`` of collapse, and a row per class: k1, k2, first_id, removed, cut_sha, kept (null: nothing is removed)."""
    info, nodes, texts, later = repeats(docs, window)

    def cut(r: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"node": [], "removed": [], "cut_sha": [], "kept": []}
        for node, text, starts in zip(r["node"], r["text"], r["starts"]):
            words = split_words(text)
            gone = covered(len(words), starts, window)
            left = [w for w, g in zip(words, gone) if not g]
            out["node"].append(node)
            out["removed"].append(len(words) - len(left))
            out["cut_sha"].append(_digest(left))
            out["kept"].append(b" ".join(left).decode("utf-8", "surrogatepass") if keep_text else None)
        return out

    cuts = in_batches(texts.join(later, "node").select("node", "text", "starts"), cut,
                      "node bigint, removed bigint, cut_sha string, kept string").dropDuplicates(["node"])
    classes = nodes.select("node", "k1", "k2", F.col("id").alias("first_id")).join(cuts, "node", "left").drop("node")
    return info, staged(classes)


def dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row."""
    info, classes = _cuts(docs, window, False)
    # Copies of one text may be most of the rows; the classes have one row each, so the join can split a hot one.
    rows = info.join(classes, ["k1", "k2"], "left")
    copy = F.coalesce((F.col("n") >= window) & (F.col("id") > F.col("first_id")), F.lit(False))
    return rows.select(
        F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), F.col("n").alias("n_words"),
        F.when(copy, F.col("n")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, hashlib.sha256(b"").hexdigest()).otherwise(F.coalesce("cut_sha", "extra")).alias("kept_sha256"))


def rewrite(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without their repeats: where words go, the text is the kept words joined by one space.

    Documents of which nothing is left go; texts without words are left alone. ``n_chars`` follows the text.
    """
    _, classes = _cuts(docs, window, True)
    k1, k2, n, first, removed, kept = unused(docs, "_k1", "_k2", "_n", "_first", "_removed", "_kept")

    def key(texts: list) -> dict[str, list]:
        return dict(zip((k1, k2, n), described(pa.array(texts, pa.large_string()), Words.wholes, False)))

    found = classes.select("k1", "k2", "first_id", "removed", "kept").withColumnsRenamed(
        {"k1": k1, "k2": k2, "first_id": first, "removed": removed, "kept": kept})
    rows = append(docs, key, f"{k1} bigint, {k2} bigint, {n} bigint").join(found, [k1, k2], "left")
    gone = F.coalesce((F.col(n) >= window) & (F.coalesce("doc_id", F.lit(NO_ID)) > F.col(first)), F.lit(False)) | \
        F.coalesce((F.col(n) > 0) & (F.col(removed) == F.col(n)), F.lit(False))
    rows = rows.where(~gone).withColumn("text", F.coalesce(kept, "text"))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col(kept).isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast("long"))
    return rows.select(*docs.columns)


def op9_substrings(spark, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))
