"""Best-fit packing of tokenised documents with certified repacking.

Documents are cut into pieces of at most ``capacity`` tokens; full pieces are sequences of their own. The others are
dealt into groups by hash and packed best-fit decreasing. A lower bound from dual feasible functions certifies a group
whose bin count meets it. Groups with a gap give the documents of all bins with free room to a common pool, which is
dealt anew and packed again; a new packing is taken only if it needs fewer bins, and the rounds end when it does not.

Defined cases: a null text is empty; a document is its ids and the end id, so an empty one has one token; a
document longer than the capacity has its short piece first; repeated rows are packed each; null ids are
carried along; an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tendersift.llm.common import in_batches, prepare, staged, table
from tendersift.llm.tokens import encode, vocabulary

CAPACITY, END, GROUP = 1024, 2, 32768


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, end: int = END, files: tuple[str, str] | None = None,
                 keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, the ids themselves."""
    files = files or vocabulary()
    prepare(docs.sparkSession)

    def cut(r: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {c: [] for c in ("doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids)}
        for doc_id, text in zip(r["doc_id"], r["text"]):
            ids = np.array(encode(text or "", files) + [end], "<u4")
            bounds = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
            for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
                out["doc_id"].append(doc_id)
                out["piece"].append(k)
                out["start"].append(a)
                out["length"].append(b - a)
                out["ids_crc32"].append(zlib.crc32(ids[a:b].tobytes()))
                if keep_ids:
                    out["ids"].append(ids[a:b].tolist())
        return out

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<bigint>" * keep_ids
    return in_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), cut, schema)


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each item, longest first. ``lengths`` is in descending order."""
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by free room
    rooms, bins, made = 0, np.empty(len(lengths), np.int64), 0
    for i, size in enumerate(lengths.tolist()):
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = waiting[room].pop()
            if not waiting[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, made
            made += 1
        left = room - size
        if left:
            waiting[left].append(b)
            rooms |= 1 << left
        bins[i] = b
    return bins


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """No packing needs fewer bins: the largest bound over two families of dual feasible functions."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1)
    upto, words = np.cumsum(count), np.cumsum(count * size)
    # Items over capacity - t count as full, items under t as nothing.
    t = np.arange(0, capacity // 2 + 1)
    below = np.where(t > 0, words[np.maximum(t - 1, 0)], 0)
    best = int(np.max((upto[-1] - upto[capacity - t]) * capacity + words[capacity - t] - below))
    bound = -(-best // capacity)
    # Sizes rounded down to multiples of 1/k, where (k + 1) * size is no whole number of capacities.
    for k in range(1, 65):
        scaled = (k + 1) * size
        whole = scaled % capacity == 0
        value = np.where(whole, size * k, scaled // capacity * capacity)
        bound = max(bound, -(-int((count * value).sum()) // (k * capacity)))
    return bound


def _pack(items: DataFrame, groups: int, capacity: int, round_no: int) -> DataFrame:
    dealt = items.select("pid", "length").withColumn("grp", F.pmod(F.xxhash64("pid", F.lit(round_no)), F.lit(groups)))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "pid"], ascending=[False, True], ignore_index=True)
        pdf["bin"] = best_fit(pdf["length"].to_numpy(), capacity)
        by = pdf.groupby("bin")["length"]
        pdf["offset"] = by.cumsum() - pdf["length"]
        pdf["free"] = capacity - by.transform("sum")
        pdf["gap"] = int(pdf["bin"].max()) + 1 - lower_bound(pdf["length"].to_numpy(), capacity)
        pdf["round"] = round_no
        return pdf[["pid", "length", "round", "grp", "bin", "offset", "free", "gap"]]

    return staged(dealt.groupBy("grp").applyInPandas(
        one, "pid bigint, length bigint, round int, grp bigint, bin bigint, offset bigint, free bigint, gap bigint"))


def pack(items: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """pid, sequence_id and offset for items (pid, length) shorter than the capacity.

    A group has about ``group`` items, since a hash of the unique pid deals them.
    """
    def bins(packed: DataFrame) -> int:
        return packed.select("grp", "bin").distinct().count()

    count = items.count()
    done, current, number = None, _pack(items, max(1, math.ceil(count / group)), capacity, 0), 0
    while True:
        loose = current.where("gap > 0 and free > 0")
        n = loose.count()
        if not n:
            break
        again = _pack(loose, max(1, math.ceil(n / group)), capacity, number + 1)
        if bins(again) >= bins(loose):
            break
        fixed = current.where("gap <= 0 or free = 0")
        done = fixed if done is None else done.unionByName(fixed)
        current, number = again, number + 1
    done = current if done is None else done.unionByName(current)
    place = (F.col("round").cast("long") * (1 << 52)) + F.col("grp") * (1 << 20) + F.col("bin")
    return done.select("pid", (-1 - place).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, end: int = END, files: tuple[str, str] | None = None,
                   keep_ids: bool = False) -> DataFrame:
    """All pieces with their sequence and place; sequence numbers are negative for shared sequences."""
    pieces = staged(token_pieces(docs, capacity, end, files, keep_ids).withColumn("pid", F.monotonically_increasing_id()))
    placed = pack(pieces.where(F.col("length") < capacity), capacity)
    full = pieces.where(F.col("length") == capacity).withColumn("sequence_id", F.col("pid")).withColumn("offset", F.lit(0).cast("long"))
    return full.unionByName(pieces.where(F.col("length") < capacity).join(placed, "pid")).drop("pid")


def sequences(packed: DataFrame) -> DataFrame:
    """The ids of each sequence in order (at most ``capacity`` each); needs ``keep_ids``."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))


def op10_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
