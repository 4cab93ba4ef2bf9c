"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over seven bytes decides where a text is cut: a position ends a piece when the hash is one less
than a multiple of the block size. Every piece gives one character of the signature, so an edit changes the
signature only where it was made. The block size is the smallest 3 * 2^k that gives at most 64 pieces; a second
signature is taken at twice that size. Two fingerprints are compared by edit distance (insertions and deletions,
a replacement counts as both) between the signatures taken at one common block size; block sizes further apart
give 0.

Defined cases: a null text is an empty one; the empty fingerprint is ``3::``; equal texts have equal fingerprints,
and equal fingerprints have likeness 1. Unequal signatures without a common run of four characters have likeness
0, so chance agreements do not count.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tendersift.llm.common import BATCH_ROWS, arrow_schema, in_batches, mix, parts, prepare, staged, table

WINDOW, PIECES, SMALLEST, COMMON_RUN = 7, 64, 3, 4
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_ROLL, _BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
_ALPHABET = np.frombuffer(LETTERS.encode(), np.uint8)
_REPEATS = re.compile(r"(.)\1{3,}")


class _Powers:
    """Powers of the base of the piece hash and of its inverse, as many as the longest text so far needs."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def reach(cls, n: int) -> None:
        if len(cls.up) < n:
            size = 1 << n.bit_length()
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(cls, name, np.multiply.accumulate(steps))


def fingerprint(text: str | None) -> str:
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    n = len(data)
    if n == 0:
        return f"{SMALLEST}::"
    _Powers.reach(n + 1)
    value = _BYTES[data]
    roll = value.copy()
    for j in range(1, min(WINDOW, n)):
        roll[j:] += value[:-j] * np.uint64(pow(_ROLL, j, 1 << 64))
    roll = (mix(roll) >> np.uint64(32)).astype(np.uint32)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(value * _Powers.up[:n], out=sums[1:])

    def signature(cuts: np.ndarray) -> str:
        ends = cuts + 1
        if not len(ends) or ends[-1] != n:
            ends = np.append(ends, n)
        starts = np.concatenate(([0], ends[:-1]))
        pieces = mix((sums[ends] - sums[starts]) * _Powers.down[starts])
        return _ALPHABET[(pieces >> np.uint64(58)).astype(np.intp)].tobytes().decode()

    size, cuts = SMALLEST, np.flatnonzero(roll % np.uint32(SMALLEST) == SMALLEST - 1)
    while len(cuts) + (len(cuts) == 0 or cuts[-1] != n - 1) > PIECES:
        size *= 2
        cuts = cuts[roll[cuts] % np.uint32(size) == size - 1]
    twice = cuts[roll[cuts] % np.uint32(2 * size) == 2 * size - 1]
    return f"{size}:{signature(cuts)}:{signature(twice)}"


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, 64 cells at a time in the bits of an integer."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & where.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _alike(a: str, b: str) -> float:
    if a == b:
        return 1.0
    a, b = _REPEATS.sub(r"\1\1\1", a), _REPEATS.sub(r"\1\1\1", b)  # long repeats of one piece say little
    runs = {a[i : i + COMMON_RUN] for i in range(len(a) - COMMON_RUN + 1)}
    if not any(b[i : i + COMMON_RUN] in runs for i in range(len(b) - COMMON_RUN + 1)):
        return 0.0
    distance = len(a) + len(b) - 2 * _common(a, b)
    return 1.0 - distance / (len(a) + len(b))


def likeness(x: str | None, y: str | None) -> float | None:
    """0 to 1; null if a fingerprint is missing."""
    if x is None or y is None:
        return None
    if x == y:
        return 1.0
    (m, a1, a2), (n, b1, b2) = x.split(":"), y.split(":")
    if m == n:
        return max(_alike(a1, b1), _alike(a2, b2) if len(a2) >= COMMON_RUN and len(b2) >= COMMON_RUN else 0.0)
    if int(m) == 2 * int(n):
        return _alike(a1, b2)
    if int(n) == 2 * int(m):
        return _alike(a2, b1)
    return 0.0


def with_fingerprint(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key`` and ``fingerprint`` of every row."""
    kind = dict(docs.dtypes)[key]
    prepare(docs.sparkSession)
    return in_batches(docs.select(F.col(key).alias("key"), F.col(text).alias("text")),
                      lambda r: {"key": r["key"], "fingerprint": [fingerprint(t) for t in r["text"]]},
                      f"key {kind}, fingerprint string").withColumnRenamed("key", key)


def edited(text: str, following: str) -> str:
    """The last half of the text replaced by as much of the start of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_PAIR = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
         "near_edited double, near_next double")


def _row(doc_id: int | None, text: str, mark: str, following: str, next_mark: str) -> tuple:
    new = edited(text, following)
    new_mark = mark if new == text else fingerprint(new)
    return (doc_id, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), mark, new_mark,
            likeness(mark, new_mark), likeness(mark, next_mark))


def neighbours(docs: DataFrame) -> DataFrame:
    """Each document against its edited text and against the next document.

    The next one follows in descending doc_id; null ids come last, equal ids go by hash of the text, then the
    text; the first document follows the last. An empty table gives no rows, a single document follows itself.

    One range exchange of the texts: tasks hold consecutive documents in order and keep one of them at a time.
    Only the first and last document of each task meet in a second, small step.
    """
    spark = prepare(docs.sparkSession)
    order = [F.col("doc_id").desc_nulls_last(), F.col("h")]
    ranged = (docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
              .withColumn("h", F.xxhash64("text")).repartitionByRange(parts(spark), *order)
              .sortWithinPartitions(*order, "text"))
    schema = f"seam int, part int, text string, {_PAIR}"
    arrow = arrow_schema(schema)

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, out = TaskContext.get().partitionId(), None, []

        def flush() -> pa.RecordBatch:
            columns = zip(*out)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                mark = fingerprint(text)
                if last is None:
                    out.append((1, part, text, doc_id, None, None, mark, None, None, None))
                else:
                    out.append((0, None, None, *_row(*last, text, mark)))
                last = (doc_id, text, mark)
                if len(out) >= BATCH_ROWS:
                    yield flush()
                    out = []
        if last is not None:
            out.append((2, part, last[1], last[0], None, None, last[2], None, None, None))
            yield flush()

    done = staged(ranged.mapInArrow(chain, schema))
    # One number for each task that had rows; which task follows which is all the driver learns.
    filled = [r.part for r in done.where("seam = 1").select("part").orderBy("part").collect()]
    inner = done.where("seam = 0").select(*[c.split()[0] for c in _PAIR.split(", ")])
    if not filled:
        return inner
    after = spark.createDataFrame(list(zip(filled, filled[1:] + filled[:1])), "part int, next_part int")
    heads = done.where("seam = 1").select(F.col("part").alias("next_part"), F.col("text").alias("following"),
                                          F.col("fingerprint").alias("next_mark"))
    ends = (done.where("seam = 2").select("part", "doc_id", "text", "fingerprint").join(after, "part").join(heads, "next_part"))

    def close(r: dict[str, list]) -> dict[str, list]:
        rows = [_row(*x) for x in zip(r["doc_id"], r["text"], r["fingerprint"], r["following"], r["next_mark"])]
        return dict(zip([c.split()[0] for c in _PAIR.split(", ")], map(list, zip(*rows)))) if rows else \
            {c.split()[0]: [] for c in _PAIR.split(", ")}

    return inner.unionByName(in_batches(ends, close, _PAIR))


def op1_fingerprints(spark, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "documents"))
