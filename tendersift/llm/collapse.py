"""One text for each class of equal documents, so that copies of any number are worked on once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tendersift.llm.common import in_arrays, staged
from tendersift.llm.hashing import Words, words_of

#: Stands for a missing id: it comes after all others.
NO_ID = (1 << 63) - 1
Describe = Callable[[Words], tuple[np.ndarray, np.ndarray, np.ndarray]]


def described(texts: pa.Array, describe: Describe, lower: bool) -> list[np.ndarray]:
    """What ``describe`` gives for every text of a column."""
    found = [describe(w) for w in words_of(texts, lower)]
    return [np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3)]


def collapse(docs: DataFrame, describe: Describe, lower: bool = False, extra: Callable[[str | None], str] | None = None,
             ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``describe`` gives two hashes of what makes texts equal and a size; texts of size 0 are in no class.

    Returns, all written to the shared folder: a row per document (id, k1, k2, n and ``extra`` if there is one), a row per
    class (node, id, k1, k2, n; ``id`` is the smallest one, ``node`` any unique number) and the texts (node, id, n, text).
    """
    given = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), "text")

    def tell(batch: pa.RecordBatch):
        texts = batch.column(1)
        yield [batch.column(0), *described(texts, describe, lower), *([[extra(t) for t in texts.to_pylist()]] if extra else [])]

    info = staged(in_arrays(given, tell, "id bigint, k1 bigint, k2 bigint, n bigint" + (", extra string" if extra else "")))
    nodes = staged(info.where("n > 0").groupBy("k1", "k2", "n").agg(F.min("id").alias("id")).withColumn("node", F.monotonically_increasing_id()))
    if info.groupBy("id").count().where("count > 1").isEmpty():
        return info, nodes, staged(given.join(nodes, "id").select("node", "id", "n", "text"))

    def name(batch: pa.RecordBatch):
        yield [batch.column(0), *described(batch.column(1), describe, lower), batch.column(1)]

    # Rows share an id (or have none) and may differ in text, so they are joined on what names their text as well.
    named = in_arrays(given, name, "id bigint, k1 bigint, k2 bigint, n bigint, text string")
    one = named.join(nodes, ["id", "k1", "k2", "n"]).groupBy("node").agg(F.first("id").alias("id"), F.first("n").alias("n"), F.first("text").alias("text"))
    return info, nodes, staged(one)
