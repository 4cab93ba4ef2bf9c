"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from tendersift.session import cut_lineage

#: A word is a run of characters that are neither a space nor one of the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
#: Whole documents per Arrow batch. A batch is the unit of memory in a Python task.
BATCH_ROWS = 256


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of these jobs: small Arrow batches, and shuffle files that go when their job has ended.

    Every job here ends in a written table, so nothing reads its shuffle files again.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def staged(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: later steps do not repeat the work, and lost executors cost nothing."""
    return cut_lineage(df)


def forget(*frames: DataFrame) -> None:
    """Delete staged tables that no later step reads, to give their disk back before the job ends."""
    for df in frames:
        spark = df.sparkSession
        mark = f"/tendersift/{spark.sparkContext.applicationId}/steps/"
        folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
        if any(mark not in f for f in folders):
            raise ValueError("only staged tables can be deleted")
        for folder in folders:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of ``df`` is called so."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def split_words(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8. bytes.split() parts at exactly the characters 9 to 13 and 32."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def arrow_schema(ddl: str) -> pa.Schema:
    """Arrow form of a schema string. Needs a session, so it is made on the driver."""
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(ddl))


def in_batches(df: DataFrame, rows: Callable[[dict[str, list]], dict[str, list]], schema: str) -> DataFrame:
    """Apply ``rows`` (lists by column name in, lists by column name out) to every Arrow batch of ``df``."""
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = rows({n: c.to_pylist() for n, c in zip(batch.schema.names, batch.columns)})
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def in_arrays(df: DataFrame, rows: Callable[[pa.RecordBatch], Iterator[list]], schema: str) -> DataFrame:
    """``rows`` turns an Arrow batch into any number of column lists (NumPy or Arrow), for work on whole columns."""
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns in rows(batch):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return df.mapInArrow(run, schema)


def append(df: DataFrame, rows: Callable[[list], dict[str, list]], schema: str, column: str = "text") -> DataFrame:
    """Add columns computed from ``column``; all others pass through as they are."""
    arrow = arrow_schema(schema)
    added = StructType.fromDDL(schema)
    taken = {f.name.lower() for f in df.schema} & {f.name.lower() for f in added}
    if taken:
        raise ValueError(f"columns {sorted(taken)} are in the table already")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = rows(batch.column(batch.schema.get_field_index(column)).to_pylist())
            more = [pa.array(out[f.name], f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *arrow.names])

    return df.mapInArrow(run, StructType([*df.schema.fields, *added.fields]))


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (an invertible multiply-and-shift mix)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def single_threaded() -> None:
    """One thread per task: Spark already runs one task per core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
