"""Readers for the yearly tender and bid files and for the reference tables.

CSV is read with a fixed schema, bad cells become null; parquet is read by its own schema. All readers
are lazy: method and year filters and the column list reach the scan.
"""

from __future__ import annotations

import logging
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tendersift import schemas as S
from tendersift.functions import expr as E

log = logging.getLogger(__name__)


def _paths(spark: SparkSession, candidates: Iterable[str]) -> list[str]:
    """Those of the paths that exist in their file system, checked on the driver without reading them."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for path in candidates:
        p = jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(conf).exists(p):
            found.append(path)
    return found


def require_file(spark: SparkSession, path: str, hint: str = "") -> str:
    """Fail early when the result of an earlier stage is missing."""
    if not _paths(spark, [path]):
        raise FileNotFoundError(f"{path} not found. {hint}".strip())
    return path


def _read(spark: SparkSession, paths: list[str], columns: dict[str, T.DataType], fmt: str,
          base: str | None = None) -> DataFrame:
    reader = spark.read.option("basePath", base) if base else spark.read
    if fmt == "parquet":
        return reader.option("mergeSchema", True).parquet(*paths)
    # Spark takes the header of one file for all of them, so every path is read with its own and united by name.
    raw = None
    for path in paths:
        one = reader.option("header", True).option("mode", "PERMISSIVE").csv(path)
        raw = one if raw is None else raw.unionByName(one, allowMissingColumns=True)
    typed = [
        (F.col(c).try_cast(kind) if not isinstance(kind, T.StringType) else F.col(c)).alias(c)
        for c, kind in columns.items() if c in raw.columns
    ]
    others = [F.col(c) for c in raw.columns if c not in columns]
    return raw.select(*typed, *others)


def _dates(df: DataFrame) -> DataFrame:
    texts = [c for c, kind in df.dtypes if c in S.DATE_COLUMNS and kind == "string"]
    return df.withColumns({c: E.lenient_timestamp(F.col(c)) for c in texts})


def pick(df: DataFrame, columns: Sequence[str] | None) -> DataFrame:
    """Known columns of the list; unknown names are ignored."""
    return df.select(*[c for c in columns if c in df.columns]) if columns else df


def sample_rows(df: DataFrame, fraction: float | None, seed: int = S.SEED) -> DataFrame:
    return df if fraction is None else df.sample(fraction=fraction, seed=seed)


def sample_exact(df: DataFrame, n: int, key: str, seed: int = S.SEED) -> DataFrame:
    """Exactly ``n`` rows (or all), the ones with the smallest hash of their key; repeatable.

    Rows are counted by ranges of the hash, each pass a thousandth of the one before, until the range with the n-th row holds
    few rows; only those are ordered. Rows that repeat a key have one hash and are told apart by their columns.
    """
    if n <= 0:
        return df.limit(0)
    hashed = df.withColumn("_h", F.xxhash64(F.col(key), F.lit(seed)))
    low, high, before = -(1 << 63), 1 << 63, 0
    while high - low > 1:
        width = max(1, -(-(high - low) // 1000))
        part = F.floor((F.col("_h").cast("decimal(20,0)") - F.lit(low).cast("decimal(20,0)")) / F.lit(width).cast("decimal(20,0)")).cast("int")
        inside = hashed.where((F.col("_h") >= F.lit(low)) & (F.col("_h") <= F.lit(high - 1)))
        # At most a thousand rows.
        counts = sorted(inside.groupBy(part.alias("p")).count().collect(), key=lambda r: r["p"])
        for r in counts:
            if before + r["count"] >= n:
                break
            before += r["count"]
        else:
            return df
        low, high = low + r["p"] * width, min(high, low + (r["p"] + 1) * width)
        if r["count"] <= 10_000:
            break
    sure = hashed.where(F.col("_h") < F.lit(low))
    last = hashed.where((F.col("_h") >= F.lit(low)) & (F.col("_h") <= F.lit(high - 1)))
    last = last.orderBy("_h", key, F.xxhash64(*df.columns)).limit(n - before)
    return sure.unionByName(last).select(*df.columns)


def load_yearly(
    spark: SparkSession,
    root: str,
    table: str,
    years: int | Sequence[int] | None = None,
    procurement_method: str | None = None,
    columns: Sequence[str] | None = None,
    sample_frac: float | None = None,
    seed: int = S.SEED,
    fmt: str = "csv",
) -> DataFrame:
    """Yearly files ``<table>_<year>.<fmt>`` or partitions ``<table>/year=<year>`` as one table.

    A year may be a file or a partition, also side by side; if it is both, the file is read. Absent years are skipped
    with a warning, no year at all is an error.
    """
    wanted = S.YEARS if years is None else [years] if isinstance(years, int) else list(years)
    schema = S.TENDER_COLUMNS if table == "tenders" else S.BID_COLUMNS
    file_of = {y: f"{root}/{table}_{y}.{fmt}" for y in wanted}
    part_of = {y: f"{root}/{table}/year={y}" for y in wanted}
    files = _paths(spark, file_of.values())
    parts = _paths(spark, [part_of[y] for y in wanted if file_of[y] not in files])
    absent = [y for y in wanted if file_of[y] not in files and part_of[y] not in parts]
    if not files and not parts:
        raise ValueError("No data found. Check years and file paths.")
    if absent:
        log.warning("%s: no data for %s", table, ", ".join(map(str, absent)))
    found = ([_read(spark, files, schema, fmt)] if files else []) + ([_read(spark, parts, schema, fmt, base=f"{root}/{table}")] if parts else [])
    df = found[0] if len(found) == 1 else found[0].unionByName(found[1], allowMissingColumns=True)
    if procurement_method:
        df = df.where(F.col("procurement_method") == procurement_method)
    return sample_rows(_dates(pick(df, columns)), sample_frac, seed)


def load_tenders(spark: SparkSession, root: str, **options) -> DataFrame:
    return load_yearly(spark, root, "tenders", **options)


def load_bids(spark: SparkSession, root: str, **options) -> DataFrame:
    return load_yearly(spark, root, "bids", **options)


def load_open_tenders(spark: SparkSession, root: str, **options) -> DataFrame:
    return load_tenders(spark, root, procurement_method=S.OPEN, **options)


def load_limited_tenders(spark: SparkSession, root: str, **options) -> DataFrame:
    return load_tenders(spark, root, procurement_method=S.LIMITED, **options)


def load_selective_tenders(spark: SparkSession, root: str, **options) -> DataFrame:
    return load_tenders(spark, root, procurement_method=S.SELECTIVE, **options)


def _reference(spark: SparkSession, root: str, table: str, columns: dict[str, T.DataType], fmt: str) -> DataFrame:
    path = require_file(spark, f"{root}/{table}.{fmt}", f"reference table {table}")
    return _dates(_read(spark, [path], columns, fmt))


def load_buyers(spark: SparkSession, root: str, fmt: str = "csv") -> DataFrame:
    return _reference(spark, root, "buyers", S.BUYER_COLUMNS, fmt)


def load_suppliers(spark: SparkSession, root: str, fmt: str = "csv") -> DataFrame:
    return _reference(spark, root, "suppliers", S.SUPPLIER_COLUMNS, fmt)


def load_bidders(spark: SparkSession, root: str, fmt: str = "csv") -> DataFrame:
    return _reference(spark, root, "bidders", S.BIDDER_COLUMNS, fmt)


def tag_year(frames: dict[int, DataFrame]) -> DataFrame:
    """One table out of yearly ones, each row tagged with its year."""
    tagged = [df.withColumn("year", F.lit(y)) for y, df in sorted(frames.items())]
    out = tagged[0]
    for df in tagged[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def overview(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Bytes and number of files per source, from file metadata only."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern).load(root).select("path", "length")
    )
    relative = F.substring_index("path", f"{root.rstrip('/')}/", -1)
    top = F.substring_index(F.substring_index(relative, "/", 1), ".", 1)
    return files.groupBy(top.alias("source")).agg(
        F.count("*").alias("files"), F.sum("length").alias("bytes"))


def validate(df: DataFrame, required: Sequence[str], name: str = "table") -> DataFrame:
    """Check the columns, then count the rows and the mean share of nulls in one aggregate."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{name}: missing columns {missing}")
    nulls = [F.avg(F.col(c).isNull().cast("int")) for c in df.columns]
    total = nulls[0]
    for share in nulls[1:]:
        total = total + share
    return df.agg(F.count("*").alias("rows"), (total / len(nulls)).alias("mean_null_rate")).select(
        F.lit(name).alias("name"), "rows", "mean_null_rate")


def merge_reference(tenders: DataFrame, table: DataFrame, key: str, suffix: str) -> DataFrame:
    """Left join of a reference table; clashing names get the suffix."""
    renamed = [F.col(c).alias(c + suffix if c in tenders.columns else c) for c in table.columns if c != key]
    return tenders.join(table.select(key, *renamed), key, "left")


def merge_with_buyers(tenders: DataFrame, buyers: DataFrame) -> DataFrame:
    return merge_reference(tenders, buyers, "buyer_id", "_buyer")


def merge_with_suppliers(tenders: DataFrame, suppliers: DataFrame) -> DataFrame:
    return merge_reference(tenders, suppliers, "supplier_id", "_supplier")


def tenders_with_bids(tenders: DataFrame, bids: DataFrame, min_bids: int = 2) -> DataFrame:
    counts = bids.groupBy("tender_id").agg(F.count("*").alias("actual_bid_count"))
    return tenders.join(counts.where(F.col("actual_bid_count") >= min_bids), "tender_id")


def write_result(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> str:
    """Write a result table; every task writes its own file. CSV keeps a header."""
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return path
