"""Tables written once per application and read back by later stages.

Detector results feed many reports. Writing them to the shared folder keeps every later plan short,
lets the parquet reader prune columns and push filters, and survives the loss of executors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from tendersift.session import shared_dir

_WRITTEN: dict[tuple[str, str, str], str] = {}


def _state(spark: SparkSession, folder: str) -> str:
    """Names, sizes and times of the files of a folder, two levels deep, so that changed inputs are staged anew."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(conf)
    if not fs.exists(root):
        return ""
    found = []
    for entry in fs.listStatus(root):
        inner = fs.listStatus(entry.getPath()) if entry.isDirectory() else [entry]
        found += [f"{x.getPath().toString()} {x.getLen()} {x.getModificationTime()}" for x in inner]
    return "\n".join(sorted(found))


@contextmanager
def _short_methods(spark: SparkSession):
    """Wide rows and many flags give generated methods longer than the JVM compiles (8000 bytes); operators are then not fused instead."""
    name = "spark.sql.codegen.hugeMethodLimit"
    old = spark.conf.get(name)
    spark.conf.set(name, "8000")
    try:
        yield
    finally:
        spark.conf.set(name, old)


def stage(spark: SparkSession, scope: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Write ``build()`` to the shared folder at first use and read it back afterwards."""
    with _short_methods(spark):
        path = stage_folder(spark, scope, name, lambda path: build().write.mode("overwrite").parquet(path))
    return spark.read.parquet(path)


def stage_folder(spark: SparkSession, scope: str, name: str, fill: Callable[[str], None]) -> str:
    """A folder of the shared one that ``fill`` writes several tables to at first use."""
    app = spark.sparkContext.applicationId
    folder = hashlib.sha256(f"{scope}\n{_state(spark, scope)}".encode()).hexdigest()[:12]
    key = (app, folder, name)
    if key not in _WRITTEN:
        path = f"{shared_dir(spark).rstrip('/')}/tendersift/{app}/{folder}/{name}"
        fill(path)
        _WRITTEN[key] = path
    return _WRITTEN[key]
