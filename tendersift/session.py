"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", memory: str = "12g", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tendersift")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Shared folder named by ``spark.checkpoint.dir``; only a local master may fall back to its own."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    own = tempfile.mkdtemp(prefix="tendersift-")
    sc.setCheckpointDir(own)
    return own


def plan_by_row_sizes(spark: SparkSession) -> None:
    """Lets plans take a table for about as large as its rows, unless the session says how large.

    Files are several times smaller. A table below the broadcast limit by its files alone takes hundreds of MB in the driver, which
    collects it to send it to all tasks.
    """
    name = "spark.sql.sources.fileCompressionFactor"
    if float(spark.conf.get(name)) == 1.0:
        spark.conf.set(name, "8.0")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and read them back.

    Survives executor loss, stops the plans of iterative jobs from growing, and gives the next round true
    sizes (a checkpointed frame keeps the size estimate of its whole history).
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tendersift/{spark.sparkContext.applicationId}/steps/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
