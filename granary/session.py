"""Session settings and table access shared by queries, tests and the bench."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", app: str = "granary", **conf: str) -> SparkSession:
    """A local session with the settings that the queries assume; a cluster brings its own."""
    settings = {
        "spark.sql.shuffle.partitions": str(cpus if str(cpus).isdigit() else os.cpu_count() or 8),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark only: the folder may be in any store."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A new folder in that of spark.checkpoint.dir, which a cluster must set; a temporary folder only on this machine, in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{folder or 'file://' + tempfile.mkdtemp(prefix='spark-')}/{label}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """The rows of a small table dealt out over all cores: few bytes are few tasks, however much work a row is."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared folder, with its lineage cut."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(scratch_folder(df.sparkSession, "checkpoints"))
    return df.checkpoint()
