"""Session settings and the shared folder used for staged tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# ANSI mode stays on (the Spark 4 default): the operators use try_* functions where bad input is expected.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cpus: int = 8, app: str = "mediatally", **extra: str) -> SparkSession:
    """A local session for tests and the bench; a cluster job brings its own session."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    conf = {
        **SETTINGS,
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.driver.memory": "12g",
        "spark.ui.enabled": "false",
        **extra,
    }
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in spark.checkpoint.dir.

    Only a local session without the setting gets a folder of its own, once, which goes when the process ends.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    if not OWN_FOLDER:
        OWN_FOLDER.append(tempfile.TemporaryDirectory(prefix="mediatally-", ignore_cleanup_errors=True))
    return OWN_FOLDER[0].name


OWN_FOLDER: list[tempfile.TemporaryDirectory] = []


def new_stage(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder; nothing is overwritten."""
    return f"{shared_folder(spark)}/mediatally/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """The table written once to the shared folder and read back, which ends its lineage."""
    path = new_stage(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
