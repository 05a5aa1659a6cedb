"""Session settings, table reading and cutting of lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def session(name: str = "tideline", **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution; other settings are the cluster's."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in settings.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names. Where none is set, a local session
    takes a temporary one; a cluster must name one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tideline-"))
    return context.getCheckpointDir().rstrip("/")


def saved(df: DataFrame) -> tuple[DataFrame, int]:
    """df, written once to the shared folder and read back, and its number of rows.
    Unlike checkpoint() this doesn't run the last stage twice."""
    path, seen = f"{shared_folder(df.sparkSession)}/saved-{uuid.uuid4().hex}", Observation()
    df.observe(seen, F.count("*").alias("n")).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get["n"]
