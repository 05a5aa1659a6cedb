"""Progress events as a file stream, and windowed indicators of a stream.

Events are JSON files whose names rise with time; a name is the cursor from which a
reader goes on. All kinds of events share one schema; `event` tells them apart.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fields of all kinds: step, plan, worker and snapshot.
EVENT = (
    "attempt_id string, event string, status string, total_workers long, max_concurrent_workers long, worker_id long, state string, n_windows long, "
    "n_extractions long, n_llm_calls long, pending_workers long, running_workers long, completed_workers long, failed_workers long, error string"
)
KINDS = ("step", "plan", "worker", "snapshot")


def emit(spark: SparkSession, folder: str, events: list[dict]) -> None:
    """Writes each event as a file of its own through the folder's file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    for e in events:
        name = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}.json"
        # A hidden name first, so that no reader meets half an event.
        out = files.create(path(f"{folder}/.{name}"))
        out.write(bytearray(json.dumps(e, sort_keys=True).encode()))
        out.close()
        files.rename(path(f"{folder}/.{name}"), path(f"{folder}/{name}"))


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the folder's events, with their cursor."""
    return spark.readStream.schema(EVENT).json(folder).withColumn("cursor", F.col("_metadata.file_name"))


def events_after(spark: SparkSession, folder: str, attempt: str, after: str | None = None) -> DataFrame:
    """An attempt's events behind a cursor, in order."""
    rows = spark.read.schema(EVENT).json(folder).withColumn("cursor", F.col("_metadata.file_name")).filter(F.col("attempt_id") == attempt)
    return (rows.filter(F.col("cursor") > after) if after else rows).orderBy("cursor")


def of_kind(events: DataFrame, kind: str) -> DataFrame:
    if kind not in KINDS:
        raise ValueError(f"unknown kind of event: {kind}")
    return events.filter(F.col("event").endswith(kind))


def current_state(events: DataFrame) -> DataFrame:
    """(attempt_id, worker_id, state, cursor) by the latest event of each worker."""
    last = F.max_by(F.struct("state", "cursor"), "cursor").alias("e")
    return of_kind(events, "worker").groupBy("attempt_id", "worker_id").agg(last).select("attempt_id", "worker_id", "e.*")


def state_counts(states: DataFrame) -> DataFrame:
    """(attempt_id, state, workers)."""
    return states.groupBy("attempt_id", "state").agg(F.count("*").alias("workers"))


def progress(events: DataFrame) -> DataFrame:
    """(attempt_id, cursor, status, snapshot, workers): what an attempt's events add up
    to; read twice, they add up to the same."""
    kind = lambda k: F.when(F.col("event").endswith(k), F.col("cursor"))
    counts = F.struct("total_workers", "pending_workers", "running_workers", "completed_workers", "failed_workers")
    return events.groupBy("attempt_id").agg(
        F.max("cursor").alias("cursor"),
        F.max_by("status", kind("step")).alias("status"),
        F.max_by(counts, kind("snapshot")).alias("snapshot"),
        F.countDistinct(F.when(F.col("event").endswith("worker"), F.col("worker_id"))).alias("workers"),
    )


def expired(spark: SparkSession, folder: str, cutoff_seconds: float) -> list[str]:
    """Names of events from before the cutoff, which their names tell."""
    names = spark.read.format("binaryFile").load(f"{folder}/*.json").select(F.element_at(F.split("path", "/"), -1).alias("name"))
    old = F.split("name", "-")[0].cast("long") < int(cutoff_seconds * 1_000_000_000)
    return sorted(r.name for r in names.filter(old).collect())


def sweep(spark: SparkSession, folder: str, cutoff_seconds: float) -> int:
    """Deletes expired events; gives how many there were."""
    path, names = spark._jvm.org.apache.hadoop.fs.Path, expired(spark, folder, cutoff_seconds)
    files = path(folder).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    for n in names:
        files.delete(path(f"{folder}/{n}"), False)
    return len(names)


def windowed(events: DataFrame, time: str, value: str, window: str, late: str = "1 hour") -> DataFrame:
    """(start, n, mean) of observed windows of a stream; time is a TIMESTAMP. A window
    goes out once, when the watermark has passed its end."""
    return events.withWatermark(time, late).groupBy(F.window(time, window)).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(F.col("window.start").alias("start"), "n", "mean")


def run_once(stream: DataFrame, folder: str) -> DataFrame:
    """All input that is there, as a table of files below folder; what a later call
    finds new is added. Every window goes out, also the last ones: each batch
    replaces the whole result of complete aggregates."""
    schema = stream.schema

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/table")

    q = stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(schema).parquet(f"{folder}/table")
