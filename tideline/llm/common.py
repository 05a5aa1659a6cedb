"""Tables, durable intermediate results and sizes shared by the operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, a local
    session takes a temporary one; a cluster must name one."""
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tideline-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def durable(df: DataFrame, label: str, partitions: int | None = None) -> DataFrame:
    """Writes df once to the shared folder and reads it back.

    This cuts the lineage, survives the loss of executors, and unlike
    checkpoint() doesn't run the last stage twice.
    """
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    (df if partitions is None else df.coalesce(partitions)).write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.tideline_path = path
    return out


def counted(df: DataFrame, label: str, **measures: Column) -> tuple[DataFrame, dict]:
    """durable(df), and measures of its rows that are taken while they are written."""
    seen = Observation()
    out = durable(df.observe(seen, *[c.alias(k) for k, c in measures.items()]), label)
    return out, seen.get


def discard(*tables: DataFrame) -> None:
    """Deletes what durable() wrote, once nothing reads it any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.tideline_path)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def groups_for(docs: DataFrame, column: str = "text", group_bytes: int = 8 << 20) -> int:
    """How many hash groups hold about group_bytes of text each."""
    total = docs.agg(F.sum(F.octet_length(column).cast("double"))).first()[0] or 0.0
    return max(1, int(total // group_bytes) + 1)


def dealt(rows: DataFrame, column: str, groups: int) -> DataFrame:
    """rows with group numbers 0 to groups - 1 in column, dealt evenly: a task gets
    whole groups, and as many as any other (a hash of the numbers would not do that)."""
    tasks = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionById(max(1, min(groups, tasks)), F.col(column))


#: Bits of the map of wanted ids: 1,024 rows of 4 KB at most.
MAP_BITS = 1 << 25


def wanted_only(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Rows whose id may be in ids (column id), and some others: a bitmap of hashed
    ids, which MAP_BITS bounds, is broadcast, so rows aren't shuffled."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(MAP_BITS)) + 1
    marks = ids.select(place("id").alias("at")).groupBy(F.bitmap_bucket_number("at").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("__bits"))
    held = F.expr("getbit(cast(conv(hex(substring(__bits, cast(__bit div 8 as int) + 1, 1)), 16, 10) as bigint), cast(__bit % 8 as int)) = 1")
    placed = rows.withColumn("__at", place(column)).withColumns({"__bucket": F.bitmap_bucket_number("__at"), "__bit": F.bitmap_bit_position("__at")})
    return placed.join(F.broadcast(marks), "__bucket").filter(held).select(rows.columns)
