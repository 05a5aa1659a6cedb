"""CSV and Parquet sources with a required timestamp column."""

from __future__ import annotations

import hashlib
import json
import uuid
import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class SourceError(ValueError):
    pass


def read_file(spark: SparkSession, path: str) -> DataFrame:
    if path.endswith(".csv"):
        return spark.read.csv(path, header=True, inferSchema=True)
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    raise SourceError(f"only .csv and .parquet files can be read: {path}")


def _common(a: T.DataType, b: T.DataType) -> T.DataType:
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    numbers = [T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType]
    if type(a) in numbers and type(b) in numbers:
        return max(a, b, key=lambda t: numbers.index(type(t)))
    times = (T.DateType, T.TimestampType, T.TimestampNTZType)
    if isinstance(a, times) and isinstance(b, times):
        return T.TimestampNTZType()
    return T.StringType()


def union_permissive(frames: list[DataFrame]) -> DataFrame:
    """All rows; columns by name, in order of appearance, with common types."""
    kinds: dict[str, T.DataType] = {}
    for f in frames:
        for field in f.schema:
            kinds[field.name] = _common(kinds[field.name], field.dataType) if field.name in kinds else field.dataType
    cast = [f.select(*[(F.col(c) if c in f.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()]) for f in frames]
    return reduce(DataFrame.unionByName, cast)


def checked(df: DataFrame) -> DataFrame:
    """df, if its timestamp column is a date or time without nulls and has rows."""
    if "timestamp" not in df.columns or not isinstance(df.schema["timestamp"].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        raise SourceError("a source needs a date or time column named timestamp")
    rows, nulls = df.agg(F.count("*"), F.count_if(F.col("timestamp").isNull())).first()
    if not rows or nulls:
        raise SourceError("a source needs rows, and no null timestamps")
    return df


def read_sources(spark: SparkSession, paths: list[str], start: str | None = None, end: str | None = None) -> DataFrame:
    """start: inclusive date; end: exclusive date."""
    df = checked(union_permissive([read_file(spark, p) for p in paths]))
    at = F.col("timestamp").cast("timestamp_ntz")
    if start:
        df = df.filter(at >= F.lit(start).cast("timestamp_ntz"))
    return df.filter(at < F.lit(end).cast("timestamp_ntz")) if end else df


def captured_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size, sha256) of every CSV and Parquet file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.filter(F.col("path").rlike(r"\.(csv|parquet)$")).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def write_panel(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "zstd").partitionBy("indicator_id").parquet(path)


def project_to_sources(df: DataFrame, needed: set[str]) -> DataFrame:
    """Only needed columns, in source order; all if none of them exists. Needed ones
    that the source lacks are warned of."""
    if missing := sorted(needed - set(df.columns)):
        warnings.warn(f"the source has no columns {', '.join(missing)}", stacklevel=2)
    kept = [c for c in df.columns if c in needed]
    return df.select(kept) if kept else df


# ---- content-addressed tables ----------------------------------------------------


def _exact(c: Column, kind: T.DataType) -> Column:
    """Strings, and arrays and structs of strings, that differ where the values do: null
    from empty, microseconds, every byte. The order of a map's entries doesn't count."""
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_exact(c.getField(f.name), f.dataType).alias(f"c{i}") for i, f in enumerate(kind)]))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _exact(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.array_sort(F.transform(F.map_entries(c), lambda x: F.struct(_exact(x["key"], kind.keyType).alias("k"), _exact(x["value"], kind.valueType).alias("v"))))
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.hex(c)
    return (F.unix_micros(c) if isinstance(kind, T.TimestampType) else c).cast("string")


def content_hash(df: DataFrame) -> str:
    """A hash of df's columns and rows with their counts. The order of rows, their files
    and the process that wrote these don't count: Parquet footers list encodings in an
    order that differs between processes."""
    row = F.to_json(F.struct(*[_exact(df[f"`{f.name.replace('`', '``')}`"], f.dataType).alias(f"c{i}") for i, f in enumerate(df.schema)]), {"ignoreNullFields": "false"})
    rows = df.select(F.sha2(row, 256).alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    # A million lists, then at most 256 rows for the driver.
    level = rows.select("h", F.concat_ws(":", "h", F.col("n").cast("string")).alias("x"))
    for digits in (5, 2):
        level = level.groupBy(F.substring("h", 1, digits).alias("h")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("x")), ","), 256).alias("d")).select("h", F.concat_ws(":", "h", "d").alias("x"))
    return hashlib.sha256("\n".join([df.schema.json(), *sorted(r.x for r in level.collect())]).encode()).hexdigest()


def write_artifact(df: DataFrame, folder: str, name: str, derived_from: dict[str, str] | None = None) -> str:
    """Writes df below folder/blobs/<identity> and a manifest with its files' hashes
    below folder/manifests; gives the identity, which is a hash of name, lineage and
    content. Equal content with equal lineage is written once."""
    spark = df.sparkSession
    staged = f"{folder}/staged/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(staged)
    manifest = {"name": name, "derived_from": derived_from or {}, "content": content_hash(spark.read.parquet(staged))}
    identity = hashlib.sha256(json.dumps(manifest, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    target = f"{folder}/blobs/{identity}"
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(staged).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if files.exists(path(target)):
        files.delete(path(staged), True)
    else:
        # One row per file of the table.
        manifest["files"] = sorted(r.sha256 for r in captured_files(spark, staged).collect())
        files.mkdirs(path(f"{folder}/blobs"))
        files.rename(path(staged), path(target))
        spark.createDataFrame([(identity, json.dumps(manifest, sort_keys=True))], "identity string, manifest string").coalesce(1).write.mode("append").json(f"{folder}/manifests")
    return identity


def read_artifact(spark: SparkSession, folder: str, identity: str) -> DataFrame:
    """The table, if its files have the hashes that its manifest names."""
    found = spark.read.schema("identity string, manifest string").json(f"{folder}/manifests").filter(F.col("identity") == identity).select("manifest").first()
    if found is None:
        raise SourceError(f"no table {identity}")
    at = f"{folder}/blobs/{identity}"
    if sorted(r.sha256 for r in captured_files(spark, at).collect()) != json.loads(found.manifest)["files"]:
        raise SourceError(f"table {identity} isn't what was written")
    return spark.read.parquet(at)
