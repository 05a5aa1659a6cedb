"""Windows with explicit empty ones."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.durations import Duration


def ticks(rows: DataFrame, window: Duration, by: list[str] | None = None, time: str = "timestamp", start: str | None = None, end: str | None = None) -> DataFrame:
    """(*by, tick): every window from the first to the last that holds a row, for
    each subject that has rows. start and end take the place of the first and the
    last row, in all directions; only windows that lie within them whole remain."""
    by = by or []
    span = rows.withColumn("tick", window.floor(F.col(time))).groupBy(*by).agg(F.min("tick").alias("lo"), F.max("tick").alias("hi")).filter("lo IS NOT NULL")
    lower, upper = (F.lit(x).cast("timestamp_ntz") for x in (start, end))
    lo, hi = (F.lit(window.floor_at(datetime.fromisoformat(x)).isoformat()).cast("timestamp_ntz") if x else None for x in (start, end))
    span = span.withColumns({"lo": F.col("lo") if lo is None else lo, "hi": F.col("hi") if hi is None else hi}).filter("lo <= hi")
    out = span.select(*by, F.explode(window.ticks(F.col("lo"), F.greatest("lo", "hi"))).alias("tick"))
    if start:
        out = out.filter(F.col("tick") >= lower)
    return out.filter(window.add(F.col("tick")) <= upper) if end else out


def in_windows(rows: DataFrame, grid: DataFrame, window: Duration, by: list[str] | None = None, time: str = "timestamp") -> DataFrame:
    """Rows of the retained windows, with their tick."""
    return rows.withColumn("tick", window.floor(F.col(time))).join(grid, [*(by or []), "tick"], "left_semi")


def dense(grid: DataFrame, rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Every tick with its rows; an empty window has one row that isn't observed."""
    out = grid.join(rows.withColumn("observed", F.lit(True)), [*(by or []), "tick"], "left")
    return out.withColumn("observed", F.coalesce("observed", F.lit(False)))


def filled(value: Column, how: str | float | None, limit: int | None, by: list[str], order: str = "tick") -> Column:
    """Null filling along each subject's grid."""
    if how is None or limit == 0:
        return value
    across, w = Window.partitionBy(*by), Window.partitionBy(*by).orderBy(order)
    if how == "forward":
        reach = Window.unboundedPreceding if limit is None else -limit
        return F.coalesce(value, F.last(value, True).over(w.rowsBetween(reach, 0)))
    if how == "backward":
        reach = Window.unboundedFollowing if limit is None else limit
        return F.coalesce(value, F.first(value, True).over(w.rowsBetween(0, reach)))
    if how in ("min", "max", "mean"):
        f = {"min": F.min, "max": F.max, "mean": F.avg}[how]
        return F.coalesce(value, f(value).over(across))
    return F.coalesce(value, F.lit({"zero": 0.0, "one": 1.0}.get(how, how)).cast("double"))


def boundaries(start: str, end: str, window: Duration) -> Column:
    """Calendar boundaries inside a span, as an array."""
    lo, hi = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    return F.filter(window.ticks(window.floor(lo), hi), lambda t: t >= lo)


def buckets(rows: DataFrame, grid: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """(*by, tick, rows): each window's rows in order of their columns."""
    listed = F.sort_array(F.collect_list(F.when(F.col("observed"), F.struct(*columns))))
    return dense(grid, rows, by).groupBy(*(by or []), "tick").agg(listed.alias("rows"))


def simulation_grid(spark, start: float, end: float, step: float, events: list[float]) -> DataFrame:
    """Distinct model times: a regular clock and the events within it."""
    n = int((end - start) / step + 1e-9)
    clock = spark.range(n + 1).select((F.lit(start) + F.col("id") * F.lit(step)).alias("time"))
    extra = spark.range(1).select(F.explode(F.array(*[F.lit(float(e)) for e in events] or [F.lit(start)])).alias("time"))
    return clock.union(extra.filter((F.col("time") >= start) & (F.col("time") <= end))).distinct()
