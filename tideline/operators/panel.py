"""Observation rows on one axis of model days, and joins in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.durations import model_days


def pivot(rows: DataFrame, ids: list[str], origin: str) -> DataFrame:
    """One row per anchor: time in model days and a column per indicator, the mean
    of readings that share an anchor."""
    at = model_days(F.col("anchor_time"), F.lit(origin).cast("timestamp_ntz")).alias("time")
    return rows.groupBy(at).pivot("indicator_id", ids).agg(F.avg("value"))


def sparsity(wide: DataFrame, ids: list[str]) -> DataFrame:
    """(indicator_id, missing_share) of each column and of all together."""
    n = F.count("*")
    shares = wide.agg(*[(F.count_if(F.col(c).isNull()) / n).alias(c) for c in ids])
    mean = sum((F.col(c) for c in ids), F.lit(0.0)) / len(ids)
    return shares.withColumn("overall", mean).unpivot([], [*ids, "overall"], "indicator_id", "missing_share")


def sparse(shares: DataFrame, limit: float = 0.5) -> DataFrame:
    """(indicator_id, missing_share, outcome) of sparsity(): columns, and the whole,
    with more than limit missing are warned of."""
    return shares.withColumn("outcome", F.when(F.col("missing_share") > limit, "warned").otherwise("passed"))


def standardize(wide: DataFrame, ids: list[str]) -> DataFrame:
    """(x - mean) / sd by column; divided by 1 where sd isn't positive."""
    stats = wide.agg(*[f(c).alias(f"{c}_{k}") for c in ids for k, f in (("m", F.avg), ("s", F.stddev_samp))])
    sd = lambda c: F.when(F.col(f"{c}_s") > 0, F.col(f"{c}_s")).otherwise(1.0)
    # One row of statistics joins every row.
    both = wide.join(F.broadcast(stats))
    return both.select(*[c for c in wide.columns if c not in ids], *[((F.col(c) - F.col(f"{c}_m")) / sd(c)).alias(c) for c in ids])


def add_boundaries(rows: DataFrame) -> DataFrame:
    """(anchor_time, added): anchors, and support bounds of interval rows that
    aren't anchors already."""
    anchors = rows.select("anchor_time").distinct()
    bounds = rows.filter("support_kind = 'interval'").select(F.explode(F.array("support_start", "support_end")).alias("anchor_time")).filter("anchor_time IS NOT NULL").distinct()
    return anchors.withColumn("added", F.lit(False)).union(bounds.join(anchors, "anchor_time", "left_anti").withColumn("added", F.lit(True)))


def asof(left: DataFrame, right: DataFrame, time: str, value: str, by: list[str] | None = None) -> DataFrame:
    """left with the latest right value at or before its time. One sort over both
    sides; no side is joined with the other."""
    by = by or []
    marked = left.withColumns({"__side": F.lit(1), value: F.lit(None).cast(right.schema[value].dataType)})
    other = right.select(*by, time, value).withColumn("__side", F.lit(0))
    w = Window.partitionBy(*by).orderBy(time, "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = marked.unionByName(other, allowMissingColumns=True)
    return both.withColumn(value, F.last(value, True).over(w)).filter("__side = 1").drop("__side")


def held_inputs(events: DataFrame, start: Column) -> DataFrame:
    """(input, time, level): of each input the level in force at start, dated to
    start, and all later events."""
    before = events.filter(F.col("time") <= start).groupBy("input").agg(F.max_by("level", "time").alias("level")).select("input", start.alias("time"), "level")
    return before.union(events.filter(F.col("time") > start).select("input", "time", "level"))


def overlap(windows: DataFrame, segments: DataFrame, bin_seconds: int, by: list[str] | None = None) -> DataFrame:
    """windows (start, end) joined with the segments (left, right) that they
    overlap, with the overlap in seconds. Both sides are cut into coarse time bins
    that make an equi-join; a pair is kept in the first bin that both share."""
    by = by or []

    def bins(lo: str, hi: str) -> Column:
        low, high = (F.floor(F.unix_timestamp(F.col(c).cast("timestamp")) / bin_seconds) for c in (lo, hi))
        return F.explode(F.sequence(low, high))

    a = windows.withColumn("__bin", bins("start", "end")).withColumn("__first", F.floor(F.unix_timestamp(F.col("start").cast("timestamp")) / bin_seconds))
    b = segments.withColumn("__bin", bins("left", "right")).withColumn("__from", F.floor(F.unix_timestamp(F.col("left").cast("timestamp")) / bin_seconds))
    both = a.join(b, [*by, "__bin"]).filter("left < end AND right > start AND __bin = greatest(__first, __from)")
    seconds = F.timestamp_diff("SECOND", F.greatest("start", "left"), F.least("end", "right"))
    return both.withColumn("overlap", seconds).drop("__bin", "__first", "__from")


def merge_times(left: DataFrame, right: DataFrame, on: str = "time") -> DataFrame:
    """Full outer join on one time column, coalesced."""
    return left.join(right, [on], "full")


def input_level(value: Column, start: Column, end: Column, operator: Column) -> Column:
    """Counts and sums as rates per model day."""
    days = F.timestamp_diff("MICROSECOND", start, end) / 86_400_000_000.0
    return F.when(operator.isin("count", "sum"), value / F.when(days != 0, days)).otherwise(value)


def select_defined(required: DataFrame, present: DataFrame) -> DataFrame:
    """(indicator_id, status): whether each required definition is present as such,
    missing, or present with another meaning."""
    names = [c for c in required.columns if c != "indicator_id"]
    p = present.select("indicator_id", F.struct(*names).alias("found"))
    both = required.withColumn("wanted", F.struct(*names)).join(p, "indicator_id", "left")
    status = F.when(F.col("found").isNull(), "missing").when(F.col("wanted").eqNullSafe(F.col("found")), "present").otherwise("mismatch")
    return both.select("indicator_id", status.alias("status"))


def support_violations(rows: DataFrame, likelihoods: dict[str, str]) -> DataFrame:
    """(indicator_id, violations): values outside the support of each likelihood."""
    v, whole = F.col("value"), F.abs(F.col("value") - F.round("value")) <= 1e-6
    allowed = {"gamma": v > 0, "beta": (v > 0) & (v < 1), "bernoulli": v.isin(0.0, 1.0), "poisson": (v >= 0) & whole, "negative_binomial": (v >= 0) & whole}
    law = F.create_map(*[F.lit(x) for kv in likelihoods.items() for x in kv])[F.col("indicator_id")]
    ok = F.lit(True)
    for name, condition in allowed.items():
        ok = F.when(law == name, condition).otherwise(ok)
    bad = v.isNotNull() & (~ok | F.isnan(v) | (F.abs(v) == float("inf")))
    return rows.groupBy("indicator_id").agg(F.count_if(bad).alias("violations"))
