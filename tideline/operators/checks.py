"""Validation and quality findings of observation rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.durations import parse_timestamp
from tideline.schema import Variable

MIN_SAMPLES = 10
GAP_FACTOR = 5
COVERAGE_WINDOWS = 10
MODAL_LIMIT = 0.5
WHOLE = 1e-6


def value_counts(rows: DataFrame) -> DataFrame:
    """(indicator_id, value, n) of distinct values, from which the rest is taken: rows
    shrink to them before anything is ordered."""
    return rows.filter("value IS NOT NULL").groupBy("indicator_id", "value").agg(F.count("*").alias("n"))


#: Ranges that a group's distinct values are dealt to before they are ranked.
RANGES = 1024


def ranked(counts: DataFrame, by: list[str]) -> DataFrame:
    """counts (*by, value, n) with upto, how many rows have that value or less, and
    total. Ranges of a group's values are counted first, so no task orders more than
    one range of a group."""
    ends = counts.groupBy(*by).agg(F.min("value").alias("__lo"), F.max("value").alias("__hi"), F.sum("n").alias("total"))
    wide = F.col("__hi") > F.col("__lo")
    place = F.when(wide, F.least(F.floor((F.col("value") - F.col("__lo")) / F.when(wide, F.col("__hi") - F.col("__lo")) * RANGES), F.lit(RANGES - 1))).otherwise(0)
    dealt = counts.join(ends, by).withColumn("__range", place)
    below = dealt.groupBy(*by, "__range").agg(F.sum("n").alias("__n"))
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    below = below.withColumn("__below", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    within = Window.partitionBy(*by, "__range").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.join(below, [*by, "__range"]).withColumn("upto", F.col("__below") + F.sum("n").over(within))
    return out.select(*by, "value", "n", "upto", "total")


def at_rank(rank: Column) -> Column:
    """The value at a rank (from 1) among ranked rows, as an aggregate."""
    return F.min(F.when(F.col("upto") >= rank, F.col("value")))


def empirical_profile(rows: DataFrame) -> DataFrame:
    """n, min, quartiles (nearest), max and mean of each indicator."""
    nearest = lambda q: at_rank(F.round(F.lit(q) * (F.col("total") - 1)) + 1)
    out = ranked(value_counts(rows), ["indicator_id"]).groupBy("indicator_id").agg(
        F.max("total").alias("n"), F.min("value").alias("min"), nearest(0.25).alias("q25"), nearest(0.5).alias("q50"), nearest(0.75).alias("q75"), F.max("value").alias("max"), (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean")
    )
    empty = rows.groupBy("indicator_id").agg(F.count("value").alias("__n")).filter("__n = 0").select("indicator_id", F.col("__n").alias("n"))
    return out.unionByName(empty, allowMissingColumns=True)


def mode(rows: DataFrame) -> DataFrame:
    """(indicator_id, value, n, share): the most frequent value, the least of ties."""
    c = value_counts(rows).groupBy("indicator_id").agg(F.max_by(F.struct("value", "n"), F.struct("n", -F.col("value"))).alias("top"), F.sum("n").alias("total"))
    return c.select("indicator_id", "top.value", "top.n", (F.col("top.n") / F.col("total")).alias("share"))


def largest_gap(rows: DataFrame) -> DataFrame:
    """(indicator_id, gap, span): in hours, between successive anchors, and overall.
    Gaps are taken within days, and between days from their ends."""
    hours = lambda a, b: F.timestamp_diff("SECOND", a, b) / 3600.0
    day = Window.partitionBy("indicator_id", "__day").orderBy("anchor_time")
    r = rows.select("indicator_id", "anchor_time").filter("anchor_time IS NOT NULL").withColumn("__day", F.to_date("anchor_time"))
    r = r.withColumn("gap", hours(F.lag("anchor_time").over(day), F.col("anchor_time")))
    days = r.groupBy("indicator_id", "__day").agg(F.max("gap").alias("gap"), F.min("anchor_time").alias("lo"), F.max("anchor_time").alias("hi"))
    across = F.lag("hi").over(Window.partitionBy("indicator_id").orderBy("__day"))
    days = days.withColumn("gap", F.greatest("gap", hours(across, F.col("lo"))))
    return days.groupBy("indicator_id").agg(F.max("gap").alias("gap"), hours(F.min("lo"), F.max("hi")).alias("span"))


def cadences(rows: DataFrame) -> DataFrame:
    """(indicator_id, cadence): median width of supports in hours; widths are counted first."""
    width = F.timestamp_diff("SECOND", F.col("support_start"), F.col("support_end")) / 3600.0
    c = rows.select("indicator_id", width.alias("width")).filter("width IS NOT NULL").groupBy("indicator_id", "width").agg(F.count("*").alias("n"))
    return c.groupBy("indicator_id").agg(F.percentile("width", F.lit(0.5), F.col("n")).alias("cadence"))


def violations(rows: DataFrame, codes: dict[str, int] | None = None) -> DataFrame:
    """Counts of broken row rules, in one pass. codes: levels of coded indicators."""
    same = Window.partitionBy("indicator_id", "anchor_time")
    v, start, end = F.col("value"), F.col("support_start"), F.col("support_end")
    flags = {
        "anchor_null": F.col("anchor_time").isNull(),
        "nonfinite_value": F.isnan(v) | (F.abs(v) == float("inf")),
        "duplicate_anchor": F.count("*").over(same) > 1,
        "support_half_null": start.isNull() != end.isNull(),
        "support_order": end < start,
        "support_empty": (F.col("support_kind") == "interval") & (end == start),
        "anchor_off_bound": F.col("anchor_time") != F.when(F.col("anchor_policy") == "support_start", start).otherwise(end),
    }
    if codes:
        size = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])[F.col("indicator_id")]
        flags["code_range"] = (v < 0) | (v >= size) | (v != F.floor(v))
    flagged = rows.withColumns({k: F.coalesce(c, F.lit(False)) for k, c in flags.items()})
    return flagged.agg(*[F.count_if(F.col(k)).alias(k) for k in flags])


def no_data(rows: DataFrame) -> DataFrame:
    """(code, outcome) of the whole table: failed if it has no row."""
    return rows.limit(1).agg(F.lit("no_data").alias("code"), F.when(F.count("*") == 0, "failed").otherwise("passed").alias("outcome"))


def findings(rows: DataFrame, variables: list[Variable]) -> DataFrame:
    """(indicator_id, code, outcome, evidence) of every declared or present
    indicator; outcome is passed, failed or not_evaluated. rows: indicator_id,
    value, anchor_time (as text it is parsed), support_start, support_end."""
    if dict(rows.dtypes)["anchor_time"] == "string":
        rows = rows.withColumn("anchor_time", parse_timestamp(F.col("anchor_time")))
    seen, v = rows.filter("value IS NOT NULL"), F.col("value")
    counts = value_counts(rows)
    stats = seen.groupBy("indicator_id").agg(
        F.count("*").alias("n"),
        F.var_samp("value").alias("variance"),
        F.min("value").alias("lo"),
        F.max("value").alias("hi"),
        F.count_if(~v.isin(0.0, 1.0)).alias("not_binary"),
        F.count_if((v < 0) | (F.abs(v - F.round(v)) > WHOLE)).alias("not_count"),
        F.count_if(F.isnan(v) | (F.abs(v) == float("inf"))).alias("nonfinite"),
    )
    # Distinct values on an even grid from the least to the greatest are a sequence.
    step = F.when((F.col("total") > 1) & (F.col("hi") > F.col("lo")), (F.col("hi") - F.col("lo")) / F.when(F.col("total") > 1, F.col("total") - 1))
    off = F.abs(v - F.col("lo") - F.round((v - F.col("lo")) / step) * step)
    per = counts.join(stats.select("indicator_id", "lo", "hi", F.col("n").alias("total")), "indicator_id")
    per = per.groupBy("indicator_id").agg(F.max("n").alias("modal"), F.first(step).alias("step"), F.max(off).alias("off"))
    times = rows.groupBy("indicator_id").agg(F.count("*").alias("n_times"), F.count_if(F.col("anchor_time").isNull()).alias("unparsed"))
    declared = rows.sparkSession.createDataFrame([(x.id, x.dtype) for x in variables], "indicator_id string, dtype string")
    all_ids = declared.join(times, "indicator_id", "full")
    for part in (stats, per, iqr_outliers(rows), cadences(seen), largest_gap(seen)):
        all_ids = all_ids.join(part, "indicator_id", "left")
    all_ids = all_ids.withColumn("n", F.coalesce("n", F.lit(0)))
    n, dtype = F.col("n"), F.col("dtype")

    def finding(code: str, failed: Column, evidence: Column, ready: Column = F.lit(True)) -> Column:
        outcome = F.when(~F.coalesce(ready, F.lit(False)), "not_evaluated").when(F.coalesce(failed, F.lit(False)), "failed").otherwise("passed")
        return F.struct(F.lit(code).alias("code"), outcome.alias("outcome"), evidence.cast("double").alias("evidence"))

    some = n > 0
    broken = F.when(dtype == "binary", F.col("not_binary")).when(dtype == "count", F.col("not_count")).when(dtype == "continuous", F.coalesce("outliers", F.lit(0))).otherwise(0)
    share = F.when(some, F.col("modal") / F.when(some, n))
    covered = F.when(F.col("cadence") > 0, F.col("span") / F.when(F.col("cadence") > 0, F.col("cadence"))) / COVERAGE_WINDOWS
    out = F.array(
        finding("undeclared", dtype.isNull(), n),
        finding("missing", n == 0, n),
        finding("sample_size", n < MIN_SAMPLES, n),
        finding("timestamps", F.col("unparsed") > 0.5 * F.col("n_times"), F.col("unparsed"), F.col("n_times") > 0),
        finding("variance", F.col("variance") == 0, F.col("variance"), n >= 2),
        finding("dtype_violation", broken > 0, broken, some),
        finding("duplicate_values", ~dtype.isin("binary", "count") & (F.col("variance") > 0) & (share > MODAL_LIMIT), share, n >= 2),
        finding("arithmetic_sequence", (n >= 5) & (F.col("modal") == 1) & (F.col("off") <= 1e-9), F.col("step"), some),
        finding("coverage", F.col("span") < COVERAGE_WINDOWS * F.col("cadence"), F.least(F.lit(1.0), covered), n >= 2),
        finding("timestamp_gap", F.col("gap") > GAP_FACTOR * F.col("cadence"), F.col("gap"), n >= 3),
        finding("nonfinite_values", F.col("nonfinite") > 0, F.col("nonfinite"), some),
    )
    return all_ids.select("indicator_id", F.inline(out))


def iqr_outliers(rows: DataFrame, factor: float = 3.0) -> DataFrame:
    """Values outside the nearest quartiles by more than factor * IQR (n >= 10)."""
    p = empirical_profile(rows).withColumn("iqr", F.col("q75") - F.col("q25")).filter(f"n >= {MIN_SAMPLES} AND iqr > 0").select("indicator_id", "q25", "q75", "iqr")
    out = value_counts(rows).join(p, "indicator_id")
    far = (F.col("value") < F.col("q25") - factor * F.col("iqr")) | (F.col("value") > F.col("q75") + factor * F.col("iqr"))
    return out.groupBy("indicator_id").agg(F.sum(F.when(far, F.col("n")).otherwise(0)).alias("outliers"))


def same_construct_pairs(indicators: DataFrame) -> DataFrame:
    """(left_id, right_id) of (indicator_id, construct, position): each pair of
    indicators of one construct, the earlier first."""
    a = indicators.select("construct", F.col("indicator_id").alias("left_id"), F.col("position").alias("i"))
    b = indicators.select("construct", F.col("indicator_id").alias("right_id"), F.col("position").alias("j"))
    return a.join(b, "construct").filter("i < j").select("left_id", "right_id")


def correlation_findings(correlations: DataFrame) -> DataFrame:
    """(left_id, right_id, outcome) of daily_correlation: negative ones fail."""
    r = F.col("r")
    return correlations.select("left_id", "right_id", F.when(r.isNull() | F.isnan(r), "not_evaluated").when(r < 0, "failed").otherwise("passed").alias("outcome"))


def daily_correlation(rows: DataFrame, pairs: list[tuple[str, str]] | DataFrame, least: int = MIN_SAMPLES) -> DataFrame:
    """Pearson correlation of daily means; null under `least` days or without variance."""
    daily = rows.groupBy("indicator_id", F.to_date("anchor_time").alias("day")).agg(F.avg("value").alias("v"))
    chosen = pairs if isinstance(pairs, DataFrame) else rows.sparkSession.createDataFrame(pairs, "left_id string, right_id string")
    a = daily.select(F.col("indicator_id").alias("left_id"), "day", F.col("v").alias("x"))
    b = daily.select(F.col("indicator_id").alias("right_id"), "day", F.col("v").alias("y"))
    both = chosen.join(a, "left_id").join(b, ["right_id", "day"]).filter("x IS NOT NULL AND y IS NOT NULL")
    s = both.groupBy("left_id", "right_id").agg(F.count("*").alias("days"), F.covar_pop("x", "y").alias("c"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"))
    d = F.col("sx") * F.col("sy")
    return s.select("left_id", "right_id", "days", F.when((F.col("days") >= least) & (d > 0), F.col("c") / F.when(d > 0, d)).alias("r"))


#: Wording, and the aggregations that contradict it.
WORDING = [
    (r"\bcount\b|\bnumber of\b|\bhow many\b", ("mean", "std")),
    (r"\baverage\b|\bmean\b", ("sum", "first", "last", "count")),
    (r"\btotal\b|\bcumulative\b|\bsum\b", ("mean", "first", "last")),
    (r"\blast\b|\bmost recent\b|\bcurrent\b", ("mean", "sum")),
]


def wording_conflict(text: Column, aggregation: Column) -> Column:
    """Whether a description's wording contradicts the aggregation."""
    out = F.lit(False)
    for pattern, against in WORDING:
        out = out | (aggregation.isin(*against) & F.lower(text).rlike(pattern))
    return out


def expected_pairs(windows: DataFrame, ids: list[str], rows: DataFrame) -> DataFrame:
    """(timestamp, indicator_id) that a worker should have answered and didn't."""
    wanted = windows.select("timestamp", F.explode(F.array(*[F.lit(i) for i in ids])).alias("indicator_id"))
    return wanted.join(rows.select("timestamp", "indicator_id"), ["timestamp", "indicator_id"], "left_anti")
