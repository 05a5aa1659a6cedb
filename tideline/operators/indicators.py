"""Computed variables: raw rows to one value per variable and window."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.durations import Duration
from tideline.functions.rules import Rule, columns_of
from tideline.operators.windows import filled, in_windows, ticks
from tideline.schema import Variable


def summary(aggregation: str, column: str, order: Column) -> Column:
    """A window summary that skips nulls; sum and std of nothing are null."""
    x = F.col(column)
    if aggregation in ("first", "last"):
        at = F.when(x.isNotNull(), order)
        return (F.min_by if aggregation == "first" else F.max_by)(x, at)
    return {"mean": F.avg, "sum": F.sum, "std": F.stddev_samp, "count": F.count}[aggregation](x)


def compute(
    raw: DataFrame,
    variables: list[Variable],
    by: list[str] | None = None,
    time: str = "timestamp",
    ties: list[str] | None = None,
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """(*by, indicator_id, value, timestamp): all windows of all variables, with
    null for windows without raw rows. Variables of one window length share one
    aggregation over the raw rows. Variables that name a missing column are left
    out. by: columns that tell subjects apart; each has a grid of its own."""
    by, order = by or [], F.struct(time, *(ties or []))
    usable = [v for v in variables if set(columns_of(v.rule) if v.rule else [v.column]) <= set(raw.columns)]
    parts = []
    for text in dict.fromkeys(v.window for v in usable):
        window, mine = Duration.parse(text), [v for v in usable if v.window == text]
        grid = ticks(raw, window, by, time, start, end)
        rows = in_windows(raw, grid, window, by, time) if start or end else raw.withColumn("tick", window.floor(F.col(time)))
        values = [(Rule(v.rule, raw.columns).column(order) if v.rule else summary(v.aggregation, v.column, order)).cast("double").alias(v.id) for v in mine]
        wide = grid.join(rows.groupBy(*by, "tick").agg(*values), [*by, "tick"], "left")
        wide = wide.select(*by, "tick", *[filled(F.col(v.id), v.fill, v.fill_limit, by).alias(v.id) for v in mine])
        parts.append(wide.unpivot([*by, "tick"], [v.id for v in mine], "indicator_id", "value"))
    out = reduce(DataFrame.unionByName, parts)
    return out.select(*by, "indicator_id", "value", F.col("tick").alias("timestamp"))


def as_text(rows: DataFrame) -> DataFrame:
    """Extraction rows: values and window starts as strings."""
    return rows.withColumns({"value": F.col("value").cast("string"), "timestamp": F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss")})


# ---- encoding ---------------------------------------------------------------

#: Fixed spellings of binary values.
TRUE_WORDS = ("true", "yes", "1", "1.0", "t", "y")
FALSE_WORDS = ("false", "no", "0", "0.0", "f", "n")


def encode_binary(value: Column) -> Column:
    low = F.lower(value)
    return F.when(low.isin(*TRUE_WORDS), 1.0).when(low.isin(*FALSE_WORDS), 0.0)


def encode_levels(value: Column, levels: list[str]) -> Column:
    """A level's index from its label or from integral text; else null."""
    label = F.lower(F.trim(value))
    number = value.try_cast("double")
    index = F.nullif(F.array_position(F.array(*[F.lit(x.strip().lower()) for x in levels]), label), F.lit(0)) - 1
    inside = (number == F.floor(number)) & (number >= 0) & (number < len(levels))
    return F.when(number.isNotNull(), F.when(inside, number)).otherwise(index.cast("double"))


def encode(rows: DataFrame, variables: list[Variable]) -> DataFrame:
    """value as a double by each variable's type; lossy texts become null."""
    value, out = F.col("value").cast("string"), None
    for v in variables:
        coded = encode_binary(value) if v.dtype == "binary" else encode_levels(value, list(v.levels)) if v.levels else None
        if coded is not None:
            hit = F.col("indicator_id") == v.id
            out = F.when(hit, coded) if out is None else out.when(hit, coded)
    plain = value.try_cast("double")
    return rows.withColumn("value", plain if out is None else out.otherwise(plain))


# ---- annotation -------------------------------------------------------------


def annotate(rows: DataFrame, variables: list[Variable]) -> DataFrame:
    """Observation rows of (indicator_id, value, timestamp), where timestamp is the
    window's start. Rows of an unknown variable fail the query that meets them."""
    start, known = F.col("timestamp"), None
    end = None
    for v in variables:
        hit = F.col("indicator_id") == v.id
        after = Duration.parse(v.window).add(start)
        end = F.when(hit, after) if end is None else end.when(hit, after)
        known = hit if known is None else known | hit
    about = {v.id: (v.support_kind, v.aggregation, v.anchor_policy, v.window) for v in variables}

    def named(i: int) -> Column:
        return F.create_map(*[F.lit(x) for k, a in about.items() for x in (k, a[i])])[F.col("indicator_id")]

    stranger = F.raise_error(F.concat(F.lit("rows of an unknown variable: "), F.coalesce(F.col("indicator_id").cast("string"), F.lit("null"))))
    out = rows.withColumn("indicator_id", F.when(known, F.col("indicator_id")).otherwise(stranger)).withColumns({"support_kind": named(0), "summary_operator": named(1), "anchor_policy": named(2), "observation_window": named(3), "support_start": start, "support_end": end})
    anchor = F.when(F.col("anchor_policy") == "support_start", F.col("support_start")).otherwise(F.col("support_end"))
    extra = [c for c in rows.columns if c not in ("indicator_id", "value", "timestamp")]
    return out.withColumn("anchor_time", anchor).select(*extra, "indicator_id", "value", "anchor_time", "support_kind", "summary_operator", "anchor_policy", "observation_window", "support_start", "support_end")


def recorded(raw: DataFrame, specs: list[dict], by: list[str] | None = None) -> DataFrame:
    """(*by, …): readings taken over unchanged, each with its own support; rows without
    an anchor are dropped. specs: id, value, anchor, start, end (column names)."""
    def stamp(name):
        return F.col(name).cast("timestamp_ntz") if name else F.lit(None).cast("timestamp_ntz")

    parts = [
        raw.select(*(by or []), F.lit(s["id"]).alias("indicator_id"), F.col(s["value"]).cast("double").alias("value"), stamp(s["anchor"]).alias("anchor_time"), stamp(s.get("start")).alias("support_start"), stamp(s.get("end")).alias("support_end")).filter("anchor_time IS NOT NULL")
        for s in specs
    ]
    return reduce(DataFrame.unionByName, parts)


def time_origin(rows: DataFrame, start: str | None = None) -> DataFrame:
    """One row: the earliest anchor or support time, or start, if that is earlier."""
    first = F.min(F.least("anchor_time", "support_start", "support_end"))
    return rows.agg((F.least(first, F.lit(start).cast("timestamp_ntz")) if start else first).alias("time_origin"))


def lossy_counts(rows: DataFrame, variables: list[Variable]) -> DataFrame:
    """(indicator_id, lost): how many values encoding makes null."""
    both = encode(rows.withColumn("__before", F.col("value").cast("string")), variables)
    return both.groupBy("indicator_id").agg(F.count_if(F.col("__before").isNotNull() & F.col("value").isNull()).alias("lost"))


def prepare(raw: DataFrame, variables: list[Variable], **options) -> DataFrame:
    """Raw rows to the panel of observation rows, in one plan."""
    return annotate(encode(compute(raw, variables, **options), variables), variables)
