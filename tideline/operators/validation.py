"""Rules that rows of a panel, and answers of a worker, have to keep. All rules are
flags of one pass; what is broken is reported whole, not only its first case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.durations import Duration
from tideline.schema import Variable


class ValidationError(ValueError):
    pass


def described(rows: DataFrame, variables: list[Variable]) -> DataFrame:
    """rows with a struct `spec` of each variable's definition; null for unknown ids."""
    if len({v.id for v in variables}) < len(variables):
        raise ValidationError("variables must have unique ids")
    found = [(v.id, v.dtype, v.support_kind, v.aggregation, v.anchor_policy, Duration.parse(v.window).text, list(v.levels)) for v in variables]
    spec = rows.sparkSession.createDataFrame(found, "indicator_id string, dtype string, support_kind string, summary_operator string, anchor_policy string, observation_window string, levels array<string>")
    # One row for each declared variable.
    spec = spec.select("indicator_id", F.struct(*spec.columns[1:]).alias("spec"))
    return rows.join(F.broadcast(spec), "indicator_id", "left")


def _whole(value: Column) -> Column:
    return value == F.floor(value)


def row_flags() -> dict[str, Column]:
    """What can be wrong with a described observation row (column twins: rows of the
    same indicator and anchor)."""
    v, start, end, anchor = (F.col(c) for c in ("value", "support_start", "support_end", "anchor_time"))
    spec = lambda f: F.col("spec")[f]
    levels = F.size(spec("levels"))
    wrong = {
        "unknown_indicator": F.col("spec").isNull(),
        "anchor_null": anchor.isNull(),
        "nonfinite_value": F.isnan(v) | (F.abs(v) == float("inf")),
        "duplicate_anchor": F.col("twins") > 1,
        "other_window": ~F.col("observation_window").eqNullSafe(spec("observation_window")),
        "support_half_null": start.isNull() != end.isNull(),
        "support_missing": v.isNotNull() & (start.isNull() | end.isNull()),
        "support_order": end < start,
        "support_empty": (spec("support_kind") == "interval") & (end == start),
        "anchor_off_bound": anchor != F.when(spec("anchor_policy") == "support_start", start).otherwise(end),
        "binary_range": (spec("dtype") == "binary") & ~v.isin(0.0, 1.0),
        "count_range": (spec("dtype") == "count") & ((v < 0) | ~_whole(v) | F.isnan(v)),
        "code_range": (levels > 0) & ((v < 0) | (v >= levels) | ~_whole(v) | F.isnan(v)),
    }
    for field in ("support_kind", "summary_operator", "anchor_policy"):
        wrong[f"other_{field}"] = ~F.col(field).eqNullSafe(spec(field))
    known = F.col("spec").isNotNull()
    return {k: F.coalesce(c if k == "unknown_indicator" else c & known, F.lit(False)) for k, c in wrong.items()}


def flagged(rows: DataFrame, variables: list[Variable], by: list[str] | None = None) -> DataFrame:
    """rows with broken: an array of the codes of the rules that they break.
    by: columns that tell subjects apart, whose anchors may coincide."""
    keys = [*(by or []), "indicator_id", "anchor_time"]
    twins = rows.groupBy(*keys).agg(F.count("*").alias("twins"))
    same = rows.join(twins.withColumnsRenamed({k: f"__{k}" for k in keys}), [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]).drop(*[f"__{k}" for k in keys])
    codes = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in row_flags().items()]))
    return described(same, variables).withColumn("broken", codes).select(*rows.columns, "broken")


def violation_counts(rows: DataFrame, variables: list[Variable], by: list[str] | None = None) -> DataFrame:
    """(indicator_id, code, rows) of all broken rules."""
    return flagged(rows, variables, by).select("indicator_id", F.explode("broken").alias("code")).groupBy("indicator_id", "code").agg(F.count("*").alias("rows"))


def validated(rows: DataFrame, variables: list[Variable], by: list[str] | None = None) -> DataFrame:
    """rows as they are; raises if any of them breaks a rule."""
    found = violation_counts(rows, variables, by).groupBy("code").agg(F.sum("rows").alias("rows"), F.min("indicator_id").alias("one")).collect()
    if found:
        raise ValidationError("; ".join(f"{r.code}: {r.rows} rows, of {r.one} and others" for r in sorted(found)))
    return rows


# ---- answers of workers -----------------------------------------------------------

#: value is JSON, so that its type can be told.
ANSWER = "window_start string, indicator_id string, value string"


def answers_of(lines: DataFrame, column: str = "answer") -> DataFrame:
    """(*others, place, window_start, indicator_id, value) of JSON documents
    {"extractions": [...]}; a document or entry of another form has nulls."""
    entry = F.from_json(F.get_json_object(column, "$.extractions"), f"array<struct<{ANSWER.replace(' string', ': string')}>>")
    others = [c for c in lines.columns if c != column]
    return lines.select(*others, F.posexplode_outer(entry).alias("place", "e")).select(*others, "place", "e.*")


def answer_errors(answers: DataFrame, variables: list[Variable], starts: DataFrame | None = None, worker: str = "worker") -> DataFrame:
    """(worker, window_start, indicator_id, error) of all errors of answers (worker,
    place, window_start, indicator_id, value); starts (worker, window_start) are the
    windows that each worker was given. An answer is told its first error; an answer
    to a question that was asked and has none is missing."""
    rows = described(answers, variables)
    text = F.trim(F.lower("value"))
    number, spec = F.col("value").try_cast("double"), F.col("spec")
    dtype, levels = spec["dtype"], F.transform(spec["levels"], lambda x: F.trim(F.lower(x)))
    fits = (
        F.when(F.col("value").isNull(), True)
        .when(dtype == "binary", text.isin("true", "false", "0", "1"))
        .when(dtype == "count", number.isNotNull() & (number >= 0) & _whole(number))
        .when(dtype == "ordinal", number.isNotNull() & _whole(number))
        .when(dtype == "categorical", number.isNull() & ~text.isin("true", "false"))
        .otherwise(number.isNotNull())
    )
    expected = F.lit(True)
    if starts is not None:
        rows = rows.join(starts.distinct().withColumn("given", F.lit(True)), [worker, "window_start"], "left")
        expected = F.col("given").isNotNull()
    counted = F.when(expected & spec.isNotNull() & F.col("window_start").isNotNull(), F.col("place"))
    again = counted > F.min(counted).over(Window.partitionBy(worker, "window_start", "indicator_id"))
    error = (
        F.when(F.col("window_start").isNull() | F.col("indicator_id").isNull(), "malformed")
        .when(~expected, "unexpected_window")
        .when(spec.isNull(), "unknown_indicator")
        .when(F.coalesce(again, F.lit(False)), "duplicate")
        .when(~fits, "dtype")
        .when((dtype == "categorical") & F.col("value").isNotNull() & ~F.array_contains(levels, text), "outside_codebook")
        .when((dtype == "ordinal") & ((number < 0) | (number >= F.size(levels))), "outside_codebook")
    )
    out = rows.withColumn("error", error).select(worker, "window_start", "indicator_id", "error")
    wrong = out.filter("error IS NOT NULL")
    if starts is None:
        return wrong
    seen = out.filter("coalesce(error, '') NOT IN ('malformed', 'unexpected_window', 'unknown_indicator')").select(worker, "window_start", "indicator_id")
    asked = starts.distinct().withColumn("indicator_id", F.explode(F.array(*[F.lit(v.id) for v in variables])))
    missing = asked.join(seen, [worker, "window_start", "indicator_id"], "left_anti").withColumn("error", F.lit("missing"))
    return wrong.unionByName(missing)
