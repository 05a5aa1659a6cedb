"""What is checked before a model is fitted or a question is answered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.operators.panel import asof, input_level

REACH_SIGMAS = 6.0


def question_windows(questions: DataFrame, panel: DataFrame, origin: Column) -> DataFrame:
    """(question, outcome, place) of questions (question, start, seconds): a window that
    starts before the record's origin fails; others lie inside the record, run past
    its end, or start after it."""
    record = panel.agg(F.max("support_end").alias("record_end"), F.min(origin).alias("origin"))
    q = questions.join(F.broadcast(record))  # one row
    end = F.col("start") + F.make_dt_interval(secs=F.col("seconds"))
    place = F.when(F.col("start") < F.col("origin"), "before").when(end <= F.col("record_end"), "inside").when(F.col("start") <= F.col("record_end"), "past_end").otherwise("after")
    q = q.withColumn("place", place)
    return q.select("question", F.when(F.col("place") == "before", "failed").otherwise("passed").alias("outcome"), "place")


def intervention_ranges(events: DataFrame, targets: DataFrame, readings: DataFrame) -> DataFrame:
    """(question, target, outcome, low, high, outside) of events (question, target,
    value), targets (target, role, indicator_id) and readings (indicator_id, value,
    support_start, support_end, summary_operator): values that an input never had in
    the record fail; a state that isn't an input, or isn't defined, isn't judged."""
    level = input_level(F.col("value"), F.col("support_start"), F.col("support_end"), F.col("summary_operator"))
    seen = targets.filter("role = 'exogenous'").join(readings.filter("value IS NOT NULL").select("indicator_id", level.alias("level")), "indicator_id")
    seen = seen.groupBy("target").agg(F.min("level").alias("low"), F.max("level").alias("high"))
    roles = targets.groupBy("target").agg(F.max("role").alias("role"))
    both = events.join(roles, "target", "left").join(seen, "target", "left")
    beyond = F.when((F.col("value") < F.col("low")) | (F.col("value") > F.col("high")), F.col("value"))
    out = both.groupBy("question", "target").agg(F.max("role").alias("role"), F.max("low").alias("low"), F.max("high").alias("high"), F.sort_array(F.collect_set(beyond)).alias("outside"))
    outcome = F.when(F.coalesce(F.col("role"), F.lit("")) != "exogenous", "not_evaluated").when(F.col("low").isNull() | (F.size("outside") > 0), "failed").otherwise("passed")
    return out.select("question", "target", outcome.alias("outcome"), "low", "high", "outside")


def prior_reach(readings: DataFrame, priors: DataFrame, sigmas: float = REACH_SIGMAS) -> DataFrame:
    """(indicator_id, z, outcome) of point readings (indicator_id, value) and priors
    (indicator_id, mu, sigma) of their free means: a mean that lies more than sigmas
    from its prior's can't be reached."""
    fine = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    means = readings.filter(fine).groupBy("indicator_id").agg(F.avg("value").alias("mean"))
    z = F.abs(F.col("mean") - F.col("mu")) / F.col("sigma")
    out = means.join(priors.filter("sigma > 0"), "indicator_id").select("indicator_id", z.alias("z"))
    return out.withColumn("outcome", F.when(F.col("z") > sigmas, "failed").otherwise("passed"))


def exact_conflicts(readings: DataFrame, constructs: DataFrame) -> DataFrame:
    """(construct, code) of exact readings (construct, time, value) and constructs
    (construct, static, initial): a static construct with two readings that differ,
    and a reading that isn't the fixed initial value (of a construct that varies,
    one at the first of all times)."""
    fine = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    first = readings.agg(F.min("time").alias("first"))
    r = readings.filter(fine).join(constructs, "construct").join(F.broadcast(first))  # one row
    initial = (F.col("static") | (F.col("time") == F.col("first"))) & (F.col("value") != F.col("initial"))
    per = r.groupBy("construct").agg(F.max("static").alias("static"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.bool_or(F.coalesce(initial, F.lit(False))).alias("off"))
    codes = F.array_compact(F.array(F.when(F.col("static") & (F.col("lo") != F.col("hi")), F.lit("conflicting_exact_readings")), F.when(F.col("off"), F.lit("initial_value_mismatch"))))
    return per.select("construct", F.explode(codes).alias("code"))


def inconsistent_inputs(readings: DataFrame, levels: DataFrame, by: list[str], time: str = "time", tolerance: float = 1e-6) -> DataFrame:
    """(*by, time, value, expected) of readings (*by, time, value) that aren't the level
    (*by, time, level) which the input holds then, by more than tolerance, relative
    and absolute."""
    held = asof(readings, levels.withColumnRenamed("level", "expected"), time, "expected", by)
    near = F.abs(F.col("value") - F.col("expected")) <= tolerance + tolerance * F.abs("expected")
    return held.filter(F.col("value").isNotNull() & ~F.isnan("value") & F.col("expected").isNotNull() & ~near).select(*by, time, "value", "expected")
