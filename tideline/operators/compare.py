"""Comparing histories, and draws with what was observed.

Histories are long rows (history, indicator_id, anchor_time, support_start,
support_end, value); a row with a null value was scheduled but missing, and an
absent row was not scheduled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.checks import ranked
from tideline.plans.session import saved


def point_changes(left: DataFrame, right: DataFrame) -> DataFrame:
    """(indicator_id, anchor_time, change, before, after) of single histories."""
    keys = ["indicator_id", "anchor_time"]
    a, b = left.select(*keys, F.col("value").alias("before"), F.lit(True).alias("l")), right.select(*keys, F.col("value").alias("after"), F.lit(True).alias("r"))
    both = a.join(b, keys, "full")
    change = F.when(F.col("l").isNull(), "added").when(F.col("r").isNull(), "removed").when(~F.col("before").eqNullSafe(F.col("after")), "revised")
    return both.withColumn("change", change).filter("change IS NOT NULL").select(*keys, "change", "before", "after")


def schedules(rows: DataFrame) -> DataFrame:
    """(indicator_id, schedules): distinct sets of anchors and supports."""
    point = F.struct("anchor_time", "support_start", "support_end")
    one = rows.groupBy("history", "indicator_id").agg(F.sha2(F.to_json(F.sort_array(F.collect_list(point))), 256).alias("schedule"))
    return one.groupBy("indicator_id").agg(F.countDistinct("schedule").alias("schedules"))


def statistics(rows: DataFrame, by: list[str]) -> DataFrame:
    """Counts, mean, population sd, min and max of each history."""
    v = F.col("value")
    return rows.groupBy(*by).agg(
        F.count(v).alias("observed_count"), F.count_if(v.isNull()).alias("missing_count"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"), F.min(v).alias("min"), F.max(v).alias("max")
    )


def proportions(rows: DataFrame, by: list[str], levels: int) -> DataFrame:
    """(*by, level, proportion) of coded values, with zeros for unseen levels."""
    seen = rows.filter("value IS NOT NULL").groupBy(*by).agg(F.count("*").alias("n"), *[F.count_if(F.col("value") == k).alias(f"l{k}") for k in range(levels)])
    per = F.array(*[F.struct(F.lit(k).alias("level"), (F.col(f"l{k}") / F.col("n")).alias("proportion")) for k in range(levels)])
    return seen.select(*by, F.inline(per))


def calibration(observed: DataFrame, draws: DataFrame) -> DataFrame:
    """(indicator_id, n, covered, outcome): share of observations within the draws'
    pointwise 95 % band; fails under 0.70 or over 0.98."""
    keys = ["indicator_id", "anchor_time"]
    band = draws.groupBy(*keys).agg(F.percentile("value", F.array(F.lit(0.025), F.lit(0.975))).alias("b"))
    both = observed.filter("value IS NOT NULL").join(band, keys)
    inside = (F.col("value") >= F.col("b")[0]) & (F.col("value") <= F.col("b")[1])
    out = both.groupBy("indicator_id").agg(F.count("*").alias("n"), F.avg(inside.cast("double")).alias("covered"))
    return out.withColumn("outcome", F.when(F.col("n") < 2, "not_evaluated").when((F.col("covered") < 0.70) | (F.col("covered") > 0.98), "failed").otherwise("passed"))


def autocorrelation(observed: DataFrame, draws: DataFrame) -> DataFrame:
    """(indicator_id, n, rho): lag-1 autocorrelation of residuals from the draws'
    mean, in time order."""
    keys = ["indicator_id", "anchor_time"]
    mean = draws.groupBy(*keys).agg(F.avg("value").alias("m"))
    r = observed.filter("value IS NOT NULL").join(mean, keys).withColumn("r", F.col("value") - F.col("m"))
    r = r.withColumn("c", F.col("r") - F.avg("r").over(Window.partitionBy("indicator_id")))
    r = r.withColumn("next", F.lead("c").over(Window.partitionBy("indicator_id").orderBy("anchor_time")))
    out = r.groupBy("indicator_id").agg(F.count("*").alias("n"), F.avg(F.col("c") * F.col("next")).alias("p"), F.avg(F.col("c") * F.col("c")).alias("v"))
    ready = (F.col("n") >= 5) & (F.col("v") >= 1e-12)
    return out.select("indicator_id", "n", F.when(ready, F.col("p") / F.when(ready, F.col("v"))).alias("rho"))


def sd_ratio(observed: DataFrame, draws: DataFrame) -> DataFrame:
    """(indicator_id, n, ratio): mean sd of the draws over the observed sd."""
    d = draws.groupBy("indicator_id", "draw").agg(F.stddev_pop("value").alias("s")).groupBy("indicator_id").agg(F.avg("s").alias("draw_sd"))
    o = observed.groupBy("indicator_id").agg(F.count("value").alias("n"), F.stddev_pop("value").alias("sd"))
    ready = (F.col("n") >= 3) & (F.col("sd") > 0)
    return o.join(d, "indicator_id").select("indicator_id", "n", F.when(ready, F.col("draw_sd") / F.when(ready, F.col("sd"))).alias("ratio"))


def test_statistics(observed: DataFrame, draws: DataFrame) -> DataFrame:
    """(indicator_id, statistic, observed, p): share of draws whose statistic is at
    least the observed one."""
    four = {"mean": F.avg, "sd": F.stddev_pop, "min": F.min, "max": F.max}
    o = observed.groupBy("indicator_id").agg(*[f("value").alias(k) for k, f in four.items()]).unpivot("indicator_id", list(four), "statistic", "observed")
    d = draws.groupBy("indicator_id", "draw").agg(*[f("value").alias(k) for k, f in four.items()]).unpivot(["indicator_id", "draw"], list(four), "statistic", "drawn")
    both = d.join(o, ["indicator_id", "statistic"])
    return both.groupBy("indicator_id", "statistic").agg(F.first("observed").alias("observed"), F.avg((F.col("drawn") >= F.col("observed")).cast("double")).alias("p"))


def overlay(draws: DataFrame) -> DataFrame:
    """(indicator_id, anchor_time, median, low, high) of the draws."""
    q = draws.groupBy("indicator_id", "anchor_time").agg(F.percentile("value", F.array(F.lit(0.5), F.lit(0.025), F.lit(0.975))).alias("q"))
    return q.select("indicator_id", "anchor_time", *[F.col("q")[i].alias(k) for i, k in enumerate(("median", "low", "high"))])


def support_match(observed: DataFrame, draws: DataFrame) -> DataFrame:
    """(indicator_id, matched): every observed anchor has every draw, with the same
    support and a value."""
    keys = ["indicator_id", "anchor_time"]
    n = draws.groupBy("indicator_id").agg(F.countDistinct("draw").alias("draws"))
    o = observed.filter("value IS NOT NULL").select(*keys, "support_start", "support_end")
    same = o.join(draws.filter("value IS NOT NULL").select(*keys, "draw", F.col("support_start").alias("s"), F.col("support_end").alias("e")), keys, "left")
    ok = F.col("support_start").eqNullSafe(F.col("s")) & F.col("support_end").eqNullSafe(F.col("e"))
    per = same.groupBy(*keys).agg(F.count_if(ok & F.col("draw").isNotNull()).alias("k")).join(n, "indicator_id", "left")
    return per.groupBy("indicator_id").agg(F.bool_and(F.coalesce(F.col("k") == F.col("draws"), F.lit(False))).alias("matched"))


# ---- summaries of draws ---------------------------------------------------------


def histogram(rows: DataFrame, by: list[str], bins: int = 25) -> DataFrame:
    """(*by, bin, count): min(bins, ceil(sqrt n)) equal bins of the finite values, the
    last edge included."""
    fine = finite(rows)
    ends = fine.groupBy(*by).agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.least(F.lit(bins), F.ceil(F.sqrt(F.count("*")))).cast("int").alias("k"))
    ends = ends.select(*by, "k", "lo", ((F.col("hi") - F.col("lo")) / F.col("k")).alias("width"))
    wide = F.col("width") > 0
    # Not width_bucket, which multiplies first and so rounds otherwise at the edges; a point lies in the middle.
    place = F.when(wide, F.floor((F.col("value") - F.col("lo")) / F.when(wide, F.col("width")))).otherwise(F.floor(F.col("k") / 2))
    return fine.join(ends, by).groupBy(*by, F.least(place + 1, F.col("k")).alias("bin")).agg(F.count("*").alias("count"))


def finite(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))


def ecdf(rows: DataFrame, by: list[str]) -> DataFrame:
    """(*by, value, probability) at distinct finite values."""
    counted = finite(rows).groupBy(*by, "value").agg(F.count("*").alias("n"))
    return ranked(counted, by).select(*by, "value", (F.col("upto") / F.col("total")).alias("probability"))


def effect_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    q = F.percentile("value", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    out = rows.groupBy(*by).agg(F.avg("value").alias("mean"), q.alias("q"), F.avg((F.col("value") > 0).cast("double")).alias("p_positive"))
    return out.select(*by, "mean", F.col("q")[1].alias("median"), F.col("q")[0].alias("low"), F.col("q")[2].alias("high"), "p_positive")


def central_frame(rows: DataFrame, by: list[str], position: str, cover: DataFrame | None = None) -> DataFrame:
    """(*by, low, high): the widest reach of the pointwise 95 % bands, and of the
    values of cover (*by, value), if given."""
    q = rows.groupBy(*by, position).agg(F.percentile("value", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    frame = q.groupBy(*by).agg(F.min(F.col("q")[0]).alias("low"), F.max(F.col("q")[1]).alias("high"))
    if cover is None:
        return frame
    ends = cover.groupBy(*by).agg(F.min("value").alias("__lo"), F.max("value").alias("__hi"))
    return frame.join(ends, by, "left").select(*by, F.least("low", "__lo").alias("low"), F.greatest("high", "__hi").alias("high"))


def paired_effects(action: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, value): action minus reference of paired draws."""
    b = reference.select(*keys, F.col("value").alias("reference"))
    return action.join(b, keys).select(*keys, (F.col("value") - F.col("reference")).alias("value"))


def finite_runs(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """(*by, run, first, last, n): stretches without a null value."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    runs = rows.withColumn("run", F.sum(F.col("value").isNull().cast("int")).over(w)).filter("value IS NOT NULL")
    return runs.groupBy(*by, "run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))


def nearest(rows: DataFrame, by: list[str], order: str, at: Column) -> DataFrame:
    """(*by, value): the row nearest in time; the earlier one of two as near."""
    gap = F.abs(F.timestamp_diff("MICROSECOND", F.col(order), at))
    return rows.groupBy(*by).agg(F.min_by("value", F.struct(gap, F.col(order))).alias("value"))


def boundary_sample(rows: DataFrame, by: list[str], order: list[str], most: int) -> DataFrame:
    """At most `most` rows of each group: the first and last ones and evenly spaced
    ones between, always the same."""
    w = Window.partitionBy(*by)
    edge = min(10, most // 3)
    middle = most - 2 * edge
    r = rows.withColumns({"__i": F.row_number().over(w.orderBy(*order)) - 1, "__n": F.count("*").over(w)})
    slot = (F.col("__n") - 2 * edge) / F.lit(float(max(middle, 1)))
    j = F.col("__i") - edge

    def centre(k):
        """The row that slot k shows: of floor(k * slot) to floor((k + 1) * slot) the middle one."""
        lo, hi = F.floor(k * slot), F.floor((k + 1) * slot)
        return F.when(hi <= lo, lo).otherwise(F.floor((lo + hi - 1) / 2))

    near = F.floor(j / slot)
    shown = F.lit(False)
    for k in (near - 1, near, near + 1):
        shown = shown | ((k >= 0) & (k < middle) & (j == centre(k)))
    keep = (F.col("__n") <= most) | (F.col("__i") < edge) | (F.col("__i") >= F.col("__n") - edge) | shown
    return r.filter(keep).drop("__i", "__n")


def compared(left: DataFrame, right: DataFrame, definitions: DataFrame, inputs: list[str] | None = None) -> DataFrame:
    """(indicator_id, code, outcome, evidence) of two sides of histories (history,
    indicator_id, anchor_time, support_start, support_end, value) and definitions
    (history, indicator_id, definition, dtype). Inputs are left out. Every variable is
    told whether each history has it, whether definitions and schedules agree; and,
    if one side is a single history and the other several draws of the same
    definition, how the draws cover it. Empty sides fail, and so does a history that
    is on both."""
    sides = left.select("history", F.lit("left").alias("side")).union(right.select("history", F.lit("right").alias("side"))).distinct()
    found = sides.groupBy("history").agg(F.count("*").alias("n"), F.min("side").alias("side")).collect()
    n = {k: sum(r.side == k or r.n > 1 for r in found) for k in ("left", "right")}
    if any(r.n > 1 for r in found) or not (n["left"] and n["right"]):
        raise ValueError("each side needs a history, and none can be on both")
    rows = left.unionByName(right).filter(~F.col("indicator_id").isin(inputs or []))
    here = rows.groupBy("indicator_id").agg(F.countDistinct("history").alias("present"))
    kinds = definitions.join(rows.select("history", "indicator_id").distinct(), ["history", "indicator_id"], "left_semi").groupBy("indicator_id").agg(F.countDistinct("definition").alias("kinds"), F.min("dtype").alias("dtype"))
    per = here.join(kinds, "indicator_id", "left").join(schedules(rows), "indicator_id", "left")

    def finding(code, failed, evidence):
        return F.struct(F.lit(code).alias("code"), F.when(failed, "failed").otherwise("passed").alias("outcome"), evidence.cast("double").alias("evidence"))

    complete = F.col("present") == len(found)
    basic = per.select(
        "indicator_id",
        F.inline(F.array(finding("indicator_presence", ~complete, F.col("present")), finding("measurement_definition", F.col("kinds") > 1, F.col("kinds")), finding("observation_schedule", F.col("schedules") > 1, F.col("schedules")))),
    )
    if (n["left"] == 1) == (n["right"] == 1):
        return basic
    observed, draws = (left, right) if n["left"] == 1 else (right, left)
    fit = per.filter(complete & (F.col("kinds") == 1) & ~F.col("dtype").isin("categorical", "ordinal")).select("indicator_id")
    observed = observed.join(fit, "indicator_id", "left_semi")
    draws = draws.join(fit, "indicator_id", "left_semi").withColumnRenamed("history", "draw")
    matched = support_match(observed, draws)
    fine = matched.filter("matched").select("indicator_id")
    observed, draws = observed.join(fine, "indicator_id", "left_semi"), draws.join(fine, "indicator_id", "left_semi")
    parts = [
        basic,
        matched.select("indicator_id", F.lit("observation_support").alias("code"), F.when(F.col("matched"), "passed").otherwise("failed").alias("outcome"), F.lit(None).cast("double").alias("evidence")),
        calibration(observed, draws).select("indicator_id", F.lit("calibration").alias("code"), "outcome", F.col("covered").alias("evidence")),
        outcome_within(autocorrelation(observed, draws), "rho", -0.3, 0.3).select("indicator_id", F.lit("autocorrelation").alias("code"), "outcome", F.col("rho").alias("evidence")),
        outcome_within(sd_ratio(observed, draws), "ratio", 1 / 3, 3.0).select("indicator_id", F.lit("sd_ratio").alias("code"), "outcome", F.col("ratio").alias("evidence")),
    ]
    return reduce(DataFrame.unionByName, parts)


def outcome_within(rows: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """rows with outcome: whether the column lies between low and high."""
    v = F.col(column)
    return rows.withColumn("outcome", F.when(v.isNull() | F.isnan(v), "not_evaluated").when((v < low) | (v > high), "failed").otherwise("passed"))


def statistic_histograms(draws: DataFrame, bins: int = 12) -> DataFrame:
    """(indicator_id, statistic, bin, count) of the draws' mean, sd, min and max."""
    four = {"mean": F.avg, "sd": F.stddev_pop, "min": F.min, "max": F.max}
    d = draws.groupBy("indicator_id", "draw").agg(*[f("value").alias(k) for k, f in four.items()]).unpivot(["indicator_id", "draw"], list(four), "statistic", "value")
    # Written once: a sum of doubles that is made anew can differ in its last bit, and then lie outside of the ends.
    d, _ = saved(d.filter("value IS NOT NULL"))
    ends = d.groupBy("indicator_id", "statistic").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    wide = F.col("hi") > F.col("lo")
    lo, width = F.when(wide, F.col("lo")).otherwise(F.col("lo") - 0.5), F.when(wide, (F.col("hi") - F.col("lo")) / bins).otherwise(1.0 / bins)
    place = F.least(F.floor((F.col("value") - lo) / width), F.lit(bins - 1)) + 1
    return d.join(ends, ["indicator_id", "statistic"]).groupBy("indicator_id", "statistic", place.cast("int").alias("bin")).agg(F.count("*").alias("count"))
