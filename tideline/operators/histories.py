"""Histories and tensors as rows: saved arrays to observation rows, rows to grids and
model-day vectors, and summaries of draws per time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.durations import MICROS_PER_DAY, model_days
from tideline.operators.panel import overlap


class HistoryError(ValueError):
    pass


def at_day(day: Column, origin: Column) -> Column:
    """The time that lies so many days after the origin."""
    return origin + F.make_dt_interval(secs=(F.round(day * MICROS_PER_DAY) / 1_000_000).cast("decimal(18,6)"))


def tensor_rows(arrays: DataFrame, axes: list[str], column: str = "values") -> DataFrame:
    """(*others, *axes, value) of nested arrays: one row per cell, places from 0."""
    out = arrays
    for i, axis in enumerate(axes):
        name = "value" if i + 1 == len(axes) else "__inner"
        others = [c for c in out.columns if c != column]
        out = out.select(*others, F.posexplode(column).alias(axis, name))
        column = name
    return out


def rows_tensor(rows: DataFrame, axes: list[str], by: list[str] | None = None) -> DataFrame:
    """(*by, values): the nested arrays of cells (*by, *axes, value); axes are places
    from 0 of which none is missing."""
    by, out, inner = by or [], rows, "value"
    for k in range(len(axes) - 1, -1, -1):
        listed = F.sort_array(F.collect_list(F.struct(axes[k], inner))).getField(inner)
        out = out.groupBy(*by, *axes[:k]).agg(listed.alias("values"))
        inner = "values"
    return out


def vector_view(arrays: DataFrame, start: int = 0, stop: int | None = None, column: str = "values", mask: str | None = None) -> Column:
    """A slice of an array column; masked and non-finite cells are null."""
    n = F.size(column) if stop is None else F.least(F.size(column), F.lit(stop))
    x = F.slice(F.col(column), F.lit(start + 1), F.greatest(n - start, F.lit(0)))
    fine = lambda v: F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)
    if mask is None:
        return F.transform(x, fine)
    return F.zip_with(x, F.slice(F.col(mask), F.lit(start + 1), F.greatest(n - start, F.lit(0))), lambda v, keep: F.when(keep, fine(v)))


def emissions(cells: DataFrame, layout: DataFrame, replicate: int, origin: Column) -> DataFrame:
    """Observation rows of one replicate's cells (draw, time, indicator_id, value,
    observed, start, end; times in model days) and layout (indicator_id and its
    fixed fields). Cells that weren't observed have null values; an observed cell
    without a finite value or support fails the query."""
    v, seen = F.col("value"), F.col("observed")
    odd = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    broken = (seen & (odd(v) | odd(F.col("start")) | odd(F.col("end")))) | (F.abs(v) == float("inf"))
    value = F.when(F.coalesce(broken, F.lit(False)), F.raise_error(F.lit("a cell isn't finite"))).when(seen, v)
    day = lambda c: F.when(~F.isnan(c), at_day(F.col(c), origin))
    rows = cells.filter(F.col("draw") == replicate).select("indicator_id", value.cast("double").alias("value"), at_day(F.col("time"), origin).alias("anchor_time"), day("start").alias("support_start"), day("end").alias("support_end"))
    fields = [c for c in layout.columns if c != "indicator_id"]
    return rows.join(layout, "indicator_id").select("indicator_id", "value", "anchor_time", *fields, "support_start", "support_end")


def saved_rows(histories: DataFrame, origin: Column) -> DataFrame:
    """Observation rows of saved histories (indicator_id, fixed fields, and the arrays
    times, values, starts, ends in model days). Arrays of different length fail."""
    arrays = ["times", "values", "starts", "ends"]
    fields = [c for c in histories.columns if c not in arrays]
    same = F.size("times") == F.size("values")
    for c in ("starts", "ends"):
        same = same & (F.size("times") == F.size(c))
    zipped = F.when(same, F.arrays_zip(*arrays)).otherwise(F.raise_error(F.lit("arrays of a history differ in length")))
    out = histories.select(*fields, F.inline(zipped))
    fine = F.when(~F.isnan("values") & (F.abs("values") < float("inf")), F.col("values"))
    return out.select(*fields, fine.alias("value"), at_day(F.col("times"), origin).alias("anchor_time"), at_day(F.col("starts"), origin).alias("support_start"), at_day(F.col("ends"), origin).alias("support_end"))


def vectors(rows: DataFrame, origin: Column, by: list[str]) -> DataFrame:
    """(*by, times, values, starts, ends): histories as arrays of model days in order."""
    day = lambda c: model_days(F.col(c), origin)
    point = F.struct(day("anchor_time").alias("t"), F.col("value").alias("v"), day("support_start").alias("s"), day("support_end").alias("e"))
    out = rows.groupBy(*by).agg(F.sort_array(F.collect_list(point)).alias("p"))
    return out.select(*by, *[F.col(f"p.{a}").alias(b) for a, b in (("t", "times"), ("v", "values"), ("s", "starts"), ("e", "ends"))])


def onto_grid(rows: DataFrame, grid: DataFrame, ids: list[str], value: str, time: str = "time") -> DataFrame:
    """grid with a column per indicator: its first value at each time that isn't null."""
    return grid.join(rows.groupBy(time).pivot("indicator_id", ids).agg(F.first(value, True)), time, "left")


def renamed(rows: DataFrame, column: str, names: dict[str, str]) -> DataFrame:
    """rows with a column's values replaced; one without a new name fails the query."""
    new = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col(column)]
    return rows.withColumn(column, F.when(new.isNotNull(), new).otherwise(F.raise_error(F.concat(F.lit("no name for "), F.coalesce(F.col(column).cast("string"), F.lit("null"))))))


def definitions(rows: DataFrame, fields: list[str]) -> DataFrame:
    """(indicator_id, *fields): each field's value that isn't null."""
    return rows.groupBy("indicator_id").agg(*[F.first(f, True).alias(f) for f in fields])


def with_boundaries(wide: DataFrame, rows: DataFrame, origin: Column) -> DataFrame:
    """wide (time and value columns) with rows of nulls at the anchors and support
    bounds of interval rows that it lacks, and at time 0 if it begins later."""
    bounds = rows.filter("support_kind = 'interval' AND anchor_time IS NOT NULL").select(F.explode(F.array("anchor_time", "support_start", "support_end")).alias("t")).filter("t IS NOT NULL")
    zero = wide.agg(F.min("time").alias("time")).filter("time > 0").select(F.lit(0.0).alias("time"))
    times = bounds.select(model_days(F.col("t"), origin).alias("time")).union(zero).distinct()
    return wide.unionByName(times.join(wide, "time", "left_anti"), allowMissingColumns=True)


def on_all_anchors(histories: DataFrame) -> DataFrame:
    """(history, anchor_time, value): every history on the union of all anchors."""
    anchors, names = histories.select("anchor_time").distinct(), histories.select("history").distinct()
    # Histories are few, and each gets every anchor: that is the result.
    return anchors.join(F.broadcast(names)).join(histories.select("history", "anchor_time", "value"), ["history", "anchor_time"], "left")


def wide_csv(rows: DataFrame, ids: list[str], path: str, time: str = "anchor_time") -> None:
    """One CSV line per time, in time order: timestamp, and each indicator's value and
    support (name, name_start, name_end)."""
    wide = rows.groupBy(F.col(time).alias("timestamp")).pivot("indicator_id", ids).agg(F.first("value", True).alias("value"), F.first("support_start", True).alias("start"), F.first("support_end", True).alias("end"))
    named = wide.select("timestamp", *[F.col(f"{i}_{f}").alias(i if f == "value" else f"{i}_{f}") for i in ids for f in ("value", "start", "end")])
    named.orderBy("timestamp").write.mode("overwrite").csv(path, header=True)


def masked(rows: DataFrame, by: list[str], order: str, keep: set[int] | None = None, drop: set[int] = frozenset()) -> DataFrame:
    """rows whose value is null where their place (from 0) isn't to be kept or is dropped."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1
    stays = ~place.isin(*drop) if drop else F.lit(True)
    if keep is not None:
        stays = stays & place.isin(*keep)
    return rows.withColumn("value", F.when(stays, F.col("value")))


def category_shares(rows: DataFrame, times: DataFrame, levels: list[str]) -> DataFrame:
    """(time, level, probability, n_draws) of draws (time, value): every level at every
    time; null where a time has no draw."""
    fine = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    seen = rows.filter(fine).groupBy("time").agg(F.count("*").alias("n_draws"), *[F.count_if(F.col("value") == k).alias(f"__{k}") for k in range(len(levels))])
    all_ = times.select("time").distinct().join(seen, "time", "left").withColumn("n_draws", F.coalesce("n_draws", F.lit(0)))
    share = lambda k: F.when(F.col("n_draws") > 0, F.col(f"__{k}") / F.when(F.col("n_draws") > 0, F.col("n_draws")))
    return all_.select("time", "n_draws", F.inline(F.array(*[F.struct(F.lit(x).alias("level"), share(k).alias("probability")) for k, x in enumerate(levels)])))


def density_histogram(rows: DataFrame, by: list[str], bins: int = 50, padding: float = 0.05) -> DataFrame:
    """(*by, center, density): equal bins over the values' range, padded on both sides
    by a share of it, or by 0.5 if it is a point; bins without values have density 0."""
    fine = rows.filter(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))
    ends = fine.groupBy(*by).agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("n"))
    pad = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) * padding).otherwise(0.5)
    ends = ends.select(*by, "n", (F.col("lo") - pad).alias("lo"), ((F.col("hi") - F.col("lo") + 2 * pad) / bins).alias("width"))
    place = F.least(F.floor((F.col("value") - F.col("lo")) / F.col("width")), F.lit(bins - 1))
    counts = fine.join(ends, by).groupBy(*by, place.alias("bin")).agg(F.count("*").alias("k"))
    every = ends.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))))
    out = every.join(counts, [*by, "bin"], "left")
    return out.select(*by, (F.col("lo") + (F.col("bin") + 0.5) * F.col("width")).alias("center"), (F.coalesce("k", F.lit(0)) / (F.col("n") * F.col("width"))).alias("density"))


def interval_statistics(windows: DataFrame, segments: DataFrame, key: str, bin_seconds: int, by: list[str] | None = None) -> DataFrame:
    """(key, mean, std, sum, count) of segments' values (column v) over windows, weighted
    by the seconds of their overlap."""
    w, v = F.col("overlap"), F.col("v")
    out = overlap(windows, segments, bin_seconds, by).groupBy(key).agg(F.sum(w).alias("__w"), F.sum(w * v).alias("__s"), F.sum(w * v * v).alias("__q"), F.sum("v").alias("sum"), F.count("v").alias("count"))
    mean = F.col("__s") / F.col("__w")
    return out.select(key, mean.alias("mean"), F.sqrt(F.greatest(F.col("__q") / F.col("__w") - mean * mean, F.lit(0.0))).alias("std"), "sum", "count")


def trapezoid_mean(windows: DataFrame, segments: DataFrame, key: str, bin_seconds: int, by: list[str] | None = None) -> DataFrame:
    """(key, mean) of a path that runs straight through each segment from value a at its
    left end to value b at its right one."""
    length = F.timestamp_diff("MICROSECOND", F.col("left"), F.col("right")) / 1e6
    part = lambda t: F.timestamp_diff("MICROSECOND", F.col("left"), t) / 1e6 / length
    lo, hi = part(F.greatest("start", "left")), part(F.least("end", "right"))
    middle = F.col("a") + (F.col("b") - F.col("a")) * (lo + hi) / 2
    out = overlap(windows, segments, bin_seconds, by)
    return out.groupBy(key).agg((F.sum(middle * F.col("overlap")) / F.sum("overlap")).alias("mean"))


def requests_in_window(requests: DataFrame, seconds: int, most: int, by: list[str], time: str = "ts") -> DataFrame:
    """requests with recent, how many of the same subject came in the window that ends
    with them, and admitted, whether these are at most `most`."""
    at = F.unix_micros(F.col(time).cast("timestamp"))
    recent = F.count("*").over(Window.partitionBy(*by).orderBy(at).rangeBetween(-seconds * 1_000_000 + 1, 0))
    return requests.withColumn("recent", recent).withColumn("admitted", F.col("recent") <= most)


def by_expected_work(draws: DataFrame, work: str, partitions: int) -> DataFrame:
    """draws dealt to tasks of similar expected work, each with its place in order of
    rising work (`order`), from which the given order can be restored."""
    dealt = draws.repartitionByRange(partitions, F.col(work), F.col("draw")).sortWithinPartitions(work, "draw")
    return dealt.withColumn("order", F.monotonically_increasing_id())


def sectioned(rows: DataFrame, section: str, order: list[str]) -> DataFrame:
    """rows with section_rows and place (from 1) in their section, in section order."""
    w = Window.partitionBy(section)
    return rows.withColumns({"section_rows": F.count("*").over(w), "place": F.row_number().over(w.orderBy(*order))}).orderBy(section, "place")
