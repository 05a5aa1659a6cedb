"""Every operator as a query over whole tables, with its oracle in DuckDB SQL.

Users of `events` are subjects with a grid of their own; customers of `orders`
serve as draws or histories. Computed doubles are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.functions.durations import Duration, model_days, parse_timestamp
from tideline.functions.rules import Rule
from tideline.operators import checks, compare, graphs, indicators, panel, posterior, simulate, text, windows
from tideline.plans.session import table
from tideline.schema import Variable

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
TYPES = ["click", "error", "purchase", "signup", "view"]
ORIGIN = "2024-01-01"


#: Added before rounding on both sides: engines that differ in the last bit of a
#: double then round alike where the exact value lies half-way.
NUDGE = "3.7e-10"


def nudged(sql: str) -> str:
    """The same SQL with NUDGE in every round(value, 4) and round(value, 6)."""
    at = 0
    while (at := sql.find("round(", at)) >= 0:
        depth, end = 1, at + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        inner = sql[at + 6 : end - 1]
        if inner.endswith((", 4", ", 6")):
            sql = f"{sql[: at + 6]}({inner[:-3]}) + {NUDGE}{inner[-3:]}{sql[end - 1 :]}"
        at += 6
    return sql


def query(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = nudged(sql)
        return f

    return keep


def r(c: Column | str, digits: int = 6) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c) + float(NUDGE), digits)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("timestamp", F.col("ts"))


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: r(c) for c in names})


# ---- windows ---------------------------------------------------------------------

_BUCKETS = {
    "6h": "time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01')",
    "1d": "date_trunc('day', ts)::TIMESTAMP",
    "7d": "time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01')",
    "1w": "date_trunc('week', ts)::TIMESTAMP",
    "1mo": "date_trunc('month', ts)::TIMESTAMP",
    "3mo": "date_trunc('quarter', ts)::TIMESTAMP",
    "18mo": "(DATE '1970-01-01' + to_months((((year(ts) - 1970) * 12 + month(ts) - 1) // 18 * 18)::INT))::TIMESTAMP",
    "2y": "make_timestamp(1970 + (year(ts) - 1970) // 2 * 2, 1, 1, 0, 0, 0.0)",
}


def _bucket(window: str) -> None:
    calendar = Duration.parse(window).calendar
    source, time = ("orders", "o_orderdate") if calendar else ("events", "ts")
    sql = f"SELECT {_BUCKETS[window]} AS tick, count(*) AS n FROM (SELECT {time} AS ts FROM {source}) GROUP BY 1"
    query(f"bucket_{window}", sql)(lambda s, d: table(s, d, source).groupBy(Duration.parse(window).floor(F.col(time)).alias("tick")).agg(F.count("*").alias("n")))


for _w in _BUCKETS:
    _bucket(_w)

_GRID = """g AS (SELECT user_id, unnest(generate_series(min(tick), max(tick), INTERVAL 1 DAY)) AS tick FROM (SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS tick FROM events) GROUP BY user_id),
e AS (SELECT *, date_trunc('day', ts)::TIMESTAMP AS tick FROM events)"""
DAY = Duration.parse("1d")


@query("tick_frame", f"WITH {_GRID} SELECT user_id, tick FROM g")
def _(s, d):
    return windows.ticks(events(s, d), DAY, ["user_id"])


@query("tick_frame_whole_months", "SELECT unnest(generate_series(TIMESTAMP '1996-02-01', TIMESTAMP '1997-12-01', INTERVAL 1 MONTH)) AS tick")
def _(s, d):
    rows = table(s, d, "orders").withColumn("timestamp", F.col("o_orderdate"))
    return windows.ticks(rows, Duration.parse("1mo"), start="1996-01-15", end="1998-01-15")


@query("tick_frame_beyond_rows", "SELECT c_nationkey, unnest(generate_series(TIMESTAMP '1989-04-01', TIMESTAMP '2001-07-01', INTERVAL 3 MONTH)) AS tick FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) GROUP BY c_nationkey")
def _(s, d):
    """start and end lie beyond all rows: the grid spans them, empty windows too."""
    c = table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    rows = table(s, d, "orders").join(c, "o_custkey").withColumn("timestamp", F.col("o_orderdate"))
    return windows.ticks(rows, Duration.parse("3mo"), ["c_nationkey"], start="1989-02-10", end="2001-11-30")


@query("dense_join", f"WITH {_GRID} SELECT user_id, tick, count(event_id) AS n, bool_or(event_id IS NOT NULL) AS observed FROM g LEFT JOIN e USING (user_id, tick) GROUP BY ALL")
def _(s, d):
    rows = events(s, d).withColumn("tick", DAY.floor(F.col("ts")))
    out = windows.dense(windows.ticks(events(s, d), DAY, ["user_id"]), rows, ["user_id"])
    return out.groupBy("user_id", "tick").agg(F.count("event_id").alias("n"), F.bool_or("observed").alias("observed"))


@query("window_rows", f"WITH {_GRID} SELECT user_id, tick, coalesce(string_agg(event_type, ',' ORDER BY ts, event_id), '') AS kinds FROM g LEFT JOIN e USING (user_id, tick) GROUP BY ALL")
def _(s, d):
    rows = events(s, d).withColumn("tick", DAY.floor(F.col("ts")))
    out = windows.buckets(rows, windows.ticks(events(s, d), DAY, ["user_id"]), ["ts", "event_id", "event_type"], ["user_id"])
    return out.select("user_id", "tick", F.concat_ws(",", F.col("rows.event_type")).alias("kinds"))


@query("semi_join_whole_windows", "SELECT event_id, date_trunc('day', ts)::TIMESTAMP AS tick FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20'")
def _(s, d):
    grid = windows.ticks(events(s, d), DAY, start="2024-01-04T12:00:00", end="2024-01-20T12:00:00")
    return windows.in_windows(events(s, d), grid, DAY).select("event_id", "tick")


@query("model_days", f"SELECT event_id, round(date_diff('microsecond', TIMESTAMP '{ORIGIN}', ts) / 86400000000.0, 6) AS time FROM events")
def _(s, d):
    return events(s, d).select("event_id", r(model_days(F.col("ts"), F.lit(ORIGIN).cast("timestamp_ntz"))).alias("time"))


@query(
    "window_bounds",
    """SELECT o_orderkey, CASE WHEN o_orderdate = date_trunc('month', o_orderdate) THEN o_orderdate - INTERVAL 1 MONTH END AS month_start,
CASE WHEN o_orderdate = date_trunc('month', o_orderdate) THEN o_orderdate END AS month_end, o_orderdate::TIMESTAMP AS week_start, o_orderdate + INTERVAL 7 DAY AS week_end FROM orders""",
)
def _(s, d):
    month, week = Duration.parse("1mo").bounds(F.col("o_orderdate"), False), Duration.parse("7d").bounds(F.col("o_orderdate"), True)
    return table(s, d, "orders").select("o_orderkey", month[0].alias("month_start"), month[1].alias("month_end"), week[0].alias("week_start"), week[1].alias("week_end"))


@query("calendar_boundaries", "SELECT unnest(generate_series(TIMESTAMP '1999-04-01', TIMESTAMP '2000-10-01', INTERVAL 3 MONTH)) AS boundary")
def _(s, d):
    return s.range(1).select(F.explode(windows.boundaries("1999-01-05", "2000-12-31", Duration.parse("3mo"))).alias("boundary"))


@query("simulation_grid", "SELECT DISTINCT t AS time FROM (SELECT i * 0.5 AS t FROM range(0, 21) x(i) UNION ALL SELECT 3.25 UNION ALL SELECT 7.0)")
def _(s, d):
    return windows.simulation_grid(s, 0.0, 10.0, 0.5, [3.25, 7.0, 12.0])


@query(
    "parse_timestamps",
    "SELECT event_id, date_trunc('second', ts)::TIMESTAMP AS a, (date_trunc('second', ts) - INTERVAL 1 HOUR)::TIMESTAMP AS b, date_trunc('day', ts)::TIMESTAMP AS c, NULL::TIMESTAMP AS bad FROM events",
)
def _(s, d):
    shown = lambda f, tail="": parse_timestamp(F.concat(F.date_format("ts", f), F.lit(tail)))
    return events(s, d).select("event_id", shown("yyyy-MM-dd HH:mm:ss").alias("a"), shown("yyyy-MM-dd'T'HH:mm:ss", "+01:00").alias("b"), shown("yyyy-MM-dd").alias("c"), shown("dd.MM.yyyy").alias("bad"))


# ---- summaries and rules ------------------------------------------------------------

_FIRST = {"first": "arg_min(value, (ts, event_id))", "last": "arg_max(value, (ts, event_id))"}
_AGG = _FIRST | {"mean": "avg(value)", "sum": "sum(value)", "std": "stddev_samp(value)", "count": "count(value)"}
_PER_DAY = f"WITH {_GRID}, a AS (SELECT user_id, tick, %s AS v FROM e GROUP BY ALL) SELECT user_id, 'x' AS indicator_id, round(v, 6) AS value, tick AS timestamp FROM g LEFT JOIN a USING (user_id, tick)"


def _agg(name: str) -> None:
    v = Variable("x", "count" if name == "count" else "continuous", name, column="value")
    query(f"agg_{name}", _PER_DAY % f"({_AGG[name]})::DOUBLE")(lambda s, d: rounded(indicators.compute(events(s, d), [v], ["user_id"], ties=["event_id"]), "value"))


for _a in _AGG:
    _agg(_a)

#: name: (rule, the same in SQL). Every operator of the rule language occurs.
_RULES = {
    "filtered_count": ('count_true(event_type == "error")', "count(*) FILTER (event_type = 'error')"),
    "filtered_mean": ('mean(value if event_type == "click" else None)', "avg(value) FILTER (event_type = 'click')"),
    "arithmetic": ("sum(value * 2 + user_id - 1)", "sum(value * 2 + user_id - 1)"),
    "divide": ("mean(value / (user_id - 3))", "avg(value / nullif(user_id - 3, 0))"),
    "modulo": ("sum((user_id - 50) % 7)", "sum((user_id - 50) - 7 * floor((user_id - 50) / 7.0))"),
    "power": ("mean(value ** 2)", "avg(value ** 2)"),
    "negate": ("-sum(value) + 10", "-sum(value) + 10"),
    "plus": ("+mean(value) * 0.5", "avg(value) * 0.5"),
    "not": ('count_true(not event_type == "view")', "count(*) FILTER (event_type <> 'view')"),
    "and_or": ('count_true((event_type == "view" and value > 50) or value < 5)', "count(*) FILTER ((event_type = 'view' AND value > 50) OR value < 5)"),
    "chained": ("count_true(10 <= value < 60)", "count(*) FILTER (value >= 10 AND value < 60)"),
    "in": ('count_true(event_type in ["click", "view"])', "count(*) FILTER (event_type IN ('click', 'view'))"),
    "not_in": ('count_true(event_type not in ("click", "view"))', "count(*) FILTER (event_type NOT IN ('click', 'view'))"),
    "is_none": ('count_true((value if event_type == "view" else None) is not None)', "count(*) FILTER (event_type = 'view')"),
    "contains": ('count_true(contains(props, "K"))', "count(*) FILTER (contains(lower(props), 'k'))"),
    "contains_any": ('count_true(contains_any(event_type, ["CLI", "rch"]))', "count(*) FILTER (contains(event_type, 'cli') OR contains(event_type, 'rch'))"),
    "abs": ("sum(abs(value - 50))", "sum(abs(value - 50))"),
    "coalesce": ('sum(coalesce(value if event_type == "view" else None, 1))', "sum(CASE WHEN event_type = 'view' THEN value ELSE 1 END)"),
    "count_non_null": ('count_non_null(value if value > 20 else None)', "count(*) FILTER (value > 20)"),
    "first": ('first(value if event_type != "view" else None)', "arg_min(value, (ts, event_id)) FILTER (event_type <> 'view')"),
    "last": ('last(value if event_type != "view" else None)', "arg_max(value, (ts, event_id)) FILTER (event_type <> 'view')"),
    "lower": ('count_true(lower(event_type) == "error")', "count(*) FILTER (event_type = 'error')"),
    "std": ("std(value)", "stddev_samp(value)"),
    "guard_min_max": ("mean(value) if max(value) - min(value) > 20 else None", "CASE WHEN max(value) - min(value) > 20 THEN avg(value) END"),
    "guard_any": ('sum(value) if any(event_type == "purchase") else None', "CASE WHEN bool_or(event_type = 'purchase') THEN sum(value) END"),
    "guard_all": ("sum(value) if all(value > 3) else None", "CASE WHEN bool_and(value > 3) THEN sum(value) END"),
}


def _rule(name: str) -> None:
    rule, sql = _RULES[name]
    v = Variable("x", window="1d", rule=rule)
    query(f"rule_{name}", _PER_DAY % f"({sql})::DOUBLE")(lambda s, d: rounded(indicators.compute(events(s, d), [v], ["user_id"], ties=["event_id"]), "value"))


for _r in _RULES:
    _rule(_r)


def _fill_sql(fill, limit) -> str:
    across = "(PARTITION BY user_id)"
    if fill in ("forward", "backward"):
        side, f = ("PRECEDING", "last_value") if fill == "forward" else ("FOLLOWING", "first_value")
        reach = f"{'UNBOUNDED' if limit is None else limit} {side}"
        rows = f"{reach} AND CURRENT ROW" if fill == "forward" else f"CURRENT ROW AND {reach}"
        return f"coalesce(v, {f}(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY tick ROWS BETWEEN {rows}))"
    return f"coalesce(v, {f'avg(v) OVER {across}' if fill == 'mean' else f'{fill}(v) OVER {across}' if fill in ('min', 'max') else {'zero': 0, 'one': 1}.get(fill, fill)})"


def _fill(name: str, fill, limit=None) -> None:
    v = Variable("x", aggregation="last", column="value", fill=fill, fill_limit=limit)
    value = "v" if limit == 0 else _fill_sql(fill, limit)
    sql = f"WITH {_GRID}, a AS (SELECT user_id, tick, arg_max(value, (ts, event_id)) AS v FROM e GROUP BY ALL), j AS (SELECT user_id, tick, v FROM g LEFT JOIN a USING (user_id, tick)) SELECT user_id, 'x' AS indicator_id, round(({value})::DOUBLE, 6) AS value, tick AS timestamp FROM j"
    query(f"fill_{name}", sql)(lambda s, d: rounded(indicators.compute(events(s, d), [v], ["user_id"], ties=["event_id"]), "value"))


for _n, _f, _l in [("forward", "forward", None), ("forward_limit1", "forward", 1), ("forward_limit0", "forward", 0), ("backward", "backward", None), ("backward_limit1", "backward", 1), ("min", "min", None), ("max", "max", None), ("mean", "mean", None), ("zero", "zero", None), ("one", "one", None), ("const", 2.5, None)]:
    _fill(_n, _f, _l)

FLAGSHIP = [
    Variable("click_mean", window="6h", rule='mean(value if event_type == "click" else None)', fill="forward", fill_limit=2),
    Variable("errors", "count", "count", "6h", rule='count_true(event_type == "error")'),
    Variable("latest", aggregation="last", window="6h", column="value", fill=0.0),
]
_FLAGSHIP_CTES = """e AS (SELECT *, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS tick FROM events),
g AS (SELECT user_id, unnest(generate_series(min(tick), max(tick), INTERVAL 6 HOUR)) AS tick FROM e GROUP BY user_id),
a AS (SELECT user_id, tick, avg(value) FILTER (event_type = 'click') AS m, (count(*) FILTER (event_type = 'error'))::DOUBLE AS n, arg_max(value, (ts, event_id)) AS l FROM e GROUP BY ALL),
j AS (SELECT user_id, tick, coalesce(m, last_value(m IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY tick ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) AS click_mean, n AS errors, coalesce(l, 0) AS latest FROM g LEFT JOIN a USING (user_id, tick)),
f AS (SELECT user_id, 'click_mean' AS indicator_id, click_mean AS value, tick FROM j UNION ALL SELECT user_id, 'errors', errors, tick FROM j UNION ALL SELECT user_id, 'latest', latest, tick FROM j)"""


@query("flagship", f"WITH {_FLAGSHIP_CTES} SELECT user_id, indicator_id, round(value, 6) AS value, tick AS timestamp FROM f")
def _(s, d):
    return rounded(indicators.compute(events(s, d), FLAGSHIP, ["user_id"], ties=["event_id"]), "value")


def observations(s: SparkSession, d: str) -> DataFrame:
    return indicators.annotate(indicators.compute(events(s, d), FLAGSHIP, ["user_id"], ties=["event_id"]), FLAGSHIP)


_OBS = f"""{_FLAGSHIP_CTES},
o AS (SELECT user_id, indicator_id, value, tick + INTERVAL 6 HOUR AS anchor_time, CASE indicator_id WHEN 'latest' THEN 'point' ELSE 'interval' END AS support_kind,
CASE indicator_id WHEN 'latest' THEN 'last' WHEN 'errors' THEN 'count' ELSE 'mean' END AS summary_operator, 'support_end' AS anchor_policy, '6h' AS observation_window, tick AS support_start, tick + INTERVAL 6 HOUR AS support_end FROM f)"""


@query("annotate", f"WITH {_OBS} SELECT * REPLACE (round(value, 6) AS value) FROM o")
def _(s, d):
    return rounded(observations(s, d), "value")


@query("prepare_panel", f"WITH {_OBS} SELECT * REPLACE (round(value, 6) AS value) FROM o")
def _(s, d):
    return rounded(indicators.prepare(events(s, d), FLAGSHIP, by=["user_id"], ties=["event_id"]), "value")


@query("extraction_rows", f"WITH {_FLAGSHIP_CTES} SELECT user_id, indicator_id, strftime(tick, '%Y-%m-%dT%H:%M:%S') AS timestamp, value IS NULL AS empty FROM f")
def _(s, d):
    return indicators.as_text(indicators.compute(events(s, d), FLAGSHIP, ["user_id"], ties=["event_id"])).select("user_id", "indicator_id", "timestamp", F.col("value").isNull().alias("empty"))


@query("recorded", "SELECT o_orderkey, 'price' AS indicator_id, o_totalprice AS value, o_orderdate::TIMESTAMP AS anchor_time, o_orderdate::TIMESTAMP AS support_start, o_orderdate + INTERVAL 30 DAY AS support_end FROM orders")
def _(s, d):
    raw = table(s, d, "orders").withColumn("until", F.col("o_orderdate") + F.expr("INTERVAL 30 DAY"))
    out = indicators.recorded(raw, [{"id": "price", "value": "o_totalprice", "anchor": "o_orderdate", "start": "o_orderdate", "end": "until"}], by=["o_orderkey"])
    return out


@query("time_origin", f"WITH {_OBS} SELECT min(least(anchor_time, support_start, support_end)) AS time_origin FROM o")
def _(s, d):
    return indicators.time_origin(observations(s, d))


# ---- encoding ----------------------------------------------------------------------


@query("encode_binary", "SELECT event_id, CASE WHEN event_id % 14 < 6 THEN 1.0 WHEN event_id % 14 < 12 THEN 0.0 END::DOUBLE AS a FROM events")
def _(s, d):
    said = F.array(*[F.lit(x) for x in ("TRUE", "Yes", "1", "1.0", "t", "Y", "False", "no", "0", "0.0", "F", "n", "maybe", "")])
    return table(s, d, "events").select("event_id", indicators.encode_binary(F.get(said, (F.col("event_id") % 14).cast("int"))).alias("a"))


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("encode_ordinal", "SELECT o_orderkey, (left(o_orderpriority, 1)::INT - 1)::DOUBLE AS code, CASE WHEN o_orderkey % 9 < 5 THEN (o_orderkey % 9)::DOUBLE END AS number FROM orders")
def _(s, d):
    """Labels in any case, and numbers of which those beyond the levels, and parts of one, are lost."""
    code = lambda c: indicators.encode_levels(c, PRIORITIES)
    k = F.col("o_orderkey") % 9
    number = F.when(k < 8, k.cast("double")).otherwise(F.lit(1.5)).cast("string")
    return table(s, d, "orders").select("o_orderkey", code(F.concat(F.lit(" "), F.lower("o_orderpriority"))).alias("code"), code(number).alias("number"))


@query("lossy_cast", "SELECT event_id, TRY_CAST(replace(event_type, 'view', '7') AS DOUBLE) AS value FROM events")
def _(s, d):
    return events(s, d).select("event_id", F.replace("event_type", F.lit("view"), F.lit("7")).try_cast("double").alias("value"))


# ---- quality ------------------------------------------------------------------------


def series(s: SparkSession, d: str) -> DataFrame:
    """Each event type as an indicator with daily windows."""
    day = DAY.floor(F.col("ts"))
    return table(s, d, "events").select(F.col("event_type").alias("indicator_id"), "value", F.col("ts").alias("anchor_time"), day.alias("support_start"), DAY.add(day).alias("support_end"), "user_id", "event_id")


_S = "s AS (SELECT event_type AS indicator_id, value, ts AS anchor_time, date_trunc('day', ts)::TIMESTAMP AS support_start, date_trunc('day', ts) + INTERVAL 1 DAY AS support_end, user_id, event_id FROM events)"


@query("profile_nearest", f"WITH {_S}, x AS (SELECT indicator_id, list(value ORDER BY value) AS l, count(value) AS n, avg(value) AS mean FROM s GROUP BY 1) SELECT indicator_id, n, l[1] AS min, l[round(0.25 * (n - 1))::INT + 1] AS q25, l[round(0.5 * (n - 1))::INT + 1] AS q50, l[round(0.75 * (n - 1))::INT + 1] AS q75, l[n] AS max, round(mean, 6) AS mean FROM x")
def _(s, d):
    return rounded(checks.empirical_profile(series(s, d)), "mean")


@query("iqr_outliers", f"WITH {_S}, x AS (SELECT indicator_id, list(value ORDER BY value) AS l, count(value) AS n FROM s GROUP BY 1), q AS (SELECT indicator_id, l[round(0.25 * (n - 1))::INT + 1] AS a, l[round(0.75 * (n - 1))::INT + 1] AS b FROM x) SELECT indicator_id, count(*) FILTER (value < a - 3 * (b - a) OR value > b + 3 * (b - a)) AS outliers FROM s JOIN q USING (indicator_id) GROUP BY 1")
def _(s, d):
    return checks.iqr_outliers(series(s, d))


DECLARED = [Variable("click"), Variable("error", "count", "count"), Variable("purchase"), Variable("signup"), Variable("weight")]


_KINDS = "(VALUES ('click', 'continuous'), ('error', 'count'), ('purchase', 'continuous'), ('signup', 'continuous'), ('weight', 'continuous')) AS k(indicator_id, dtype)"


@query(
    "findings",
    f"""WITH {_S}, x AS (SELECT *, value - lag(value) OVER (PARTITION BY indicator_id ORDER BY value) AS step, date_diff('second', lag(anchor_time) OVER w, anchor_time) AS gap, count(*) OVER (PARTITION BY indicator_id, value) AS same FROM s WINDOW w AS (PARTITION BY indicator_id ORDER BY anchor_time)),
t AS (SELECT indicator_id, count(*) AS n, var_samp(value) AS variance, max(same) / count(*)::DOUBLE AS share, median(date_diff('second', support_start, support_end)) / 3600.0 AS cadence, max(gap) / 3600.0 AS gap, date_diff('second', min(anchor_time), max(anchor_time)) / 3600.0 AS span, count(DISTINCT round(step, 9)) AS steps, min(step) AS least_step, list(value ORDER BY value) AS l, count(*) FILTER (anchor_time IS NULL) AS lost, count(*) FILTER (isnan(value) OR isinf(value)) AS odd FROM x GROUP BY 1),
q AS (SELECT *, l[round(0.25 * (n - 1))::INT + 1] AS a, l[round(0.75 * (n - 1))::INT + 1] AS b FROM t),
u AS (SELECT coalesce(q.indicator_id, k.indicator_id) AS id, dtype, q.* EXCLUDE (indicator_id, n), coalesce(n, 0) AS n,
CASE dtype WHEN 'continuous' THEN CASE WHEN n >= 10 AND b > a THEN len(list_filter(l, lambda v: v < a - 3 * (b - a) OR v > b + 3 * (b - a))) ELSE 0 END WHEN 'count' THEN len(list_filter(l, lambda v: v < 0 OR abs(v - round(v)) > 1e-6)) WHEN 'binary' THEN len(list_filter(l, lambda v: v NOT IN (0, 1))) ELSE 0 END AS broken FROM q FULL JOIN {_KINDS} ON q.indicator_id = k.indicator_id)
SELECT id AS indicator_id, unnest(['undeclared', 'missing', 'sample_size', 'timestamps', 'variance', 'dtype_violation', 'duplicate_values', 'arithmetic_sequence', 'coverage', 'timestamp_gap', 'nonfinite_values']) AS code,
unnest([CASE WHEN dtype IS NULL THEN 'failed' ELSE 'passed' END, CASE WHEN n = 0 THEN 'failed' ELSE 'passed' END, CASE WHEN n < 10 THEN 'failed' ELSE 'passed' END,
CASE WHEN n = 0 THEN 'not_evaluated' WHEN lost > 0.5 * n THEN 'failed' ELSE 'passed' END,
CASE WHEN n < 2 THEN 'not_evaluated' WHEN variance = 0 THEN 'failed' ELSE 'passed' END,
CASE WHEN n = 0 THEN 'not_evaluated' WHEN broken > 0 THEN 'failed' ELSE 'passed' END,
CASE WHEN n < 2 THEN 'not_evaluated' WHEN dtype NOT IN ('binary', 'count') AND variance > 0 AND share > 0.5 THEN 'failed' ELSE 'passed' END,
CASE WHEN n = 0 THEN 'not_evaluated' WHEN n >= 5 AND steps = 1 AND least_step <> 0 THEN 'failed' ELSE 'passed' END,
CASE WHEN n < 2 THEN 'not_evaluated' WHEN span < 10 * cadence THEN 'failed' ELSE 'passed' END,
CASE WHEN n < 3 THEN 'not_evaluated' WHEN gap > 5 * cadence THEN 'failed' ELSE 'passed' END,
CASE WHEN n = 0 THEN 'not_evaluated' WHEN odd > 0 THEN 'failed' ELSE 'passed' END]) AS outcome FROM u""",
)
def _(s, d):
    return checks.findings(series(s, d), DECLARED).select("indicator_id", "code", "outcome")


@query("no_data", "SELECT 'no_data' AS code, CASE WHEN count(*) = 0 THEN 'failed' ELSE 'passed' END AS outcome FROM events WHERE value < 0")
def _(s, d):
    return checks.no_data(table(s, d, "events").filter("value < 0"))


@query("mode", "WITH c AS (SELECT o_orderpriority AS indicator_id, floor(o_totalprice / 1000) AS value, count(*) AS n FROM orders GROUP BY ALL) SELECT indicator_id, arg_max(value, (n, -value)) AS value, max(n) AS n, round(max(n) / sum(n)::DOUBLE, 6) AS share FROM c GROUP BY 1")
def _(s, d):
    o = table(s, d, "orders").select(F.col("o_orderpriority").alias("indicator_id"), F.floor(F.col("o_totalprice") / 1000).cast("double").alias("value"))
    return rounded(checks.mode(o), "share")


#: Each rule is broken by rows of its own, told by event_id.
@query("validate_violations", """WITH x AS (SELECT event_id % 97 AS m, count(*) OVER (PARTITION BY event_type, CASE WHEN event_id % 97 <> 1 THEN CASE WHEN event_id % 97 = 2 THEN date_trunc('day', ts) ELSE ts END END) AS same FROM events)
SELECT count(*) FILTER (m = 1) AS anchor_null, count(*) FILTER (m IN (3, 4)) AS nonfinite_value, count(*) FILTER (same > 1) AS duplicate_anchor, count(*) FILTER (m = 5) AS support_half_null, count(*) FILTER (m IN (6)) AS support_order, count(*) FILTER (m = 7) AS support_empty, count(*) FILTER (m IN (2, 6, 8)) AS anchor_off_bound FROM x""")
def _(s, d):
    e, m = table(s, d, "events"), F.col("event_id") % 97
    hour = F.expr("INTERVAL 1 HOUR")
    end = F.when(m == 5, None).when(m == 6, F.col("ts") - hour - hour).when(m == 8, F.col("ts") + hour).otherwise(F.col("ts"))
    rows = e.select(
        F.col("event_type").alias("indicator_id"),
        F.when(m == 3, float("nan")).when(m == 4, float("inf")).otherwise(F.col("value")).alias("value"),
        F.when(m != 1, F.when(m == 2, DAY.floor(F.col("ts"))).otherwise(F.col("ts"))).alias("anchor_time"),
        F.when(m == 7, F.col("ts")).otherwise(F.col("ts") - hour).alias("support_start"),
        end.alias("support_end"),
        F.lit("interval").alias("support_kind"),
        F.lit("support_end").alias("anchor_policy"),
    )
    return checks.violations(rows)


@query("codebook_bounds", "SELECT count(*) FILTER (event_id % 11 > 7) + count(*) FILTER (event_id % 11 = 0) + count(*) FILTER (event_id % 11 = 5) AS code_range FROM events")
def _(s, d):
    """Codes -1 to 9 of 7 levels, and one that is no whole number."""
    k = F.col("event_id") % 11
    rows = series(s, d).withColumns({"value": F.when(k == 5, 2.5).otherwise((k - 1).cast("double")), "support_kind": F.lit("point"), "anchor_policy": F.lit("support_end"), "indicator_id": F.lit("q")})
    return checks.violations(rows, {"q": 7}).select("code_range")


@query("daily_corr", f"WITH {_S}, m AS (SELECT indicator_id, anchor_time::DATE AS day, avg(value) AS v FROM s GROUP BY ALL), b AS (SELECT a.indicator_id AS left_id, c.indicator_id AS right_id, a.v AS x, c.v AS y FROM m a JOIN m c ON a.day = c.day WHERE (a.indicator_id, c.indicator_id) IN (('click', 'view'), ('error', 'signup'))) SELECT left_id, right_id, count(*) AS days, round(corr(x, y), 6) AS r FROM b GROUP BY ALL")
def _(s, d):
    return rounded(checks.daily_correlation(series(s, d), [("click", "view"), ("error", "signup")]), "r")


@query("construct_correlations", f"""WITH {_S}, m AS (SELECT indicator_id, anchor_time::DATE AS day, avg(value) AS v FROM s GROUP BY ALL), c AS (SELECT a.indicator_id AS left_id, b.indicator_id AS right_id, corr(a.v, b.v) AS r, count(*) AS n FROM m a JOIN m b ON a.day = b.day AND a.indicator_id < b.indicator_id AND (a.indicator_id = 'view') = (b.indicator_id = 'view') GROUP BY ALL)
SELECT left_id, right_id, CASE WHEN n < 10 OR r IS NULL THEN 'not_evaluated' WHEN r < 0 THEN 'failed' ELSE 'passed' END AS outcome FROM c""")
def _(s, d):
    """All types but views measure one construct."""
    known = s.createDataFrame([(t, t if t == "view" else "acts", i) for i, t in enumerate(TYPES)], "indicator_id string, construct string, position int")
    return checks.correlation_findings(checks.daily_correlation(series(s, d), checks.same_construct_pairs(known)))


@query("modal_share", f"WITH {_S}, c AS (SELECT indicator_id, round(value) AS v, count(*) AS n FROM s GROUP BY ALL) SELECT indicator_id, round(max(n) / sum(n)::DOUBLE, 6) AS share FROM c GROUP BY 1")
def _(s, d):
    c = series(s, d).groupBy("indicator_id", F.round("value").alias("v")).agg(F.count("*").alias("n"))
    return c.groupBy("indicator_id").agg(r(F.max("n") / F.sum("n")).alias("share"))


@query("wording_conflicts", "SELECT doc_id, regexp_matches(lower(text), '\\b(total|cumulative|sum|number of|how many|count|last|most recent|current)\\b') AS conflict FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", checks.wording_conflict(F.col("text"), F.lit("mean")).alias("conflict"))


@query("completeness", "WITH t AS (SELECT DISTINCT user_id, date_trunc('day', ts)::TIMESTAMP AS timestamp FROM events), w AS (SELECT DISTINCT timestamp FROM t), p AS (SELECT DISTINCT date_trunc('day', ts)::TIMESTAMP AS timestamp, event_type AS indicator_id FROM events WHERE value > 150) SELECT w.timestamp, k AS indicator_id FROM w, unnest(['click', 'error', 'purchase', 'signup', 'view']) AS u(k) WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.timestamp = w.timestamp AND p.indicator_id = k)")
def _(s, d):
    e = events(s, d).withColumn("timestamp", DAY.floor(F.col("ts")))
    return checks.expected_pairs(e.select("timestamp").distinct(), TYPES, e.filter("value > 150").select("timestamp", F.col("event_type").alias("indicator_id")).distinct())


# ---- panel --------------------------------------------------------------------------

_WIDE = ", ".join(f"avg(value) FILTER (event_type = '{t}') AS {t}" for t in TYPES)
_H = "h AS (SELECT event_type, value, time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS anchor_time FROM events)"


def hourly(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select(F.col("event_type").alias("indicator_id"), "value", Duration.parse("1h").floor(F.col("ts")).alias("anchor_time"))


def wide(s: SparkSession, d: str) -> DataFrame:
    return panel.pivot(hourly(s, d), TYPES, ORIGIN)


_TIME = f"date_diff('microsecond', TIMESTAMP '{ORIGIN}', anchor_time) / 86400000000.0 AS time"


@query("pivot_wide", f"WITH {_H}, w AS (SELECT {_TIME}, {_WIDE} FROM h GROUP BY anchor_time) SELECT round(time, 6) AS time, {', '.join(f'round({t}, 6) AS {t}' for t in TYPES)} FROM w")
def _(s, d):
    return rounded(wide(s, d), "time", *TYPES)


@query("sparsity", f"WITH {_H}, w AS (SELECT {_WIDE} FROM h GROUP BY anchor_time), m AS (SELECT {', '.join(f'(count(*) - count({t})) / count(*)::DOUBLE AS {t}' for t in TYPES)} FROM w), u AS (UNPIVOT m ON {', '.join(TYPES)} INTO NAME indicator_id VALUE x) SELECT indicator_id, round(x, 6) AS missing_share FROM u UNION ALL SELECT 'overall', round(avg(x), 6) FROM u")
def _(s, d):
    return rounded(panel.sparsity(wide(s, d), TYPES), "missing_share")


@query("standardize", f"WITH {_H}, w AS (SELECT {_TIME}, {_WIDE} FROM h GROUP BY anchor_time) SELECT round(time, 6) AS time, {', '.join(f'round(({t} - avg({t}) OVER ()) / stddev_samp({t}) OVER (), 6) AS {t}' for t in TYPES)} FROM w")
def _(s, d):
    return rounded(panel.standardize(wide(s, d), TYPES), "time", *TYPES)


@query("augment_boundaries", f"WITH {_OBS}, anchors AS (SELECT DISTINCT anchor_time FROM o), bounds AS (SELECT support_start AS anchor_time FROM o WHERE support_kind = 'interval' UNION SELECT support_end FROM o WHERE support_kind = 'interval') SELECT anchor_time, false AS added FROM anchors UNION ALL SELECT anchor_time, true FROM bounds WHERE anchor_time NOT IN (SELECT anchor_time FROM anchors)")
def _(s, d):
    return panel.add_boundaries(observations(s, d))


@query("asof_level", "SELECT e.event_id, p.value AS level FROM (SELECT * FROM events WHERE event_type = 'view') e ASOF LEFT JOIN (SELECT user_id, ts, value FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts >= p.ts")
def _(s, d):
    e = table(s, d, "events")
    left = e.filter("event_type = 'view'").select("event_id", "user_id", "ts")
    right = e.filter("event_type = 'purchase'").select("user_id", "ts", F.col("value").alias("level"))
    return panel.asof(left, right, "ts", "level", ["user_id"]).select("event_id", "level")


@query("held_inputs", "SELECT user_id AS input, TIMESTAMP '2024-01-15' AS time, arg_max(value, ts) AS level FROM events WHERE ts <= TIMESTAMP '2024-01-15' GROUP BY 1 UNION ALL SELECT user_id, ts, value FROM events WHERE ts > TIMESTAMP '2024-01-15'")
def _(s, d):
    rows = table(s, d, "events").select(F.col("user_id").alias("input"), F.col("ts").alias("time"), F.col("value").alias("level"))
    return panel.held_inputs(rows, F.lit("2024-01-15").cast("timestamp_ntz"))


_OV = """w AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderdate::TIMESTAMP AS "start", o_orderdate + INTERVAL 45 DAY AS "end" FROM orders), g AS (SELECT o_orderkey AS j, o_custkey AS c, o_orderdate::TIMESTAMP AS "left", o_orderdate + INTERVAL 20 DAY AS "right", o_totalprice AS v FROM orders)"""


def _overlaps(s, d):
    o = table(s, d, "orders")
    after = lambda n: F.col("o_orderdate") + F.expr(f"INTERVAL {n} DAY")
    w = o.select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.col("o_orderdate").alias("start"), after(45).alias("end"))
    g = o.select(F.col("o_orderkey").alias("j"), F.col("o_custkey").alias("c"), F.col("o_orderdate").alias("left"), after(20).alias("right"), F.col("o_totalprice").alias("v"))
    return panel.overlap(w, g, 30 * 86400, ["c"])


@query("interval_overlap", f"""WITH {_OV} SELECT k, j, date_diff('second', greatest("start", "left"), least("end", "right")) AS overlap FROM w JOIN g ON w.c = g.c AND "left" < "end" AND "right" > "start" """)
def _(s, d):
    return _overlaps(s, d).select("k", "j", "overlap")


@query("interval_mean", f"""WITH {_OV}, x AS (SELECT k, v, date_diff('second', greatest("start", "left"), least("end", "right")) AS s FROM w JOIN g ON w.c = g.c AND "left" < "end" AND "right" > "start") SELECT k, round(sum(v * s) / sum(s), 4) AS mean FROM x GROUP BY k""")
def _(s, d):
    return _overlaps(s, d).groupBy("k").agg(r(F.sum(F.col("v") * F.col("overlap")) / F.sum("overlap"), 4).alias("mean"))


@query("full_outer_times", "SELECT coalesce(a.time, b.time) AS time, a.n, b.m FROM (SELECT date_trunc('day', ts)::TIMESTAMP AS time, count(*) AS n FROM events WHERE event_type = 'signup' AND value > 40 GROUP BY 1) a FULL JOIN (SELECT date_trunc('day', ts)::TIMESTAMP AS time, count(*) AS m FROM events WHERE event_type = 'error' AND value > 40 GROUP BY 1) b ON a.time = b.time")
def _(s, d):
    def side(kind, name):
        return table(s, d, "events").filter((F.col("event_type") == kind) & (F.col("value") > 40)).groupBy(DAY.floor(F.col("ts")).alias("time")).agg(F.count("*").alias(name))

    return panel.merge_times(side("signup", "n"), side("error", "m"))


@query("input_levels", "SELECT event_id, round(value / (1 + event_id % 5), 6) AS rate, value AS level FROM events")
def _(s, d):
    """Sums over one to five days count per day, other summaries as they are."""
    rows = series(s, d).withColumn("support_end", F.col("support_start") + F.make_dt_interval((1 + F.col("event_id") % 5).cast("int")))
    level = lambda op: panel.input_level(F.col("value"), F.col("support_start"), F.col("support_end"), F.lit(op))
    return rows.select("event_id", r(level("sum")).alias("rate"), level("mean").alias("level"))


@query("definition_match", "SELECT n_name AS indicator_id, CASE WHEN n_regionkey = 0 THEN 'missing' WHEN n_regionkey = 1 THEN 'mismatch' ELSE 'present' END AS status FROM nation")
def _(s, d):
    n = table(s, d, "nation").select(F.col("n_name").alias("indicator_id"), F.col("n_regionkey").alias("region"))
    return panel.select_defined(n, n.filter("region > 0").withColumn("region", F.when(F.col("region") == 1, 99).otherwise(F.col("region"))))


@query("support_violations", "SELECT event_type AS indicator_id, CASE WHEN event_type IN ('click', 'signup') THEN count(*) FILTER (value <= 0) WHEN event_type = 'error' THEN count(*) FILTER (abs(value - round(value)) > 1e-6) WHEN event_type = 'view' THEN count(*) FILTER (value NOT IN (0, 1)) ELSE count(*) FILTER (value <= 0 OR value >= 1) END AS violations FROM events GROUP BY event_type")
def _(s, d):
    return panel.support_violations(series(s, d), {"click": "gamma", "signup": "gamma", "error": "poisson", "view": "bernoulli", "purchase": "beta"})


# ---- comparison: each user is a draw, the hour of the month the anchor -----------------

_DR = "d0 AS (SELECT user_id AS draw, event_type AS indicator_id, date_trunc('day', ts)::TIMESTAMP AS anchor_time, avg(value) AS value FROM events GROUP BY ALL), ob AS (SELECT indicator_id, anchor_time, median(value) AS value FROM d0 GROUP BY ALL)"


def draws(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").groupBy(F.col("user_id").alias("draw"), F.col("event_type").alias("indicator_id"), DAY.floor(F.col("ts")).alias("anchor_time")).agg(F.avg("value").alias("value"))


def observed(s: SparkSession, d: str) -> DataFrame:
    return draws(s, d).groupBy("indicator_id", "anchor_time").agg(F.median("value").alias("value"))


@query("diff_points", f"WITH {_DR}, l AS (SELECT indicator_id, anchor_time, round(value, 1) AS v FROM ob WHERE anchor_time < TIMESTAMP '2024-01-20'), q AS (SELECT indicator_id, anchor_time, round(value) AS v FROM ob WHERE anchor_time >= TIMESTAMP '2024-01-10') SELECT indicator_id, anchor_time, CASE WHEN l.v IS NULL THEN 'added' WHEN q.v IS NULL THEN 'removed' ELSE 'revised' END AS change, l.v AS before, q.v AS after FROM l FULL JOIN q USING (indicator_id, anchor_time) WHERE l.v IS DISTINCT FROM q.v")
def _(s, d):
    o = observed(s, d)
    left = o.filter("anchor_time < TIMESTAMP_NTZ '2024-01-20 00:00:00'").withColumn("value", F.round("value", 1))
    return compare.point_changes(left, o.filter("anchor_time >= TIMESTAMP_NTZ '2024-01-10 00:00:00'").withColumn("value", F.round("value")))


@query("schedules", f"WITH {_DR}, x AS (SELECT draw, indicator_id, list(anchor_time ORDER BY anchor_time) AS l FROM d0 GROUP BY ALL) SELECT indicator_id, count(DISTINCT l) AS schedules FROM x GROUP BY 1")
def _(s, d):
    return compare.schedules(draws(s, d).withColumnsRenamed({"draw": "history"}).withColumns({"support_start": F.col("anchor_time"), "support_end": F.col("anchor_time")}))


@query("history_stats", f"WITH {_DR} SELECT draw, indicator_id, count(value) AS observed_count, count(*) - count(value) AS missing_count, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, round(min(value), 6) AS min, round(max(value), 6) AS max FROM d0 GROUP BY ALL")
def _(s, d):
    return rounded(compare.statistics(draws(s, d), ["draw", "indicator_id"]), "mean", "sd", "min", "max")


@query("level_proportions", "WITH l AS (SELECT o_custkey, left(o_orderpriority, 1)::INT - 1 AS v FROM orders) SELECT o_custkey, k::INT AS level, round(count(*) FILTER (v = k) / count(*)::DOUBLE, 6) AS proportion FROM l, range(0, 5) x(k) GROUP BY ALL")
def _(s, d):
    rows = table(s, d, "orders").select("o_custkey", indicators.encode_levels(F.col("o_orderpriority"), PRIORITIES).alias("value"))
    return rounded(compare.proportions(rows, ["o_custkey"], 5), "proportion")


@query("calibration", f"WITH {_DR}, b AS (SELECT indicator_id, anchor_time, quantile_cont(value, 0.025) AS lo, quantile_cont(value, 0.975) AS hi FROM d0 GROUP BY ALL), c AS (SELECT indicator_id, count(*) AS n, avg((value >= lo AND value <= hi)::INT) AS covered FROM ob JOIN b USING (indicator_id, anchor_time) GROUP BY 1) SELECT indicator_id, n, round(covered, 6) AS covered, CASE WHEN n < 2 THEN 'not_evaluated' WHEN covered < 0.7 OR covered > 0.98 THEN 'failed' ELSE 'passed' END AS outcome FROM c")
def _(s, d):
    return rounded(compare.calibration(observed(s, d), draws(s, d)), "covered")


@query("autocorr", f"WITH {_DR}, r AS (SELECT indicator_id, anchor_time, ob.value - m AS r FROM ob JOIN (SELECT indicator_id, anchor_time, avg(value) AS m FROM d0 GROUP BY ALL) USING (indicator_id, anchor_time)), c AS (SELECT indicator_id, anchor_time, r - avg(r) OVER (PARTITION BY indicator_id) AS c FROM r), x AS (SELECT *, lead(c) OVER (PARTITION BY indicator_id ORDER BY anchor_time) AS n FROM c) SELECT indicator_id, count(*) AS n, round(avg(c * x.n) / avg(c * c), 6) AS rho FROM x GROUP BY 1")
def _(s, d):
    return rounded(compare.autocorrelation(observed(s, d), draws(s, d)), "rho")


@query("sd_ratio", f"WITH {_DR}, a AS (SELECT indicator_id, avg(s) AS ds FROM (SELECT indicator_id, draw, stddev_pop(value) AS s FROM d0 GROUP BY ALL) GROUP BY 1) SELECT indicator_id, count(value) AS n, round(any_value(ds) / stddev_pop(value), 6) AS ratio FROM ob JOIN a USING (indicator_id) GROUP BY 1")
def _(s, d):
    return rounded(compare.sd_ratio(observed(s, d), draws(s, d)), "ratio")


@query("ppc_stats", f"WITH {_DR}, o4 AS (UNPIVOT (SELECT indicator_id, avg(value) AS mean, stddev_pop(value) AS sd, min(value) AS min, max(value) AS max FROM ob GROUP BY 1) ON mean, sd, min, max INTO NAME statistic VALUE observed), d4 AS (UNPIVOT (SELECT indicator_id, draw, avg(value) AS mean, stddev_pop(value) AS sd, min(value) AS min, max(value) AS max FROM d0 GROUP BY ALL) ON mean, sd, min, max INTO NAME statistic VALUE drawn) SELECT indicator_id, statistic, round(any_value(observed), 6) AS observed, round(avg((drawn >= observed)::INT), 6) AS p FROM d4 JOIN o4 USING (indicator_id, statistic) GROUP BY ALL")
def _(s, d):
    return rounded(compare.test_statistics(observed(s, d), draws(s, d)), "observed", "p")


@query("overlay", f"WITH {_DR} SELECT indicator_id, anchor_time, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.975), 6) AS high FROM d0 GROUP BY ALL")
def _(s, d):
    return rounded(compare.overlay(draws(s, d)), "median", "low", "high")


@query("support_match", f"WITH {_DR}, k AS (SELECT indicator_id, count(DISTINCT draw) AS n FROM d0 GROUP BY 1), c AS (SELECT indicator_id, anchor_time, count(*) AS m FROM d0 GROUP BY ALL) SELECT indicator_id, bool_and(m = n) AS matched FROM c JOIN k USING (indicator_id) GROUP BY 1")
def _(s, d):
    bounds = {"support_start": F.col("anchor_time"), "support_end": F.col("anchor_time")}
    return compare.support_match(observed(s, d).withColumns(bounds), draws(s, d).withColumns(bounds))


@query("histogram", "WITH b AS (SELECT event_type, min(value) AS lo, max(value) AS hi, least(25, ceil(sqrt(count(*))))::INT AS k FROM events GROUP BY 1) SELECT event_type, least(floor((value - lo) / ((hi - lo) / k))::BIGINT + 1, k)::BIGINT AS bin, count(*) AS count FROM events JOIN b USING (event_type) GROUP BY ALL")
def _(s, d):
    return compare.histogram(table(s, d, "events"), ["event_type"]).withColumn("bin", F.col("bin").cast("long"))


@query("ecdf", "WITH c AS (SELECT event_type, value, count(*) AS n FROM events GROUP BY ALL) SELECT event_type, value, round(sum(n) OVER (PARTITION BY event_type ORDER BY value) / sum(n) OVER (PARTITION BY event_type)::DOUBLE, 6) AS probability FROM c")
def _(s, d):
    return rounded(compare.ecdf(table(s, d, "events"), ["event_type"]), "probability")


@query("effect_summary", "SELECT event_type, round(avg(value - 40), 6) AS mean, round(quantile_cont(value - 40, 0.5), 6) AS median, round(quantile_cont(value - 40, 0.025), 6) AS low, round(quantile_cont(value - 40, 0.975), 6) AS high, round(avg((value - 40 > 0)::INT), 6) AS p_positive FROM events GROUP BY 1")
def _(s, d):
    return rounded(compare.effect_summary(table(s, d, "events").withColumn("value", F.col("value") - 40), ["event_type"]), "mean", "median", "low", "high", "p_positive")


@query("central_frame", "WITH b AS (SELECT event_type, date_trunc('day', ts) AS p, quantile_cont(value, 0.025) AS l, quantile_cont(value, 0.975) AS h FROM events GROUP BY ALL) SELECT event_type, round(min(l), 6) AS low, round(max(h), 6) AS high FROM b GROUP BY 1")
def _(s, d):
    return rounded(compare.central_frame(table(s, d, "events").withColumn("p", DAY.floor(F.col("ts"))), ["event_type"], "p"), "low", "high")


@query("paired_effects", f"WITH {_DR} SELECT a.draw, a.anchor_time, round(a.value - b.value, 6) AS value FROM d0 a JOIN d0 b ON a.draw = b.draw AND a.anchor_time = b.anchor_time WHERE a.indicator_id = 'click' AND b.indicator_id = 'view'")
def _(s, d):
    one = lambda k: draws(s, d).filter(F.col("indicator_id") == k).drop("indicator_id")
    return rounded(compare.paired_effects(one("click"), one("view"), ["draw", "anchor_time"]), "value")


@query("finite_runs", "WITH x AS (SELECT user_id, ts, CASE WHEN event_type <> 'error' THEN value END AS v FROM events), y AS (SELECT *, sum((v IS NULL)::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM x) SELECT user_id, run, min(ts) AS first, max(ts) AS last, count(*) AS n FROM y WHERE v IS NOT NULL GROUP BY ALL")
def _(s, d):
    return compare.finite_runs(table(s, d, "events").withColumn("value", F.when(F.col("event_type") != "error", F.col("value"))), ["user_id"], "ts")


@query("nearest_row", "SELECT user_id, arg_min(value, (abs(date_diff('microsecond', ts, TIMESTAMP '2024-01-15')), ts)) AS value FROM events GROUP BY 1")
def _(s, d):
    return compare.nearest(table(s, d, "events"), ["user_id"], "ts", F.lit("2024-01-15").cast("timestamp_ntz"))


@query("truncate_events", "WITH x AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events), z AS (SELECT DISTINCT user_id, n, k, floor(k * ((n - 20) / 10::DOUBLE))::BIGINT AS a, floor((k + 1) * ((n - 20) / 10::DOUBLE))::BIGINT AS b FROM x, range(0, 10) r(k) WHERE n > 30), c AS (SELECT user_id, 10 + CASE WHEN b <= a THEN a ELSE (a + b - 1) // 2 END AS i FROM z) SELECT event_id FROM x WHERE n <= 30 OR i < 10 OR i >= n - 10 UNION SELECT event_id FROM x JOIN c USING (user_id, i)")
def _(s, d):
    return compare.boundary_sample(table(s, d, "events"), ["user_id"], ["ts", "event_id"], 30).select("event_id")


# ---- posterior: nations serve as chains ---------------

_PO = "po AS (SELECT c_nationkey AS chain, o_orderpriority AS param, o_orderkey AS draw, o_totalprice AS value FROM orders JOIN customer ON o_custkey = c_custkey)"


def posterior_rows(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("chain"))
    return table(s, d, "orders").join(c, "o_custkey").select("chain", F.col("o_orderpriority").alias("param"), F.col("o_orderkey").alias("draw"), F.col("o_totalprice").alias("value"))


@query("hdi", f"WITH {_PO}, x AS (SELECT param, value, row_number() OVER (PARTITION BY param ORDER BY value) AS i, count(*) OVER (PARTITION BY param) AS n FROM po), b AS (SELECT a.param, a.value AS low, c.value AS high FROM x a JOIN x c ON a.param = c.param AND c.i = a.i + floor(0.94 * a.n)) SELECT param, arg_min(low, (round(high - low, 9), low)) AS low, arg_min(high, (round(high - low, 9), low)) AS high FROM b GROUP BY 1")
def _(s, d):
    return posterior.hdi(posterior_rows(s, d))


@query("rank_hist", f"WITH {_PO}, x AS (SELECT *, rank() OVER (PARTITION BY param ORDER BY value) + (count(*) OVER (PARTITION BY param, value) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY param) AS n FROM po) SELECT param, chain, len(list_filter(range(1, 20), lambda k: r >= 1 + k * n / 20.0)) + 1 AS bin, count(*) AS count FROM x GROUP BY ALL")
def _(s, d):
    return posterior.rank_histogram(posterior_rows(s, d)).withColumn("bin", F.col("bin").cast("long"))


@query("bfmi", f"WITH {_PO}, x AS (SELECT chain, value - lag(value) OVER (PARTITION BY chain ORDER BY draw) AS d, value - avg(value) OVER (PARTITION BY chain) AS c FROM po) SELECT chain, round(sum(d * d) / sum(c * c), 6) AS bfmi FROM x GROUP BY 1")
def _(s, d):
    return rounded(posterior.bfmi(posterior_rows(s, d)), "bfmi")


@query("rhat", f"WITH {_PO}, x AS (SELECT *, row_number() OVER (PARTITION BY param, chain ORDER BY draw) AS i, count(*) OVER (PARTITION BY param, chain) AS n FROM po), y AS (SELECT param, chain, value, CASE WHEN i <= n // 2 THEN 0 WHEN i > ceil(n / 2.0) THEN 1 END AS h FROM x), z AS (SELECT param, chain, h, avg(value) AS m, var_samp(value) AS v, count(*) AS k FROM y WHERE h IS NOT NULL GROUP BY ALL), t AS (SELECT param, avg(v) AS w, var_samp(m) AS b, avg(k) AS k FROM z GROUP BY 1) SELECT param, round(sqrt(((k - 1) / k * w + b) / w), 6) AS rhat FROM t")
def _(s, d):
    return rounded(posterior.rhat(posterior_rows(s, d)), "rhat")


@query("marginals", f"WITH {_PO} SELECT param, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS sd, count(*) AS n FROM po GROUP BY 1")
def _(s, d):
    out = posterior.marginals(posterior_rows(s, d))
    return out.withColumns({c: r(c, 4) for c in ("mean", "sd")})


@query("ess")
def _(s, d):
    return rounded(posterior.ess(posterior_rows(s, d)), "ess", "mcse")


@query("verdicts")
def _(s, d):
    found = posterior.rank_diagnostics(posterior_rows(s, d))
    return posterior.verdicts(found.withColumn("ess", F.least("ess_bulk", "ess_tail")), 25)


@query("rank_diagnostics")
def _(s, d):
    return rounded(posterior.rank_diagnostics(posterior_rows(s, d)), "rhat", "ess_bulk", "ess_tail")


def log_likelihoods(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select(F.crc32(F.col("event_type").cast("binary")).alias("point"), F.col("event_id").alias("draw"), (-F.col("value") / 50).alias("log_lik"))


@query("psis_loo")
def _(s, d):
    return rounded(posterior.psis_loo(log_likelihoods(s, d)), "elpd", "pareto_k")


@query("loo_totals")
def _(s, d):
    return rounded(posterior.loo_totals(log_likelihoods(s, d)), "elpd_loo", "p_loo", "se")


@query("weight_ess", "WITH w AS (SELECT event_type AS step, exp(-value / 20 - max(-value / 20) OVER (PARTITION BY event_type)) AS w FROM events), p AS (SELECT step, w / sum(w) OVER (PARTITION BY step) AS p FROM w) SELECT step, round(1 / sum(p * p), 4) AS ess, round(-sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END), 6) AS entropy FROM p GROUP BY 1")
def _(s, d):
    out = posterior.weight_ess(table(s, d, "events").select(F.col("event_type").alias("step"), (-F.col("value") / 20).alias("log_weight")))
    return out.withColumns({"ess": r("ess", 4), "entropy": r("entropy")})


_EN = "en AS (SELECT user_id AS draw, date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / 86400000000.0 AS time, value FROM events)"


def ensemble(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select(F.col("user_id").alias("draw"), model_days(F.col("ts"), F.lit(ORIGIN).cast("timestamp_ntz")).alias("time"), "value")


@query("screen_confinement", """WITH e AS (SELECT user_id AS draw, ts, CASE WHEN event_id % 1009 = 0 THEN 'nan'::DOUBLE WHEN event_id % 2003 = 0 THEN NULL ELSE value END AS v FROM events),
l AS (SELECT draw, list(v ORDER BY ts) AS v, list(date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / 86400000000.0 ORDER BY ts) AS t, count(*) AS n, count(*) // 4 AS q FROM e GROUP BY 1),
g AS (SELECT n, len(list_filter(v, lambda x: x IS NULL OR isnan(x))) AS bad, list_min(list_filter(list_transform(range(1, n + 1), lambda i: CASE WHEN v[i] IS NULL OR isnan(v[i]) THEN t[i] END), lambda x: x IS NOT NULL)) AS onset, list_max(list_transform(v[n - q + 1 :], lambda x: abs(x))) / (list_aggregate(list_transform(v[q + 1 : 2 * q], lambda x: abs(x)), 'quantile_cont', 0.95) + 1e-9) AS growth FROM l)
SELECT round(sum(bad) / sum(n)::DOUBLE, 6) AS nonfinite_share, round(avg((bad > 0 OR growth > 5)::INT), 6) AS escaped_share, round(median(onset), 6) AS onset FROM g""")
def _(s, d):
    broken = F.when(F.col("event_id") % 1009 == 0, float("nan")).when(F.col("event_id") % 2003 == 0, None).otherwise(F.col("value"))
    rows = table(s, d, "events").select(F.col("user_id").alias("draw"), model_days(F.col("ts"), F.lit(ORIGIN).cast("timestamp_ntz")).alias("time"), broken.alias("value"))
    return rounded(posterior.confinement(rows), "nonfinite_share", "escaped_share", "onset")


@query("screen_scale", f"WITH {_EN}, x AS (SELECT floor(time) AS time, value FROM en), m AS (SELECT median(time) AS mid FROM x), y AS (SELECT time, (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / 1.349 AS s FROM x, m WHERE time >= mid GROUP BY 1) SELECT round(median(s), 6) AS scale FROM y")
def _(s, d):
    return rounded(posterior.latent_scale(ensemble(s, d).withColumn("time", F.floor("time"))), "scale")


@query("screen_resolvability", "WITH t AS (SELECT value / 1000 AS tau FROM events), g AS (SELECT date_diff('microsecond', lag(ts) OVER (ORDER BY ts), ts) / 86400000000.0 AS gap FROM events), x AS (SELECT quantile_disc(gap, 0.5) AS mid, sum(gap) AS span FROM g) SELECT round(avg((mid <= 3 * tau AND span >= 4 * tau)::INT), 6) AS resolved_share FROM t, x")
def _(s, d):
    e = table(s, d, "events")
    # Gaps within days, and one across each day's end: no single window over all rows.
    day = e.groupBy(F.to_date("ts").alias("day")).agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    inner = e.select(F.timestamp_diff("MICROSECOND", F.lag("ts").over(Window.partitionBy(F.to_date("ts")).orderBy("ts")), F.col("ts")).alias("us"))
    outer = day.select(F.timestamp_diff("MICROSECOND", F.lag("hi").over(Window.orderBy("day")), F.col("lo")).alias("us"))
    gaps = inner.union(outer).filter("us IS NOT NULL").select((F.col("us") / 86_400_000_000.0).alias("gap"))
    return rounded(posterior.resolvability(e.select((F.col("value") / 1000).alias("tau")), gaps), "resolved_share")


@query("screen_saturation", f"WITH {_EN}, x AS (SELECT draw, CASE WHEN value > 0 THEN 1 / (1 + exp(-(1.0 + draw % 3) * (ln(value) - ln(20.0 + draw)))) ELSE 0 END AS o FROM en), y AS (SELECT draw, avg((o >= 0.1 AND o <= 0.9)::INT) AS s FROM x GROUP BY 1) SELECT round(avg((s >= 0.1)::INT), 6) AS active_share FROM y")
def _(s, d):
    rows = ensemble(s, d).withColumns({"ec50": (20 + F.col("draw")).cast("double"), "hill": (1 + F.col("draw") % 3).cast("double")})
    return rounded(posterior.saturation(rows), "active_share")


#: A third of the draws stands still, and so does the edge in every second one of these.
@query("screen_overwhelm", f"WITH {_EN}, p AS (SELECT draw, CASE WHEN draw % 3 = 0 THEN 5.0 ELSE value END AS x, CASE WHEN draw % 6 = 0 THEN 5.0 ELSE value * value / 100 END AS y FROM en), y AS (SELECT draw, quantile_cont(x - y, 0.75) - quantile_cont(x - y, 0.25) AS e, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS w FROM p GROUP BY 1) SELECT round(median(CASE WHEN w > 0 THEN e / w WHEN e > 0 THEN 'inf'::DOUBLE ELSE 0 END), 6) AS share FROM y")
def _(s, d):
    rows = ensemble(s, d)
    on = rows.withColumn("value", F.when(F.col("draw") % 3 == 0, 5.0).otherwise(F.col("value")))
    off = rows.withColumn("value", F.when(F.col("draw") % 6 == 0, 5.0).otherwise(F.col("value") * F.col("value") / 100))
    return rounded(posterior.edge_overwhelm(on, off), "share")


@query("screen_reach", f"WITH {_DR}, a AS (SELECT indicator_id, draw, quantile_cont(value, 0.5) AS l, (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / 1.349 AS s FROM d0 GROUP BY ALL), e AS (SELECT indicator_id, quantile_cont(l, 0.01) AS l1, quantile_cont(l, 0.99) AS l2, quantile_cont(s, 0.01) AS s1, quantile_cont(s, 0.99) AS s2 FROM a GROUP BY 1), o AS (SELECT indicator_id, quantile_cont(value, 0.5) AS l, (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / 1.349 AS s FROM ob GROUP BY 1) SELECT indicator_id, CASE WHEN l < l1 THEN 'below' WHEN l > l2 THEN 'above' ELSE 'inside' END AS location, CASE WHEN s < s1 THEN 'below' WHEN s > s2 THEN 'above' ELSE 'inside' END AS scale FROM o JOIN e USING (indicator_id)")
def _(s, d):
    return posterior.reach(observed(s, d), draws(s, d))


@query("screen_transmission", f"WITH {_DR}, y AS (SELECT indicator_id, draw, var_pop(value) AS v, avg(value * 2) AS c FROM d0 GROUP BY ALL) SELECT indicator_id, round(median(v / nullif(v + c, 0)), 6) AS share FROM y GROUP BY 1")
def _(s, d):
    rows = draws(s, d).select("indicator_id", "draw", F.col("anchor_time").alias("time"), F.col("value").alias("signal"), (F.col("value") * 2).alias("variance"))
    return rounded(posterior.transmission(rows), "share")


# ---- graphs, documents, lineage ------------------------------------------------------------

#: Nations serve as constructs: each has edges to two others, which makes cycles.
_G = """nodes AS (SELECT 'n' || n_nationkey AS node, n_regionkey <> 1 AS varying FROM nation),
edges AS (SELECT 'n' || n_nationkey AS cause, 'n' || ((n_nationkey * 7 + 4) % 25) AS effect, n_regionkey = 0 AS lagged FROM nation WHERE n_nationkey % 4 <> 0 UNION ALL SELECT 'n' || n_nationkey, 'n' || ((n_nationkey * 2 + 1) % 25), false FROM nation WHERE n_nationkey % 3 <> 0 AND n_nationkey <> 24),
seen AS (SELECT 'n' || n_nationkey AS node FROM nation WHERE n_regionkey <> 2)"""


def graph(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    n, k = table(s, d, "nation"), F.col("n_nationkey")
    name = lambda c: F.concat(F.lit("n"), c.cast("string"))
    one = n.filter(k % 4 != 0).select(name(k).alias("cause"), name((k * 7 + 4) % 25).alias("effect"), (F.col("n_regionkey") == 0).alias("lagged"))
    two = n.filter((k % 3 != 0) & (k != 24)).select(name(k).alias("cause"), name((k * 2 + 1) % 25).alias("effect"), F.lit(False).alias("lagged"))
    return n.select(name(k).alias("node"), (F.col("n_regionkey") != 1).alias("varying")), one.union(two), n.filter("n_regionkey <> 2").select(name(k).alias("node"))


def _up(name: str, start: str, edges: str = "edges") -> str:
    """A recursive CTE of all strict ancestors of start."""
    return f"{name} AS (SELECT cause AS node FROM {edges} WHERE effect = '{start}' UNION SELECT e.cause FROM {edges} e JOIN {name} ON e.effect = {name}.node)"


@query("ancestors", f"WITH RECURSIVE {_G}, {_up('up', 'n10')} SELECT node FROM up WHERE node <> 'n10'")
def _(s, d):
    return graphs.ancestors(graph(s, d)[1], "n10")


@query("unroll", f"WITH {_G} SELECT cause, t AS cause_slice, effect, t AS effect_slice FROM edges, (VALUES (0), (1)) x(t) WHERE NOT lagged UNION ALL SELECT cause, 0, effect, 1 FROM edges WHERE lagged UNION ALL SELECT node, 0, node, 1 FROM nodes WHERE varying")
def _(s, d):
    nodes, edges, _seen = graph(s, d)
    return graphs.unrolled(nodes, edges)


@query("confounders", f"WITH {_G} SELECT cause AS node, count(DISTINCT effect) AS children FROM edges WHERE cause NOT IN (SELECT node FROM seen) AND effect IN (SELECT node FROM seen) GROUP BY 1 HAVING count(DISTINCT effect) >= 2")
def _(s, d):
    return graphs.latent_confounders(graph(s, d)[1], graph(s, d)[2])


@query("blocking_confounders", f"""WITH RECURSIVE {_G}, past AS (SELECT * FROM edges WHERE 'n3' NOT IN (cause, effect)), {_up('before', 'n3')}, {_up('other', 'n10', 'past')}
SELECT node FROM nodes WHERE node IN (SELECT node FROM before) AND node IN (SELECT node FROM other) AND node NOT IN (SELECT node FROM seen) AND node IN (SELECT cause FROM edges WHERE effect IN (SELECT node FROM seen)) AND node NOT IN ('n3', 'n10')""")
def _(s, d):
    _nodes, edges, seen = graph(s, d)
    return graphs.blocking_confounders(edges, seen, "n3", "n10")


#: Edges from lower to higher nations only: without cycles.
_DAG = "dag AS (SELECT cause, effect FROM edges WHERE substr(cause, 2)::INT < substr(effect, 2)::INT)"


@query("instruments", f"""WITH RECURSIVE {_G}, {_DAG}, cut AS (SELECT * FROM dag WHERE effect <> 'n17'), {_up('up', 'n23', 'cut')}, down AS (SELECT node FROM up UNION SELECT c.effect FROM cut c JOIN down ON c.cause = down.node)
SELECT DISTINCT cause AS node FROM dag WHERE effect = 'n17' AND cause IN (SELECT node FROM seen) AND cause NOT IN (SELECT node FROM down)""")
def _(s, d):
    _nodes, edges, seen = graph(s, d)
    dag = edges.filter("int(substr(cause, 2)) < int(substr(effect, 2))")
    return graphs.instruments(dag, seen, "n17", "n23")


@query("prune_edges", f"WITH RECURSIVE {_G}, {_up('up', 'n10')}, kept AS (SELECT node FROM up UNION SELECT 'n10') SELECT cause, effect FROM edges WHERE cause IN (FROM kept) AND effect IN (FROM kept)")
def _(s, d):
    nodes, edges, _seen = graph(s, d)
    return graphs.pruned(nodes, edges, "n10")


@query("induced_dependencies", f"WITH {_G}, roots AS (SELECT node FROM nodes WHERE node NOT IN (FROM seen) AND node NOT IN (SELECT effect FROM edges)) SELECT DISTINCT a.effect AS \"left\", b.effect AS \"right\" FROM edges a JOIN edges b ON a.cause = b.cause AND a.effect < b.effect WHERE a.cause IN (FROM roots)")
def _(s, d):
    nodes, edges, seen = graph(s, d)
    return graphs.induced_dependencies(edges, nodes.join(seen, "node", "left_anti").select("node"))


@query("reference_indicators", "SELECT n_regionkey AS node, (list(n_name ORDER BY CASE n_nationkey % 5 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 2 WHEN 3 THEN 1 ELSE 0 END, n_nationkey % 2, n_nationkey))[1] AS indicator FROM nation WHERE n_nationkey % 7 <> 4 GROUP BY 1")
def _(s, d):
    kinds = F.array(*[F.lit(x) for x in ("categorical", "binary", "count", "ordinal", "continuous")])
    n = table(s, d, "nation").filter("n_nationkey % 7 <> 4")
    return graphs.reference_indicators(n.select(F.col("n_regionkey").alias("node"), F.col("n_name").alias("indicator"), F.get(kinds, (F.col("n_nationkey") % 5).cast("int")).alias("dtype"), (F.col("n_nationkey") % 2 == 0).alias("positive"), F.col("n_nationkey").alias("position")))


@query("staleness", "SELECT 'n' || n_nationkey AS node FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 's' || s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1")
def _(s, d):
    n = table(s, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("artifact"), F.concat(F.lit("r"), "n_regionkey").alias("source"))
    p = table(s, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("artifact"), F.concat(F.lit("n"), "s_nationkey").alias("source"))
    return graphs.stale(n.union(p), s.createDataFrame([("r1",)], "node string"))


@query("dependencies", "WITH f AS (SELECT l_partkey AS revision, min(l_orderkey) AS source FROM lineitem GROUP BY 1) SELECT DISTINCT l_orderkey AS seq, source FROM lineitem JOIN f ON l_partkey = revision WHERE source < l_orderkey")
def _(s, d):
    rows = table(s, d, "lineitem").select(F.col("l_orderkey").alias("seq"), F.col("l_partkey").alias("revision"))
    return graphs.dependencies(rows, rows)


@query("latest_records", "SELECT o_custkey, max(o_orderkey) AS seq, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1")
def _(s, d):
    return graphs.latest(table(s, d, "orders").select("o_custkey", F.col("o_orderkey").alias("seq"), "o_totalprice"), "o_custkey")


@query("cache_evict", "WITH f AS (SELECT 'r' || r_regionkey || '-' || n_nationkey AS path, TIMESTAMP '2024-01-01' + to_days(n_nationkey::INT) AS modified, 100 + n_nationkey AS size FROM nation JOIN region ON n_regionkey = r_regionkey), y AS (SELECT *, sum(size) OVER (ORDER BY modified DESC, path DESC) AS total FROM f WHERE modified >= TIMESTAMP '2024-01-06') SELECT path, 'age' AS reason FROM f WHERE modified < TIMESTAMP '2024-01-06' UNION ALL SELECT path, 'size' FROM y WHERE total > 1000")
def _(s, d):
    n = table(s, d, "nation")
    files = n.select(F.concat_ws("-", F.concat(F.lit("r"), "n_regionkey"), "n_nationkey").alias("path"), (F.lit(ORIGIN).cast("timestamp_ntz") + F.make_dt_interval(F.col("n_nationkey").cast("int"))).alias("modified"), (F.col("n_nationkey") + 100).alias("size"))
    return graphs.evicted(files, F.lit("2024-01-06").cast("timestamp_ntz"), 1000)


@query("doc_diff", "SELECT 'p' || p_partkey AS path, p_brand AS before, CASE WHEN p_size > 40 THEN NULL ELSE 'new' END AS after FROM part WHERE p_size > 30")
def _(s, d):
    p = table(s, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("path"), F.col("p_brand").alias("value"), "p_size")
    after = p.filter("p_size <= 40").withColumn("value", F.when(F.col("p_size") > 30, "new").otherwise(F.col("value")))
    return graphs.document_changes(p, after)


# ---- text, filters, simulation, streaming -----------------------------------------------------


@query(
    "window_text",
    """WITH e AS (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS tick, ts, event_id, strftime(ts, '%H:%M') || '  ' || event_type || ', ' || event_id AS line FROM events),
g AS (SELECT unnest(generate_series(min(tick), max(tick), INTERVAL 6 HOUR)) AS tick FROM e), x AS (SELECT *, row_number() OVER (PARTITION BY tick ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY tick) AS n FROM e),
z AS (SELECT DISTINCT tick, floor(k * ((n - 20) / 20::DOUBLE))::BIGINT AS a, floor((k + 1) * ((n - 20) / 20::DOUBLE))::BIGINT AS b FROM x, range(0, 20) r(k) WHERE n > 40), c AS (SELECT tick, 10 + CASE WHEN b <= a THEN a ELSE (a + b - 1) // 2 END AS i FROM z),
s AS (SELECT * FROM x WHERE n <= 40 OR i < 10 OR i >= n - 10 OR (tick, i) IN (SELECT tick, i FROM c)),
t AS (SELECT tick, any_value(n) AS n, '## Window Start: ' || strftime(tick, '%Y-%m-%dT%H:%M:%S') || chr(10) || chr(10) || CASE WHEN any_value(n) > 40 THEN '(showing 40 of ' || any_value(n) || ' events, sampled)' || chr(10) ELSE '' END || string_agg(line, chr(10) ORDER BY ts, event_id::VARCHAR) AS text FROM s GROUP BY tick)
SELECT tick, coalesce(n, 0) AS n, text FROM g LEFT JOIN t USING (tick)""",
)
def _(s, d):
    return text.window_text(events(s, d), ["event_type", "event_id"], "6h", most=40, ties=["event_id"])


@query("semantic_scores", "WITH e AS (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS tick, event_type FROM events), g AS (SELECT unnest(generate_series(min(tick), max(tick), INTERVAL 6 HOUR)) AS tick FROM e), a AS (SELECT tick, count(*) FILTER (event_type = 'error') AS n FROM e GROUP BY 1) SELECT 'errors' AS indicator_id, n::DOUBLE AS value, tick AS timestamp FROM g LEFT JOIN a USING (tick)")
def _(s, d):
    return text.score_pieces(events(s, d), ["event_type"], "6h", lambda t: t.str.count(r"  error(?=\n|$)").astype("float64"), "errors", ties=["event_id"])


@query("row_filter", "SELECT n_nationkey FROM nation WHERE contains(lower(n_name), '1')  OR contains(n_nationkey::VARCHAR, '1') OR contains(n_regionkey::VARCHAR, '1')")
def _(s, d):
    return text.row_filter(table(s, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), "1").select("n_nationkey")


@query("simulate")
def _(s, d):
    return simulate.simulate(s, 50, 200, shift=0.5)


@query("stream_tumbling", "SELECT date_trunc('day', ts)::TIMESTAMP AS start, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def _(s, d):
    import uuid

    from tideline.plans.session import shared_folder
    from tideline.streaming import progress

    schema = table(s, d, "events").schema
    stream = s.readStream.schema(schema).parquet(f"{d}/events*.parquet").withColumn("at", F.col("ts").cast("timestamp"))
    out = progress.run_once(progress.windowed(stream, "at", "value", "1 day"), f"{shared_folder(s)}/tumbling-{uuid.uuid4().hex}")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "n", r("mean").alias("mean"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
