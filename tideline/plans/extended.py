"""Queries of validation, preflight, histories, laws, sources and events, with their
oracles. Importing this module registers them in the catalog."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline import actions
from tideline.functions import laws
from tideline.functions.durations import Duration, as_utc, model_days, strip_zone
from tideline.operators import compare, graphs, histories, identification, indicators, panel, posterior, preflight, validation
from tideline.plans.catalog import _DR, _EN, _G, _H, _OBS, _OV, _PO, _S, _WIDE, DAY, FLAGSHIP, ORIGIN, TYPES, draws, ensemble, events, graph, hourly, observations, observed, posterior_rows, query, r, rounded, series, wide
from tideline.plans.session import shared_folder, table
from tideline.schema import Variable
from tideline.sources import readers
from tideline.streaming import progress

_DAYS = "date_diff('microsecond', TIMESTAMP '2024-01-01', {}) / 86400000000.0"


def origin():
    return F.lit(ORIGIN).cast("timestamp_ntz")


def scratch(s: SparkSession, label: str) -> str:
    return f"{shared_folder(s)}/{label}-{uuid.uuid4().hex}"


# ---- validation ----------------------------------------------------------------------

_CHECKED = [Variable("click", aggregation="sum"), Variable("error", "count", "count"), Variable("purchase", "binary", "last"), Variable("signup", "ordinal", "first", levels=("a", "b", "c"))]


@query(
    "validate_rows",
    """WITH e AS (SELECT event_id % 89 AS m, event_type AS t, ts, date_trunc('day', ts)::TIMESTAMP AS d, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events),
x AS (SELECT *, CASE WHEN m = 1 THEN 'nan'::DOUBLE WHEN m = 2 THEN -1.5 WHEN m = 3 THEN NULL ELSE 1 END AS v, CASE WHEN m = 9 THEN 12 ELSE i END AS a FROM e),
y AS (SELECT *, count(*) OVER (PARTITION BY t, CASE WHEN m <> 4 THEN a END) AS twins FROM x),
z AS (SELECT t AS indicator_id, unnest([
CASE WHEN t = 'view' THEN 'unknown_indicator' END,
CASE WHEN t <> 'view' AND m = 4 THEN 'anchor_null' END, CASE WHEN t <> 'view' AND m = 1 THEN 'nonfinite_value' END, CASE WHEN t <> 'view' AND twins > 1 THEN 'duplicate_anchor' END,
CASE WHEN t <> 'view' AND m = 5 THEN 'other_window' END, CASE WHEN t <> 'view' AND m = 6 THEN 'support_half_null' END, CASE WHEN t <> 'view' AND m = 6 THEN 'support_missing' END,
CASE WHEN t <> 'view' AND m = 7 THEN 'support_order' END, CASE WHEN t IN ('click', 'error') AND m = 8 THEN 'support_empty' END,
CASE WHEN t <> 'view' AND m <> 4 AND ((m IN (7, 8) AND t <> 'signup') OR (m = 9 AND i <> 12)) THEN 'anchor_off_bound' END,
CASE WHEN t = 'purchase' AND m IN (1, 2) THEN 'binary_range' END, CASE WHEN t = 'error' AND m IN (1, 2) THEN 'count_range' END, CASE WHEN t = 'signup' AND m IN (1, 2) THEN 'code_range' END,
CASE WHEN t <> 'view' AND m = 10 THEN 'other_support_kind' END, CASE WHEN t <> 'view' AND m = 11 THEN 'other_summary_operator' END, CASE WHEN t <> 'view' AND m = 12 THEN 'other_anchor_policy' END]) AS code FROM y)
SELECT indicator_id, code, count(*) AS rows FROM z WHERE code IS NOT NULL GROUP BY ALL""",
)
def _(s, d):
    """Rows that break one rule each, told by event_id; anchors are made distinct first."""
    m = F.col("event_id") % 89
    e = table(s, d, "events").withColumn("i", F.row_number().over(Window.partitionBy("event_type").orderBy("ts", "event_id")))
    hour = lambda n: F.make_dt_interval(hours=F.lit(n))
    own = origin() + F.make_dt_interval(hours=F.col("i"))
    spec = {v.id: v for v in _CHECKED}
    field = lambda f: F.create_map(*[F.lit(x) for k, v in spec.items() for x in (k, getattr(v, f))])[F.col("event_type")]
    starts = F.col("event_type") == "signup"
    rows = e.select(
        F.col("event_type").alias("indicator_id"),
        F.when(m == 1, float("nan")).when(m == 2, -1.5).when(m == 3, None).otherwise(1.0).alias("value"),
        F.when(m != 4, F.when(m == 9, origin() + hour(12)).otherwise(own)).alias("anchor_time"),
        F.when(m == 10, "other").otherwise(field("support_kind")).alias("support_kind"),
        F.when(m == 11, "other").otherwise(field("aggregation")).alias("summary_operator"),
        F.when(m == 12, "other").otherwise(field("anchor_policy")).alias("anchor_policy"),
        F.when(m == 5, "2d").otherwise("1d").alias("observation_window"),
        F.when(m == 6, None).when(starts, own).otherwise(own - hour(24)).alias("support_start"),
        F.when(m == 7, own - hour(30)).when(m == 8, F.when(starts, own).otherwise(own - hour(24))).when(starts, own + hour(24)).otherwise(own).alias("support_end"),
    )
    return validation.violation_counts(rows, _CHECKED)


_ASKED = [Variable("click", "count", "sum"), Variable("error", "binary", "last"), Variable("purchase", "categorical", "last", levels=("Low", "High")), Variable("signup", "ordinal", "first", levels=("a", "b", "c"))]


@query(
    "worker_output",
    """WITH e AS (SELECT user_id AS worker, event_id AS place, event_id % 12 AS m, CASE WHEN event_id % 53 = 0 THEN NULL ELSE strftime(ts, '%Y-%m-%d') END AS window_start, event_type AS id, (event_id % 53 <> 0) AND day(ts) <> 7 AS given FROM events),
x AS (SELECT *, CASE WHEN given AND id <> 'view' THEN place END AS p FROM e), y AS (SELECT *, p > min(p) OVER (PARTITION BY worker, window_start, id) AS again FROM x),
z AS (SELECT worker, window_start, id AS indicator_id, CASE WHEN window_start IS NULL THEN 'malformed' WHEN NOT given THEN 'unexpected_window' WHEN id = 'view' THEN 'unknown_indicator' WHEN again THEN 'duplicate'
WHEN m = 0 THEN NULL WHEN id = 'click' THEN CASE WHEN m IN (1, 2) THEN NULL ELSE 'dtype' END WHEN id = 'error' THEN CASE WHEN m = 1 OR m = 5 THEN NULL ELSE 'dtype' END
WHEN id = 'signup' THEN CASE WHEN m = 1 THEN NULL WHEN m IN (2, 3) THEN 'outside_codebook' ELSE 'dtype' END
ELSE CASE WHEN m IN (1, 2, 3, 4, 5) THEN 'dtype' WHEN m IN (6, 7) THEN NULL ELSE 'outside_codebook' END END AS error FROM y),
a AS (SELECT DISTINCT user_id AS worker, strftime(ts, '%Y-%m-%d') AS window_start FROM events WHERE day(ts) <> 7), q AS (SELECT worker, window_start, unnest(['click', 'error', 'purchase', 'signup']) AS indicator_id FROM a)
SELECT * FROM z WHERE error IS NOT NULL UNION ALL SELECT worker, window_start, indicator_id, 'missing' FROM q ANTI JOIN (SELECT * FROM z WHERE coalesce(error, '') NOT IN ('malformed', 'unexpected_window', 'unknown_indicator')) USING (worker, window_start, indicator_id)""",
)
def _(s, d):
    said = F.array(*[F.lit(x) for x in (None, "1", "7", "-1", "2.5", "true", "low", " HIGH ", "none", "x y", "nothing", "ja")])
    e = table(s, d, "events")
    day = F.date_format("ts", "yyyy-MM-dd")
    answers = e.select(F.col("user_id").alias("worker"), F.col("event_id").alias("place"), F.when(F.col("event_id") % 53 != 0, day).alias("window_start"), F.col("event_type").alias("indicator_id"), F.get(said, (F.col("event_id") % 12).cast("int")).alias("value"))
    starts = e.filter("day(ts) <> 7").select(F.col("user_id").alias("worker"), day.alias("window_start"))
    return validation.answer_errors(answers, _ASKED, starts)


@query("worker_documents", "SELECT o_custkey AS worker, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INT AS place, strftime(o_orderdate, '%Y-%m-%d') AS window_start, o_orderpriority AS indicator_id, o_orderkey::VARCHAR AS value FROM orders")
def _(s, d):
    """One JSON document per customer, taken apart again."""
    entry = F.struct("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("window_start"), F.col("o_orderpriority").alias("indicator_id"), F.col("o_orderkey").alias("value"))
    lists = table(s, d, "orders").groupBy(F.col("o_custkey").alias("worker")).agg(F.sort_array(F.collect_list(entry)).alias("extractions"))
    return validation.answers_of(lists.select("worker", F.to_json(F.struct("extractions")).alias("answer")))


@query("lossy_counts", "SELECT CASE o_orderkey % 3 WHEN 0 THEN 'level' WHEN 1 THEN 'flag' ELSE 'number' END AS indicator_id, count(*) FILTER (CASE o_orderkey % 3 WHEN 0 THEN o_orderkey % 5 = 4 WHEN 1 THEN o_orderkey % 5 > 1 ELSE o_orderkey % 5 = 4 END) AS lost FROM orders GROUP BY 1")
def _(s, d):
    k = F.col("o_orderkey")
    value = F.when(k % 5 == 4, "odd").otherwise((k % 5).cast("string"))
    name = F.when(k % 3 == 0, "level").when(k % 3 == 1, "flag").otherwise("number")
    rows = table(s, d, "orders").select(name.alias("indicator_id"), value.alias("value"))
    return indicators.lossy_counts(rows, [Variable("level", "ordinal", "last", levels=("a", "b", "c", "d")), Variable("flag", "binary", "last"), Variable("number")])


@query("time_origin_from", f"WITH {_OBS} SELECT least(min(least(anchor_time, support_start, support_end)), TIMESTAMP '2023-12-24') AS time_origin FROM o")
def _(s, d):
    return indicators.time_origin(observations(s, d), "2023-12-24")


# ---- preflight ------------------------------------------------------------------------


@query("question_windows", f"WITH {_S}, p AS (SELECT max(support_end) AS e, min(anchor_time) AS o FROM s), q AS (SELECT n_name AS question, TIMESTAMP '2023-12-28' + to_days(2 * n_nationkey::INT) AS a, 86400 * (n_regionkey + 1) AS secs FROM nation) SELECT question, CASE WHEN a < o THEN 'failed' ELSE 'passed' END AS outcome, CASE WHEN a < o THEN 'before' WHEN a + to_seconds(secs) <= e THEN 'inside' WHEN a <= e THEN 'past_end' ELSE 'after' END AS place FROM q, p")
def _(s, d):
    start = F.expr("TIMESTAMP_NTZ '2023-12-28 00:00:00'") + F.make_dt_interval((2 * F.col("n_nationkey")).cast("int"))
    q = table(s, d, "nation").select(F.col("n_name").alias("question"), start.alias("start"), (86400 * (F.col("n_regionkey") + 1)).alias("seconds"))
    return preflight.question_windows(q, series(s, d), F.col("anchor_time"))


@query(
    "intervention_ranges",
    f"""WITH {_S}, l AS (SELECT indicator_id, min(value) AS low, max(value) AS high FROM s WHERE indicator_id IN ('click', 'view') GROUP BY 1),
e AS (SELECT n_regionkey AS question, ['click', 'view', 'error', 'lost', 'none'][n_nationkey % 5 + 1] AS target, n_nationkey * 12.5 AS value FROM nation)
SELECT question, target, CASE WHEN target IN ('error', 'none') THEN 'not_evaluated' WHEN any_value(low) IS NULL OR bool_or(value > high OR value < low) THEN 'failed' ELSE 'passed' END AS outcome, round(any_value(low), 6) AS low, round(any_value(high), 6) AS high, count(DISTINCT value) FILTER (value > high OR value < low) AS outside FROM e LEFT JOIN l ON target = indicator_id GROUP BY question, target""",
)
def _(s, d):
    events_ = table(s, d, "nation").select(F.col("n_regionkey").alias("question"), F.get(F.array(*[F.lit(x) for x in ("click", "view", "error", "lost", "none")]), (F.col("n_nationkey") % 5).cast("int")).alias("target"), (F.col("n_nationkey") * 12.5).alias("value"))
    targets = s.createDataFrame([("click", "exogenous", "click"), ("view", "exogenous", "view"), ("error", "endogenous", "error"), ("lost", "exogenous", "nothing")], "target string, role string, indicator_id string")
    out = preflight.intervention_ranges(events_, targets, series(s, d).withColumn("summary_operator", F.lit("mean")))
    return rounded(out, "low", "high").withColumn("outside", F.size("outside").cast("long"))


@query("prior_reach", f"WITH {_S}, p(indicator_id, mu, sigma) AS (VALUES ('click', 0.0, 5.0), ('view', 45.0, 1.0), ('error', 10.0, 0.0)) SELECT indicator_id, round(abs(avg(value) - any_value(mu)) / any_value(sigma), 6) AS z, CASE WHEN abs(avg(value) - any_value(mu)) / any_value(sigma) > 6 THEN 'failed' ELSE 'passed' END AS outcome FROM s JOIN p USING (indicator_id) WHERE sigma > 0 GROUP BY 1")
def _(s, d):
    priors = s.createDataFrame([("click", 0.0, 5.0), ("view", 45.0, 1.0), ("error", 10.0, 0.0)], "indicator_id string, mu double, sigma double")
    return rounded(preflight.prior_reach(series(s, d), priors), "z")


_CUST = "SELECT o_custkey AS construct, o_orderdate::TIMESTAMP AS time, (o_custkey % 4 + CASE WHEN o_custkey % 7 = 0 THEN o_orderkey % 2 ELSE 0 END)::DOUBLE AS value FROM orders"


@query(
    "exact_conflicts",
    f"""WITH x AS ({_CUST}), f AS (SELECT min(time) AS first FROM x), c AS (SELECT c_custkey AS construct, c_custkey % 3 <> 0 AS static, (c_custkey % 5)::DOUBLE AS initial FROM customer),
y AS (SELECT construct, any_value(static) AS static, count(DISTINCT value) AS n, bool_or((static OR time = first) AND value <> initial) AS off FROM x JOIN c USING (construct), f GROUP BY 1)
SELECT construct, 'conflicting_exact_readings' AS code FROM y WHERE static AND n > 1 UNION ALL SELECT construct, 'initial_value_mismatch' FROM y WHERE off""",
)
def _(s, d):
    k = F.col("o_custkey")
    readings = table(s, d, "orders").select(k.alias("construct"), F.col("o_orderdate").alias("time"), (k % 4 + F.when(k % 7 == 0, F.col("o_orderkey") % 2).otherwise(0)).cast("double").alias("value"))
    c = F.col("c_custkey")
    constructs = table(s, d, "customer").select(c.alias("construct"), (c % 3 != 0).alias("static"), (c % 5).cast("double").alias("initial"))
    return preflight.exact_conflicts(readings, constructs)


@query("inconsistent_inputs", """WITH l AS (SELECT user_id, ts, round(value) AS level FROM events WHERE event_type = 'purchase'), x AS (SELECT user_id, ts AS time, event_id, round(value) AS value FROM events WHERE event_type = 'view'), y AS (SELECT x.user_id, x.time, CASE WHEN event_id % 3 = 0 THEN l.level + 1e-5 WHEN event_id % 3 = 1 THEN l.level + 1e-8 ELSE x.value END AS value, l.level AS expected FROM x ASOF JOIN l ON x.user_id = l.user_id AND x.time >= l.ts)
SELECT user_id, time, round(value, 6) AS value, round(expected, 6) AS expected FROM y WHERE abs(value - expected) > 1e-6 + 1e-6 * abs(expected)""")
def _(s, d):
    e = table(s, d, "events").withColumn("value", F.round("value"))
    levels = e.filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("time"), F.col("value").alias("level"))
    views = e.filter("event_type = 'view'").select("user_id", F.col("ts").alias("time"), "event_id", "value")
    held = panel.asof(views, levels, "time", "level", ["user_id"])
    m = F.col("event_id") % 3
    told = held.withColumn("value", F.when(m == 0, F.col("level") + 1e-5).when(m == 1, F.col("level") + 1e-8).otherwise(F.col("value"))).drop("level")
    return rounded(preflight.inconsistent_inputs(told, levels, ["user_id"]), "value", "expected")


# ---- tensors and histories -------------------------------------------------------------


@query("tensor_rows", "SELECT vec_id, (i - 1)::INT AS place, round(embedding[i]::DOUBLE, 6) AS value FROM embeddings, range(1, 65) x(i)")
def _(s, d):
    out = histories.tensor_rows(table(s, d, "embeddings").select("vec_id", F.col("embedding").alias("values")), ["place"])
    return out.select("vec_id", "place", r(F.col("value").cast("double")).alias("value"))


@query("tensor_round_trip", "SELECT vec_id, true AS same FROM embeddings")
def _(s, d):
    """Each vector as a matrix of 8 by 8 cells, as rows, and back."""
    square = table(s, d, "embeddings").select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, F.lit(8))).alias("values"))
    back = histories.rows_tensor(histories.tensor_rows(square, ["row", "column"]), ["row", "column"], ["vec_id"])
    return square.join(back.withColumnRenamed("values", "again"), "vec_id").select("vec_id", (F.col("values") == F.col("again")).alias("same"))


@query("vector_view", "SELECT vec_id, round(list_sum(list_transform(range(11, 21), lambda i: CASE WHEN i % 3 <> 0 THEN embedding[i]::DOUBLE ELSE 0 END)), 6) AS total, 3::BIGINT AS missing FROM embeddings")
def _(s, d):
    rows = table(s, d, "embeddings").withColumns({"values": F.col("embedding").cast("array<double>"), "mask": F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: i % 3 != 0)})
    cut = rows.select("vec_id", histories.vector_view(rows, 10, 20, mask="mask").alias("v"))
    return cut.select("vec_id", r(F.aggregate("v", F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))).alias("total"), F.size(F.filter("v", lambda x: x.isNull())).cast("long").alias("missing"))


@query(
    "emissions",
    """WITH c AS (SELECT event_type AS indicator_id, ts, value, event_id % 4 <> 0 AS seen FROM events WHERE user_id % 10 = 3)
SELECT indicator_id, CASE WHEN seen THEN round(value, 6) END AS value, ts AS anchor_time, 'point' AS support_kind, '1d' AS observation_window, ts - INTERVAL 1 DAY AS support_start, ts AS support_end FROM c""",
)
def _(s, d):
    e = table(s, d, "events")
    day = model_days(F.col("ts"), origin())
    cells = e.select((F.col("user_id") % 10).alias("draw"), day.alias("time"), F.col("event_type").alias("indicator_id"), "value", (F.col("event_id") % 4 != 0).alias("observed"), (day - 1).alias("start"), day.alias("end"))
    layout = s.createDataFrame([(t, "point", "1d") for t in TYPES], "indicator_id string, support_kind string, observation_window string")
    return rounded(histories.emissions(cells, layout, 3, origin()), "value")


@query("history_vectors", f"WITH {_S}, h AS (SELECT user_id, indicator_id, list({_DAYS.format('anchor_time')} ORDER BY anchor_time, value) AS t, list(value ORDER BY anchor_time, value) AS v FROM s GROUP BY ALL) SELECT user_id, indicator_id, len(t) AS n, round(t[1], 6) AS first, round(t[-1], 6) AS last, round(v[1], 6) AS value FROM h")
def _(s, d):
    v = histories.vectors(series(s, d), origin(), ["user_id", "indicator_id"])
    return v.select("user_id", "indicator_id", F.size("times").cast("long").alias("n"), r(F.col("times")[0]).alias("first"), r(F.element_at("times", -1)).alias("last"), r(F.col("values")[0]).alias("value"))


@query("saved_rows", f"WITH {_S} SELECT user_id, indicator_id, value, anchor_time, support_start, support_end FROM s")
def _(s, d):
    """Every history as arrays, and as rows again."""
    return histories.saved_rows(histories.vectors(series(s, d), origin(), ["user_id", "indicator_id"]), origin())


@query("onto_grid", f"WITH {_H}, g AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 1 HOUR)) AS time), c AS (SELECT anchor_time AS time, indicator_id, count(*)::DOUBLE AS n FROM (SELECT event_type AS indicator_id, anchor_time FROM h) GROUP BY ALL) SELECT time, max(n) FILTER (indicator_id = 'click') AS click, max(n) FILTER (indicator_id = 'error') AS error FROM g LEFT JOIN c USING (time) GROUP BY 1")
def _(s, d):
    grid = s.range(1).select(F.explode(F.expr("sequence(TIMESTAMP_NTZ '2024-01-01 00:00:00', TIMESTAMP_NTZ '2024-01-31 00:00:00', INTERVAL 1 HOUR)")).alias("time"))
    counts = hourly(s, d).groupBy(F.col("anchor_time").alias("time"), "indicator_id").agg(F.count("*").cast("double").alias("n"))
    return histories.onto_grid(counts, grid, ["click", "error"], "n")


@query("renamed", "SELECT event_id, CASE event_type WHEN 'view' THEN 'seen' ELSE upper(event_type) END AS event_type FROM events")
def _(s, d):
    return histories.renamed(table(s, d, "events").select("event_id", "event_type"), "event_type", {t: "seen" if t == "view" else t.upper() for t in TYPES})


@query("definitions", "SELECT o_orderpriority AS indicator_id, 'k' || left(o_orderpriority, 1) AS kind FROM orders GROUP BY ALL")
def _(s, d):
    kind = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("k"), F.left("o_orderpriority", F.lit(1))))
    return histories.definitions(table(s, d, "orders").select(F.col("o_orderpriority").alias("indicator_id"), kind.alias("kind")), ["kind"])


@query(
    "boundary_rows",
    f"""WITH {_OBS}, w AS (SELECT {_DAYS.format('anchor_time')} AS time, avg(value) AS m FROM o WHERE indicator_id = 'latest' AND anchor_time > TIMESTAMP '2024-01-03' GROUP BY ALL),
b AS (SELECT DISTINCT {_DAYS.format('t')} AS time FROM (SELECT unnest([anchor_time, support_start, support_end]) AS t FROM o WHERE support_kind = 'interval') UNION SELECT 0.0) SELECT round(time, 6) AS time, round(m, 6) AS m FROM w UNION ALL SELECT round(time, 6), NULL FROM b WHERE time NOT IN (SELECT time FROM w)""",
)
def _(s, d):
    o = observations(s, d)
    w = o.filter("indicator_id = 'latest' AND anchor_time > TIMESTAMP_NTZ '2024-01-03 00:00:00'").groupBy(model_days(F.col("anchor_time"), origin()).alias("time")).agg(F.avg("value").alias("m"))
    return rounded(histories.with_boundaries(w, o, origin()), "time", "m")


@query("on_all_anchors", f"WITH {_DR}, d AS (SELECT * FROM d0 WHERE indicator_id = 'signup'), a AS (SELECT DISTINCT anchor_time FROM d), h AS (SELECT DISTINCT draw FROM d) SELECT h.draw AS history, a.anchor_time, round(d.value, 6) AS value FROM h CROSS JOIN a LEFT JOIN d ON d.draw = h.draw AND d.anchor_time = a.anchor_time")
def _(s, d):
    one = draws(s, d).filter("indicator_id = 'signup'").withColumnRenamed("draw", "history")
    return rounded(histories.on_all_anchors(one), "value")


@query("masked_history", "WITH x AS (SELECT event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS i FROM events) SELECT event_id, CASE WHEN i < 40 AND i NOT IN (3, 5) THEN round(value, 6) END AS value FROM x")
def _(s, d):
    return rounded(histories.masked(table(s, d, "events"), ["user_id"], "ts", set(range(40)), {3, 5}).select("event_id", "value"), "value")


@query("wide_csv", f"WITH {_DR} SELECT anchor_time AS timestamp, round(max(value) FILTER (indicator_id = 'click'), 6) AS click, round(max(value) FILTER (indicator_id = 'view'), 6) AS view FROM (SELECT anchor_time, indicator_id, round(value, 4) AS value FROM ob) GROUP BY 1 HAVING count(*) FILTER (indicator_id IN ('click', 'view')) > 0")
def _(s, d):
    """Written as CSV, and read again."""
    rows = observed(s, d).withColumns({"value": F.round("value", 4), "support_start": F.col("anchor_time"), "support_end": F.col("anchor_time")}).filter("indicator_id IN ('click', 'view')")
    path = scratch(s, "wide")
    histories.wide_csv(rows, ["click", "view"], path)
    back = s.read.csv(path, header=True, schema="timestamp timestamp_ntz, click double, click_start timestamp_ntz, click_end timestamp_ntz, view double, view_start timestamp_ntz, view_end timestamp_ntz")
    return rounded(back.select("timestamp", "click", "view"), "click", "view")


@query("category_shares", "WITH x AS (SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS time, left(o_orderpriority, 1)::INT - 1 AS v FROM orders), t AS (SELECT DISTINCT time FROM x UNION SELECT TIMESTAMP '1980-01-01') SELECT time, l.level, count(v) AS n_draws, round(CASE WHEN count(v) > 0 THEN count(*) FILTER (v = l.k) / count(v)::DOUBLE END, 6) AS probability FROM t LEFT JOIN x USING (time), (VALUES (0, 'a'), (1, 'b'), (2, 'c'), (3, 'd'), (4, 'e')) l(k, level) GROUP BY ALL")
def _(s, d):
    month = Duration.parse("1mo").floor(F.col("o_orderdate"))
    rows = table(s, d, "orders").select(month.alias("time"), (F.left("o_orderpriority", F.lit(1)).cast("double") - 1).alias("value"))
    times = rows.select("time").union(s.range(1).select(F.expr("TIMESTAMP_NTZ '1980-01-01 00:00:00'")))
    return rounded(histories.category_shares(rows, times, list("abcde")), "probability")


@query("density_histogram", "WITH e AS (SELECT event_type, min(value) AS a, max(value) AS b, count(*) AS n FROM events GROUP BY 1), w AS (SELECT event_type, n, a - 0.05 * (b - a) AS lo, (b - a) * 1.1 / 50 AS width FROM e), g AS (SELECT *, unnest(range(0, 50)) AS bin FROM w), c AS (SELECT w.event_type, least(floor((value - lo) / width), 49) AS bin, count(*) AS k FROM events JOIN w USING (event_type) GROUP BY ALL) SELECT event_type, round(lo + (bin + 0.5) * width, 4) AS center, round(coalesce(k, 0) / (n * width), 6) AS density FROM g LEFT JOIN c USING (event_type, bin)")
def _(s, d):
    out = histories.density_histogram(table(s, d, "events"), ["event_type"])
    return out.withColumns({"center": r("center", 4), "density": r("density")})


def _spans(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = table(s, d, "orders")
    after = lambda n: F.col("o_orderdate") + F.expr(f"INTERVAL {n} DAY")
    w = o.select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.col("o_orderdate").alias("start"), after(45).alias("end"))
    g = o.select(F.col("o_custkey").alias("c"), F.col("o_orderdate").alias("left"), after(20).alias("right"), F.col("o_totalprice").alias("v"), (F.col("o_totalprice") / 2).alias("a"), (F.col("o_totalprice") / 3).alias("b"))
    return w, g


_PAIRED = """x AS (SELECT k, v, "left" AS l, greatest("start", "left") AS lo, least("end", "right") AS hi FROM w JOIN g ON w.c = g.c AND "left" < "end" AND "right" > "start")"""


@query("interval_statistics", f"WITH {_OV}, {_PAIRED}, y AS (SELECT k, v, date_diff('second', lo, hi) AS o FROM x) SELECT k, round(sum(o * v) / sum(o), 4) AS mean, round(sum(v), 4) AS sum, count(v) AS count, round(sqrt(greatest(sum(o * v * v) / sum(o) - (sum(o * v) / sum(o)) ** 2, 0)) / 100, 1) AS std FROM y GROUP BY 1")
def _(s, d):
    out = histories.interval_statistics(*_spans(s, d), "k", 30 * 86400, ["c"])
    return out.withColumns({"mean": r("mean", 4), "sum": r("sum", 4), "std": F.round(F.col("std") / 100, 1)})


@query("trapezoid_mean", f"WITH {_OV}, {_PAIRED}, y AS (SELECT k, v / 2 + (v / 3 - v / 2) * (date_diff('second', l, lo) + date_diff('second', l, hi)) / (2 * 20 * 86400.0) AS m, date_diff('second', lo, hi) AS o FROM x) SELECT k, round(sum(o * m) / sum(o), 4) AS mean FROM y GROUP BY 1")
def _(s, d):
    return histories.trapezoid_mean(*_spans(s, d), "k", 30 * 86400, ["c"]).select("k", r("mean", 4).alias("mean"))


@query("requests_in_window", "SELECT event_id, count(*) OVER w AS recent, count(*) OVER w <= 3 AS admitted FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 21599999999 MICROSECOND PRECEDING AND CURRENT ROW)")
def _(s, d):
    return histories.requests_in_window(table(s, d, "events"), 6 * 3600, 3, ["user_id"]).select("event_id", "recent", "admitted")


@query("expected_work", "SELECT o_orderkey AS draw, rank() OVER (ORDER BY o_totalprice, o_orderkey) AS place FROM orders")
def _(s, d):
    """The places in order of work, counted from the tasks' own order."""
    dealt = histories.by_expected_work(table(s, d, "orders").select(F.col("o_orderkey").alias("draw"), F.col("o_totalprice").alias("work")), "work", 8)
    part = F.shiftright("order", 33)
    sizes = dealt.groupBy(part.alias("p")).agg(F.count("*").alias("n"))
    before = sizes.select("p", (F.sum("n").over(Window.orderBy("p")) - F.col("n")).alias("before"))
    return dealt.withColumn("p", part).join(before, "p").select("draw", (F.col("before") + F.col("order") % (1 << 33) + 1).alias("place"))


@query("sections", "SELECT n_regionkey, n_name, count(*) OVER (PARTITION BY n_regionkey) AS section_rows, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name)::INT AS place FROM nation")
def _(s, d):
    return histories.sectioned(table(s, d, "nation").select("n_regionkey", "n_name"), "n_regionkey", ["n_name"])


# ---- laws ---------------------------------------------------------------------------


@query(
    "log_densities",
    """SELECT event_id, round(-0.5 * ((value - 40) / 7) ** 2 - ln(7) - 0.5 * ln(2 * pi()), 6) AS normal,
round(lgamma(2.5) - lgamma(2.0) - 0.5 * ln(4 * pi()) - ln(7) - 2.5 * ln(1 + ((value - 40) / 7) ** 2 / 4), 6) AS student,
round(floor(value) * ln(30) - 30 - lgamma(floor(value) + 1), 6) AS poisson,
round(CASE WHEN value > 0 THEN 2.5 * ln(0.05) + 1.5 * ln(value) - 0.05 * value - lgamma(2.5) END, 6) AS gamma,
round(lgamma(floor(value) + 3.5) - lgamma(3.5) - lgamma(floor(value) + 1) + 3.5 * ln(3.5 / 23.5) + floor(value) * ln(20 / 23.5), 6) AS negative_binomial,
round(CASE WHEN value > 0 AND value < 1000 THEN 1.5 * ln(value / 1000) + 3.5 * ln(1 - value / 1000) + lgamma(7) - lgamma(2.5) - lgamma(4.5) END, 6) AS beta,
round((event_id % 2) * 0.3 - ln(1 + exp(0.3)), 6) AS bernoulli FROM events""",
)
def _(s, d):
    v, e = F.col("value"), table(s, d, "events")
    d_ = laws.log_density
    fine = lambda c: F.when(c > float("-inf"), c)
    return rounded(
        e.select(
            "event_id",
            d_("Normal", v, loc=40, scale=7).alias("normal"),
            d_("StudentT", v, df=4, loc=40, scale=7).alias("student"),
            d_("Poisson", F.floor(v).cast("double"), rate=30).alias("poisson"),
            fine(d_("Gamma", v, concentration=2.5, rate=0.05)).alias("gamma"),
            d_("NegativeBinomial2", F.floor(v).cast("double"), mean=20, concentration=3.5).alias("negative_binomial"),
            fine(d_("Beta", v / 1000, concentration1=2.5, concentration0=4.5)).alias("beta"),
            d_("BernoulliLogits", (F.col("event_id") % 2).cast("double"), logits=0.3).alias("bernoulli"),
        ),
        "normal", "student", "poisson", "gamma", "negative_binomial", "beta", "bernoulli",
    )


@query(
    "category_laws",
    """WITH x AS (SELECT event_id, event_id % 4 AS k, value / 50 - 1 AS z FROM events), y AS (SELECT *, [1 / (1 + exp(z + 1)), 1 / (1 + exp(z)), 1 / (1 + exp(z - 2))] AS c FROM x)
SELECT event_id, round(CASE WHEN k < 4 THEN ln(CASE k WHEN 0 THEN c[1] WHEN 1 THEN c[2] - c[1] WHEN 2 THEN c[3] - c[2] ELSE 1 - c[3] END) END, 6) AS ordered, CASE WHEN k < 3 THEN round([0.0, z, -z][k + 1] - ln(1 + exp(z) + exp(-z)), 6) END AS categorical FROM y""",
)
def _(s, d):
    z, k = F.col("value") / 50 - 1, (F.col("event_id") % 4).cast("double")
    out = table(s, d, "events").select("event_id", laws.log_density("OrderedLogistic", k, predictor=z, cutpoints=[-1.0, 0.0, 2.0]).alias("ordered"), laws.log_density("Categorical", k, logits=[0.0, z, -z]).alias("categorical"))
    return rounded(out.withColumn("categorical", F.when(F.col("categorical") > float("-inf"), F.col("categorical"))), "ordered", "categorical")


@query("expressions", "SELECT event_id, round(1 / (1 + exp(-(value - 40) / 10)), 6) AS sigmoid, round(2 * greatest(value - 10, 0) ** 1.5 / (30 ** 1.5 + greatest(value - 10, 0) ** 1.5 + 1e-12), 6) AS hill, round(-0.5 * (value - 40) - 0.001 * (value - 40) ** 3, 4) AS force, round(0.25 * (value - 40) ** 2 + 0.00025 * (value - 40) ** 4, 4) AS potential FROM events")
def _(s, d):
    v = F.col("value")
    out = table(s, d, "events").select("event_id", r(laws.sigmoid((v - 40) / 10)).alias("sigmoid"), r(laws.hill(v - 10, 2, 30, 1.5)).alias("hill"), r(laws.restoring_force(v, 40, 0.5, 0.001), 4).alias("force"), r(laws.restoring_potential(v, 40, 0.5, 0.001), 4).alias("potential"))
    return out


@query("prior_quantiles", "SELECT event_id, round(-ln(1 - u) / 2, 6) AS exponential, round(3 + u * 4, 6) AS uniform, round(-ln(0.2 + 0.7 * u) / 2, 6) AS decay FROM (SELECT event_id, (event_id % 1000 + 0.5) / 1000 AS u FROM events)")
def _(s, d):
    u = (F.col("event_id") % 1000 + 0.5) / 1000
    out = table(s, d, "events").select("event_id", laws.prior_quantile("Exponential", u, rate=2).alias("exponential"), laws.prior_quantile("Uniform", u, lower=3, upper=7).alias("uniform"), laws.persistence_to_decay(0.2 + 0.7 * u, 2).alias("decay"))
    return rounded(out, "exponential", "uniform", "decay")


@query("normal_round_trip", "SELECT event_id, round((event_id % 999 + 0.5) / 999, 6) AS u FROM events")
def _(s, d):
    u = (F.col("event_id") % 999 + 0.5) / 999
    return table(s, d, "events").select("event_id", r(laws.normal_cdf(laws.prior_quantile("Normal", u, mu=0, sigma=1))).alias("u"))


@query("hash_variates")
def _(s, d):
    """Hashes differ between engines: tests check that the variates are even."""
    return table(s, d, "events").select("event_id", laws.variate(F.col("event_type"), F.col("event_id")).alias("u"))


# ---- screens, equivalence, order -----------------------------------------------------


_CO = "co AS (SELECT indicator_id, draw, floor(value / 15) AS value FROM d0), oo AS (SELECT indicator_id, floor(value / 15) AS value FROM ob)"
_THREE = "avg(value) AS mean, var_pop(value) AS variance, avg((value = 0)::INT) AS zeros"


def _counted(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.floor(F.col("value") / 15).cast("double"))


@query("count_reach", f"WITH {_DR}, {_CO}, a AS (SELECT indicator_id, draw, {_THREE} FROM co GROUP BY ALL), u AS (UNPIVOT (SELECT * FROM a) ON mean, variance, zeros INTO NAME statistic VALUE v), e AS (SELECT indicator_id, statistic, quantile_cont(v, 0.01) AS low, quantile_cont(v, 0.99) AS high FROM u GROUP BY ALL), o AS (UNPIVOT (SELECT indicator_id, {_THREE} FROM oo GROUP BY 1) ON mean, variance, zeros INTO NAME statistic VALUE v) SELECT indicator_id, statistic, round(v, 6) AS observed, round(low, 6) AS low, round(high, 6) AS high, CASE WHEN v >= low AND v <= high THEN 'passed' ELSE 'failed' END AS outcome FROM o JOIN e USING (indicator_id, statistic)")
def _(s, d):
    return rounded(posterior.count_reach(_counted(observed(s, d)), _counted(draws(s, d))), "observed", "low", "high")


@query(
    "code_reach",
    f"""WITH {_DR}, {_CO}, c2 AS (SELECT indicator_id, draw, least(value, 3) AS v FROM co), o2 AS (SELECT indicator_id, least(value, 3) AS v FROM oo),
a AS (SELECT indicator_id, draw, [avg((v = 0)::INT), avg((v = 1)::INT), avg((v = 2)::INT), avg((v = 3)::INT)] AS p FROM c2 GROUP BY ALL), m AS (SELECT indicator_id, [avg(p[1]), avg(p[2]), avg(p[3]), avg(p[4])] AS c FROM a GROUP BY 1),
b AS (SELECT indicator_id, [avg((v = 0)::INT), avg((v = 1)::INT), avg((v = 2)::INT), avg((v = 3)::INT)] AS p FROM o2 GROUP BY ALL),
f AS (SELECT indicator_id, p, list_sum(list_transform(range(1, 5), lambda i: abs(p[i] - c[i]))) / 2 AS distance, -list_sum(list_transform(p, lambda x: x * ln(x + 1e-12))) AS entropy FROM a JOIN m USING (indicator_id)),
g AS (SELECT indicator_id, list_sum(list_transform(range(1, 5), lambda i: abs(p[i] - c[i]))) / 2 AS distance, -list_sum(list_transform(p, lambda x: x * ln(x + 1e-12))) AS entropy FROM b JOIN m USING (indicator_id)),
e AS (SELECT indicator_id, quantile_cont(distance, 0.99) AS d99, quantile_cont(entropy, 0.01) AS e1, quantile_cont(entropy, 0.99) AS e99 FROM f GROUP BY 1)
SELECT indicator_id, 'distance' AS statistic, round(distance, 6) AS observed, 0.0 AS low, round(d99, 6) AS high, CASE WHEN distance <= d99 THEN 'passed' ELSE 'failed' END AS outcome FROM g JOIN e USING (indicator_id)
UNION ALL SELECT indicator_id, 'entropy', round(entropy, 6), round(e1, 6), round(e99, 6), CASE WHEN entropy BETWEEN e1 AND e99 THEN 'passed' ELSE 'failed' END FROM g JOIN e USING (indicator_id)""",
)
def _(s, d):
    code = lambda df: _counted(df).withColumn("value", F.least("value", F.lit(3.0)))
    return rounded(posterior.code_reach(code(observed(s, d)), code(draws(s, d)), 4), "observed", "low", "high")


@query("code_transmission", f"WITH {_DR}, p AS (SELECT indicator_id, draw, anchor_time, l.level, CASE l.level WHEN 0 THEN 1 / (1 + exp(-(value - 40) / 20)) ELSE 1 - 1 / (1 + exp(-(value - 40) / 20)) END AS p FROM d0, (VALUES (0), (1)) l(level)), y AS (SELECT indicator_id, draw, level, var_pop(p) AS v, avg(p * p) AS q FROM p GROUP BY ALL), z AS (SELECT indicator_id, draw, sum(v) AS v, 1 - sum(q) AS g FROM y GROUP BY ALL) SELECT indicator_id, round(median(v / (v + g)), 6) AS share FROM z GROUP BY 1")
def _(s, d):
    p = laws.sigmoid((F.col("value") - 40) / 20)
    rows = draws(s, d).select("indicator_id", "draw", F.col("anchor_time").alias("time"), F.inline(F.array(F.struct(F.lit(0).alias("level"), p.alias("probability")), F.struct(F.lit(1).alias("level"), (1 - p).alias("probability")))))
    return rounded(posterior.code_transmission(rows), "share")


@query(
    "screens",
    f"""WITH {_EN}, l AS (SELECT draw, list(abs(value) ORDER BY time) AS v, count(*) AS n, count(*) // 4 AS q FROM en GROUP BY 1), c AS (SELECT avg((list_max(v[n - q + 1 :]) / (list_aggregate(v[q + 1 : 2 * q], 'quantile_cont', 0.95) + 1e-9) > 5)::INT) AS x FROM l),
f AS (SELECT floor(time) AS time, value FROM en), k AS (SELECT median(s) / 30 AS x FROM (SELECT (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / 1.349 AS s FROM f, (SELECT median(time) AS mid FROM f) WHERE time >= mid GROUP BY time)),
w AS (SELECT median(e / w) AS x FROM (SELECT quantile_cont(value - value * value / 100, 0.75) - quantile_cont(value - value * value / 100, 0.25) AS e, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS w FROM en GROUP BY draw)),
t AS (SELECT avg((1.0 <= 3 * value / 10 AND 30.0 >= 4 * value / 10)::INT) AS x FROM events)
SELECT 'state' AS subject, 'nonfinite_share' AS statistic, 0.0 AS value, 'passed' AS outcome UNION ALL SELECT 'state', 'escaped_share', round(x, 6), CASE WHEN x > 0.01 THEN 'failed' ELSE 'passed' END FROM c
UNION ALL SELECT 'days', 'nonfinite_share', 0.0, 'passed' UNION ALL SELECT 'days', 'escaped_share', NULL, 'not_evaluated' UNION ALL SELECT 'days', 'scale_over_anchor', round(x, 6), CASE WHEN x < 1 / 3.0 OR x > 3 THEN 'failed' ELSE 'passed' END FROM k
UNION ALL SELECT 'state', 'resolved_share', round(x, 6), CASE WHEN x < 0.8 THEN 'failed' ELSE 'passed' END FROM t UNION ALL SELECT 'edge', 'overwhelm', round(x, 6), CASE WHEN x > 0.95 THEN 'failed' ELSE 'passed' END FROM w""",
)
def _(s, d):
    """Two states, one of which has an anchor, one time constant and one edge. The
    second state's draws are single readings, too short to be judged for growth."""
    e = ensemble(s, d)
    days = table(s, d, "events").select(F.lit("days").alias("state"), F.col("event_id").alias("draw"), F.floor(model_days(F.col("ts"), origin())).cast("double").alias("time"), "value")
    states = e.select(F.lit("state").alias("state"), "draw", "time", "value").union(days)
    anchors = s.createDataFrame([("days", 30.0)], "state string, anchor double")
    taus = table(s, d, "events").select(F.lit("state").alias("state"), (F.col("value") / 10).alias("tau"))
    gaps = s.createDataFrame([(1.0,)] * 30, "gap double")
    edges = e.select(F.lit("edge").alias("edge"), "draw", "time", F.col("value").alias("value_on"), (F.col("value") * F.col("value") / 100).alias("value_off"))
    return rounded(posterior.screens(states, anchors, taus, gaps, edges), "value")


_MARGINALS = "m AS (SELECT c_nationkey AS param, avg(c_acctbal) AS mean, CASE WHEN c_nationkey % 5 = 0 THEN 0 ELSE stddev_pop(c_acctbal) END AS sd, 1.5 AS mcse FROM customer GROUP BY 1)"


@query("equivalence", f"WITH {_MARGINALS}, l AS (SELECT param, mean + CASE WHEN sd > 0 THEN param / 10.0 ELSE 0 END AS mean, sd * (1 + param / 1000.0) AS sd, mcse FROM m), b AS (SELECT max((abs(l.mean - m.mean) + 2 * sqrt(4.5)) / m.sd) FILTER (m.sd > 0) AS a, max(abs(l.sd / m.sd - 1)) FILTER (m.sd > 0) AS s, bool_and(l.mean = m.mean AND l.sd = 0) FILTER (m.sd = 0) AS f FROM l JOIN m USING (param)) SELECT f AND a <= 0.1 AND s <= 0.1 AS equivalent, round(a, 6) AS max_mean_bound, round(s, 6) AS max_sd_error, f AS fixed_equal FROM b")
def _(s, d):
    k = F.col("c_nationkey")
    m = table(s, d, "customer").groupBy(k.alias("param")).agg(F.avg("c_acctbal").alias("mean"), F.stddev_pop("c_acctbal").alias("sd")).withColumns({"sd": F.when(F.col("param") % 5 == 0, 0.0).otherwise(F.col("sd")), "mcse": F.lit(1.5)})
    shift = F.when(F.col("sd") > 0, F.col("param") / 10).otherwise(0.0)
    left = m.withColumn("mean", F.col("mean") + shift).withColumns({"sd": F.col("sd") * (1 + F.col("param") / 1000), "mcse": F.lit(1.5)})
    # Both sides' error is 1.5 on each: the hypotenuse is the root of 4.5.
    return rounded(posterior.equivalent(left, m), "max_mean_bound", "max_sd_error")


@query("start_scores", "WITH p AS (SELECT n_regionkey AS param, c_acctbal AS value FROM customer JOIN nation ON c_nationkey = n_nationkey), f AS (SELECT param, avg(value) AS m, stddev_samp(value) AS s FROM p GROUP BY 1), x AS (SELECT n_nationkey % 5 AS start, n_regionkey AS param, n_nationkey * 100.0 AS value FROM nation) SELECT start, round(sqrt(avg(((value - m) / s) ** 2)), 6) AS rms, round(max(abs((value - m) / s)), 6) AS furthest FROM x JOIN f USING (param) GROUP BY 1")
def _(s, d):
    n = table(s, d, "nation")
    ref = table(s, d, "customer").join(n.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("param")), "c_nationkey").select("param", F.col("c_acctbal").alias("value"))
    starts = n.select((F.col("n_nationkey") % 5).alias("start"), F.col("n_regionkey").alias("param"), (F.col("n_nationkey") * 100.0).alias("value"))
    return rounded(posterior.start_scores(starts, ref), "rms", "furthest")


@query("influence_order", "SELECT s_suppkey AS point, CASE WHEN s_suppkey % 9 <> 0 THEN round(s_acctbal / 10000, 6) END AS pareto_k, row_number() OVER (ORDER BY CASE WHEN s_suppkey % 9 = 0 THEN 0 ELSE 1 END, CASE WHEN s_suppkey % 9 <> 0 THEN s_acctbal END DESC, s_suppkey)::INT AS place FROM supplier")
def _(s, d):
    k = F.when(F.col("s_suppkey") % 9 != 0, F.col("s_acctbal") / 10000)
    return rounded(posterior.influence_order(table(s, d, "supplier").select(F.col("s_suppkey").alias("point"), k.alias("pareto_k"))), "pareto_k")


@query("traces", "SELECT o_orderpriority AS param, c_nationkey AS chain, count(*) AS n, arg_min(o_totalprice, o_orderkey) AS first, arg_max(o_totalprice, o_orderkey) AS last FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL")
def _(s, d):
    t = posterior.traces(posterior_rows(s, d))
    return t.select("param", "chain", F.size("values").cast("long").alias("n"), F.col("values")[0].alias("first"), F.element_at("values", -1).alias("last"))


@query("energy_histograms", f"WITH {_PO}, v AS (SELECT 'marginal' AS kind, value - (SELECT avg(value) FROM po) AS v FROM po UNION ALL SELECT 'transition', value - lag(value) OVER (PARTITION BY chain ORDER BY draw) FROM po), e AS (SELECT kind, min(v) AS a, max(v) AS b, count(v) AS n FROM v GROUP BY 1), w AS (SELECT kind, n, a - 0.05 * (b - a) AS lo, (b - a) * 1.1 / 40 AS width FROM e), g AS (SELECT *, unnest(range(0, 40)) AS bin FROM w), c AS (SELECT w.kind, least(floor((v - lo) / width), 39) AS bin, count(*) AS k FROM v JOIN w USING (kind) WHERE v IS NOT NULL GROUP BY ALL) SELECT kind, round(lo + (bin + 0.5) * width, 2) AS center, round(1e6 * coalesce(k, 0) / (n * width), 6) AS density FROM g LEFT JOIN c USING (kind, bin)")
def _(s, d):
    out = posterior.energy_histograms(posterior_rows(s, d))
    return out.withColumns({"center": F.round("center", 2), "density": r(F.col("density") * 1e6)})


@query("framed_cover", "WITH b AS (SELECT event_type, date_trunc('day', ts) AS p, quantile_cont(value, 0.025) AS l, quantile_cont(value, 0.975) AS h FROM events GROUP BY ALL), f AS (SELECT event_type, min(l) AS l, max(h) AS h FROM b GROUP BY 1), c AS (SELECT event_type, min(value) AS lo, max(value) AS hi FROM events WHERE event_type <> 'view' GROUP BY 1) SELECT event_type, round(least(l, lo), 6) AS low, round(greatest(h, hi), 6) AS high FROM f LEFT JOIN c USING (event_type)")
def _(s, d):
    e = table(s, d, "events").withColumn("p", DAY.floor(F.col("ts")))
    return rounded(compare.central_frame(e, ["event_type"], "p", e.filter("event_type <> 'view'")), "low", "high")


@query("latent_worst")
def _(s, d):
    """Order prices of five regions' customers as paths of one state; tests compare the
    worst coordinate with a plain computation."""
    n = table(s, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("chain"))
    c = table(s, d, "customer").join(n, "c_nationkey").select(F.col("c_custkey").alias("o_custkey"), "chain")
    rows = table(s, d, "orders").join(c, "o_custkey").select(F.col("o_orderstatus").alias("state"), F.col("o_orderpriority").alias("time"), "chain", F.col("o_orderkey").alias("draw"), F.col("o_totalprice").alias("value"))
    return rounded(posterior.latent_worst(rows), "rhat", "ess_bulk", "ess_tail")


# ---- comparison of two sides -----------------------------------------------------------


@query("statistic_histograms", f"WITH {_DR}, d4 AS (UNPIVOT (SELECT indicator_id, draw, avg(value) AS mean, stddev_pop(value) AS sd, min(value) AS min, max(value) AS max FROM d0 GROUP BY ALL) ON mean, sd, min, max INTO NAME statistic VALUE v), e AS (SELECT indicator_id, statistic, min(v) AS lo, max(v) AS hi FROM d4 GROUP BY ALL) SELECT indicator_id, statistic, (least(floor((v - lo) / ((hi - lo) / 12)), 11) + 1)::INT AS bin, count(*) AS count FROM d4 JOIN e USING (indicator_id, statistic) GROUP BY ALL")
def _(s, d):
    return compare.statistic_histograms(draws(s, d))


def _sides(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One observed history of daily values, and one per priority class of its orders."""
    o = table(s, d, "orders").select(F.concat(F.lit("i"), (F.col("o_custkey") % 3).cast("string")).alias("indicator_id"), Duration.parse("1mo").floor(F.col("o_orderdate")).alias("anchor_time"), F.col("o_orderpriority").alias("draw"), F.col("o_totalprice").alias("value"))
    o = o.filter("NOT (indicator_id = 'i2' AND draw = '5-LOW' AND month(anchor_time) = 6)")
    bounds = {"support_start": F.col("anchor_time"), "support_end": F.col("anchor_time")}
    left = o.groupBy("indicator_id", "anchor_time").agg(F.avg("value").alias("value")).withColumns({"history": F.lit("real")} | bounds)
    right = o.groupBy("indicator_id", "anchor_time", "draw").agg(F.avg("value").alias("value")).withColumnRenamed("draw", "history").withColumns(bounds)
    return left, right.select(left.columns), left.unionByName(right.select(left.columns)).select("history", "indicator_id", F.lit("d").alias("definition"), F.lit("continuous").alias("dtype")).distinct()


@query(
    "compare_sides",
    """WITH o AS (SELECT 'i' || (o_custkey % 3) AS id, date_trunc('month', o_orderdate)::TIMESTAMP AS t, o_orderpriority AS h, o_totalprice AS v FROM orders), p AS (SELECT * FROM o WHERE NOT (id = 'i2' AND h = '5-LOW' AND month(t) = 6)),
l AS (SELECT id, t, avg(v) AS v FROM p GROUP BY ALL), q AS (SELECT id, t, h, avg(v) AS v FROM p GROUP BY ALL), a AS (SELECT id, h, t FROM q UNION ALL SELECT id, 'real', t FROM l),
k AS (SELECT id, count(DISTINCT h) AS present FROM a GROUP BY 1), sc AS (SELECT id, count(DISTINCT s) AS n FROM (SELECT id, h, list(t ORDER BY t) AS s FROM a GROUP BY ALL) GROUP BY 1),
m AS (SELECT id, bool_and(n = 5) AS matched FROM (SELECT l.id, l.t, count(q.h) AS n FROM l LEFT JOIN q ON l.id = q.id AND l.t = q.t GROUP BY ALL) GROUP BY 1),
b AS (SELECT id, t, quantile_cont(v, 0.025) AS lo, quantile_cont(v, 0.975) AS hi, avg(v) AS mu FROM q GROUP BY ALL), c AS (SELECT l.id, count(*) AS n, avg((l.v BETWEEN lo AND hi)::INT) AS covered FROM l JOIN b USING (id, t) JOIN m USING (id) WHERE matched GROUP BY 1),
rr AS (SELECT l.id, t, l.v - mu AS r FROM l JOIN b USING (id, t) JOIN m USING (id) WHERE matched), cc AS (SELECT id, t, r - avg(r) OVER (PARTITION BY id) AS c FROM rr), ac AS (SELECT id, avg(c * nx) / avg(c * c) AS rho, count(*) AS n FROM (SELECT *, lead(c) OVER (PARTITION BY id ORDER BY t) AS nx FROM cc) GROUP BY 1),
sd AS (SELECT id, avg(s) AS ds FROM (SELECT id, h, stddev_pop(v) AS s FROM q GROUP BY ALL) GROUP BY 1), ra AS (SELECT l.id, any_value(ds) / stddev_pop(l.v) AS ratio FROM l JOIN sd USING (id) JOIN m USING (id) WHERE matched GROUP BY 1)
SELECT id AS indicator_id, 'indicator_presence' AS code, 'passed' AS outcome, 6.0 AS evidence FROM k UNION ALL SELECT id, 'measurement_definition', 'passed', 1 FROM k
UNION ALL SELECT id, 'observation_schedule', CASE WHEN n > 1 THEN 'failed' ELSE 'passed' END, n FROM sc UNION ALL SELECT id, 'observation_support', CASE WHEN matched THEN 'passed' ELSE 'failed' END, NULL FROM m
UNION ALL SELECT id, 'calibration', CASE WHEN covered < 0.7 OR covered > 0.98 THEN 'failed' ELSE 'passed' END, round(covered, 6) FROM c
UNION ALL SELECT id, 'autocorrelation', CASE WHEN abs(rho) > 0.3 THEN 'failed' ELSE 'passed' END, round(rho, 6) FROM ac UNION ALL SELECT id, 'sd_ratio', CASE WHEN ratio < 1 / 3.0 OR ratio > 3 THEN 'failed' ELSE 'passed' END, round(ratio, 6) FROM ra""",
)
def _(s, d):
    left, right, definitions = _sides(s, d)
    return rounded(compare.compared(left, right, definitions, inputs=["none"]), "evidence")


# ---- graphs ----------------------------------------------------------------------------


@query("observed_constructs", "SELECT n_name AS node FROM nation WHERE n_regionkey = 0 OR n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 3 = 0)")
def _(s, d):
    n = table(s, d, "nation")
    nodes = n.select(F.col("n_name").alias("node"), F.when(F.col("n_regionkey") == 0, "exogenous").otherwise("endogenous").alias("role"))
    found = table(s, d, "supplier").filter("s_suppkey % 3 = 0").join(n.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("node")), "s_nationkey")
    return graphs.observed_constructs(nodes, found)


@query(
    "law_origins",
    """WITH RECURSIVE m AS (SELECT n_nationkey AS rev, CASE WHEN n_nationkey > 4 THEN n_nationkey - 5 END AS parent, n_nationkey % 10 = 3 OR n_nationkey = 6 AS fit FROM nation),
l AS (SELECT rev, k AS law, CASE WHEN k = 1 AND rev >= 18 THEN rev ELSE rev % 5 END + k * 100 AS value, k < 2 AS uncertain FROM m, range(0, 3) x(k)),
up AS (SELECT rev, rev AS anc, 0 AS steps FROM m UNION ALL SELECT up.rev, m.parent, steps + 1 FROM up JOIN m ON up.anc = m.rev WHERE m.parent IS NOT NULL),
c AS (SELECT up.rev, anc, steps, count(*) FILTER (a.uncertain AND a.value = b.value) AS inh, count(*) FILTER (a.uncertain) AS unc, count(*) FILTER (NOT a.uncertain AND a.value <> b.value) AS ed FROM up JOIN m ON m.rev = anc AND m.fit JOIN l a ON a.rev = up.rev JOIN l b ON b.rev = anc AND b.law = a.law GROUP BY ALL),
n AS (SELECT * FROM c WHERE inh > 0 QUALIFY row_number() OVER (PARTITION BY rev ORDER BY steps) = 1)
SELECT 'r' || m.rev AS revision, CASE WHEN anc IS NULL THEN 'authored' WHEN inh = unc AND ed = 0 THEN 'fitted' ELSE 'mixed' END AS origin, 'r' || anc AS fitted_revision FROM m LEFT JOIN n USING (rev)""",
)
def _(s, d):
    k = F.col("n_nationkey")
    name = lambda c: F.concat(F.lit("r"), c.cast("string"))
    n = table(s, d, "nation")
    models = n.select(name(k).alias("revision"), F.when(k > 4, name(k - 5)).alias("parent"), F.when((k % 10 == 3) | (k == 6), "fit").otherwise("edit_model").alias("produced_by"))
    law = n.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(2))))
    value = F.when((F.col("j") == 1) & (k >= 18), k).otherwise(k % 5) + F.col("j") * 100
    laws_ = law.select(name(k).alias("revision"), F.col("j").alias("law"), value.cast("string").alias("value"), (F.col("j") < 2).alias("uncertain"))
    return graphs.law_origins(models, laws_, models.select("revision"))


@query("confounders_unrolled", f"WITH {_G}, u AS (SELECT cause || '@' || t AS cause, effect || '@' || t AS effect FROM edges, (VALUES (0), (1)) x(t) WHERE NOT lagged UNION ALL SELECT cause || '@0', effect || '@1' FROM edges WHERE lagged UNION ALL SELECT node || '@0', node || '@1' FROM nodes WHERE varying), s AS (SELECT node || '@' || t AS node FROM seen, (VALUES (0), (1)) x(t)) SELECT cause AS node, count(DISTINCT effect) AS children FROM u WHERE cause NOT IN (FROM s) AND effect IN (FROM s) GROUP BY 1 HAVING count(DISTINCT effect) >= 2")
def _(s, d):
    nodes, edges, seen = graph(s, d)
    twice = seen.select(F.explode(F.array(*[F.concat(F.col("node"), F.lit(f"@{t}")) for t in (0, 1)])).alias("node"))
    return graphs.latent_confounders(graphs.flattened(graphs.unrolled(nodes, edges)), twice)


@query("identification")
def _(s, d):
    """Effects of every third nation on all others, in the graph without cycles; tests
    hold the algorithm against known graphs."""
    _nodes, edges, seen = graph(s, d)
    known = sorted(r.node for r in seen.collect())
    dag = [tuple(r) for r in edges.filter("int(substr(cause, 2)) < int(substr(effect, 2))").select("cause", "effect").collect()]
    pairs = [(a, b) for a in known[::3] for b in known if a != b]
    return s.createDataFrame(identification.effects(dag, known, pairs), "treatment string, outcome string, identifiable boolean")


@query("redundant_coefficients", "SELECT ['alpha', 'beta', 'own0', 'own1', 'own2', 'own3'] AS parameters")
def _(s, d):
    """Terms of the parts' sizes: alpha and beta only ever occur as a product, so the
    group that terms join has six parameters and five dimensions."""
    sizes = sorted(r.p_size for r in table(s, d, "part").select("p_size").distinct().collect())
    terms = [{"alpha": k, "beta": k, f"own{k % 4}": 1} for k in sizes] + [{f"own{k}": k + 1} for k in range(4)]
    return s.createDataFrame([(list(g),) for g in graphs.redundant_coefficients(terms)], "parameters array<string>")


@query("sparse_columns", f"WITH {_H}, w AS (SELECT {_WIDE} FROM h GROUP BY anchor_time), m AS (SELECT {', '.join(f'(count(*) - count({t})) / count(*)::DOUBLE AS {t}' for t in TYPES)} FROM w), u AS (UNPIVOT m ON {', '.join(TYPES)} INTO NAME indicator_id VALUE x) SELECT indicator_id, CASE WHEN x > 0.001 THEN 'warned' ELSE 'passed' END AS outcome FROM u UNION ALL SELECT 'overall', CASE WHEN avg(x) > 0.001 THEN 'warned' ELSE 'passed' END FROM u")
def _(s, d):
    return panel.sparse(panel.sparsity(wide(s, d), TYPES), 0.001).select("indicator_id", "outcome")


@query("marginal_summaries", f"WITH {_PO}, x AS (SELECT param, value, row_number() OVER (PARTITION BY param ORDER BY value) AS i, count(*) OVER (PARTITION BY param) AS n FROM po), b AS (SELECT a.param, a.value AS low, c.value AS high FROM x a JOIN x c ON a.param = c.param AND c.i = a.i + floor(0.94 * a.n)), h AS (SELECT param, arg_min(low, (round(high - low, 9), low)) AS low, arg_min(high, (round(high - low, 9), low)) AS high FROM b GROUP BY 1) SELECT po.param, round(avg(value), 4) AS mean, count(*) AS n, any_value(low) AS low, any_value(high) AS high, 50::BIGINT AS bins FROM po JOIN h USING (param) GROUP BY 1")
def _(s, d):
    out = posterior.marginal_summaries(posterior_rows(s, d))
    return out.select("param", r("mean", 4).alias("mean"), "n", "low", "high", F.size("density").cast("long").alias("bins"))


# ---- sources and events ------------------------------------------------------------------


@query("as_utc", "SELECT event_id, date_trunc('second', ts)::TIMESTAMP - INTERVAL 2 HOUR AS a, date_trunc('day', ts)::TIMESTAMP AS b, strftime(ts, '%Y-%m-%d %H:%M:%S') AS c FROM events")
def _(s, d):
    zoned = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("+02:00"))
    return table(s, d, "events").select("event_id", as_utc(zoned, "string").alias("a"), as_utc(F.to_date("ts"), "date").alias("b"), strip_zone(zoned).alias("c"))


@query("read_sources", "SELECT o_orderkey, o_orderdate::TIMESTAMP AS timestamp, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS price, CASE WHEN o_orderkey % 2 = 1 THEN o_orderpriority END AS note FROM orders WHERE o_orderdate >= TIMESTAMP '1994-01-01' AND o_orderdate < TIMESTAMP '1997-06-01'")
def _(s, d):
    """Half of the orders as CSV, half as Parquet, with different columns."""
    o = table(s, d, "orders").withColumn("timestamp", F.col("o_orderdate"))
    a, b = f"{scratch(s, 'half')}.csv", f"{scratch(s, 'half')}.parquet"
    o.filter("o_orderkey % 2 = 0").select("o_orderkey", "timestamp", F.col("o_totalprice").alias("price")).write.csv(a, header=True)
    o.filter("o_orderkey % 2 = 1").select("o_orderkey", "timestamp", F.col("o_orderpriority").alias("note")).write.parquet(b)
    out = readers.read_sources(s, [a, b], "1994-01-01", "1997-06-01")
    return readers.project_to_sources(out, {"o_orderkey", "timestamp", "price", "note"}).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@query("prepare_data", """WITH o AS (SELECT o_custkey % 20 AS c, date_trunc('month', o_orderdate)::TIMESTAMP AS tick, sum(o_totalprice) AS v FROM orders WHERE o_orderdate >= TIMESTAMP '1994-02-01' AND o_orderdate < TIMESTAMP '1996-05-20' GROUP BY ALL),
g AS (SELECT c, unnest(generate_series(TIMESTAMP '1994-02-01', TIMESTAMP '1996-04-01', INTERVAL 1 MONTH)) AS tick FROM (SELECT DISTINCT c FROM o)) SELECT c, 'spent' AS indicator_id, round(v, 4) AS value, tick + INTERVAL 1 MONTH AS anchor_time, 'passed' AS undeclared FROM g LEFT JOIN o USING (c, tick)""")
def _(s, d):
    """From files to a stored panel and its findings: monthly sums between two dates."""
    path = f"{scratch(s, 'orders')}.parquet"
    table(s, d, "orders").select(F.col("o_orderdate").alias("timestamp"), (F.col("o_custkey") % 20).alias("c"), "o_totalprice", "o_orderstatus").write.parquet(path)
    out = actions.prepare_data(s, [path], [Variable("spent", aggregation="sum", window="1mo", column="o_totalprice")], ["c"], "1994-02-01", "1996-05-20", scratch(s, "store"))
    told = out.findings.filter("code = 'undeclared'").select("indicator_id", F.col("outcome").alias("undeclared"))
    return out.panel.join(told, "indicator_id").select("c", "indicator_id", r("value", 4).alias("value"), "anchor_time", "undeclared")


@query("artifact", "SELECT n_nationkey, n_name, true AS once FROM nation")
def _(s, d):
    """Written twice under its content's hash, which makes one table, and read with a check."""
    n, folder = table(s, d, "nation").select("n_nationkey", "n_name").coalesce(1), scratch(s, "store")
    one, two = (readers.write_artifact(n, folder, "nations", {"model": "r1"}) for _ in range(2))
    return readers.read_artifact(s, folder, one).withColumn("once", F.lit(one == two))


@query("panel_files", f"WITH {_OBS} SELECT user_id, indicator_id, round(value, 6) AS value, anchor_time FROM o WHERE indicator_id = 'errors'")
def _(s, d):
    path = scratch(s, "panel")
    readers.write_panel(indicators.prepare(events(s, d), FLAGSHIP, by=["user_id"], ties=["event_id"]), path)
    return rounded(s.read.parquet(path).filter("indicator_id = 'errors'").select("user_id", "indicator_id", "value", "anchor_time"), "value")


def _emitted(s: SparkSession, d: str) -> str:
    """A folder with an event of a worker for each nation, of two attempts, between a
    step and a snapshot each."""
    folder, out = scratch(s, "events"), []
    for a in ("a", "b"):
        out.append({"attempt_id": a, "event": "engine.step", "status": "running"})
    for n in sorted(table(s, d, "nation").collect(), key=lambda x: x.n_nationkey):
        out.append({"attempt_id": "ab"[n.n_nationkey % 2], "event": "engine.extraction.worker", "worker_id": n.n_nationkey % 9, "state": "completed" if n.n_regionkey == 0 else "running", "n_windows": n.n_nationkey})
    out.append({"attempt_id": "a", "event": "engine.extraction.snapshot", "total_workers": 9, "pending_workers": 0, "running_workers": 4, "completed_workers": 5, "failed_workers": 0})
    out.append({"attempt_id": "a", "event": "engine.step", "status": "done"})
    progress.emit(s, folder, out)
    return folder


_LAST = "e AS (SELECT ['a', 'b'][n_nationkey % 2 + 1] AS attempt_id, n_nationkey % 9 AS worker_id, CASE WHEN n_regionkey = 0 THEN 'completed' ELSE 'running' END AS state, n_nationkey AS k FROM nation), w AS (SELECT attempt_id, worker_id, arg_max(state, k) AS state FROM e GROUP BY ALL)"


@query("worker_states", f"WITH {_LAST} SELECT attempt_id, worker_id, state FROM w")
def _(s, d):
    """The stream of events, read until it ends, folded to each worker's last state."""
    folder = _emitted(s, d)
    return progress.run_once(progress.current_state(progress.read_events(s, folder)), scratch(s, "states")).select("attempt_id", "worker_id", "state")


@query("state_counts", f"WITH {_LAST} SELECT attempt_id, state, count(*) AS workers FROM w GROUP BY ALL")
def _(s, d):
    return progress.state_counts(progress.current_state(progress.events_after(s, _emitted(s, d), "a").unionByName(progress.events_after(s, _emitted(s, d), "b"))))


@query("progress", f"WITH {_LAST} SELECT attempt_id, CASE attempt_id WHEN 'a' THEN 'done' ELSE 'running' END AS status, CASE attempt_id WHEN 'a' THEN 5 ELSE 0 END::BIGINT AS completed, count(*) AS workers FROM w GROUP BY 1")
def _(s, d):
    out = progress.progress(s.read.schema(progress.EVENT).json(_emitted(s, d)).withColumn("cursor", F.col("_metadata.file_name")))
    return out.select("attempt_id", "status", F.coalesce("snapshot.completed_workers", F.lit(0)).alias("completed"), "workers")


@query("events_after_cursor", "SELECT count(*) - 12 AS events, true AS ordered FROM nation")
def _(s, d):
    """From the middle on, of both attempts, and swept afterwards up to nothing."""
    folder = _emitted(s, d)
    names = sorted(x.cursor for a in "ab" for x in progress.events_after(s, folder, a).filter("event LIKE '%worker'").select("cursor").collect())
    left = [x.worker_id for a in "ab" for x in progress.events_after(s, folder, a, names[11]).filter("event LIKE '%worker'").collect()]
    gone = progress.sweep(s, folder, int(names[0].split("-")[0]) / 1e9 - 1)
    return s.createDataFrame([(len(left), gone == 0)], "events long, ordered boolean")


@query("document_edits", "SELECT p_partkey, true AS restored, 'p' || p_partkey AS changed FROM part WHERE p_size > 25")
def _(s, d):
    """Each part as a document, its edit as a patch, and the patch applied again."""

    def one(key, size, brand):
        before = {"constructs": {"a": {"kind": "state", "size": size, "note": None}, "b": {"kind": "state"}}, "brand": brand}
        after = {"constructs": {"a": {"kind": "state", "size": size * 2, "note": "x"}}, "brand": None}
        patch = graphs.diff(before, after)
        return graphs.merge(before, patch) == after and patch["constructs"]["b"] is None and len(graphs.content_hash(after)) == 64

    def run(batches):
        for b in batches:
            yield b.assign(restored=[one(*x) for x in zip(b["p_partkey"].tolist(), b["p_size"].tolist(), b["p_brand"].tolist())])[["p_partkey", "restored"]]

    out = table(s, d, "part").filter("p_size > 25").select("p_partkey", "p_size", "p_brand").mapInPandas(run, "p_partkey long, restored boolean")
    return out.withColumn("changed", F.concat(F.lit("p"), "p_partkey"))
