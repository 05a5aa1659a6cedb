"""Operators against definitions worked out by hand or written plainly in numpy."""

import datetime as dt
import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.functions import laws
from tideline.functions.durations import Duration
from tideline.operators import checks, compare, histories, indicators, posterior, preflight, text, validation, windows
from tideline.schema import Variable
from tideline.sources import readers


def day(n, hour=0):
    return dt.datetime(2024, 1, n, hour)


def test_the_grid_spans_start_to_end(spark):
    """Readings on the 5th and 6th, dates from the 3rd to the 9th: six days."""
    rows = spark.createDataFrame([(day(5, 7),), (day(6, 9),)], "timestamp timestamp_ntz")
    got = lambda **k: [r.tick.day for r in windows.ticks(rows, Duration.parse("1d"), **k).orderBy("tick").collect()]
    assert got(start="2024-01-03", end="2024-01-09") == [3, 4, 5, 6, 7, 8]
    assert got(start="2024-01-03") == [3, 4, 5, 6] and got(end="2024-01-08T12:00:00") == [5, 6, 7]
    assert got(start="2024-01-05T01:00:00", end="2024-01-06T23:00:00") == [] == got(start="2024-01-09", end="2024-01-08")
    out = indicators.compute(rows.withColumn("x", F.lit(1.0)), [Variable("n", "count", "count", column="x")], start="2024-01-03", end="2024-01-09")
    assert [r.value for r in out.orderBy("timestamp").collect()] == [None, None, 1, 1, None, None]


@pytest.mark.parametrize("n", [29, 30, 34, 57, 101, 1000])
def test_shown_rows_of_a_long_window(spark, n):
    """30 of n rows: 10 at each end and the middles of 10 even slots between."""
    slot, shown = (n - 20) / 10, set(range(10)) | set(range(n - 10, n))
    for i in range(10):
        a, b = int(i * slot), int((i + 1) * slot)
        shown.add(10 + (a if b <= a else (a + b - 1) // 2))
    rows = spark.range(n).select("id", F.lit(1).alias("g"))
    got = {r.id for r in compare.boundary_sample(rows, ["g"], ["id"], 30).collect()}
    assert got == (shown if n > 30 else set(range(n)))


def test_window_text(spark):
    rows = spark.createDataFrame([(day(1, 9), "b", None), (day(1, 8), "a", 1.5), (day(3), "c", None)], "timestamp timestamp_ntz, kind string, x double")
    out = {r.tick.day: r.text for r in text.window_text(rows, ["kind", "x"], "1d").collect()}
    assert out == {1: "## Window Start: 2024-01-01T00:00:00\n\n08:00  a, 1.5\n09:00  b", 2: None, 3: "## Window Start: 2024-01-03T00:00:00\n\n00:00  c"}
    many = spark.range(40).select(F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, id)").alias("timestamp"), "id")
    lines = text.window_text(many, ["id"], "1d", most=30).first().text.split("\n")
    assert lines[2] == "(showing 30 of 40 events, sampled)" and len(lines) == 33


@pytest.mark.parametrize("n", [30, 50, 110])
def test_rank_histogram(spark, n):
    """Ranks lie in even bins from 1 to n + 1."""
    x = np.random.default_rng(n).normal(size=n)
    x[1] = x[0]
    order = np.argsort(x)
    rank = np.empty(n)
    rank[order] = np.arange(1, n + 1)
    rank[[0, 1]] = rank[[0, 1]].mean()
    want = np.histogram(rank, bins=20, range=(1, n + 1))[0]
    got = posterior.rank_histogram(spark.createDataFrame([("p", 0, i, float(v)) for i, v in enumerate(x)], "param string, chain int, draw int, value double")).collect()
    assert {r.bin: r["count"] for r in got} == {i + 1: c for i, c in enumerate(want) if c}


def paths(spark, x):
    return spark.createDataFrame([(d, float(t), float(v)) for d, row in enumerate(x) for t, v in enumerate(row)], "draw int, time double, value double")


def test_confinement(spark):
    x = np.ones((2, 8))
    x[0, 3] = np.inf
    out = posterior.confinement(paths(spark, x)).first()
    assert (out.nonfinite_share, out.escaped_share, out.onset) == (1 / 16, 0.5, 3.0)
    still = np.zeros((4, 11))
    still[0, 9], still[1, 3], still[2, -1] = 1e-6, 5.0, 1e-10  # n // 4 places: 2 to 3, and 9 to 10
    assert posterior.confinement(paths(spark, still)).first().escaped_share == 0.25
    assert posterior.confinement(paths(spark, np.ones((2, 3)))).first().escaped_share is None


def test_an_edge_moves_a_state_that_stands_still(spark):
    on, off = np.full((3, 9), 2.0), np.full((3, 9), 2.0)
    off[0] += np.arange(9)
    off[1] += np.arange(9)
    assert posterior.edge_overwhelm(paths(spark, on), paths(spark, off)).first().share == math.inf
    assert posterior.edge_overwhelm(paths(spark, on[2:]), paths(spark, off[2:])).first().share == 0.0


def test_wording(spark):
    said = [("number of steps", "sum", False), ("number of steps", "mean", True), ("Average pace", "last", True), ("average pace", "mean", False), ("total cost", "count", False), ("total cost", "first", True), ("most recent", "sum", True), ("most recent", "last", False), ("summary", "mean", False)]
    rows = spark.createDataFrame(said, "words string, op string, expected boolean")
    assert all(r.c == r.expected for r in rows.select(checks.wording_conflict(F.col("words"), F.col("op")).alias("c"), "expected").collect())


def test_duplicates_of_codes_count_and_those_of_counts_do_not(spark):
    rows = [(k, float(v), day(1 + i), day(1 + i), day(2 + i)) for k in ("o", "c") for i, v in enumerate([1] * 9 + [0, 2, 0])]
    df = spark.createDataFrame(rows, "indicator_id string, value double, anchor_time timestamp_ntz, support_start timestamp_ntz, support_end timestamp_ntz")
    out = {r.indicator_id: r.outcome for r in checks.findings(df, [Variable("o", "ordinal", "last", levels=("a", "b", "c")), Variable("c", "count", "count")]).collect() if r.code == "duplicate_values"}
    assert out == {"o": "failed", "c": "passed"}


def test_quantiles_of_many_ranges(spark):
    """Heavy tails put nearly all values into one range; ranks stay exact."""
    x = np.sort(np.round(np.random.default_rng(3).standard_cauchy(5000), 2))
    df = spark.createDataFrame([("a", float(v)) for v in x] + [("b", 7.0)] * 3 + [("c", None)], "indicator_id string, value double")
    out = {r.indicator_id: r for r in checks.empirical_profile(df).collect()}
    assert [out["a"][k] for k in ("n", "min", "q25", "q50", "q75", "max")] == [5000, x[0], x[round(0.25 * 4999)], x[2500], x[round(0.75 * 4999)], x[-1]]
    assert (out["b"].q25, out["b"].n, out["c"].n, out["c"].q50) == (7.0, 3, 0, None)


def test_effective_sizes_and_errors_as_numpy_has_them(spark):
    rng = np.random.default_rng(8)
    x = np.zeros((4, 300))
    for t in range(1, 300):
        x[:, t] = 0.6 * x[:, t - 1] + rng.normal(size=4)
    out = posterior.ess(spark.createDataFrame([("p", c, i, float(v)) for c in range(4) for i, v in enumerate(x[c])], "param string, chain int, draw int, value double")).first()
    halves = x.reshape(8, 150)
    m, n = halves.shape
    centred = halves - halves.mean(1, keepdims=True)
    acov = np.array([[np.dot(r[: n - t], r[t:]) / (n - 1) for t in range(n)] for r in centred]).mean(0)
    within = acov[0]
    var = within * (n - 1) / n + halves.mean(1).var(ddof=1)
    rho = 1 - (within - acov) / var
    rho[0], tau, last, t = 1, -1.0, np.inf, 0
    while t + 1 < n and (pair := rho[t] + rho[t + 1]) > 0:
        last = min(last, pair)
        tau, t = tau + 2 * last, t + 2
    assert abs(out.ess - m * n / tau) < 1e-6 * out.ess and abs(out.mcse - x.std(ddof=1) / math.sqrt(out.ess)) < 1e-9


def test_smoothed_weights(spark):
    """Points whose weights have no tail to smooth give the plain importance estimate."""
    ll = np.log(np.random.default_rng(4).uniform(0.2, 0.9, 16))
    out = posterior.psis_loo(spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(ll)], "point long, draw int, log_lik double")).first()
    assert abs(out.elpd - math.log(1 / np.mean(1 / np.exp(ll)))) < 1e-9 and out.outcome == "not_evaluated"


def test_the_worst_coordinate(spark):
    rng = np.random.default_rng(2)
    rows = [(s, t, c, i, float(v + (2 * c if (s, t) == ("u", 1) else 0))) for s in "uv" for t in range(2) for c in range(3) for i, v in enumerate(rng.normal(size=60))]
    rows += [("w", 0, 0, i, 1.0) for i in range(60)] + [("w", 0, 1, i, float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "state string, time int, chain int, draw int, value double")
    out = {r.state: r for r in posterior.latent_worst(df).collect()}
    one = {t: r for t in (0, 1) for r in posterior.rank_diagnostics(df.filter(f"state = 'u' AND time = {t}").withColumn("param", F.lit("x"))).collect()}
    assert out["u"].rhat == max(o.rhat for o in one.values()) > 1.2 > out["v"].rhat and out["u"].coordinates == 2
    assert out["u"].ess_bulk == min(o.ess_bulk for o in one.values()) and (out["w"].rhat, out["w"].ess_bulk) == (None, 0.0)


def test_laws_sum_to_one(spark):
    k = spark.range(400).select(F.col("id").cast("double").alias("x"))
    total = lambda law, **p: k.agg(F.sum(F.exp(laws.log_density(law, F.col("x"), **p)))).first()[0]
    assert abs(total("Poisson", rate=7.5) - 1) < 1e-9 and abs(total("NegativeBinomial2", mean=6, concentration=2.5) - 1) < 1e-9
    assert abs(total("OrderedLogistic", predictor=0.3, cutpoints=[-1.0, 0.5, 2.0]) - 1) < 1e-9 and abs(total("Categorical", logits=[0.1, 2.0, -1.0]) - 1) < 1e-9
    x = spark.range(1, 20000).select((F.col("id") / 2000).alias("x"))
    area = lambda law, **p: x.agg(F.sum(F.exp(laws.log_density(law, F.col("x"), **p)) / 2000)).first()[0]
    assert abs(area("Gamma", concentration=2.5, rate=3.0) - 1) < 1e-4 and abs(area("Beta", concentration1=2.5, concentration0=3.0) - 1) < 1e-4
    assert abs(area("Normal", loc=5, scale=0.7) - 1) < 1e-4 and abs(area("StudentT", df=30, loc=5, scale=0.3) - 1) < 1e-4


def test_special_functions(spark):
    points = [0.01, 0.5, 1.0, 1.5, 3.2, 10.0, 170.0, 1e6]
    got = spark.createDataFrame([(p,) for p in points], "x double").select(laws.lgamma(F.col("x"))).collect()
    assert all(abs(r[0] - math.lgamma(p)) <= 1e-12 * max(1, abs(math.lgamma(p))) + 1e-12 for r, p in zip(got, points))
    z = [-30.0, -6.0, -4.0, -3.999, -1.0, 0.0, 0.3, 2.0, 4.0, 5.5, 9.0]
    got = spark.createDataFrame([(p,) for p in z], "x double").select(laws.normal_cdf(F.col("x"))).collect()
    assert all(abs(r[0] - statistics.NormalDist().cdf(p)) < 1e-12 for r, p in zip(got, z))
    u = [1e-9, 0.001, 0.2, 0.5, 0.77, 0.99999]
    got = spark.createDataFrame([(p,) for p in u], "x double").select(laws.normal_quantile(F.col("x"))).collect()
    assert all(abs(r[0] - statistics.NormalDist().inv_cdf(p)) < 1e-7 for r, p in zip(got, u))


def test_moments_and_priors(spark):
    m = lambda law, **p: spark.range(1).select(*laws.mean_variance(law, **p)).first()
    assert tuple(m("Gamma", concentration=3, rate=2)) == (1.5, 0.75) and tuple(m("NegativeBinomial2", mean=4, concentration=2)) == (4, 12)
    assert tuple(m("StudentT", df=1.5, loc=2, scale=1)) == (2, None) and tuple(m("Beta", concentration1=1, concentration0=1)) == (0.5, 1 / 12)
    q = spark.range(1).select(laws.prior_quantile("TruncatedNormal", 0.5, mu=0, sigma=1, lower=-1, upper=1), laws.prior_quantile("HalfNormal", 0.5, sigma=2), laws.interval_effect_to_rate(1.0, math.log(2), 1)).first()
    assert abs(q[0]) < 1e-9 and abs(q[1] - 2 * statistics.NormalDist().inv_cdf(0.75)) < 1e-7 and abs(q[2] - 2 * math.log(2)) < 1e-12


def test_variates_are_even_and_stay(spark):
    u = lambda n: [r[0] for r in spark.range(0, 4000, 1, n).select(laws.variate(F.lit("key"), F.col("id"))).collect()]
    one = u(1)
    assert one == u(7) and 0 < min(one) < max(one) < 1
    assert max(abs(np.sort(one) - np.linspace(0, 1, 4000))) < 0.03


def test_rows_that_break_rules_are_refused(spark):
    rows = spark.createDataFrame([("a", 1.0, day(2), "interval", "mean", "support_end", "1d", day(1), day(2))], "indicator_id string, value double, anchor_time timestamp_ntz, support_kind string, summary_operator string, anchor_policy string, observation_window string, support_start timestamp_ntz, support_end timestamp_ntz")
    assert validation.validated(rows, [Variable("a", window="24h")]).count() == 1
    with pytest.raises(validation.ValidationError, match="unknown_indicator"):
        validation.validated(rows, [Variable("b")])
    with pytest.raises(validation.ValidationError, match="nonfinite_value: 1 rows"):
        validation.validated(rows.withColumn("value", F.lit(float("inf"))), [Variable("a")])


def test_window_of_a_question(spark):
    panel = spark.createDataFrame([(day(3), day(2), day(10))], "anchor_time timestamp_ntz, support_start timestamp_ntz, support_end timestamp_ntz")
    q = spark.createDataFrame([(k, day(d), s) for k, d, s in (("a", 1, 60), ("b", 4, 86400), ("c", 9, 10 * 86400), ("d", 12, 5))], "question string, start timestamp_ntz, seconds long")
    out = {r.question: (r.outcome, r.place) for r in preflight.question_windows(q, panel, F.col("anchor_time")).collect()}
    assert out == {"a": ("failed", "before"), "b": ("passed", "inside"), "c": ("passed", "past_end"), "d": ("passed", "after")}


def test_cells_without_finite_values_are_refused(spark):
    cells = spark.createDataFrame([(0, 1.0, "a", float("nan"), False, 0.0, 1.0), (0, 2.0, "a", 3.0, True, 1.0, 2.0), (1, 1.0, "a", float("nan"), True, 0.0, 1.0)], "draw int, time double, indicator_id string, value double, observed boolean, start double, end double")
    layout = spark.createDataFrame([("a", "point")], "indicator_id string, support_kind string")
    origin = F.lit(day(1)).cast("timestamp_ntz")
    assert [(r.value, r.anchor_time) for r in histories.emissions(cells, layout, 0, origin).orderBy("anchor_time").collect()] == [(None, day(2)), (3.0, day(3))]
    with pytest.raises(Exception, match="isn't finite"):
        histories.emissions(cells, layout, 1, origin).collect()


def test_a_changed_table_is_noticed(spark, tmp_path):
    folder = tmp_path.as_uri()
    one = readers.write_artifact(spark.range(5).coalesce(1), folder, "t")
    assert readers.write_artifact(spark.range(5).coalesce(1), folder, "t") == one != readers.write_artifact(spark.range(5).coalesce(1), folder, "t", {"model": "x"})
    assert readers.read_artifact(spark, folder, one).count() == 5
    next((tmp_path / "blobs" / one).glob("part-*.parquet")).unlink()
    with pytest.raises(readers.SourceError):
        readers.read_artifact(spark, folder, one)


def test_identity_is_of_the_content(spark, tmp_path):
    folder = tmp_path.as_uri()
    rows = [(i % 7, None if i % 5 == 0 else f"n{i % 3}") for i in range(40)]
    write = lambda r, n: readers.write_artifact(spark.createDataFrame(r, "k int, v string").repartition(n), folder, "t")
    assert write(rows, 1) == write(rows[::-1], 3) == write(rows, 5)
    assert len({write(rows, 1), write(rows[1:], 1), write(rows + rows[:1], 1), write([*rows[1:], (0, "")], 1)}) == 4
    assert len(list((tmp_path / "blobs").iterdir())) == 4


def test_content_hash_tells_values_apart(spark):
    of = lambda sql: readers.content_hash(spark.sql(f"SELECT {sql}"))
    kinds = ["1 AS a", "1L AS a", "1 AS b", "CAST(NULL AS int) AS a", "'null' AS a", "'' AS a", "CAST(NULL AS string) AS a", "X'00' AS a", "X'' AS a", "0D AS a", "-0D AS a", "CAST('NaN' AS double) AS a"]
    kinds += ["timestamp'2024-01-01 00:00:00.000001Z' AS a", "timestamp'2024-01-01 00:00:00.000002Z' AS a", "timestamp_ntz'2024-03-31 02:30:00' AS a", "timestamp_ntz'2024-03-31 03:30:00' AS a", "date'2024-01-01' AS a"]
    kinds += ["array('a,b') AS a", "array('a', 'b') AS a", "array('b', 'a') AS a", "CAST(NULL AS struct<x:int>) AS a", "CAST(named_struct('x', NULL) AS struct<x:int>) AS a", "map('a', 1, 'b', 2) AS a", "map('a', 2, 'b', 1) AS a", "1 AS `x.y`, 2 AS `z``w`", "2 AS `x.y`, 1 AS `z``w`"]
    assert len({of(k) for k in kinds}) == len(kinds)
    assert of("map('a', 1, 'b', 2) AS a") == of("map('b', 2, 'a', 1) AS a")


@pytest.mark.parametrize("value", [0.0, -3.5, 2.0**60])
def test_histogram_of_a_point(spark, value):
    rows = spark.createDataFrame([("a", value)] * 10 + [("a", None), ("a", float("nan"))], "g string, value double")
    # 4 bins, of which the third begins at the middle.
    assert [tuple(r) for r in compare.histogram(rows, ["g"]).collect()] == [("a", 3, 10)]


def test_statistics_are_binned_within_their_own_ends(spark):
    """Draws that come out otherwise each time they are computed, as sums in another order do."""

    def noise(batches):
        import os

        for b in batches:
            yield b.assign(value=[int.from_bytes(os.urandom(4)) / 2**32 for _ in range(len(b))])

    ids = spark.range(400).selectExpr("'a' AS indicator_id", "id % 40 AS draw", "0D AS value")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        got = compare.statistic_histograms(ids.mapInPandas(noise, ids.schema)).toPandas()
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    ends = got.groupby("statistic").agg(low=("bin", "min"), high=("bin", "max"), n=("count", "sum"))
    assert ends.values.tolist() == [[1, 12, 40]] * 4


def test_empty_sides_are_refused(spark):
    schema = "history string, indicator_id string, anchor_time timestamp_ntz, support_start timestamp_ntz, support_end timestamp_ntz, value double"
    one, none = spark.createDataFrame([("h", "a", day(1), day(1), day(1), 1.0)], schema), spark.createDataFrame([], schema)
    known = spark.createDataFrame([("h", "a", "d", "continuous")], "history string, indicator_id string, definition string, dtype string")
    for left, right in ((one, none), (none, one), (one, one)):
        with pytest.raises(ValueError):
            compare.compared(left, right, known)
