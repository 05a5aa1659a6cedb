"""Windows, rules, fills, encodings and checks on literal rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tideline.functions.durations import Duration, parse_timestamp
from tideline.functions.rules import Rule, RuleError, columns_of
from tideline.operators import checks, compare, indicators, panel, text, windows
from tideline.schema import Variable
from tideline.sources import readers


def day(n, hour=0):
    return dt.datetime(2024, 1, n, hour)


@pytest.fixture(scope="module")
def readings(spark):
    """Two days with values (one has two), two with a null row, two without rows."""
    rows = [(day(13, 20), 5.0), (day(15, 4), None), (day(10, 6), 3.0), (day(13, 1), 1.0), (day(12, 9), None)]
    return spark.createDataFrame(rows, "timestamp timestamp_ntz, reading double")


N = None
#: Days 10 to 15, worked out by hand.
FILLS = [
    ("sum", None, None, [3, N, N, 6, N, N]),
    ("sum", "zero", None, [3, 0, 0, 6, 0, 0]),
    ("mean", None, None, [3, N, N, 3, N, N]),
    ("mean", "backward", None, [3, 3, 3, 3, N, N]),
    ("first", None, None, [3, N, N, 1, N, N]),
    ("first", "forward", None, [3, 3, 3, 1, 1, 1]),
    ("last", None, None, [3, N, N, 5, N, N]),
    ("last", "one", None, [3, 1, 1, 5, 1, 1]),
    ("last", -1.5, None, [3, -1.5, -1.5, 5, -1.5, -1.5]),
    ("last", "min", None, [3, 3, 3, 5, 3, 3]),
    ("last", "mean", None, [3, 4, 4, 5, 4, 4]),
    ("last", "max", None, [3, 5, 5, 5, 5, 5]),
    ("last", "backward", 1, [3, N, 5, 5, N, N]),
    ("last", "forward", 1, [3, 3, N, 5, 5, N]),
    ("last", "forward", 0, [3, N, N, 5, N, N]),
]


@pytest.mark.parametrize("aggregation,fill,limit,expected", FILLS)
def test_fills(readings, aggregation, fill, limit, expected):
    v = Variable("x", aggregation=aggregation, column="reading", fill=fill, fill_limit=limit)
    assert [r.value for r in indicators.compute(readings, [v]).orderBy("timestamp").collect()] == expected


def test_a_window_without_rows_differs_from_one_with_null_rows(readings):
    v = Variable("x", "count", "count", column="reading")
    assert [r.value for r in indicators.compute(readings, [v]).orderBy("timestamp").collect()] == [1, N, 0, 2, N, 0]


def test_windows_of_one_length_share_one_aggregation(readings):
    out = indicators.compute(readings, [Variable("a", column="reading"), Variable("b", aggregation="sum", column="reading"), Variable("gone", column="nothing")])
    assert {r.indicator_id for r in out.select("indicator_id").distinct().collect()} == {"a", "b"}


@pytest.mark.parametrize(
    "window,ts,expected",
    [
        ("1mo", "2023-07-31 23:59:59", "2023-07-01"),
        ("5mo", "2023-07-31 23:59:59", "2023-05-01"),
        ("4y", "2023-07-31 00:00:00", "2022-01-01"),
        ("5d", "1970-01-13 01:00:00", "1970-01-11"),
        ("2w", "1970-01-20 01:00:00", "1970-01-19"),
        ("1y3mo", "1971-05-02 00:00:00", "1971-04-01"),
    ],
)
def test_window_starts(spark, window, ts, expected):
    got = spark.range(1).select(Duration.parse(window).floor(F.lit(ts).cast("timestamp_ntz")).alias("t")).first().t
    assert got == dt.datetime.fromisoformat(expected) == Duration.parse(window).floor_at(dt.datetime.fromisoformat(ts))


@pytest.mark.parametrize("bad", ["", "1", "d", "0d", "1d2h", "1mo3d", "-1d"])
def test_bad_durations(bad):
    with pytest.raises(ValueError):
        Duration.parse(bad)


@pytest.mark.parametrize("bad", ["value", "sum(mean(x))", "sum(x) + sum(y)", "2 / sum(x)", "any(x)", "open('f')", "sum(x).y", "sum(x) if y else 0", "sum(x) if y > 0 else None", "sum(x) if max(min(x)) > 0 else None", "sum(x, y)", "sum(unknown)", "sum(x if x is 3 else 0)", "coalesce(x)"])
def test_illegal_rules(spark, bad):
    with pytest.raises(RuleError):
        Rule(bad, ["x", "y", "value"]).column(F.col("x"))


def test_columns_of_rules():
    assert columns_of('mean(a if b == "x" else None) if max(c) > 1 else None') == ["a", "b", "c"]


@pytest.mark.parametrize("rule,expected", [("count_true(not x > 1)", 2), ("sum(x / 0)", None), ("sum(x % -3)", -3.0), ("sum(x) if any(x > 9) else None", None), ("sum(x) if all(x > 0) else None", None)])
def test_null_semantics(spark, rule, expected):
    rows = spark.createDataFrame([(1, 1.0), (2, None), (3, 2.0)], "t int, x double")
    assert rows.agg(Rule(rule, ["x"]).column(F.col("t")).alias("v")).first().v == expected


def test_variable_legality():
    for wrong in [dict(dtype="ordinal", aggregation="mean", levels=("a", "b")), dict(dtype="binary"), dict(levels=("a", "b")), dict(dtype="ordinal", aggregation="last", levels=("a", "a")), dict(fill_limit=1), dict(aggregation="last", window="1mo")]:
        with pytest.raises(ValueError):
            Variable("x", **wrong)


def test_encoding(spark):
    rows = spark.createDataFrame([("b", "Yes"), ("b", "0.0"), ("b", "maybe"), ("o", " High "), ("o", "1"), ("o", "3"), ("o", "0.5"), ("c", "1e3"), ("c", "x")], "indicator_id string, value string")
    out = indicators.encode(rows, [Variable("b", "binary", "last"), Variable("o", "ordinal", "last", levels=("low", "medium", "high")), Variable("c")])
    assert [r.value for r in out.collect()] == [1.0, 0.0, None, 2.0, 1.0, None, None, 1000.0, None]


def test_annotation_of_mixed_windows(spark):
    ends = {"5mo": dt.datetime(2000, 8, 1), "4y": dt.datetime(2004, 3, 1), "36h": dt.datetime(2000, 3, 2, 12), "3w": dt.datetime(2000, 3, 22)}
    rows = spark.createDataFrame([(k, 1.0, dt.datetime(2000, 3, 1)) for k in ends], "indicator_id string, value double, timestamp timestamp_ntz")
    out = {r.indicator_id: r.support_end for r in indicators.annotate(rows, [Variable(k, window=k) for k in ends]).collect()}
    assert out == ends
    with pytest.raises(Exception, match="unknown variable: 3w"):
        indicators.annotate(rows, [Variable(k, window=k) for k in list(ends)[:3]]).collect()


def test_timestamp_formats(spark):
    texts = ["2024-01-02 03:04:05", "2024-01-02T03:04:05.25", "2024-01-02", "2024-01-02T03:04:05+01:00", "nonsense"]
    got = [r.t for r in spark.createDataFrame([(x,) for x in texts], "x string").select(parse_timestamp(F.col("x")).alias("t")).collect()]
    assert got == [dt.datetime(2024, 1, 2, 3, 4, 5), dt.datetime(2024, 1, 2, 3, 4, 5, 250000), dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 2, 2, 4, 5), None]


def test_sources(spark, tmp_path):
    a, b = tmp_path / "a.csv", tmp_path / "b.csv"
    a.write_text("timestamp,score\n2024-01-01T00:00:00,1\n")
    b.write_text("timestamp,score,text\n2024-01-02T00:00:00,2.5,hi\n2024-01-03T00:00:00,,\n")
    out = readers.read_sources(spark, [str(a), str(b)], start="2024-01-01", end="2024-01-03")
    assert out.columns == ["timestamp", "score", "text"] and [r.score for r in out.orderBy("timestamp").collect()] == [1.0, 2.5]
    a.write_text("date,score\n2024-01-01,1\n")
    for wrong in (str(a), str(tmp_path / "x.zip")):
        with pytest.raises(readers.SourceError):
            readers.read_sources(spark, [wrong])
    assert readers.captured_files(spark, str(tmp_path)).count() == 2


def test_point_changes_are_symmetric(spark):
    at = lambda rows: spark.createDataFrame([("x", day(d), v) for d, v in rows], "indicator_id string, anchor_time timestamp_ntz, value double")
    a, b = at([(1, 1.0), (2, None), (3, 3.0)]), at([(1, 1.0), (2, 4.0), (4, 8.0)])
    there = {(r.anchor_time, r.change) for r in compare.point_changes(a, b).collect()}
    back = {(r.anchor_time, r.change) for r in compare.point_changes(b, a).collect()}
    assert there == {(day(2), "revised"), (day(3), "removed"), (day(4), "added")}
    swap = {"added": "removed", "removed": "added", "revised": "revised"}
    assert back == {(t, swap[c]) for t, c in there}


def test_findings(spark):
    v = "indicator_id string, value double, anchor_time timestamp_ntz, support_start timestamp_ntz, support_end timestamp_ntz"
    rows = [("a", float(i), day(1 + i), day(1 + i), day(2 + i)) for i in range(12)] + [("b", 1.0, day(1 + i), day(1 + i), day(2 + i)) for i in range(3)]
    out = {(r.indicator_id, r.code): r.outcome for r in checks.findings(spark.createDataFrame(rows, v), [Variable("a"), Variable("gone")]).collect()}
    assert out["a", "arithmetic_sequence"] == "failed" and out["a", "sample_size"] == "passed"
    assert out["b", "undeclared"] == "failed" and out["b", "variance"] == "failed" and out["gone", "missing"] == "failed"


def test_findings_of_ranges_and_timestamps(spark):
    v = "indicator_id string, value double, anchor_time string, support_start timestamp_ntz, support_end timestamp_ntz"
    at = lambda i, text=None: (text or day(1 + i).isoformat(), day(1 + i), day(2 + i))
    rows = [(k, float(i % 7) if i or k == "few" else far, *at(i)) for k, far in (("in", 3.0), ("out", 99.0)) for i in range(12)]
    rows += [("few", 99.0 if i == 0 else float(i), *at(i)) for i in range(9)]
    rows += [("half", float(i), *at(i, "nonsense" if i % 2 else None)) for i in range(4)]
    rows += [("lost", float(i), *at(i, "nonsense" if i else None)) for i in range(4)] + [("nulls", None, *at(i, "nonsense")) for i in range(2)]
    found = checks.findings(spark.createDataFrame(rows, v), [Variable(k) for k in ("in", "out", "few", "half", "lost", "nulls", "gone")])
    out = {(r.indicator_id, r.code): (r.outcome, r.evidence) for r in found.collect()}
    assert out["out", "dtype_violation"] == ("failed", 1.0)
    assert out["in", "dtype_violation"][0] == out["few", "dtype_violation"][0] == "passed" and out["gone", "dtype_violation"][0] == "not_evaluated"
    assert out["in", "timestamps"][0] == out["half", "timestamps"][0] == "passed" and out["gone", "timestamps"][0] == "not_evaluated"
    assert out["lost", "timestamps"] == ("failed", 3.0) and out["nulls", "timestamps"] == ("failed", 2.0)


def test_window_scores_count_every_row(spark):
    """A window of more than a million rows, an empty one, and pieces smaller than a window."""
    rows = spark.range(1_200_000).select("id", F.when(F.col("id") % 3 == 0, "error").otherwise("view").alias("kind"), F.lit(day(1)).cast("timestamp_ntz").alias("timestamp"))
    rows = rows.union(spark.range(1).select("id", F.lit("error"), F.lit(day(3)).cast("timestamp_ntz")))
    count = lambda t: t.str.count(r"  error(?=\n|$)").astype("float64")
    out = text.score_pieces(rows, ["kind"], "1d", count, "errors", ties=["id"])
    assert [(r.indicator_id, r.value, r.timestamp) for r in out.orderBy("timestamp").collect()] == [("errors", 400_000.0, day(1)), ("errors", None, day(2)), ("errors", 1.0, day(3))]
    some = rows.filter("id < 50")
    one, small = ({r.timestamp: r.value for r in text.score_pieces(some, ["kind"], "1d", count, "errors", piece=k).collect()} for k in (1000, 3))
    assert one == small == {day(1): 17.0, day(2): None, day(3): 1.0}
    unread = text.score_pieces(some, ["kind"], "1d", lambda t: count(t).where(count(t) > 0), "errors", piece=1)
    assert {r.timestamp: r.value for r in unread.collect()} == {day(1): None, day(2): None, day(3): 1.0}


def test_overlap_finds_each_pair_once(spark):
    s = spark.createDataFrame([(1, day(1), day(9)), (2, day(3), day(4))], "j int, left timestamp_ntz, right timestamp_ntz")
    w = spark.createDataFrame([(1, day(2), day(8))], "k int, start timestamp_ntz, end timestamp_ntz")
    assert sorted((r.j, r.overlap) for r in panel.overlap(w, s, 86400).collect()) == [(1, 6 * 86400), (2, 86400)]


def test_empty_source(spark):
    none = spark.createDataFrame([], "timestamp timestamp_ntz, reading double")
    assert windows.ticks(none, Duration.parse("1d")).count() == 0
    with pytest.raises(readers.SourceError):
        readers.checked(none)
