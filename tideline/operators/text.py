"""Windows of raw rows as text, and pluggable scoring of each window."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.durations import Duration
from tideline.operators.compare import boundary_sample
from tideline.operators.windows import ticks

PIECE_ROWS = 4096


def _lines(rows: DataFrame, by: list[str], columns: list[str], time: str, ties: list[str] | None) -> DataFrame:
    """(*by, l, shown): the rows' lines by time, and how many."""
    line = F.concat(F.date_format(time, "HH:mm"), F.lit("  "), F.concat_ws(", ", *[F.col(c).cast("string") for c in columns]))
    return rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col(time).alias("t"), *[F.col(c).cast("string").alias(f"k{i}") for i, c in enumerate(ties or columns)], line.alias("line")))).alias("l"), F.count("*").alias("shown"))


def window_text(raw: DataFrame, columns: list[str], window: str, time: str = "timestamp", most: int = 300, ties: list[str] | None = None) -> DataFrame:
    """(tick, n, text): each window's rows as lines "HH:MM  v1, v2" below a heading;
    long windows show their first, last and evenly spaced rows, after a note that
    says so; empty ones have no text."""
    w = Duration.parse(window)
    rows = raw.withColumn("tick", w.floor(F.col(time)))
    shown = boundary_sample(rows, ["tick"], [time, *(ties or columns)], most)
    lines = _lines(shown, ["tick"], columns, time, ties)
    total = rows.groupBy("tick").agg(F.count("*").alias("n"))
    body = F.concat_ws("\n", F.transform("l", lambda x: x["line"]))
    head = F.concat(F.lit("## Window Start: "), F.date_format("tick", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("\n\n"))
    note = F.when(F.col("n") > F.col("shown"), F.concat(F.lit("(showing "), F.col("shown").cast("string"), F.lit(" of "), F.col("n").cast("string"), F.lit(" events, sampled)\n"))).otherwise("")
    out = lines.join(total, "tick").select("tick", "n", F.concat(head, note, body).alias("text"))
    return ticks(raw, w, time=time).join(out, "tick", "left").select("tick", F.coalesce("n", F.lit(0)).alias("n"), "text")


def score_windows(windows: DataFrame, scorer: Callable[[pd.Series], pd.Series], indicator_id: str) -> DataFrame:
    """(indicator_id, value, timestamp): the scorer sees texts in batches; windows
    without text get null without being scored, and so does what the scorer can't read."""

    def run(batches):
        for pdf in batches:
            value = pd.Series([None] * len(pdf), dtype="float64")
            some = pdf["text"].notna()
            if some.any():
                value[some.to_numpy()] = scorer(pdf.loc[some, "text"]).to_numpy(dtype="float64")
            yield pd.DataFrame({"indicator_id": indicator_id, "value": value, "timestamp": pdf["tick"]})

    return windows.select("tick", "text").mapInPandas(run, "indicator_id string, value double, timestamp timestamp_ntz")


def score_pieces(raw: DataFrame, columns: list[str], window: str, scorer: Callable[[pd.Series], pd.Series], indicator_id: str, time: str = "timestamp", ties: list[str] | None = None, piece: int = PIECE_ROWS) -> DataFrame:
    """(indicator_id, value, timestamp) of every window, for scorers whose scores of
    parts add up: all rows are scored, in pieces of a window of at most `piece` rows
    as they are read. Empty windows get null, and so do those with an unread piece."""
    w = Duration.parse(window)
    # The id is a row's place in its input task: no window's rows come together.
    rows = raw.withColumn("tick", w.floor(F.col(time))).withColumn("piece", F.floor(F.monotonically_increasing_id() / piece))
    texts = _lines(rows, ["tick", "piece"], columns, time, ties).select("tick", F.concat_ws("\n", F.transform("l", lambda x: x["line"])).alias("text"))
    scores = score_windows(texts, scorer, indicator_id).groupBy(F.col("timestamp").alias("tick"))
    value = F.when(F.count("value") == F.count("*"), F.sum("value")).alias("value")
    return ticks(raw, w, time=time).join(scores.agg(value), "tick", "left").select(F.lit(indicator_id).alias("indicator_id"), "value", F.col("tick").alias("timestamp"))


def row_filter(rows: DataFrame, words: str) -> DataFrame:
    """Rows whose JSON holds the words, in any case."""
    return rows.filter(F.contains(F.lower(F.to_json(F.struct("*"))), F.lit(words.lower())))
