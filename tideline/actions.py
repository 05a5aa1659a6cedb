"""What a user calls: from raw files to a checked panel, edits of documents, and
comparisons. Each action puts operators together and keeps none of its own logic."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tideline.functions.rules import columns_of
from tideline.operators import checks, compare, graphs, indicators
from tideline.schema import Variable
from tideline.sources import readers


@dataclass(frozen=True)
class Prepared:
    """A panel of observation rows, its findings, and, if it was stored, its identity."""

    panel: DataFrame
    findings: DataFrame
    identity: str | None = None


def prepare_data(spark: SparkSession, paths: list[str], variables: list[Variable], by: list[str] | None = None, start: str | None = None, end: str | None = None, store: str | None = None) -> Prepared:
    """Reads CSV and Parquet files, computes the variables over the windows between
    start and end, and checks the result. store: a folder that keeps the panel under
    the hash of its content."""
    by = by or []
    needed = {"timestamp", *by}.union(*(columns_of(v.rule) if v.rule else [v.column] for v in variables))
    raw = readers.project_to_sources(readers.read_sources(spark, paths, start, end), needed)
    panel = indicators.prepare(raw, variables, by=by, start=start, end=end)
    identity = None
    if store:
        identity = readers.write_artifact(panel, store, "panel")
        panel = readers.read_artifact(spark, store, identity)
    return Prepared(panel, checks.findings(panel, variables), identity)


def edit_question(question: dict, patch: dict) -> dict:
    """The edited question; it keeps an outcome."""
    out = graphs.merge(question, patch)
    if not out.get("outcome"):
        raise ValueError("a question needs an outcome")
    return out


def edit_model(model: dict, patch: dict) -> dict:
    """The edited model without what the edit has orphaned."""
    return graphs.without_orphans(graphs.merge(model, patch))


def model_diff(before: dict, after: dict) -> dict:
    return graphs.diff(before, after)


def data_diff(left: DataFrame, right: DataFrame, definitions: DataFrame, inputs: list[str] | None = None) -> DataFrame:
    return compare.compared(left, right, definitions, inputs)
