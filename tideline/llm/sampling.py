"""What the classifiers share: a bounded, reproducible sample of labelled texts
to fit on, fitting in one task, and scoring by a broadcast model."""

from __future__ import annotations

import pickle
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.textbatch import chunks, release

#: Labelled documents that a classifier is fitted on at most.
FIT_ROWS = 5000
#: Longer texts (in bytes) are never part of the sample, so its size is bounded too.
FIT_TEXT_BYTES = 32_768


def remainder(column: str, modulus: int):
    """crc32 of the id as text, modulo modulus; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def labelled(docs: DataFrame, labels: DataFrame, label: str, training=None, rows: int = FIT_ROWS, text_bytes: int = FIT_TEXT_BYTES) -> DataFrame:
    """(doc_id, label, text) of at most rows labelled ids, picked by a hash of the
    id among those for which the condition training holds. A document that has
    several labels is fitted with each; of rows that share an id, one text counts."""
    picked = (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & (F.lit(True) if training is None else training))
        .distinct()
        .orderBy(F.xxhash64("doc_id"), "label")
        .limit(rows)
    )
    short = docs.select("doc_id", "text").filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= text_bytes)
    # Rows are bounded by the limit, so this side may be broadcast.
    return short.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def fitted(sample: DataFrame, learn: Callable[[list[tuple]], object]):
    """learn(rows) of the whole bounded sample, run in one task; rows are sorted
    tuples of Python values. Only the model comes to the driver."""

    def run(batches):
        rows: list[tuple] = []
        for batch in batches:
            rows += zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)))
        model = pickle.dumps(learn(sorted(rows)))
        rows.clear()
        release()
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], ["model"])

    found = sample.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0].model) if found else learn([])


def with_scores(docs: DataFrame, model, carry: list[str] | None = None) -> DataFrame:
    """Applies model.score to whole texts in one pass without a shuffle."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in (docs.columns if carry is None else carry) if c != "score"]
    schema = T.StructType([*(docs.schema[c] for c in names), T.StructField("score", T.DoubleType())])

    def run(batches):
        for batch in chunks(batches):
            scores = pa.array(shipped.value.score(batch.column("text").to_pylist()), pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), scores], [*names, "score"])

    return docs.select(*dict.fromkeys([*names, "text"])).mapInArrow(run, schema)
