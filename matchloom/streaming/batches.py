"""Batches of S1 rows as a stream: resumable scoring and a running recall gate."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import evaluation as E
from ..sources.files import FIELDS, strings


def stream_source(spark: SparkSession, folder: str, files_a_batch: int = 1) -> DataFrame:
    """The TSV files of a folder, some at a time."""
    return spark.readStream.schema(strings(*FIELDS)).option("sep", "\t").option("header", True).option("maxFilesPerTrigger", files_a_batch).csv(folder)


def process(rows: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Handles all batches that are there now, then ends. Batches that the checkpoint has are not read again,
    which is how a run that broke off goes on."""
    q = rows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def running_gate(pairs: DataFrame, truth: DataFrame, checkpoint: str) -> E.IncrementalGate:
    """The gate over a stream of candidate pairs (each entity's in one batch)."""
    gate = E.IncrementalGate(truth)
    process(pairs, lambda df, _: gate.update(df), checkpoint)
    return gate
