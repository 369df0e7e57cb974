"""Cleaning and lookups over streams. An extension: plain projections and joins with static tables, no state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.clean import dictionary_lookup, postprocess, preprocess
from ..operators.corpus import memory_lookup


def cleaned(stream: DataFrame, text: str = "text") -> DataFrame:
    """``stream`` with source (for a model) and target (for readers) forms of its text."""
    return stream.withColumns({"source_form": preprocess(F.col(text)), "target_form": postprocess(F.col(text))})


def looked_up(stream: DataFrame, memory: DataFrame, key, text: str = "text") -> DataFrame:
    """``stream`` with the dictionary's or the memory's answer; a join of a stream with a static table."""
    return memory_lookup(stream.withColumn("short", dictionary_lookup(F.col(text))), memory, key(F.col(text))).withColumn("answer", F.coalesce("short", "exact"))


def run_once(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Work off what there is into Parquet files, exactly once by the checkpoint."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
