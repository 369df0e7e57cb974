"""Token ids in Parquet list columns: dictionary-coded ids, delta-coded positions, bounded row groups.

A file holds the documents of one range of ids in ascending order. Its list column of ids is
dictionary coded (token ids repeat), its numbers are delta coded (they ascend or are small), its
row groups and pages are bounded in bytes, and the writer's page index lets a reader take some
documents, or the metadata columns only, without the pages of the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import worker_encoder
from .common import bound_batches, new_path

ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 256 << 10

SCHEMA = "part int, row long, doc_id long, local_start long, n_tokens long, ids array<int>"
_ARROW = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])


def write_options(row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES) -> dict[str, str]:
    numbers = ("part", "row", "doc_id", "local_start", "n_tokens")
    return {
        "parquet.writer.version": "v2",
        "parquet.block.size": str(row_group_bytes),
        "parquet.page.size": str(page_bytes),
        "parquet.dictionary.page.size": str(1 << 20),
        "parquet.enable.dictionary": "true",
        "parquet.columnindex.truncate.length": "64",
        "compression": "zstd",
    } | {f"parquet.enable.dictionary#{c}": "false" for c in numbers}


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int | None, id: str = "doc_id", text: str = "text", path: str | None = None, partitions: int | None = None) -> str:
    """Encode all documents and write them in ascending id order; returns the folder.

    Texts are dealt by sampled ranges of ids and encoded after that, so that the shuffle carries
    text (smaller than ids). A null or empty text has ``end_id`` only, or no id where that is
    None. Null ids come first, repeated rows stay (equal ids are ordered by a hash of the text, then
    by text), an empty table gives a folder with a schema and no rows. Other columns are not written.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    bound_batches(spark)
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    by = ("doc_id", F.xxhash64("text"))
    rows = rows.repartitionByRange(partitions, *by) if partitions else rows.repartitionByRange(*by)
    rows = rows.sortWithinPartitions(*by, "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, row, start = worker_encoder(tokenizer), 0, 0
        tail = [] if end_id is None else [np.array([end_id], np.uint32)]
        for b in batches:
            ids = [np.concatenate([encoder.encode(t.as_py()), *tail]) for t in b["text"]]
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            ends = np.cumsum(size)
            flat = np.concatenate(ids).astype(np.int32) if ids else np.empty(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(flat))
            columns = [pa.array(np.arange(row, row + len(ids))), b["doc_id"], pa.array(start + ends - size), pa.array(size), lists]
            yield pa.RecordBatch.from_arrays(columns, schema=_ARROW)
            row, start = row + len(ids), start + int(size.sum())

    out = rows.mapInArrow(encode, SCHEMA.removeprefix("part int, ")).select(F.spark_partition_id().alias("part"), "*")
    out.write.options(**write_options()).parquet(path)
    return path


def open_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The written rows with ``start``: the ids of all documents before each, in file order.

    Only the metadata columns are read for the offsets; the totals are one row of two numbers for each
    file, so they can be broadcast.
    """
    rows = spark.read.schema(SCHEMA).parquet(path)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = totals.select("part", (F.sum("total").over(W.orderBy("part")) - F.col("total")).alias("before"))
    return rows.join(F.broadcast(before), "part").withColumn("start", F.col("before") + F.col("local_start")).drop("before")


def read_slice(spark: SparkSession, path: str, low: int, high: int, columns: tuple[str, ...] = ("doc_id", "n_tokens", "ids")) -> DataFrame:
    """The documents with low <= id <= high; other row groups and pages are skipped by their statistics."""
    return spark.read.schema(SCHEMA).parquet(path).where(F.col("doc_id").between(low, high)).select(*columns)
