"""A bounded sample of labelled documents for fitting; everything else covers all rows."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a classifier is fitted on at most.
MAX_TRAIN_ROWS = 12_000
FOLDS = 4


def held_out(id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3; a null id is never held out."""
    return F.coalesce(F.crc32(F.encode(id.cast("string"), "utf-8")) % 3 == 1, F.lit(False))


def is_held_out(id: int) -> bool:
    return zlib.crc32(str(id).encode()) % 3 == 1


def training_rows(docs: DataFrame, labels: DataFrame, label: str, id: str = "doc_id", text: str = "text", max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """Columns text, y, fold of at most ``max_rows`` labelled documents that are not held out.

    The sample is the rows with the smallest hash of the id; its ids and labels, a bounded table,
    are broadcast to the scan of the documents. Ids that are labelled twice take the larger label,
    null ids and null labels are left out, and of documents with one id all rows count, up to the bound:
    of more rows those with the smallest hash of id and text stay.
    """
    known = labels.where(F.col(id).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(id)))
    known = known.groupBy(F.col(id).alias("k")).agg(F.max(F.col(label).cast("double")).alias("y"))
    bounded = known.orderBy(F.xxhash64("k"), "k").limit(max_rows)
    rows = docs.select(F.col(id).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    fold = F.pmod(F.xxhash64("k"), F.lit(FOLDS)).cast("int").alias("fold")
    rows = rows.join(F.broadcast(bounded), "k")
    # this count reads ids alone; only where ids repeat are texts hashed
    if rows.count() > max_rows:
        rows = rows.withColumn("h", F.xxhash64("k", "text"))
        least = [x.h for x in rows.select("h").orderBy("h").limit(max_rows).collect()]
        # rows with the last hash are equal; as many of them stay as there is room for
        last = least[-1] if least else 0
        room = max_rows - sum(h < last for h in least)
        rows = rows.where(F.col("h") < last).union(rows.where(F.col("h") == last).limit(room))
    return rows.select("text", "y", fold)
