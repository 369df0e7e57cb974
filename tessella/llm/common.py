"""Shared plumbing of the training-data operators: written cut points and Arrow helpers."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch, whatever its rows hold; a longer text is a batch of its own.
BATCH_BYTES = 4 << 20
#: Rows of a file of a narrow table whose number of rows is known.
FILE_ROWS = 1 << 16


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; where that is unset, one beside the warehouse, which executors share too."""
    root = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tessella-scratch"
    return root.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{scratch_root(spark)}/tessella-{tag}-{uuid.uuid4().hex}"


def in_few(df: DataFrame, rows: int) -> DataFrame:
    """``df`` of about ``rows`` narrow rows in as many partitions as these need, at most those of a shuffle.

    The work before it keeps its partitions. A shuffle into hundreds leaves hundreds of files of a
    few rows, and on a local folder Hadoop has the executor start a process for each of them.
    """
    most = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(1, min(most, -(-rows // FILE_ROWS))))


def materialize(df: DataFrame, tag: str, rows: int | None = None, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage, so that a lost executor costs a reread of a file and not a rerun
    of the plan, and it computes an expensive plan once for several readers. A narrow table of
    about ``rows`` rows is written in few files.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    (df if rows is None else in_few(df, rows)).write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessella_path = path
    return out


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table that :func:`materialize` wrote and nobody reads any more."""
    path = getattr(df, "_tessella_path", None)
    if path:
        spark = df.sparkSession
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def bound_batches(spark: SparkSession) -> None:
    """Bound the bytes of Arrow batches in this session; all operators set the same, so that plans don't depend on who came last."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_key(text: Column) -> Column:
    """A 128-bit key of a text: equal texts have equal keys, computed in the JVM."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


# ---- arrays and texts in time that grows with their length ----

#: Items of an array that are gone through with a growing array; what is kept of each block is put together after that.
_BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(items: Column, zero: Column, measure: Callable[[Column], Column], merge: Callable[[Column, Column], Column]) -> Column:
    """Structs (item, before): each item with the merged measures of all before it; ``merge`` is associative.

    An array that grows by one item is copied with each step, so it only grows within a block.
    """

    def block(part: Column) -> Column:
        none = F.transform(F.slice(part, 1, 0), lambda x: F.struct(x.alias("item"), zero.alias("before")))
        step = lambda s, x: F.struct(merge(s["total"], measure(x)).alias("total"), F.concat(s["out"], F.array(F.struct(x.alias("item"), s["total"].alias("before")))).alias("out"))
        return F.aggregate(part, F.struct(zero.alias("total"), none.alias("out")), step)

    def joined(blocks: Column) -> Column:
        none = F.transform(F.slice(blocks, 1, 0), lambda b: b["total"])
        step = lambda s, b: F.struct(merge(s["total"], b["total"]).alias("total"), F.concat(s["out"], F.array(s["total"])).alias("out"))
        starts = F.aggregate(blocks, F.struct(zero.alias("total"), none.alias("out")), step, lambda s: s["out"])
        return F.flatten(F.zip_with(blocks, starts, lambda b, o: F.transform(b["out"], lambda x: F.struct(x["item"].alias("item"), merge(o, x["before"]).alias("before")))))

    def dealt(all_items: Column) -> Column:
        last = F.greatest(F.lit(0), F.ceil(F.size(all_items) / _BLOCK).cast("int") - 1)
        return F.transform(F.sequence(F.lit(0), last), lambda i: block(F.slice(all_items, i * _BLOCK + 1, F.lit(_BLOCK))))

    return let(let(items, dealt), joined)


def code_points(text: Column) -> Column:
    """A text with four bytes for each code point, so that :func:`piece` finds a place without a walk from the start."""
    return F.encode(text, "UTF-32")


def piece(points: Column, start: Column, end: Column) -> Column:
    """The text from code point ``start`` to ``end`` (exclusive) of :func:`code_points`."""
    return F.decode(F.substring(points, 4 * start + 1, 4 * (end - start)), "UTF-32")
