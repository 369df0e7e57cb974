"""CSV and line files as text tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.dialect import strip, text_of
from ..operators.contracts import parallel_columns, require

NULLS = "nan"
#: Bytes of a table that is dealt out anew where it has fewer files than there are cores.
SMALL = 256 << 20
#: Bytes of a task whose work takes long for each byte, and so many such tasks at most.
TASK, MOST_TASKS = 8 << 20, 10_000


def input_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores: a small table in a few files is dealt out, as its row groups bound the tasks of a scan; others stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = input_bytes(df)
    return df.repartition(2 * cores) if len(df.inputFiles()) < cores and size < SMALL else df


def dealt(df: DataFrame, size: int | None = None, *keys: str) -> DataFrame:
    """``df`` dealt out evenly, or by ``keys``, for work that takes long for each byte: about ``TASK`` bytes a task, two tasks a core at least.

    A scan gives one task up to 128 MB, and a shuffle's small partitions are merged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = input_bytes(df) if size is None else size
    return df.repartition(max(2 * cores, min(MOST_TASKS, -(-size // TASK))), *keys)


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that the cluster shares: spark.checkpoint.dir, or one beside the warehouse where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tessella-scratch"
    return f"{root.rstrip('/')}/tessella-{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` as a table in a folder, worked out once for all who read it."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_csv(spark: SparkSession, path: str, schema: str | None = None, infer: bool = False, multi_line: bool = True) -> DataFrame:
    """A CSV file with a header and doubled quotes; "" and nan are NULL. Without a schema columns are text, or of inferred types.

    ``multi_line`` allows line feeds within quotes, at the price that a file is one task; without
    it large files are split.
    """
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').option("nullValue", NULLS).option("emptyValue", None)
    df = (reader.schema(schema) if schema else reader.option("inferSchema", infer)).csv(path)
    return df.select(*[F.when(F.col(f"`{c}`") == "", None).otherwise(F.col(f"`{c}`")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in df.dtypes])


def read_column(spark: SparkSession, path: str, column: str) -> DataFrame:
    """One column of a CSV file, stripped; a missing header or column raises ValueError."""
    df = read_csv(spark, path)
    if not df.columns:
        raise ValueError(f"{path} has no header")
    require(df, [column])
    return df.select(strip(text_of(F.col(f"`{column}`"))).alias("text"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines, stripped, without blank ones."""
    return spark.read.text(path).select(strip(F.col("value")).alias("text")).where("text <> ''")


def read_texts(spark: SparkSession, path: str, column: str | None = None) -> DataFrame:
    """A column of a CSV file, or the lines of any other file."""
    if column is not None:
        return read_column(spark, path, column)
    if path.lower().endswith(".csv"):
        raise ValueError(f"{path} is CSV; name a column")
    return read_lines(spark, path)


def numbered(rows: DataFrame, out: str) -> DataFrame:
    """``rows`` with their number from 0, in the order of the file they are read from.

    Partitions of one file come in file order, so a row's number is its own within the partition
    and the rows of the partitions before, which are counted in one pass.
    """
    own = rows.withColumn("__id", F.monotonically_increasing_id())
    part = F.shiftright("__id", 33)
    sizes = own.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(W.orderBy("__part")) - F.col("__n")).alias("__before"))  # one row a partition
    joined = own.join(F.broadcast(before), part == F.col("__part"))
    return joined.select((F.col("__before") + F.col("__id").bitwiseAND((1 << 33) - 1)).alias(out), *rows.columns)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Columns line_no (from 0, in file order), text; all lines, as they are."""
    return numbered(spark.read.text(path).select(F.col("value").alias("text")), "line_no")


def read_parallel(spark: SparkSession, src_path: str, tgt_path: str, longer_than: int = 5) -> DataFrame:
    """Columns ord, src, tgt from two files by line; the shorter file decides; both sides need more than ``longer_than`` characters."""
    a, b = numbered_lines(spark, src_path), numbered_lines(spark, tgt_path)
    pairs = a.join(b.withColumnRenamed("text", "tgt"), "line_no").select(F.col("line_no").alias("ord"), strip(F.col("text")).alias("src"), strip(F.col("tgt")).alias("tgt"))
    return pairs.where((F.length("src") > longer_than) & (F.length("tgt") > longer_than))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Columns src, tgt of a CSV file whose columns are found by name; rows with a NULL go; no fit gives no rows."""
    df = read_csv(spark, path)
    found = parallel_columns(df)
    if found is None:
        return spark.createDataFrame([], "src string, tgt string")
    return df.select(F.col(f"`{found[0]}`").alias("src"), F.col(f"`{found[1]}`").alias("tgt")).dropna()


def first_path(spark: SparkSession, paths: list[str]) -> str | None:
    """The first of several paths or patterns that there is, as a path, looked up by Spark's own file systems; a pattern's first by name."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
        if spark._jvm.java.util.Objects.nonNull(found) and len(found):
            return min(x.getPath().toString() for x in found)
    return None


def find_table(spark: SparkSession, folders: list[str], names: list[str], pattern: str = "*entence*.*") -> str | None:
    """The path of the first of ``names`` in the first folder that has one, else of what fits ``pattern``, else None."""
    return first_path(spark, [f"{f}/{n}" for f in folders for n in [*names, pattern]])


def read_first(spark: SparkSession, paths: list[str]) -> DataFrame | None:
    """The first of several CSV paths (or patterns) that there is; None without any."""
    path = first_path(spark, paths)
    return None if path is None else read_csv(spark, path)


def teacher_or_target(df: DataFrame, teacher: str = "teacher_translation", target: str = "translation") -> DataFrame:
    """``df`` with tgt: the teacher's column where the table has one and it is not NULL."""
    return df.withColumn("tgt", F.coalesce(teacher, target) if teacher in df.columns else F.col(target))
