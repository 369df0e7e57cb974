"""Writers: CSV submissions, split outputs, result tables with optional columns, JSON reports."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import texts
from ..functions.texts import over_texts


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """CSV with a header. ``one_file`` is for outputs that a single task can hold."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_split(rows: DataFrame, train: str, val: str) -> None:
    """The two sides of a split (column is_val) to two folders."""
    write_csv(rows.where("not is_val").drop("is_val"), train)
    write_csv(rows.where("is_val").drop("is_val"), val)


def result_table(df: DataFrame, always: list[str], optional: list[str]) -> DataFrame:
    """The columns that must be there and those of the optional ones that are."""
    return df.select(*always, *[c for c in optional if c in df.columns])


def repaired(df: DataFrame, id: str = "id", text: str = "translation", default: str = "broken text") -> DataFrame:
    """Columns id (long), text: ASCII, single blanks, never blank."""
    return df.select(F.col(id).try_cast("long").alias(id), over_texts(partial(texts.repaired, default=default), F.col(text), default).alias(text))


def report_json(df: DataFrame) -> DataFrame:
    """Each row as one JSON text, in a column ``report``."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("report"))
