"""What tables must look like: column resolution, schema checks, profiles, and checks of outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dialect import blank


def resolve(df: DataFrame, names: list[str]) -> str | None:
    """The first of ``names`` that is a column."""
    return next((n for n in names if n in df.columns), None)


def parallel_columns(df: DataFrame) -> tuple[str, str] | None:
    """Source and target columns by parts of their names, the last fit of each; else the first two text columns; else None."""
    src = [c for c in df.columns if any(p in c.lower() for p in ("translit", "akkadian", "source", "src"))]
    tgt = [c for c in df.columns if c not in src and any(p in c.lower() for p in ("translat", "english", "target", "tgt"))]
    if src and tgt:
        return src[-1], tgt[-1]
    texts = [c for c, kind in df.dtypes if kind == "string"]
    return (texts[0], texts[1]) if len(texts) >= 2 else None


def require(df: DataFrame, names: list[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}; there are {', '.join(df.columns)}")


def schema_rows(df: DataFrame) -> DataFrame:
    """Columns position, name, type of a table's own columns."""
    return df.sparkSession.createDataFrame([(i, n, t) for i, (n, t) in enumerate(df.dtypes)], "position int, name string, type string")


def inspect(df: DataFrame, *order: str, rows: int = 5) -> dict:
    """What a table looks like: its number of rows and columns, names, types and first rows."""
    names, kinds = zip(*df.dtypes) if df.dtypes else ((), ())
    return {"shape": (df.count(), len(names)), "columns": list(names), "types": list(kinds), "first": [x.asDict() for x in df.orderBy(*order).limit(rows).collect()]}


def profile(df: DataFrame, texts: list[str]) -> DataFrame:
    """A row for each text column: rows, nulls, mean, least and largest length."""
    stats = [F.struct(F.lit(c).alias("name"), F.count("*").alias("n_rows"), F.count_if(F.col(c).isNull()).alias("nulls"), F.avg(F.length(c)).alias("mean_length"), F.min(F.length(c)).alias("min_length"), F.max(F.length(c)).alias("max_length")) for c in texts]
    return df.agg(F.array(*stats).alias("s")).select(F.inline("s"))


def expectations(df: DataFrame, text: str, id: str, rows: int | None = None) -> DataFrame:
    """One row of checks of an output table: counts of what is wrong, and whether all is right."""
    bad = df.agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col(id).isNull()).alias("null_ids"),
        (F.count(id) - F.count_distinct(id)).alias("repeated_ids"),
        F.count_if(F.col(text).isNull()).alias("null_texts"),
        F.count_if(F.col(text).isNotNull() & blank(F.col(text))).alias("blank_texts"),
        F.count_if(F.col(text).rlike(r"[^\x00-\x7f]")).alias("non_ascii_texts"),
    )
    good = (F.col("null_ids") + F.col("repeated_ids") + F.col("null_texts") + F.col("blank_texts") + F.col("non_ascii_texts")) == 0
    return bad.withColumn("ok", good if rows is None else good & (F.col("n_rows") == rows))
