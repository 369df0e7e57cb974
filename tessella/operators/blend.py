"""Weighted means of parameter vectors over models, keyed by parameter name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def blended(params: DataFrame, weights: dict[str, float], renormalise: bool = True) -> DataFrame:
    """Columns name, vec from model, name, vec (array<double>).

    A model without a weight, and one that lacks a parameter, drops out; with ``renormalise`` the
    weights that are left are scaled to 1 for each parameter, else for all models that there are.
    """
    table = F.create_map(*[x for k, w in weights.items() for x in (F.lit(k), F.lit(float(w)))])
    rows = params.withColumn("w", F.try_element_at(table, F.col("model").cast("string"))).where("w is not null")
    each = rows.select("model", "name", "w", F.posexplode("vec").alias("i", "v"))
    if renormalise:
        value = F.sum(F.col("w") * F.col("v")) / F.sum("w")
    else:
        there = rows.select("model", "w").distinct().agg(F.sum("w").alias("total"))
        each = each.crossJoin(F.broadcast(there))  # one row
        value = F.sum(F.col("w") * F.col("v") / F.col("total"))
    cells = each.groupBy("name", "i").agg(value.alias("v"))
    return cells.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda c: c["v"]).alias("vec"))
