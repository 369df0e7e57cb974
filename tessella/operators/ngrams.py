"""N-grams of characters and words, their counts, and clipped overlaps of pairs of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import text_overlaps
from ..functions.dialect import let, tokens

_NONE = "array<string>"


def windows(items: Column, n: int, glue: str) -> Column:
    """All runs of n items, joined; none where there are fewer."""
    if n == 1:
        return items
    joined = lambda x: lambda first, i: F.concat(first, *[part for k in range(1, n) for part in (F.lit(glue), F.get(x, i + k))])
    return let(items, lambda x: F.transform(F.slice(x, 1, F.greatest(F.size(x) - n + 1, F.lit(0))), joined(x)))


def characters(text: Column) -> Column:
    return F.when(text == "", F.array().cast(_NONE)).otherwise(F.split(text, ""))


def char_ngrams(text: Column, n: int) -> Column:
    return windows(characters(text), n, "")


def word_ngrams(text: Column, n: int) -> Column:
    return windows(tokens(text), n, "\x01")


def gram_rows(rows: DataFrame, text: str, chars: tuple[int, ...] = (), words: tuple[int, ...] = (), keys: tuple[str, ...] = ()) -> DataFrame:
    """Columns ``keys``, kind ("char" or "word"), n, gram: a row for each n-gram, repeats included."""
    grams = [("char", n, windows(F.col("__chars"), n, "")) for n in chars] + [("word", n, windows(F.col("__words"), n, "\x01")) for n in words]
    split = rows.select(*keys, characters(F.col(text)).alias("__chars"), tokens(F.col(text)).alias("__words"))
    if len(grams) == 1:
        kind, n, of = grams[0]
        return split.select(*keys, F.lit(kind).alias("kind"), F.lit(n).alias("n"), F.explode(of).alias("gram"))
    # an order is a row first, so that no struct is made for each n-gram
    orders = split.select(*keys, F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(n).alias("n"), of.alias("grams")) for kind, n, of in grams])).alias("o"))
    return orders.select(*keys, "o.kind", "o.n", F.explode("o.grams").alias("gram"))


def overlaps(pairs: DataFrame, a: str, b: str, keys: tuple[str, ...], chars: tuple[int, ...] = (), words: tuple[int, ...] = ()) -> DataFrame:
    """Columns ``keys``, kind, n, common, in_a, in_b: clipped common n-grams and totals of each pair.

    Both texts are in one row, so nothing is shuffled. An order that neither text reaches has no
    row; NULL texts are empty.
    """
    rows = pairs.select(*keys, F.explode(text_overlaps(F.col(a), F.col(b), chars, words)).alias("o"))
    return rows.select(*keys, "o.*").where((F.col("in_a") > 0) | (F.col("in_b") > 0))
