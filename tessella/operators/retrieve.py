"""Nearest texts by TF-IDF over character and word n-grams, a length penalty, and a second look by similarity.

An index is an inverted list: n-gram to document and weight, with each n-gram's number of documents
and largest weight. A query's rarest n-grams give a score that its best documents reach at least.
Its most common n-grams, as far as their largest contributions together stay under that score,
can't lift a document to it alone, so their long lists are never read as a whole: only documents
that hold another n-gram of the query, and can still reach the score, look them up. Results are
exact. What query and document lack adds at most the weight of the second look, which is under
the score that a result needs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.arrow import ratcliff
from ..functions.clean import retrieval_key
from ..functions.dialect import tokens
from ..sources.files import scratch, written
from .ngrams import characters, windows

CHAR_ORDERS, WORD_ORDERS = (3, 4, 5, 6), (1, 2)
W_CHAR, W_WORD, W_SEQ, PENALTY, TOP, AGAIN, ACCEPT = 0.75, 0.20, 0.05, 0.3, 60, 10, 0.10
#: What rounding can add to or take from a sum.
EPS = 1e-9


def edge_grams(key: Column) -> Column:
    """Character n-grams inside each word padded by a blank; a shorter word is its own, once."""

    def of(word: Column) -> Column:
        padded = characters(F.concat(F.lit(" "), word, F.lit(" ")))
        each = [windows(padded, n, "") if n == CHAR_ORDERS[0] else F.when(F.size(padded) >= n, windows(padded, n, "")).otherwise(F.array().cast("array<string>")) for n in CHAR_ORDERS]
        return F.concat(*each)

    return F.flatten(F.transform(tokens(key), of))


def key_words(key: Column) -> Column:
    """Runs of two or more word characters, and pairs of neighbours."""
    words = F.filter(F.regexp_extract_all(key, F.lit("[a-z0-9_]+"), F.lit(0)), lambda w: F.length(w) >= 2)
    return F.concat(words, windows(words, 2, " "))


@dataclass
class Index:
    """``docs``: doc, key, words (and any payload); ``grams``: space, gram, doc, weight; ``terms``: space, gram, df, idf, top (the largest weight)."""

    docs: DataFrame
    grams: DataFrame
    terms: DataFrame


def counts(rows: DataFrame, id: str, key: str = "key") -> DataFrame:
    """Columns id, space, gram, tf."""
    each = F.concat(F.transform(edge_grams(F.col(key)), lambda g: F.struct(F.lit("char").alias("space"), g.alias("gram"))), F.transform(key_words(F.col(key)), lambda g: F.struct(F.lit("word").alias("space"), g.alias("gram"))))
    return rows.select(id, F.explode(each).alias("g")).groupBy(id, "g.space", "g.gram").agg(F.count("*").alias("tf"))


def weighted(tf: DataFrame, idf: DataFrame, id: str) -> DataFrame:
    """TF-IDF of unit length for each id and space; n-grams outside the vocabulary are gone before lengths are taken."""
    raw = tf.join(idf.select("space", "gram", "idf"), ["space", "gram"]).withColumn("raw", F.col("tf") * F.col("idf"))
    size = raw.groupBy(F.col(id).alias("i"), F.col("space").alias("s")).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("size"))
    return raw.join(size, (F.col(id) == F.col("i")) & (F.col("space") == F.col("s"))).select("space", "gram", id, (F.col("raw") / F.col("size")).alias("weight"))


def build_index(corpus: DataFrame, folder: str, doc: str = "doc", source: str = "src", key: Column | None = None) -> Index:
    """Index the rows of ``corpus`` by their normalized sources; idf is ln((1 + N) / (1 + df)) + 1 over all rows.

    ``doc`` has no repeats; it may be a struct. Columns besides ``source`` are kept as payload. The
    index is written to ``folder``, and :func:`open_index` opens it again.
    """
    docs = corpus.withColumn("key", key if key is not None else retrieval_key(F.col(source))).withColumn("words", F.size(tokens(F.col("key"))))
    docs = written(docs.withColumnRenamed(doc, "doc") if doc != "doc" else docs, f"{folder}/docs")
    tf = written(counts(docs, "doc"), f"{folder}/counts")
    total = docs.agg(F.count("*").alias("total"))
    df = tf.groupBy("space", "gram").agg(F.count("*").alias("df"))
    idf = df.crossJoin(F.broadcast(total)).select("space", "gram", "df", (F.log((1 + F.col("total")) / (1 + F.col("df"))) + 1).alias("idf"))  # a total is one row
    grams = written(weighted(tf, idf, "doc"), f"{folder}/grams")
    top = grams.groupBy("space", "gram").agg(F.max("weight").alias("top"))
    return Index(docs, grams, written(idf.join(top, ["space", "gram"]), f"{folder}/terms"))


def open_index(spark: SparkSession, folder: str) -> Index:
    return Index(*[spark.read.parquet(f"{folder}/{t}") for t in ("docs", "grams", "terms")])


def similarities(queries: DataFrame, index: Index, query: str = "query", key: str = "key") -> DataFrame:
    """Columns query, doc, char_sim, word_sim for each query and document that share an n-gram."""
    tf = counts(queries.withColumnRenamed(query, "query") if query != "query" else queries, "query", key)
    q = weighted(tf, index.terms, "query").withColumnRenamed("weight", "qw")
    part = lambda s: F.sum(F.when(F.col("space") == s, F.col("qw") * F.col("weight")).otherwise(0.0))
    return q.join(index.grams, ["space", "gram"]).groupBy("query", "doc").agg(part("char").alias("char_sim"), part("word").alias("word_sim"))


def nearest(queries: DataFrame, index: Index, top: int = TOP, w_char: float = W_CHAR, w_word: float = W_WORD) -> DataFrame:
    """Columns query, doc, combined of each query's ``top`` documents, ties to the smaller doc; ``queries`` has query, key.

    An n-gram adds at most its part of the query times its largest weight in any document.
    """
    q = weighted(counts(queries, "query"), index.terms, "query")
    q = q.withColumn("c", F.when(F.col("space") == "char", w_char).otherwise(w_word) * F.col("weight")).drop("weight")
    q = q.join(index.terms, ["space", "gram"]).withColumn("most", F.col("c") * F.col("top"))
    by = W.partitionBy("query")
    rare_first = by.orderBy("df", "space", "gram")
    q = q.withColumn("total", F.sum("most").over(by)).withColumn("upto", F.sum("most").over(rare_first)).select("query", "space", "gram", "c", "most", "total", "upto")
    q = written(q, scratch(queries.sparkSession, "asked"))  # read twice, and behind an Arrow function
    rare = q.where(F.col("upto") - F.col("most") < F.col("total") / 2)
    # the score of the last of the best by rare n-grams alone: the best by all n-grams reach it too
    part = rare.select("query", "space", "gram", "c").join(index.grams, ["space", "gram"]).groupBy("query", "doc").agg(F.sum(F.col("c") * F.col("weight")).alias("p"))
    last = part.withColumn("r", F.row_number().over(W.partitionBy("query").orderBy(F.desc("p")))).where(F.col("r") == top).select(F.col("query").alias("lq"), F.col("p").alias("least"))
    split = q.join(last, F.col("query") == F.col("lq"), "left").withColumn("least", F.coalesce("least", F.lit(0.0)) - EPS)
    split = split.select("query", "space", "gram", "c", "least", (F.col("total") - F.col("upto") + F.col("most")).alias("rest"))
    split = written(split, scratch(queries.sparkSession, "split"))
    common = F.col("rest") < F.col("least")
    spare = split.groupBy("query").agg(F.first("least").alias("least"), F.coalesce(F.max(F.when(common, F.col("rest"))), F.lit(0.0)).alias("spare"))
    first = split.where(~common).join(index.grams, ["space", "gram"]).groupBy("query", "doc").agg(F.sum(F.col("c") * F.col("weight")).alias("p"))
    alive = first.join(spare, "query").where(F.col("p") + F.col("spare") >= F.col("least")).select("query", "doc", "p")
    looked = alive.join(split.where(common).select("query", "space", "gram", "c"), "query").join(index.grams, ["doc", "space", "gram"])
    full = alive.union(looked.select("query", "doc", F.col("c") * F.col("weight"))).groupBy("query", "doc").agg(F.round(F.sum("p"), 12).alias("combined"))
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("combined"), "doc"))
    return full.withColumn("r", rank).where(F.col("r") <= top).drop("r")


def top_matches(queries: DataFrame, index: Index, query: str = "query", text: str = "text", top: int = TOP, again: int = AGAIN, w_char: float = W_CHAR, w_word: float = W_WORD, penalty: float = PENALTY) -> DataFrame:
    """Columns query, key, doc, src_key, combined, score, rank: the best ``again`` by penalized score among the ``top`` by similarity.

    Ties go to the smaller doc, also between the two cuts.
    """
    q = queries.select(F.col(query).alias("query"), retrieval_key(F.col(text)).alias("key")).withColumn("q_words", F.size(tokens(F.col("key"))))
    q = q.where("key <> ''")
    near = nearest(q.select("query", "key"), index, top, w_char, w_word)
    docs = index.docs.select("doc", F.col("key").alias("src_key"), "words")
    joined = near.join(docs, "doc").join(q, "query")
    share = F.col("words") / F.greatest(F.lit(1), F.col("q_words"))
    scored = joined.withColumn("score", F.round(F.col("combined") * F.exp(-F.abs(F.log(share + 1e-5)) * penalty), 12))
    second = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "doc"))
    return scored.withColumn("rank", second).where(F.col("rank") <= again).select("query", "key", "doc", "src_key", "combined", "score", "rank")


def retrieve(queries: DataFrame, index: Index, target: str = "tgt", query: str = "query", text: str = "text", accept: float = ACCEPT, w_seq: float = W_SEQ, **how) -> DataFrame:
    """Columns query, doc, translation, score: the best document of each query, or '' and 0 where none scores over ``accept``.

    Ten rows a query at most reach the similarity function. ``accept`` must not be under ``w_seq``:
    documents without a shared n-gram are never looked at.
    """
    if accept < w_seq:
        raise ValueError("accept must be at least w_seq")
    near = top_matches(queries, index, query, text, **how)
    total = near.withColumn("total", F.col("score") + w_seq * ratcliff(F.col("key"), F.col("src_key")))
    best = total.groupBy("query").agg(F.max(F.struct(F.round("total", 12).alias("r"), (-F.col("rank")).alias("k"), "doc", "total")).alias("b"))
    best = best.where(F.col("b.total") > accept).select(F.col("query").alias("q"), "b.doc", F.col("b.total").alias("total"))
    best = best.join(index.docs.select(F.col("doc").alias("d"), F.col(target).alias("hit")), F.col("doc") == F.col("d"), "left")
    out = queries.select(F.col(query).alias("query")).distinct().join(best, F.col("query").eqNullSafe(F.col("q")), "left")
    return out.select("query", "doc", F.coalesce("hit", F.lit("")).alias("translation"), F.coalesce("total", F.lit(0.0)).alias("score"))
