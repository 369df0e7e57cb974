"""Corpus preparation: pairs, splits, sentence tables, deduplication, memories, lexicons, weighting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.arrow import align_monotone, plain
from ..functions.clean import retrieval_key
from ..functions.dialect import S, collapse, let, lookup, strip, text_of, tokens
from ..functions.tables import EDGE_MARKS
from ..sources.files import scratch, written

# ---- sentences ----


def _filled(parts: Column) -> Column:
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def source_sentences(text: Column) -> Column:
    """Parts after a full stop, exclamation or question mark and white space, or at line feeds."""
    return _filled(F.split(text_of(text), rf"(?<=[.!?]){S}+|\n+", -1))


def target_sentences(text: Column, collapsed: bool = False) -> Column:
    t = collapse(text_of(text)) if collapsed else text_of(text)
    return _filled(F.split(t, rf"(?<=[.!?]){S}+", -1))


def source_lines(text: Column) -> Column:
    """Lines with single blanks; where there is one only, its parts at semicolons."""
    lines = F.filter(F.transform(F.split(text_of(text), "\n+", -1), collapse), lambda p: p != "")
    return F.when(F.size(lines) > 1, lines).otherwise(_filled(F.split(collapse(text_of(text)), rf";{S}+", -1)))


def zip_longest(a: Column, b: Column) -> Column:
    """Structs (at, src, tgt) of two arrays by place; the shorter one is filled with ''; two empty ones give one row."""
    pair = lambda x, y: F.struct(F.coalesce(x, F.lit("")).alias("src"), F.coalesce(y, F.lit("")).alias("tgt"))
    # a lambda works out anew what it names for each element, so none of these names a or b
    zipped = F.zip_with(a, b, pair)
    filled = let(zipped, lambda z: F.when(F.size(z) > 0, z).otherwise(F.array(pair(F.lit(""), F.lit("")))))
    return F.transform(filled, lambda p, i: F.struct(i.alias("at"), p["src"].alias("src"), p["tgt"].alias("tgt")))


def sentence_rows(docs: DataFrame, sentences: DataFrame | None, doc_id: str, sent_id: str | None, src: str, tgt: str, order: str | None = None, s_src: str = "src", s_tgt: str = "tgt") -> DataFrame:
    """Columns doc_id, sentence_idx, transliteration, translation.

    Documents that the sentence table knows take its rows in ``order``, its NULLs read as "nan"; the
    rest are split and zipped. Without a table, or without a column to match by, all are split.
    """
    rest = docs
    known = None
    if sentences is not None and sent_id is not None:
        nan = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("nan"))
        s = sentences.select(F.col(sent_id).alias("k"), F.col(order).alias("o"), nan(s_src).alias("transliteration"), nan(s_tgt).alias("translation"))
        known = docs.select(F.col(doc_id).alias("doc_id")).join(s, F.col("doc_id") == F.col("k"))
        place = F.row_number().over(W.partitionBy("doc_id").orderBy("o")) - 1
        known = known.select("doc_id", place.alias("sentence_idx"), "transliteration", "translation")
        rest = docs.join(s.select("k").distinct(), docs[doc_id] == F.col("k"), "left_anti")
    split = rest.select(F.col(doc_id).alias("doc_id"), F.explode(zip_longest(source_sentences(F.col(src)), target_sentences(F.col(tgt)))).alias("z"))
    split = split.select("doc_id", F.col("z.at").alias("sentence_idx"), F.col("z.src").alias("transliteration"), F.col("z.tgt").alias("translation"))
    return known.unionByName(split) if known is not None else split


def sentence_pairs(docs: DataFrame, src: str = "src", tgt: str = "tgt") -> DataFrame:
    """Distinct non-empty pairs src, tgt, aligned in order; a document that can't be split is one pair; rows with a NULL are left out."""
    rows = docs.dropna(subset=[src, tgt]).select(F.col(src).alias("s"), F.col(tgt).alias("t"))
    pairs = rows.select("s", "t", align_monotone(source_lines(F.col("s")), target_sentences(F.col("t"), collapsed=True)).alias("p"))
    whole = F.array(F.struct(F.col("s").alias("src"), F.col("t").alias("tgt")))
    out = pairs.select(F.explode(F.when(F.size("p") > 0, F.col("p")).otherwise(whole)).alias("x")).select("x.src", "x.tgt")
    return out.where("src <> '' and tgt <> ''").distinct()


def zip_strict(a: Column, b: Column) -> Column:
    """Structs (a, b) of two arrays by place; arrays of different sizes raise an error when they are met."""
    sizes = F.concat(F.lit("arrays of "), F.size(a).cast("string"), F.lit(" and "), F.size(b).cast("string"))
    pairs = F.zip_with(a, b, lambda x, y: F.struct(x.alias("a"), y.alias("b")))
    return F.when(F.size(a) == F.size(b), pairs).otherwise(F.raise_error(sizes))


def turn_pairs(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Each user turn with the assistant turn right after it: conv, turn, src, tgt."""
    w = W.partitionBy(conv).orderBy(turn)
    both = rows.select(conv, turn, F.col(role).alias("r"), F.col(text).alias("src"), F.lead(role).over(w).alias("r2"), F.lead(text).over(w).alias("tgt"))
    return both.where("r = 'user' and r2 = 'assistant'").select(conv, turn, "src", "tgt")


# ---- filters, limits, batches ----


def longer_than(rows: DataFrame, text: str, least: int) -> DataFrame:
    """Rows of at least so many words."""
    return rows.where(F.size(tokens(text_of(F.col(text)))) >= least)


def first_rows(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The first ``n`` rows in an order that the data gives; each task sends n rows at most."""
    return rows.orderBy(*order).limit(n)


def batched(rows: DataFrame, size: int, id: str, seed: int | None = None) -> DataFrame:
    """``rows`` with batch and place, both from 0: batches of ``size`` rows in the order of ``id``, or of a hash of id and seed.

    Rows are dealt to sorted ranges and numbered by the sizes of the ranges before, so no task sees all of them.
    """
    order = F.col(id) if seed is None else F.md5(F.concat_ws(":", F.col(id).cast("string"), F.lit(str(seed))))
    dealt = rows.withColumn("__o", order).repartitionByRange("__o").sortWithinPartitions("__o", id).withColumn("__i", F.monotonically_increasing_id())
    dealt = written(dealt, scratch(rows.sparkSession, "batches"))  # numbers hold for good once they are written
    part = F.shiftright("__i", 33)
    sizes = dealt.groupBy(part.alias("__p")).agg(F.count("*").alias("__n"))
    before = sizes.select("__p", (F.sum("__n").over(W.orderBy("__p")) - F.col("__n")).alias("__b"))  # one row a partition
    number = F.col("__b") + F.col("__i").bitwiseAND((1 << 33) - 1)
    numbered = dealt.join(F.broadcast(before), part == F.col("__p"))
    return numbered.select(*rows.columns, F.floor(number / size).cast("long").alias("batch"), (number % size).cast("long").alias("place"))


# ---- duplicates, unions, splits ----


def dedup_first(rows: DataFrame, key: str, order: str) -> DataFrame:
    w = W.partitionBy(key).orderBy(order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def dedup_last(rows: DataFrame, key: Column, value: Column, order: Column) -> DataFrame:
    """Columns key, value: of rows with one key the last value stays."""
    return rows.groupBy(key.alias("key")).agg(F.max_by(value, order).alias("value"))


def repeated(rows: DataFrame, times: int) -> DataFrame:
    """Every row so many times."""
    return rows.withColumn("__k", F.explode(F.sequence(F.lit(1), F.lit(times)))).drop("__k")


def overlap_size(a: DataFrame, b: DataFrame, key_a: str, key_b: str) -> DataFrame:
    """One row: how many ids both tables have."""
    return a.select(F.col(key_a).alias("k")).intersect(b.select(F.col(key_b).alias("k"))).agg(F.count("*").alias("overlap"))


def hash_split(rows: DataFrame, id: str, share: float, seed: int = 42) -> DataFrame:
    """``rows`` with is_val: exactly ceil(n * share) rows, those with the largest MD5 of "id:seed"; of equal ones the smaller id.

    Hashes are counted by their first four digits; only the rows of the group that the border runs
    through, one in 65,536, are put in order.
    """
    hashed = rows.withColumn("__h", F.md5(F.concat_ws(":", F.col(id).cast("string"), F.lit(str(seed))))).withColumn("__b", F.substring("__h", 1, 4))
    sizes = hashed.groupBy("__b").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(W.orderBy(F.desc("__b")))  # 65,536 rows at most
    want = F.ceil(F.sum("n").over(W.partitionBy()) * F.lit(share))
    groups = sizes.select(F.col("__b").alias("b"), (upto <= want).alias("all"), (want - upto + F.col("n")).alias("room"))
    dealt = hashed.join(F.broadcast(groups), F.col("__b") == F.col("b"))
    border = ~F.col("all") & (F.col("room") > 0)
    rank = F.row_number().over(W.partitionBy("__b").orderBy(F.desc("__h"), id))
    sure = dealt.where(~border).select(*rows.columns, F.col("all").alias("is_val"))
    return sure.union(dealt.where(border).withColumn("__r", rank).select(*rows.columns, (F.col("__r") <= F.col("room")).alias("is_val")))


# ---- memories and lexicons ----


def translation_memory(pairs: DataFrame, src: str = "src", tgt: str = "tgt", order: str = "ord", key=retrieval_key, least: int = 4) -> DataFrame:
    """Columns key, value: the first target of each source text, then the last of each normalized key; keys under ``least`` characters go."""
    first = dedup_first(pairs.dropna(subset=[src, tgt]), src, order)
    keyed = first.withColumn("__k", key(F.col(src))).where(F.length("__k") >= least)
    return dedup_last(keyed, F.col("__k"), F.col(tgt), F.col(order))


def memory_lookup(rows: DataFrame, memory: DataFrame, key: Column, out: str = "exact") -> DataFrame:
    """``rows`` with the memory's value for their key, or NULL. Spark broadcasts the memory if its size allows."""
    m = memory.select(F.col("key").alias("__m"), F.col("value").alias(out))
    return rows.withColumn("__k", key).join(m, F.col("__k") == F.col("__m"), "left").drop("__k", "__m")


def name_lexicon(entries: DataFrame, norm: str = "norm", order: str = "ord", kind: str | None = "type", wanted: str = "PN") -> DataFrame:
    """Columns ascii, name: names whose plain lower-case form differs from them; the first of equal names, the last of equal forms."""
    rows = entries.where(F.col(kind) == wanted) if kind else entries
    rows = rows.select(strip(F.col(norm)).alias("name"), F.col(order).alias("o")).where("length(name) >= 3")
    first = rows.groupBy("name").agg(F.min("o").alias("o")).withColumn("ascii", F.lower(plain(F.col("name"))))
    kept = first.where((F.col("ascii") != F.lower("name")) & (F.length("ascii") >= 3))
    return kept.groupBy("ascii").agg(F.max_by("name", "o").alias("name"))


def restore_names(text: Column, names: dict[str, str]) -> Column:
    """Words that the lexicon knows in their full form; marks behind a word stay, those before it go, capitals are kept."""
    if not names:
        return text
    table, marks = lookup(names), "".join("\\" + c for c in EDGE_MARKS)

    def one(word: Column) -> Column:
        bare = F.lower(F.regexp_replace(word, rf"\A[{marks}]+|[{marks}]+\z", ""))
        name = F.try_element_at(table, bare)
        first = F.substring(word, 1, 1)
        capital = F.when((F.upper(first) == first) & (F.lower(first) != first), F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, F.lit(2), F.length(name)))).otherwise(name)
        return F.when(name.isNotNull(), F.concat(capital, F.regexp_extract(word, rf"([{marks}]*)\z", 1))).otherwise(word)

    return F.when(text.isNull() | (text == ""), text).otherwise(F.array_join(F.transform(tokens(text), one), " "))


# ---- label ids ----


def byte_ids(text: Column, most: int | None = None, pad_to: int | None = None) -> Column:
    """UTF-8 bytes plus 3 and the end id 1, cut to ``most`` and filled with 0 up to ``pad_to``."""
    raw = F.decode(F.encode(text_of(text), "utf-8"), "iso-8859-1")  # a character for each byte
    raw = raw if most is None else F.substring(raw, 1, most - 1)
    each = F.when(raw == "", F.array().cast("array<int>")).otherwise(F.transform(F.split(raw, ""), lambda c: F.ascii(c) + 3))
    ids = F.concat(each, F.array(F.lit(1)))
    return ids if pad_to is None else F.concat(ids, F.array_repeat(F.lit(0), F.greatest(F.lit(0), F.lit(pad_to) - F.size(ids))))


def masked_labels(ids: Column, pad: int = 0) -> Column:
    return F.transform(ids, lambda x: F.when(x == pad, -100).otherwise(x))


def unmasked_labels(ids: Column, size: int, pad: int = 0) -> Column:
    return F.transform(ids, lambda x: F.when((x < 0) | (x >= size), pad).otherwise(x))
