"""Rule cascades: the first rule that answers wins. Dear steps run on the rows only that reach them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import clean as C
from ..functions.arrow import tail_aligned
from ..functions.dialect import blank, collapse, let, strip, text_of, tokens
from ..functions.tables import DICTIONARY, DICTIONARY_ADAPTER, DICTIONARY_ASCII
from ..operators import corpus, metrics, select
from ..sources.files import numbered, read_csv, scratch, written

# ---- one row at a time ----


def model_cascade(source: Column, model: Column) -> Column:
    """Dictionary, then "..." for broken sources, then the model's text, cleaned and capped."""
    answer = C.cap_length(C.postprocess(model), source)
    return F.coalesce(C.dictionary_lookup(source), F.when(C.is_broken(source), F.lit("...")), answer)


def retrieval_cascade(source: Column, found: Column) -> Column:
    return F.coalesce(C.dictionary_lookup(source), F.when(C.is_broken(source), F.lit("...")), text_of(found))


def retrieval_only_cascade(source: Column, found: Column) -> Column:
    answer = F.coalesce(C.dictionary_lookup(source, DICTIONARY_ASCII), found)
    return C.or_default(C.postprocess_retrieved(answer))


def adapter_cascade(source: Column, model: Column) -> Column:
    return F.coalesce(C.dictionary_lookup(source, DICTIONARY_ADAPTER), F.when(C.is_broken_adapter(source), F.lit("...")), C.postprocess_adapter(model, source))


def plain_pipeline(model: Column) -> Column:
    """Cleaned with "hnr" for blanks, without big gaps."""
    return C.strip_big_gaps(C.postprocess_plain(model))


def edit_cascade(source: Column, model: Column, edited: Column, lexicon: dict[str, list[str]]) -> Column:
    """The model's text, its edit where that is sound; a failed row (NULL) gets a text made of what is known."""

    t = C.postprocess_plain(model, "")
    refined = C.postprocess_plain(C.accepted_edit(edited, t), "")
    better = F.when((F.length(t) > 10) & (F.length(refined) > 10) & (F.length(refined) < 2 * F.length(t)), refined).otherwise(t)
    told = let(better, lambda b: F.when(F.length(b) < 3, F.lit("<gap> translation unavailable <gap>")).otherwise(b))
    return F.when(model.isNull(), C.fallback_text(source, lexicon)).otherwise(told)


def threshold_hybrid(found: Column, score: Column, model: Column, threshold: Column | float) -> Column:
    return F.when((score > threshold) & (text_of(found) != ""), found).otherwise(model)


def tail_hybrid(source: Column, model: Column, found: Column, least: Column | int, most: int = 350) -> Column:
    """For long sources the model's first ``most`` characters and the found text from the blank nearest to that length on."""

    def joined(t: Column) -> Column:
        size = F.least(F.length(model), F.lit(most))
        blanks = F.filter(F.sequence(F.lit(0), F.greatest(F.length(t), F.lit(1)) - 1), lambda i: F.substring(t, i + 1, F.lit(1)) == " ")
        cut = F.array_min(F.transform(blanks, lambda p: F.struct(F.abs(p - size).alias("d"), p.alias("p"))))["p"]
        both = F.concat(F.substring(model, 1, most), F.substring(t, cut + 1, F.length(t)))
        use = (F.length(text_of(source)) >= least) & (t != "") & (F.length(t) > F.length(model))
        return F.when(use, F.coalesce(both, model)).otherwise(model)

    return let(text_of(found), joined)


def refined(first: Column, second: Column) -> Column:
    """A second pass is taken if it has over three characters, is no garbage, and keeps 0.4 of the words; then ASCII, never blank."""

    def pick(s: Column) -> Column:
        sound = (F.length(strip(text_of(second))) > 3) & (s != "") & ~C.is_garbage(s)
        long = (F.size(tokens(s)) >= 0.4 * F.size(tokens(first))) | (F.size(tokens(first)) < 5)
        return F.when(sound & long, s).otherwise(first)

    chosen = let(C.postprocess_ascii(text_of(second)), pick)
    return C.or_default(collapse(C.to_ascii(text_of(chosen))))


def adaptive_width(rows: int, budget_s: float, costs: dict[int, float]) -> int:
    """The widest setting whose cost for all rows is under the budget, else 1."""
    return max((w for w, c in costs.items() if c * rows < budget_s), default=1)


# ---- tables ----


def translate(rows: DataFrame, cands: DataFrame, threshold: float = 0.5, similarity=metrics.combined_similarity) -> DataFrame:
    """Columns id, translation, confidence, high_confidence, method, candidates for rows (id, text) and their candidates (id, cand, text, seq_score).

    Candidates come from any model, a beam of one or of many; one row is a batch of one. The first
    three are named; a row without any has an empty translation and confidence 0.
    """
    sources = rows.select(F.col("id").alias("i"), text_of(F.col("text")).alias("source"))
    known = cands.select(F.col("id").alias("group"), "cand", "text", "seq_score").join(sources, F.col("group").eqNullSafe(F.col("i"))).drop("i")
    best = select.confidence_select(known, threshold, similarity).select(F.col("group").alias("g"), "text", "score", "high_confidence", "method")
    first = F.slice(F.array_sort(F.collect_list(F.struct("cand", text_of(F.col("text")).alias("text")))), 1, 3)
    named = known.withColumn("r", F.row_number().over(W.partitionBy("group").orderBy("cand"))).where("r <= 3")
    named = named.groupBy(F.col("group").alias("n")).agg(F.transform(first, lambda c: c["text"]).alias("candidates"))
    out = rows.select("id").join(best, F.col("id").eqNullSafe(F.col("g")), "left").join(named, F.col("id").eqNullSafe(F.col("n")), "left")
    none = F.array().cast("array<string>")
    return out.select("id", text_of(F.col("text")).alias("translation"), F.coalesce("score", F.lit(0.0)).alias("confidence"), F.coalesce("high_confidence", F.lit(False)).alias("high_confidence"), F.coalesce("method", F.lit("confidence_filtering")).alias("method"), F.coalesce("candidates", none).alias("candidates"))


def translate_csv(spark: SparkSession, path: str, candidates: Callable[[DataFrame], DataFrame], column: str = "transliteration", **how) -> DataFrame:
    """:func:`translate` for a column of a CSV file; ids are the places of its rows, and ``candidates`` makes candidates of rows (id, text)."""
    rows = numbered(read_csv(spark, path).select(text_of(F.col(f"`{column}`")).alias("text")), "id")
    return translate(rows, candidates(rows), **how).drop("candidates")


HIGH, FAIR, LOW, LONG = 0.70, 0.30, 0.15, 256


def first_tier(rows: DataFrame, cands: DataFrame, memory: DataFrame, key, external: float = 0.3) -> DataFrame:
    """Columns sample_id, text, method for rows (sample_id, source, found, found_score) and candidates (sample_id, cand, text).

    Dictionary, exact memory, retrieval if all candidates are garbage or its score is high, else the
    candidates' consensus, with the retrieved tail behind short answers to long sources. Rows that
    an earlier rule answers never reach a later one.
    """
    base = rows.select("sample_id", text_of(F.col("source")).alias("source"), text_of(F.col("found")).alias("found"), F.coalesce("found_score", F.lit(0.0)).alias("found_score"))
    base = base.withColumn("short", C.dictionary_lookup(F.col("source"), DICTIONARY_ASCII))
    short = base.where("short is not null").select("sample_id", F.col("short").alias("text"), F.lit("short").alias("method"))
    # read several times below, and behind an Arrow function
    looked = written(corpus.memory_lookup(base.where("short is null"), memory, key(F.col("source"))), scratch(rows.sparkSession, "looked"))
    exact = looked.where("exact is not null").select("sample_id", C.postprocess_ascii(F.col("exact")).alias("text"), F.lit("exact").alias("method"))
    open_rows = looked.where("exact is null").withColumn("tr", C.postprocess_ascii(F.col("found"))).drop("short", "exact")
    open_rows = written(open_rows, scratch(rows.sparkSession, "open"))
    cleaned = cands.join(open_rows.select(F.col("sample_id").alias("s")), F.col("sample_id") == F.col("s")).select(F.col("sample_id").alias("group"), "cand", C.postprocess_ascii(F.col("text")).alias("text"))
    sound = written(cleaned.where((F.col("text") != "") & ~C.is_garbage(F.col("text"))), scratch(rows.sparkSession, "sound"))
    counted = sound.groupBy(F.col("group").alias("g")).agg(F.count("*").alias("sound"))
    state = open_rows.join(counted, F.col("sample_id") == F.col("g"), "left").drop("g")
    none = F.col("sound").isNull()
    strong = (F.col("found_score") >= HIGH) & (F.col("tr") != "")
    by_search = state.where(none | strong).select("sample_id", F.col("tr").alias("text"), F.lit("trtry").alias("method"))
    vote = state.where(~(none | strong))
    refs = vote.where((F.col("tr") != "") & (F.col("found_score") > LOW)).select(F.col("sample_id").alias("group"), F.col("tr").alias("ref_text"), F.col("found_score").alias("ref_weight"))
    voters = sound.join(vote.select(F.col("sample_id").alias("v")), F.col("group") == F.col("v"), "left_semi")
    chosen = select.consensus_select(voters, refs, external).select(F.col("group").alias("c"), F.col("text").alias("chosen"))
    joined = vote.join(chosen, F.col("sample_id") == F.col("c"))
    extend = (F.length("source") > LONG) & (F.col("tr") != "") & (F.length("chosen") < 0.6 * F.length("tr")) & (F.col("found_score") > FAIR)
    tail = joined.where(extend).select("sample_id", tail_aligned(F.col("chosen"), F.col("tr")).alias("text"), F.lit("byt5").alias("method"))
    rest = joined.where(~extend).select("sample_id", F.col("chosen").alias("text"), F.lit("byt5").alias("method"))
    return short.union(exact).union(by_search).union(tail).union(rest)


def hybrid_grid(rows: DataFrame, thresholds: list[float]) -> DataFrame:
    """``rows`` (sample_id, source, model, found, score, reference) once for each threshold: pattern, sample_id, prediction, reference."""
    each = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("t")
    return rows.select("*", each).select(F.concat(F.lit("E>"), F.col("t").cast("string")).alias("pattern"), "sample_id", threshold_hybrid(F.col("found"), F.col("score"), F.col("model"), F.col("t")).alias("prediction"), "reference")


def cap_grid(rows: DataFrame, shares: list[float], plus: list[int], keep_uncapped: bool = True) -> DataFrame:
    """Cleaned model texts (once) capped by every setting: share, plus, sample_id, prediction, reference; NULL share: no cap."""
    clean = rows.select("sample_id", "source", C.postprocess(F.col("model")).alias("p"), "reference")
    settings = [F.struct(F.lit(float(s)).alias("share"), F.lit(p).alias("plus")) for s in shares for p in plus]
    if keep_uncapped:
        settings.append(F.struct(F.lit(None).cast("double").alias("share"), F.lit(None).cast("int").alias("plus")))
    each = clean.select("*", F.explode(F.array(*settings)).alias("g")).select("sample_id", "source", "p", "reference", "g.share", "g.plus")
    cut = F.when(F.col("share").isNull(), F.col("p")).otherwise(C.cap_length(F.col("p"), F.col("source"), F.col("share"), F.col("plus"), None))
    return each.select("share", "plus", "sample_id", F.when(blank(cut), F.lit("")).otherwise(cut).alias("prediction"), "reference")


def grid_best(scored: DataFrame, order: list[str], score: str = "geo_mean") -> DataFrame:
    """The row with the best score, the first in ``order`` of equals."""
    return scored.orderBy(F.desc(score), *order).limit(1)


def pattern_report(patterns: DataFrame, baseline: str) -> DataFrame:
    """Corpus scores of each pattern (pattern, sample_id, prediction, reference) and how many predictions differ from the baseline's."""
    scores = metrics.corpus_scores(patterns, "prediction", "reference", ("pattern",))
    base = patterns.where(F.col("pattern") == baseline).select(F.col("sample_id").alias("s"), F.col("prediction").alias("b"))
    changed = patterns.join(base, F.col("sample_id") == F.col("s"), "left").groupBy(F.col("pattern").alias("p")).agg(F.count_if(~F.col("prediction").eqNullSafe(F.col("b"))).alias("changed"))
    return scores.join(changed, F.col("pattern") == F.col("p")).drop("p")
