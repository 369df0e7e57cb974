"""The best candidate of each group: minimum Bayes risk, consensus, confidence, votes. Rows: group, cand, text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.dialect import first_best, strip, text_of, tokens
from . import metrics as M

WEIGHTS = {"confidence": 0.4, "consistency": 0.3, "fluency": 0.2, "length": 0.1}


def distinct_candidates(cands: DataFrame, stripped: bool = False, weight: str | None = None) -> DataFrame:
    """Columns group, text, cand (the first of equal texts), n (rows of the group) and weight; with ``stripped`` blanks go."""
    text = strip(text_of(F.col("text"))) if stripped else text_of(F.col("text"))
    rows = cands.select("group", "cand", text.alias("text"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"))
    rows = rows.withColumn("n", F.count("*").over(W.partitionBy("group")))
    rows = rows.where("text <> ''") if stripped else rows
    return rows.groupBy("group", "text", "n").agg(F.min("cand").alias("cand"), F.sum("w").alias("weight"))


def candidate_pairs(unique: DataFrame) -> DataFrame:
    """Ordered pairs of different candidates of a group: group, i, j, a, b, w (of the second)."""
    a, b = unique.alias("a"), unique.alias("b")
    on = F.col("a.group").eqNullSafe(F.col("b.group")) & (F.col("a.cand") != F.col("b.cand"))
    return a.join(b, on).select(F.col("a.group").alias("group"), F.col("a.cand").alias("i"), F.col("b.cand").alias("j"), F.col("a.text").alias("a"), F.col("b.text").alias("b"), F.col("b.weight").alias("w"))


def mbr_scores(cands: DataFrame, utility="chrf", weight: str | None = None) -> DataFrame:
    """Columns group, cand, text, score of each different candidate: its mean utility against the others of its group.

    With ``weight`` the mean is weighted by the others' summed weights, or even where a group's are
    all 0. A group of one row scores 100; equal candidates only score 0, as nothing is compared.
    """
    unique = distinct_candidates(cands, weight=weight)
    if weight:
        total = F.sum("weight").over(W.partitionBy("group"))
        unique = unique.withColumn("weight", F.when(total > 0, F.col("weight") / total).otherwise(1.0))
    scored = candidate_pairs(unique).withColumn("u", M.utility(utility)(F.col("a"), F.col("b")))
    mean = F.when(F.sum("w") > 0, F.sum(F.col("w") * F.col("u")) / F.sum("w")).otherwise(0.0)
    of = scored.groupBy(F.col("group").alias("g"), F.col("i").alias("c")).agg(mean.alias("s"))
    joined = unique.join(of, F.col("group").eqNullSafe(F.col("g")) & (F.col("cand") == F.col("c")), "left")
    return joined.select("group", "cand", "text", F.when(F.col("n") == 1, 100.0).otherwise(F.coalesce("s", F.lit(0.0))).alias("score"))


def best_of(scored: DataFrame) -> DataFrame:
    """Columns group, cand, text, score: the best row of each group, the first of equals."""
    best = scored.groupBy("group").agg(first_best(F.round("score", 9), F.col("cand"), F.col("cand"), F.col("text"), F.col("score").alias("exact")).alias("b"))
    return best.select("group", "b.cand", "b.text", F.col("b.exact").alias("score"))


def mbr_select(cands: DataFrame, utility="chrf", weight: str | None = None) -> DataFrame:
    return best_of(mbr_scores(cands, utility, weight))


def mbr_details(cands: DataFrame, utility="chrf", weight: str | None = None) -> DataFrame:
    """Columns group, cand, text, score, n_candidates, n_unique, best: all rows, equal texts with one score; ``best`` marks the choice."""
    scores = mbr_scores(cands, utility, weight)
    chosen = best_of(scores).select(F.col("group").alias("g"), F.col("cand").alias("c"))
    unique = scores.groupBy(F.col("group").alias("u")).agg(F.count("*").alias("n_unique"))
    rows = cands.select("group", "cand", text_of(F.col("text")).alias("text")).withColumn("n_candidates", F.count("*").over(W.partitionBy("group")))
    scored = scores.select(F.col("group").alias("sg"), F.col("text").alias("st"), "score")
    out = rows.join(scored, F.col("group").eqNullSafe(F.col("sg")) & (F.col("text") == F.col("st")))
    out = out.join(chosen, F.col("group").eqNullSafe(F.col("g"))).join(unique, F.col("group").eqNullSafe(F.col("u")))
    return out.select("group", "cand", "text", "score", "n_candidates", "n_unique", (F.col("cand") == F.col("c")).alias("best"))


def consensus_select(cands: DataFrame, refs: DataFrame | None = None, external: float = 0.3) -> DataFrame:
    """The candidate that agrees most with the others, and with outside references (group, ref_text, ref_weight) by a share of ``external``.

    Texts are stripped, blank ones left out; a group of blanks only gives its first row. Groups of
    one different text keep it. Agreement is the mean chrF++ of precision and recall.
    """
    unique = distinct_candidates(cands, stripped=True)
    inner = candidate_pairs(unique).withColumn("u", M.mean_chrf(F.col("a"), F.col("b")))
    inner = inner.groupBy(F.col("group").alias("g"), F.col("i").alias("c")).agg(F.avg("u").alias("inner"))
    scored = unique.join(inner, F.col("group").eqNullSafe(F.col("g")) & (F.col("cand") == F.col("c")), "left").drop("g", "c")
    score = F.coalesce("inner", F.lit(0.0))
    if refs is not None:
        theirs = refs.select(F.col("group").alias("g"), text_of(F.col("ref_text")).alias("b"), F.col("ref_weight").cast("double").alias("w")).where(strip(F.col("b")) != "")
        pairs = unique.join(theirs, F.col("group").eqNullSafe(F.col("g"))).select("group", "cand", F.col("text").alias("a"), "b", "w")
        outer = pairs.withColumn("u", M.mean_chrf(F.col("a"), F.col("b")))
        outer = outer.groupBy(F.col("group").alias("g"), F.col("cand").alias("c")).agg(F.when(F.sum("w") > 0, F.sum(F.col("w") * F.col("u")) / F.sum("w")).otherwise(0.0).alias("outer"))
        scored = scored.join(outer, F.col("group").eqNullSafe(F.col("g")) & (F.col("cand") == F.col("c")), "left").drop("g", "c")
        groups = refs.select(F.col("group").alias("g"), F.lit(True).alias("has")).distinct()
        scored = scored.join(groups, F.col("group").eqNullSafe(F.col("g")), "left")
        if external > 0:
            score = F.when(F.col("has"), (1 - external) * score + external * F.coalesce("outer", F.lit(0.0))).otherwise(score)
    chosen = best_of(scored.select("group", "cand", "text", score.alias("score")))
    first = cands.groupBy("group").agg(F.min(F.struct("cand", text_of(F.col("text")).alias("text"))).alias("f")).select(F.col("group").alias("g"), "f")
    out = first.join(chosen, F.col("group").eqNullSafe(F.col("g")), "left")
    return out.select(F.col("g").alias("group"), F.coalesce("cand", "f.cand").alias("cand"), F.coalesce("text", "f.text").alias("text"), F.coalesce("score", F.lit(0.0)).alias("score"))


def consistency(cands: DataFrame, similarity=M.combined_similarity) -> DataFrame:
    """Columns group, n, avg_similarity, voting, best_i, best_j, best_similarity, consistency.

    Mean similarity of all pairs (0.6) and the share of words that several candidates hold (0.4).
    Groups of one candidate have 0.5 throughout. Best pair: the first of equals, by place.
    """
    rows = cands.select("group", "cand", text_of(F.col("text")).alias("text"))
    rows = rows.withColumn("at", F.row_number().over(W.partitionBy("group").orderBy("cand")) - 1)
    a, b = rows.alias("a"), rows.alias("b")
    pairs = a.join(b, F.col("a.group").eqNullSafe(F.col("b.group")) & (F.col("a.at") < F.col("b.at")))
    pairs = pairs.select(F.col("a.group").alias("g"), F.col("a.at").alias("i"), F.col("b.at").alias("j"), similarity(F.col("a.text"), F.col("b.text")).alias("sim"))
    best = F.max(F.struct("sim", (-F.col("i")).alias("i"), (-F.col("j")).alias("j"))).alias("best")
    pairs = pairs.groupBy("g").agg(F.avg("sim").alias("avg"), best)
    words = rows.select("group", F.explode(F.array_distinct(tokens(F.lower("text")))).alias("word")).groupBy("group", "word").count()
    votes = words.groupBy(F.col("group").alias("v")).agg((F.count_if(F.col("count") > 1) / F.count("*")).alias("vote"))
    sizes = rows.groupBy("group").agg(F.count("*").alias("n"))
    out = sizes.join(pairs, F.col("group").eqNullSafe(F.col("g")), "left").join(votes, F.col("group").eqNullSafe(F.col("v")), "left")
    alone, vote, none = F.col("n") < 2, F.coalesce("vote", F.lit(0.5)), F.coalesce(F.col("best.sim"), F.lit(0.0)) <= 0
    return out.select(
        "group",
        "n",
        F.when(alone, 0.5).otherwise(F.col("avg")).alias("avg_similarity"),
        F.when(alone, 0.5).otherwise(vote).alias("voting"),
        F.when(alone | none, 0).otherwise(-F.col("best.i")).alias("best_i"),
        F.when(alone | none, 0).otherwise(-F.col("best.j")).alias("best_j"),
        F.when(alone, 1.0).otherwise(F.col("best.sim")).alias("best_similarity"),
        F.when(alone, 0.5).otherwise(F.least(F.lit(1.0), 0.6 * F.col("avg") + 0.4 * vote)).alias("consistency"),
    )


def candidate_score(text: Column, source: Column, seq_score: Column, consistent: Column, weights: dict[str, float] = WEIGHTS) -> Column:
    """The weighted mean of confidence, consistency (0.5 if NULL), fluency and fit of lengths."""
    total = sum(weights.values())
    parts = {"confidence": M.confidence(seq_score), "consistency": F.coalesce(consistent, F.lit(0.5)), "fluency": M.fluency(text), "length": M.length_fit(source, text)}
    return sum((parts[k] * (w / total) for k, w in weights.items()), F.lit(0.0))


def confidence_select(cands: DataFrame, threshold: float = 0.5, similarity=M.combined_similarity, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """The best candidate (group, cand, text, source, seq_score) where unsure ones are held against each other.

    Candidates whose confidence reaches ``threshold`` have consistency 1; for the others it is 0.3 of
    their confidence and 0.7 of how far the unsure ones of the group agree. Returns group, cand,
    text, score, high_confidence_count, low_confidence_count, high_confidence, method.
    """
    rows = cands.select("group", "cand", text_of(F.col("text")).alias("text"), text_of(F.col("source")).alias("source"), "seq_score").withColumn("conf", M.confidence(F.col("seq_score")))
    low = consistency(rows.where(F.col("conf") < threshold), similarity).select(F.col("group").alias("g"), F.col("consistency").alias("c"))
    joined = rows.join(low, F.col("group").eqNullSafe(F.col("g")), "left")
    consistent = F.when(F.col("conf") >= threshold, 1.0).otherwise(0.3 * F.col("conf") + 0.7 * F.col("c"))
    score = candidate_score(F.col("text"), F.col("source"), F.col("seq_score"), consistent, weights)
    scored = joined.withColumn("score", score)
    best = first_best(F.round("score", 9), F.col("cand"), F.col("cand"), F.col("text"), F.col("score").alias("exact")).alias("b")
    out = scored.groupBy("group").agg(best, F.count_if(F.col("conf") >= threshold).alias("high"), F.count_if(F.col("conf") < threshold).alias("low"))
    sure = (F.col("high") > 0) | (F.col("b.exact") >= 0.7)
    return out.select("group", "b.cand", "b.text", F.col("b.exact").alias("score"), F.col("high").alias("high_confidence_count"), F.col("low").alias("low_confidence_count"), sure.alias("high_confidence"), F.when(sure, "high_confidence").otherwise("confidence_filtering").alias("method"))


def select_best(cands: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """The best candidate by :func:`candidate_score`; ``consistent`` is a column of the rows or NULL."""
    consistent = F.col("consistent") if "consistent" in cands.columns else F.lit(None).cast("double")
    rows = cands.withColumn("text", text_of(F.col("text"))).withColumn("score", candidate_score(text_of(F.col("text")), text_of(F.col("source")), F.col("seq_score"), consistent, weights))
    return best_of(rows)


def top_words(cands: DataFrame, k: int = 3, words: int = 5, score: str = "seq_score") -> DataFrame:
    """Columns group, text: the most frequent words of the k best candidates, the first met of equals; no words give the first candidate."""
    rank = F.row_number().over(W.partitionBy("group").orderBy(F.desc(score), F.desc("cand")))
    top = cands.withColumn("rank", rank).where(F.col("rank") <= k)
    each = top.select("group", (-F.col("rank")).alias("order"), F.posexplode(tokens(text_of(F.col("text")))).alias("at", "word"))
    counted = each.groupBy("group", "word").agg(F.count("*").alias("n"), F.min(F.struct("order", "at")).alias("first"))
    voted = counted.withColumn("r", F.row_number().over(W.partitionBy("group").orderBy(F.desc("n"), "first"))).where(F.col("r") <= words)
    voted = voted.groupBy(F.col("group").alias("g")).agg(F.array_sort(F.collect_list(F.struct("r", "word"))).alias("ws"))
    first = cands.groupBy("group").agg(F.min(F.struct("cand", text_of(F.col("text")).alias("text"))).alias("f"))
    out = first.join(voted, F.col("group").eqNullSafe(F.col("g")), "left")
    return out.select("group", F.coalesce(F.array_join(F.transform("ws", lambda w: w["word"]), " "), "f.text").alias("text"))


def weighted_choice(cands: DataFrame, score: str = "score", seed: int = 42) -> DataFrame:
    """One candidate of each group, drawn with a chance in proportion to its score; a seed gives one draw for good."""
    name = F.md5(F.concat_ws(":", F.col("group").cast("string"), F.col("cand").cast("string"), F.lit(str(seed))))
    u = (F.conv(F.substring(name, 1, 12), 16, 10).cast("double") + 1) / float((1 << 48) + 1)
    rows = cands.where(F.col(score) > 0).withColumn("key", -F.log(u) / F.col(score))
    return rows.groupBy("group").agg(F.min(F.struct("key", "cand", "text")).alias("b")).select("group", "b.cand", "b.text")


def best_model(cands: DataFrame, score: str = "seq_score") -> DataFrame:
    """The best row over models; a failed one has no score and counts as -1."""
    return best_of(cands.select("group", "cand", "text", F.coalesce(score, F.lit(-1.0)).alias("score")))


def non_blank(cands: Column) -> Column:
    """An array of candidates without blanks; one empty candidate where nothing is left."""
    kept = F.filter(cands, lambda c: c.isNotNull() & (strip(c) != ""))
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit("")))
