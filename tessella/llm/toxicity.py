"""Toxicity scores: boosted trees over dense features, with isotonic calibration.

The lexicon has known English insults and, learned from the training rows, words and word
beginnings that toxic documents hold far more often than others. Features are densities of
lexicon words, their nearness to second-person words, capitals, punctuation and disguised
spellings. While the trees are fitted, a document's features use a lexicon that was learned
without its fold, so the trees see lexicon hits as they fall on new documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gbt
from .common import bound_batches, drop_table, materialize
from .labelled import FOLDS, MAX_TRAIN_ROWS, training_rows

THRESHOLD = 0.7
INSULTS = frozenset("idiot idiots moron morons stupid loser losers scum trash clown clowns pathetic worthless disgusting dumb garbage jerk vermin filth creep freak imbecile".split())
YOU = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer usted ustedes ti tuyo vosotros".split())
#: Learned entries: of a word's beginnings, those of these lengths; seen in so many toxic training documents; so strong.
PREFIXES, LEAST_SEEN, LEAST_ODDS, MAX_ENTRIES = (3, 4, 5, 6, 7), 6, 2.0, 4000
_WORD = re.compile(r"[^\W_]+(?:[*@$!|'’._-][^\W_]+)*")
_LEET = str.maketrans("0134578@$!|", "oieastbasil")
_DISGUISE = re.compile(r"[^\w]|[0-9]")
_CACHED = 1 << 18

FEATURES = ("log_words", "hits_per_100", "log_hits", "distinct_hits", "top_score", "score_per_word", "strong_hits_per_100", "disguised_per_100", "near_you", "you_per_100", "capitals", "shouting", "marks", "repeats", "word_length", "other_per_100")
#: More lexicon hits never make a document less toxic.
MONOTONE = {FEATURES.index(f): 1 for f in ("log_hits", "distinct_hits", "top_score", "near_you")}


def tokens(word: str) -> list[str]:
    return [word, *(f"{word[:k]}*" for k in PREFIXES if len(word) > k)]


class Lexicon(dict):
    """Word to score, worked out when a word is first met; a bounded memory, not a bound on words."""

    def __init__(self, entries: dict[str, float]):
        self.entries = {w: 4.0 for w in INSULTS} | entries

    def __missing__(self, word: str) -> float:
        if len(self) >= _CACHED:
            self.clear()
        plain = _DISGUISE.sub("", word.translate(_LEET)) if _DISGUISE.search(word) else word
        if plain != word and (plain in INSULTS or self.entries.get(plain, 0) >= LEAST_ODDS):
            got = -max(4.0, self.entries.get(plain, 0))  # negative: a disguised hit
        else:
            got = max((self.entries.get(t, 0.0) for t in tokens(word)), default=0.0)
        self[word] = got
        return got


def features(text: str, lexicon: Lexicon) -> list[float]:
    """The features of a whole text; an empty text has zeros."""
    low = text.lower()
    words = _WORD.findall(low)
    n = max(1, len(words))
    signed = np.fromiter(map(lexicon.__getitem__, words), float, len(words))
    score = np.abs(signed)
    at = np.flatnonzero(score)
    you = np.array([i for i, w in enumerate(words) if w in YOU], int) if not YOU.isdisjoint(words) else np.empty(0, int)
    near = 0
    if len(at) and len(you):
        k = np.searchsorted(you, at)
        gap = np.minimum(np.abs(you[np.minimum(k, len(you) - 1)] - at), np.abs(you[np.maximum(k - 1, 0)] - at))
        near = int((gap <= 5).sum())
    hits = Counter(words[i] for i in at)
    upper = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    chars = max(1, len(text))
    strong = int((score >= 3).sum())
    return [
        float(np.log1p(len(words))), 100 * len(at) / n, float(np.log1p(len(at))), float(len(hits)), float(score.max()) if len(score) else 0.0,
        float(score.sum()) / n, 100 * strong / n, 100 * float((signed < 0).sum()) / n, float(near), 100 * len(you) / n, upper / chars,
        text.count("!") / chars, sum(map(text.count, ".,;:?*#$%&|")) / chars, max(hits.values(), default=0) / max(1, len(at)), len(low) / n, 100 * float((score < 3).sum() - (score == 0).sum()) / n,
    ]


@dataclass
class Model:
    trees: gbt.Trees
    entries: dict[str, float]


def _learn(counts: pd.DataFrame, totals: pd.DataFrame, without: int | None, max_entries: int) -> dict[str, float]:
    """Entries by smoothed log odds; of entries with like counts the shorter beginnings and words compete freely."""
    c, t = (x if without is None else x[x["fold"] != without] for x in (counts, totals))
    pos, neg = max(1.0, t["pos"].sum()), max(1.0, t["neg"].sum())
    g = c.groupby("token", sort=True)[["pos", "neg"]].sum()
    g = g[g["pos"] >= LEAST_SEEN]
    odds = np.log((g["pos"] + 0.5) / (pos + 1)) - np.log((g["neg"] + 0.5) / (neg + 1))
    # a word that is only as frequent as chance allows gets less: one standard error is taken off
    odds -= np.sqrt(1 / (g["pos"] + 0.5) + 1 / (g["neg"] + 0.5)) * 0.5
    odds = odds[odds >= LEAST_ODDS].sort_values(ascending=False, kind="stable")
    return odds.head(max_entries).round(6).to_dict()


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id: str = "doc_id", text: str = "text", max_rows: int = MAX_TRAIN_ROWS, max_entries: int = MAX_ENTRIES) -> Model:
    """Fit on at most ``max_rows`` labelled rows that are not held out. Without any, all scores are one constant.

    The model has the ``max_entries`` strongest words and beginnings of words of these rows.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = materialize(training_rows(docs, labels, label, id, text, max_rows), "train")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple[str, int], list[int]] = {}
        for b in batches:
            for t, y, fold in zip(b["text"], b["y"], b["fold"]):
                for token in {x for w in set(_WORD.findall(t.lower())) for x in tokens(w)}:
                    seen.setdefault((token, fold), [0, 0])[int(y == 0)] += 1
            if len(seen) > 1 << 20:
                yield frame(seen)
                seen = {}
        yield frame(seen)

    def frame(seen: dict) -> pd.DataFrame:
        return pd.DataFrame([(*k, *v) for k, v in seen.items()], columns=["token", "fold", "pos", "neg"])

    raw = rows.mapInPandas(count, "token string, fold int, pos long, neg long")
    by_fold = raw.groupBy("token", "fold").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    often = by_fold.groupBy("token").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"), *[F.sum(F.when(F.col("fold") == f, F.col(c)).otherwise(0)).alias(f"{c}{f}") for f in range(FOLDS) for c in ("pos", "neg")])
    totals = rows.groupBy("fold").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")).toPandas()
    pos, neg = max(1.0, totals["pos"].sum()), max(1.0, totals["neg"].sum())
    # at most max_entries * 4 tokens of the bounded sample reach the driver
    strength = F.log((F.col("p") + 0.5) / (pos + 1)) - F.log((F.col("n") + 0.5) / (neg + 1))
    wide = often.where(F.col("p") >= LEAST_SEEN).withColumn("s", strength).where(F.col("s") >= LEAST_ODDS - 0.5)
    wide = wide.orderBy(F.desc("s"), "token").limit(4 * max_entries).toPandas()
    counts = pd.concat([pd.DataFrame({"token": wide["token"], "fold": f, "pos": wide[f"pos{f}"], "neg": wide[f"neg{f}"]}) for f in range(FOLDS)])
    by = {f: _learn(counts, totals, f, max_entries) for f in [*range(FOLDS), None]}

    def dense(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicons = {f: Lexicon(by[f]) for f in range(FOLDS)}
        for b in batches:
            yield pd.DataFrame([[y, fold, *features(t, lexicons[fold])] for t, y, fold in zip(b["text"], b["y"], b["fold"])], columns=["y", "fold", *FEATURES])

    schema = "y double, fold int, " + ", ".join(f"{f} double" for f in FEATURES)
    train = rows.mapInPandas(dense, schema).toPandas().sort_values(["fold", *FEATURES, "y"], kind="stable")
    drop_table(rows)
    x, y, fold = train[list(FEATURES)].to_numpy(), train["y"].to_numpy(), train["fold"].to_numpy()
    out = np.full(len(y), 0.0)
    for f in range(FOLDS):
        part = fold == f
        if part.any():
            out[part] = gbt.fit(x[~part], y[~part], monotone=MONOTONE).score(x[part])
    trees = gbt.fit(x, y, monotone=MONOTONE)
    if 0 < y.sum() < len(y):
        trees.knots = gbt.isotonic(out, y)
    return Model(trees, by[None])


def with_toxicity(df: DataFrame, model: Model, text: str = "text", out: str = "toxicity") -> DataFrame:
    """``df`` with a double column: each whole text's score from 0 to 1, higher for likelier toxic.

    Null texts score as empty ones. Other columns and repeated rows pass unchanged; equal texts
    have equal scores; a column named ``out`` is replaced. Nothing but the text enters a score.
    """
    bound_batches(df.sparkSession)
    trees, entries = model.trees, model.entries

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lexicon = Lexicon(entries)
        for texts in batches:
            x = np.array([features(t or "", lexicon) for t in texts], float).reshape(-1, len(FEATURES))
            yield pd.Series(trees.score(x))

    return df.withColumn(out, score(F.col(text)))

