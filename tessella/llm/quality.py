"""Quality rules: fixed rules over document statistics, then boosted trees for what passes them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gbt
from .common import bound_batches
from .labelled import FOLDS, MAX_TRAIN_ROWS, training_rows

SYMBOLS = "#*$%&|<>"
WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 8, 20, 30
#: A document is kept if its calibrated chance of being good reaches this.
KEEP_FROM = 0.5
#: Words of a batch that are handled at one time.
_BLOCK_WORDS = 1 << 20

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "symbols", "bars", "dup_lines", "repeats", "word_length", "capitals", "bangs", "stops", "distinct", "line_words", "top_word", "digits", "marks", "symbol_words")
#: More of these never makes a document better.
MONOTONE = {FEATURES.index(f): -1 for f in ("symbols", "bars", "dup_lines", "repeats", "capitals", "bangs", "top_word", "symbol_words")}


def split_words(text: str) -> list[bytes]:
    """Maximal runs without blanks: bytes.split() parts at exactly U+0020 and U+0009 to U+000D."""
    return text.encode("utf-8", "surrogatepass").split()


def repeat_words(words: list[list[bytes]]) -> np.ndarray:
    """For each text, its words that lie in a window of eight words found twice or more in that text.

    Windows are named exactly, without hashes that could collide: pairs of words get a number,
    then pairs of pairs, then pairs of those.
    """
    size = np.fromiter(map(len, words), np.int64, len(words))
    total = int(size.sum())
    if total < WINDOW:
        return np.zeros(len(words), np.int64)
    doc = np.repeat(np.arange(len(words)), size)
    code = pd.factorize(np.array([w for ws in words for w in ws], object))[0].astype(np.int64)
    step = 1
    while step < WINDOW:
        code = pd.factorize(code[:-step] * np.int64(total + 1) + code[step:])[0].astype(np.int64)
        step *= 2
    n = len(code)
    inside = doc[:n] == doc[WINDOW - 1 :]
    key = pd.factorize(code * np.int64(len(words) + 1) + doc[:n])[0]
    twice = inside & (np.bincount(key, inside, minlength=1)[key] >= 2)
    change = np.zeros(total + 1, np.int64)
    change[np.flatnonzero(twice)] += 1
    change[np.flatnonzero(twice) + WINDOW] -= 1
    return np.bincount(doc, np.cumsum(change)[:-1] > 0, minlength=len(words)).astype(np.int64)


def line_stats(text: str) -> tuple[int, int]:
    """Lines with a word, and those of them that equal an earlier one."""
    lines = [x for x in text.split("\n") if x.strip(" \t\r\v\f")]
    return len(lines), len(lines) - len(set(lines))


def measure(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """STATS (integers) and FEATURES of whole texts, a row for each."""
    stats, feats = np.zeros((len(texts), len(STATS)), np.int64), np.zeros((len(texts), len(FEATURES)))
    held: list[list[bytes]] = []
    first = 0
    for i, t in enumerate(texts):
        words = split_words(t)
        held.append(words)
        n, chars = max(1, len(words)), sum(map(len, words))
        if not t.isascii():
            chars = len(t) - sum(map(t.count, " \t\n\r\v\f"))
        symbols = sum(map(t.count, SYMBOLS))
        lines, dups = line_stats(t)
        stats[i, :4] = len(words), chars, symbols, dups
        seen = pd.Series(words, dtype=object).value_counts() if words else None
        size = max(1, chars)
        upper = sum(map(t.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÉÈÊÀÇÑÍÓÁ"))
        short = sum(c for w, c in seen.items() if len(w) <= 3) if words else 0
        feats[i] = [
            np.log1p(len(words)), symbols / size, t.count("|") / n, dups / max(1, lines), 0, chars / n, upper / size, t.count("!") / n, short / n,
            (len(seen) if words else 0) / n, len(words) / max(1, lines), (int(seen.iloc[0]) if words else 0) / n, sum(map(t.count, "0123456789")) / size, sum(map(t.count, ".,;:?")) / n,
            sum(c for w, c in seen.items() if w[-1] in b"#*$%&|<>") / n if words else 0,
        ]
        if sum(map(len, held)) >= _BLOCK_WORDS or i + 1 == len(texts):
            stats[first : i + 1, 4] = repeat_words(held)
            first, held = i + 1, []
    feats[:, 4] = stats[:, 4] / np.maximum(1, stats[:, 0])
    return stats, feats


def base_failed(stats: np.ndarray) -> np.ndarray:
    return (stats[:, 0] < MIN_WORDS) | (100 * stats[:, 4] > MAX_REPEAT_PERCENT * stats[:, 0])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id: str = "doc_id", text: str = "text", max_rows: int = MAX_TRAIN_ROWS) -> gbt.Trees:
    """Trees for the chance that a text is good, fitted on at most ``max_rows`` labelled rows."""
    bound_batches(docs.sparkSession)

    def dense(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = pd.DataFrame(measure(list(b["text"]))[1], columns=FEATURES)
            yield out.assign(y=b["y"].to_numpy(), fold=b["fold"].to_numpy())

    schema = ", ".join(f"{f} double" for f in FEATURES) + ", y double, fold int"
    rows = training_rows(docs, labels, label, id, text, max_rows).mapInPandas(dense, schema).toPandas()
    rows = rows.sort_values(["fold", *FEATURES, "y"], kind="stable")
    x, y, fold = rows[list(FEATURES)].to_numpy(), rows["y"].to_numpy(), rows["fold"].to_numpy()
    out = np.zeros(len(y))
    for f in range(FOLDS):
        if (fold == f).any():
            out[fold == f] = gbt.fit(x[fold != f], y[fold != f], monotone=MONOTONE, trees=60).score(x[fold == f])
    trees = gbt.fit(x, y, monotone=MONOTONE, trees=60)
    if 0 < y.sum() < len(y):
        trees.knots = gbt.isotonic(out, y)
    return trees


RESULT = ", ".join(f"{s} long" for s in STATS) + ", base_failed boolean, quality double, kept boolean"


def with_quality(df: DataFrame, trees: gbt.Trees, text: str = "text", out: str = "quality_rules", keep_from: float = KEEP_FROM) -> DataFrame:
    """``df`` with a struct column: the statistics, whether a fixed rule fails, the score and the verdict.

    A null text counts as one without words, which fails. Other columns and repeated rows pass
    unchanged; a column named ``out`` is replaced.
    """
    bound_batches(df.sparkSession)

    @F.pandas_udf(RESULT)
    def rules(texts: pd.Series) -> pd.DataFrame:
        stats, feats = measure([t or "" for t in texts])
        failed, score = base_failed(stats), trees.score(feats)
        return pd.DataFrame({s: stats[:, i] for i, s in enumerate(STATS)} | {"base_failed": failed, "quality": score, "kept": ~failed & (score >= keep_from)})

    return df.withColumn(out, rules(F.col(text)))
