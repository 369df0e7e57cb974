"""The Arrow functions: NFKD without marks, Ratcliff-Obershelp similarity, n-gram overlaps, n-gram loops, monotone alignment, tails. Rules are in ``texts``."""

from __future__ import annotations

import difflib
import math
import re
from collections import Counter
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import texts
from .texts import unlooped  # noqa: F401

# Workers import this module, so UDFs are made where they are used and not at import.


def plain(text: Column) -> Column:
    """NFKD without combining marks; NULL stays."""
    return texts.over_texts(texts.plain, text)


def ratcliff(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp similarity as difflib has it: not symmetric, popular characters of long texts don't count. NULL gives NULL."""
    return F.pandas_udf(_ratcliff, "double")(a, b)


def _ratcliff(a: pd.Series, b: pd.Series) -> pd.Series:
    out = [None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)]
    return pd.Series(out, dtype="float64")


#: Texts whose counts a worker keeps; pairs that follow each other often share one.
_KEPT = 32


@lru_cache(_KEPT)
def _profile(items: str | tuple[str, ...], n: int) -> Counter:
    """How often each run of n characters, or of n items, is met."""
    if n == 1:
        return Counter(items)
    if isinstance(items, str):
        return Counter([items[i : i + n] for i in range(len(items) - n + 1)])
    return Counter(zip(*(items[i:] for i in range(n))))


_OVERLAPS = "array<struct<kind:string,n:int,common:long,in_a:long,in_b:long>>"


def _common(kind: str, a, b, orders: tuple[int, ...]) -> list[tuple]:
    out = []
    for n in orders:
        x, y = _profile(a, n), _profile(b, n)
        out.append((kind, n, sum(min(x[g], y[g]) for g in x.keys() & y.keys()), max(0, len(a) - n + 1), max(0, len(b) - n + 1)))
    return out


def text_overlaps(a: Column, b: Column, chars: tuple[int, ...] = (), words: tuple[int, ...] = ()) -> Column:
    """Clipped common n-grams and totals of two texts, for each order of characters ("char") and of words ("word"); NULL is empty."""

    def of(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            x, y = x or "", y or ""
            both = _common("char", x, y, chars)
            out.append(both + _common("word", tuple(x.split()), tuple(y.split()), words) if words else both)
        return pd.Series(out, dtype=object)

    return F.pandas_udf(of, _OVERLAPS)(a, b)


_13A = [(re.compile(p), new) for p, new in ((r"([\{-~\[-` -&\(-\+:-@/])", r" \1 "), (r"([^0-9])([.,])", r"\1 \2 "), (r"([.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 "))]
_MARKS = frozenset("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


def bleu_tokens(text: str) -> tuple[str, ...]:
    """The mteval-13a tokenization: marks and symbols apart, but not points and commas inside numbers."""
    for old, new in (("<skipped>", ""), ("-\n", ""), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        text = text.replace(old, new)
    text = " " + text.replace("\n", " ") + " "
    for pattern, new in _13A:
        text = pattern.sub(new, text)
    return tuple(text.split())


def chrf_words(text: str) -> tuple[str, ...]:
    """Words with one mark at an end taken off, the last one first."""
    out = []
    for w in text.split():
        if len(w) > 1 and w[-1] in _MARKS:
            out += w[:-1], w[-1]
        elif len(w) > 1 and w[0] in _MARKS:
            out += w[0], w[1:]
        else:
            out.append(w)
    return tuple(out)


@lru_cache(8)
def _scored(text: str, orders: tuple[tuple[str, tuple[int, ...]], ...]) -> list[tuple[str, int, Counter, int]]:
    """kind, order, counts and their sum: "b" for BLEU's tokens, "w" for chrF's words, "char" for characters without blanks."""
    of = {"b": bleu_tokens, "w": chrf_words, "char": lambda t: "".join(t.split())}
    out = []
    for kind, sizes in orders:
        items = of[kind](text)
        out += [(kind, n, _profile.__wrapped__(items, n), max(0, len(items) - n + 1)) for n in sizes]
    return out


@lru_cache(16)
def _score_counts(a: str, b: str, orders: tuple) -> list[tuple]:
    return [(kind, n, sum(min(x[g], y[g]) for g in x.keys() & y.keys()), in_a, in_b) for (kind, n, x, in_a), (_, _, y, in_b) in zip(_scored(a, orders), _scored(b, orders))]


def score_counts(a: Column, b: Column, orders: tuple[tuple[str, tuple[int, ...]], ...]) -> Column:
    """What corpus scores add up, for each kind and order. Rows that follow each other and share a text, or both, count it once."""

    def of(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_score_counts(x or "", y or "", orders) for x, y in zip(a, b)], dtype=object)

    return F.pandas_udf(of, _OVERLAPS)(a, b)


def without_loops(text: Column) -> Column:
    """Texts of under six words stay as they are, white space too; others come back with single blanks."""
    return texts.over_texts(texts.without_loops, text)


def aligned(src: list[str], tgt: list[str], most: int = 2) -> list[tuple[str, str]]:
    """Pair units in order, up to ``most`` of each at a time, by the nearest word counts; what is left joins the last pair."""
    i = j = 0
    pairs: list[list[str]] = []
    while i < len(src) and j < len(tgt):
        options = []
        for a in range(1, min(most, len(src) - i) + 1):
            for b in range(1, min(most, len(tgt) - j) + 1):
                s, t = " ".join(src[i : i + a]), " ".join(tgt[j : j + b])
                off = abs(math.log(max(1, len(s.split())) / max(1, len(t.split()))))
                options.append((off, len(options), a, b, s, t))
        _, _, a, b, s, t = min(options)
        pairs.append([s, t])
        i, j = i + a, j + b
    if pairs:
        pairs[-1] = [" ".join([pairs[-1][0], *src[i:]]), " ".join([pairs[-1][1], *tgt[j:]])]
    return [tuple(p) for p in pairs]


def align_monotone(src: Column, tgt: Column) -> Column:
    """Arrays of units as an array of pairs; see :func:`aligned`."""
    return F.pandas_udf(_align, "array<struct<src:string,tgt:string>>")(src, tgt)


def _align(src: pd.Series, tgt: pd.Series) -> pd.Series:
    return pd.Series([aligned(list(s) if s is not None else [], list(t) if t is not None else []) for s, t in zip(src, tgt)])


def with_tail(chosen: str, other: str) -> str:
    """``chosen`` with the words of ``other`` from where they best follow its last three words on."""
    mine, theirs = chosen.split(), other.split()
    if len(theirs) <= len(mine) + 3:
        return chosen
    end = " ".join(mine[max(len(mine) - 3, 0) :]).lower()
    near = [(difflib.SequenceMatcher(None, end, " ".join(theirs[max(0, j - 3) : j]).lower()).ratio(), -j) for j in range(len(theirs) // 2, len(theirs))]
    share, place = max(near, default=(0.0, 0))
    return f"{chosen} {' '.join(theirs[-place:])}".strip() if share > 0.3 else chosen


def tail_aligned(chosen: Column, other: Column) -> Column:
    return F.pandas_udf(_tails, "string")(chosen, other)


def _tails(chosen: pd.Series, other: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else with_tail(a, b) for a, b in zip(chosen, other)])
