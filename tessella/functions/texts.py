"""The target-side rules and the key of sources as plain Python over Arrow batches.

They mean what the rules of ``tables`` mean one after the other, but look first for what a rule
can't do without, which most texts lack, and compare words by a hash first. As chains of regular
expressions in Spark they took some 2 to 8 microseconds a character. A text takes time in
proportion to its length, and a batch is turned into Python a few texts at a time.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables as T

#: Bytes of text that are Python objects at a time; a longer text is alone.
SLICE_BYTES = 1 << 20


def over_texts(rule: Callable[[str], str], text: Column, null: str | None = None) -> Column:
    """``rule`` for each text; NULL gives ``null``. Besides the batch as it came and the one that goes, a slice is held."""

    def of(batch: pa.Array) -> pa.Array:
        return mapped(batch, rule, null)

    # workers import this module, so UDFs are made where they are used and not at import
    return F.arrow_udf(of, "string")(text)


def mapped(batch: pa.Array, rule: Callable[[str], str], null: str | None = None) -> pa.Array:
    rows = max(1, min(len(batch), SLICE_BYTES * len(batch) // max(1, batch.nbytes)))
    parts = [pa.array([null if t is None else rule(t) for t in batch.slice(at, rows).to_pylist()], pa.string()) for at in range(0, len(batch), rows)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def capped(text: str, most: int | None) -> str:
    """Whole words while their lengths, a blank each, stay within ``most``; the first always stays. Shorter texts are not touched."""
    if most is not None and len(text) <= most:
        return text
    words, size = text.split(), 0
    for n, w in enumerate(words):
        size += len(w) + 1
        if most is not None and size > most and n:
            return " ".join(words[:n])
    return " ".join(words)


def capped_texts(text: Column, most: Column) -> Column:
    def of(batch: pa.Array, most: pa.Array) -> pa.Array:
        return pa.array([None if t is None else capped(t, m) for t, m in zip(batch.to_pylist(), most.to_pylist())], pa.string())

    return F.arrow_udf(of, "string")(text, most)


# ---- characters ----


def swap(text: str, chars: str, new: str = "") -> str:
    """str.translate, a character that is there at a time; none of ``new`` is in ``chars``."""
    if text.isascii():
        return ascii_swap(text, chars, new)
    for i, c in enumerate(chars):
        if c in text:
            text = text.replace(c, new[i] if i < len(new) else "")
    return text


def ascii_swap(text: str, chars: str, new: str) -> str:
    for c, i in _ascii(chars):
        if c in text:
            text = text.replace(c, new[i] if i < len(new) else "")
    return text


@lru_cache(256)
def _ascii(chars: str) -> list[tuple[str, int]]:
    return [(c, i) for i, c in enumerate(chars) if c.isascii()]


_OTHER = re.compile(r"[^\x00-\x7f]")


@lru_cache(1 << 16)
def _bare(c: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))


@lru_cache(1 << 16)
def _plain_ascii(c: str) -> str:
    known = dict(zip(T.DIACRITICS, T.DIACRITICS_ASCII))
    return _OTHER.sub(" ", _bare(known.get(c, c)))


def _each_other(text: str, new: Callable[[str], str]) -> str:
    for c in set(_OTHER.findall(text)):
        text = text.replace(c, new(c))
    return text


def plain(text: str) -> str:
    """NFKD without combining marks, which is a matter of single characters: only marks change places."""
    return text if text.isascii() else _each_other(text, _bare)


def to_ascii(text: str) -> str:
    return text if text.isascii() else _each_other(text, _plain_ascii)


def collapse(text: str) -> str:
    return " ".join(text.split())


def repaired(text: str, default: str) -> str:
    return collapse(to_ascii(text)) or default


# ---- rules ----

_BETWEEN = re.compile(T.BRACKETED)
_GRAMMAR = re.compile(T.GRAMMAR, re.I)
# an x between word boundaries; what may begin a match is a set, which is found fast
_LONE_X = re.compile(r"\[x\]|\[X\]|\(x\)|\(X\)|x(?!\w)(?<!\wx)|X(?!\w)(?<!\wX)")
_X_KEY = re.compile(r"[xX](?<!\w[xX])[xX]{0,2}(?!\w)")
_OUTPUT_GAPS = [(re.compile(p), new) for p, new in T.OUTPUT_GAP_RULES]
_ZERO = re.compile(r"0(?<!\w0)\s++([¼½¾⅓-⅞])")
# one digit stands for the number before the point; \b0 before a point is met by it as well
_DECIMALS = [(p[1:].split("+")[0].replace(r"\b", ""), re.compile(r"(\d)" + p.replace("3+", "3++").replace("6+", "6++").replace(r"\d*", r"\d*+").replace(r"\b", r"(?!\w)")), rf"\1 {sign}") for p, sign in T.DECIMALS]
_GAP, _BIG = "\ue000", "\ue001"


def _upto_last(text: str, ends: str, rule: Callable[[str], str]) -> str:
    """``rule`` for what stands before the last of ``ends``, as a match that ends in one would scan the rest in vain, over and over."""
    at = max(text.rfind(c) for c in ends) + 1
    return rule(text[:at]) + text[at:] if at else text


def output_gaps(text: str) -> str:
    if "x" in text or "X" in text:
        text = _LONE_X.sub("<gap>", text)
    if "..." in text or "…" in text or "[." in text:
        text = _OUTPUT_GAPS[0][0].sub(_OUTPUT_GAPS[0][1], text)
    if "<gap>" in text:
        text = _OUTPUT_GAPS[1][0].sub(_OUTPUT_GAPS[1][1], text)
    return _OUTPUT_GAPS[2][0].sub(_OUTPUT_GAPS[2][1], text) if "<big_gap>" in text else text


def remove_grammar(text: str) -> str:
    return _GRAMMAR.sub("", text) if "(" in text else text


def _guarded(text: str, rule: Callable[[str], str], gap: str, big: str) -> str:
    held = rule(text.replace("<gap>", _GAP).replace("<big_gap>", _BIG))
    return held.replace(_GAP, gap).replace(_BIG, big)


def remove_bracketed(text: str, gap: str = "<gap>", big: str = "<big_gap>") -> str:
    rule = lambda t: _upto_last(t, ")]", lambda h: _BETWEEN.sub("", h) if "(" in h or "[" in h else h)
    return _guarded(text, rule, gap, big)


def remove_special(text: str) -> str:
    return _guarded(text, lambda t: swap(t, T.BAD_OUTPUT), " <gap> ", " <big_gap> ")


def convert_fractions(text: str) -> str:
    if "/" in text:
        for old, new in T.FRACTIONS.items():
            text = text.replace(old, new)
    return text


def decimal_fractions(text: str) -> str:
    for met, pattern, new in _DECIMALS:
        if met in text:
            text = pattern.sub(new, text)
    return text


def zero_fractions(text: str) -> str:
    return text if text.isascii() else _ZERO.sub(r"\1", text)


def strip_big_gaps(text: str) -> str:
    return collapse(text.replace("<big_gap>", ""))


def whole_sentences(text: str, least: int = 200) -> str:
    end = max(text.rfind("."), text.rfind(","))
    return text[:end].rstrip() if len(text) >= least and end > len(text) * 0.5 else text


def strip_dashes(text: str, again: bool = True) -> str:
    out = collapse(text).strip("-")
    return out.strip() if again else out


# ---- repeats ----

_WORDS = re.compile(r"(\w+)")


def _numbers(words: list[str]) -> np.ndarray:
    """A hash of each word: what differs there differs; what is equal is compared again as words."""
    return np.fromiter(map(hash, words), np.int64, len(words))


def _repeated(ids: np.ndarray, n: int) -> list[int]:
    """Where ``n`` words come again right behind themselves."""
    if len(ids) < 2 * n:
        return []
    same = ids[:-n] == ids[n:]
    if n > 1:
        if same.tobytes().find(b"\x01" * n) < 0:
            return []
        upto = np.concatenate(([0], np.cumsum(same)))
        return np.flatnonzero(upto[n:] - upto[:-n] == n).tolist()
    return np.flatnonzero(same).tolist()


def unrepeated(text: str) -> str:
    """``tables.REPEAT_RULES``: one of immediately repeated words, then of phrases of four, three and two words with the same blanks inside."""
    parts = _WORDS.split(text)
    words, before = parts[1::2], parts[::2]  # what stands before each word, and the end
    if len(words) < 2:
        return text
    ids, changed = _numbers(words), False
    for n in (1, 4, 3, 2):
        gone, done = [], 0
        for i in _repeated(ids, n):
            if i < done or not all(s.isspace() for s in before[i + 1 : i + n]):
                continue
            phrase, inner, at = words[i : i + n], before[i + 1 : i + n], i + n
            while words[at : at + n] == phrase and before[at].isspace() and before[at + 1 : at + n] == inner:
                at += n
            if at > i + n:
                gone.append((i + n, at))
                done = at
        if gone:
            changed = True
            stay = np.ones(len(words), bool)
            for a, b in gone:
                stay[a:b] = False
            ids, kept = ids[stay], np.flatnonzero(stay).tolist()
            words, before = [words[k] for k in kept], [*[before[k] for k in kept], before[-1]]
    if not changed:
        return text
    return "".join([x for pair in zip(before, words) for x in pair]) + before[-1]


def unlooped(words: list[str], least: int = 3, most: int = 8) -> list[str]:
    """Words without immediate repeats of a chunk of ``most`` down to ``least`` words, left to right."""
    ids = _numbers(words)
    for n in range(most, least - 1, -1):
        stay, done = None, 0
        for i in _repeated(ids, n):
            if i < done:
                continue
            at = i + n
            while words[at : at + n] == words[i : i + n]:
                at += n
            stay = np.ones(len(words), bool) if stay is None else stay
            stay[i + n : at] = False
            done = at
        if stay is not None:
            words, ids = [words[k] for k in np.flatnonzero(stay).tolist()], ids[stay]
    return words


def without_loops(text: str) -> str:
    """Texts of under six words stay as they are, white space too; others come back with single blanks."""
    words = text.split()
    return text if len(words) < 6 else " ".join(unlooped(words))


def remove_repeats(text: str, loops: bool = True) -> str:
    out = unrepeated(text)
    return without_loops(out) if loops else out


# ---- pipelines ----

_LOW = T.SUBSCRIPTS, T.DIGITS
_BOTH = T.SUBSCRIPTS + T.SUPERSCRIPTS, T.DIGITS * 2


def _head(text: str) -> str:
    return remove_grammar(output_gaps(swap(swap(text, "ḫḪ", "hH"), *_BOTH)))


def postprocess(text: str, brackets: bool = True, big_gaps: bool = True) -> str:
    if not text.strip():
        return ""
    t = _head(text)
    t = remove_bracketed(t) if brackets else t
    t = remove_repeats(zero_fractions(decimal_fractions(convert_fractions(remove_special(t)))))
    t = strip_big_gaps(t) if big_gaps else t
    return strip_dashes(whole_sentences(t))


def postprocess_ascii(text: str) -> str:
    if not text.strip():
        return ""
    t = convert_fractions(remove_special(remove_bracketed(_head(text))))
    t = strip_big_gaps(remove_repeats(t))
    return collapse(to_ascii(strip_dashes(whole_sentences(t, 201))))


def postprocess_retrieved(text: str) -> str:
    if not text.strip():
        return ""
    t = remove_bracketed(swap(swap(text, "ḫḪ", "hH"), *_LOW), "", "")
    t = remove_repeats(convert_fractions(swap(t, T.BAD_OUTPUT)), loops=False)
    return collapse(to_ascii(strip_dashes(t)))


def postprocess_plain(text: str, empty: str = "hnr") -> str:
    if not text.strip():
        return empty
    t = remove_special(remove_grammar(output_gaps(swap(swap(text, "ḫḪ", "hH"), *_LOW))))
    return strip_dashes(remove_repeats(decimal_fractions(t), loops=False), again=False)


# the ranges of the key's digits; ⁰-⁹ is all from U+2070 to U+2079, without ¹, ² and ³
_KEY_DIGITS = T.DIGITS + T.SUBSCRIPTS + "".join(map(chr, range(0x2070, 0x207A)))
_BRACED, _SHORT, _KEPT = re.compile(r"\{([^}]+)\}"), re.compile(r"\(([a-z]{1,6})\)"), re.compile(r"[^a-z0-9\-_ ]+")


def retrieval_key(text: str, superscripts: bool = False) -> str:
    t = swap(text.lower().strip(), _KEY_DIGITS + "¹²³" if superscripts else _KEY_DIGITS)
    if "{" in t:
        t = _upto_last(t, "}", lambda h: _BRACED.sub(r" DET_\1 ", h))
    if "(" in t:
        t = _SHORT.sub(r" DET_\1 ", t)
    t = swap(t, "[]<>ʾʿˀˁ'", "    ").replace("…", " GAP ").replace("...", " GAP ")
    if "x" in t or "X" in t:
        t = _X_KEY.sub(" GAP ", t)
    return collapse(_KEPT.sub(" ", plain(swap(t, ".+", " "))))
