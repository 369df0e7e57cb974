"""Test items found in training texts: n-gram seeds propose passages, Smith-Waterman alignment scores them.

The items are worked through in blocks of bounded size, each against all documents. A task
numbers the words of its documents by the block's vocabulary and looks up every n-gram; where an
item's n-gram is met, however common, the words around it become a candidate passage, as many as
an alignment through the n-gram can span and still reach the score. Only candidates that have too
few of the item's words for the score, whatever their order, are left out. Alignment by words gives
the rest a score from 0 to 1, the share of the best that the item could reach, so copies with
changed, lost or added words score too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, materialize, text_key

N = 3
#: Characters of items in a block; its seeds and words, no more than these, go to all workers.
BLOCK_CHARS = 4 << 20
MATCH, MISMATCH, GAP = 2, 1, 1
#: A passage counts from this score on.
SCORE_FROM = 0.5
_WORD, _NO_WORD = re.compile(r"\w+"), re.compile(r"\W")
_SLICE, _CELLS, _BITS = 1 << 20, 1 << 18, 21


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@dataclass
class Block:
    """Vocabulary, items as word numbers, and the places (item, position) of each n-gram in sorted order."""

    vocabulary: dict[str, int]
    items: list[np.ndarray]
    codes: np.ndarray
    first: np.ndarray
    place_item: np.ndarray
    place_at: np.ndarray


def codes_of(ids: np.ndarray) -> np.ndarray:
    """A number for each run of N words; negative where a word is unknown.

    Past 2**21 words runs can share a number, which proposes passages too many and none too few.
    """
    mask = (1 << _BITS) - 1
    first = ids[: len(ids) - N + 1].astype(np.int64)
    out, bad = first & mask, first < 0
    for k in range(1, N):
        x = ids[k : len(ids) - N + 1 + k]
        out, bad = out << _BITS | (x & mask), bad | (x < 0)
    return np.where(bad, -1, out)


def make_block(texts: list[str]) -> Block:
    vocabulary: dict[str, int] = {}
    items = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words(t)], np.int32) for t in texts]
    code, item, at = [], [], []
    for i, x in enumerate(items):
        c = codes_of(x) if len(x) >= N else np.empty(0, np.int64)
        code.append(c)
        item.append(np.full(len(c), i))
        at.append(np.arange(len(c)))
    code, item, at = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (code, item, at))
    by = np.argsort(code, kind="stable")
    codes, first = np.unique(code[by], return_index=True)
    return Block(vocabulary, items, codes, np.r_[first, len(code)], item[by], at[by])


def split(held: list, chars: int) -> list[list]:
    """Items in blocks of at most ``chars`` characters; an item longer than that is a block of its own."""
    blocks, size = [[]], 0
    for x in held:
        if blocks[-1] and size + len(x["text"]) > chars:
            blocks.append([])
            size = 0
        blocks[-1].append(x)
        size += len(x["text"])
    return blocks


def word_numbers(text: str, vocabulary: dict[str, int]) -> np.ndarray:
    """The words of a whole text by number, -1 for words of no item; long texts go slice by slice."""
    parts, at, get = [], 0, vocabulary.get
    while at < len(text):
        end = len(text)
        if end - at > _SLICE:
            m = _NO_WORD.search(text, at + _SLICE)
            end = m.start() if m else end
        found = words(text[at:end])
        parts.append(np.fromiter(map(get, found, repeat(-1)), np.int32, len(found)))
        at = end
    return np.concatenate(parts) if parts else np.empty(0, np.int32)


def passages(ids: np.ndarray, block: Block, score_from: float = SCORE_FROM) -> Iterator[tuple[int, int, int]]:
    """Candidates of one document: item, start and end of the words around its hits.

    An alignment of m words has added words for at most MATCH * m less the score it must reach, so
    all that reach it and run through a hit lie within these words.
    """
    if len(ids) < N or not len(block.codes):
        return
    code = codes_of(ids)
    p = np.flatnonzero(code >= 0)
    k = np.minimum(np.searchsorted(block.codes, code[p]), len(block.codes) - 1)
    hit = block.codes[k] == code[p]
    p, k = p[hit], k[hit]
    if not len(p):
        return
    count = block.first[k + 1] - block.first[k]
    place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(block.first[k], count)
    p, item = np.repeat(p, count), block.place_item[place]
    size = np.fromiter(map(len, block.items), np.int64, len(block.items))[item]
    spare = np.floor(MATCH * size * (1 - score_from) / GAP).astype(np.int64)
    slack = np.maximum(8 + size // 4, spare)
    low = p - block.place_at[place] - slack
    high = low + size + 2 * slack
    by = np.lexsort((low, item))
    item, low, high = item[by], np.maximum(low[by], 0), np.minimum(high[by], len(ids))
    # windows of one item that touch are one passage; ends are compared with the largest so far of the item
    reach = np.maximum.accumulate(high + item * (len(ids) + 1))
    cut = np.flatnonzero(np.r_[True, (item[1:] != item[:-1]) | (low[1:] + item[1:] * (len(ids) + 1) > reach[:-1])])
    for a, b in zip(cut, np.r_[cut[1:], len(item)]):
        yield int(item[a]), int(low[a]), int(high[a:b].max())


def most(item: np.ndarray, text: np.ndarray) -> int:
    """How many words an alignment can match at most: those in common, each as often as in both."""
    if len(item) > len(text):
        item, text = text, item
    own, n = np.unique(item, return_counts=True)
    at = np.minimum(np.searchsorted(own, text), len(own) - 1)
    return int(np.minimum(n, np.bincount(at[own[at] == text], minlength=len(own))).sum())


def align(item: list[np.ndarray], text: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman scores of pairs, and the place in each text after the best alignment's last word, the first of equals.

    All pairs take a step at once, a row of every table for each word of the items. Gaps along the
    row come from a running maximum, as a gap costs the same for each word.
    """
    n, rows, width = len(item), max(map(len, item), default=0), max(map(len, text), default=0)
    a, b = np.full((n, rows), -2, np.int32), np.full((n, width), -1, np.int32)
    for i, (x, y) in enumerate(zip(item, text)):
        a[i, : len(x)], b[i, : len(y)] = x, y
    slope = GAP * np.arange(width, dtype=np.int32)
    h = np.zeros((n, width + 1), np.int32)
    best, end = np.zeros(n, np.int32), np.zeros(n, np.int64)
    for i in range(rows):
        step = np.where(b == a[:, i : i + 1], MATCH, -MISMATCH)
        now = np.maximum(np.maximum(h[:, :-1] + step, h[:, 1:] - GAP), 0)
        now = np.maximum.accumulate(now + slope, axis=1) - slope
        top = now.argmax(1)
        score = now[np.arange(n), top] if width else best
        better = (score > best) | ((score == best) & (top + 1 < end))
        best, end = np.where(better, score, best), np.where(better, top + 1, end)
        h[:, 1:] = now
    return best, end


def _scored(block: Block, score_from: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            item, low = b["item"].to_numpy(), b["low"].to_numpy()
            texts = [np.asarray(x.values, np.int32) for x in b["words"]]
            keep = sorted(range(len(texts)), key=lambda k: len(texts[k]))
            while keep:
                m = 1
                while m < len(keep) and (m + 1) * len(texts[keep[m]]) <= _CELLS:
                    m += 1
                part, keep = np.array(keep[:m]), keep[m:]
                mine, theirs = [block.items[i] for i in item[part]], [texts[k] for k in part]
                score, end = align(mine, theirs)
                share = score / (MATCH * np.fromiter(map(len, mine), float, m))
                good = np.flatnonzero(share >= score_from)
                if not len(good):
                    continue
                _, back = align([mine[i][::-1] for i in good], [theirs[i][: end[i]][::-1] for i in good])
                rows, stop = part[good], low[part[good]] + end[good]
                columns = [b["id"].take(pa.array(rows)), *map(pa.array, (item[rows], share[good], stop - back, stop))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "item", "score", "start_word", "end_word"])

    return run


def overlaps(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", score_from: float = SCORE_FROM, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row for each document and item whose best alignment scores ``score_from`` or more.

    Columns ``id``, ``item_id``, score, start_word, end_word (words of the document from 0, end
    exclusive). Words are runs of letters, digits and underscores, in lower case. Rows with one id
    count as one document and give their best passage, the earliest of equal ones; null ids are one
    document, null item ids one item, and repeated items one item. Null and empty texts match
    nothing, and neither do items of fewer than N words. Passages that share no run of N words with
    an item are not proposed, whatever they would score. An item longer than a block has a pass of
    its own; aligning takes time by its words times those of each passage that may hold it. Empty
    tables give an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    tests = items.select(F.col(item_id).alias("item"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    chars = tests.agg(F.sum(F.length("text"))).first()[0] or 0
    count = -(-chars // max(1, block_chars // 2)) or 1
    rows = docs.where(F.col(text).isNotNull()).select(F.col(id).alias("id"), F.col(text).alias("text"))
    kinds = dict(rows.dtypes)["id"], dict(tests.dtypes)["item"]
    found = spark.createDataFrame([], f"id {kinds[0]}, item {kinds[1]}, score double, start_word long, end_word long")
    for b in range(count):
        held = tests.where(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == b).distinct().collect()
        held.sort(key=lambda x: (x["item"] is not None, x["item"], x["text"]))
        for part in split(held, 2 * block_chars):
            block, names = make_block([x["text"] for x in part]), [x["item"] for x in part]

            def candidates(batches: Iterator[pa.RecordBatch], block: Block = block) -> Iterator[pa.RecordBatch]:
                def packed(d: pa.RecordBatch, out: list) -> pa.RecordBatch:
                    row, item, low, near = zip(*out) if out else [[]] * 4
                    arrow = pa.int32(), pa.int64(), pa.list_(pa.int32())
                    columns = [pa.array(list(x), kind) for x, kind in zip((item, low, near), arrow)]
                    return pa.RecordBatch.from_arrays([d["id"].take(pa.array(list(row), pa.int64())), *columns], names=["id", "item", "low", "words"])

                for d in batches:
                    out, held = [], 0
                    for row, t in enumerate(d["text"]):
                        ids = word_numbers(t.as_py(), block.vocabulary)
                        for item, low, high in passages(ids, block, score_from):
                            near = ids[low:high]
                            # the score divided as in _scored, so that rounding can't tell them apart
                            if MATCH * most(block.items[item], near) / (MATCH * float(len(block.items[item]))) < score_from:
                                continue
                            out.append((row, item, low, near))
                            held += len(near)
                            if held > _SLICE:
                                yield packed(d, out)
                                out, held = [], 0
                    yield packed(d, out)

            def run(batches: Iterator[pa.RecordBatch], propose=candidates, score=_scored(block, score_from)) -> Iterator[pa.RecordBatch]:
                return score(propose(batches))

            # one function, as two would keep two Python workers for each task
            scored = rows.mapInArrow(run, f"id {kinds[0]}, item int, score double, start_word long, end_word long")
            named = spark.createDataFrame(list(enumerate(names)), f"k int, item {kinds[1]}")
            scored = scored.withColumnRenamed("item", "k").join(F.broadcast(named), "k").select("id", "item", "score", "start_word", "end_word")
            found = found.union(materialize(scored, "scored"))
    best = F.max(F.struct("score", (-F.col("start_word")).alias("s"), (-F.col("end_word")).alias("e"))).alias("b")
    out = found.groupBy("id", "item").agg(best)
    return out.select(F.col("id").alias(id), F.col("item").alias(item_id), "b.score", (-F.col("b.s")).alias("start_word"), (-F.col("b.e")).alias("end_word"))


def clean(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` whose text holds no item; see :func:`overlaps`. All columns stay.

    Each row goes or stays by its own text, so null and repeated ids don't take clean rows along.
    """
    key = "__tessella_key"
    keyed = docs.select(text_key(F.col(text)).alias(key), text)
    dirty = overlaps(keyed, items, key, text, **how).select(F.col(key).alias("__tessella_dirty")).distinct()
    return docs.join(dirty, text_key(docs[text]) == dirty["__tessella_dirty"], "left_anti")
