"""Repeated byte strings, found through a sparse suffix array.

A byte goes if a string of ``length`` bytes that covers it starts anywhere else. Sorting the
suffixes of all bytes would move hundreds of times the input, so the array is sparse: of the
suffixes that start in a window of ``length`` bytes, the one whose first LEAD bytes have the
smallest hash is the window's anchor. Equal windows have equal anchors at equal distances, and
an anchor serves about a hundred windows. Then:

1. Anchors are dealt by sampled splitters into ranges of their leading bytes, sorted, and compared
   with their neighbours. A lead that occurs once ends here. Anchors whose whole context is equal,
   by two 64-bit hashes of its bytes, settle all their windows at once.
2. One anchor of each other context fetches its bytes. These suffixes are dealt by sampled
   splitters again; buckets sort them by multikey quicksort, to the right of their anchors and,
   turned round, to the left. Two windows at one distance from their anchors are equal if both the
   longest common prefixes between them reach their ends: bytes decide, no hashes.
3. A lead with more than SPLIT contexts is dealt to several buckets. What one of them doesn't
   settle is compared across the boundaries by a join of 128-bit window hashes.

No step holds more than a bucket's share of a lead, however common it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, drop_table, materialize

LENGTH, LEAD = 200, 32
#: Contexts of one lead that are compared in one task; more are split.
SPLIT = 1 << 16
#: Bytes whose hashes are held at one time, suffixes that are sorted together if their leads are
#: rarer than that, and rows that a quicksort no longer parts.
_SEGMENT, _BLOCK, _FEW = 1 << 20, 8192, 48
_INDEX = np.uint64((1 << 21) - 1)
_A = (1 << 12) - 1  # packed: position << 24 | least distance << 12 | largest distance
_U = np.uint64


@cache
def _tables() -> tuple[np.ndarray, ...]:
    """Random bytes-to-numbers tables, and powers of two odd multipliers with their inverses."""
    r = np.random.default_rng(20240229)
    bytes_to = [r.integers(0, 1 << 64, 256, dtype=np.uint64) for _ in range(3)]
    n = _SEGMENT + 4 * (_A + 1)
    powers = []
    for m in (0x9E3779B97F4A7C15, 0xD1342543DE82EF95):
        for x in (m, pow(m, -1, 1 << 64)):
            p = np.full(n, _U(x))
            p[0] = 1
            powers.append(np.multiply.accumulate(p))
    return (*bytes_to, *powers)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def _sums(buf: np.ndarray, table: np.ndarray, power: np.ndarray) -> np.ndarray:
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(table[buf] * power, out=out[1:])
    return out


def _segment_anchors(buf: np.ndarray, valid: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Anchors of the windows that start at ``valid`` (ascending): first and last window, anchor, its leading eight bytes, hash of its lead and of its context."""
    to_lead, to_context, _, power, inverse, _, _ = _tables()
    x, k = to_lead[buf], 1
    while k < LEAD:
        x = x[:-k] * _U(0x9E3779B97F4A7C15 + 2 * k) + x[k:]
        x ^= x >> _U(29)
        k *= 2
    low = (x & ~_INDEX) | np.arange(len(x), dtype=np.uint64)
    width, k = length - LEAD + 1, 1
    while 2 * k <= width:
        low, k = np.minimum(low[:-k], low[k:]), 2 * k
    if width > k:
        low = np.minimum(low[: k - width], low[width - k :])
    at = (low[valid] & _INDEX).astype(np.int64)
    cut = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (valid[1:] != valid[:-1] + 1)])
    first, last = valid[cut], valid[np.r_[cut[1:] - 1, len(at) - 1]]
    at = at[cut]
    total = _sums(buf, to_context, power[: len(buf)])
    context = (total[last + length] - total[first]) * inverse[first]
    shape = ((at - last) << 12 | (at - first)).astype(np.uint64)
    lead = np.zeros(len(at), np.uint64)
    for k in range(8):
        lead = lead << _U(8) | buf[at + k]
    return first, last, at, lead ^ _U(1 << 63), x[at], _mix(context ^ _mix(shape + _U(1)))


_ANCHORS = "lead long, h long, c long, k1 long, k2 int, at long"
_ANCHORS_ARROW = pa.schema([("lead", pa.int64()), ("h", pa.int64()), ("c", pa.int64()), ("k1", pa.int64()), ("k2", pa.int32()), ("at", pa.int64())])


def _anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = b["t"]
            ends = np.frombuffer(t.buffers()[1], np.int32, len(t) + t.offset + 1)[t.offset :].astype(np.int64) if len(t) else np.zeros(1, np.int64)
            data = np.frombuffer(t.buffers()[2], np.uint8)[ends[0] : ends[-1]] if t.buffers()[2] else np.empty(0, np.uint8)
            ends -= ends[0]
            k1, k2 = b["k1"].to_numpy(), b["k2"].to_numpy()
            opens = np.zeros(len(data) + 1, np.int32)
            long = np.flatnonzero(np.diff(ends) >= length)
            np.add.at(opens, ends[long], 1)
            np.add.at(opens, ends[long + 1] - length + 1, -1)
            starts = np.flatnonzero(np.cumsum(opens) > 0)
            for base in range(0, len(data), _SEGMENT):
                lo, hi = np.searchsorted(starts, (base, base + _SEGMENT))
                if lo == hi:
                    continue
                first, last, at, lead, h, c = _segment_anchors(data[base : base + _SEGMENT + length], starts[lo:hi] - base, length)
                doc = np.searchsorted(ends, first + base, "right") - 1
                packed = (at + base - ends[doc]) << 24 | (at - last) << 12 | (at - first)
                columns = [lead.view(np.int64), h.view(np.int64), c.view(np.int64), k1[doc], k2[doc], packed]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], schema=_ANCHORS_ARROW)

    return run


SETTLED, FETCH = 1, 2
_MARKED = "kind int, h long, k1 long, k2 int, at long"
_MARKED_ARROW = pa.schema([("kind", pa.int32()), ("h", pa.int64()), ("k1", pa.int64()), ("k2", pa.int32()), ("at", pa.int64())])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare each anchor of a partition that is sorted by (lead, h, c) with the ones before and after it.

    SETTLED: another anchor has the same context. FETCH: the anchor stands for a context that has to
    be compared with other contexts of the same lead. At both ends of the partition the neighbour is
    unknown and counts as another context of the same lead.
    """
    held: dict[str, np.ndarray] | None = None
    group_c, at_edge = None, True  # of the group of the first held row: its first context; whether the partition began with it
    before: tuple[int, int] | None = None  # (h, c) of the row before the held ones

    def emit(x: dict[str, np.ndarray], follows: tuple[int, int] | None) -> pa.RecordBatch:
        nonlocal group_c, at_edge, before
        h, c = x["h"], x["c"]
        n = len(h)
        same_h = np.r_[before is not None and before[0] == h[0], h[1:] == h[:-1]]
        same_c = same_h & np.r_[before is not None and before[1] == c[0], c[1:] == c[:-1]]
        next_h = np.r_[same_h[1:], follows is None or follows[0] == h[-1]]
        next_c = np.r_[same_c[1:], follows is not None and follows == (h[-1], c[-1])]
        start = np.maximum.accumulate(np.where(same_h, -1, np.arange(n)))
        first_c = np.where(start >= 0, c[start], 0 if group_c is None else group_c)
        edge = (start < 0) & at_edge if before is not None else (start == 0) & at_edge
        first = (c == first_c) & ~edge
        fetch = np.where(first, ~next_c & next_h, ~same_c)
        kind = (same_c | next_c) * SETTLED + fetch * FETCH
        if start[-1] >= 0:
            group_c, at_edge = c[start[-1]], before is None and start[-1] == 0 and at_edge
        before = (h[-1], c[-1])
        keep = np.flatnonzero(kind)
        return pa.RecordBatch.from_arrays([pa.array(kind[keep].astype(np.int32)), *[pa.array(x[k][keep]) for k in ("h", "k1", "k2", "at")]], schema=_MARKED_ARROW)

    for b in batches:
        if not b.num_rows:
            continue
        now = {k: b[k].to_numpy() for k in ("h", "c", "k1", "k2", "at")}
        if held is not None:
            yield emit(held, (now["h"][0], now["c"][0]))
        held = now
    if held is not None:
        yield emit(held, None)


_CONTEXTS = "lead binary, part int, context binary, single boolean, k1 long, k2 int, at long"


def _contexts(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for text, k1, k2, wanted in zip(b["t"].to_pylist(), b["k1"].to_pylist(), b["k2"].to_pylist(), b["wanted"].to_pylist()):
                single: dict[tuple[int, int], bool] = {}
                for w in wanted:  # one place twice: two copies of a whole text
                    at = w["at"], w["part"]
                    single[at] = not w["settled"] and at not in single
                for (at, part), s in single.items():
                    p, low, high = at >> 24, at >> 12 & _A, at & _A
                    out.append((text[p : p + LEAD], part, text[p - high : p + length - low], s, k1, k2, at))
            names = ["lead", "part", "context", "single", "k1", "k2", "at"]
            kinds = [pa.binary(), pa.int32(), pa.binary(), pa.bool_(), pa.int64(), pa.int32(), pa.int64()]
            columns = zip(*out) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)

    return run


def multikey_sort(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of byte rows, and how many bytes each row shares with the one after it in that order.

    Multikey quicksort: a part is split in three by a pivot for the word at its depth, eight bytes
    that compare as a number; the middle part goes on to the next word. Parts of few rows are
    sorted by what is left of them at once.
    """
    n, width = rows.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = rows
    words = padded.view(">u8").astype(np.uint64)
    depth, order = words.shape[1], np.arange(n)
    todo = [(0, n, 0)]
    while todo:
        low, high, d = todo.pop()
        if high - low < 2 or d == depth:
            continue
        part = order[low:high]
        if high - low <= _FEW:
            order[low:high] = part[np.lexsort(words[part, d:].T[::-1])]
            continue
        w = words[part, d]
        pivot = np.sort(w[[0, len(w) // 2, -1]])[1]
        less, more = w < pivot, w > pivot
        same = ~(less | more)
        order[low:high] = np.concatenate([part[less], part[same], part[more]])
        a = low + int(less.sum())
        b = a + int(same.sum())
        todo += [(low, a, d), (a, b, d + 1), (b, high, d)]
    differ = rows[order[1:]] != rows[order[:-1]]
    return order, np.where(differ.any(1), differ.argmax(1), width)


def _side(buf: np.ndarray, start: np.ndarray, size: np.ndarray, step: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes of ``size`` bytes from ``start``, forwards or turned round, in order: the order, each one's place, shared bytes."""
    n, along = len(start), np.arange(width)
    rows = np.zeros((n, width), np.uint8)
    for i in range(0, n, _BLOCK):
        j = slice(i, i + _BLOCK)
        place = np.clip(start[j, None] + step * along, 0, len(buf) - 1)
        rows[j] = np.where(along < size[j, None], buf[place], 0)
    order, shared = multikey_sort(rows)
    at = np.empty(n, np.int64)
    at[order] = np.arange(n)
    return order, at, shared


def _reach(order: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """The longest match of each suffix with a neighbour."""
    out = np.empty(len(order), np.int64)
    out[order] = np.maximum(np.r_[shared, 0], np.r_[0, shared])
    return out


RESULT, SINGLE, SEEN = 0, 1, 2
_FOUND = "kind int, h1 long, h2 long, k1 long, k2 int, run long"
_FOUND_ARROW = pa.schema([("kind", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("k1", pa.int64()), ("k2", pa.int32()), ("run", pa.int64())])


def _found(kind: int, h1: np.ndarray, h2: np.ndarray, k1: np.ndarray, k2: np.ndarray, run: np.ndarray) -> pa.RecordBatch:
    columns = [np.full(len(run), kind, np.int32), h1.view(np.int64), h2.view(np.int64), k1, k2, run]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=_FOUND_ARROW)


def _block(t: pa.Table, length: int) -> Iterator[pa.RecordBatch]:
    """Compare the windows of a block of suffixes, which has all of a lead's or of a part's. Parts count from 1; 0 is a whole lead.

    Windows at one distance from their anchors are equal if they are in one group of suffixes that
    share what is to the right, and in one of those that share what is to the left. Groups are runs
    of the sorted suffixes whose neighbours share enough bytes.
    """
    n = t.num_rows
    contexts = t["context"].to_pylist()
    size = np.fromiter(map(len, contexts), np.int64, n)
    buf = np.frombuffer(b"".join(contexts), np.uint8)
    begin = np.cumsum(size) - size
    at, k1, k2, single, part = (t[c].to_numpy() for c in ("at", "k1", "k2", "single", "part"))
    near, far, cut = at >> 12 & _A, at & _A, part > 0
    right_order, right_at, right = _side(buf, begin + far, length - near, 1, length)
    left_order, left_at, left = _side(buf, begin + far - 1, far, -1, length)
    # parts of one lead that happen to meet here are compared as others are, by their hashes
    apart = np.cumsum(np.r_[False, part[1:] != part[:-1]])
    right_reach, left_reach, weight = _reach(right_order, right), _reach(left_order, left), 2 - single
    low, high = int(near.min()), int(far.max())
    hit, alone = np.zeros((n, high - low + 2), bool), []
    for a in range(low, high + 1):
        rows = np.flatnonzero((near <= a) & (a <= far) & (cut | (right_reach >= length - a) & (left_reach >= a)))
        if not len(rows):
            continue
        from_right = np.cumsum(np.r_[False, right < length - a])[right_at[rows]]
        from_left = np.cumsum(np.r_[False, left < a])[left_at[rows]]
        _, first, name = np.unique((from_right * n + from_left) * (apart[-1] + 1) + apart[rows], return_index=True, return_inverse=True)
        times = np.bincount(name, weight[rows])
        hit[rows, a - low] = (times[name] >= 2) & single[rows]
        if cut.any():
            seen = times >= 2
            alone.append((SINGLE, rows[~seen[name] & cut[rows]], a))
            alone.append((SEEN, rows[first[seen]][cut[rows[first[seen]]]], a))
    # runs of distances, in each row; starts of windows descend as distances ascend
    edge = np.diff(np.pad(hit, ((0, 0), (1, 0))).astype(np.int8), axis=1)
    row, a = np.nonzero(edge == 1)
    _, b = np.nonzero(edge == -1)
    start = (at >> 24)[row] - (b - 1 + low)
    if len(row):
        none = np.zeros(len(row), np.uint64)
        yield _found(RESULT, none, none, k1[row], k2[row], start << 12 | (b - 1 - a))
    if alone:
        _, one, two, p1, i1, p2, i2 = _tables()
        offset = np.arange(len(buf)) - np.repeat(begin, size)
        s1, s2 = _sums(buf, one, p1[offset]), _sums(buf, two, p2[offset])
        for kind, rows, a in alone:
            inside = far[rows] - a
            first = begin[rows] + inside
            h1, h2 = (_mix((s[first + length] - s[first]) * i[inside]) for s, i in ((s1, i1), (s2, i2)))
            if len(rows):
                yield _found(kind, h1, h2, k1[rows], k2[rows], ((at >> 24)[rows] - a) << 12)


def _blocks(length: int):
    """Blocks of a partition that is sorted by (lead, part). Equal keys share a partition, so only parts are cut off from others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            for piece in (b.slice(i, _BLOCK) for i in range(0, b.num_rows, _BLOCK)):
                t = pa.Table.from_batches([piece])
                held = pa.concat_tables([held, t]) if held is not None else t
                if held.num_rows >= _BLOCK:
                    key = list(zip(held["lead"].to_pylist(), held["part"].to_pylist()))
                    i = len(key) - 1
                    while i > 0 and key[i - 1] == key[-1]:
                        i -= 1
                    if i:
                        yield from _block(held.slice(0, i), length)
                        held = held.slice(i)
        if held is not None and held.num_rows:
            yield from _block(held, length)

    return run


def repeated_spans(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH, split: int = SPLIT) -> DataFrame:
    """Columns id, text (binary), n_bytes, spans: one row per row of ``docs``.

    ``spans`` has the maximal runs (start, end; bytes, end exclusive) that are covered by strings
    of ``length`` bytes which start at two places or more, in any documents or in one; strings
    don't cross documents, and overlaps count. Texts are their UTF-8 bytes, null ones are empty;
    shorter texts have no span; repeated rows are documents of their own, so they cover each
    other; an empty table gives an empty result; other columns are ignored. ``length`` is from
    2 * LEAD to 4096.
    """
    if not 2 * LEAD <= length <= _A + 1:
        raise ValueError(f"length must be from {2 * LEAD} to {_A + 1}")
    spark = docs.sparkSession
    bound_batches(spark)
    t = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(F.col(id).alias("id"), t.cast("binary").alias("t"), F.xxhash64(t).alias("k1"), F.hash(t).alias("k2"))
    anchors = materialize(keyed.where(F.length("t") >= length).select("t", "k1", "k2").mapInArrow(_anchors(length), _ANCHORS), "anchors")
    near = anchors.repartitionByRange("lead", "h", "c", "k1", "k2", "at").sortWithinPartitions("lead", "h", "c")
    marked = materialize(near.mapInArrow(_compare, _MARKED), "marked")
    drop_table(anchors)

    copies = keyed.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min("id").alias("who"))
    copies = materialize(copies, "copies")
    kind = F.col("kind")
    wanted = marked.where(kind.bitwiseAND(FETCH) > 0).select("h", "k1", "k2", "at", (kind.bitwiseAND(SETTLED) > 0).alias("settled"))
    crowded = wanted.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > split)
    parts = F.ceil(F.col("n") / split).cast("int")
    wanted = wanted.join(materialize(crowded, "crowded"), "h", "left").withColumn("part", F.coalesce(F.pmod(F.hash("k1", "k2", "at"), parts) + 1, F.lit(0)))
    wanted = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("at", "part", "settled")).alias("wanted")).join(copies, ["k1", "k2"])
    wanted = wanted.select(F.col("k1").alias("j1"), F.col("k2").alias("j2"), "who", "wanted")
    # one of a text's copies gives its bytes; with the id in the key, copies are dealt apart
    which = (F.col("k1") == F.col("j1")) & (F.col("k2") == F.col("j2")) & F.col("id").eqNullSafe(F.col("who"))
    texts = keyed.join(wanted.hint("shuffle_hash"), which).select("t", "k1", "k2", "wanted")
    bound_batches(spark)
    contexts = materialize(texts.mapInArrow(_contexts(length), _CONTEXTS), "contexts")
    dealt = contexts.repartitionByRange("lead", "part").sortWithinPartitions("lead", "part")
    found = materialize(dealt.mapInArrow(_blocks(length), _FOUND), "found")
    drop_table(contexts)

    place = F.when(kind == SINGLE, F.struct("k1", "k2", "run"))
    across = found.where(kind > RESULT).groupBy("h1", "h2").agg(F.sum("kind").alias("n"), F.collect_list(place).alias("places"))
    across = across.where("n >= 2").select(F.inline("places"))
    low, high = F.shiftright("at", 12).bitwiseAND(_A), F.col("at").bitwiseAND(_A)
    settled = marked.where(kind.bitwiseAND(SETTLED) > 0).select("k1", "k2", F.shiftleft(F.shiftright("at", 24) - high, 12).bitwiseOR(high - low).alias("run"))
    runs = settled.union(found.where(kind == RESULT).select("k1", "k2", "run")).union(across)
    runs = runs.union(copies.where("n >= 2").select("k1", "k2", F.lit(-1).cast("long").alias("run")))
    spans = runs.groupBy("k1", "k2").agg(F.collect_set("run").alias("runs"))

    @F.pandas_udf("array<struct<start:long,end:long>>")
    def merged(sets: pd.Series) -> pd.Series:
        return sets.map(lambda x: _merge(np.asarray(x, np.int64), length))

    spans = materialize(spans.select("k1", "k2", merged("runs").alias("spans")), "spans")
    for old in (marked, found, copies):
        drop_table(old)
    n = F.length("t").cast("long")
    clipped = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.least(s["end"], n).alias("end")))
    none = F.array().cast("array<struct<start:long,end:long>>")
    out = keyed.join(spans.hint("shuffle_hash"), ["k1", "k2"], "left")
    return out.select(F.col("id").alias(id), F.col("t").alias(text), n.alias("n_bytes"), F.when(n >= length, F.coalesce(clipped, none)).otherwise(none).alias("spans"))


def _merge(runs: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Runs of window starts as merged spans of bytes; -1 stands for a whole text."""
    if (runs < 0).any():
        return [(0, 1 << 62)]
    start = runs >> 12
    end = start + (runs & _A) + length
    by = np.argsort(start, kind="stable")
    start, top = start[by], np.maximum.accumulate(end[by])
    new = np.r_[True, start[1:] > top[:-1]]
    return list(zip(start[new].tolist(), top[np.r_[np.flatnonzero(new)[1:] - 1, len(top) - 1]].tolist()))


def kept_bytes(text: Column, n_bytes: Column, spans: Column) -> Column:
    """The bytes of a text outside its spans, joined."""
    zero = F.lit(0).cast("long")
    gaps = F.zip_with(F.concat(F.array(zero), spans["end"]), F.concat(spans["start"], F.array(n_bytes)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    joined = F.aggregate(gaps, F.lit(b"").cast("binary"), lambda acc, g: F.concat(acc, F.substring(text, (g["a"] + 1).cast("int"), (g["b"] - g["a"]).cast("int"))))
    return F.when(F.size(spans) > 0, joined).otherwise(text)


def removed_bytes(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
