"""SimHash near-duplicates through an inverted index of positional bytes.

Two 64-bit fingerprints that differ in at most three bits differ in at most three of their
eight bytes, so they share five positional bytes or more. A list of the index has the
fingerprints with given bytes at some positions. The k-th byte that a pair shares is no later
than its (3 + k)-th byte, so the lists for k of the first 3 + k positions lose no pair. The
index starts with as many positions as keep lists short by chance, and a list that is long all
the same is split by the next position that its pairs can share, at most to five positions.

Within a list the shared bytes of each pair are tallied, pairs under the guaranteed five are
dropped, the others are verified bit by bit, and only a spanning forest of the links leaves the
list: a group of m near copies yields m - 1 links and not m * m.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, drop_table, in_few, materialize
from .components import components

SEED = 42
MAX_BITS = 3
BYTES, SHARED_BYTES = 8, 5
#: A list with more fingerprints is split by one more position; at five positions it looks its neighbours up.
LIST_MAX = 256
#: The index starts with so many positions that a list has no more than this by chance.
BY_CHANCE = 16
#: Shingles whose hashes are held at one time.
_BLOCK = 1 << 18


def spans(text: str | None, n: int) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words in lower case (A-Z), joined by blanks, and the starts and ends of its shingles of ``n`` words.

    Fewer words than ``n`` are one shingle; no words have none.
    """
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    if not words:
        return b"", np.empty(0, np.int64), np.empty(0, np.int64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start, stop = (end - size, end[n - 1 :]) if len(words) >= n else (end[:1] - size[:1], end[-1:])
    return b" ".join(words), start[: len(stop)], stop


def hashes(text: str | None, n: int) -> Iterator[np.ndarray]:
    """The XXH64 of a text's shingles, repeats included, in blocks of rows of eight bytes."""
    joined, start, stop = spans(text, n)
    digest = xxhash.xxh64_digest
    for at in range(0, len(stop), _BLOCK):
        pairs = zip(start[at : at + _BLOCK].tolist(), stop[at : at + _BLOCK].tolist())
        yield np.frombuffer(b"".join([digest(joined[i:j], SEED) for i, j in pairs]), np.uint8).reshape(-1, 8)


def fingerprint(text: str | None, n: int = 3) -> int:
    """The SimHash of a whole text: bit i is 1 if it is set in over half of the shingle hashes."""
    ones, total = np.zeros(64, np.int64), 0
    for h in hashes(text, n):
        total += len(h)
        for k in range(0, len(h), 255):
            ones += np.unpackbits(h[k : k + 255], axis=1).sum(0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def with_fingerprint(df: DataFrame, text: str = "text", out: str = "fp", n: int = 3) -> DataFrame:
    """``df`` with a long column of each text's fingerprint (its 64 bits, as a signed number)."""
    bound_batches(df.sparkSession)

    @F.pandas_udf("long")
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series([_signed(fingerprint(t, n)) for t in texts], dtype="int64")

    return df.withColumn(out, prints(F.col(text)))


# ---- the index: position p is byte p of a fingerprint, the highest first; a choice is a set of positions as bits ----


def mask(choice: int) -> int:
    """The bits of a fingerprint at the positions of a choice."""
    return sum(0xFF << (56 - 8 * p) for p in range(BYTES) if choice >> p & 1)


def choices(k: int) -> list[int]:
    """The choices of ``k`` positions that a pair's first ``k`` shared bytes can be."""
    return [sum(1 << p for p in c) for c in combinations(range(BYTES - SHARED_BYTES + k), k)]


def longer(choice: int) -> list[int]:
    """The choices that add the next position that a pair can share."""
    k, last = choice.bit_count(), choice.bit_length()
    return [choice | 1 << p for p in range(last, BYTES - SHARED_BYTES + k + 1)]


def first_choice(n: int) -> int:
    """How many positions the index starts with for ``n`` fingerprints."""
    return next((k for k in range(1, SHARED_BYTES) if n <= BY_CHANCE << 8 * k), SHARED_BYTES)


def _deltas(bits: int) -> np.ndarray:
    free = [i for i in range(64) if not (bits >> i) & 1]
    return np.array([sum(1 << b for b in c) for k in range(1, MAX_BITS + 1) for c in combinations(free, k)], np.uint64)


def forest(values: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among sorted different fingerprints that agree in ``bits``, 40 of them.

    Each step looks up the few thousand values within three bits of one, so its work does not grow with the list.
    """
    out: list[tuple[int, int]] = []
    left, deltas = np.ones(len(values), bool), _deltas(bits)
    for first in range(len(values)):
        if not left[first]:
            continue
        left[first] = False
        stack = [first]
        while stack:
            i = stack.pop()
            want = values[i] ^ deltas
            at = np.minimum(np.searchsorted(values, want), len(values) - 1)
            near = at[(values[at] == want) & left[at]]
            left[near] = False
            out += [(int(values[i]), int(values[j])) for j in near]
            stack += near.tolist()
    return out


def tallied(group: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (places in ``values``) of all pairs within groups of neighbours, as a spanning forest of each group.

    A pair's shared positional bytes are counted; those with SHARED_BYTES or more are verified by their bits.
    """
    firsts, seconds = [], []
    at = np.arange(len(values))
    for step in range(1, len(values)):
        at = at[at + step < len(values)]
        at = at[group[at] == group[at + step]]
        if not len(at):
            break
        differ = values[at] ^ values[at + step]
        tally = (differ.view(np.uint8).reshape(-1, BYTES) == 0).sum(1)
        kept = tally >= SHARED_BYTES
        near = at[kept][np.bitwise_count(differ[kept]) <= MAX_BITS]
        firsts.append(near)
        seconds.append(near + step)
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, j in zip(np.concatenate(firsts or [at[:0]]).tolist(), np.concatenate(seconds or [at[:0]]).tolist()):
        a, b = find(i), find(j)
        if a != b:
            root[b] = a
            out.append((i, j))
    pairs = np.array(out, np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


_ROWS = "choice int, a long, b long"


def _rows(choice, a, b) -> pd.DataFrame:
    return pd.DataFrame({"choice": np.asarray(choice, np.int32), "a": a, "b": b})


def _split(choice: int, values: np.ndarray) -> Iterator[pd.DataFrame]:
    """The rows (choice, key, fingerprint) of a long list's members in the lists that take its place."""
    for c in longer(choice):
        yield _rows(np.full(len(values), c), values & np.int64(_signed(mask(c))), values)


def _lists(list_max: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Links (choice 0, u, v) of the short lists of a partition sorted by (choice, key, fp), and the splits of long ones.

        A list that is split is never held: its rows pass through.
        """
        held = [np.empty(0, np.int64)] * 3
        passing: tuple[int, int] | None = None

        def whole(choice, key, fp, start, size) -> Iterator[pd.DataFrame]:
            long = size > list_max
            for at, m in zip(start[long].tolist(), size[long].tolist()):
                if int(choice[at]).bit_count() < SHARED_BYTES:
                    yield from _split(int(choice[at]), fp[at : at + m])
                else:
                    found = np.array(forest(np.sort(fp[at : at + m].view(np.uint64)), mask(int(choice[at]))), np.uint64).reshape(-1, 2).view(np.int64)
                    yield _rows(np.zeros(len(found)), found[:, 0], found[:, 1])
            short = np.repeat(~long & (size > 1), size)
            group, values = np.repeat(np.arange(len(size)), size)[short], fp[short]
            i, j = tallied(group, values.view(np.uint64))
            yield _rows(np.zeros(len(i)), values[i], values[j])

        for part in batches:
            now = [part[c].to_numpy(dtype=np.int64) for c in ("choice", "key", "fp")]
            if passing:
                more = (now[0] == passing[0]) & (now[1] == passing[1])
                yield from _split(passing[0], now[2][more])
                now = [x[~more] for x in now]
            choice, key, fp = (np.concatenate(x) for x in zip(held, now))
            if not len(fp):
                continue
            passing = None
            start = np.flatnonzero(np.r_[True, (choice[1:] != choice[:-1]) | (key[1:] != key[:-1])])
            size = np.diff(np.r_[start, len(fp)])
            yield from whole(choice[: start[-1]], key[: start[-1]], fp[: start[-1]], start[:-1], size[:-1])
            held = [x[start[-1] :] for x in (choice, key, fp)]
            if size[-1] > list_max and int(held[0][0]).bit_count() < SHARED_BYTES:
                passing = int(held[0][0]), int(held[1][0])
                yield from _split(passing[0], held[2])
                held = [x[:0] for x in held]
        if len(held[2]):
            yield from whole(*held, np.zeros(1, np.int64), np.array([len(held[2])]))

    return run


def links(prints: DataFrame, n: int, list_max: int = LIST_MAX) -> DataFrame:
    """Columns u, v: a spanning forest of all pairs of different fingerprints within three bits.

    ``prints`` has one column fp (long) of ``n`` rows without repeats and nulls. ``list_max`` bounds
    the pairs that a fingerprint meets in a list and what is held of it; all sizes give the same components.
    """
    k = first_choice(n)
    masks = [F.struct(F.lit(c).alias("choice"), F.lit(_signed(mask(c))).cast("long").bitwiseAND(F.col("fp")).alias("key")) for c in choices(k)]
    rows, steps = prints.select("fp", F.explode(F.array(*masks)).alias("x")).select("x.choice", "x.key", "fp"), []
    size = n  # the lists get more rows than that, but forests and splits leave fewer
    while True:
        dealt = rows.repartition("choice", "key").sortWithinPartitions("choice", "key", "fp")
        step = materialize(dealt.mapInPandas(_lists(list_max), _ROWS), "lists", size)
        steps.append(step)
        rows = step.where("choice > 0").select("choice", F.col("a").alias("key"), F.col("b").alias("fp"))
        k += 1
        size = 0 if k > SHARED_BYTES else rows.count()
        if not size:
            break
    found = [x.where("choice = 0").select(F.col("a").alias("u"), F.col("b").alias("v")) for x in steps]
    out = materialize(reduce(DataFrame.union, found).distinct(), "links", sum(x.count() for x in found))
    for old in steps:
        drop_table(old)
    return out


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", n: int = 3) -> DataFrame:
    """One row per row of ``docs``: id, fp (long), component (the smallest id reachable, itself included).

    Fingerprints link at three or fewer differing bits, and components are closed under links.
    Null, empty and blank texts have fingerprint zero and link like any other. Repeated rows are
    kept and share a component. A null id counts for no minimum; a component of null ids only
    has a null component. An empty table gives an empty result. Other columns are ignored, so
    their names cannot clash.
    """
    prints = with_fingerprint(docs.select(F.col(id).alias("id"), F.col(text).alias("t")), "t", "fp", n).drop("t")
    prints = materialize(prints, "prints")
    classes = materialize(prints.groupBy("fp").agg(F.min("id").alias("least")), "classes", rows := prints.count())
    edges = links(classes.select("fp"), classes.count())
    roots = components(edges, edges.count()).withColumnRenamed("node", "fp")
    drop_table(edges)
    rooted = classes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    of = rooted.join(least, "root").select("fp", "component")
    return in_few(prints.join(of, "fp").select(F.col("id").alias(id), "fp", "component"), rows)
