import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import suffix_dedup as sd


def slow(texts, length):
    seen = {}
    for t in texts:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] = seen.get(b[i : i + length], 0) + 1
    out = []
    for t in texts:
        b = (t or "").encode()
        mark = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] >= 2:
                mark[i : i + length] = b"\1" * length
        spans = [(i, 0) for i in range(len(b)) if mark[i] and (i == 0 or not mark[i - 1])]
        out.append((len(b), sum(mark), len(spans), hashlib.sha256(bytes(x for x, m in zip(b, mark) if not m)).hexdigest()))
    return out


def corpus(seed):
    r = random.Random(seed)
    words = ["".join(r.choices("abcdeé ", k=r.randint(1, 8))) for _ in range(500)]
    say = lambda n: " ".join(r.choices(words, k=n))
    passages = [say(n) for n in (30, 45, 60, 90)]
    texts = [None, "", "short", "a" * 199, "b" * 200, "c" * 450, "ab" * 300, say(80) * 3]
    for _ in range(120):
        texts.append(say(r.randint(5, 90)) + "".join(r.choice(passages)[r.randint(0, 20) :] + say(r.randint(0, 40)) for _ in range(r.randint(0, 2))))
    for t in r.sample(texts[8:], 30):
        cut = list(t)
        for _ in range(r.randint(1, 4)):
            cut[r.randrange(len(cut))] = "X"
        texts += ["".join(cut), t[r.randint(0, 150) :]]
    return texts + [texts[9]] * 5 + [passages[0] + say(3) for _ in range(60)]


def run(spark, texts, **how):
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, t string, k1 int")
    x = sd.repeated_spans(df, **how)
    kept = sd.kept_bytes(F.col("text"), F.col("n_bytes"), F.col("spans"))
    got = x.select("doc_id", "n_bytes", sd.removed_bytes(F.col("spans")).alias("r"), F.size("spans").alias("s"), F.sha2(kept, 256).alias("k")).collect()
    return {g[0]: tuple(g)[1:] for g in got}


@pytest.mark.parametrize("split", [sd.SPLIT, 4])
def test_spans_against_brute_force(spark, split):
    """Leads with more than four contexts are split, so the join across boundaries decides."""
    texts = corpus(3 + split)
    want = slow(texts, 200)
    assert run(spark, texts, split=split) == dict(enumerate(want))
    assert 20 < sum(w[1] > 0 for w in want) < len(want) - 20


def test_other_length_and_empty_table(spark):
    texts = corpus(11)[:80]
    assert run(spark, texts, length=70) == dict(enumerate(slow(texts, 70)))
    assert run(spark, []) == {}
    with pytest.raises(ValueError):
        run(spark, [], length=40)


def test_repeated_rows_and_null_ids(spark):
    text = "".join(random.Random(1).choices("abcdefgh ", k=300))
    df = spark.createDataFrame([(None, text), (None, text), (None, "z" + text[:199]), (4, None)], "doc_id long, text string")
    got = sorted((g["n_bytes"], [tuple(s) for s in g["spans"]]) for g in sd.repeated_spans(df).collect())
    assert got == [(0, []), (200, []), (300, [(0, 300)]), (300, [(0, 300)])]


def test_multikey_sort_orders_and_measures():
    r = np.random.default_rng(2)
    rows = np.repeat(r.integers(97, 99, (60, 21), dtype=np.uint8), 3, axis=0)
    rows[::4, 17] = 0
    order, shared = sd.multikey_sort(rows)
    listed = [rows[i].tobytes() for i in order]
    assert listed == sorted(x.tobytes() for x in rows)
    for a, b, n in zip(listed, listed[1:], shared):
        assert a[:n] == b[:n] and (n == 21 or a[n] != b[n])
