import random

import numpy as np

from tessella.llm import decontaminate as dc


def slow_align(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            s = dc.MATCH if a[i] == b[j] else -dc.MISMATCH
            h[i + 1, j + 1] = max(0, h[i, j] + s, h[i, j + 1] - dc.GAP, h[i + 1, j] - dc.GAP)
    return int(h.max())


def test_alignment_against_the_plain_table():
    r = np.random.default_rng(3)
    items = [r.integers(0, 6, r.integers(1, 25)) for _ in range(60)]
    texts = [r.integers(-1, 6, r.integers(1, 50)) for _ in range(60)]
    score, end = dc.align(items, texts)
    for x, y, s, e in zip(items, texts, score, end):
        assert s == slow_align(x, y)
        assert s == 0 or slow_align(x, y[:e]) == s and slow_align(x, y[: e - 1]) < s


def tables(seed):
    r = random.Random(seed)
    vocabulary = ["".join(r.choices("aeioukrstné", k=r.randint(2, 6))) for _ in range(400)]
    say = lambda n: r.choices(vocabulary, k=n)
    items = [say(r.randint(12, 40)) for _ in range(25)]
    docs, want = [], {}
    for d in range(120):
        words = say(r.randint(0, 110))
        if d % 4 == 0:
            i = r.randrange(25)
            copy = list(items[i])
            for _ in range(len(copy) // 6 if d % 8 else 0):
                k = r.randrange(len(copy))
                copy[k : k + r.randint(0, 1)] = say(r.randint(0, 1))
            at = r.randint(0, len(words))
            words[at:at] = [w.upper() + "," for w in copy]
            want[d] = i
        docs.append((d, " ".join(words) + "\n", "clash", 1))
    return docs, [(i, " ".join(x) + ".") for i, x in enumerate(items)], want


def slow(docs, items, score_from):
    out = {}
    for d, t, *_ in docs:
        w = dc.words(t or "")
        for i, x in items:
            y = dc.words(x)
            s = slow_align(np.array(y), np.array(w)) / (dc.MATCH * len(y)) if w and len(y) >= dc.N else 0
            if s >= score_from:
                out[d, i] = s
    return out


def test_finds_copies_and_edits_and_leaves_the_rest(spark):
    docs, items, want = tables(1)
    a = spark.createDataFrame(docs, "doc_id long, text string, item string, item_id int")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id): x for x in dc.overlaps(a, b).collect()}
    assert {k: v.score for k, v in got.items()} == slow(docs[:], items, dc.SCORE_FROM)
    assert set(want.items()) == set(got)
    for (d, i), x in got.items():
        part = dc.words(docs[d][1])[x.start_word : x.end_word]
        assert slow_align(np.array(dc.words(items[i][1])), np.array(part)) == round(x.score * dc.MATCH * len(dc.words(items[i][1])))
    small = {(x.doc_id, x.item_id): x.score for x in dc.overlaps(a, b, block_chars=1200).collect()}
    assert small == {k: v.score for k, v in got.items()}
    kept = dc.clean(a, b)
    assert kept.columns == a.columns and {x.doc_id for x in kept.collect()} == set(range(120)) - set(want)


def test_heavy_edits_beside_exact_and_mass_copies(spark):
    r = random.Random(8)
    vocabulary = [f"v{i}" for i in range(3000)]
    say = lambda n: r.choices(vocabulary, k=n)
    items = [say(r.randint(30, 60)) for _ in range(6)]

    def inserted(x):
        out, at = [], 0
        while at < len(x):
            n = r.choice((2, 3))
            out += x[at : at + n] + say(1)
            at += n
        return out

    def replaced(x):
        out, at = list(x), 3
        while at < len(x):
            out[at] = say(1)[0]
            at += r.choice((3, 4))
        return out

    def late(x):
        return [w for k in range(0, len(x) - 6, 2) for w in x[k : k + 2] + say(1)] + x[(len(x) - 5) // 2 * 2 :]

    copies = [e(x) for x in items for e in (inserted, replaced, late)]
    copies += [list(x) for x in items] + [list(items[0]) for _ in range(40)]
    docs = [(d, " ".join(say(20) + c + say(20))) for d, c in enumerate(copies)]
    tests = [(i, " ".join(x)) for i, x in enumerate(items)]
    want = slow(docs, tests, dc.SCORE_FROM)
    assert len(want) == len(docs)
    got = dc.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(tests, "item_id long, text string")).collect()
    assert {(x.doc_id, x.item_id): x.score for x in got} == want


def test_the_most_an_alignment_can_match():
    r = np.random.default_rng(5)
    for _ in range(60):
        x, y = r.integers(0, 6, r.integers(1, 25)), r.integers(-1, 6, r.integers(1, 50))
        assert dc.most(x, y) == sum(min((x == w).sum(), (y == w).sum()) for w in set(x.tolist()))


def test_nulls_repeats_short_items_and_empty_tables(spark):
    item = "one two three four five six seven eight"
    a = spark.createDataFrame([(None, item), (None, "x " + item), (1, None), (1, ""), (2, "two words"), (3, item), (3, item)], "doc_id long, text string")
    b = spark.createDataFrame([(None, item), (None, item), (5, "two words"), (6, None), (7, "")], "item_id long, text string")
    got = sorted(((x.doc_id, x.item_id, x.score, x.start_word, x.end_word) for x in dc.overlaps(a, b).collect()), key=str)
    assert got == [(3, None, 1.0, 0, 8), (None, None, 1.0, 0, 8)]
    assert sorted(x.doc_id for x in dc.clean(a, b).collect()) == [1, 1, 2]
    big = spark.createDataFrame([(2**60 + 1, item), (None, item)], "doc_id long, text string").coalesce(1)
    assert {x.doc_id for x in dc.overlaps(big, b).collect()} == {2**60 + 1, None}
    assert dc.overlaps(a.limit(0), b).collect() == [] and dc.overlaps(a, b.limit(0)).collect() == []
    assert dc.clean(a, b.limit(0)).count() == 7


def test_clean_rows_stay_whatever_their_id(spark):
    item = "one two three four five six seven eight"
    rows = [(None, item, 1), (None, "some clean text here", 2), (None, None, 3), (4, "x " + item, 4), (4, "another clean text", 5), (5, item, 6)]
    a = spark.createDataFrame(rows, "doc_id long, text string, n int")
    kept = dc.clean(a, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert kept.columns == a.columns and sorted(x.n for x in kept.collect()) == [2, 3, 5]


def test_items_longer_than_a_block(spark, monkeypatch):
    docs, items, _ = tables(2)
    r = random.Random(3)
    long = " ".join(f"w{r.randrange(900)}" for _ in range(700))
    docs, items = docs + [(900, "so " + long + " it ends", "clash", 1)], items + [(90, long)]
    a = spark.createDataFrame(docs, "doc_id long, text string, item string, item_id int").coalesce(2)
    b = spark.createDataFrame(items, "item_id long, text string")
    want = slow(docs, items, dc.SCORE_FROM)
    assert (900, 90) in want
    assert {(x.doc_id, x.item_id): x.score for x in dc.overlaps(a, b, block_chars=1200).collect()} == want
    assert [len(x) for x in dc.split([{"text": "x" * n} for n in (3, 4, 30, 5, 5)], 10)] == [2, 1, 2]
    # more words than the numbers of runs have room for
    monkeypatch.setattr(dc, "_BITS", 5)
    block = dc.make_block([x for _, x in items])
    assert len(block.vocabulary) >> dc._BITS
    for i, (_, x) in enumerate(items):
        assert i in {k for k, *_ in dc.passages(dc.word_numbers(x, block.vocabulary), block)}


def test_long_texts_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(dc, "_SLICE", 50)
    text = " ".join(f"w{i}" * (i % 40 + 1) for i in range(200))
    names = {w: i for i, w in enumerate(dc.words(text))}
    assert dc.word_numbers(text, names).tolist() == list(range(200))
