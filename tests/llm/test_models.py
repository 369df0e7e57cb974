import random
import re
from collections import Counter

import numpy as np
import pytest

from tessella.llm import gbt, labelled, quality, toxicity


def test_flat_trees_score_like_a_walk_and_learn():
    r = np.random.default_rng(0)
    x = r.normal(size=(2000, 4))
    y = (x[:, 0] + (x[:, 1] > 0) * 2 > 1).astype(float)
    m = gbt.fit(x, y, trees=40)
    p = m.score(x)
    assert ((p > 0.5) == y).mean() > 0.95

    def walk(row):
        out = m.base
        for k in m.roots:
            while m.left[k] != k:
                k = m.right[k] if row[m.feature[k]] > m.threshold[k] else m.left[k]
            out += m.value[k]
        return out

    assert np.allclose([walk(row) for row in x[:200]], m.raw(x[:200]))
    assert np.isfinite(m.score(np.full((1, 4), np.nan))).all()


def test_monotone_features_never_turn():
    r = np.random.default_rng(1)
    x = r.uniform(size=(3000, 2))
    y = (np.sin(9 * x[:, 0]) + x[:, 0] + r.normal(size=3000) * 0.3 > 0.5).astype(float)
    m = gbt.fit(x, y, monotone={0: 1})
    grid = np.linspace(0, 1, 400)
    for other in (0.1, 0.9):
        assert (np.diff(m.raw(np.stack([grid, np.full(400, other)], 1))) >= -1e-9).all()


@pytest.mark.parametrize("n,ones", [(0, 0), (5, 0), (5, 5), (40, 1)])
def test_few_rows_or_one_class(n, ones):
    y = np.array([1.0] * ones + [0.0] * (n - ones))
    m = gbt.fit(np.arange(2.0 * n).reshape(n, 2), y)
    assert ((0 <= m.score(np.zeros((3, 2)))) & (m.score(np.zeros((3, 2))) <= 1)).all()


def test_isotonic_is_the_best_step_fit():
    r = np.random.default_rng(2)
    p = np.round(r.uniform(size=300), 2)
    y = (r.uniform(size=300) < p).astype(float)
    xs, ys = gbt.isotonic(p, y)
    assert (np.diff(ys) >= 0).all() and (np.diff(xs) >= 0).all()
    assert abs(np.interp(p, xs, ys).mean() - y.mean()) < 0.05


def slow_stats(text):
    words = re.findall("[^\\x20\\x09-\\x0D]+", text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count, inside = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            inside.update(range(i, i + 8))
    seen, dups = set(), 0
    for line in (text or "").split("\n"):
        if re.search("[^\\x20\\x09-\\x0D]", line):
            dups += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text or "")), dups, len(inside)]


def texts():
    r = random.Random(2)
    yield from ["", " \n\t\n ", "one", "a b c d e f g h a b c d e f g h", "x\x1fy \x85z\n\nx\x1fy \x85z", "É #é $|<>\nÉ #é $|<>", "w " * 3000]
    for _ in range(60):
        yield "".join(r.choices(["aa", "b", "é", "#", "|"], k=1)[0] + r.choice([" ", " ", "\n", "\v"]) for _ in range(r.randint(1, 300)))


def test_statistics_against_brute_force(monkeypatch):
    some = list(texts())
    want = [slow_stats(t) for t in some]
    assert quality.measure(some)[0].tolist() == want
    monkeypatch.setattr(quality, "_BLOCK_WORDS", 50)
    assert quality.measure(some)[0].tolist() == want
    assert quality.measure([])[0].shape == (0, 5)


def corpus():
    r = random.Random(8)
    words = ["".join(r.choices("abcdefghij", k=r.randint(2, 8))) for _ in range(400)]
    rows = []
    for i in range(400):
        ws, bad = r.choices(words, k=r.randint(30, 200)), i % 5 == 0
        if bad:
            for _ in range(6):
                ws.insert(r.randrange(len(ws)), r.choice(["idiot", "scum", "moron", "clown"]))
        if i % 7 == 0:
            ws = [w + "###" for w in ws]
        rows.append((i, " ".join(ws), int(bad), int(i % 7 != 0)))
    return rows


def test_models_on_held_out_rows(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "en", 3) for i, t, _, _ in rows] + [(None, None, None, 0), (1000, "", "x", 1)], "doc_id long, text string, y string, fold int")
    labels = spark.createDataFrame([(i, a, b) for i, _, a, b in rows] + [(None, 1, 1), (3, None, None)], "doc_id long, toxic int, quality int")
    score = {x.doc_id: x.s for x in toxicity.with_toxicity(docs, toxicity.fit(docs, labels), out="s").collect()}
    assert len(score) == 402 and all(0 <= s <= 1 for s in score.values())
    held = [(score[i] >= 0.7, a) for i, _, a, _ in rows if labelled.is_held_out(i)]
    assert sum(p == a for p, a in held) / len(held) > 0.95 and score[1000] < 0.7
    q = {x.doc_id: x.q for x in quality.with_quality(docs, quality.fit(docs, labels), out="q").collect()}
    held = [(q[i].kept, b) for i, _, _, b in rows if labelled.is_held_out(i)]
    assert sum(p == b for p, b in held) / len(held) > 0.95
    assert q[1000].base_failed and not q[None].kept and q[None].n_words == 0


def test_no_labels_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some words"), (1, "some words")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    out = toxicity.with_toxicity(docs, toxicity.fit(docs, labels), out="s").collect()
    assert len(out) == 2 and out[0].s == out[1].s
    assert quality.with_quality(docs.limit(0), quality.fit(docs, labels), out="q").count() == 0


def test_disguised_insults_count():
    lexicon = toxicity.Lexicon({})
    assert lexicon["idiot"] > 0 and lexicon["1d10t"] < 0 and lexicon["i.d.i.o.t"] < 0 and lexicon["table"] == 0
    assert toxicity.features("you absolute idiot", lexicon)[8] == 1


def test_training_never_sees_held_out_labels(spark):
    docs = spark.createDataFrame([(i, str(i)) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(60)], "doc_id long, toxic int")
    got = {int(x.text) for x in labelled.training_rows(docs, labels, "toxic").collect()}
    assert got == {i for i in range(60) if not labelled.is_held_out(i)}
    assert labelled.training_rows(docs, labels, "toxic", max_rows=7).count() == 7


def test_repeated_labelled_ids_keep_the_bound_and_all_folds(spark):
    docs = spark.createDataFrame([(i, f"text {i} {k}") for i in range(60) for k in range(20)] + [(0, "same")] * 300, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    for rows in (docs, docs.where("text = 'same'")):
        got = labelled.training_rows(rows, labels, "toxic", max_rows=100).collect()
        assert len(got) == 100
        again = labelled.training_rows(rows.repartition(5), labels, "toxic", max_rows=100).collect()
        assert sorted(got) == sorted(again)
    all_of = labelled.training_rows(docs, labels, "toxic", max_rows=5000).collect()
    assert len(all_of) == 20 * sum(not labelled.is_held_out(i) for i in range(60)) + 300 * (not labelled.is_held_out(0))
    few = labelled.training_rows(docs.where("text <> 'same'"), labels, "toxic", max_rows=100).collect()
    assert len(few) == 100 and {x.fold for x in few} == {x.fold for x in all_of}
