import random
import re

import pytest

import corpus_pipeline as cp
from tessella.llm import bpe, decontaminate, pii, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tox double, pii string"


def edited(text, r):
    words = text.split()
    for _ in range(r.randint(1, 3)):
        words[r.randrange(len(words))] = "changed"
    return " ".join(words)


def documents(seed=2):
    r = random.Random(seed)
    vocabulary = ["".join(r.choices("aeioukrstn", k=r.randint(2, 6))) for _ in range(300)]
    say = lambda n: " ".join(r.choices(vocabulary, k=n))
    items = [say(25) for _ in range(6)]
    texts = [say(r.randint(5, 120)) for _ in range(80)]
    texts += [f"{say(20)} you idiot moron loser you scum {say(10)} idiot you {k}" for k in range(30)]
    texts += [edited(t, r) for t in texts[:40] if len(t.split()) > 60]
    texts += texts[:10] + [t.upper() for t in texts[10:14]] + [None, "", None]
    texts += [f"{say(30)} {i} {say(10)}" for i in items] + [f"{say(12)} mail a.b@c.org or 10.0.0.{k}" for k in range(9)]
    rows = [(i, t, "en", "s", len(t or ""), 1.0, "x") for i, t in enumerate(texts)]
    labels = [(i, int("idiot" in (t or "")), 1) for i, t in enumerate(texts) if i % 5]
    return rows, labels, list(enumerate(items))


def five(text):
    words = re.findall("[^\\x20\\x09-\\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    rows, labels, items = documents()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_each_stage_against_plain_code(spark, folder):
    """Every stage is worked out in plain Python on what the stage before has kept."""
    rows, _, items = documents()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    lexicon = toxicity.Lexicon(model.entries)
    import numpy as np

    left = [x for x in rows if model.trees.score(np.array([toxicity.features(x[1] or "", lexicon)]))[0] < toxicity.THRESHOLD]
    assert 0 < len(left) < len(rows)
    groups = {}
    grams = {x[0]: five(x[1]) for x in left}
    for x in left:  # closed under links
        near = [k for k, v in groups.items() if any(9 * len(grams[x[0]] & grams[y]) >= 4 * (len(grams[x[0]]) + len(grams[y])) for y in v)]
        groups[x[0]] = {x[0]}.union(*[groups.pop(k) for k in near])
    left = [x for x in left if x[0] in {min(v) for v in groups.values()}]
    tests = [np.array(decontaminate.make_block([t]).items[0]) for _, t in items]

    def leaks(text):
        for (_, t), ids in zip(items, tests):
            block = decontaminate.make_block([t])
            w = decontaminate.word_numbers(text or "", block.vocabulary)
            if len(w) and decontaminate.align([ids], [w])[0][0] >= decontaminate.SCORE_FROM * 2 * len(ids):
                return True
        return False

    left = [x for x in left if not leaks(x[1])]
    now = docs
    for name, stage in cp.STAGES[:3]:
        now = stage(spark, now, folder)
        assert now.columns == docs.columns, name
        at = f"{folder}/{name}"
        now.write.parquet(at)
        now = spark.read.parquet(at)
    assert sorted(map(tuple, now.collect()), key=lambda x: x[0]) == left
    hidden = cp.hide_personal_data(spark, now, folder)
    assert hidden.columns == docs.columns
    spans = {x.doc_id: x for x in pii.with_spans(now.select("doc_id", "text"), out="s").collect()}
    texts = {}
    for x in hidden.collect():
        t, out, at = spans[x.doc_id].text, "", 0
        for s in spans[x.doc_id].s:
            if s.start >= at:
                out += t[at : s.start] + f"<{pii.KINDS[s.kind].upper()}>"
            at = max(at, s.end)
        want = None if t is None else out + t[at:]
        assert x.text == want and x.n_chars == len(want or "")
        texts[x.doc_id] = want or ""
    assert any("<EMAIL>" in t and "<IP>" in t for t in texts.values())
    encoder = bpe.open_bpe(cp.TOKENIZER).library
    got = {x.doc_id: x for x in cp.run(spark, folder).collect()}
    assert set(got) == set(texts)
    for i, x in got.items():
        assert x.exact and x.token_ids == encoder.encode(texts[i], add_special_tokens=False).ids and x.n_tokens == len(x.token_ids)


def test_stages_on_odd_rows(spark, folder):
    odd = [(None, None, None, None, None, None, None), (None, None, None, None, None, None, None), (7, "x@y.z", None, None, None, None, "c"), (7, "x@y.z", None, None, None, None, "c"), (7, "", "en", "s", 0, 0.0, "")]
    empty = spark.createDataFrame([], SCHEMA)
    for rows, counts in ((spark.createDataFrame(odd, SCHEMA), (5, 2, 5, 5, 5)), (empty, (0,) * 5)):
        for (name, stage), n in zip(cp.STAGES, counts):
            assert len(stage(spark, rows, folder).collect()) == n, name
