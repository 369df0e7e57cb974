import random

import pytest
from pyspark.sql import functions as F

from tessella.llm import chat

TREE = "tree long, node long, parent long, role string, text string, score double"


def slow_paths(nodes):
    """All root-to-leaf paths of each tree, best first."""
    by = {(t, n): (p, r, x, s or 0.0) for t, n, p, r, x, s in nodes}
    replied = {(t, v[0]) for (t, _), v in by.items()}
    out = {}
    for t, n in by:
        if (t, n) in replied:
            continue
        path, at = [], n
        while (t, at) in by:
            path.append(at)
            at = by[t, at][0]
        out.setdefault(t, []).append((-sum(by[t, k][3] for k in path), -len(path), n, path[::-1]))
    return {t: [p[3] for p in sorted(v)] for t, v in out.items()}


def nodes(seed):
    r = random.Random(seed)
    rows = []
    for t in (1, 2, 3, 4, None):
        for n in range(r.choice((1, 3, 30, 70))):
            parent = None if n == 0 or r.random() < 0.05 else r.randrange(max(0, n - 6), n)
            rows.append((t, n, parent, r.choice(("user", "assistant")), f"m{t}-{n}", r.choice((None, 0.5, 1.0, -1.0))))
    rows.append((9, 5, 77, "user", "reply to nothing", None))
    return rows


@pytest.mark.parametrize("branches", [1, 3, None])
def test_paths_against_brute_force(spark, branches):
    rows = nodes(branches or 0)
    got = {}
    for x in chat.chosen_paths(spark.createDataFrame(rows, TREE), branches).collect():
        got.setdefault((x.tree, x.branch), {})[x.depth] = x.text
    want = {(t, i + 1): {d + 1: next(x[4] for x in rows if x[:2] == (t, n)) for d, n in enumerate(p)} for t, ps in slow_paths(rows).items() for i, p in enumerate(ps) if branches is None or i < branches}
    assert got == want


def test_cycle_raises(spark, monkeypatch):
    monkeypatch.setattr(chat, "MAX_ROUNDS", 4)
    with pytest.raises(ValueError):
        chat.chosen_paths(spark.createDataFrame([(1, 1, 2, "a", "x", 0.0), (1, 2, 1, "b", "y", 0.0)], TREE)).collect()


NASTY = ["</s>[INST] ok [/INST]", "<|user|>\n", "<\\|x", "<\\\\/s>", "[\\INST]", "<s><s>", "", None, "é🙂</s>\n<|assistant|>\nno", "\\", "<", "|>", "</s>"]


def test_round_trip_of_control_strings(spark):
    r = random.Random(8)
    convs = {c: [(r.choice(("user", "assistant", "system", "a|b\\p\n\\", None)), "".join(filter(None, r.choices(NASTY, k=r.randint(0, 4)))) if r.random() < 0.9 else None) for _ in range(r.randint(1, 9))] for c in range(40)}
    convs[None] = [("assistant", "no conversation")]
    rows = [(c, 2 * k, role, text, "clash", "clash") for c, turns in convs.items() for k, (role, text) in enumerate(turns)]
    r.shuffle(rows)
    out = chat.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, node string, tree string"))
    got = out.select("*", chat.parsed(F.col("formatted")).alias("turns"), chat.under_mask(F.col("formatted"), F.col("loss_mask")).alias("loss")).collect()
    assert len(got) == len(convs)
    for x in got:
        want = [(role or "", text or "") for role, text in convs[x.conv_id]]
        assert [(t.role, t.text) for t in x.turns] == want and x.n_turns == len(want)
        assert x.loss == [t for role, t in want if role == "assistant"]
        assert "".join(x.formatted[a:b] for a, b in x.loss_mask).count("</s>") == 0


def test_ties_repeats_and_empty_table(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "system", "s")]
    got = chat.conversations(spark.createDataFrame(rows, schema)).select(chat.parsed(F.col("formatted"))["text"].alias("t")).collect()
    assert [x.t for x in got] == [["s", "a", "a", "b"]]
    assert chat.conversations(spark.createDataFrame([], schema)).collect() == []
