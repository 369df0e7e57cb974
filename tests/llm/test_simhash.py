import itertools
import random
import re

import numpy as np
import xxhash

from tessella.llm import common, simhash
from tessella.llm import components as stars
from tessella.llm.components import components


def slow_print(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\\x20\\x09-\\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(prints):
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(prints, 2):
        if bin(prints[a] ^ prints[b]).count("1") <= 3:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in prints}


def test_fingerprint_is_the_definition():
    for t in [None, "", " \n", "One", "one TWO", "Ä b C d", "a b c d e f a b c", "x\x1cy z w q", "w " * 5000]:
        assert simhash.fingerprint(t) == slow_print(t), t


def test_near_duplicates_against_brute_force(spark):
    r = random.Random(5)
    words = ["".join(r.choices("abcdefgh", k=r.randint(2, 7))) for _ in range(300)]
    texts = []
    for _ in range(40):
        base = r.choices(words, k=120)
        texts.append(" ".join(base))
        for _ in range(r.randint(0, 4)):
            copy = list(base)
            copy[r.randrange(120)] = r.choice(words)
            texts.append(" ".join(copy))
    texts += ["", None, "  ", "Same text here now", "same TEXT here now"]
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, component int")
    got = {x.doc_id: (x.fp & (2**64 - 1), x.component) for x in simhash.near_duplicates(df).collect()}
    prints = {i: slow_print(t) for i, t in enumerate(texts)}
    want = slow_components(prints)
    assert got == {i: (prints[i], want[i]) for i in prints}
    assert len(set(want.values())) < len(want)


def test_repeats_null_ids_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, "lonely words in here")], "doc_id long, text string")
    got = sorted((str(x.doc_id), x.component) for x in simhash.near_duplicates(df).collect() if x.component)
    assert got == [("1", 1), ("1", 1), ("None", 1)]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def grouped(values, edges):
    root = {int(v): int(v) for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        assert bin(a ^ b).count("1") <= 3 and find(a) != find(b)
        root[find(b)] = find(a)
    groups = {}
    for v in root:
        groups.setdefault(find(v), set()).add(v)
    return {frozenset(g) for g in groups.values()}


def test_looking_up_and_tallying_give_one_forest():
    r = np.random.default_rng(1)
    bits = simhash.mask(0b11111)
    free = [i for i in range(64) if not bits >> i & 1]
    values = np.unique([sum(1 << free[b] for b in set(r.integers(0, 24, 5).tolist())) for _ in range(600)]).astype(np.uint64)
    i, j = simhash.tallied(np.zeros(len(values), np.int64), values)
    a = grouped(values, simhash.forest(values, bits))
    assert a == grouped(values, [(int(values[x]), int(values[y])) for x, y in zip(i, j)]) and len(a) > 1


def test_choices_reach_each_pair_that_shares_five_bytes():
    for shared in itertools.combinations(range(8), 5):
        at = [sum(1 << p for p in shared[:k]) for k in range(1, 6)]
        for k, choice in enumerate(at, 1):
            assert choice in simhash.choices(k)
        assert all(b in simhash.longer(a) for a, b in zip(at, at[1:]))
    assert [simhash.first_choice(n) for n in (0, 4096, 4097, 1 << 20, 1 << 28, 1 << 40)] == [1, 1, 2, 2, 3, 5]


def test_split_lists_lose_no_link(spark):
    """Dense fingerprints, so that lists of one position are split again and again."""
    r = np.random.default_rng(3)
    base = r.integers(0, 1 << 62, 6).tolist()
    values = sorted({b ^ sum(1 << int(x) for x in set(r.integers(0, 64, r.integers(0, 4)))) for b in base for _ in range(150)})
    values = [simhash._signed(v) for v in values]
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    want = set(map(frozenset, grouped([v % (1 << 64) for v in values], forest_of([v % (1 << 64) for v in values]))))
    for n, most in ((len(values), 256), (len(values), 3), (1, 2), (1 << 40, 5)):
        edges = [(x.u % (1 << 64), x.v % (1 << 64)) for x in simhash.links(df, n, most).collect()]
        got = {}
        for v in values:
            got[v % (1 << 64)] = {v % (1 << 64)}
        for a, b in edges:
            assert bin(a ^ b).count("1") <= 3
            both = got[a] | got[b]
            for x in both:
                got[x] = both
        assert set(map(frozenset, got.values())) == want, (n, most)


def forest_of(values):
    """Links of a spanning forest by comparing all pairs."""
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    out = []
    for a, b in itertools.combinations(values, 2):
        if bin(a ^ b).count("1") <= 3 and find(a) != find(b):
            root[find(b)] = find(a)
            out.append((a, b))
    return out


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 300)] + [(None, 5), (7, 7)]
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(300)}


def test_small_tables_are_few_files_however_many_partitions_made_them(spark, monkeypatch):
    """An executor starts a process for each file on a local folder, which the check tool counted as a second executor."""
    session = spark.newSession()
    session.conf.set("spark.sql.shuffle.partitions", "40")
    session.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    r, files = np.random.default_rng(4), {}
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(r.choice(words, 40)) for _ in range(150)]
    texts += [f"{t} {t} {t} {w}" for t in texts[:50] for w in ("end", "stop", "halt")]
    df = session.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)

    def counted(table, tag, *args, **options):
        out = common.materialize(table, tag, *args, **options)
        files.setdefault(tag, []).append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(simhash, "materialize", counted)
    monkeypatch.setattr(stars, "materialize", counted)
    out = simhash.near_duplicates(df)
    assert set(files) == {"prints", "classes", "lists", "links", "edges"} and len(files["edges"]) > 1
    assert max(max(n) for n in files.values()) <= 2, files
    assert out.rdd.getNumPartitions() == 1
    prints = {i: slow_print(t) for i, t in enumerate(texts)}
    want = slow_components(prints)
    assert len(set(want.values())) < len(set(prints.values()))
    assert {x.doc_id: (x.fp & (2**64 - 1), x.component) for x in out.collect()} == {i: (prints[i], want[i]) for i in prints}


def test_files_of_a_table_follow_its_rows(spark):
    rows = spark.range(10_000, numPartitions=6)
    for n, files in ((0, 1), (10_000, 1), (common.FILE_ROWS + 1, 2), (1 << 40, 8)):
        out = common.materialize(rows, "rows", n)
        assert len(out.inputFiles()) == files and out.agg({"id": "sum"}).first()[0] == 49_995_000
        common.drop_table(out)
