import collections
import random
import zlib

import pytest

from tessella.llm import sharding


def place(spark, texts, **how):
    rows = [(i, t, 9, b"x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int, key binary")
    got = sharding.sharded(df, **how).collect()
    assert sorted(x.doc_id for x in got) == list(range(len(texts)))
    shards = how.get("shards", 24)
    counts = collections.Counter(x.shard for x in got)
    assert set(counts) <= set(range(shards))
    if texts:
        assert max(counts.values()) - min([counts[s] for s in range(shards)]) <= 1
    for s in counts:
        assert sorted(x.slot for x in got if x.shard == s) == list(range(counts[s]))
    for x in got:
        b = (texts[x.doc_id] or "").encode()
        assert (x.size, x.text_crc32) == (len(b) + 8, zlib.crc32(b))
    where = collections.defaultdict(set)
    for x in got:
        where[texts[x.doc_id] or ""].add(x.shard)
    return where


def test_groups_stay_together_and_sizes_are_even(spark):
    r = random.Random(1)
    texts = [f"one {i}" for i in range(400)] + ["é", None, "", None]
    for g in range(40):
        texts += [f"group {g}"] * r.randint(2, 6)
    r.shuffle(texts)
    where = place(spark, texts, shards=7)
    assert all(len(v) == 1 for v in where.values())


def test_a_group_beyond_a_share_fills_few_shards(spark):
    texts = ["hot"] * 300 + [f"single {i}" for i in range(600)]
    where = place(spark, texts, shards=12, chunk_rows=20)
    assert 4 <= len(where["hot"]) <= 6


@pytest.mark.parametrize("n", [0, 1, 5, 24, 25])
def test_small_tables_and_all_one_text(spark, n):
    place(spark, [f"t{i}" for i in range(n)])
    place(spark, ["same"] * n, chunk_rows=3)


def test_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(None, "a"), (None, "a"), (3, None), (3, None), (3, "b")], "doc_id long, text string")
    got = sharding.sharded(df, shards=2).collect()
    assert len(got) == 5 and len({(x.shard, x.slot) for x in got}) == 5
