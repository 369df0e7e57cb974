"""Every opN query over a whole small table against its contract, worked out in plain Python."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from test_models import slow_stats
from test_pii import slow as slow_pii
from test_simhash import slow_components, slow_print
from test_suffix_dedup import slow as slow_spans
from tokenizers import Tokenizer

from tessella.llm import labelled, queries, sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, slot string, score string, pii string, fp string, spans string, token_ids string"


def texts():
    r = random.Random(6)
    words = ["".join(r.choices("abcdeé", k=r.randint(1, 7))) for _ in range(200)]
    say = lambda n: " ".join(r.choices(words, k=n))
    passage = say(70)
    out = [None, "", " \n", "one", say(4000), "é🙂 </s> <|x|>", "mail a@b.c or 10.0.0.1, card 4111 1111 1111 1111, call +1 555 123 4567"]
    out += [say(r.randint(1, 120)) for _ in range(30)] + [f"{say(10)} {passage} {say(r.randint(1, 9))}" for _ in range(6)]
    out += [f"you idiot {say(8)} moron you scum {say(30)} loser" for _ in range(25)]
    base = out[20].split()
    out += [out[4], out[8], out[8], out[20].upper(), " ".join([*base[:3], "zz", *base[3:]])]
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at, some = str(tmp_path_factory.mktemp("contract")), texts()
    rows = [(i, t, None if i % 3 else "en", "s", len(t or ""), *["clash"] * 6) for i, t in enumerate(some)]
    r = random.Random(1)
    items = [(0, " ".join(some[20].split()[:30])), (1, None), (2, ""), (3, "nothing of this is anywhere at all")]
    labels = [(i, int(i % 2), int("idiot" in (t or ""))) for i, t in enumerate(some) if r.random() < 0.8] + [(None, 1, 1), (5, None, None)]
    talk = [(c, k, ("user", "assistant")[k % 2], f"turn {k} </s>[INST] {c}" if k % 5 else None) for c in (1, 2) for k in range(c * 7)]
    for name, data, schema in (("documents", rows, SCHEMA), ("benchmark", items, "item_id long, text string"), ("labels", labels, "doc_id long, quality int, toxic int"), ("conversations", talk, "conv_id long, turn long, role string, text string")):
        spark.createDataFrame(data, schema).repartition(3).write.parquet(f"{at}/{name}.parquet")
    empty = str(tmp_path_factory.mktemp("none"))
    for name in ("documents", "benchmark", "labels", "conversations"):
        spark.read.parquet(f"{at}/{name}.parquet").limit(0).write.parquet(f"{empty}/{name}.parquet")
    return at, empty


def rows(spark, folder, name):
    out = queries.QUERIES[name](spark, folder[0])
    return out.columns, {x[0]: x for x in out.collect()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_op1(spark, folder):
    columns, got = rows(spark, folder, "op1_simhash")
    prints = {i: slow_print(t) for i, t in enumerate(texts())}
    parts = slow_components(prints)
    assert columns[:3] == ["doc_id", "fingerprint", "component_id"]
    assert {i: tuple(x)[1:3] for i, x in got.items()} == {i: (f"{p:016x}", parts[i]) for i, p in prints.items()}


def test_op2(spark, folder):
    columns, got = rows(spark, folder, "op2_suffix_dedup")
    assert columns[:5] == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert [tuple(got[i])[1:5] for i in sorted(got)] == slow_spans(texts(), 200)


def test_op3(spark, folder):
    """The law, the slots, and that no group is cut but where a plain count says it must."""
    columns, got = rows(spark, folder, "op3_sharding")
    some = texts()
    assert columns[:7] == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    for i, x in got.items():
        b = (some[i] or "").encode()
        assert (x.size, x.text_crc32, x.law, x.grown_shard) == (len(b) + 8, zlib.crc32(b), "rows", None)
    per = Counter(x.shard for x in got.values())
    assert set(per) == set(range(24)) and max(per.values()) - min(per.values()) <= 1
    for s in range(24):
        assert sorted(x.slot for x in got.values() if x.shard == s) == list(range(per[s]))
    groups = {}
    for i, x in got.items():
        groups.setdefault(some[i] or "", set()).add(x.shard)
    sizes, share = Counter(t or "" for t in some), min(per.values())
    assert all(len(v) <= -(-sizes[t] // share) for t, v in groups.items())
    links = sharding.cut_links(queries.QUERIES["op3_sharding"](spark, folder[0]), "text_crc32").first()
    assert links.cut == sum(len(v) - 1 for v in groups.values()) and links.links == sum(n - 1 for n in sizes.values())


def test_op4_and_op8(spark, folder):
    library = Tokenizer.from_file(queries.TOKENIZER)
    library.no_truncation()
    library.no_padding()
    columns, files = rows(spark, folder, "op4_token_files")
    assert columns[:4] == ["doc_id", "start", "n_tokens", "ids_crc32"]
    _, coded = rows(spark, folder, "op8_bpe")
    start = 0
    for i, t in enumerate(texts()):
        ids = library.encode(t or "", add_special_tokens=False).ids
        ended = np.array([*ids, queries.END_ID], "<u4")
        assert tuple(files[i])[1:4] == (start, len(ended), zlib.crc32(ended.tobytes()))
        start += len(ended)
        assert tuple(coded[i])[1:4] == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_op5(spark, folder):
    columns, got = rows(spark, folder, "op5_quality")
    assert columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    for i, t in enumerate(texts()):
        stats = slow_stats(t)
        failed = stats[0] < 20 or 100 * stats[4] > 30 * stats[0]
        assert list(got[i])[1:7] == [*stats, failed] and not (failed and got[i].kept)


def test_op6(spark, folder):
    columns, got = rows(spark, folder, "op6_pii")
    assert columns[:7] == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    for i, t in enumerate(texts()):
        want = slow_pii(t)
        counts = Counter(x.split(":")[0] for x in want)
        assert tuple(got[i])[1:6] == (*[counts[k] for k in ("email", "ip", "card", "phone")], sha(",".join(want)))
        assert set(want) <= set(got[i].spans.split(",")) | {""}


def test_op7(spark, folder):
    found = {(x.doc_id, x.item_id) for x in queries.QUERIES["op7_decontaminate"](spark, folder[0]).collect()}
    some = texts()
    first = some[20].split()[:30]
    assert found == {(i, 0) for i, t in enumerate(some) if t and len(set(first) & set(t.lower().split())) > 25 and t.lower()[:10] == some[20].lower()[:10]}


def test_op10(spark, folder):
    columns, got = rows(spark, folder, "op10_toxicity")
    assert columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    for i, x in got.items():
        assert x.held_out == labelled.is_held_out(i) and 0 <= x.score <= 1 and x.predicted == int(x.score >= 0.7)
    by_text = {}
    for i, t in enumerate(texts()):
        assert by_text.setdefault(t or "", got[i].score) == got[i].score


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_empty_tables(spark, folder, name):
    assert queries.QUERIES[name](spark, folder[1]).count() == (1 if name == "op9_chat" else 0)
