import json
import random
import time

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessella.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


def texts():
    r = random.Random(3)
    bits = ["the", "don't", " 'll", "  ", "\n\n", " \n x", "été", "日本語", "1234", "<|endoftext|>", "<|endo", "!!!", "\t", " ", "🙂", "a" * 50, "'s", "... ", "\r\n", "\x1c", "\x85", "½²"]
    yield from ["", " ", "\n", "a", "word " * 20000, "x" * 30000, " " * 20000 + "y", "<|endoftext|>"]
    for k in range(60):
        some = bits if k % 3 == 0 else [b for b in bits if "endoftext" not in b]
        yield "".join(r.choices("abc de\n", k=r.randint(0, 9000)))
        yield (" " if k % 2 else "").join(r.choices(some, k=r.randint(1, 6000)))


def test_ids_are_the_librarys():
    library, encoder = Tokenizer.from_file(PATH), bpe.ChunkEncoder(bpe.ByteBPE(PATH))
    joined = 0
    for t in texts():
        want = library.encode(t, add_special_tokens=False).ids
        got = encoder.encode(t)
        assert got.tolist() == want
        assert encoder.bpe.decode(got) == library.decode(want, skip_special_tokens=False)
        joined += sum(len(bpe.cuts(s)) - 1 for s in encoder.bpe.segments(t) if isinstance(s, str))
    assert joined > 250


def test_shared_passages_are_encoded_once():
    r = random.Random(4)
    words = ["".join(r.choices("abcdefgh", k=5)) for _ in range(500)]
    shared = " ".join(r.choices(words, k=20000))
    encoder = bpe.ChunkEncoder(bpe.ByteBPE(PATH))
    encoder.encode("one start " + shared)
    before = encoder.misses
    encoder.encode("quite another beginning of it " + shared)
    assert encoder.misses - before <= 3 and encoder.hits > 20
    tight = bpe.ChunkEncoder(encoder.bpe, 1000)
    assert tight.encode(shared).tolist() == encoder.encode(shared).tolist() and tight.held <= 8192


def test_cuts_depend_on_content_only():
    r = random.Random(6)
    text = "".join(r.choices("abcd efgh", k=60000))
    a = set(bpe.cuts(text))
    b = {c - 7 for c in bpe.cuts("shifted"[:7] + text)}
    assert len(a & b) > 0.9 * len(a)


def test_round_trip_on_frames(spark):
    rows = [(1, "some text", "x"), (1, "some text", "x"), (2, None, None), (None, "", "y"), (3, "é" * 20000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.with_decoded(bpe.with_token_ids(df, PATH), PATH)
    assert out.where(F.coalesce("text", F.lit("")) != F.col("decoded")).count() == 0 and out.count() == 5
    assert out.where("text is null").select(F.size("token_ids")).first()[0] == 0
    assert bpe.with_token_ids(df.limit(0), PATH).count() == 0
    assert np.asarray(out.where("doc_id = 2").first().token_ids).size == 0


def test_plain_text_is_not_searched_byte_by_byte(tmp_path):
    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    (tmp_path / "bare.json").write_text(json.dumps(spec | {"added_tokens": []}), encoding="utf-8")

    def seconds(run, text):
        times = []
        for _ in range(5):
            start = time.process_time()
            run(text)
            times.append(time.process_time() - start)
        return min(times)

    text, names = " international government" * 40000, "a <|unused|> b <|endoftext|> é<|endo"
    for path in (PATH, str(tmp_path / "bare.json")):
        one, library = bpe.ByteBPE(path), Tokenizer.from_file(path)
        assert bpe.ChunkEncoder(one).encode(names).tolist() == library.encode(names, add_special_tokens=False).ids
        assert one.plain(text).tolist() == one.ranks.encode_ordinary(text)
        assert seconds(one.plain, text) < 2 * seconds(one.ranks.encode_ordinary, text)
