"""What only shows on long texts and large tables."""

import random
import re
import time
import tracemalloc
import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella import queries
from tessella.functions import arrow
from tessella.functions import clean as C
from tessella.functions import tables as T
from tessella.functions import texts as X
from tessella.functions.dialect import sub_python
from tessella.operators import corpus
from tessella.sources import files


def test_zip_longest_splits_a_text_once(spark):
    df = spark.createDataFrame([(0, "One. Two! Three", "a. b"), (1, "", "x"), (2, "", ""), (3, None, None)], "i int, s string, t string")
    z = df.select("i", corpus.zip_longest(corpus.source_sentences(F.col("s")), corpus.target_sentences(F.col("t"))).alias("z")).orderBy("i").collect()
    assert [[tuple(x) for x in r.z] for r in z] == [[(0, "One.", "a."), (1, "Two!", "b"), (2, "Three", "")], [(0, "", "x")], [(0, "", "")], [(0, "", "")]]
    # 4,000 sentences; split once for each of them, they took minutes
    long = spark.createDataFrame([("A short sentence stands here. " * 4000,)], "s string")
    began = time.time()
    assert long.select(F.size(corpus.zip_longest(corpus.source_sentences(F.col("s")), corpus.target_sentences(F.col("s"))))).first()[0] == 4000
    assert time.time() - began < 20


@pytest.mark.parametrize("name", ["blend_plain", "blend_renormalised"])
def test_blends_keep_the_sign_of_what_rounds_to_nothing(spark, tmp_path, name):
    vectors = [(0, [-1e-7, 1e-7, 0.25], 0), (1, [-1e-7, 1e-7, -0.5], 1)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    rows = queries.QUERIES[name](spark, str(tmp_path)).collect()
    assert [str(v) for v in rows[0].vec[:2]] == ["-0.0", "0.0"]


# ---- rules as plain Python, and how work is dealt ----

BITS = ["x", "X", "xx", "[x]", "(X)", "...", "....", "…", "[..]", "[x", "x)", "{d}", "{", "}", "½", "₂", "¹", "⁰", "0.5", "12.75", "1.5.5.5", "0.3333", "1.66a", "0.25", "0 ½", "00 ⅓", "1/2", " ", "  ", "\n", "\xa0", " ", "the", "the", "the", "king", "of", "é", "ß", "ﬁ", "Å", "x-x", "_x_", "(fem.)", "(plur x)", "(DET)", "(ab)", "<gap>", "<big_gap>", "\ue000", "—", "ʾ", "ḫ", "š", ".", ",", "\x1c", "-", "--", "İ", "Σ"]


def odd_texts(seed, n=400):
    r = random.Random(seed)
    few = ["a", "b", "a", "b", "c", ",", "\n"]
    texts_ = ["", " ", "\xa0", *["".join(b + r.choice(("", " ", " ")) for b in r.choices(BITS, k=r.randint(1, 25))) for _ in range(n)]]
    return texts_ + [" ".join(r.choices(few, k=r.randint(2, 60))) for _ in range(n)] + ["".join(b + r.choice((" ", "  ")) for b in r.choices(few, k=30)) for _ in range(n)]


def py(*rules, flags=0):
    return lambda t: sub_python(t, *rules, flags=flags)


def by_words(words):
    for n in range(8, 2, -1):
        out, at = [], 0
        while at < len(words):
            step = at + n
            while len(words[at:step]) >= n and words[step : step + n] == words[at : at + n]:
                step += n
            met = step > at + n
            out += words[at : at + n] if met else [words[at]]
            at = step if met else at + 1
        words = out
    return words


def key_by_rules(t):
    t = sub_python(t.lower().strip(), ("[₀-₉⁰-⁹0-9]", ""), (r"\{([^}]+)\}", r" DET_\1 "), (r"\(([a-z]{1,6})\)", r" DET_\1 "))
    t = t.translate(str.maketrans("[]<>", "    ", "ʾʿˀˁ'")).replace("…", " GAP ").replace("...", " GAP ")
    t = sub_python(t, (r"\b[xX]{1,3}\b", " GAP ")).translate(str.maketrans(".", " ", "+"))
    bare = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    return " ".join(sub_python(bare, (r"[^a-z0-9\-_ ]+", " ")).split())


def ascii_by_rules(t):
    t = t.translate(str.maketrans(T.DIACRITICS, T.DIACRITICS_ASCII))
    return re.sub(r"[^\x00-\x7f]", " ", "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))


RULES = {
    "output_gaps": (X.output_gaps, lambda t: py(*T.OUTPUT_GAP_RULES)(py((r"\[x\]|\(x\)|\bx\b", "<gap>"), flags=re.I)(t))),
    "remove_grammar": (X.remove_grammar, py((T.GRAMMAR, ""), flags=re.I)),
    "remove_bracketed": (X.remove_bracketed, lambda t: py((T.BRACKETED, ""))(t.replace("<gap>", "\ue000").replace("<big_gap>", "\ue001")).replace("\ue000", "<gap>").replace("\ue001", "<big_gap>")),
    "decimal_fractions": (X.decimal_fractions, py(*C.decimal_rules())),
    "zero_fractions": (X.zero_fractions, py((r"\b0\s+([¼½¾⅓-⅞])", r"\1"))),
    "word_loops": (X.unrepeated, py(*T.REPEAT_RULES)),
    "ngram_loops": (X.without_loops, lambda t: t if len(t.split()) < 6 else " ".join(by_words(t.split()))),
    "retrieval_key": (X.retrieval_key, key_by_rules),
    "sanitize_ascii": (X.to_ascii, ascii_by_rules),
}


@pytest.mark.parametrize("name", RULES)
def test_fast_rules_mean_what_the_tables_say(name):
    fast, slow = RULES[name]
    for t in odd_texts(len(name)):
        assert fast(t) == slow(t), t


LONG = ["postprocess_pipeline", "postprocess_ascii", "postprocess_plain", "postprocess_retrieved", "repeated_phrases", "word_loops", "retrieval_key_superscripts", "retrieval_key", "decimal_fractions", "sanitize_ascii", "repaired_output"]


def documents(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(folder / "documents.parquet"))


@pytest.mark.parametrize("name", LONG)
def test_no_chain_of_regular_expressions_over_large_tasks(spark, tmp_path, monkeypatch, name):
    documents(spark, tmp_path, [(i, f"{i} a word") for i in range(600)])
    monkeypatch.setattr(files, "TASK", 64)
    df = queries.QUERIES[name](spark, str(tmp_path))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 0
    assert df.rdd.getNumPartitions() > 64


def test_a_batch_is_turned_into_python_by_slices():
    batch = pa.array([f"{i} word " * 3000 for i in range(2000)] + [None])
    tracemalloc.start()
    out = X.mapped(batch, X.to_ascii)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.equals(batch) and batch.nbytes > 40_000_000 and peak < 8_000_000


@pytest.mark.parametrize("rule", [X.remove_bracketed, X.retrieval_key, X.decimal_fractions, X.postprocess])
def test_time_grows_with_a_text(rule):
    for t in ("(" * 200_000, "{" * 200_000, "1" * 200_000 + ".5x", "[(" * 100_000 + ")"):
        began = time.process_time()
        rule(t)
        assert time.process_time() - began < 5


def test_a_dictionary_entry_is_looked_up_once_and_words_stay_with_their_document(spark, tmp_path):
    documents(spark, tmp_path, [(1, "a-na a-na \xa0zz"), (2, "x\n")])
    df = queries.QUERIES["short_dictionary"](spark, str(tmp_path))
    got = {(r.doc_id, r.word): tuple(r)[2:] for r in df.collect() if r.doc_id > 0}
    assert got == {(1, "a-na"): (2, "To", "To", "To"), (1, "zz"): (1, None, None, None), (2, "x"): (1, None, "", "broken")}
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    # before, words were split again for each table and shuffled once they were counted
    assert plan.count("split(") <= 1 and plan.count("Exchange hashpartitioning") == 1


def test_word_pairs_of_large_tables_are_small_tasks_of_plain_columns(spark, tmp_path, monkeypatch):
    documents(spark, tmp_path, [(i, f"a b a b c{i}") for i in range(300)] + [(900, "alone"), (901, ""), (902, None)])
    monkeypatch.setattr(files, "TASK", 64)
    df = queries.QUERIES["word_ngrams"](spark, str(tmp_path))
    got = {r.gram: (r.kind, r.n, r.cnt) for r in df.collect()}
    assert got["a\x01b"] == ("word", 2, 600) and got["b\x01a"][2] == 300 and got["b\x01c7"][2] == 1 and len(got) == 302
    assert "sequence(" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_scores_count_a_text_once_for_rows_that_share_it(monkeypatch):
    made = []
    monkeypatch.setattr(arrow, "bleu_tokens", lambda t: made.append(t) or tuple(t.split()))
    arrow._scored.cache_clear(), arrow._score_counts.cache_clear()
    orders = (("b", (1, 2)), ("w", (1,)), ("char", (3,)))
    rows = [("a b, c", "a b c."), ("a b c.", "a b c."), ("a b, c", "a b c."), ("", "a b c.")]
    got = [arrow._score_counts(a, b, orders) for a, b in rows]
    assert sorted(made) == ["", "a b c.", "a b, c"]
    assert got[0] == got[2] == [("b", 1, 1, 3, 3), ("b", 2, 0, 2, 2), ("w", 1, 3, 4, 4), ("char", 3, 0, 2, 2)]
    assert got[3] == [("b", 1, 0, 0, 3), ("b", 2, 0, 0, 2), ("w", 1, 0, 0, 4), ("char", 3, 0, 0, 2)]


@pytest.mark.parametrize("name", ["cap_grid", "cap_grid_texts", "pattern_report", "model_cascade"])
def test_cascades_are_even_tasks_without_folds_over_words(spark, tmp_path, monkeypatch, name):
    turns = [(i, k, role, f"{role} says word{i} and more, {k}. " * 12) for i in range(40) for k, role in enumerate(("user", "assistant"))]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    spark.createDataFrame([(i, f"item {i}") for i in range(7)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    plan = queries.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    # a repartition by number is not merged into a few tasks, as what windows leave is
    assert "Repartition 16, true" in plan
    if name.startswith("cap_grid"):
        assert "aggregate(" not in plan
