import random

import pytest
from pyspark.sql import functions as F

from tessella.functions import clean as C
from tessella.functions import tables as T
from tessella.functions.arrow import aligned, unlooped, with_tail
from tessella.functions.dialect import blank, collapse, strip, sub, sub_python, tokens

NBSP, SEP = " ", " "
BITS = ["x", "xx", "[x]", "[xxx]", "...", "....", ".....", "…", "……", "[ . . . ]", "( . .. )", "{d}", "{GIŠ}", "a-na", "KÙ.BABBAR", "½", "₂", "¹", "0.5", "12.75", "0 ½", "1/2", " ", "  ", "\n", NBSP, SEP, "the", "the", "é", "x-x", "_x_", "(fem.)", "(plur x)", "<gap>", "<big_gap>", ".", ",", "\x1c"]


def texts(seed, n=150):
    r = random.Random(seed)
    return ["", " ", NBSP, *["".join(b + r.choice(("", " ", " ")) for b in r.choices(BITS, k=r.randint(1, 14))) for _ in range(n)]]


def apply(spark, rows, column):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    return [x[1] for x in sorted(df.select("i", column(F.col("t"))).collect())]


@pytest.mark.parametrize("rules", [T.GAP_RULES, T.STRICT_GAP_RULES, T.SHORT_GAP_RULES, T.OUTPUT_GAP_RULES, T.DOT_GAP_RULES, T.BRACED_RULES, T.REPEAT_RULES, C.decimal_rules(), [(r"\b[xX]{1,3}\b", " GAP ")], [(T.GRAMMAR, "")]])
def test_rules_mean_the_same_in_python(spark, rules):
    rows = texts(len(rules))
    assert apply(spark, rows, lambda t: sub(t, *rules)) == [sub_python(t, *rules) for t in rows]


def test_primitives_as_python_has_them(spark):
    rows = texts(77)
    assert apply(spark, rows, tokens) == [t.split() for t in rows]
    assert apply(spark, rows, strip) == [t.strip() for t in rows]
    assert apply(spark, rows, collapse) == [" ".join(t.split()) for t in rows]
    assert apply(spark, rows, blank) == [not t.strip() for t in rows]


GOLDEN = [
    (C.preprocess, "KISIB {d}UTU-ba-ni DUMU e-na-su-en2", T.PREFIX + "KISIB UTU-ba-ni DUMU e-na-su-en2"),
    (C.preprocess, "1 ma-na KU.BABBAR ... sa-ru-pa-am", T.PREFIX + "1 ma-na KU.BABBAR <big_gap> sa-ru-pa-am"),
    (C.preprocess, "{m}a-sur-i-di [...] ana {ki}ka-ni-is", T.PREFIX + "a-sur-i-di <big_gap> ana ka-ni-is"),
    (C.preprocess, "", T.PREFIX),
    (C.preprocess, None, T.PREFIX),
    (C.postprocess, "Seal of Samas-bani, son of Enasuen2", "Seal of Samas-bani, son of Enasuen2"),
    (C.postprocess, "1 mina of refined silver halved (fem.) price", "1 mina of refined silver halved price"),
    (C.postprocess, "Assur-idi [...] to Kanes (the city) the the tablet", "Assur-idi to Kanes the tablet"),
    (C.postprocess, "He said: I will give 0.5 silver", "He said: I will give 0 ½ silver".replace("0 ½", "½")),
    (C.postprocess, "1/2 mina", "12 mina"),
    (C.to_ascii, "½ mina", "1 2 mina"),
    (C.unbraced_signs, "{d}-enlil  {KI}  {GIŠ}-TUKUL", "(d)enlil  KI  (GIŠ)TUKUL"),
    (C.normalize_gaps, "a x x b", "a <gap> x b"),
    (C.dictionary_lookup, "a-na", "To"),
    (C.dictionary_lookup, " x ", ""),
    (C.dictionary_lookup, "a-na b", None),
    (lambda t: C.dictionary_lookup(t, T.DICTIONARY_ASCII), "x", "broken"),
    (C.is_broken, "[... a b", True),
    (C.is_broken, "", True),
    (C.is_broken, "x x a", True),
    (C.is_broken, "a b c", False),
    (C.is_garbage, "no", True),
    (C.is_garbage, "a a a a a a b", True),
    (C.is_garbage, "word", False),
    (C.remove_repeats, "the king of the land the king of the land", "the king of the land"),
    (C.retrieval_key, "KIŠIB {d}UTU-ba-ni ... x KÙ.AN¹₂ (d)", "kisib _d utu-ba-ni ku an1 _d"),
    (C.strict_gaps, None, ""),
    (C.postprocess_plain, " ", "hnr"),
    (C.without_template, "A good answer. You are an expert in things", "A good answer."),
    (C.without_template, "He gave it. um-ma a-na-ku said. More", "He gave it."),
    (C.edited_answer, "x Corrected: He went home. And th", "He went home."),
    (C.whole_sentences, "a" * 150 + ". " + "b" * 90, "a" * 150),
    (C.or_default, "  ", "broken text"),
]


@pytest.mark.parametrize("k", range(len(GOLDEN)))
def test_golden(spark, k):
    rule, text, want = GOLDEN[k]
    assert apply(spark, [text], rule) == [want]


def test_cap_keeps_whole_words_and_the_first(spark):
    def cap(t, most):
        if len(t) <= most:
            return t
        out, size = [], 0
        for w in t.split():
            if size + len(w) + 1 > most and size:
                break
            out.append(w)
            size += len(w) + 1
        return " ".join(out)

    rows = texts(5)
    for most in (0, 5, 12, 30):
        assert apply(spark, rows, lambda t: C.capped(t, F.lit(most))) == [cap(t, most) for t in rows]


def test_fallback_text(spark):
    lexicon = {"la": ["not"], "ana": ["to", "for"]}
    rows = ["ana la 15 ana", "zzz 7", "zzz", None]
    assert apply(spark, rows, lambda t: C.fallback_text(t, lexicon)) == ["to for not involving 15 <big_gap>", "involving 7 <big_gap>", "From <gap> to <gap> <big_gap>", "From <gap> to <gap> <big_gap>"]


def test_python_helpers():
    assert unlooped("a b c a b c a b c d".split()) == "a b c d".split()
    assert aligned(["a b", "c"], ["x y", "z"]) == [("a b", "x y"), ("c", "z")]
    assert aligned([], ["x"]) == [] and aligned(["a"], ["b", "c d e f"]) == [("a", "b c d e f")]
    assert with_tail("a b", "c d") == "a b"
    assert with_tail("one two three", "zero one two three four five six").endswith("four five six")
