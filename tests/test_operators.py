import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import blend, contracts, corpus, metrics, retrieve, select
from tessella.plans import cascade

PAIR = "k int, a string, b string"


def said(seed, n):
    r = random.Random(seed)
    return [" ".join(r.choices(["to", "the", "king", "é", "gave", "a", "mina,", "(so)", "1.5", "x"], k=r.randint(0, 9))) for _ in range(n)]


def grams(items, n):
    return collections.Counter(tuple(items[i : i + n]) for i in range(len(items) - n + 1))


def slow_chrf(a, b, mean_first):
    if not a or not b:
        return (0.0 if a or b or mean_first else 100.0)
    ps, rs, fs = [], [], []
    for items, orders in (((list(a), list(b)), range(1, 7)), ((a.split(), b.split()), (1, 2))):
        for n in orders:
            x, y = grams(items[0], n), grams(items[1], n)
            c = sum((x & y).values())
            p, r = (c / sum(v.values()) if v else 0.0 for v in (x, y))
            ps.append(p)
            rs.append(r)
            fs.append(5 * p * r / (4 * p + r) if p + r else 0.0)
    p, r = sum(ps) / 8, sum(rs) / 8
    return (5 * p * r / (4 * p + r) if p + r else 0.0) if mean_first else sum(fs) / 8 * 100


def slow_bleu(a, b):
    x, y = a.split(), b.split()
    if not x or not y:
        return 0.0
    logs = [math.log((sum((grams(x, n) & grams(y, n)).values()) + 1) / (sum(grams(x, n).values()) + 1)) for n in (1, 2, 3, 4)]
    return min(1.0, math.exp(1 - len(y) / len(x))) * math.exp(sum(logs) / 4) * 100


def test_sentence_metrics_against_plain_code(spark):
    rows = [(i, a, b) for i, (a, b) in enumerate(zip(["", "", "one", "same text", *said(1, 40)], ["", "x", "one", "same text", *said(2, 40)]))]
    df = spark.createDataFrame(rows, PAIR)
    a, b = F.col("a"), F.col("b")
    got = df.select("k", metrics.chrf(a, b).alias("chrf"), metrics.mean_chrf(a, b).alias("mean"), metrics.bleu(a, b).alias("bleu"), metrics.bleu_chrf(a, b).alias("geo")).collect()
    chrf, mean, bleu, geo = ({x.k: x[f] for x in got} for f in ("chrf", "mean", "bleu", "geo"))
    for k, a, b in rows:
        assert chrf[k] == pytest.approx(slow_chrf(a, b, False)), (a, b)
        assert mean[k] == pytest.approx(slow_chrf(a, b, True)), (a, b)
        assert bleu[k] == pytest.approx(slow_bleu(a, b)), (a, b)
        assert geo[k] == pytest.approx(math.sqrt(max(0, bleu[k]) * chrf[k])), (a, b)
    assert bleu[2] == pytest.approx(100)
    f1 = df.select(metrics.token_f1(F.lit(""), F.lit(" ")), metrics.token_f1(F.lit(""), F.lit("a")), metrics.token_f1(F.lit("a b"), F.lit("b c"))).first()
    assert tuple(f1) == (1.0, 0.0, 0.5)
    with pytest.raises(ValueError):
        metrics.utility("nothing")


def test_corpus_scores_of_equal_and_unlike_texts(spark):
    rows = [(i, t or "word", t or "word") for i, t in enumerate(said(3, 20))]
    same = metrics.corpus_scores(spark.createDataFrame(rows, PAIR), "a", "b").first()
    assert (same.n, same.bleu, same.chrf, same.geo_mean) == (20, 100.0, 100.0, 100.0)
    none = metrics.corpus_scores(spark.createDataFrame([(1, "aaa", "bbb"), (2, None, "b")], PAIR), "a", "b").first()
    assert (none.bleu, none.chrf) == (0.0, 0.0)
    # three of four words match: precisions 3/4, 2/3, 1/2 and none, halved to 1/2
    one = metrics.corpus_scores(spark.createDataFrame([(1, "a b c d", "a b c e")], PAIR), "a", "b").first()
    assert one.bleu == pytest.approx(100 * (3 / 4 * 2 / 3 * 1 / 2 * 1 / 2) ** 0.25, abs=1e-3)


CAND = "group int, cand int, text string, source string, seq_score double"


def test_selection_edges(spark):
    rows = [(1, 0, "only", "s", 0.0), (2, 0, "same", "s", -1.0), (2, 1, "same", "s", -1.0), (3, 0, "the king gave", "s", -2.0), (3, 1, "the king gave a", "s", -0.1), (3, 2, "zzz", "s", -3.0), (4, 0, " ", "s", None), (4, 1, "", "s", None)]
    df = spark.createDataFrame(rows, CAND)
    mbr = {x.group: (x.cand, x.score) for x in select.mbr_select(df).collect()}
    assert mbr[1] == (0, 100.0) and mbr[2] == (0, 0.0) and mbr[3][0] in (0, 1)
    chosen = {x.group: x.text for x in select.consensus_select(df).collect()}
    assert (chosen[1], chosen[2], chosen[4]) == ("only", "same", " ") and chosen[3].startswith("the king gave")
    agreed = {x.group: x for x in select.consistency(df, metrics.token_f1).collect()}
    assert (agreed[1].consistency, agreed[1].best_similarity) == (0.5, 1.0) and (agreed[2].best_i, agreed[2].best_j, agreed[2].best_similarity) == (0, 1, 1.0)
    sure = {x.group: x for x in select.confidence_select(df, 0.5, metrics.token_f1).collect()}
    assert (sure[1].high_confidence_count, sure[1].method) == (1, "high_confidence") and sure[3].cand == 1 and sure[2].low_confidence_count == 2
    assert {x.group: x.text for x in select.top_words(df.fillna({"seq_score": 0.0})).collect()}[3].split()[:2] == ["the", "king"]
    assert {x.group for x in select.weighted_choice(df.withColumn("score", F.lit(1.0))).collect()} == {1, 2, 3, 4}


def test_retrieval_finds_the_source_and_refuses_the_rest(spark, tmp_path):
    pairs = [(i, f"um-ma word{i} a-na šar{chr(97 + i % 26)}im mana{i}", f"target {i}") for i in range(30)]
    index = retrieve.build_index(spark.createDataFrame(pairs, "doc int, src string, tgt string"), str(tmp_path / "index"))
    asks = spark.createDataFrame([(1, pairs[7][1].upper()), (2, "qqqq"), (3, None)], "query int, text string")
    got = {x.query: (x.translation, x.score) for x in retrieve.retrieve(asks, index).collect()}
    assert got[1][0] == "target 7" and got[1][1] > 0.9 and got[2] == ("", 0.0) and got[3] == ("", 0.0)
    with pytest.raises(ValueError):
        retrieve.retrieve(asks, index, accept=0.01)


def test_corpus_operators(spark):
    docs = spark.createDataFrame([("d1", "a. b", "A. B! C"), ("d2", "x\ny", "X"), ("d3", None, None)], "id string, src string, tgt string")
    sentences = spark.createDataFrame([("d2", 1, "one", None), ("d2", 0, "zero", "t")], "doc_id string, o int, src string, tgt string")
    rows = corpus.sentence_rows(docs, sentences, "id", "doc_id", "src", "tgt", "o").collect()
    assert sorted(map(tuple, rows)) == [("d1", 0, "a.", "A."), ("d1", 1, "b", "B!"), ("d1", 2, "", "C"), ("d2", 0, "zero", "t"), ("d2", 1, "one", "nan"), ("d3", 0, "", "")]
    pairs = spark.createDataFrame([(0, "abcd", "first"), (1, "abcd", "second"), (2, "ABCD", "third"), (3, "ab", "short")], "ord int, src string, tgt string")
    memory = corpus.translation_memory(pairs)
    assert [tuple(x) for x in memory.collect()] == [("abcd", "third")]
    split = corpus.hash_split(spark.range(101), "id", 0.2).collect()
    assert sum(x.is_val for x in split) == 21
    names = corpus.name_lexicon(spark.createDataFrame([(0, "PN", "Abā-aḫu"), (1, "PN", "Plain"), (2, "GN", "Šu")], "ord int, type string, norm string"))
    table = {x.ascii: x.name for x in names.collect()}
    assert table == {"aba-ahu": "Abā-aḫu"}
    one = spark.createDataFrame([("gave to (Aba-ahu,",)], "t string").select(corpus.restore_names(F.col("t"), table), corpus.byte_ids(F.lit("é"), 2, 4)).first()
    assert one[0] == "gave to abā-aḫu,".replace("abā", "Abā")
    assert one[1] == [198, 1, 0, 0]


def test_blend_contracts_and_width(spark):
    params = spark.createDataFrame([("a", "w", [1.0, 2.0]), ("b", "w", [3.0, 4.0]), ("a", "v", [1.0]), ("z", "w", [9.0, 9.0])], "model string, name string, vec array<double>")
    got = {x.name: x.vec for x in blend.blended(params, {"a": 1.0, "b": 3.0}).collect()}
    assert got == {"w": [2.5, 3.5], "v": [1.0]}
    plain = {x.name: x.vec for x in blend.blended(params, {"a": 1.0, "b": 3.0}, renormalise=False).collect()}
    assert plain == {"w": [2.5, 3.5], "v": [0.25]}
    out = spark.createDataFrame([(1, "ok"), (1, " "), (None, "é"), (4, None)], "id int, translation string")
    e = contracts.expectations(out, "translation", "id").first()
    assert (e.n_rows, e.null_ids, e.repeated_ids, e.null_texts, e.blank_texts, e.non_ascii_texts, e.ok) == (4, 1, 1, 1, 1, 1, False)
    assert contracts.parallel_columns(out) is None and contracts.resolve(out, ["x", "id"]) == "id"
    with pytest.raises(ValueError):
        contracts.require(out, ["nothing"])
    assert cascade.adaptive_width(40, 24000, {1: 11, 2: 15, 4: 25, 8: 50}) == 8 and cascade.adaptive_width(10**6, 1, {1: 11}) == 1


def test_cascades(spark):
    rows = [("a-na", "m", "r", 0.9), ("[... x", "m", "r", 0.9), ("two words", "the the tablet", "r s", 0.4)]
    df = spark.createDataFrame(rows, "s string, m string, f string, score double")
    s, m, f = F.col("s"), F.col("m"), F.col("f")
    got = [tuple(x) for x in df.select(cascade.model_cascade(s, m), cascade.retrieval_cascade(s, f), cascade.threshold_hybrid(f, F.col("score"), m, 0.5)).collect()]
    assert got == [("To", "To", "r"), ("...", "...", "r"), ("the tablet", "r s", "the the tablet")]
    long = spark.createDataFrame([("s" * 200, "one two", "uno due tre quattro")], "s string, m string, f string")
    assert long.select(cascade.tail_hybrid(s, m, f, 128)).first()[0] == "one two tre quattro"


def test_positional_zip_and_evaluation_refuse_what_does_not_match(spark):
    df = spark.createDataFrame([(["a", "b"], [1, 2]), ([], [])], "a array<string>, b array<int>")
    got = [[tuple(y) for y in x[0]] for x in df.select(corpus.zip_strict(F.col("a"), F.col("b"))).collect()]
    assert got == [[("a", 1), ("b", 2)], []]
    with pytest.raises(Exception, match="arrays of 2 and 1"):
        spark.createDataFrame([(["a", "b"], [1])], df.schema).select(corpus.zip_strict(F.col("a"), F.col("b"))).collect()
    side = lambda *rows: spark.createDataFrame(list(rows), "id int, text string")
    one = metrics.evaluate(side((1, "a b c d"), (2, "x")), side((2, "x"), (1, "a b c d"))).first()
    assert (one.n, one.bleu, one.chrf) == (2, 100.0, 100.0)
    for a, b in ((side((1, "x")), side((1, "x"), (2, "y"))), (side((1, "x")), side((2, "x"))), (side((1, "x"), (1, "x")), side((1, "x"), (2, "x"))), (df.limit(0).select(F.lit(1).alias("id"), F.lit("").alias("text")), side((1, "x")))):
        with pytest.raises(ValueError):
            metrics.evaluate(a, b)
    scores = metrics.training_scores(spark.createDataFrame([(" ", None), ("a b", "a b")], "p string, l string"), F.col("p"), F.col("l"), lambda t: t).first()
    assert scores.chrf == 100.0


def test_batches_filters_and_shapes(spark):
    rows = spark.createDataFrame([(i, "w " * i) for i in range(10)], "id int, text string")
    got = sorted(map(tuple, corpus.batched(rows, 4, "id").select("id", "batch", "place").collect()))
    assert got == [(i, i // 4, i % 4) for i in range(10)]
    mixed = corpus.batched(rows, 4, "id", seed=3).select("batch", "place").collect()
    assert sorted(map(tuple, mixed)) == [(i // 4, i % 4) for i in range(10)]
    assert sorted(x.id for x in corpus.longer_than(rows, "text", 8).collect()) == [8, 9]
    assert [x.id for x in corpus.first_rows(rows, 3, "id").collect()] == [0, 1, 2]
    seen = contracts.inspect(rows, "id", rows=2)
    assert seen["shape"] == (10, 2) and seen["columns"] == ["id", "text"] and [x["id"] for x in seen["first"]] == [0, 1]
    for share in (0.0, 0.15, 1.0):
        assert sum(x.is_val for x in corpus.hash_split(rows, "id", share).collect()) == math.ceil(10 * share)


def test_translation_of_single_rows_batches_and_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, "one two three four five"), (2, None), (3, "none")], "id int, text string")
    cands = spark.createDataFrame([(1, k, t, s) for k, (t, s) in enumerate([("a b c d e", -2.0), ("a b c d f", -0.1), ("x", -3.0), ("y", -4.0)])] + [(2, 0, None, None)], "id int, cand int, text string, seq_score double")
    got = {x.id: x for x in cascade.translate(rows, cands, similarity=metrics.token_f1).collect()}
    assert got[1].translation == "a b c d f" and got[1].high_confidence and got[1].candidates == ["a b c d e", "a b c d f", "x"]
    assert got[2].translation == "" and got[3].confidence == 0.0 and got[3].candidates == [] and not got[3].high_confidence
    (tmp_path / "in.csv").write_text('transliteration,other\n"first, line",1\n,2\nlast,3\n')
    upper = lambda rows: rows.select("id", F.lit(0).alias("cand"), F.upper("text").alias("text"), F.lit(-0.1).alias("seq_score"))
    out = cascade.translate_csv(spark, str(tmp_path / "in.csv"), upper, similarity=metrics.token_f1).collect()
    assert sorted((x.id, x.translation) for x in out) == [(0, "FIRST, LINE"), (1, ""), (2, "LAST")]


def test_round_trip_records_and_all_scores(spark):
    df = spark.createDataFrame([("a <gap> b ", "a  b"), ("abc", "xyz"), ("", None)], "a string, b string")
    got = [x[0] for x in df.select(metrics.round_trip(F.col("a"), F.col("b"))).collect()]
    assert got[0].lev_similarity == 1.0 and got[0].is_valid and not got[1].is_valid and got[2].score == 1.0 and got[2].roundtrip_text == ""
    cands = spark.createDataFrame([(1, 0, "the king"), (1, 1, "the king gave"), (1, 2, "the king"), (2, 0, "one")], "group int, cand int, text string")
    rows = {(x.group, x.cand): x for x in select.mbr_details(cands).collect()}
    assert rows[1, 0].score == rows[1, 2].score and (rows[1, 0].n_candidates, rows[1, 0].n_unique) == (3, 2) and rows[2, 0].best and rows[2, 0].score == 100.0
    assert sum(x.best for x in rows.values()) == 2


def test_search_with_pruning_equals_scoring_all(spark, tmp_path):
    r = random.Random(9)
    say = lambda: " ".join(r.choices(["um-ma", "a-na", "šarrum", "ma-na", "kaspam", "x", "i-na", "belum", "tuppam"], k=r.randint(1, 9)))
    index = retrieve.build_index(spark.createDataFrame([(i, say(), "") for i in range(120)], "doc int, src string, tgt string"), str(tmp_path / "i"))
    asks = spark.createDataFrame([(i, say()) for i in range(15)], "query int, key string").where("key <> ''")
    from tessella.functions.clean import retrieval_key

    asks = asks.select("query", retrieval_key(F.col("key")).alias("key")).where("key <> ''")
    every = retrieve.similarities(asks, index).select("query", "doc", F.round(0.75 * F.col("char_sim") + 0.2 * F.col("word_sim"), 12).alias("s")).collect()
    want = {}
    for x in sorted(every, key=lambda x: (-round(x.s, 9), x.doc)):
        want.setdefault(x.query, []).append(x.doc)
    got = {}
    for x in sorted(retrieve.nearest(asks, index, top=7).collect(), key=lambda x: (-round(x.combined, 9), x.doc)):
        got.setdefault(x.query, []).append(x.doc)
    assert got == {q: d[:7] for q, d in want.items()}
