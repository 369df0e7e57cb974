"""The library's operators over the driver's tables, and the same results in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import clean as C
from .functions import tables as T
from .functions.arrow import align_monotone, without_loops
from .functions.dialect import S, collapse, collapse_sql, let, strip, strip_sql, sub_sql, text_of, tokens, tokens_sql
from .operators import blend, contracts, corpus, metrics, ngrams, retrieve, select
from .oracles import aligned_sql, corpus_scores_sql, loops_query, repeats_query
from .plans import cascade
from .sources import files, sinks
from .sources.files import dealt, input_bytes, scratch, spread

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def column_query(name: str, rule, sql: str | None = None) -> None:
    """A query that applies a Column rule to all documents."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return dealt(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", rule(F.col("text")).alias("result"))

    QUERIES[name] = run
    if sql:
        ORACLES[name] = f"select doc_id, {sql} as result from documents"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def replace_sql(text: str, table_: dict[str, str]) -> str:
    for old, new in table_.items():
        text = f"replace({text}, {q(old)}, {q(new)})"
    return text


# ---- text rules over documents ----

NOT_WORD = r"[^\p{L}\p{N}_]"


def guarded_sql(text: str, body, gap: str, big: str) -> str:
    held = replace_sql(text, {"<gap>": "", "<big_gap>": ""})
    return replace_sql(body(held), {"": gap, "": big})


def digits_sql(text: str) -> str:
    return f"translate(translate({text}, {q(T.SUBSCRIPTS)}, {q(T.DIGITS)}), {q(T.SUPERSCRIPTS)}, {q(T.DIGITS)})"


def special_sql(text: str) -> str:
    return guarded_sql(text, lambda t: f"translate({t}, {q(T.BAD_OUTPUT)}, '')", " <gap> ", " <big_gap> ")


def decimals_sql(text: str) -> str:
    # (\d+) takes every leading digit, so a 0 never waits for the second rule of a sign
    for pattern, sign in T.DECIMALS:
        text = sub_sql(text, (r"(\d+)" + pattern.replace(r"\b", r"([^\w]|$)"), rf"\1 {sign}\2"))
    return text


def lone_sql(text: str, pattern: str, new: str, flags: str = "g") -> str:
    """A pattern between word boundaries; twice, as neighbours share the character between them."""
    for _ in range(2):
        text = f"regexp_replace({text}, '(^|{NOT_WORD})(?:{pattern})($|{NOT_WORD})', '\\1{new}\\2', '{flags}')"
    return text


def preprocess_sql(text: str) -> str:
    t = sub_sql(sub_sql(text, *T.GAP_RULES), (T.DETERMINATIVE, ""), flags="gi")
    t = collapse_sql(f"translate({digits_sql(t)}, {q(T.SCHOLARLY)}, '')")
    return f"(select {q(T.PREFIX)} || case when length(x) > 800 then substr(x, 1, 800) || ' <big_gap>' else x end from (select {t} as x))"


def cut_sql(text: str, least: int) -> str:
    rfind = lambda c: f"case when contains(x, '{c}') then length(x) - instr(reverse(x), '{c}') else -1 end"
    inner = f"select x, greatest({rfind('.')}, {rfind(',')}) as p from (select {text} as x)"
    return f"(select case when length(x) >= {least} and p > length(x) * 0.5 then regexp_replace(substr(x, 1, p), '{S}+$', '') else x end from ({inner}))"


def key_sql(text: str) -> str:
    t = f"lower({strip_sql(text)})"
    t = sub_sql(t, ("[₀-₉⁰-⁹0-9]", ""), (r"\{([^}]+)\}", r" DET_\1 "), (r"\(([a-z]{1,6})\)", r" DET_\1 "))
    t = replace_sql(f"translate(translate({t}, '[]<>', '    '), 'ʾʿˀˁ''', '')", {"…": " GAP ", "...": " GAP "})
    t = f"translate({lone_sql(t, '[xX]{1,3}', ' GAP ')}, '.+', ' ')"
    return collapse_sql(sub_sql(f"strip_accents({t})", (r"[^a-z0-9\-_ ]+", " ")))


column_query("clean_whitespace", collapse, collapse_sql("text"))
column_query("translate_digits", lambda t: C.normalize_superscripts(C.normalize_subscripts(t)), digits_sql("text"))
column_query("strip_scholarly", C.remove_scholarly, f"translate(text, {q(T.SCHOLARLY)}, '')")
column_query("plain_h", C.plain_h, "translate(text, 'ḫḪ', 'hH')")
column_query("special_chars", C.remove_special, special_sql("text"))
column_query("grammar_annotations", C.remove_grammar, sub_sql("text", (T.GRAMMAR, ""), flags="gi"))
column_query("bracket_content", C.remove_bracketed, guarded_sql("text", lambda t: sub_sql(t, (T.BRACKETED, "")), "<gap>", "<big_gap>"))
column_query("determinatives", C.remove_determinatives, sub_sql("text", (T.DETERMINATIVE, ""), flags="gi"))
column_query("normalize_gaps", C.normalize_gaps, sub_sql("text", *T.GAP_RULES))
column_query("short_gaps", C.short_gaps, sub_sql("text", *T.SHORT_GAP_RULES))
column_query("strict_gaps", C.strict_gaps, strip_sql(sub_sql("case when length(text) > 800 then substr(text, 1, 800) || ' <big_gap>' else text end", *T.STRICT_GAP_RULES)))
column_query("dot_gaps", C.dot_gaps, collapse_sql(sub_sql("text", *T.DOT_GAP_RULES)))
column_query("output_gaps", C.output_gaps, sub_sql(lone_sql(sub_sql("text", (r"\[x\]|\(x\)", "<gap>"), flags="gi"), "[xX]", "<gap>"), *T.OUTPUT_GAP_RULES))
column_query("convert_fractions", C.convert_fractions, replace_sql("text", T.FRACTIONS))
column_query("decimal_fractions", C.decimal_fractions, decimals_sql("text"))
column_query("zero_fraction", C.zero_fractions, sub_sql("text", (r"(^|[^\w])0\s+([¼½¾⅓-⅞])", r"\1\2")))
column_query("unbraced_signs", C.unbraced_signs, sub_sql("text", *T.BRACED_RULES))
column_query("without_notes", C.without_notes, collapse_sql(sub_sql("text", *T.NOTE_RULES)))
column_query("preprocess_pipeline", C.preprocess, preprocess_sql("text"))
column_query("preprocess_any_dots", lambda t: C.preprocess(t, dots="any"), preprocess_sql("text"))
column_query("preprocess_adapter", C.preprocess_adapter, f"{q(T.PREFIX)} || {collapse_sql(digits_sql(sub_sql('text', *T.SHORT_GAP_RULES)))}")
column_query("preprocess_dots", C.preprocess_dots, f"{q(T.PREFIX)} || {collapse_sql(sub_sql('text', *T.DOT_GAP_RULES))}")
column_query("postprocess_digits", C.postprocess_digits, collapse_sql(replace_sql(digits_sql("translate(text, 'ḫḪ', 'hH')"), T.FRACTIONS)))
column_query("strip_big_gaps", lambda t: C.strip_big_gaps(C.normalize_gaps(t)), collapse_sql(f"replace({sub_sql('text', *T.GAP_RULES)}, '<big_gap>', '')"))
column_query("truncate_sentence", C.whole_sentences, cut_sql("text", 200))
column_query("retrieval_key", C.retrieval_key, key_sql("text"))
column_query("sanitize_ascii", C.to_ascii, f"regexp_replace(strip_accents(translate(text, {q(T.DIACRITICS)}, {q(T.DIACRITICS_ASCII)})), '[^\\x00-\\x7f]', ' ', 'g')")


def ascii_sql(text: str) -> str:
    return f"regexp_replace(strip_accents(translate({text}, {q(T.DIACRITICS)}, {q(T.DIACRITICS_ASCII)})), '[^\\x00-\\x7f]', ' ', 'g')"


def plain_sql(text: str) -> str:
    return f"translate({text}, 'ḫḪ', 'hH')"


def gaps_sql(text: str) -> str:
    return sub_sql(lone_sql(sub_sql(text, (r"\[x\]|\(x\)", "<gap>"), flags="gi"), "[xX]", "<gap>"), *T.OUTPUT_GAP_RULES)


def grammar_sql(text: str) -> str:
    return sub_sql(text, (T.GRAMMAR, ""), flags="gi")


def bracketed_sql(text: str, gap: str = "<gap>", big: str = "<big_gap>") -> str:
    return guarded_sql(text, lambda t: sub_sql(t, (T.BRACKETED, "")), gap, big)


def dashes_sql(text: str, again: bool) -> str:
    t = f"regexp_replace({collapse_sql(text)}, '^-+|-+$', '', 'g')"
    return strip_sql(t) if again else t


def zero_sql(text: str) -> str:
    return sub_sql(text, (r"(^|[^\w])0\s+([¼½¾⅓-⅞])", r"\1\2"))


DOCS = "(select doc_id as id, text from documents)"
#: What comes before repeats are taken out, and what comes after, of each pipeline.
TARGET_HEAD = grammar_sql(gaps_sql(digits_sql(plain_sql("text"))))
BEFORE_FULL = zero_sql(decimals_sql(replace_sql(special_sql(bracketed_sql(TARGET_HEAD)), T.FRACTIONS)))
BEFORE_ASCII = replace_sql(special_sql(bracketed_sql(TARGET_HEAD)), T.FRACTIONS)
LOW_DIGITS = f"translate({plain_sql('text')}, {q(T.SUBSCRIPTS)}, {q(T.DIGITS)})"
BEFORE_FOUND = replace_sql(f"translate({bracketed_sql(LOW_DIGITS, '', '')}, {q(T.BAD_OUTPUT)}, '')", T.FRACTIONS)
BEFORE_PLAIN = decimals_sql(special_sql(grammar_sql(gaps_sql(LOW_DIGITS))))


def big_gaps_sql(text: str) -> str:
    return collapse_sql(f"replace({text}, '<big_gap>', '')")


AFTER_FULL = lambda t: dashes_sql(cut_sql(big_gaps_sql(t), 200), True)
AFTER_ASCII = lambda t: collapse_sql(ascii_sql(dashes_sql(cut_sql(big_gaps_sql(t), 201), True)))
AFTER_FOUND = lambda t: collapse_sql(ascii_sql(dashes_sql(t, True)))
AFTER_PLAIN = lambda t: dashes_sql(t, False)


def cleaned_sql(rel: str, before: str, after, loops: bool, empty: str = "") -> str:
    """doc_id, result of a target pipeline for ``rel`` (id, text)."""
    inner = repeats_query(rel, before, after, loops)
    ctes, last = inner.rsplit("\nselect ", 1)
    result = f"case when {collapse_sql('text')} = '' then {q(empty)} else {after('t')} end"
    return f"{ctes}\nselect id as doc_id, {result} as result from fixed join {rel} using (id)"


for _name, _rule, _before, _after, _loops, _empty in (
    ("repeated_phrases", C.remove_repeats, "text", lambda t: t, True, None),
    ("postprocess_pipeline", C.postprocess, BEFORE_FULL, AFTER_FULL, True, ""),
    ("postprocess_ascii", C.postprocess_ascii, BEFORE_ASCII, AFTER_ASCII, True, ""),
    ("postprocess_retrieved", C.postprocess_retrieved, BEFORE_FOUND, AFTER_FOUND, False, ""),
    ("postprocess_plain", C.postprocess_plain, BEFORE_PLAIN, AFTER_PLAIN, False, "hnr"),
):
    column_query(_name, _rule)
    ORACLES[_name] = repeats_query(DOCS, _before, _after, _loops) if _empty is None else cleaned_sql(DOCS, _before, _after, _loops, _empty)

column_query("ngram_loops", without_loops)
ORACLES["ngram_loops"] = loops_query(DOCS)
column_query("word_loops", lambda t: C.remove_repeats(t, loops=False))
ORACLES["word_loops"] = repeats_query(DOCS, "text", lambda t: t, False)


def template_sql(text: str) -> str:
    for marker in T.TEMPLATE_MARKERS:
        text = f"(select case when contains(x, {q(marker)}) then {strip_sql(f'split_part(x, {q(marker)}, 1)')} else x end from (select {text} as x))"
    words = r"(^|[^\p{L}\p{N}_])" + T.SOURCE_WORDS.removeprefix(r"\b")
    kept = f"list_slice(p, 1, coalesce(list_position(list_transform(p, lambda s: regexp_matches(s, '{words}')), true), len(p) + 1) - 1)"
    joined = "case when ends_with(j, '.') then j else j || '.' end"
    cut = f"(select case when regexp_matches(x, '{words}') and len(k) > 0 then (select {joined} from (select array_to_string(k, '. ') as j)) else x end from (select x, {kept} as k from (select x, string_split(x, '.') as p from (select {text} as x))))"
    return f"(select case when length(y) < 10 and length(text) > 50 then null else y end from (select {cut} as y))"


def edited_sql(text: str) -> str:
    for mark in ("Corrected:", "Translation:"):
        text = f"(select case when contains(x, '{mark}') then {strip_sql(f'list_last(string_split(x, {q(mark)}))')} else x end from (select {text} as x))"
    last = "length(regexp_extract(x, '^(.*[.!?])', 1, 's'))"
    return f"(select case when substr(x, length(x), 1) in ('.', '!', '?') or {last} - 1 <= length(x) * 0.5 then x else substr(x, 1, {last}) end from (select {text} as x))"


column_query("template_cut", C.without_template, template_sql("text"))
column_query("edited_answer", C.edited_answer, edited_sql("text"))
column_query("retrieval_key_superscripts", lambda t: C.retrieval_key(t, superscripts=True), key_sql("text").replace("[₀-₉⁰-⁹0-9]", "[₀-₉⁰-⁹0-9¹²³]"))
column_query("default_text", lambda t: C.or_default(F.when(F.length(t) % 2 == 0, t)), "case when length(text) % 2 = 0 and " + collapse_sql("text") + " <> '' then text else 'broken text' end")
column_query("final_cleanup", C.strip_dashes, dashes_sql("text", True))
column_query("gap_marks_deleted", lambda t: F.replace(F.replace(C.normalize_gaps(t), F.lit("<big_gap>"), F.lit("")), F.lit("<gap>"), F.lit("")), f"replace(replace({sub_sql('text', *T.GAP_RULES)}, '<big_gap>', ''), '<gap>', '')")
column_query("refine_prefix", lambda t: C.with_prefix(C.truncate(t, 100), T.REVERSE_PREFIX), f"{q(T.REVERSE_PREFIX)} || case when length(text) > 100 then substr(text, 1, 100) || ' <big_gap>' else text end")
column_query("broken_text", C.is_broken, f"(select starts_with(x, '[...') or len(w) = 0 or (len(list_filter(w, lambda t: regexp_matches(t, '{T.BROKEN_TOKEN}'))) / nullif(len(w), 0) > 0.4 and len(w) < 20) from (select {strip_sql('text')} as x, {tokens_sql('text')} as w))")
column_query("broken_text_adapter", C.is_broken_adapter, f"(select (starts_with(x, '[') and contains(substr(x, 1, 20), '...')) or (len(w) > 3 and len(list_filter(w, lambda t: t in ('x', 'xx', 'xxx', '<gap>', '<big_gap>', '...'))) / greatest(len(w), 1) > 0.4) from (select {strip_sql('text')} as x, {tokens_sql('text')} as w))")
column_query("garbage_output", C.is_garbage, f"(select length(x) < 3 or (len(w) > 5 and len(list_distinct(w)) / greatest(len(w), 1) < 0.3) from (select {strip_sql('text')} as x, {tokens_sql('text')} as w))")
column_query("source_words", lambda t: F.size(C.source_words(t)), f"len(list_filter(regexp_extract_all(regexp_replace(text, '<[\\p{{L}}\\p{{N}}_]+>', '', 'g'), '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '(?i){T.SOURCE_WORD[2:-2]}')))")
column_query("numbers", lambda t: F.array_join(C.numbers(t), ","), r"array_to_string(regexp_extract_all(text, '\p{Nd}+'), ',')")


def entries_sql(table_: dict[str, str]) -> str:
    return "(values " + ", ".join(f"({q(k)}, {q(v)})" for k, v in table_.items()) + ") e(word, value)"


WORDS_SQL = f"(select doc_id, word, count(*) as n from (select doc_id, unnest({tokens_sql('text')}) as word from documents union all select -1, word from {entries_sql(T.DICTIONARY | T.DICTIONARY_ADAPTER)}) group by all)"


@query(f"""select w.doc_id, w.word, w.n, e.value as meaning, a.value as library, b.value as ascii from {WORDS_SQL} w left join {entries_sql(T.DICTIONARY_ADAPTER)} on e.word = w.word
left join {entries_sql(T.DICTIONARY).replace(') e(', ') a(')} on a.word = w.word left join {entries_sql(T.DICTIONARY_ASCII).replace(') e(', ') b(')} on b.word = w.word""")
def short_dictionary(spark, sf_dir):
    """Each different word of each document, and each entry of the dictionaries, as a one-word source."""
    known = spark.createDataFrame([(-1, w) for w in T.DICTIONARY | T.DICTIONARY_ADAPTER], "doc_id long, text string")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # dealt by document, so that its words are counted where it is and aren't shuffled
    texts = dealt(docs.select("doc_id", "text").union(known), input_bytes(docs), "doc_id")
    words = texts.select("doc_id", F.explode(tokens(F.col("text"))).alias("word")).groupBy("doc_id", "word").agg(F.count("*").alias("n"))
    tables = (("meaning", T.DICTIONARY_ADAPTER), ("library", T.DICTIONARY), ("ascii", T.DICTIONARY_ASCII))
    return words.select("doc_id", "word", "n", *[C.dictionary_lookup(F.col("word"), t).alias(name) for name, t in tables])


@query("select 'text' as name, count(*) as n_rows, count(*) filter (text is null) as nulls, round(avg(length(text)), 6) as mean_length, min(length(text)) as min_length, max(length(text)) as max_length from documents")
def length_profile(spark, sf_dir):
    p = contracts.profile(table(spark, sf_dir, "documents"), ["text"])
    return p.select("name", "n_rows", "nulls", F.round("mean_length", 6).alias("mean_length"), F.col("min_length").cast("long").alias("min_length"), F.col("max_length").cast("long").alias("max_length"))


@query("select role as method, count(*) as n, count(*) filter (regexp_matches(text, '[^\\x00-\\x7f]')) as non_ascii, round(count(*) / sum(count(*)) over (), 9) as share from conversations group by role")
def method_counts(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy(F.col("role").alias("method")).agg(F.count("*").alias("n"), F.count_if(F.col("text").rlike(r"[^\x00-\x7f]")).alias("non_ascii"))
    total = c.agg(F.sum("n").alias("total"))
    return c.crossJoin(F.broadcast(total)).select("method", "n", "non_ascii", F.round(F.col("n") / F.col("total"), 9).alias("share"))  # one row


@query("""select min(doc_id) as min_id, max(doc_id) as max_id, count(*) as n_rows, count(*) filter (doc_id is null) as null_ids, count(doc_id) - count(distinct doc_id) as repeated_ids,
count(*) filter (text is null) as null_texts, count(*) filter (text is not null and regexp_matches(text, '^\\s*$')) as blank_texts, count(*) filter (regexp_matches(text, '[^\\x00-\\x7f]')) as non_ascii_texts from documents""")
def output_contract(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    ids = d.agg(F.min("doc_id").alias("min_id"), F.max("doc_id").alias("max_id"))
    return ids.crossJoin(F.broadcast(contracts.expectations(d, "text", "doc_id"))).drop("ok")  # one row each


@query("select * from (values (0, 'doc_id', 'bigint'), (1, 'text', 'string'), (2, 'lang', 'string'), (3, 'source', 'string'), (4, 'n_chars', 'bigint')) v(position, name, type)")
def schema_check(spark, sf_dir):
    return contracts.schema_rows(table(spark, sf_dir, "documents"))


# ---- sentences and pairs ----

PAIRS = """(select conv_id, turn, text as src, tgt from (select *, lead(role) over w as r2, lead(text) over w as tgt from conversations
window w as (partition by conv_id order by turn)) where role = 'user' and r2 = 'assistant')"""


def filled_sql(parts: str) -> str:
    return f"list_filter(list_transform({parts}, lambda p: {strip_sql('p')}), lambda p: p <> '')"


def src_sentences_sql(text: str) -> str:
    return filled_sql(f"regexp_split_to_array(regexp_replace({text}, '([.!?]){S}+', '\\1' || chr(1), 'g'), '[\\x01\\n]+')")


def tgt_sentences_sql(text: str) -> str:
    return filled_sql(f"string_split(regexp_replace({text}, '([.!?]){S}+', '\\1' || chr(1), 'g'), chr(1))")


def _pairs(spark, sf_dir) -> DataFrame:
    return corpus.turn_pairs(table(spark, sf_dir, "conversations"))


@query(f"select conv_id, turn, src, tgt from {PAIRS}")
def parallel_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir)


@query(f"select doc_id, i - 1 as sentence_idx, s[i] as sentence from (select doc_id, s, unnest(range(1, len(s) + 1)) as i from (select doc_id, {src_sentences_sql('text')} as s from documents))")
def sentence_split(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(corpus.source_sentences(F.col("text"))).alias("i", "sentence")).select("doc_id", F.col("i").cast("long").alias("sentence_idx"), "sentence")


LINES = f"list_filter(list_transform(regexp_split_to_array(text, '\\n+'), lambda p: {collapse_sql('p')}), lambda p: p <> '')"


@query(f"""select doc_id, i - 1 as line_idx, s[i] as line from (select doc_id, s, unnest(range(1, len(s) + 1)) as i from (select doc_id,
case when len(l) > 1 then l else {filled_sql(f"regexp_split_to_array({collapse_sql('text')}, ';' || '{S}' || '+')")} end as s from (select doc_id, text, {LINES} as l from documents)))""")
def line_split(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(corpus.source_lines(F.col("text"))).alias("i", "line")).select("doc_id", F.col("i").cast("long").alias("line_idx"), "line")


@query(f"""select conv_id, turn, i as at, coalesce(a[i + 1], '') as src, coalesce(b[i + 1], '') as tgt from (select *, unnest(range(0, greatest(len(a), len(b), 1))) as i
from (select conv_id, turn, {src_sentences_sql('src')} as a, {tgt_sentences_sql('tgt')} as b from {PAIRS}))""")
def sentence_zip_longest(spark, sf_dir):
    z = _pairs(spark, sf_dir).select("conv_id", "turn", F.explode(corpus.zip_longest(corpus.source_sentences(F.col("src")), corpus.target_sentences(F.col("tgt")))).alias("z"))
    return z.select("conv_id", "turn", F.col("z.at").cast("long").alias("at"), "z.src", "z.tgt")


@query(f"""with known as (select d.doc_id, 0 as sentence_idx, coalesce(cast(l.quality as varchar), 'nan') as transliteration, coalesce(cast(l.toxic as varchar), 'nan') as translation
from documents d join labels l on l.doc_id = d.doc_id),
rest as (select doc_id, {src_sentences_sql('text')} as a, {tgt_sentences_sql('text')} as b from documents where doc_id not in (select doc_id from labels))
select doc_id, sentence_idx, transliteration, translation from known union all
select doc_id, i, coalesce(a[i + 1], ''), coalesce(b[i + 1], '') from (select *, unnest(range(0, greatest(len(a), len(b), 1))) as i from rest)""")
def id_join_fallback(spark, sf_dir):
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = corpus.sentence_rows(d, labels, "doc_id", "doc_id", "text", "text", "quality", "quality", "toxic")
    return rows.withColumn("sentence_idx", F.col("sentence_idx").cast("long"))


LINES_SQL = f"list_filter(list_transform(regexp_split_to_array({{0}}, '\\n+'), lambda p: {collapse_sql('p')}), lambda p: p <> '')"


def lines_sql(text: str) -> str:
    whole = filled_sql(f"regexp_split_to_array({collapse_sql(text)}, ';' || '{S}' || '+')")
    lines = LINES_SQL.replace("{0}", text)
    return f"case when len({lines}) > 1 then {lines} else {whole} end"


@query(f"""with recursive units as (select {{'conv_id': conv_id, 'turn': turn}} as id, src, tgt, {lines_sql('src')} as a, {tgt_sentences_sql(collapse_sql('tgt'))} as b from {PAIRS}),
{aligned_sql('units', 'src', 'tgt')},
every as (select src, tgt from aligned union all select src, tgt from units where len(a) = 0 or len(b) = 0) select distinct src, tgt from every where src <> '' and tgt <> ''""")
def align_pairs(spark, sf_dir):
    return corpus.sentence_pairs(_pairs(spark, sf_dir))


# ---- duplicates, memories, unions ----


@query("select text, min(doc_id) as doc_id from documents group by text")
def dedup_first(spark, sf_dir):
    return corpus.dedup_first(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "doc_id")


@query(f"select lang as key, max_by(source, doc_id) as value from documents group by lang")
def dedup_last(spark, sf_dir):
    return corpus.dedup_last(table(spark, sf_dir, "documents"), F.col("lang"), F.col("source"), F.col("doc_id"))


MEMORY = f"""(select {key_sql('src')} as key, max_by(tgt, ord) as value from (select src, tgt, ord from (select src, tgt, {{'c': conv_id, 't': turn}} as ord,
row_number() over (partition by src order by conv_id, turn) as r from {PAIRS}) where r = 1) group by 1 having length(key) > 3)"""


@query(f"select c.conv_id, c.turn, m.value as exact from conversations c left join {MEMORY} m on m.key = {key_sql('c.text')}")
def memory_lookup(spark, sf_dir):
    pairs = _pairs(spark, sf_dir).withColumn("ord", F.struct("conv_id", "turn"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return corpus.memory_lookup(rows, corpus.translation_memory(pairs), C.retrieval_key(F.col("text"))).select("conv_id", "turn", "exact")


NAMES = f"""(select a, max_by(name, o) as name from (select name, min(o) as o, lower(strip_accents(name)) as a from (select {strip_sql('word')} as name, {{'i': item_id, 'k': k}} as o from
(select item_id, unnest({tokens_sql('text')}) as word, unnest(range(0, len({tokens_sql('text')}))) as k from benchmark)) where length(name) >= 3 group by name) where a <> lower(name) and length(a) >= 3 group by a)"""


def _names(spark, sf_dir) -> DataFrame:
    """Words of the benchmark that have diacritics, as names."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(tokens(F.col("text"))).alias("k", "norm"))
    return corpus.name_lexicon(b.select("norm", F.struct("item_id", "k").alias("ord")), kind=None)


@query(f"select a as ascii, name from {NAMES}")
def name_lexicon(spark, sf_dir):
    return _names(spark, sf_dir)


@query(f"""with names as {NAMES}, w as (select doc_id, unnest({tokens_sql('text')}) as word from documents)
select doc_id, count(*) as words, count(names.name) as known from w left join names on names.a = lower(w.word) group by doc_id""")
def lexicon_lookup(spark, sf_dir):
    """How many words of each document are the plain form of a name."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(tokens(F.col("text"))).alias("word"))
    joined = words.join(_names(spark, sf_dir), F.lower("word") == F.col("ascii"), "left")
    return joined.groupBy("doc_id").agg(F.count("*").alias("words"), F.count("name").alias("known"))


FEW_NAMES = {"wordeon": "wördeon", "the": "thé", "la": "là", "des": "dès", "que": "qué", "die": "díe", "und": "ünd"}
_MARKS = r"[.,;:!?()\[\]\"'']"


@query(f"""select doc_id, coalesce(string_agg(case when e.value is null then word else
  case when upper(substr(word, 1, 1)) = substr(word, 1, 1) and lower(substr(word, 1, 1)) <> substr(word, 1, 1) then upper(substr(e.value, 1, 1)) || substr(e.value, 2) else e.value end
  || regexp_extract(word, '({_MARKS}*)$', 1) end, ' ' order by k), '') as result
from (select doc_id, unnest(w) as word, unnest(range(0, len(w))) as k from (select doc_id, {tokens_sql('text')} as w from documents)) x left join {entries_sql(FEW_NAMES).replace('e(word', 'e(plain')}
on e.plain = lower(regexp_replace(word, '^{_MARKS}+|{_MARKS}+$', '', 'g')) group by doc_id""")
def restore_names(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", corpus.restore_names(F.col("text"), FEW_NAMES).alias("result"))


@query("select count(*) as overlap from (select doc_id from documents intersect select doc_id from labels)")
def id_overlap(spark, sf_dir):
    return corpus.overlap_size(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id", "doc_id")


@query(f"select text, count(*) as copies from (select src as text from {PAIRS} union all select text from benchmark, range(3)) group by text")
def weighted_union(spark, sf_dir):
    both = _pairs(spark, sf_dir).select(F.col("src").alias("text")).unionByName(corpus.repeated(table(spark, sf_dir, "benchmark").select("text"), 3))
    return both.groupBy("text").agg(F.count("*").alias("copies"))


@query("""select doc_id, source, row_number() over (order by h desc, doc_id) <= ceil(count(*) over () * 0.2) as is_val
from (select doc_id, source, md5(doc_id || ':42') as h from documents)""")
def hash_split(spark, sf_dir):
    return corpus.hash_split(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", 0.2)


# ---- n-grams and metrics over turn pairs ----


def counts_sql(rel: str, a: str, b: str, keys: str, chars=(1, 2, 3, 4, 5, 6), words=(1, 2)) -> str:
    """Columns keys, kind, n, common, in_a, in_b."""
    parts = []
    for col, ia, ib in ((a, 1, 0), (b, 0, 1)):
        for n in chars:
            parts.append(f"select {keys}, 'char' as kind, {n} as n, unnest(list_transform(range(1, length({col}) - {n} + 2), lambda i: substr({col}, i, {n}))) as gram, {ia} as ia, {ib} as ib from {rel}")
        for n in words:
            parts.append(f"select {keys}, 'word' as kind, {n} as n, unnest(list_transform(range(1, len(t) - {n} + 2), lambda i: array_to_string(list_slice(t, i, i + {n} - 1), chr(1)))) as gram, {ia} as ia, {ib} as ib from (select *, {tokens_sql(col)} as t from {rel})")
    grams = " union all ".join(parts)
    each = f"select {keys}, kind, n, gram, sum(ia) as ia, sum(ib) as ib from ({grams}) group by all"
    return f"(select {keys}, kind, n, sum(least(ia, ib)) as common, sum(ia) as in_a, sum(ib) as in_b from ({each}) group by all)"


F_SQL = "case when p + r > 0 then 5.0 * p * r / (4.0 * p + r) else 0.0 end"
PR_SQL = "coalesce(common / nullif(in_a, 0), 0.0) as p, coalesce(common / nullif(in_b, 0), 0.0) as r"


def chrf_sql(rel: str, a: str, b: str, keys: str) -> str:
    return f"(select {keys}, sum({F_SQL}) / 8 * 100 as chrf from (select *, {PR_SQL} from {counts_sql(rel, a, b, keys)}) group by all)"


def mean_chrf_sql(rel: str, a: str, b: str, keys: str) -> str:
    means = f"select {keys}, sum(p) / 8 as p, sum(r) / 8 as r from (select {keys}, {PR_SQL} from {counts_sql(rel, a, b, keys)}) group by all"
    return f"(select {keys}, {F_SQL} as chrf from ({means}))"


def bleu_sql(rel: str, a: str, b: str, keys: str) -> str:
    counts = counts_sql(rel, a, b, keys, (), (1, 2, 3, 4))
    brevity = f"least(1.0, exp(1 - len({tokens_sql(b)}) / greatest(len({tokens_sql(a)}), 1)))"
    joined = f"select p.*, c.l from (select *, {brevity} as bp from {rel}) p join (select {keys}, sum(ln((common + 1) / (in_a + 1))) / 4 as l from {counts} group by all) c using ({keys})"
    return f"(select {keys}, bp * exp(l) * 100 as bleu from ({joined}))"


KEYS = ("conv_id", "turn")


@query(f"select kind, n, gram, count(*) as cnt from (select 'char' as kind, 3 as n, unnest(list_transform(range(1, length(src) - 1), lambda i: substr(src, i, 3))) as gram from {PAIRS}) group by all")
def char_ngrams(spark, sf_dir):
    return ngrams.gram_rows(_pairs(spark, sf_dir), "src", chars=(3,)).groupBy("kind", "n", "gram").agg(F.count("*").alias("cnt"))


@query(f"select kind, n, gram, count(*) as cnt from (select 'word' as kind, 2 as n, unnest(list_transform(range(1, len(t)), lambda i: t[i] || chr(1) || t[i + 1])) as gram from (select {tokens_sql('text')} as t from documents)) group by all")
def word_ngrams(spark, sf_dir):
    return ngrams.gram_rows(dealt(spark.read.parquet(f"{sf_dir}/documents.parquet")), "text", words=(2,)).groupBy("kind", "n", "gram").agg(F.count("*").alias("cnt"))


@query(f"select conv_id, turn, kind, n, cast(common as bigint) as common, cast(in_a as bigint) as in_a, cast(in_b as bigint) as in_b from {counts_sql(PAIRS, 'src', 'tgt', 'conv_id, turn')}")
def clipped_overlap(spark, sf_dir):
    return ngrams.overlaps(_pairs(spark, sf_dir), "src", "tgt", KEYS, metrics.CHARS, metrics.WORDS)


@query(f"select conv_id, turn, round(chrf, 6) as chrf from {chrf_sql(PAIRS, 'src', 'tgt', 'conv_id, turn')}")
def chrf_mbr(spark, sf_dir):
    return _pairs(spark, sf_dir).select(*KEYS, F.round(metrics.chrf(F.col("src"), F.col("tgt")), 6).alias("chrf"))


@query(f"select conv_id, turn, round(chrf, 6) as chrf from {mean_chrf_sql(PAIRS, 'src', 'tgt', 'conv_id, turn')}")
def chrf_consensus(spark, sf_dir):
    return _pairs(spark, sf_dir).select(*KEYS, F.round(metrics.mean_chrf(F.col("src"), F.col("tgt")), 6).alias("chrf"))


@query(f"select conv_id, turn, round(bleu, 6) as bleu from {bleu_sql(PAIRS, 'src', 'tgt', 'conv_id, turn')}")
def bleu_sentence(spark, sf_dir):
    return _pairs(spark, sf_dir).select(*KEYS, F.round(metrics.bleu(F.col("src"), F.col("tgt")), 6).alias("bleu"))


@query(f"""select conv_id, turn, round(case when bleu <= 0 or chrf <= 0 then 0.0 else sqrt(bleu * chrf) end, 6) as geo_mean
from {bleu_sql(PAIRS, 'src', 'tgt', 'conv_id, turn')} join {chrf_sql(PAIRS, 'src', 'tgt', 'conv_id, turn')} using (conv_id, turn)""")
def geo_mean(spark, sf_dir):
    return _pairs(spark, sf_dir).select(*KEYS, F.round(metrics.bleu_chrf(F.col("src"), F.col("tgt")), 6).alias("geo_mean"))


def f1_sql(a: str, b: str) -> str:
    inner = f"select list_distinct({tokens_sql(f'lower({a})')}) as x, list_distinct({tokens_sql(f'lower({b})')}) as y"
    return f"(select case when len(x) = 0 and len(y) = 0 then 1.0 when len(list_intersect(x, y)) = 0 then 0.0 else 2 * len(list_intersect(x, y)) / (len(x) + len(y)) end from ({inner}))"


@query(f"select conv_id, turn, round({f1_sql('src', 'tgt')}, 6) as f1 from {PAIRS}")
def token_f1(spark, sf_dir):
    return _pairs(spark, sf_dir).select(*KEYS, F.round(metrics.token_f1(F.col("src"), F.col("tgt")), 6).alias("f1"))


@query()
def combined_similarity(spark, sf_dir):
    a, b = F.col("src"), F.col("tgt")
    return _pairs(spark, sf_dir).select(*KEYS, F.round(metrics.combined_similarity(a, b), 6).alias("combined"), F.round(metrics.round_trip_similarity(a, b), 6).alias("round_trip"))


@query(corpus_scores_sql(f"select turn, tgt as h, src as r from {PAIRS}", "turn"))
def corpus_scores(spark, sf_dir):
    """Assistant turns against the user turns before them, by place in the conversation."""
    p = _pairs(spark, sf_dir)
    return metrics.corpus_scores(p, "tgt", "src", ("turn",))


# ---- candidates: the assistant turns of a conversation ----

CANDS = "(select conv_id as grp, turn as cand, text, -0.1 * (row_number() over (partition by conv_id order by turn) - 1) as seq_score from conversations where role = 'assistant')"


def _cands(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    rank = F.row_number().over(W.partitionBy("conv_id").orderBy("turn")) - 1
    return c.select(F.col("conv_id").alias("group"), F.col("turn").alias("cand"), "text", (rank * -0.1).alias("seq_score"))


def utility_sql(rel: str, keys: str, name: str) -> str:
    """keys, u: a utility of pairs (a, b)."""
    if name == "chrf":
        return f"(select {keys}, chrf as u from {chrf_sql(rel, 'a', 'b', keys)})"
    if name == "bleu":
        return f"(select {keys}, bleu as u from {bleu_sql(rel, 'a', 'b', keys)})"
    if name == "f1":
        return f"(select {keys}, {f1_sql('a', 'b')} as u from {rel})"
    return f"(select {keys}, case when bleu <= 0 or chrf <= 0 then 0.0 else sqrt(bleu * chrf) end as u from {bleu_sql(rel, 'a', 'b', keys)} join {chrf_sql(rel, 'a', 'b', keys)} using ({keys}))"


def mbr_sql(weight: str, utility: str = "chrf", details: bool = False) -> str:
    unique = f"(select grp, text, min(cand) as cand, sum({weight}) as weight, sum(count(*)) over (partition by grp) as n from {CANDS} group by grp, text)"
    pairs = "(select a.grp, a.cand as i, b.cand as j, a.text as a, b.text as b, b.weight as w from uniq a join uniq b on a.grp = b.grp and a.cand <> b.cand)"
    scored = f"(select grp, i, sum(w * u) / sum(w) as s from {utility_sql('pairs', 'grp, i, j, w', utility)} group by all)"
    ranked = "select u.grp, u.cand, case when u.n = 1 then 100.0 else coalesce(s.s, 0.0) end as score from uniq u left join scored s on s.grp = u.grp and s.i = u.cand"
    ctes = f"with uniq as {unique}, pairs as {pairs}, scored as {scored}, ranked as (select *, row_number() over (partition by grp order by round(score, 9) desc, cand) as r from ({ranked}))"
    if details:
        return f"""{ctes} select c.grp as "group", c.cand, round(r.score, 6) as score, count(*) over (partition by c.grp) as n_candidates, (select count(*) from uniq x where x.grp = c.grp) as n_unique, c.cand = r.cand and r.r = 1 as best
from {CANDS} c join uniq u on u.grp = c.grp and u.text = c.text join ranked r on r.grp = c.grp and r.cand = u.cand"""
    return f'{ctes} select grp as "group", cand, round(score, 6) as score from ranked where r = 1'


@query(mbr_sql("1"))
def mbr_select(spark, sf_dir):
    return select.mbr_select(_cands(spark, sf_dir)).select("group", "cand", F.round("score", 6).alias("score"))


@query(mbr_sql("exp(seq_score)"))
def mbr_weighted(spark, sf_dir):
    c = _cands(spark, sf_dir).withColumn("w", F.exp("seq_score"))
    return select.mbr_select(c, weight="w").select("group", "cand", F.round("score", 6).alias("score"))


@query(mbr_sql("1", "bleu"))
def mbr_bleu(spark, sf_dir):
    return select.mbr_select(_cands(spark, sf_dir), "bleu").select("group", "cand", F.round("score", 6).alias("score"))


@query(mbr_sql("1", "geo_mean"))
def mbr_geo_mean(spark, sf_dir):
    return select.mbr_select(_cands(spark, sf_dir), "geo_mean").select("group", "cand", F.round("score", 6).alias("score"))


@query(mbr_sql("1", "f1"))
def mbr_callable(spark, sf_dir):
    """A utility that the caller brings."""
    return select.mbr_select(_cands(spark, sf_dir), metrics.token_f1).select("group", "cand", F.round("score", 6).alias("score"))


@query(mbr_sql("1", details=True))
def mbr_details(spark, sf_dir):
    return select.mbr_details(_cands(spark, sf_dir)).select("group", "cand", F.round("score", 6).alias("score"), "n_candidates", "n_unique", "best")


STRIPPED = strip_sql("text")
USERS = "(select conv_id as grp, turn, text from conversations where role = 'user')"


@query(f"""with uniq as (select grp, {STRIPPED} as text, min(cand) as cand, count(*) as n from {CANDS} where {STRIPPED} <> '' group by 1, 2),
pairs as (select a.grp, a.cand as i, b.cand as j, a.text as a, b.text as b from uniq a join uniq b on a.grp = b.grp and a.cand <> b.cand),
inn as (select grp, i, avg(chrf) as s from {mean_chrf_sql('pairs', 'a', 'b', 'grp, i, j')} group by all),
refs as (select u.grp, u.cand as i, r.turn as j, u.text as a, r.text as b from uniq u join {USERS} r on r.grp = u.grp),
outr as (select grp, i, avg(chrf) as s from {mean_chrf_sql('refs', 'a', 'b', 'grp, i, j')} group by all),
has as (select distinct grp from {USERS}),
ranked as (select u.grp, u.cand, case when has.grp is null then coalesce(inn.s, 0) else 0.7 * coalesce(inn.s, 0) + 0.3 * coalesce(outr.s, 0) end as score from uniq u
left join inn on inn.grp = u.grp and inn.i = u.cand left join outr on outr.grp = u.grp and outr.i = u.cand left join has on has.grp = u.grp)
select grp as "group", cand, round(score, 6) as score from (select *, row_number() over (partition by grp order by round(score, 9) desc, cand) as r from ranked) where r = 1""")
def consensus_select(spark, sf_dir):
    refs = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.col("conv_id").alias("group"), F.col("text").alias("ref_text"), F.lit(1.0).alias("ref_weight"))
    return select.consensus_select(_cands(spark, sf_dir), refs).select("group", "cand", F.round("score", 6).alias("score"))


def consistency_sql(cands: str) -> str:
    rows = f"(select *, row_number() over (partition by grp order by cand) - 1 as pos from {cands})"
    sims = f"(select a.grp, a.pos as i, b.pos as j, {f1_sql('a.text', 'b.text')} as sim from rws a join rws b on a.grp = b.grp and a.pos < b.pos)"
    votes = f"(select grp, count(*) filter (c > 1) / count(*) as vote from (select grp, word, count(*) as c from (select grp, unnest(list_distinct({tokens_sql('lower(text)')})) as word from rws) group by all) group by grp)"
    best = "(select grp, avg(sim) as a, arg_max((i, j, sim), (round(sim, 12), -i, -j)) as b from sims group by grp)"
    return f"""with rws as {rows}, sims as {sims}, votes as {votes}, best as {best}, sizes as (select grp, count(*) as n from rws group by grp)
select s.grp, s.n, case when s.n < 2 then 0.5 else best.a end as avg_similarity, case when s.n < 2 then 0.5 else coalesce(vote, 0.5) end as voting,
case when s.n < 2 then 0.5 else least(1.0, 0.6 * best.a + 0.4 * coalesce(vote, 0.5)) end as consistency from sizes s left join best on best.grp = s.grp left join votes on votes.grp = s.grp"""


@query(f'select grp as "group", n, round(avg_similarity, 6) as avg_similarity, round(voting, 6) as voting, round(consistency, 6) as consistency from ({consistency_sql(CANDS)})')
def candidate_consistency(spark, sf_dir):
    c = select.consistency(_cands(spark, sf_dir), metrics.token_f1)
    return c.select("group", "n", *[F.round(x, 6).alias(x) for x in ("avg_similarity", "voting", "consistency")])


@query()
def candidate_consistency_full(spark, sf_dir):
    c = select.consistency(_cands(spark, sf_dir))
    return c.select("group", "n", "best_i", "best_j", *[F.round(x, 6).alias(x) for x in ("avg_similarity", "voting", "best_similarity", "consistency")])


def fit_sql(share: str) -> str:
    return f"case when {share} between 0.8 and 1.5 then 1.0 when {share} between 0.5 and 2.0 then 0.8 else 0.5 end"


N_SQL = f"len({tokens_sql('text')})"
SRC_N = f"(select conv_id as grp, min_by(text, turn) as source from conversations where role = 'user' group by 1)"


@query(f"""with c as (select c.*, coalesce(u.source, '') as source, exp(seq_score * 5) as conf from {CANDS} c left join {SRC_N} u on u.grp = c.grp),
low as (select grp, consistency from ({consistency_sql("(select * from c where conf < 0.5)")})),
s as (select c.grp, c.cand, conf, 0.4 * conf + 0.3 * case when conf >= 0.5 then 1.0 else 0.3 * conf + 0.7 * low.consistency end
+ 0.2 * case when {N_SQL} between 5 and 20 then 1.0 when {N_SQL} between 3 and 25 then 0.8 else 0.5 end + 0.1 * {fit_sql(f"({N_SQL} / greatest(1, len({tokens_sql('source')})))")} as score
from c left join low on low.grp = c.grp),
r as (select *, row_number() over (partition by grp order by round(score, 9) desc, cand) as r, count(*) filter (conf >= 0.5) over (partition by grp) as high from s)
select grp as "group", cand, round(score, 6) as score, high as high_confidence_count, high > 0 or score >= 0.7 as high_confidence from r where r = 1""")
def confidence_filter(spark, sf_dir):
    users = table(spark, sf_dir, "conversations").where("role = 'user'").groupBy(F.col("conv_id").alias("g")).agg(F.min_by("text", "turn").alias("source"))
    c = _cands(spark, sf_dir).withColumn("seq_score", F.col("seq_score") * 5).join(users, F.col("group") == F.col("g"), "left").drop("g")
    out = select.confidence_select(c, 0.5, metrics.token_f1)
    return out.select("group", "cand", F.round("score", 6).alias("score"), "high_confidence_count", "high_confidence")


def scores_sql(confidence: str, weights: dict[str, float]) -> str:
    """The weighted score of a candidate (text, source) whose consistency is not known."""
    parts = {"confidence": confidence, "consistency": "0.5", "fluency": f"case when {N_SQL} between 5 and 20 then 1.0 when {N_SQL} between 3 and 25 then 0.8 else 0.5 end", "length": fit_sql(f"({N_SQL} / greatest(1, len({tokens_sql('source')})))")}
    return " + ".join(f"{w / sum(weights.values())} * ({parts[k]})" for k, w in weights.items())


def _with_source(spark, sf_dir) -> DataFrame:
    users = table(spark, sf_dir, "conversations").where("role = 'user'").groupBy(F.col("conv_id").alias("g")).agg(F.min_by("text", "turn").alias("source"))
    return _cands(spark, sf_dir).join(users, F.col("group") == F.col("g"), "left").drop("g")


def best_sql(weights: dict[str, float]) -> str:
    return f"""with s as (select c.grp, c.cand, {scores_sql('exp(seq_score)', weights)} as score from (select c.*, coalesce(u.source, '') as source from {CANDS} c left join {SRC_N} u on u.grp = c.grp) c)
select grp as "group", cand, round(score, 6) as score from (select *, row_number() over (partition by grp order by round(score, 9) desc, cand) as r from s) where r = 1"""


OWN_WEIGHTS = {"confidence": 0.1, "fluency": 0.6, "length": 0.5}


@query(best_sql(select.WEIGHTS))
def select_best(spark, sf_dir):
    return select.select_best(_with_source(spark, sf_dir)).select("group", "cand", F.round("score", 6).alias("score"))


@query(best_sql(OWN_WEIGHTS))
def select_best_own_weights(spark, sf_dir):
    return select.select_best(_with_source(spark, sf_dir), OWN_WEIGHTS).select("group", "cand", F.round("score", 6).alias("score"))


@query(f"""select doc_id, unnest(case when len(k) > 0 then k else [''] end) as cand from (select doc_id, list_filter(string_split(text, chr(10)), lambda c: {strip_sql('c')} <> '') as k from documents)""")
def non_blank(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(select.non_blank(F.split("text", "\n", -1))).alias("cand"))


@query(f"""with top as (select * from (select *, row_number() over (partition by grp order by seq_score desc, cand desc) as r from {CANDS}) where r <= 3),
w as (select grp, word, count(*) as n, min((-r, i)) as first from (select grp, r, t[i] as word, i from (select grp, r, t, unnest(range(1, len(t) + 1)) as i from (select grp, r, {tokens_sql('text')} as t from top))) group by all),
v as (select *, row_number() over (partition by grp order by n desc, first) as k from w)
select grp as "group", string_agg(word, ' ' order by k) as text from v where k <= 5 group by grp""")
def top_k_voting(spark, sf_dir):
    return select.top_words(_cands(spark, sf_dir))


@query(f"""select grp as "group", cand, text from (select *, row_number() over (partition by grp order by -ln((cast('0x' || substr(md5(grp || ':' || cand || ':42'), 1, 12) as bigint) + 1) / (281474976710656.0 + 1)) / exp(seq_score), cand) as r from {CANDS}) where r = 1""")
def weighted_choice(spark, sf_dir):
    return select.weighted_choice(_cands(spark, sf_dir).withColumn("score", F.exp("seq_score")))


@query(f'select grp as "group", min(cand) as cand from {CANDS} group by grp')
def best_model(spark, sf_dir):
    return select.best_model(_cands(spark, sf_dir)).select("group", "cand")


# ---- retrieval: benchmark items against user turns ----

CORPUS = f"(select {{'conv_id': conv_id, 'turn': turn}} as doc, src, tgt, {key_sql('src')} as key from {PAIRS})"
ITEMS = f"(select item_id as query, {key_sql('text')} as key from benchmark)"


def grams_sql(rel: str, id: str) -> str:
    chars = " union all ".join(f"select {id}, 'char' as space, unnest(list_transform(range(1, greatest(length(w) - {n} + 2, 1)), lambda i: substr(w, i, {n}))) as gram from w_{id} {'where length(w) >= ' + str(n)}" for n in (3, 4, 5, 6))
    words = f"select {id}, 'word' as space, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) as gram from (select {id}, list_filter(regexp_extract_all(key, '[a-z0-9_]+'), lambda x: length(x) >= 2) as t from {rel})"
    return f"(with w_{id} as (select {id}, ' ' || unnest({tokens_sql('key')}) || ' ' as w from {rel}) select {id}, space, gram, count(*) as tf from ({chars} union all {words}) group by all)"


TFIDF = f"""corp as {CORPUS}, items as {ITEMS}, dg as {grams_sql('corp', 'doc')}, qg as {grams_sql('items', 'query')},
idf as (select space, gram, ln((1 + (select count(*) from corp)) / (1 + count(*))) + 1 as idf from dg group by all),
dw as (select doc, space, gram, tf * idf / sqrt(sum(tf * idf * tf * idf) over (partition by doc, space)) as w from dg join idf using (space, gram)),
qw as (select query, space, gram, tf * idf / sqrt(sum(tf * idf * tf * idf) over (partition by query, space)) as w from qg join idf using (space, gram)),
sims as (select query, doc, sum(case when space = 'char' then qw.w * dw.w else 0 end) as char_sim, sum(case when space = 'word' then qw.w * dw.w else 0 end) as word_sim from qw join dw using (space, gram) group by all)"""


def _index(spark, sf_dir) -> retrieve.Index:
    pairs = _pairs(spark, sf_dir).select(F.struct("conv_id", "turn").alias("doc"), "src", "tgt")
    return retrieve.build_index(pairs, scratch(spark, "index"))


def _items(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), "text")


@query(f"with {TFIDF} select query, doc.conv_id as conv_id, doc.turn as turn, round(char_sim, 6) as char_sim, round(word_sim, 6) as word_sim from sims")
def tfidf_similarity(spark, sf_dir):
    items = _items(spark, sf_dir).select("query", C.retrieval_key(F.col("text")).alias("key"))
    s = retrieve.similarities(items, _index(spark, sf_dir))
    return s.select("query", "doc.conv_id", "doc.turn", F.round("char_sim", 6).alias("char_sim"), F.round("word_sim", 6).alias("word_sim"))


@query(f"""with {TFIDF}, near as (select query, doc, round(0.75 * char_sim + 0.20 * word_sim, 12) as combined from sims qualify row_number() over (partition by query order by combined desc, doc) <= 60),
sc as (select n.query, n.doc, n.combined, round(n.combined * exp(-abs(ln(len({tokens_sql('c.key')}) / greatest(1, len({tokens_sql('i.key')})) + 1e-5)) * 0.3), 12) as score from near n join corp c using (doc) join items i using (query))
select query, doc.conv_id as conv_id, doc.turn as turn, round(combined, 6) as combined, round(score, 6) as score, row_number() over (partition by query order by score desc, doc) as rank from sc qualify rank <= 10""")
def retrieve_topk(spark, sf_dir):
    top = retrieve.top_matches(_items(spark, sf_dir), _index(spark, sf_dir))
    return top.select("query", "doc.conv_id", "doc.turn", F.round("combined", 6).alias("combined"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query()
def retrieve_reranked(spark, sf_dir):
    out = retrieve.retrieve(_items(spark, sf_dir), _index(spark, sf_dir))
    return out.select("query", "doc.conv_id", "doc.turn", "translation", "score")


# ---- cascades and grids: user turn as source, assistant turn as model text, the next pair's as retrieved ----

HYBRID = f"(select p.conv_id, p.turn, p.src as source, p.tgt as model, b.text as found, (p.conv_id % 10) / 10.0 as score, p.src as reference from {PAIRS} p left join benchmark b on b.item_id = (p.conv_id * 31 + p.turn) % (select max(item_id) + 1 from benchmark))"


def _hybrid(spark, sf_dir) -> DataFrame:
    """Columns sample_id (a struct), source, model, found, score, reference; the benchmark stands for what a search found, dealt by number."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("b"), F.col("text").alias("found"))
    n = table(spark, sf_dir, "benchmark").agg((F.max("item_id") + 1).alias("n"))
    pairs = dealt(_pairs(spark, sf_dir), input_bytes(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    keyed = pairs.crossJoin(F.broadcast(n)).withColumn("k", (F.col("conv_id") * 31 + F.col("turn")) % F.col("n"))  # one row
    return keyed.join(b, F.col("k") == F.col("b"), "left").select(F.struct("conv_id", "turn").alias("sample_id"), F.col("src").alias("source"), F.col("tgt").alias("model"), "found", ((F.col("conv_id") % 10) / 10.0).alias("score"), F.col("src").alias("reference"))


def _named(df: DataFrame) -> DataFrame:
    return df.select("sample_id.conv_id", "sample_id.turn", *[c for c in df.columns if c != "sample_id"])


@query(f"select 'E>' || t as pattern, conv_id, turn, case when score > cast(t as double) and coalesce(found, '') <> '' then found else model end as prediction, reference from {HYBRID}, (values ('0.3'), ('0.5'), ('0.7')) g(t)")
def hybrid_threshold_grid(spark, sf_dir):
    return _named(cascade.hybrid_grid(_hybrid(spark, sf_dir), [0.3, 0.5, 0.7]))


@query(f"""with h as (select *, least(length(model), 350) as n from {HYBRID}), c as (select *, list_min(list_transform(list_filter(range(0, length(found)), lambda i: substr(found, i + 1, 1) = ' '), lambda i: (abs(i - n), i))) as cut from h)
select conv_id, turn, case when length(source) >= 128 and coalesce(found, '') <> '' and length(found) > length(model) and cut is not null then substr(model, 1, 350) || substr(found, cut[2] + 1) else model end as prediction from c""")
def tail_hybrid(spark, sf_dir):
    h = _hybrid(spark, sf_dir)
    return h.select("sample_id.conv_id", "sample_id.turn", cascade.tail_hybrid(F.col("source"), F.col("model"), F.col("found"), 128).alias("prediction"))


def capped_sql(rel: str, keys: str, text: str, most: str) -> str:
    words = f"select {keys}, w[i] as w, i, sum(length(w[i]) + 1) over (partition by {keys} order by i) as upto, most from (select *, unnest(range(1, len(w) + 1)) as i from (select *, {tokens_sql(text)} as w, {most} as most from {rel}))"
    kept = f"select {keys}, string_agg(w, ' ' order by i) as cut from ({words}) where i = 1 or upto <= most group by all"
    return f"(select r.*, case when length({text}) <= {most} then {text} else coalesce(k.cut, '') end as result from {rel} r left join ({kept}) k using ({keys}))"


@query(f"select conv_id, turn, result from {capped_sql(PAIRS, 'conv_id, turn', 'tgt', 'greatest(cast(floor(length(src) * 0.5 + 30) as int), 100)')}")
def cap_length(spark, sf_dir):
    return _pairs(spark, sf_dir).select(*KEYS, C.cap_length(F.col("tgt"), F.col("src")).alias("result"))


def broken_sql(text: str) -> str:
    return ORACLES["broken_text"].split("select doc_id, ", 1)[1].rsplit(" as result", 1)[0].replace("text", text)


def word_sql(text: str, entries: dict[str, str]) -> str:
    """The entry of a one-word text, else NULL."""
    return f"(select case when len(w) = 1 then (select e.value from {entries_sql(entries)} where e.word = w[1]) end from (select {tokens_sql(text)} as w))"


#: Pairs as rows with one id.
ROWS = f"(select {{'conv_id': conv_id, 'turn': turn}} as id, model as text, source, coalesce(found, '') as found from {HYBRID})"
FOUND = f"(select {{'conv_id': conv_id, 'turn': turn}} as id, coalesce(found, '') as text, source, model from {HYBRID})"


def pipeline_sql(rel: str, cleaned: str, result: str) -> str:
    """conv_id, turn, result where ``cleaned`` is doc_id, result of a target pipeline and ``result`` SQL over c (cleaned), source and text."""
    ctes, last = cleaned.rsplit("\nselect ", 1)
    return f"{ctes},\nclean as (select {last})\nselect id.conv_id as conv_id, id.turn as turn, {result} as result from (select r.*, x.result as c from {rel} r join clean x on x.doc_id = r.id)"


def cap_sql(text: str, most: str) -> str:
    """Whole words within ``most``, by folding sizes over the words: the number of words that stay."""
    words = tokens_sql("x")
    n = "list_reduce(list_concat([{'n': 0, 'size': 0}], list_transform(w, lambda v: {'n': 1, 'size': length(v) + 1})), lambda a, v: case when a.size + v.size > m and a.size > 0 then {'n': a.n, 'size': 1000000000} else {'n': a.n + 1, 'size': a.size + v.size} end).n"
    return f"(select case when length(x) <= m then x else array_to_string(list_slice(w, 1, {n}), ' ') end from (select x, m, {words} as w from (select {text} as x, {most} as m)))"


HALF = "cast(floor(length(source) * 0.5 + 30) as int)"


@query(pipeline_sql(ROWS, cleaned_sql(ROWS, BEFORE_FULL, AFTER_FULL, True), f"coalesce({word_sql('source', T.DICTIONARY)}, case when {broken_sql('source')} then '...' end, {cap_sql('c', f'greatest({HALF}, 100)')})"))
def cascade_library(spark, sf_dir):
    return _named(_hybrid(spark, sf_dir).select("sample_id", cascade.model_cascade(F.col("source"), F.col("model")).alias("result")))


@query(pipeline_sql(ROWS, cleaned_sql(ROWS, BEFORE_PLAIN, AFTER_PLAIN, False, "hnr"), big_gaps_sql("c")))
def cascade_plain(spark, sf_dir):
    return _named(_hybrid(spark, sf_dir).select("sample_id", cascade.plain_pipeline(F.col("model")).alias("result")))


ADAPTED = dashes_sql(f"replace(replace(translate(model, {q(T.BAD_OUTPUT)}, ''), '<big_gap>', ''), '<gap>', '')", False)
ADAPTED_BROKEN = ORACLES["broken_text_adapter"].split("select doc_id, ", 1)[1].rsplit(" as result", 1)[0].replace("text", "source")


@query(f"select conv_id, turn, coalesce({word_sql('source', T.DICTIONARY_ADAPTER)}, case when {ADAPTED_BROKEN} then '...' end, {cap_sql(ADAPTED, HALF)}) as result from {HYBRID}")
def cascade_adapter(spark, sf_dir):
    return _named(_hybrid(spark, sf_dir).select("sample_id", cascade.adapter_cascade(F.col("source"), F.col("model")).alias("result")))


FOUND_FIRST = f"(select id, coalesce({word_sql('source', T.DICTIONARY_ASCII)}, text) as text from {FOUND})"


@query(pipeline_sql(FOUND_FIRST, cleaned_sql(FOUND_FIRST, BEFORE_FOUND, AFTER_FOUND, False), f"case when {collapse_sql('c')} = '' then 'broken text' else c end"))
def cascade_retrieval(spark, sf_dir):
    return _named(_hybrid(spark, sf_dir).select("sample_id", cascade.retrieval_only_cascade(F.col("source"), F.col("found")).alias("result")))


@query(f"select conv_id, turn, coalesce({word_sql('source', T.DICTIONARY)}, case when {broken_sql('source')} then '...' end, found, '') as result from {HYBRID}")
def cascade_search(spark, sf_dir):
    return _named(_hybrid(spark, sf_dir).select("sample_id", cascade.retrieval_cascade(F.col("source"), F.col("found")).alias("result")))


SECOND = f"""case when length({strip_sql('text')}) > 3 and c <> '' and not (length({strip_sql('c')}) < 3 or (len({tokens_sql('c')}) > 5 and len(list_distinct({tokens_sql('c')})) / greatest(len({tokens_sql('c')}), 1) < 0.3))
and (len({tokens_sql('c')}) >= 0.4 * len({tokens_sql('model')}) or len({tokens_sql('model')}) < 5) then c else model end"""


@query(pipeline_sql(FOUND, cleaned_sql(FOUND, BEFORE_ASCII, AFTER_ASCII, True), f"(select case when y = '' then 'broken text' else y end from (select {collapse_sql(ascii_sql(SECOND))} as y))"))
def cascade_refined(spark, sf_dir):
    return _named(_hybrid(spark, sf_dir).select("sample_id", cascade.refined(F.col("model"), F.col("found")).alias("result")))


CAPS = [(s, p) for s in (0.3, 0.4, 0.5, 0.6, 0.7, 0.8) for p in (20, 30, 40, 50)]
CAP_TABLE = ", ".join(f"({s}, {p})" for s, p in CAPS)


@query(f"""{cleaned_sql(ROWS, BEFORE_FULL, AFTER_FULL, True).rsplit(chr(10) + "select ", 1)[0]},
clean as (select {cleaned_sql(ROWS, BEFORE_FULL, AFTER_FULL, True).rsplit(chr(10) + "select ", 1)[1]}),
base2 as (select id, source, result as c from {ROWS} join clean on doc_id = id)
select id.conv_id as conv_id, id.turn as turn, cast(share as double) as share, cast(plus as int) as plus, (select case when {collapse_sql('y')} = '' then '' else y end from (select {cap_sql('c', 'cast(floor(length(source) * share + plus) as int)')} as y)) as prediction
from base2, (values {CAP_TABLE}) g(share, plus) union all select id.conv_id, id.turn, -1.0, -1, case when {collapse_sql('c')} = '' then '' else c end from base2""")
def cap_grid_texts(spark, sf_dir):
    return _named(cascade.cap_grid(_hybrid(spark, sf_dir), [0.3, 0.4, 0.5, 0.6, 0.7, 0.8], [20, 30, 40, 50]).drop("reference").fillna(-1, ["share", "plus"]))


GRID = f"select 'E>' || t as pattern, case when score > cast(t as double) and coalesce(found, '') <> '' then found else model end as h, reference as r from {HYBRID}, (values ('0.3'), ('0.5'), ('0.7')) g(t)"


@query(f"select * from ({corpus_scores_sql(GRID, 'pattern')}) order by geo_mean desc, pattern limit 1")
def grid_best(spark, sf_dir):
    scores = metrics.corpus_scores(cascade.hybrid_grid(_hybrid(spark, sf_dir), [0.3, 0.5, 0.7]), "prediction", "reference", ("pattern",))
    return cascade.grid_best(scores, ["pattern"])


def tail_sql(least: int) -> str:
    inner = f"select *, least(length(model), 350) as n from {HYBRID}"
    cut = "list_min(list_transform(list_filter(range(0, length(found)), lambda i: substr(found, i + 1, 1) = ' '), lambda i: (abs(i - n), i)))"
    return f"select 'F>={least}' as pattern, conv_id, turn, case when length(source) >= {least} and coalesce(found, '') <> '' and length(found) > length(model) and cut is not null then substr(model, 1, 350) || substr(found, cut[2] + 1) else model end as h, reference as r from (select *, {cut} as cut from ({inner}))"


PATTERNS = f"""select 'A' as pattern, conv_id, turn, model as h, reference as r from {HYBRID} union all
select 'D', conv_id, turn, coalesce({word_sql('source', T.DICTIONARY)}, case when {broken_sql('source')} then '...' end, found, ''), reference from {HYBRID} union all
select 'E>' || t, conv_id, turn, case when score > cast(t as double) and coalesce(found, '') <> '' then found else model end, reference from {HYBRID}, (values ('0.3'), ('0.5'), ('0.7')) g(t)
union all {tail_sql(128)} union all {tail_sql(256)} union all {tail_sql(512)}"""
CHANGED = f"(select p.pattern, count(*) filter (p.h is distinct from b.h) as changed from ({PATTERNS}) p left join ({PATTERNS}) b on b.pattern = 'A' and b.conv_id = p.conv_id and b.turn = p.turn group by p.pattern)"


@query()
def cap_grid(spark, sf_dir):
    grid = cascade.cap_grid(_hybrid(spark, sf_dir), [0.3, 0.4, 0.5, 0.6, 0.7, 0.8], [20, 30, 40, 50])
    named = grid.withColumn("pattern", F.concat_ws("/", F.coalesce(F.col("share").cast("string"), F.lit("none")), F.coalesce(F.col("plus").cast("string"), F.lit("none"))))
    return metrics.corpus_scores(named, "prediction", "reference", ("pattern",))


@query(f"select s.*, c.changed from ({corpus_scores_sql(f'select pattern, h, r from ({PATTERNS})', 'pattern')}) s join {CHANGED} c using (pattern)")
def pattern_report(spark, sf_dir):
    h = _hybrid(spark, sf_dir)
    # all patterns of a row follow each other, as scores count a text once then
    found = {"A": F.col("model"), "D": cascade.retrieval_cascade(F.col("source"), F.col("found"))}
    found |= {f"E>{t}": cascade.threshold_hybrid(F.col("found"), F.col("score"), F.col("model"), t) for t in (0.3, 0.5, 0.7)}
    found |= {f"F>={n}": cascade.tail_hybrid(F.col("source"), F.col("model"), F.col("found"), n) for n in (128, 256, 512)}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("pattern"), v.alias("prediction")) for k, v in found.items()])).alias("p")
    patterns = h.select("sample_id", "reference", each).select("p.pattern", "sample_id", "p.prediction", "reference")
    return cascade.pattern_report(patterns, "A")


@query()
def model_cascade(spark, sf_dir):
    h = _hybrid(spark, sf_dir)
    s, m = F.col("source"), F.col("model")
    return h.select("sample_id.conv_id", "sample_id.turn", cascade.model_cascade(s, m).alias("library"), cascade.adapter_cascade(s, m).alias("adapter"), cascade.retrieval_only_cascade(s, F.col("found")).alias("retrieval"), cascade.plain_pipeline(m).alias("plain"), cascade.edit_cascade(s, m, F.col("found"), {"die": ["the"], "la": ["the"]}).alias("edited"), cascade.refined(m, F.col("found")).alias("refined"))


@query()
def cascade_tier1(spark, sf_dir):
    h = _hybrid(spark, sf_dir)
    rows = h.select("sample_id", "source", "found", F.col("score").alias("found_score"))
    cands = h.select("sample_id", F.lit(0).alias("cand"), F.col("model").alias("text")).union(h.select("sample_id", F.lit(1), F.col("source")))
    pairs = _pairs(spark, sf_dir).withColumn("ord", F.struct("conv_id", "turn"))
    return _named(cascade.first_tier(rows, cands, corpus.translation_memory(pairs), C.retrieval_key))


@query("select w as width from (select coalesce(max(w), 1) as w from (values (1, 11), (2, 15), (4, 25), (8, 50)) v(w, c) where c * (select count(*) from benchmark) < 24000)")
def adaptive_width(spark, sf_dir):
    n = table(spark, sf_dir, "benchmark").count()
    return spark.createDataFrame([(cascade.adaptive_width(n, 24000, {1: 11, 2: 15, 4: 25, 8: 50}),)], "width int")


# ---- weight blending: an embedding's label as model, its place within the label as parameter ----

PARAMS = "(select cast(label as varchar) as model, 'p' || (row_number() over (partition by label order by vec_id) - 1) as name, embedding as vec from embeddings)"
CELLS = f"(select model, name, i, cast(vec[i] as double) as v, w from (select *, unnest(range(1, len(vec) + 1)) as i from {PARAMS} join (values ('0', 0.5), ('1', 0.3), ('2', 0.1)) g(m, w) on m = model))"


def blend_sql(value: str) -> str:
    return f"select name, list(round(v, 6) order by i) as vec from (select name, i, {value} as v from {CELLS} group by all) group by name"


def _params(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    place = F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1
    return e.select(F.col("label").cast("string").alias("model"), F.concat(F.lit("p"), place).alias("name"), F.col("embedding").cast("array<double>").alias("vec"))


def _rounded(df: DataFrame) -> DataFrame:
    # a negative value that rounds to nothing is -0.0 in SQL; Spark rounds by way of a decimal, which has no such sign
    return df.select("name", F.transform("vec", lambda v: let(F.round(v, 6), lambda r: F.when((r == 0) & (v < 0), F.lit(-0.0)).otherwise(r))).alias("vec"))


@query(blend_sql("sum(w * v) / sum(w)"))
def blend_renormalised(spark, sf_dir):
    return _rounded(blend.blended(_params(spark, sf_dir), {"0": 0.5, "1": 0.3, "2": 0.1}))


@query(blend_sql("sum(w * v) / 0.9"))
def blend_plain(spark, sf_dir):
    return _rounded(blend.blended(_params(spark, sf_dir), {"0": 0.5, "1": 0.3, "2": 0.1}, renormalise=False))


# ---- label ids ----


IDS = "(select conv_id, turn, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: cast('0x' || h as int) + 3) as ids from conversations)"


@query(f"select conv_id, turn, len(ids) as n, array_to_string(list_concat(list_slice(ids, 1, 511), [1]), ' ') as kept from {IDS}")
def byte_ids(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", (F.size(corpus.byte_ids(F.col("text"))) - 1).cast("long").alias("n"), F.array_join(corpus.byte_ids(F.col("text"), 512).cast("array<string>"), " ").alias("kept"))


PADDED = f"(select conv_id, turn, list_concat(x, list_transform(range(0, greatest(0, 40 - len(x))), lambda i: 0)) as x from (select conv_id, turn, list_concat(list_slice(ids, 1, 31), [1]) as x from {IDS}))"


@query(f"select conv_id, turn, array_to_string(list_transform(x, lambda v: case when v = 0 then -100 else v end), ' ') as masked, array_to_string(list_transform(x, lambda v: case when v >= 200 then 0 else v end), ' ') as unmasked from {PADDED}")
def label_masks(spark, sf_dir):
    """Ids cut to 32 and filled up to 40, with the filling masked, and back with ids that a vocabulary of 200 lacks as filling."""
    ids = corpus.byte_ids(F.col("text"), 32, 40)
    masked = corpus.masked_labels(ids)
    joined = lambda c: F.array_join(c.cast("array<string>"), " ")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", joined(masked).alias("masked"), joined(corpus.unmasked_labels(masked, 200)).alias("unmasked"))


# ---- files: tables are written to the shared folder and read again ----

TALK = "(select conv_id, turn, role, text from conversations)"


def _csv(spark, df: DataFrame, tag: str) -> str:
    path = scratch(spark, tag)
    sinks.write_csv(df, path)
    return path


@query(f"select conv_id, turn, role, nullif(text, '') as text from {TALK}")
def csv_round_trip(spark, sf_dir):
    talk = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return files.read_csv(spark, _csv(spark, talk, "csv"), "conv_id long, turn long, role string, text string")


@query("select o_orderkey as orderkey, o_totalprice as price, o_orderstatus as status from orders")
def csv_inferred(spark, sf_dir):
    """Types are found by reading; line by line, so that a file can be split."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("orderkey"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"))
    out = files.read_csv(spark, _csv(spark, orders, "orders"), infer=True, multi_line=False)
    return out.select(F.col("orderkey").cast("long").alias("orderkey"), "price", "status")


@query(f"select {strip_sql('text')} as text, count(*) as n from {TALK} group by 1")
def csv_column(spark, sf_dir):
    path = _csv(spark, table(spark, sf_dir, "conversations").select("conv_id", "text"), "column")
    return files.read_texts(spark, path, "text").groupBy("text").agg(F.count("*").alias("n"))


ONE_LINE = "regexp_replace({0}, '[\\r\\n]+', ' ', 'g')"


@query(f"select text, count(*) as n from (select {strip_sql('line')} as text from (select unnest(regexp_split_to_array(text, '\\r\\n|\\r|\\n')) as line from documents)) where text <> '' group by text")
def text_lines(spark, sf_dir):
    path = scratch(spark, "lines")
    table(spark, sf_dir, "documents").select("text").write.text(path)
    return files.read_texts(spark, path).groupBy("text").agg(F.count("*").alias("n"))


LINED = f"(select row_number() over (order by conv_id, turn) - 1 as ord, {strip_sql(ONE_LINE.format('src'))} as src, {strip_sql(ONE_LINE.format('tgt'))} as tgt from {PAIRS})"


@query(f"select * from {LINED} where length(src) > 5 and length(tgt) > 5")
def parallel_lines(spark, sf_dir):
    sides = {}
    for c in ("src", "tgt"):
        line = F.regexp_replace(c, r"[\r\n]+", " ")
        sides[c] = scratch(spark, c)
        _pairs(spark, sf_dir).select("conv_id", "turn", line.alias("line")).coalesce(1).sortWithinPartitions("conv_id", "turn").select("line").write.text(sides[c])
    return files.read_parallel(spark, sides["src"], sides["tgt"])


@query(f"select src, tgt from {PAIRS} where src <> '' and tgt <> ''")
def corpus_scan(spark, sf_dir):
    """Columns are found by their names, in the first folder and under the first name that there is."""
    named = _pairs(spark, sf_dir).select("conv_id", F.col("src").alias("Akkadian_text"), F.col("tgt").alias("english"))
    folder = scratch(spark, "found")
    sinks.write_csv(named, f"{folder}/all_Sentences.csv")
    return files.read_corpus(spark, files.find_table(spark, [f"{folder}/nowhere", folder], ["sentences.csv"]))


@query("select doc_id, source, coalesce(lang, source) as tgt from documents")
def teacher_choice(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return files.teacher_or_target(d, "lang", "source").select("doc_id", "source", "tgt")


@query(ORACLES["hash_split"].replace("doc_id, source,", "doc_id,", 1))
def split_outputs(spark, sf_dir):
    train, val = scratch(spark, "train"), scratch(spark, "val")
    sinks.write_split(corpus.hash_split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.2), train, val)
    read = lambda path, flag: files.read_csv(spark, path, "doc_id long").withColumn("is_val", F.lit(flag))
    return read(train, False).union(read(val, True))


@query(f"select doc_id as id, case when {collapse_sql(ascii_sql('text'))} = '' then 'broken text' else {collapse_sql(collapse_sql(ascii_sql('text')))} end as translation from documents")
def repaired_output(spark, sf_dir):
    d = dealt(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("translation"))
    return sinks.repaired(d)


@query("select to_json({'role': role, 'n': n}) as report from (select role, count(*) as n from conversations group by role)")
def report_json(spark, sf_dir):
    return sinks.report_json(table(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("n")))


@query("select doc_id, lang, source from documents")
def result_table(spark, sf_dir):
    return sinks.result_table(table(spark, sf_dir, "documents"), ["doc_id", "lang"], ["source", "not there"])


@query("select count(*) as n_rows, 5 as n_columns, 'doc_id,text,lang,source,n_chars' as names, min(doc_id) as first_id from documents")
def table_shape(spark, sf_dir):
    seen = contracts.inspect(table(spark, sf_dir, "documents"), "doc_id")
    return spark.createDataFrame([(seen["shape"][0], seen["shape"][1], ",".join(seen["columns"]), seen["first"][0]["doc_id"])], "n_rows long, n_columns int, names string, first_id long")


# ---- filters, limits, batches, scores of whole tables ----


@query("select doc_id, text from documents order by doc_id desc limit 25")
def first_rows(spark, sf_dir):
    return corpus.first_rows(table(spark, sf_dir, "documents").select("doc_id", "text", (-F.col("doc_id")).alias("turned")), 25, "turned").drop("turned")


@query("select doc_id, (row_number() over (order by doc_id) - 1) // 32 as batch, (row_number() over (order by doc_id) - 1) % 32 as place from documents")
def batches_in_order(spark, sf_dir):
    return corpus.batched(table(spark, sf_dir, "documents").select("doc_id"), 32, "doc_id")


@query("select doc_id, (row_number() over (order by h, doc_id) - 1) // 32 as batch, (row_number() over (order by h, doc_id) - 1) % 32 as place from (select doc_id, md5(doc_id || ':7') as h from documents)")
def batches_shuffled(spark, sf_dir):
    return corpus.batched(table(spark, sf_dir, "documents").select("doc_id"), 32, "doc_id", seed=7)


@query(f"select conv_id, turn, src from {PAIRS} where len({tokens_sql('src')}) >= 10")
def token_count_filter(spark, sf_dir):
    return corpus.longer_than(_pairs(spark, sf_dir), "src", 10).select("conv_id", "turn", "src")


@query(f"select conv_id, turn, unnest(range(0, len(a))) as at, unnest(a) as word, unnest(list_transform(a, lambda w: length(w))) as size from (select conv_id, turn, {tokens_sql('src')} as a from {PAIRS})")
def positional_zip(spark, sf_dir):
    words = tokens(F.col("src"))
    z = corpus.zip_strict(words, F.transform(words, F.length))
    out = _pairs(spark, sf_dir).select("conv_id", "turn", F.posexplode(z).alias("at", "z"))
    return out.select("conv_id", "turn", F.col("at").cast("long").alias("at"), F.col("z.a").alias("word"), F.col("z.b").cast("long").alias("size"))


@query(f"select n, bleu, chrf, geo_mean from ({corpus_scores_sql(f'select 0 as one, tgt as h, src as r from {PAIRS}', 'one')})")
def evaluate(spark, sf_dir):
    p = _pairs(spark, sf_dir).select(F.struct("conv_id", "turn").alias("id"), "src", "tgt")
    return metrics.evaluate(p.select("id", F.col("tgt").alias("text")), p.select("id", F.col("src").alias("text")))


DIGITS_DONE = collapse_sql(replace_sql(digits_sql("translate({0}, 'ḫḪ', 'hH')"), T.FRACTIONS))


def dotted_sql(text: str) -> str:
    return f"(select case when {strip_sql('y')} = '' then '.' else y end from (select {DIGITS_DONE.replace('{0}', text)} as y))"


DOTTED = "select 0 as one, " + dotted_sql("tgt") + " as h, " + dotted_sql("src") + f" as r from {PAIRS}"


@query(f"select bleu, chrf from ({corpus_scores_sql(DOTTED, 'one')})")
def training_scores(spark, sf_dir):
    return metrics.training_scores(_pairs(spark, sf_dir), F.col("tgt"), F.col("src"), C.postprocess_digits)


@query(f"select text, min(part) as part from (select text, 0 as part from benchmark union all select src, 1 from {PAIRS}) group by text")
def corpora_together(spark, sf_dir):
    """Further corpora behind the first; of equal texts the first one stays."""
    both = table(spark, sf_dir, "benchmark").select("text", F.lit(0).alias("part")).union(_pairs(spark, sf_dir).select("src", F.lit(1)))
    return corpus.dedup_first(both, "text", "part")


@query(ORACLES["confidence_filter"].replace('select grp as "group", cand, round(score, 6) as score, high as high_confidence_count, high > 0 or score >= 0.7 as high_confidence from r where r = 1', f"""select r.grp as id, t.text as translation, round(r.score, 6) as confidence, r.high > 0 or r.score >= 0.7 as high_confidence,
case when r.high > 0 or r.score >= 0.7 then 'high_confidence' else 'confidence_filtering' end as method, (select array_to_string(list_slice(list(x.text order by x.cand), 1, 3), chr(1)) from {CANDS} x where x.grp = r.grp) as candidates
from r join {CANDS} t on t.grp = r.grp and t.cand = r.cand where r.r = 1"""))
def translate_batch(spark, sf_dir):
    """The first user turn of a conversation as the source, its assistant turns as candidates."""
    c = _with_source(spark, sf_dir).withColumn("seq_score", F.col("seq_score") * 5)
    rows = c.select(F.col("group").alias("id"), F.col("source").alias("text")).distinct()
    out = cascade.translate(rows, c.select(F.col("group").alias("id"), "cand", "text", "seq_score"), 0.5, metrics.token_f1)
    return out.select("id", "translation", F.round("confidence", 6).alias("confidence"), "high_confidence", "method", F.array_join("candidates", "\x01").alias("candidates"))


FLAGSHIP = retrieve_topk
