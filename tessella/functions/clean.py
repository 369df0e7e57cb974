"""Cleaning rules for source and target texts, and the pipelines made of them. All are Column to Column; what ``texts`` has runs there."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables as T
from . import texts
from .dialect import blank, collapse, let, lookup, replace_all, rstrip, strip, sub, text_of, tokens
from .texts import over_texts

# ---- source side ----


def normalize_gaps(text: Column, dots: str = "split") -> Column:
    """Marks of lost text as <gap> and <big_gap>. ``dots``: "split" takes runs of five, then three or four; "any" takes three or more at once."""
    rules = T.GAP_RULES
    if dots == "any":
        rules = [*rules[:2], (r"\.{3,}", "<big_gap>"), rules[3], *rules[5:]]
    return sub(text, *rules)


def remove_determinatives(text: Column) -> Column:
    return sub(text, (T.DETERMINATIVE, ""), flags="(?iu)")


def normalize_subscripts(text: Column) -> Column:
    return F.translate(text, T.SUBSCRIPTS, T.DIGITS)


def normalize_superscripts(text: Column) -> Column:
    return F.translate(text, T.SUPERSCRIPTS, T.DIGITS)


def remove_scholarly(text: Column) -> Column:
    return F.translate(text, T.SCHOLARLY, "")


def truncate(text: Column, most: int = 800) -> Column:
    return let(text, lambda t: F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit(" <big_gap>"))).otherwise(t))


def with_prefix(text: Column, prefix: str = T.PREFIX) -> Column:
    return F.concat(F.lit(prefix), text)


def short_gaps(text: Column) -> Column:
    """Dots and runs of x only; blanks around a lone x go with it."""
    return sub(text_of(text), *T.SHORT_GAP_RULES)


def strict_gaps(text: Column, most: int = 800) -> Column:
    """Truncated first; only bracketed or long runs of dots are big gaps."""
    return strip(sub(truncate(text_of(text), most), *T.STRICT_GAP_RULES))


def dot_gaps(text: Column) -> Column:
    return collapse(sub(text_of(text), *T.DOT_GAP_RULES))


def unbraced_signs(text: Column) -> Column:
    return sub(text, *T.BRACED_RULES)


def without_notes(text: Column) -> Column:
    return collapse(sub(text, *T.NOTE_RULES))


def retrieval_key(text: Column, superscripts: bool = False) -> Column:
    """The form that sources are matched by. ``superscripts``: ¹, ² and ³ go too, which lie outside the range of the other ones."""
    return over_texts(partial(texts.retrieval_key, superscripts=superscripts), text, "")


def source_words(text: Column) -> Column:
    """Words for the lexicon, outside of marks in angle brackets."""
    pattern = "(?iu)" + sub_pattern(T.SOURCE_WORD)
    return F.regexp_extract_all(sub(text_of(text), (r"<\w+>", "")), F.lit(pattern), F.lit(0))


def sub_pattern(pattern: str) -> str:
    from .dialect import spelled_out

    return spelled_out(pattern)


def numbers(text: Column) -> Column:
    return F.regexp_extract_all(text_of(text), F.lit(r"\p{Nd}+"), F.lit(0))


# ---- target side ----


def plain_h(text: Column) -> Column:
    return F.translate(text, "ḫḪ", "hH")


def output_gaps(text: Column) -> Column:
    return sub(sub(text, (r"\[x\]|\(x\)|\bx\b", "<gap>"), flags="(?iu)"), *T.OUTPUT_GAP_RULES)


def remove_grammar(text: Column) -> Column:
    return sub(text, (T.GRAMMAR, ""), flags="(?iu)")


# private-use characters stand for the gap marks while brackets and angle brackets go
_GAP, _BIG = "\ue000", "\ue001"


def _guarded(text: Column, body, gap: str, big: str) -> Column:
    held = replace_all(text, {"<gap>": _GAP, "<big_gap>": _BIG})
    return replace_all(body(held), {_GAP: gap, _BIG: big})


def remove_bracketed(text: Column, keep_gaps: bool = True) -> Column:
    """Delete what stands in round or square brackets; the kinds may mix, nothing nests."""
    return _guarded(text, lambda t: sub(t, (T.BRACKETED, "")), *(("<gap>", "<big_gap>") if keep_gaps else ("", "")))


def remove_special(text: Column, keep_gaps: bool = True) -> Column:
    if not keep_gaps:
        return F.translate(text, T.BAD_OUTPUT, "")
    return _guarded(text, lambda t: F.translate(t, T.BAD_OUTPUT, ""), " <gap> ", " <big_gap> ")


def convert_fractions(text: Column) -> Column:
    return replace_all(text, T.FRACTIONS)


def decimal_rules() -> list[tuple[str, str]]:
    return [rule for pattern, sign in T.DECIMALS for rule in ((r"(\d+)" + pattern, rf"\1 {sign}"), (r"\b0" + pattern, sign))]


def decimal_fractions(text: Column) -> Column:
    return over_texts(texts.decimal_fractions, text)


def zero_fractions(text: Column) -> Column:
    return sub(text, (r"\b0\s+([¼½¾⅓-⅞])", r"\1"))


def remove_repeats(text: Column, loops: bool = True) -> Column:
    """One of immediately repeated words and phrases of up to four words; with ``loops`` also of three to eight words as they stand."""
    return over_texts(partial(texts.remove_repeats, loops=loops), text)


def strip_big_gaps(text: Column) -> Column:
    return collapse(F.replace(text, F.lit("<big_gap>"), F.lit("")))


def whole_sentences(text: Column, least: int = 200) -> Column:
    """Texts of ``least`` characters or more end before their last full stop or comma, if that is past the middle."""

    head = F.regexp_extract(text, r"(?s)\A(.*)[.,]", 1)
    return F.when((F.length(text) >= least) & (F.length(head) > F.length(text) * 0.5), rstrip(head)).otherwise(text)


def capped(text: Column, most: Column) -> Column:
    """Whole words while their lengths, a blank each, stay within ``most``; the first always stays. Shorter texts are not touched."""
    return texts.capped_texts(text, most.cast("int"))


def cap_length(text: Column, source: Column, share: float | Column = 0.5, plus: int | Column = 30, least: int | None = 100) -> Column:
    """At most ``share`` of the source's length and ``plus`` characters, rounded down, and not under ``least``."""
    most = F.floor(F.length(text_of(source)) * share + plus).cast("int")
    return capped(text, F.greatest(most, F.lit(least)) if least is not None else most)


def strip_dashes(text: Column, again: bool = True) -> Column:
    out = F.regexp_replace(collapse(text), r"\A-++|(?<!-)-++\z", "")
    return strip(out) if again else out


def to_ascii(text: Column) -> Column:
    """Known diacritics to letters, then NFKD without marks, then anything else to a blank."""
    return over_texts(texts.to_ascii, text)


def _side_of(text: Column, mark: str, side: int) -> Column:
    """What stands before the first mark (1) or behind the last (-1), stripped; without a mark the text."""
    return let(text, lambda x: F.when(F.contains(x, F.lit(mark)), strip(F.substring_index(x, mark, side))).otherwise(x))


def without_template(text: Column) -> Column:
    """Cut at prompt markers and before a sentence with source words; NULL if next to nothing of a long text is left."""
    t = text
    for marker in T.TEMPLATE_MARKERS:
        t = _side_of(t, marker, 1)
    pattern = "(?U)" + sub_pattern(T.SOURCE_WORDS)

    def before(x: Column) -> Column:
        sentences = F.split(x, r"\.", -1)
        met = F.array_position(F.transform(sentences, lambda s: s.rlike(pattern)), True)
        kept = F.when(met > 0, F.slice(sentences, 1, met.cast("int") - 1)).otherwise(sentences)
        joined = let(F.array_join(kept, ". "), lambda j: F.when(j.endswith("."), j).otherwise(F.concat(j, F.lit("."))))
        return F.when(x.rlike(pattern) & (F.size(kept) > 0), joined).otherwise(x)

    done = let(t, before)
    return let(done, lambda x: F.when((F.length(x) < 10) & (F.length(text) > 50), F.lit(None)).otherwise(x))


def edited_answer(text: Column) -> Column:
    """What follows the last "Corrected:" and "Translation:", up to its last full sentence if that is past the middle."""
    t = text
    for mark in ("Corrected:", "Translation:"):
        t = _side_of(t, mark, -1)

    def end(x: Column) -> Column:
        last = F.length(F.regexp_extract(x, r"(?s)\A(.*[.!?])", 1))
        return F.when(F.substring(x, -1, 1).isin(".", "!", "?") | (last - 1 <= F.length(x) * 0.5), x).otherwise(F.substring(x, F.lit(1), last))

    return let(t, end)


def accepted_edit(edited: Column, before: Column) -> Column:
    """The edited text unless it is too short, too long, or lost the gap marks; then the text before."""
    gaps = lambda x: F.contains(x, F.lit("<gap>")) | F.contains(x, F.lit("<big_gap>"))
    bad = edited.isNull() | (F.length(edited) < 5) | (F.length(edited) > F.length(before) * 2.5) | (gaps(before) & ~gaps(edited))
    return F.when(bad, before).otherwise(edited)


def or_default(text: Column, default: str = "broken text") -> Column:
    return F.when(text.isNull() | blank(text), F.lit(default)).otherwise(text)


def fallback_text(text: Column, lexicon: dict[str, list[str]]) -> Column:
    """A text for a source that nothing else translates: known words, the first number, and a gap."""
    known = F.create_map(*[x for w, ts in lexicon.items() for x in (F.lit(w), F.array(*map(F.lit, ts)))]) if lexicon else F.lit(None).cast("map<string,array<string>>")
    none = F.array().cast("array<string>")
    hits = F.flatten(F.transform(F.slice(source_words(text), 1, 5), lambda w: F.coalesce(F.try_element_at(known, F.lower(w)), none)))
    first = F.try_element_at(numbers(text), F.lit(1))
    parts = F.filter(F.array(F.nullif(F.array_join(F.slice(hits, 1, 3), " "), F.lit("")), F.concat(F.lit("involving "), first)), lambda p: p.isNotNull())
    return F.when(F.size(parts) > 0, F.concat(F.array_join(parts, " "), F.lit(" <big_gap>"))).otherwise(F.lit("From <gap> to <gap> <big_gap>"))


# ---- predicates ----


def is_broken(text: Column) -> Column:
    """Mostly gaps: begins with "[...", has no words, or over 40 % of fewer than 20 words are gaps."""
    pattern = sub_pattern(T.BROKEN_TOKEN)
    words = tokens(text_of(text))
    gaps = F.size(F.filter(words, lambda w: w.rlike(pattern)))
    return strip(text_of(text)).startswith("[...") | (F.size(words) == 0) | ((gaps / F.nullif(F.size(words), F.lit(0)) > 0.4) & (F.size(words) < 20))


def is_broken_adapter(text: Column) -> Column:
    words, t = tokens(text_of(text)), strip(text_of(text))
    gaps = F.size(F.filter(words, lambda w: w.isin("x", "xx", "xxx", "<gap>", "<big_gap>", "...")))
    return (t.startswith("[") & F.contains(F.substring(t, 1, 20), F.lit("..."))) | ((F.size(words) > 3) & (gaps / F.greatest(F.size(words), F.lit(1)) > 0.4))


def is_garbage(text: Column) -> Column:
    """Under three characters, or over five words of which fewer than 30 % differ."""
    words = tokens(text_of(text))
    return (F.length(strip(text_of(text))) < 3) | ((F.size(words) > 5) & (F.size(F.array_distinct(words)) / F.greatest(F.size(words), F.lit(1)) < 0.3))


def dictionary_lookup(text: Column, table: dict[str, str] = T.DICTIONARY) -> Column:
    """The entry of a one-word text, else NULL; an empty entry is a hit. No word of a table has white space inside, so the stripped text is looked up."""
    return F.try_element_at(lookup(table), strip(text_of(text)))


# ---- pipelines ----


def preprocess(text: Column, most: int = 800, prefix: str = T.PREFIX, dots: str = "split") -> Column:
    t = remove_determinatives(normalize_gaps(text, dots))
    t = truncate(collapse(remove_scholarly(normalize_superscripts(normalize_subscripts(t)))), most)
    return F.when(text.isNull() | blank(text), F.lit(prefix)).otherwise(with_prefix(t, prefix))


def preprocess_adapter(text: Column, prefix: str = T.PREFIX) -> Column:
    t = with_prefix(collapse(normalize_superscripts(normalize_subscripts(sub(text, *T.SHORT_GAP_RULES)))), prefix)
    return F.coalesce(t, F.lit(""))


def preprocess_dots(text: Column, prefix: str = T.PREFIX) -> Column:
    return with_prefix(dot_gaps(text), prefix)


def postprocess(text: Column, brackets: bool = True, big_gaps: bool = True) -> Column:
    """The full target pipeline. ``brackets`` and ``big_gaps``: whether bracketed text and big gaps go."""
    return over_texts(partial(texts.postprocess, brackets=brackets, big_gaps=big_gaps), text, "")


def postprocess_ascii(text: Column) -> Column:
    """The target pipeline without decimals, ending in ASCII; long texts are those over 200 characters."""
    return over_texts(texts.postprocess_ascii, text, "")


def postprocess_retrieved(text: Column) -> Column:
    return over_texts(texts.postprocess_retrieved, text, "")


def postprocess_plain(text: Column, empty: str = "hnr") -> Column:
    """No bracket step, decimals before repeats, no loops; a blank text gives ``empty``."""
    return over_texts(partial(texts.postprocess_plain, empty=empty), text, empty)


def postprocess_digits(text: Column) -> Column:
    return collapse(convert_fractions(normalize_superscripts(normalize_subscripts(plain_h(text_of(text))))))


def postprocess_adapter(text: Column, source: Column) -> Column:
    """Gap marks lose their angle brackets before they are looked for, so their words stay."""
    t = replace_all(F.translate(text_of(text), T.BAD_OUTPUT, ""), {"<big_gap>": "", "<gap>": ""})
    return cap_length(strip_dashes(t, again=False), source, least=None)
