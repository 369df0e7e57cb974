"""Personal data in texts, with SQL functions only.

Regular expressions propose spans, checksums confirm them (Luhn for cards, mod 97 for IBANs), and
words near a span raise or lower its score. Positions come from cutting the text at the matches:
the lengths of the gaps and of the matches, added up, are the starts and ends in code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import code_points, let, piece, running

SPAN = "array<struct<start:int,kind:int,end:int,score:double>>"
#: Kinds in the order that breaks ties between spans with one start. The first four always stay.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret", "local_phone")
BASE = KINDS[:4]

# The look-behinds only spare the regex engine starts inside a run that the run's first start
# has already tried; \G is where the match before ended. Possessive runs give nothing back
# that could match, so what is found stays the same and long runs take linear time.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=(?:\x20?[A-Z0-9]){11})",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "secret": r"(?i)(?<![A-Za-z0-9])(?:api[_-]?key|token|secret|password|passwd)\x20?[=:]\x20?[\"']?[A-Za-z0-9_+/=-]{16,}+",
    "local_phone": r"(?<![0-9+(.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9-])",
}
#: The pattern of an IBAN finds its head; this takes what may follow, words in capitals and numbers too.
_IBAN_RUN = r"^[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}"
#: Letters and digits of an IBAN by country.
IBAN_LENGTHS = {
    k: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
        26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
        30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for k in countries.split()
}
#: What a text must hold for a kind to be looked for at all; each follows from the kind's pattern.
_NEEDS = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"),
    "phone": lambda t: t.rlike(r"\+[0-9]"),
    "iban": lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}"),
    "ssn": lambda t: t.rlike(r"[0-9]-[0-9]{2}-[0-9]"),
    "secret": lambda t: t.rlike(r"[=:]\x20?[\"']?[A-Za-z0-9_+/=-]{16}"),
    "local_phone": lambda t: t.rlike(r"[0-9][-.\x20][0-9]{4}"),
}
#: Score without context, and words that support a kind or speak against it.
SCORES = {"email": 0.9, "ip": 0.8, "card": 0.9, "phone": 0.8, "iban": 0.9, "ssn": 0.5, "secret": 0.7, "local_phone": 0.5}
SUPPORT = {
    "email": "e-?mail|mail|contact|write",
    "ip": "ip|host|server|address|adresse",
    "card": "card|visa|credit|karte|carte|tarjeta",
    "phone": "phone|call|tel|fax|mobile|telefon|téléphone|teléfono",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "ssn": "ssn|social security|taxpayer",
    "secret": "api|token|secret|password|key",
    "local_phone": "phone|call|tel|fax|mobile|telefon|téléphone|teléfono",
}
AGAINST = "order|invoice|version|serial|part number|isbn|issn|build|page"
NEAR = 48
#: Added kinds need this score; the base kinds stay whatever their score.
KEEP_FROM = 0.5


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, value) of leftmost non-overlapping matches, in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = let(found, lambda values: F.zip_with(F.transform(F.slice(gaps, 1, F.size(values)), F.length), values, lambda g, v: F.struct(g.alias("gap"), v.alias("value"))))
    placed = running(pairs, F.lit(0), lambda p: p["gap"] + F.length(p["value"]), lambda a, b: a + b)
    start = lambda x: x["before"] + x["item"]["gap"]
    return F.transform(placed, lambda x: F.struct(start(x).alias("start"), (start(x) + F.length(x["item"]["value"])).alias("end"), x["item"]["value"].alias("value")))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    back = F.reverse(digits)
    each = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.struct(F.substring(back, i, F.lit(1)).cast("int").alias("d"), (i % 2 == 0).alias("twice")))
    worth = F.transform(each, lambda x: F.when(~x["twice"], x["d"]).when(x["d"] < 5, 2 * x["d"]).otherwise(2 * x["d"] - 9))
    return F.aggregate(worth, F.lit(0), lambda a, b: a + b) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether letters and digits, read as an IBAN, leave 1 when divided by 97."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))
    codes = F.transform(F.sequence(F.lit(1), F.length(turned)), lambda i: F.ascii(F.substring(turned, i, F.lit(1))))
    rest = F.aggregate(codes, F.lit(0), lambda a, c: F.when(c <= 57, (a * 10 + c - 48) % 97).otherwise((a * 100 + c - 55) % 97))
    return rest == 1


def _ibans(text: Column, points: Column) -> Column:
    """Array of (start, end) of IBANs, from each head to the end of a word where mod 97 holds.

    That is the end the country's length gives, or else the last one; those inside another are left out.
    """
    lengths = F.create_map(*[F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair])

    def best(run: Column) -> Column:
        def at(p: Column) -> Column:
            return F.struct(p.alias("p"), F.replace(F.substring(run["run"], F.lit(1), p), F.lit(" "), F.lit("")).alias("plain"))

        stops = F.filter(F.sequence(F.lit(15), F.length(run["run"])), lambda p: ~F.substring(run["tail"], p, F.lit(2)).rlike("^(?: |.[A-Za-z0-9])"))
        good = F.filter(F.transform(stops, at), lambda x: F.when(F.length(x["plain"]) >= 15, mod97(x["plain"])).otherwise(False))
        fits = lambda x: F.coalesce(F.length(x["plain"]) == F.try_element_at(lengths, F.substring(run["run"], 1, 2)), F.lit(False))
        return F.array_max(F.transform(good, lambda x: F.struct(fits(x).alias("fits"), x["p"].alias("p"))))

    # a transform for each step: what it gives is a value, and not computed again for each use
    heads = F.transform(matches(text, PATTERNS["iban"]), lambda m: F.struct(m["start"].alias("start"), piece(points, m["start"], m["start"] + 70).alias("tail")))
    runs = F.transform(heads, lambda h: F.struct(h["start"].alias("start"), h["tail"].alias("tail"), F.regexp_extract(h["tail"], _IBAN_RUN, 0).alias("run")))
    found = F.transform(runs, lambda r: F.struct(r["start"].alias("start"), (r["start"] + best(r)["p"]).alias("end")))
    # heads come by their starts, so one that ends no later than any before it lies inside that
    kept = running(F.filter(found, lambda m: m["end"].isNotNull()), F.lit(-1), lambda m: m["end"], F.greatest)
    return F.transform(F.filter(kept, lambda x: x["item"]["end"] > x["before"]), lambda x: x["item"])


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        plain = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(plain, lambda p: F.when(F.length(p) <= 3, p.cast("int") <= 255).otherwise(False))
    if kind == "card":
        d = _digits(value)
        return F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    if kind == "ssn":
        return ~value.rlike("^(000|666|9)") & ~value.rlike("-00-|-0000$")
    return F.lit(True)


def _score(points: Column, kind: str, start: Column, end: Column) -> Column:
    near = F.lower(F.concat_ws(" ", piece(points, F.greatest(start - NEAR, F.lit(0)), start), piece(points, end, end + NEAR)))
    # a word against counts only where none supports: "to order, call ..." is still a number to call
    change = F.when(near.rlike(rf"(?<!\p{{L}})(?:{SUPPORT[kind]})(?!\p{{L}})"), 0.2).when(near.rlike(rf"(?<!\p{{L}})(?:{AGAINST})(?!\p{{L}})"), -0.3).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(F.lit(SCORES[kind]) + change, 3)))


def _of_kind(text: Column, kind: str) -> Column:
    """Spans of a kind that pass its check."""

    def spans(points: Column) -> Column:
        good = _ibans(text, points) if kind == "iban" else F.filter(matches(text, PATTERNS[kind]), lambda m: _valid(kind, m["value"]))
        return F.transform(good, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), m["end"].alias("end"), _score(points, kind, m["start"], m["end"]).alias("score")))

    return F.when(_NEEDS[kind](text), let(code_points(text), spans)).otherwise(F.array().cast(SPAN))


def with_spans(df: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """``df`` with an array column of spans (start, kind, end, score), by start and then kind.

    ``kind`` is a place in KINDS; starts and ends count code points, ends are exclusive. A base
    span that passes its check always stays; an added span needs KEEP_FROM and must not lie within a
    base span. Null and empty texts have no spans; other columns and repeated rows pass unchanged;
    a column named ``out`` is replaced.
    """
    t = "__tessella_text"
    rows = df.withColumn(t, F.coalesce(F.col(text), F.lit("")))
    every = F.array_sort(F.concat(*[_of_kind(F.col(t), k) for k in KINDS]))
    # by start, base kinds first: a span lies within a base span if one that began before it ends no earlier
    reach = running(every, F.lit(-1), lambda m: F.when(m["kind"] < len(BASE), m["end"]).otherwise(-1), F.greatest)
    free = F.filter(reach, lambda x: (x["item"]["kind"] < len(BASE)) | ((x["item"]["score"] >= KEEP_FROM) & (x["item"]["end"] > x["before"])))
    return rows.withColumn(out, F.transform(free, lambda x: x["item"])).drop(t)


def named(spans: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """The spans of ``kinds`` as kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    own = F.filter(spans, lambda s: s["kind"] < len(kinds))
    return F.array_join(F.transform(own, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets; overlapping spans become one, named by the first."""
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])

    def done(points: Column) -> Column:
        reach = running(spans, F.lit(0), lambda s: s["end"], F.greatest)
        # what begins before the last end so far belongs to the span before
        pieces = F.transform(reach, lambda x: F.when(x["item"]["start"] >= x["before"], F.concat(piece(points, x["before"], x["item"]["start"]), F.element_at(names, x["item"]["kind"] + 1))).otherwise(""))
        return F.concat(F.array_join(pieces, ""), piece(points, F.array_max(spans["end"]), F.length(text)))

    return F.when(F.size(spans) > 0, let(code_points(text), done)).otherwise(text)
