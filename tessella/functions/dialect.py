"""One regular-expression dialect for Spark, DuckDB and Python, and text primitives with Python's meaning.

Rules are written in Python's syntax, where \\w, \\s, \\d and \\b know all of Unicode. Java and RE2
read these classes as ASCII, so they are spelled out.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = r"\p{L}\p{N}_"
_SPACE = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_CLASS = {"w": _WORD, "s": _SPACE, "d": r"\p{Nd}"}
W, S = f"[{_WORD}]", f"[{_SPACE}]"
#: S for Java only: what is single and under 256 is one look into a table, and the rest is left out at once for other characters.
FAST_S = r"[\x09\x0a\x0b\x0c\x0d\x1c\x1d\x1e\x1f\x20\x85\xa0[\x{1680}-\x{3000}&&[\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]]"
BOUNDARY = rf"(?:(?<={W})(?!{W})|(?<!{W})(?={W}))"

#: Pattern and replacement, both in Python's syntax.
Rule = tuple[str, str]


def spelled_out(pattern: str, boundary: str | None = BOUNDARY) -> str:
    """A Python pattern with its Unicode classes spelled out; without ``boundary``, \\b raises ValueError."""
    out, inside = [], False
    for m in re.finditer(r"\\u([0-9a-fA-F]{4})|\\(.)|(.)", pattern, re.S):
        code, escape, plain = m.groups()
        if code:
            out.append(rf"\x{{{code}}}")
        elif escape in _CLASS:
            out.append(_CLASS[escape] if inside else f"[{_CLASS[escape]}]")
        elif escape == "b":
            if boundary is None:
                raise ValueError(f"no word boundary here: {pattern}")
            out.append(boundary)
        else:
            inside = plain == "[" or (inside and plain != "]")
            out.append(m[0])
    return "".join(out)


def sub(text: Column, *rules: Rule, flags: str = "") -> Column:
    """Apply rules in order, as re.sub does."""
    for pattern, new in rules:
        java = new.replace("\\\\", "\0").replace("$", "\\$")
        java = re.sub(r"\\(\d)", r"$\1", java).replace("\0", "\\\\")
        text = F.regexp_replace(text, flags + spelled_out(pattern), java)
    return text


def sub_sql(text: str, *rules: Rule, flags: str = "g") -> str:
    """The same rules as DuckDB SQL; patterns can't have \\b, lookarounds or backreferences."""
    for pattern, new in rules:
        quoted = [x.replace("'", "''") for x in (spelled_out(pattern, None), new)]
        text = f"regexp_replace({text}, '{quoted[0]}', '{quoted[1]}', '{flags}')"
    return text


def sub_python(text: str, *rules: Rule, flags: int = 0) -> str:
    for pattern, new in rules:
        text = re.sub(pattern, new, text, flags=flags)
    return text


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_of(value: Column) -> Column:
    """NULL as the empty text."""
    return F.coalesce(value, F.lit(""))


#: What Python calls white space, which S has as a class.
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def strip(text: Column) -> Column:
    """str.strip()"""
    return F.btrim(text, F.lit(SPACES))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(SPACES))


def collapse(text: Column) -> Column:
    """Runs of white space to one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{FAST_S}+", " "))


def tokens(text: Column) -> Column:
    """str.split(): Spark keeps empty tokens at the edges, these go."""
    return F.array_remove(F.split(text, f"{FAST_S}+"), "")


def blank(text: Column) -> Column:
    return collapse(text) == ""


def replace_all(text: Column, table: dict[str, str]) -> Column:
    for old, new in table.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def lookup(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def first_best(score: Column, order: Column, *rest: Column) -> Column:
    """An aggregate: the struct of the row with the largest score; of equals the one first in ``order``."""
    return F.max(F.struct(score.alias("score"), (-order).alias("turned"), *rest))


# Python's class as SQL, for oracles
SPACE_SQL = S


def collapse_sql(text: str) -> str:
    return f"trim(regexp_replace({text}, '{S}+', ' ', 'g'))"


def strip_sql(text: str) -> str:
    return f"regexp_replace({text}, '^{S}+|{S}+$', '', 'g')"


def tokens_sql(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{S}+'), lambda t: t <> '')"
