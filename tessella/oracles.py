"""DuckDB SQL for rules that one expression cannot hold: repeats, corpus scores, alignment. Used by oracles only."""

from __future__ import annotations

from .functions.dialect import S, W, tokens_sql
from .operators.metrics import CHARS, ORDERS, WORDS

SPACED = f"'^{S}+$'"


def unrepeated(name: str, src: str, n: int, spaced: bool) -> str:
    """CTEs up to ``name`` (id, k, s, w): ``src`` without immediate repeats of ``n`` words, the leftmost first.

    A row is a word w and what stands before it, s; with ``spaced`` words belong together only
    across white space, and a repeat has the same white space inside. Few words equal the n-th
    after them, so all but one step work on few rows.
    """
    over = "over (partition by id order by k)"
    inner = [f"coalesce(lead(k, {i}) {over} = k + {i} and lead(ok, {i}) {over}, false)" for i in range(1, n)]
    ok, behind = (f"s = s2 and regexp_matches(s, {SPACED})", f"regexp_matches(s2, {SPACED})") if spaced else ("true", "true")
    return f"""{name}_f as (select id, k, {ok} as ok, {behind} as b from (select id, k, s, w, lead(s, {n}) {over} as s2, lead(w, {n}) {over} as w2 from {src}) where w = w2),
{name}_e as (select id, k from (select id, k, {" and ".join(["b", *inner])} as eq from {name}_f) where eq),
{name}_c as materialized (select id, k, max(k) over (partition by id, k % {n}, island) + {n} as stop from (select id, k, k - {n} * row_number() over (partition by id, k % {n} order by k) as island from {name}_e)),
{name}_m as (select id, min(k) as k from {name}_c group by id union all
  select m.id, min(d.k) as k from {name}_m m join {name}_c c on c.id = m.id and c.k = m.k join {name}_c d on d.id = m.id and d.k >= c.stop + {n} group by m.id),
{name}_g as (select id, unnest(range(k + {n}, stop + {n})) as k from {name}_m join {name}_c using (id, k)),
{name} as materialized (select id, row_number() over (partition by id order by k) as k, s, w from {src} anti join {name}_g using (id, k))"""


def without_repeats(rel: str, loops: bool) -> str:
    """CTEs up to ``fixed`` (id, t) from ``rel`` (id, t): repeated words and phrases gone, with ``loops`` those of three to eight words too."""
    ctes = [f"""w0 as materialized (select id, k, s[k] as s, w[k] as w from (select id, s, w, unnest(range(1, len(w) + 1)) as k from
  (select id, regexp_split_to_array(t, '{W}+') as s, regexp_extract_all(t, '{W}+') as w from {rel})))"""]
    src = "w0"
    for n in (1, 4, 3, 2):
        ctes.append(unrepeated(f"w{n}", src, n, True))
        src = f"w{n}"
    ctes.append(f"said as (select id, string_agg(s || w, '' order by k) as t from {src} group by id)")
    ctes.append(f"whole as (select r.id, coalesce(said.t, '') || regexp_replace(r.t, '^.*{W}', '', 's') as t from {rel} r left join said using (id))")
    if not loops:
        return ",\n".join([*ctes, "fixed as (select * from whole)"])
    return ",\n".join([*ctes, without_loops("whole")])


def without_loops(rel: str) -> str:
    """CTEs up to ``fixed`` (id, t) from ``rel`` (id, t): immediate repeats of eight down to three words gone; texts of under six words stay."""
    ctes = [f"l9 as materialized (select id, k, '' as s, w[k] as w from (select id, w, unnest(range(1, len(w) + 1)) as k from (select id, {tokens_sql('t')} as w from {rel}) where len(w) >= 6))"]
    for n in range(8, 2, -1):
        ctes.append(unrepeated(f"l{n}", f"l{n + 1}", n, False))
    ctes.append("looped as (select id, string_agg(w, ' ' order by k) as t from l3 group by id)")
    return ",\n".join([*ctes, f"fixed as (select w.id, coalesce(l.t, w.t) as t from {rel} w left join looped l using (id))"])


def loops_query(rel: str) -> str:
    return f"with recursive base as (select id, text as t from {rel}),\n{without_loops('base')}\nselect id as doc_id, t as result from fixed"


def repeats_query(rel: str, before: str, after, loops: bool) -> str:
    """``rel`` has id and text; ``before`` is SQL over text, ``after`` gives SQL over t."""
    return f"with recursive base as (select id, {before} as t from {rel}),\n{without_repeats('base', loops)}\nselect id as doc_id, {after('t')} as result from fixed"


def bleu_tokens_sql(text: str) -> str:
    t = f"replace(replace({text}, '<skipped>', ''), '-' || chr(10), '')"
    for entity, sign in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        t = f"replace({t}, '{entity}', '{sign}')"
    t = f"' ' || replace({t}, chr(10), ' ') || ' '"
    for pattern, new in ((r"([\{-~\[-` -&\(-\+:-@/])", r" \1 "), (r"([^0-9])([.,])", r"\1 \2 "), (r"([.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 ")):
        t = f"regexp_replace({t}, '{pattern}', '{new}', 'g')"
    return tokens_sql(t)


def chrf_words_sql(text: str) -> str:
    mark = r"[!-/:-@\[-`{-~]"
    return f"""flatten(list_transform({tokens_sql(text)}, lambda w: case when length(w) = 1 then [w] when regexp_matches(w, '{mark}$') then [substr(w, 1, length(w) - 1), substr(w, length(w), 1)]
  when regexp_matches(w, '^{mark}') then [substr(w, 1, 1), substr(w, 2)] else [w] end))"""


def corpus_scores_sql(rel: str, by: str) -> str:
    """A SELECT of by, n, bleu, chrf, geo_mean for ``rel`` (by, h, r); see operators.metrics.corpus_scores."""
    parts = []
    for side, ih, ir in (("h", 1, 0), ("r", 0, 1)):
        kinds = [("b", bleu_tokens_sql(f"coalesce({side}, '')"), ORDERS), ("w", chrf_words_sql(f"coalesce({side}, '')"), WORDS)]
        for kind, items, orders in kinds:
            for n in orders:
                parts.append(f"select id, {by}, '{kind}' as kind, {n} as n, unnest(list_transform(range(1, len(x) - {n} + 2), lambda i: array_to_string(list_slice(x, i, i + {n} - 1), chr(1)))) as gram, {ih} as ih, {ir} as ir from (select id, {by}, {items} as x from numbered_rows)")
        for n in CHARS:
            parts.append(f"select id, {by}, 'c', {n}, unnest(list_transform(range(1, length(x) - {n} + 2), lambda i: substr(x, i, {n}))), {ih}, {ir} from (select id, {by}, regexp_replace(coalesce({side}, ''), '{S}+', '', 'g') as x from numbered_rows)")
    grams = " union all ".join(parts)
    at = lambda k, f: f"coalesce(max({f}) filter (kind = '{k[0]}' and n = {k[1:]}), 0)"
    columns = ", ".join(f"cast({at(k, f)} as double) as {k}{f}" for k in [*[f"b{n}" for n in ORDERS], *[f"c{n}" for n in CHARS], *[f"w{n}" for n in WORDS]] for f in "mhr")
    logs, halvings = [], "0"
    for n in ORDERS:
        halvings = f"{halvings} + case when b{n}m = 0 and b{n}h > 0 then 1 else 0 end"
        p = f"case when b{n}h = 0 then 0.0 when b{n}m = 0 then 1.0 / (pow(2.0, {halvings}) * b{n}h) else b{n}m / b{n}h end"
        logs.append(f"(case when ({p}) > 0 then ln({p}) else -9999999999.0 end)")
    some = " + ".join(f"b{n}m" for n in ORDERS)
    bleu = f"case when {some} > 0 then 100 * (case when b1h >= b1r then 1.0 when b1h > 0 then exp(1 - b1r / greatest(b1h, 1.0)) else 0.0 end) * exp(({' + '.join(logs)}) / {len(ORDERS)}) else 0.0 end"
    orders = [f"c{n}" for n in CHARS] + [f"w{n}" for n in WORDS]
    use = lambda k: f"({k}h > 0 and {k}r > 0)"
    count = " + ".join(f"cast({use(k)} as int)" for k in orders)
    mean = lambda f: "coalesce((" + " + ".join(f"case when {use(k)} then {k}m / {k}{f} else 0.0 end" for k in orders) + f") / nullif({count}, 0), 0.0)"
    return f"""with numbered_rows as (select *, row_number() over () as id from ({rel})),
counted as (select id, {by}, kind, n, gram, sum(ih) as ih, sum(ir) as ir from ({grams}) group by all),
each_row as (select id, {by}, kind, n, sum(least(ih, ir)) as m, sum(ih) as h, sum(ir) as r from counted group by all),
total as (select {by}, kind, n, sum(m) as m, sum(case when kind = 'b' or r > 0 then h else 0 end) as h, sum(r) as r from each_row group by all),
wide as (select {by}, {columns} from total group by {by}),
sizes as (select {by}, count(*) as n from numbered_rows group by {by}),
scored as (select sizes.{by}, sizes.n, coalesce({bleu}, 0.0) as bleu, {mean('h')} as p, {mean('r')} as q from sizes left join wide on wide.{by} = sizes.{by}),
done as (select {by}, n, bleu, 100 * (case when p + q > 0 then 5.0 * p * q / (4.0 * p + q) else 0.0 end) as chrf from scored)
select {by}, n, round_even(bleu, 4) as bleu, round_even(chrf, 4) as chrf, round_even(sqrt(bleu * chrf), 4) as geo_mean from done"""


def aligned_sql(rel: str, src: str, tgt: str) -> str:
    """CTEs up to ``aligned`` (id, src, tgt) from ``rel`` (id, a, b; arrays): up to two units of each side at a time, by the nearest word counts."""
    n = lambda t: f"len({tokens_sql(t)})"
    take = lambda x, i, m: f"array_to_string(list_slice({x}, {i} + 1, {i} + {m}), ' ')"
    options = ", ".join(
        f"case when {p} <= len(a) - i and {r} <= len(b) - j then {{'off': abs(ln(greatest(1, {n(take('a', 'i', p))}) / greatest(1, {n(take('b', 'j', r))}))), 'o': {2 * p + r}, 'p': {p}, 'r': {r}}} end" for p in (1, 2) for r in (1, 2)
    )
    return f"""walk as (select id, a, b, 0 as i, 0 as j, 0 as p, 0 as r, 0 as step from {rel} where len(a) > 0 and len(b) > 0 union all
  select id, a, b, i + x.p, j + x.r, x.p, x.r, step + 1 from (select id, a, b, i, j, step, list_min(list_filter([{options}], lambda o: o is not null)) as x from
    (select id, a, b, i, j, step from walk where i < len(a) and j < len(b)))),
ends as (select id, max(step) as last from walk group by id),
aligned as (select id, {take('a', '(i - p)', 'p')} || case when step = last and i < len(a) then ' ' || array_to_string(list_slice(a, i + 1, len(a)), ' ') else '' end as {src},
  {take('b', '(j - r)', 'r')} || case when step = last and j < len(b) then ' ' || array_to_string(list_slice(b, j + 1, len(b)), ' ') else '' end as {tgt} from walk join ends using (id) where step > 0)"""
