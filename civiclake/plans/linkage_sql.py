"""Check SQL for a whole trained linkage: exact u, EM as a recursion over pattern counts, scores and clusters, for any ``Linkage``.

All of it works on CTEs ``people`` (an id and the compared columns) and ``prof`` (distinct compared values with ``profile_id``,
``copies`` and term frequencies). Every pair of values and of blocked profiles is formed; it is for small tables only.
"""

from __future__ import annotations

from collections.abc import Sequence

from civiclake.operators.linkage.compare import Comparison, Linkage
from civiclake.operators.linkage.model import FLOOR


def profiles(linkage: Linkage, id_col: str) -> str:
    columns = ", ".join(linkage.columns)
    frequent = [c.column for c in linkage.comparisons if c.term_frequency]
    counts = "".join(f"""
    tf_{c} as (select {c}, count(*) * 1.0 / (select count(*) from people) as tf from people where {c} is not null group by 1),""" for c in frequent)
    joins = " ".join(f"left join tf_{c} on tf_{c}.{c} = p.{c}" for c in frequent)
    picked = "".join(f", tf_{c}.tf as tf_{c}" for c in frequent)
    return f"""prof0 as (select {columns}, min({id_col}) as profile_id, count(*) as copies from people group by all),{counts}
    prof as (select p.*{picked} from prof0 p {joins})"""


def level(c: Comparison, a: str, b: str) -> str:
    far = {"jaro_winkler": f"jaro_winkler_similarity({a}, {b}) >=", "levenshtein": f"levenshtein({a}, {b}) <=", "date": f"abs(date_diff('day', {a}, {b})) <="}
    steps = "".join(f" when {far[c.kind]} {t} then {c.top - 1 - i}" for i, t in enumerate(c.thresholds))
    return f"case when {a} is null or {b} is null then -1 when {a} = {b} then {c.top}{steps} else 0 end"


def _each(linkage: Linkage, what: str) -> list[str]:
    return [f"{what}_{c.column}_{k}" for c in linkage.comparisons for k in range(c.top + 1)]


def _u(linkage: Linkage) -> str:
    parts = []
    for c in linkage.comparisons:
        x = c.column
        parts.append(f"""
    val_{x} as (select {x} as v, count(*)::hugeint as n from people where {x} is not null group by 1),
    seen_{x} as (select level, sum(n)::double as n from (select {level(c, 'a.v', 'b.v')} as level,
      case when a.v = b.v then a.n * (a.n - 1) / 2 else a.n * b.n end as n from val_{x} a join val_{x} b on a.v <= b.v) group by 1)""")
    shares = [f"""(select coalesce(max(greatest({FLOOR}::double, s.n / t.n)) filter (where s.level = {k}), {FLOOR}::double)
        from seen_{c.column} s, (select sum(n) as n from seen_{c.column}) t where s.n > 0) as u_{c.column}_{k}"""
              for c in linkage.comparisons for k in range(c.top + 1)]
    return f"{','.join(parts)},\n    u as (select {', '.join(shares)})"


def _em(linkage: Linkage, number: int, rule: Sequence[str], rounds: int, tolerance: float) -> str:
    free = linkage.outside(rule)
    same = " and ".join(f"a.{c} = b.{c}" for c in rule)
    gammas = ", ".join(f"{level(c, f'a.{c.column}', f'b.{c.column}')} as g_{c.column}" for c in free)
    names = [(c.column, k) for c in free for k in range(c.top + 1)]
    held = ", ".join(f"m_{x}_{k}" for x, k in names)
    start = ", ".join(f"{0.95 if k == c.top else 0.05 / c.top!r}::double as m_{c.column}_{k}" for c in free for k in range(c.top + 1))

    def product(first: str, what: str) -> str:
        factors = "".join(" * (case g_{0} {1} else 1 end)".format(c.column, " ".join(f"when {k} then {what}_{c.column}_{k}" for k in range(c.top + 1))) for c in free)
        return first + factors

    weights = ", ".join(f"sum(case when g_{x} = {k} then share else 0 end) as w_{x}_{k}" for x, k in names)
    totals = {c.column: " + ".join(f"w_{c.column}_{k}" for k in range(c.top + 1)) for c in free}
    new = ", ".join(f"greatest({FLOOR}::double, w_{x}_{k} / coalesce(nullif({totals[x]}, 0), 1)) as new_{x}_{k}" for x, k in names)
    moved = ", ".join(f"abs(new_{x}_{k} - m_{x}_{k})" for x, k in names)
    renamed = ", ".join(f"new_{x}_{k} as m_{x}_{k}" for x, k in names)
    return f"""
    pat{number} as (select {', '.join(f'g_{c.column}' for c in free)}, sum(n)::double as n from (select {gammas},
        case when a.profile_id = b.profile_id then a.copies * (a.copies - 1) / 2 else a.copies * b.copies end as n
        from prof a join prof b on {same} and a.profile_id <= b.profile_id) group by all having sum(n) > 0),
    em{number} as (select 0 as step, 1.0::double as moved, 0.1::double as rate, {start}
      union all
      select step + 1, greatest(abs(new_rate - rate), {moved}), new_rate, {renamed} from (
        select step, rate, {held}, least(greatest(matched / total, {FLOOR}::double), 1 - {FLOOR}::double) as new_rate, {new} from (
          select step, rate, {held}, sum(share) as matched, sum(n) as total, {weights} from (
            select *, n * yes / (yes + no) as share from (
              select e.*, p.*, {product('rate', 'm')} as yes, {product('(1 - rate)', 'u')} as no
              from em{number} e, pat{number} p, u where step < {rounds} and moved >= {tolerance!r}))
          group by step, rate, {held}))),
    fit{number} as (select * from em{number} order by step desc limit 1)"""


def trained(linkage: Linkage, training: Sequence[Sequence[str]], rounds: int, tolerance: float) -> str:
    """CTEs up to ``model``: one row with ``prior`` and ``m_<column>_<level>``, ``u_<column>_<level>``."""
    runs = ",".join(_em(linkage, i, rule, rounds, tolerance) for i, rule in enumerate(training))
    means = []
    for c in linkage.comparisons:
        open_ = [i for i, rule in enumerate(training) if c.column not in rule]
        for k in range(c.top + 1):
            fixed = 0.95 if k == c.top else 0.05 / c.top
            total = " + ".join(f"fit{i}.m_{c.column}_{k}" for i in open_)
            means.append((f"({total}) / {len(open_)}" if open_ else f"{fixed!r}::double") + f" as m_{c.column}_{k}")
    fits = ", ".join(f"fit{i}" for i in range(len(training)))
    odds = []
    for i, rule in enumerate(training):
        raised = "".join(f" / (m_{c.column}_{c.top} / u_{c.column}_{c.top})" for c in linkage.comparisons if c.column in rule)
        odds.append(f"(rate{i} / (1 - rate{i}){raised})")
    prior = " + ".join(f"{o} / (1 + {o})" for o in odds)
    rates = ", ".join(f"fit{i}.rate as rate{i}" for i in range(len(training)))
    return f"""{_u(linkage)},{runs},
    means as (select u.*, {rates}, {', '.join(means)} from u, {fits}),
    model as (select least(greatest(({prior}) / {len(training)}, 1e-9), 0.5) as prior, {', '.join(_each(linkage, 'm') + _each(linkage, 'u'))} from means)"""


def _bits(c: Comparison, gamma: str, frequency: str) -> str:
    cases = " ".join(f"when {k} then log2(m_{c.column}_{k} / u_{c.column}_{k})" for k in range(c.top + 1))
    rarity = f" + (case when {gamma} = {c.top} then log2(u_{c.column}_{c.top} / {frequency}) else 0 end)" if c.term_frequency else ""
    return f"(case {gamma} {cases} else 0 end){rarity}"


def scored(linkage: Linkage) -> str:
    """CTE ``scored``: every blocked pair of profiles with its first rule, weight and probability under ``model``."""
    blocked = " union all ".join(
        f"select {i} as rule, a.profile_id as l, b.profile_id as r from prof a join prof b on {' and '.join(f'a.{c} = b.{c}' for c in rule)} and a.profile_id < b.profile_id"
        for i, rule in enumerate(linkage.rules))
    gammas = ", ".join(f"{level(c, f'a.{c.column}', f'b.{c.column}')} as gamma_{c.column}" for c in linkage.comparisons)
    frequencies = "".join(f", a.tf_{c.column}" for c in linkage.comparisons if c.term_frequency)
    weight = " + ".join(["log2(prior / (1 - prior))", *[_bits(c, f"gamma_{c.column}", f"tf_{c.column}") for c in linkage.comparisons]])
    return f"""blocked as ({blocked}),
    levelled as (select l as profile_id_l, r as profile_id_r, match_key{frequencies}, {gammas}
      from (select l, r, min(rule) as match_key from blocked group by 1, 2) join prof a on a.profile_id = l join prof b on b.profile_id = r),
    scored as (select *, 1 / (1 + pow(2.0::double, -({weight}))) as match_probability from levelled, model)"""


def clusters(linkage: Linkage, id_col: str, threshold: float) -> str:
    """CTE ``assigned``: ``id_col`` and ``cluster_id`` of every record."""
    same = " and ".join(f"o.{c} is not distinct from r.{c}" for c in linkage.columns)
    blocked = " or ".join("(" + " and ".join(f"p.{c} is not null" for c in rule) + ")" for rule in linkage.rules)
    own = " + ".join(["log2(prior / (1 - prior))", *[
        f"(case when p.{c.column} is not null then log2(m_{c.column}_{c.top} / u_{c.column}_{c.top})"
        + (f" + log2(u_{c.column}_{c.top} / p.tf_{c.column})" if c.term_frequency else "") + " else 0 end)" for c in linkage.comparisons]])
    return f"""linked as (select profile_id_l as a, profile_id_r as b from scored where match_probability >= {threshold}
      union all select profile_id_r, profile_id_l from scored where match_probability >= {threshold}),
    reach as (select a as node, a as label from linked union select l.b, r.label from reach r join linked l on l.a = r.node),
    named as (select node, min(label) as cluster_id from reach group by 1),
    own as (select p.*, ({blocked}) and 1 / (1 + pow(2.0::double, -({own}))) >= {threshold} as together from prof p, model),
    assigned as (select r.{id_col}, coalesce(n.cluster_id, case when o.together then o.profile_id end, r.{id_col}) as cluster_id
      from people r join own o on {same} left join named n on n.node = o.profile_id)"""
