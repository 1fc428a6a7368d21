"""DuckDB SQL for the rows of the corpus queries that it can express."""

from __future__ import annotations

#: Levels of runs of 16 told in SQL: enough for 16 million rows a source and 65,536 sources.
_LEVELS, _TOPS = 6, 4


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of a text: a byte is xored in, then eight shifts follow, told apart by -1."""
    bits = f"flatten([[ord(ch), -1, -1, -1, -1, -1, -1, -1, -1] for ch in string_split({text}, '')])"
    step = "case when x >= 0 then xor(c, x) else xor(c >> 1, 3988292384 * (c & 1)) end"
    return f"xor(list_reduce({bits}, lambda c, x: {step}, 4294967295::bigint), 4294967295::bigint)"


def _leaf(text: str = "text") -> str:
    def told(value: str) -> str:
        return f"coalesce(strlen(cast({value} as varchar)) || ':' || {value}, '-')"

    return f"sha256({' || '.join(told(v) for v in ('doc_id', 'source', 'lang', 'n_chars', text))})"


def _tree(nodes: str, name: str, levels: int) -> tuple[str, str]:
    """CTEs of the levels above ``nodes(key, pos, n, h)``; the last one, ``{name}{levels}``, holds a node a key."""
    parts, below = [], nodes
    for k in range(1, levels + 1):
        several = f"n > {16 ** (k - 1)}"
        parts.append(
            f"""{name}s{k} as materialized (select key, pos, {several} as up,
                coalesce(string_agg(h, '') over (r rows between unbounded preceding and 1 preceding), '') as l,
                coalesce(string_agg(h, '') over (r rows between 1 following and unbounded following), '') as r
                from {below} window r as (partition by key, pos // 16 order by pos)),
            {name}{k} as materialized (select key, pos // 16 as pos, n,
                case when {several} then sha256(string_agg(h, '' order by pos)) else any_value(h) end as h
                from {below} group by key, pos // 16, n)"""
        )
        below = f"{name}{k}"
    return ", ".join(parts), below


def merkle() -> str:
    low, subroots = _tree("places", "a", _LEVELS)
    high, roots = _tree("tops", "b", _TOPS)
    joins = [(f"as{k}", "d", k) for k in range(1, _LEVELS + 1)] + [(f"bs{k}", "t", k) for k in range(1, _TOPS + 1)]
    joined = " ".join(f"join {s} on {s}.key = {of}.key and {s}.pos = {of}.pos // {16 ** (k - 1)}" for s, of, k in joins)
    siblings = " || ".join(f"{s}.l || {s}.r" for s, _, _ in joins)
    fold, folds = "coalesce(changed, leaf)", []
    for i, (s, _, _) in enumerate(joins):
        folds.append(f"f{i} as (select *, case when u{i} then sha256(l{i} || h || r{i}) else h end as h2 from {f'f{i - 1}_' if i else 'steps'}), f{i}_ as (select * exclude (h, h2), h2 as h from f{i})")
    shown = ", ".join(f"{s}.up as u{i}, {s}.l as l{i}, {s}.r as r{i}" for i, (s, _, _) in enumerate(joins))
    tampered = f"{_crc32('cast(doc_id as varchar)')} % 5 = 0"
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""with leaves as materialized (
        select doc_id, coalesce('+' || source, '') as key, {_leaf()} as leaf, case when {tampered} then {_leaf(lowered)} end as changed from documents),
    d as materialized (select *, row_number() over (partition by key order by doc_id nulls first, leaf) - 1 as pos,
        count(*) over (partition by key) as n from leaves),
    places as (select key, pos, n, leaf as h from d),
    {low},
    t as materialized (select '*' as key, key as of, h, row_number() over (order by key) - 1 as pos, count(*) over () as n from {subroots}),
    tops as (select key, pos, n, h from t),
    {high},
    steps as (select d.doc_id, d.leaf, t.h as subroot, z.h as root, sha256({siblings}) as proof_sha256, {fold} as h, {shown}
        from d join t on t.of = d.key join {roots} z on z.key = t.key {joined}),
    {', '.join(folds)}
    select doc_id, leaf, subroot, root, proof_sha256, h as folded_root, h = root as verified from f{len(joins) - 1}_"""


def collocations(least: int = 100, top: int = 2000) -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    grams = " union all ".join(
        f"select lang, array_to_string(w[i:i + {k - 1}], ' ') as phrase, {k} as size from pieces, unnest(range(1, len(w) - {k - 2})) as t(i)"
        for k in range(1, 6)
    )
    cuts = " union all ".join(
        f"""select lang, phrase, {k} as k, size, f as a, array_to_string(w[:{k}], ' ') as lp, array_to_string(w[{k + 1}:], ' ') as rp
            from candidates where size > {k}"""
        for k in range(1, 5)
    )
    return f"""with pieces as materialized (
        select lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda x: x <> '') as w from (
            select coalesce(lang, 'und') as lang, unnest(string_split_regex({lower}, '[.,;:!?\\n-\\r]')) as piece from documents)),
    totals as (select lang, sum(len(w)) as n from pieces group by lang),
    counts as materialized (select lang, phrase, size, count(*) as f from ({grams}) group by all having count(*) >= {least}),
    candidates as materialized (select *, string_split(phrase, ' ') as w from counts where size > 1),
    cuts as ({cuts}),
    scored as (select c.lang, c.phrase, c.k, c.a, l.f as l, r.f as r, t.n,
            (1000::hugeint * c.a * t.n) // (l.f::hugeint * r.f) as score
        from cuts c join counts l on l.lang = c.lang and l.phrase = c.lp join counts r on r.lang = c.lang and r.phrase = c.rp
        join totals t on t.lang = c.lang),
    least_cut as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
    covered as (select distinct lang, part as phrase, f from (
        select lang, f, unnest(flatten([[array_to_string(w[i:j], ' ') for j in range(i + 1, len(w) + 1) if j - i + 1 < len(w)] for i in range(1, len(w))])) as part
        from candidates)),
    kept as (select s.* from least_cut s anti join covered v on v.lang = s.lang and v.phrase = s.phrase and 100 * v.f >= 100 * s.a),
    ranked as (select lang, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank, phrase, a, l, r, n, score from kept)
    select lang, rank, phrase, a, l, r, cast(n as bigint) as n, cast(score as bigint) as score from ranked where rank <= {top}"""
