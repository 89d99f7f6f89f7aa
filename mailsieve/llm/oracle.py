"""DuckDB SQL for the queries that it can express."""

from __future__ import annotations

from mailsieve.llm import quality as R

WORDS = r"list_filter(string_split_regex({0}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_P = range(len(R.FEATURES))
_PAIRS = [(i, j) for i in _P for j in range(i + 1)]


def _distance(e: str) -> str:
    """Squared distance of v.x0.. from the estimate ``e``, by forward substitution; ``y`` columns come before."""
    steps = []
    for i in _P:
        rest = f"(v.{R.FEATURES[i]} / {R.STEP}.0 - {e}.m_{i})" + "".join(f" - {e}.l_{i}_{j} * ({steps[j]})" for j in range(i))
        steps.append(f"({rest}) / {e}.l_{i}_{i}")
    return " + ".join(f"({y}) * ({y})" for y in steps)


def _covariance(rows: str, keys: str, grow: float, floors: tuple[float, ...], also: str = "") -> str:
    """Means and covariances, floors included, of the rows with the same keys."""
    sums = [f"sum({x}::hugeint)::double / count(*) / {R.STEP} as m_{i}" for i, x in enumerate(R.FEATURES)]
    sums += [f"sum({R.FEATURES[i]}::hugeint * {R.FEATURES[j]})::double / count(*) / {R.STEP**2} as s_{i}_{j}" for i, j in _PAIRS]
    spread = [f"{grow!r} * (s_{i}_{j} - m_{i} * m_{j}) + {floors[i] ** 2 if i == j else 0.0!r} as v_{i}_{j}" for i, j in _PAIRS]
    return f"select * exclude ({', '.join(f's_{i}_{j}' for i, j in _PAIRS)}), {', '.join(spread)} from (select {keys}, {also} {', '.join(sums)} from {rows} group by {keys})"


def _factored(rows: str, floors: tuple[float, ...]) -> str:
    """The rows of a query with the Cholesky factor of their v_i_j, one column after the other, and its volume."""
    for i, j in _PAIRS:
        value = f"v_{i}_{j}" + "".join(f" - l_{i}_{k} * l_{j}_{k}" for k in range(j))
        value = f"sqrt(greatest({value}, {floors[i] ** 2!r}))" if i == j else f"({value}) / l_{j}_{j}"
        rows = f"select *, {value} as l_{i}_{j} from ({rows})"
    return f"select *, l_0_0 * l_1_1 * l_2_2 * l_3_3 as volume from ({rows})"


def robust_outliers(floors=(0.08, 0.04, 0.06, 0.06), support=0.75, steps=30, min_rows=50, cut=R.CHI_9999) -> str:
    angle = lambda part, whole: f"asin(sqrt(least(1.0, {part} / greatest({whole}, 1)::double)))"
    vector = [
        "ln(greatest(word_chars, 1) / greatest(n_words, 1)::double)", angle("n_symbols", "word_chars"), angle("n_dup_lines", "n_lines"),
        angle("n_repeat_words", "n_words"),
    ]
    xs, ms, ls = ", ".join(R.FEATURES), ", ".join(f"m_{i}" for i in _P), ", ".join(f"l_{i}_{j}" for i, j in _PAIRS)
    near = lambda e: f"round(256 * ln(1 + {_distance(e)}))::int"
    medians = ", ".join(f"quantile_cont({x}, 0.5) as c_{i}" for i, x in enumerate(R.FEATURES))
    spreads = ", ".join(f"quantile_cont(abs({x} - c_{i}), 0.5) as d_{i}" for i, x in enumerate(R.FEATURES))
    centres = ", ".join(f"any_value(c_{i}) / {R.STEP}.0 as m_{i}" for i in _P)
    plain = ", ".join(f"pow(greatest(1.4826 * d_{i} / {R.STEP}.0, {floors[i]}), 2) as v_{i}_{j}" if i == j else f"0.0::double as v_{i}_{j}" for i, j in _PAIRS)
    turned = ", ".join(f"case when r > 0 then round(({x} / {R.STEP}.0 - m_{i}) / l_{i}_{i} / r * {R.STEP})::bigint else 0 end as {x}" for i, x in enumerate(R.FEATURES))
    scaled = ", ".join(f"4 * t.v_{i}_{j} * p.l_{i}_{i} * p.l_{j}_{j} + {floors[i] ** 2 if i == j else 0.0!r} as v_{i}_{j}" for i, j in _PAIRS)
    errors = ("0.3 / greatest(n_words, 1)", "0.25 / greatest(word_chars, 1)", "0.25 / greatest(n_lines, 1)", "2.0 / greatest(n_words, 1)")
    own = ", ".join(f"v_{i}_{j} + ({errors[i]})::double as v_{i}_{j}" if i == j else f"v_{i}_{j}" for i, j in _PAIRS)
    return f"""
with recursive texts as (select row_number() over () as rid, doc_id, coalesce(lang, null) as lang, source, coalesce(text, '') as t from documents
), split as (select *, {WORDS.format('t')} as w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines from texts
), windows as (select rid, i, array_to_string(w[i:i + 7], ' ') as win from (select rid, w, unnest(range(1, len(w) - 6)) as i from split)
), starts as (select rid, i from (select rid, i, count(*) over (partition by rid, win) as n from windows) where n > 1
), covered as (select rid, sum(least(8, i - before)) as n from (
        select rid, i, coalesce(lag(i) over (partition by rid order by i), i - 8) as before from starts) group by rid
), base as (select s.rid, doc_id, t, len(w)::bigint as n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::bigint as word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, len(lines) as n_lines,
        (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(c.n, 0)::bigint as n_repeat_words,
        coalesce('=' || lang, '-') as lang_key, coalesce('=' || lang, '-') || chr(31) || coalesce('=' || source, '-') as own
    from split s left join covered c on c.rid = s.rid
), judged as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
        {', '.join(f'round({x} * {R.STEP})::bigint as {n}' for n, x in zip(R.FEATURES, vector))} from base
), once as (select distinct lang_key, own, t, {xs} from judged where not base_failed
), groups as (select own, case when count(*) >= {min_rows} then own else any_value(lang_key) || chr(30) end as grp,
        case when count(*) >= {min_rows} then 'source' else 'language' end as level from once group by own
), vectors as (select distinct grp, t, {xs} from once join groups on groups.own = once.own
), enough as (select grp from vectors group by grp having count(*) >= {min_rows}
), centre as (select grp, {medians} from vectors group by grp
), plain as ({_factored(f"select grp, 0 as start, {ms}, {plain} from (select v.grp, {centres}, {spreads} from vectors v join centre on centre.grp = v.grp group by v.grp)", floors)}
), seen as (select v.*, {', '.join(f'p.m_{i}' for i in _P)}, {', '.join(f'p.l_{i}_{j}' for i, j in _PAIRS)}, {near('p')} as d, sqrt({_distance('p')}) as r
    from vectors v join plain p on p.grp = v.grp
), turned as (select grp, {turned} from seen
), half as (select grp, {xs} from (select *, quantile_cont(d, 0.5) over (partition by grp) as bound from seen) where d <= bound
), turns as (select t.grp, 1 as start, {', '.join(f'p.m_{i}' for i in _P)}, {scaled}
    from ({_covariance('turned', 'grp', 1.0, (0.0,) * 4)}) t join plain p on p.grp = t.grp
), moves as (
    select grp, start, 0 as step, 'inf'::double as volume, {ms}, {ls} from plain
    union all select grp, 1, 0, 'inf'::double, {ms}, {ls} from ({_factored('select * from turns', floors)})
    union all select grp, 2, 0, 'inf'::double, {ms}, {ls} from ({_factored(_covariance('half', 'grp', 1.0, floors), floors)})
), paths as (
    select * from moves
    union all
    select grp, start, step, volume, {ms}, {ls} from ({_factored(_covariance(f"""(
        select *, quantile_cont(d, {support}) over (partition by grp, start) as bound from (
            select v.*, e.start, e.step, e.volume as before, {near('e')} as d from vectors v join paths e on e.grp = v.grp))
        where d <= bound""", 'grp, start', R.GROW_75, floors, 'any_value(step) + 1 as step, any_value(before) as before,'), floors)})
    where volume < before * (1 - {R.FALL!r}) and step <= {steps}
), best as (select * from paths where step > 0 qualify row_number() over (partition by grp order by volume, start) = 1
), inside as (select v.* from vectors v join best e on e.grp = v.grp where {_distance('e')} <= {R.CHI_975}
), fitted as ({_covariance('inside', 'grp', R.GROW_975, floors)}
), known as (select own, level, {ms}, {', '.join(f'v_{i}_{j}' for i, j in _PAIRS)} from groups join enough using (grp) join fitted using (grp)
), placed as (select j.*, level, {ms}, {own} from judged j left join known on known.own = j.own
), measured as ({_factored('select * from placed', floors)})
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    not base_failed and coalesce({_distance('v')} <= {cut}, true) as kept,
    case when base_failed then 'base' else coalesce(level, 'none') end as judged_by
from measured v
"""


ORACLE: dict[str, str] = {
    "op2_bbit_minhash": r"""
with recursive texts as (
    select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
    from documents
), sets as (
    select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
        else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s
    from texts
), items as (select distinct doc_id, unnest(s) as x from sets where doc_id is not null
), sizes as (select doc_id, count(*) as n from items group by doc_id
), shared as (
    select a.doc_id as a, b.doc_id as b, count(*) as n from items a join items b on a.x = b.x and a.doc_id < b.doc_id group by all
), links as (
    select a, b from shared join sizes p on p.doc_id = a join sizes q on q.doc_id = b where 100 * shared.n >= 75 * (p.n + q.n - shared.n)
), both_ways as (select a, b from links union all select b, a from links
), reach as (
    select distinct a as node, a as other from both_ways
    union
    select r.node, e.b from reach r join both_ways e on e.a = r.other
), least as (select node, min(other) as component_id from reach group by node)
select t.doc_id, len(s)::bigint as n_shingles, coalesce(component_id, t.doc_id) as component_id,
    coalesce(coalesce(component_id, t.doc_id) = t.doc_id, true) as kept
from sets t left join least on node = t.doc_id
    """,
    "op3_robust_outliers": robust_outliers(),
    "op5_prefix_tree_chat": r"""
        with rows as (
            select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
            union all select -7, turn, role, '\### Assistant: </turn> ok' from (values (0, 'user'), (1, 'assistant')) v(turn, role)
        ), formatted as (
            select *, '### ' || replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), ':', '\:')
                || ':' || chr(10) || replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>')
                || '</turn>' || chr(10) as shown
            from rows
        )
        select conv_id, count(*) as n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
            coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
            sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
            sum(length(shown))::bigint as formatted_chars
        from formatted group by conv_id
    """,
    "op8_int8_blocks": """
        with good as (
            select vec_id, embedding::double[] as v from embeddings
            where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
                and len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), scored as (
            select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v) as score
            from good q join good c on q.vec_id % 20 = 0 and c.vec_id <> q.vec_id and len(c.v) = len(q.v)
        ), ranked as (
            select query_id, row_number() over (partition by query_id order by score desc, vec_id)::integer as rank, vec_id, score from scored
        )
        select query_id, rank, vec_id, score from ranked where rank <= 20
    """,
    "op13_shared_lists": """
        with good as (
            select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
                list_transform(embedding::double[], lambda x: floor(256 * x)) as v
            from embeddings
            where vec_id is not null and label is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), scored as (
            select a.vec_id as anchor_id, c.vec_id as other_id, a.label = c.label as alike,
                case when len(a.v) = 0 then 0 else list_inner_product(a.v, c.v) end::bigint as score
            from good a join good c on a.vec_id % 100 = 0 and len(c.v) = len(a.v)
        ), positives as (
            select anchor_id, other_id as positive_id, score as positive_score from scored where alike and other_id <> anchor_id
            qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5
        )
        select p.anchor_id, positive_id, row_number() over best::integer as rank, other_id as negative_id, positive_score, score as negative_score
        from positives p join scored s on s.anchor_id = p.anchor_id and not alike and 80 * positive_score <= 100 * score and score <= positive_score
        window best as (partition by p.anchor_id, positive_id order by score desc, other_id)
        qualify row_number() over best <= 5
    """,
}
