"""The similarity scores as SQL text, by the published definitions alone: the other side of the comparison for whatever uses them."""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict[str, str] = {}


def common_length(a: str, b: str) -> str:
    """Length of the longest common subsequence of two non-empty strings: a fold over the letters of one, each step a fold over those of the other."""
    letters = f"list_transform(string_split({b}, ''), lambda ch: [ord(ch)::BIGINT])"
    places = f"list_prepend([0::BIGINT], list_transform(range(1, length({a}) + 1), lambda j: [j, ord(substr({a}, j, 1))::BIGINT]))"
    step = "list_append(acc, CASE WHEN p[2] = ch[1] THEN row[p[1]] + 1 ELSE greatest(row[p[1] + 1], acc[p[1]]) END)"
    return f"list_last(list_reduce(list_prepend(list_transform(range(length({a}) + 1), lambda z: 0::BIGINT), {letters}), lambda row, ch: list_reduce({places}, lambda acc, p: {step})))"


def ratio(a: str, b: str) -> str:
    return f"CASE WHEN {a} = '' AND {b} = '' THEN 100.0::DOUBLE WHEN {a} = '' OR {b} = '' THEN 0.0::DOUBLE ELSE 200.0::DOUBLE * ({common_length(a, b)}) / (length({a}) + length({b})) END"


def _partial(s: str, t: str) -> str:
    """Best ratio of the shorter of two string columns with the windows of the longer one; s is the shorter one."""
    window = f"substr({t}, greatest(w, 0) + 1, least(length({t}), w + length({s})) - greatest(w, 0))"
    return f"list_max(list_transform(range(1 - length({s}), length({t})), lambda w: {ratio(s, window)}))"


def scored(pairs: str, weighted: bool = True) -> str:
    """CTEs from `pairs` (name of a CTE with a, b): `scores` (a, b, token_set, and weighted where asked for) of every distinct pair of non-empty strings."""
    words = lambda s: f"list_filter(string_split_regex({s}, '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+'), lambda x: x <> '')"
    out = f"""pair0 AS (SELECT DISTINCT a, b, {words('a')} AS ta, {words('b')} AS tb FROM {pairs} WHERE a <> '' AND b <> ''),
    pair1 AS (SELECT *, list_sort(list_distinct(list_intersect(ta, tb))) AS com, list_sort(list_distinct(list_filter(ta, lambda x: NOT list_contains(tb, x)))) AS ra, list_sort(list_distinct(list_filter(tb, lambda x: NOT list_contains(ta, x)))) AS rb FROM pair0),
    pair2 AS (SELECT *, array_to_string(com, ' ') AS c, array_to_string(list_concat(com, ra), ' ') AS fa, array_to_string(list_concat(com, rb), ' ') AS fb, array_to_string(list_sort(ta), ' ') AS sa, array_to_string(list_sort(tb), ' ') AS sb FROM pair1),
    pair3 AS (SELECT *, CASE WHEN len(ta) = 0 OR len(tb) = 0 THEN 0.0::DOUBLE WHEN len(com) > 0 AND (len(ra) = 0 OR len(rb) = 0) THEN 100.0::DOUBLE
        WHEN len(com) > 0 THEN greatest({ratio('fa', 'fb')}, 200.0::DOUBLE * length(c) / (length(c) + length(fa)), 200.0::DOUBLE * length(c) / (length(c) + length(fb))) ELSE {ratio('fa', 'fb')} END AS token_set FROM pair2)"""
    if not weighted:
        return out + ", scores AS (SELECT a, b, token_set FROM pair3)"
    # Distinct and sorted words of either side where none is common; the shorter string first.
    return out + f""",
    pair4 AS (SELECT *, greatest(length(a), length(b))::DOUBLE / least(length(a), length(b)) AS lengths, CASE WHEN length(a) <= length(b) THEN a ELSE b END AS s, CASE WHEN length(a) <= length(b) THEN b ELSE a END AS t,
        CASE WHEN length(sa) <= length(sb) THEN sa ELSE sb END AS ss, CASE WHEN length(sa) <= length(sb) THEN sb ELSE sa END AS st, CASE WHEN length(fa) <= length(fb) THEN fa ELSE fb END AS fs, CASE WHEN length(fa) <= length(fb) THEN fb ELSE fa END AS ft FROM pair3),
    pair5 AS (SELECT *, CASE WHEN lengths <= 8 THEN 0.9::DOUBLE ELSE 0.6::DOUBLE END AS scale, {ratio('a', 'b')} AS plain FROM pair4),
    scores AS (SELECT a, b, token_set, CASE WHEN lengths < 1.5 THEN greatest(plain, 0.95::DOUBLE * greatest({ratio('sa', 'sb')}, token_set))
        ELSE greatest(plain, scale * ({_partial('s', 't')}), 0.95::DOUBLE * scale * CASE WHEN len(com) > 0 THEN 100.0::DOUBLE WHEN len(ta) = len(list_distinct(ta)) AND len(tb) = len(list_distinct(tb)) THEN {_partial('ss', 'st')} ELSE greatest({_partial('ss', 'st')}, {_partial('fs', 'ft')}) END) END AS weighted FROM pair5)"""
