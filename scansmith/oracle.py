"""DuckDB SQL that says what scans and rollups over the derived corpus return, made from the same catalogue."""

from __future__ import annotations

from collections.abc import Sequence

from scansmith import catalog as C
from scansmith.catalog import Pattern
from scansmith.corpus import corpus_sql


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _re2(p: Pattern) -> str:
    flags = "i" * p.fold + "s" * p.dotall
    return quoted((f"(?{flags})" if flags else "") + p.regex)


def _any(v: str, parts: Sequence[str]) -> str:
    return "(" + " OR ".join(f"contains({v}, {quoted(p)})" for p in parts) + ")"


_ENDS = " OR ".join(f"ends_with(lower(v), {quoted(e)})" for e in C.URL_NOISE_ENDINGS)
CHECKS = {
    "endpoint": f"length(v) >= 3 AND v NOT IN ({', '.join(map(quoted, C.NOISE_STRINGS))}) AND starts_with(v, '/') AND len(list_filter(string_split(v, '/'), lambda p: length(p) >= 2)) > 0 AND NOT regexp_matches(v, {quoted('|'.join(f'(?:{n})' for n in C.NOISE_ENDPOINTS))})",
    "url": f"length(v) >= 15 AND NOT {_any('lower(v)', [*C.NOISE_DOMAINS, 'undefined', 'null'])} AND NOT contains(v, '{{') AND NOT starts_with(lower(v), 'data:') AND NOT ({_ENDS})",
    "secret": f"length(v) >= 10 AND NOT {_any('lower(v)', C.SECRET_NOISE)}",
    "email": f"string_split(lower(v), '@')[-1] NOT IN ({', '.join(map(quoted, C.EMAIL_NOISE_DOMAINS))}) AND NOT {_any('lower(v)', C.EMAIL_NOISE)}",
    "file": f"length(v) >= 3 AND NOT {_any('lower(v)', C.FILE_NOISE)} AND NOT ends_with(lower(v), '.map') AND NOT (ends_with(lower(v), '.json') AND length(string_split(v, '/')[-1]) <= 7)",
    "sourcemap": "length(v) > 0 AND NOT starts_with(v, 'data:')",
    "over3": "length(v) > 3",
    "over2": "length(v) > 2",
    "nonempty": "length(v) > 0",
}
_MASKED = "CASE WHEN length(v) > 20 THEN substr(v, 1, 10) || '...' || right(v, 4) ELSE v END"
_SHORT = "CASE WHEN length(v) > 80 THEN substr(v, 1, 80) || '...' ELSE v END"


def _shown(p: Pattern) -> str:
    name = quoted(f"{p.prefix or p.label}: ")
    return {"plain": "v", "labelled": f"{name} || v", "masked": f"{name} || {_MASKED}", "short": f"{name} || {_SHORT}", "constant": f"{name} || {quoted(p.label or '')}"}[p.shown]


def pattern_sql(p: Pattern, docs: str = "docs", check: bool = True, extra: str = "") -> str:
    """The findings of one pattern: category, value, source, line, type, pass_ord, pat_ord, match_ord."""
    kind = "CORS Misconfiguration" if p.order == 22 else p.label
    rows = (
        f"SELECT source, i, trim(coalesce(g[i], ''), ' \t\n\r') AS v, w, s, s[i + 1] AS after FROM (SELECT source, regexp_extract_all(text, {_re2(p)}, 0) AS w, "
        f"regexp_extract_all(text, {_re2(p)}, {p.group}) AS g, string_split_regex(text, {_re2(p)}) AS s FROM {docs} WHERE {_any('low', p.needles)}), unnest(range(1, len(w) + 1)) AS t(i)"
    )
    before = "array_to_string(s[1:i], '') || array_to_string(w[1:i - 1], '')"
    return (
        f"SELECT {quoted(p.category)} AS category, {_shown(p)} AS value, source, CAST(1 + length({before}) - length(replace({before}, chr(10), '')) AS INTEGER) AS line, "
        f"{quoted(kind) if kind else 'CAST(NULL AS VARCHAR)'} AS type, {p.order} AS pass_ord, {p.ordinal} AS pat_ord, CAST(i - 1 AS INTEGER) AS match_ord, v AS raw{extra} "
        f"FROM ({rows}) WHERE {CHECKS[p.check] if check else 'true'}"
    )


def findings_sql(patterns: Sequence[Pattern], docs: str | None = None) -> str:
    """CTEs `docs`, `matches` and `findings` (first of each source, category and value)."""
    union = "\nUNION ALL ".join(pattern_sql(p) for p in patterns)
    return (
        f"WITH docs AS MATERIALIZED (SELECT source, text, lower(text) AS low FROM ({docs or corpus_sql(dialect='duckdb')})), matches AS ({union}), findings AS MATERIALIZED ("
        "SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY source, category, value ORDER BY pass_ord, pat_ord, match_ord) AS k FROM matches) WHERE k = 1)"
    )


def case_sql(key: str, table: dict[str, object], default: object) -> str:
    lit = lambda x: quoted(x) if isinstance(x, str) else str(x)
    return f"CASE {key} " + " ".join(f"WHEN {quoted(k)} THEN {lit(v)}" for k, v in table.items()) + f" ELSE {lit(default)} END"
