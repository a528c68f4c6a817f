"""The secret scan as DuckDB SQL, from the same patterns."""

from __future__ import annotations

from tessera.llm.secrets import BASE, KINDS


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def secret_scan_sql(scope: int = 200) -> str:
    parts = []
    for n, (kind, pattern, role) in enumerate(KINDS):
        p = _quoted(pattern)
        keep = "TRUE"
        value = f"regexp_extract_all(text, {p}, 2)" if n == 0 else f"regexp_extract_all(text, {p})"
        if n == 0:
            keep = "length(v[i]) >= 12"
        if n == 4:
            keep = "regexp_matches(v[i], '[0-9]') AND regexp_matches(v[i], '[A-Za-z]') AND (regexp_matches(v[i], '[A-Z]') OR regexp_matches(v[i], '[+/_-]') OR length(v[i]) >= 32)"
        parts.append(f"""
            SELECT doc_id, {n} AS kind, '{role}' AS role, start, start + length(m[i]) AS stop FROM (
                SELECT doc_id, m, v, i, CAST(list_sum(list_transform(g[1:i], lambda s: length(s))) + coalesce(list_sum(list_transform(m[1:i-1], lambda s: length(s))), 0) AS BIGINT) AS start
                FROM (SELECT doc_id, m, v, g, unnest(range(1, len(m) + 1)) AS i FROM (
                    SELECT doc_id, regexp_extract_all(text, {p}) AS m, {value} AS v, string_split_regex(text, {p}) AS g FROM t WHERE regexp_matches(text, {p})))
            ) WHERE {keep}""")
    name = "[" + ", ".join(_quoted(k) for k, _, _ in KINDS) + "][kind + 1]"
    counts = ", ".join(f"count(*) FILTER (kind = {n}) AS n_{k}" for n, (k, _, _) in enumerate(KINDS[:BASE]))
    return f"""
    WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    every AS ({" UNION ALL ".join(parts)}),
    base AS (SELECT * FROM every WHERE kind < {BASE}),
    part AS (SELECT * FROM base UNION ALL SELECT * FROM every w WHERE kind >= {BASE} AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = w.doc_id AND b.start < w.stop AND w.start < b.stop)),
    linked AS (SELECT * FROM part w WHERE kind >= {BASE} AND EXISTS (
        SELECT 1 FROM part o WHERE o.doc_id = w.doc_id AND o.role = CASE WHEN w.role = 'secret' THEN 'id' ELSE 'secret' END AND o.start < w.stop + {scope} AND w.start < o.stop + {scope})),
    shown AS (SELECT *, {name} || ':' || start || ':' || stop AS s FROM (SELECT * FROM base UNION ALL SELECT * FROM linked)),
    lists AS (SELECT doc_id, {counts}, coalesce(string_agg(s, ',' ORDER BY start, kind) FILTER (kind < {BASE}), '') AS base, string_agg(s, ',' ORDER BY start, kind) AS spans, count(*) FILTER (kind >= {BASE}) AS n_linked FROM shown GROUP BY doc_id)
    SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_linked, 0) AS n_linked
    FROM t LEFT JOIN lists USING (doc_id)
    """
