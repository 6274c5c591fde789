"""DuckDB's SQL for the queries that SQL can express."""

from __future__ import annotations

from corpusmill.llm.secrets import BASE, RULES, Rule


def _mix() -> str:
    return r"""
WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS k FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap FROM src),
b AS (SELECT *, sum(cap) OVER (ORDER BY cap / w, source NULLS LAST) - cap AS below, sum(w) OVER () - sum(w) OVER (ORDER BY cap / w, source NULLS LAST) + w AS weight, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM w),
t AS (SELECT source, source_size, least(cap, max((total - below) / weight) OVER () * w) AS target FROM b),
r AS (SELECT s.doc_id, s.size, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS budget,
    CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id ROWS UNBOUNDED PRECEDING) - s.size AS BIGINT) AS before FROM sized s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM r)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - before)) AS BIGINT) AS taken FROM e"""


def _secrets() -> str:
    def spans(i: int, r: Rule) -> str:
        pattern = ("(?i)" if r.fold else "") + r.pattern
        lit = "'" + pattern.replace("'", "''") + "'"
        m, gaps = f"regexp_extract_all(t, {lit})", f"string_split_regex(t, {lit})"
        group = f"regexp_extract_all(t, {lit}, {r.group})" if r.group else "m"
        return (
            f"SELECT doc_id, {i} AS ord, '{r.kind}' AS kind, unnest(list_transform(range(1, len(m) + 1), lambda i: "
            "{'s': list_sum(list_transform(gaps[1:i], lambda g: len(g))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: len(x))), 0), 'n': len(m[i]), 'g': len(g[i])})) AS x "
            f"FROM (SELECT doc_id, m, gaps, {group} AS g FROM (SELECT doc_id, t, {m} AS m, {gaps} AS gaps FROM docs))"
        )

    each = " UNION ALL ".join(f"SELECT doc_id, ord, kind, x.s AS s, x.s + x.n AS e FROM ({spans(i, r)}) WHERE x.g >= {r.min_length}" for i, r in enumerate(RULES))
    item = "kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT)"
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in BASE)
    return (
        f"WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), found AS ({each}) "
        f"SELECT d.doc_id, {counts}, sha256(coalesce(string_agg({item}, ',' ORDER BY s, ord) FILTER (WHERE ord < {len(BASE)}), '')) AS base_sha256, "
        f"coalesce(string_agg({item}, ',' ORDER BY s, ord), '') AS spans FROM docs d LEFT JOIN found f USING (doc_id) GROUP BY d.doc_id"
    )


SQL = {"op3_source_mixing": _mix(), "op5_secret_scan": _secrets()}
