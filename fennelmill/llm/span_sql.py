"""DuckDB SQL for spans of personal data and secrets, from the patterns as their contract states them."""

from __future__ import annotations


def found(kind: str, place: int, pattern: str, group: int = 0) -> str:
    """Two common tables: ``<kind>`` has ``doc_id, place, kind, value, part, s, e`` of each match in ``d (doc_id, t)``."""
    p = pattern.replace("'", "''")
    every = f"regexp_extract_all(t, '{p}')"
    return (
        f"{kind}_all AS (SELECT doc_id, unnest({every}) AS value, unnest(regexp_extract_all(t, '{p}', {group})) AS part, unnest((regexp_split_to_array(t, '{p}'))[1:len({every})]) AS gap, generate_subscripts({every}, 1) AS i FROM d),\n"
        f"{kind} AS (SELECT doc_id, {place} AS place, '{kind}' AS kind, value, part, CAST(sum(length(gap) + length(value)) OVER w - length(value) AS BIGINT) AS s, CAST(sum(length(gap) + length(value)) OVER w AS BIGINT) AS e FROM {kind}_all WINDOW w AS (PARTITION BY doc_id ORDER BY i))"
    )


def either_case(words: str) -> str:
    """A pattern whose ASCII letters match in either case, and no other letters."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in words)


WRITTEN = "coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place), '')"
_ASSIGN = f"({either_case('password|passwd|secret|token|api_?key')})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
_SOURCE = "d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS owner, concat_ws('/', source, lang) AS repository FROM documents)"

#: op10 with its default parameters.
SECRETS = rf"""
WITH {_SOURCE},
{found('assign', 0, _ASSIGN, 2)},
{found('access', 1, 'AKIA[A-Z0-9]+')},
{found('hex', 2, '[0-9a-f]+')},
{found('generic', 3, '[A-Za-z0-9+/_.=-]+')},
base AS (SELECT * FROM assign WHERE length(part) >= 12 UNION ALL SELECT * FROM access WHERE length(value) >= 18 UNION ALL SELECT * FROM hex WHERE length(value) >= 16),
c AS (SELECT * FROM base UNION ALL SELECT * FROM generic WHERE regexp_matches(value, '^[A-Za-z0-9+/_-]{{20,}}={{0,2}}$') AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[0-9]')),
parts AS (SELECT part, length(part) AS n, list_distinct(string_split(part, '')) AS chars FROM (SELECT DISTINCT part FROM c)),
random AS (SELECT part, list_sum(list_transform(list_transform(chars, lambda x: (n - length(replace(part, x, ''))) / n::DOUBLE), lambda p: -p * log2(p))) >= 3.0
    AND NOT regexp_matches(part, '(?i)example|sample|dummy|changeme|placeholder|your[_-]|xxxx|12345678|abcdefgh|00000000|test') AS is_random FROM parts),
held AS (SELECT part, count(DISTINCT owner) >= 3 OR count(DISTINCT (repository, owner)) >= 5 AS copied FROM c JOIN d USING (doc_id) GROUP BY 1),
j AS (SELECT c.*, is_random AND NOT copied AS live, copied FROM c JOIN random USING (part) JOIN held USING (part)),
spans AS (SELECT * FROM base UNION ALL SELECT doc_id, place, kind, value, part, s, e FROM j WHERE kind = 'generic' AND live AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = j.doc_id AND b.s < j.e AND b.e > j.s)),
x AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, {WRITTEN} AS base FROM base GROUP BY 1),
y AS (SELECT doc_id, {WRITTEN} AS spans FROM spans GROUP BY 1),
z AS (SELECT doc_id, count(*) FILTER (live) AS n_live, count(*) FILTER (copied) AS n_copied FROM j GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM d LEFT JOIN x USING (doc_id) LEFT JOIN y USING (doc_id) LEFT JOIN z USING (doc_id)
"""

_DIGITS = "regexp_replace(value, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN reverse({_DIGITS})[i]::INT WHEN reverse({_DIGITS})[i]::INT > 4 THEN reverse({_DIGITS})[i]::INT * 2 - 9 ELSE reverse({_DIGITS})[i]::INT * 2 END)) % 10 = 0"

#: The base spans of op9.
PERSONAL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
{found('email', 0, r'[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')},
{found('ip', 1, r'[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)')},
{found('card', 2, r'[0-9]([\x20-]?[0-9])+')},
{found('phone', 3, r'\+[0-9][\x20().0-9-]+[0-9]')},
base AS (SELECT * FROM email UNION ALL SELECT * FROM ip WHERE list_bool_and(list_transform(string_split(value, '.'), lambda p: length(ltrim(p, '0')) <= 3 AND coalesce(TRY_CAST(nullif(ltrim(p, '0'), '') AS INT), 0) <= 255))
  UNION ALL SELECT * FROM card WHERE length({_DIGITS}) BETWEEN 12 AND 19 AND {_LUHN} UNION ALL SELECT * FROM phone WHERE length({_DIGITS}) BETWEEN 9 AND 15),
x AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in ("email", "ip", "card", "phone"))}, {WRITTEN} AS base FROM base GROUP BY 1)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in ("email", "ip", "card", "phone"))}, sha256(coalesce(base, '')) AS base_sha256 FROM d LEFT JOIN x USING (doc_id)
"""
