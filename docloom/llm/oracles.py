"""The registered corpus queries in DuckDB SQL, where SQL can express them.

Not here: learned rules (7, 10), merges and tokenizer files (4, 8, 9), XXH64 and components (6), keyed
permutations (5) and the pipeline. Tests hold those against brute force."""

from __future__ import annotations

from . import secret_scan, url_filter

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _spans() -> str:
    parts = []
    for n, rule in enumerate(secret_scan.RULES):
        p = rule.pattern.replace("'", "''")
        own = f"regexp_extract_all(t, '{p}', {rule.group})"
        parts.append(f"""SELECT r, {n} AS kind, '{rule.kind}' AS name, gaps[i] AS gap, length(hit[i]) AS n, length(own[i]) AS own, i,
            (list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hit[1:i-1], lambda x: length(x))), 0))::BIGINT AS start
            FROM (SELECT r, gaps, hit, own, unnest(range(1, len(hit) + 1)) AS i FROM (SELECT r, string_split_regex(t, '{p}') AS gaps, regexp_extract_all(t, '{p}') AS hit, {own} AS own FROM d WHERE regexp_matches(t, '{p}'))) WHERE length(own[i]) >= {rule.at_least}""")
    return " UNION ALL ".join(parts)


_BASE = len(secret_scan.BASE)
OP1 = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
s AS ({_spans()}),
g AS (SELECT r, {", ".join(f"count(*) FILTER (WHERE kind = {n}) AS n_{rule.kind}" for n, rule in enumerate(secret_scan.BASE))},
  string_agg(name || ':' || start || ':' || (start + n), ',' ORDER BY start, kind) FILTER (WHERE kind < {_BASE}) AS base,
  string_agg(name || ':' || start || ':' || (start + n), ',' ORDER BY start, kind) AS spans FROM s GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{rule.kind}, 0) AS n_{rule.kind}" for rule in secret_scan.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (r)"""

_RULES = sorted(url_filter.RULES, key=lambda r: (-len(r[0] + r[1]), r))


def _case(value) -> str:
    return "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{value(h, p, v)}'" for h, p, v in _RULES) + " END"


#: The list's entries in canonical form, all of them hosts.
_ENTRIES = ", ".join("'" + u.removeprefix("https://").removesuffix("/") + "'" for u in url_filter.LISTED)
OP2 = rf"""
WITH u AS (SELECT page_id, url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
c AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@|:(80|443)?$', '', 'g'), '^www\.', '') AS h, list_sort(list_filter(string_split(regexp_extract(coalesce(url, ''), '(?s)^[^#]*?://[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]*|gclid|fbclid|ref)(=|$)'))) AS q FROM u),
k AS (SELECT *, CASE WHEN h <> '' THEN h || regexp_replace(path, '/+$', '') || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END AS canonical, {_case(lambda h, p, v: h + p)} AS rule, {_case(lambda h, p, v: v)} AS ruled FROM c),
n AS (SELECT *, regexp_extract(canonical, '(?s)^[^/?]*') AS bare FROM k),
m AS (SELECT *, CASE WHEN rule IS NULL THEN coalesce(canonical IN ({_ENTRIES}) OR regexp_extract(canonical, '(?s)^[^?]*') IN ({_ENTRIES}) OR bare IN ({_ENTRIES})
  OR regexp_extract(bare, '(?:^|\.)([^.]*\.[^.]*)$', 1) IN ({_ENTRIES}) OR regexp_extract(bare, '(?:^|\.)((?:[^.]*\.){{2}}[^.]*)$', 1) IN ({_ENTRIES})
  OR regexp_extract(bare, '(?:^|\.)((?:[^.]*\.){{3}}[^.]*)$', 1) IN ({_ENTRIES}) OR regexp_extract(bare, '(?:^|\.)((?:[^.]*\.){{4}}[^.]*)$', 1) IN ({_ENTRIES}), false) END AS listed FROM n)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, listed FROM m"""

_W = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP3 = f"""
WITH i AS (SELECT item_id, {_W} AS w FROM benchmark WHERE item_id IS NOT NULL),
v AS MATERIALIZED (SELECT DISTINCT item_id, n, array_to_string(w[k:k+n-1], ' ') AS g FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS k FROM i WHERE len(w) > 0)),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_W} AS w FROM documents),
x AS (SELECT r, n, k, array_to_string(w[k:k+n-1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM v))),
h AS MATERIALIZED (SELECT r, n, k, item_id FROM x JOIN v USING (n, g)),
p AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS q FROM (SELECT DISTINCT r, k, n FROM h)) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS item_id FROM h) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, (coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w)) AS contaminated FROM d LEFT JOIN p USING (r) LEFT JOIN t USING (r)"""

ORACLES = {"op1_secret_scan": OP1, "op2_url_filter": OP2, "op3_decontamination": OP3}
