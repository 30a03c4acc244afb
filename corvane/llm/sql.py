"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from corvane.llm.url_filter import RULES, SOFT, SOFT_LIMIT, STRICT, TERMS

OP10 = r"""
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""


_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = (
    rf"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), "
    r"'[\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+'), lambda x: x <> '')"
)
OP9 = rf"""
WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS l, array_to_string(w[i : i + 9], ' ') AS g
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
places AS (
  SELECT doc_id, i, l, array_to_string(w[i : i + l - 1], ' ') AS g
  FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i
        FROM docs CROSS JOIN (SELECT DISTINCT l FROM windows) WHERE len(w) >= l)),
occ AS (SELECT doc_id, i, places.l, item_id FROM places JOIN windows USING (g)),
hit AS (
  SELECT doc_id, count(*) AS n_hit
  FROM (SELECT DISTINCT doc_id, unnest(range(i, i + l)) AS p FROM (SELECT DISTINCT doc_id, i, l FROM occ))
  GROUP BY doc_id),
ids AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::varchar AS id FROM occ WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)
"""


def _bounded(kind: str, weighted: bool = False) -> str:
    """Number of different terms of a class between boundaries, or the sum of their weights."""
    hit = r"regexp_matches(low, '(^|[^0-9a-z]){}([^0-9a-z]|$)')::int"
    return " + ".join(hit.format(t) + (f" * {w}" if weighted else "") for t, k, w in TERMS if k == kind)


def url_sql() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    return rf"""
WITH rules(h, p, v) AS (VALUES {rules}),
cut AS (
  SELECT page_id, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
         CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
parts AS (
  SELECT page_id, low,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM cut),
fit AS (
  SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY page_id)
SELECT page_id, host, path, rule,
       coalesce(v, CASE WHEN n_strict > 0 OR soft_weight >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END) AS verdict,
       n_strict::int AS n_strict, n_soft::int AS n_soft, soft_weight::double AS soft_weight
FROM (SELECT *, {_bounded(STRICT)} AS n_strict, {_bounded(SOFT)} AS n_soft, {_bounded(SOFT, True)} AS soft_weight FROM parts)
LEFT JOIN fit USING (page_id)
"""


ORACLES = {"op4_url_vocabulary": url_sql(), "op9_decontamination": OP9, "op10_chunk_recipes": OP10}
