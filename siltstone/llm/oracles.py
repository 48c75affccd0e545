"""SQL for the operators that SQL can express, run by DuckDB on the same tables."""

from __future__ import annotations

from siltstone.llm import license, secrets

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = f"regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all({LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + least(2, len(w)) - 1), ' ') AS part FROM (SELECT *, unnest(range(1, greatest(len(w) - 2, 0) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.part = b.part AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 80 * (p.n + q.n - k)),
ties AS MATERIALIZED (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id, doc_id AS node FROM d UNION SELECT reach.doc_id, ties.y FROM reach JOIN ties ON ties.x = reach.node),
named AS (SELECT doc_id, min(node) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d JOIN named USING (doc_id) LEFT JOIN n USING (doc_id)
"""

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
b AS (SELECT item_id, {WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
windows AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(8, len(w)) AS size, array_to_string(list_slice(w, i, i + least(8, len(w)) - 1), ' ') AS part
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 8, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (SELECT doc_id, size, i, array_to_string(list_slice(w, i, i + size - 1), ' ') AS part FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes)),
hits AS (SELECT p.doc_id, p.size, p.i, x.item FROM places p JOIN windows x ON x.size = p.size AND x.part = p.part),
counted AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(len(items), 0) >= 2 AS contaminated
FROM d LEFT JOIN counted USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def _pattern(markup: str) -> str:
    """A template as a pattern over words that blanks stand around."""
    from siltstone.llm.decontam import words_of

    out = []
    for k, part in enumerate(license.MARKUP.split(markup)):
        if k % 2 == 0:
            out += [" " + word.decode() for word in words_of(part)]
        elif part == "beginOptional":
            out.append("(?:")
        elif part == "endOptional":
            out.append(")?")
        else:
            out.append("(?: [^ ]+){0,%s}" % dict(x.split("=", 1) for x in part.split(";")[1:]).get("max", "1"))
    return "".join(out) + " "


def licenses() -> str:
    phrases = " UNION ALL ".join(f"SELECT doc_id, i - 1 AS place, '{label}' AS label FROM placed WHERE " + " AND ".join(f"w[i + {n}] = '{word}'" for n, word in enumerate(phrase.split())) for phrase, label in license.PHRASES.items())
    accepted = " UNION ALL ".join(f"SELECT doc_id, '{label}' AS label, {rank} AS own FROM d WHERE regexp_matches(line, '{_pattern(markup)}')" for rank, found in ((2, license.TEXTS), (1, license.NOTICES)) for label, markup in found)
    return f"""
WITH d AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS line FROM (SELECT doc_id, {WORDS} AS w FROM documents)),
placed AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
base AS ({phrases}), accepted AS ({accepted}),
b AS (SELECT doc_id, count(*) AS n_base, min(at_) AS first_word, max(at_) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM (SELECT doc_id, place AS at_, label FROM base) GROUP BY doc_id),
a AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(own) AS own FROM (SELECT doc_id, label, 0 AS own FROM base UNION ALL SELECT doc_id, label, own FROM accepted) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN own = 2 THEN 1.0 WHEN own = 1 THEN 0.75 WHEN n_base > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score FROM d LEFT JOIN b USING (doc_id) LEFT JOIN a USING (doc_id)
"""


def secret_spans() -> str:
    def rows(rank: int, rule: secrets.Rule) -> str:
        p = rule.pattern.replace("'", "''")
        return f"SELECT doc_id, '{rule.kind}' AS kind, {rank} AS rank, {rule.least} AS least, unnest(list_transform(string_split_regex(t, '{p}'), lambda x: length(x))) AS gap, unnest(list_append(regexp_extract_all(t, '{p}'), NULL)) AS hit, unnest(list_append(regexp_extract_all(t, '{p}', {rule.group}), NULL)) AS core, unnest(list_append(regexp_extract_all(t, '{p}', {rule.span}), NULL)) AS part, generate_subscripts(string_split_regex(t, '{p}'), 1) AS n FROM d"

    parts = " UNION ALL ".join(rows(n, rule) for n, rule in enumerate(secrets.RULES))
    kinds = ", ".join(f"count(*) FILTER (kind = '{rule.kind}') AS n_{rule.kind}" for rule in secrets.BASE)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS ({parts}),
e AS (SELECT *, sum(gap + coalesce(length(hit), 0)) OVER (PARTITION BY doc_id, kind ORDER BY n) AS stop FROM m),
f AS (SELECT doc_id, kind, rank, kind || ':' || CAST(stop - length(part) AS BIGINT) || ':' || CAST(stop AS BIGINT) AS span, stop - length(part) AS start FROM e
  WHERE hit IS NOT NULL AND length(core) >= least)
SELECT d.doc_id, {kinds}, sha256(coalesce(string_agg(span, ',' ORDER BY start, rank) FILTER (rank < {len(secrets.BASE)}), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY start, rank), '') AS spans
FROM d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id
"""


def every() -> dict[str, str]:
    return {"op4_near_duplicates": NEAR_DUPLICATES, "op5_decontamination": DECONTAMINATION, "op9_licenses": licenses(), "op10_secrets": secret_spans()}
