"""The derived collections of ``annolake.sources.fixtures`` as DuckDB SQL; those that are read several times are made once."""

from __future__ import annotations

from annolake.schema import LABELS, valid_triples

WORDPUNCT = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+|\s+"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def hashed(text: str) -> str:
    return f"CAST('0x'||substr(md5({text}),1,6) AS BIGINT)"


LABEL_LIST = "[" + ", ".join(map(quoted, LABELS)) + "]"


def label_of(number: str) -> str:
    return f"({LABEL_LIST})[CAST(({number}) % 13 + 1 AS INT)]"


def tokenised(texts: str, pattern: str) -> str:
    """A query: paper_id, location, i, tok, s, e."""
    return f"""SELECT paper_id, location, CAST(i AS BIGINT) AS i, tok, e - length(tok) AS s, e FROM (SELECT *, CAST(sum(length(tok)) OVER (PARTITION BY paper_id, location ORDER BY i) AS BIGINT) AS e
 FROM (SELECT paper_id, location, unnest(l) AS tok, generate_subscripts(l, 1) - 1 AS i FROM (SELECT paper_id, location, regexp_extract_all(text, {quoted(pattern)}) AS l FROM {texts} WHERE text <> '')))"""


G, X, L = hashed("'g|'||lower(tok)"), hashed("'x|'||lower(tok)"), hashed("'l|'||lower(tok)")
PAIR_KEY = "paper_id||'|'||location||'|'||subject_start_idx||'|'||object_start_idx"
_valid: dict[tuple[str, str], list[str]] = {}
for _h, _t, _p in valid_triples():
    _valid.setdefault((_h, _t), []).append(_p)
VALID = ", ".join(f"({quoted(h)}, {quoted(t)}, [{', '.join(map(quoted, p))}])" for (h, t), p in _valid.items())

PREFIX = f"""WITH papers AS (SELECT CAST(doc_id AS VARCHAR) AS paper_id, split_part(text, chr(10), 1) AS title,
  CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END AS abstract FROM documents),
sections AS (SELECT paper_id, 'title' AS location, title AS text FROM papers UNION ALL SELECT paper_id, 'abstract', abstract FROM papers),
tokens AS MATERIALIZED ({tokenised('sections', WORDPUNCT)}),
words AS (SELECT *, lead(e) OVER (PARTITION BY paper_id, location ORDER BY i) AS ne FROM tokens WHERE length(tok) >= 4 AND regexp_full_match(tok, '[\\p{{L}}\\p{{N}}_]+')),
gold0 AS (SELECT paper_id, location, s AS start_idx, (CASE WHEN {X} % 4 = 0 THEN coalesce(ne, e) ELSE e END) - 1 AS end_idx, {label_of(L)} AS label,
  CASE WHEN {hashed("'n|'||lower(tok)")} % 11 = 0 THEN '-1' ELSE 'C'||lpad(CAST({hashed("'u|'||lower(tok)||'|'||(length(paper_id)+ascii(right(paper_id,1)))")} % 200 AS VARCHAR), 4, '0') END AS uri, lower(tok) AS word FROM words WHERE {G} % 5 = 0),
gold AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY location DESC, start_idx, end_idx) AS ord FROM gold0),
every AS (SELECT *, {hashed("m||'|'||paper_id||'|'||location||'|'||s")} AS h, {G} % 5 = 0 AS g, {X} % 4 = 0 AS x, {L} AS l FROM words, (SELECT unnest([0, 1, 2]) AS m)),
chosen AS (SELECT *, (CASE WHEN x AND NOT (h % 100 BETWEEN 8 AND 15) THEN coalesce(ne, e) ELSE e END) - 1 AS end_idx FROM every WHERE (g AND h % 100 < 80) OR (NOT g AND h % 100 < 3)),
pred0 AS (SELECT m, paper_id, location, s AS start_idx, end_idx, CASE WHEN h % 100 < 8 THEN {label_of('l + 1')} ELSE {label_of('l')} END AS label, (h % 1000) / 1000 AS confscore, 0 AS dup FROM chosen
  UNION ALL SELECT m, paper_id, location, s, end_idx, {label_of('l + 5')}, 0.5, 1 FROM chosen WHERE g AND h % 17 = 0),
pred AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY m, paper_id ORDER BY location DESC, start_idx, dup, end_idx) AS ord FROM pred0),
valid AS (SELECT * FROM (VALUES {VALID}) AS v(head, tail, predicates)),
forward AS (SELECT a.paper_id, a.location, a.start_idx AS subject_start_idx, a.end_idx AS subject_end_idx, a.label AS subject_label, a.ord AS subject_ord,
  b.start_idx AS object_start_idx, b.end_idx AS object_end_idx, b.label AS object_label, b.ord AS object_ord FROM gold a JOIN gold b ON a.paper_id = b.paper_id AND a.location = b.location AND a.ord < b.ord),
gated AS MATERIALIZED (SELECT f.*, v.predicates FROM forward f JOIN valid v ON f.subject_label = v.head AND f.object_label = v.tail),
gold_relations AS MATERIALIZED (SELECT * EXCLUDE (predicates), predicates[CAST({hashed(f"'p|'||{PAIR_KEY}")} % len(predicates) + 1 AS INT)] AS predicate FROM gated WHERE {hashed(f"'r|'||{PAIR_KEY}")} % 10 = 0),
pairs3 AS (SELECT *, {hashed(f"'q|'||m||'|'||{PAIR_KEY}")} AS h, {hashed(f"'r|'||{PAIR_KEY}")} % 10 = 0 AS r, {hashed(f"'p|'||{PAIR_KEY}")} AS p FROM gated, (SELECT unnest([0, 1, 2]) AS m)),
pred_relations AS MATERIALIZED (SELECT * EXCLUDE (predicates, h, r, p), predicates[CAST((p + CASE WHEN h % 100 < 10 THEN 1 ELSE 0 END) % len(predicates) + 1 AS INT)] AS predicate, (h % 1000) / 1000 AS confscore FROM pairs3 WHERE (r AND h % 100 < 80) OR (NOT r AND h % 100 < 2)),
gold_text AS (SELECT g.*, substr(s.text, g.start_idx + 1, g.end_idx - g.start_idx + 1) AS text_span FROM gold g JOIN sections s USING (paper_id, location)),
pred_text AS (SELECT g.*, substr(s.text, g.start_idx + 1, g.end_idx - g.start_idx + 1) AS text_span FROM pred g JOIN sections s USING (paper_id, location)),
dedup AS (SELECT * FROM pred QUALIFY row_number() OVER (PARTITION BY m, paper_id, location, start_idx, end_idx ORDER BY ord) = 1),
breaks AS (SELECT *, CASE WHEN start_idx < max(end_idx) OVER (PARTITION BY m, paper_id, location ORDER BY start_idx, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS brk FROM dedup),
clusters AS (SELECT *, sum(brk) OVER (PARTITION BY m, paper_id, location ORDER BY start_idx, ord) AS cl FROM breaks),
longest AS (SELECT m, paper_id, location, start_idx, end_idx, label, confscore, ord FROM clusters QUALIFY row_number() OVER (PARTITION BY m, paper_id, location, cl ORDER BY end_idx - start_idx DESC, start_idx, ord) = 1),
clean AS (SELECT * FROM longest WHERE list_contains({LABEL_LIST}, label))
"""
