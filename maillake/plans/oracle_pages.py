"""SQL twins of the paged-document queries (DuckDB dialect)."""

from __future__ import annotations

from maillake.plans.oracle import oracle
from maillake.plans.queries_pages import IMPORT_LIMIT

ASSIGNED_SQL = """
WITH p AS (SELECT conv_id AS doc, turn AS page, role, text FROM conversations),
a AS (
  SELECT doc, page, role, text,
         max(CASE WHEN role = 'user' THEN page END) OVER (
           PARTITION BY doc ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS message_start
  FROM p),
assigned AS (SELECT * FROM a WHERE message_start IS NOT NULL),
msgs AS (
  SELECT doc, message_start, count(*) AS pages, string_agg(text, '' ORDER BY page) AS full_text
  FROM assigned GROUP BY doc, message_start)"""


def noun_runs_sql(text: str) -> str:
    """List of sorted distinct capitalised runs of ``text`` (the twin of pages.noun_runs)."""
    t = "regexp_replace(w, '^[^A-Za-z0-9]+|[^A-Za-z0-9]+$', '', 'g')"
    pdf = "regexp_matches(lower(w), '\\.pdf[^a-z0-9]*$')"
    cap = f"(i > 1 AND regexp_matches({t}, '^[A-Z][A-Za-z0-9''-]*$'))"
    mark = (f"CASE WHEN {pdf} AND {cap} THEN {t} || chr(2) WHEN {pdf} THEN chr(2) || chr(1) "
            f"WHEN {cap} THEN {t} ELSE chr(1) END")
    per_sentence = (f"list_transform(string_split_regex({text}, '[.!?]+\\s+'), lambda s: "
                    f"string_split_regex(array_to_string(list_transform("
                    f"string_split_regex(trim(s), '\\s+'), lambda w, i: {mark}), ' '), "
                    f"'\\s*\\x01\\s*'))")
    clean = ("trim(replace(replace(replace(replace(replace(replace(r, '|', ''), '‘', ''), "
             "'’', ''), '“', ''), '”', ''), '*', ' '))")
    runs = f"list_transform(list_filter(flatten({per_sentence}), lambda r: NOT contains(r, chr(2))), lambda r: {clean})"
    return f"list_sort(list_distinct(list_filter({runs}, lambda r: length(r) > 0)))"


@oracle("first_pages")
def _():
    return "SELECT conv_id AS doc, turn AS page FROM conversations WHERE role = 'user'"


@oracle("page_to_message")
def _():
    return ASSIGNED_SQL + "\nSELECT doc, message_start, pages, full_text FROM msgs"


@oracle("import_limit")
def _():
    return ASSIGNED_SQL + f""",
numbered AS (
  SELECT doc, message_start, row_number() OVER (ORDER BY doc, message_start) AS message_no
  FROM (SELECT DISTINCT doc, message_start FROM assigned) t)
SELECT a.doc, a.page, a.message_start FROM assigned a
JOIN numbered n ON a.doc = n.doc AND a.message_start = n.message_start
WHERE n.message_no < {IMPORT_LIMIT}"""


@oracle("term_index")
def _():
    return f"""
WITH forms AS (SELECT doc_id AS page, unnest({noun_runs_sql('text')}) AS form FROM documents),
tp AS (SELECT lower(form) AS term, page, max(form) AS form FROM forms GROUP BY 1, 2),
cnt AS (SELECT term, count(*) AS n_pages FROM tp GROUP BY term HAVING count(*) < 50)
SELECT tp.term, cnt.n_pages, arg_max(tp.form, tp.page) AS title,
       string_agg(CAST(tp.page AS VARCHAR), ',' ORDER BY tp.page) AS pages
FROM tp JOIN cnt ON tp.term = cnt.term GROUP BY tp.term, cnt.n_pages"""


GEOMETRY_SQL = """
WITH t AS (SELECT conv_id AS doc, turn AS page, role, text FROM conversations),
lines AS (SELECT doc, page, role, unnest(string_split(text, chr(10))) AS line,
                 unnest(range(len(string_split(text, chr(10))))) AS line_no FROM t),
words AS (SELECT doc, page, line_no, unnest(string_split(trim(line), ' ')) AS text,
                 unnest(range(len(string_split(trim(line), ' ')))) AS word_no FROM lines),
spans AS (SELECT doc, page, CAST(line_no * 100000 + word_no AS BIGINT) AS pos, text,
                 line_no * 12.0 AS y0, line_no * 12.0 + 10 AS y1 FROM words WHERE text <> ''),
links AS (SELECT doc, page, CAST(line_no AS BIGINT) AS pos,
                 CASE WHEN role = 'user' THEN 2 ELSE 1 END AS kind,
                 'mailto:' || role || CAST(doc AS VARCHAR) || '@chat.example' AS uri,
                 line_no * 12.0 + 2 AS y0, line_no * 12.0 + 6 AS y1 FROM lines),
lk AS (SELECT doc, page, pos AS link_pos, uri, (y0 + y1) / 2 AS mid FROM links
       WHERE kind = 2 AND starts_with(uri, 'mailto:')),
labelled AS (
  SELECT lk.doc, lk.page, lk.link_pos, replace(lower(arg_min(s.text, s.pos)), ':', '') AS label,
         replace(lk.uri, 'mailto:', '') AS address
  FROM lk JOIN spans s ON lk.doc = s.doc AND lk.page = s.page AND lk.mid BETWEEN s.y0 AND s.y1
  GROUP BY lk.doc, lk.page, lk.link_pos, lk.uri)"""


@oracle("link_labels")
def _():
    return GEOMETRY_SQL + "\nSELECT doc, page, link_pos, label, address FROM labelled"


@oracle("beside_label")
def _():
    return GEOMETRY_SQL + """,
lab AS (SELECT doc, page, min(pos) AS lpos, arg_min(y0, pos) AS y0, arg_min(y1, pos) AS y1
        FROM spans WHERE text = 'the' GROUP BY doc, page),
beside AS (SELECT s.doc, s.page, 'beside' AS kind, 'the' AS label,
                  string_agg(s.text, ' ' ORDER BY s.pos) AS value
           FROM spans s JOIN lab l ON s.doc = l.doc AND s.page = l.page AND s.y0 = l.y0 AND s.y1 = l.y1
           WHERE s.pos <> l.lpos GROUP BY s.doc, s.page),
fields AS (SELECT doc, page, 'links' AS kind, label, string_agg(address, ' ' ORDER BY link_pos) AS value
           FROM labelled GROUP BY doc, page, label)
SELECT * FROM beside UNION ALL SELECT * FROM fields"""


@oracle("message_keywords")
def _():
    return f"""
WITH kw AS (SELECT DISTINCT doc_id AS message_rowid, unnest({noun_runs_sql('text')}) AS keyword FROM documents),
ids AS (SELECT keyword, row_number() OVER (ORDER BY keyword) AS keyword_id
        FROM (SELECT DISTINCT keyword FROM kw) t)
SELECT ids.keyword_id, kw.keyword, kw.message_rowid FROM kw JOIN ids ON kw.keyword = ids.keyword"""
