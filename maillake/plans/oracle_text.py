"""SQL twins of the text / forms / merge queries (DuckDB dialect)."""

from __future__ import annotations

from maillake.plans import params as P
from maillake.plans.oracle import oracle

# Fixed values, written out apart from the operators' own patterns (searched, not anchored).
FORM_FIELD_RE = "[> ]*([a-zA-Z ]+): *(.*)"
EMAIL_RE = r"([._\-A-Za-z0-9_]+@[A-Za-z0-9_.\-]+)"
HTML_TAG_RE = """<[a-zA-Z/!?]([^'">]|"[^"]*"|'[^']*')*>"""
HTML_COMMENT_RE = "(?s)<!--.*?-->"
RAW_TEXT_SPLIT_RE = """(?i)<(?:script|style)\\b(?:[^'">]|"[^"]*"|'[^']*')*>|</(?:script|style)\\s*>"""
#: The references that the pages hold (``&amp;`` last).
HTML_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", "\u00a0"),
                 ("&copy;", "©"), ("&reg;", "®"), ("&middot;", "·"), ("&mdash;", "—"), ("&ndash;", "–"), ("&hellip;", "…"),
                 ("&amp;", "&")]
#: The characters of the data's languages that fold to ASCII; all others above 0x7F are dropped.
FOLDED = {"à": "a", "á": "a", "â": "a", "ä": "ae", "ç": "c", "è": "e", "é": "e", "ê": "e", "í": "i", "ñ": "n", "ó": "o",
          "ö": "oe", "ú": "u", "ü": "ue", "ß": "ss", "À": "A", "Á": "A", "Â": "A", "Ä": "Ae", "Ç": "C", "È": "E", "É": "E",
          "Ê": "E", "Í": "I", "Ñ": "N", "Ó": "O", "Ö": "Oe", "Ú": "U", "Ü": "Ue"}


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def py_strip(x: str) -> str:
    return f"regexp_replace({x}, '^[ \\t\\n\\r\\f\\x0B]+|[ \\t\\n\\r\\f\\x0B]+$', '', 'g')"


def norm_subject(x: str) -> str:
    return py_strip(f"replace(lower({x}), 're:', '')")


def ellipsis(x: str) -> str:
    return (f"CASE WHEN {x} IS NULL THEN '' WHEN length({x}) > 30 "
            f"THEN substr({x}, 1, 30) || '...' ELSE {x} END")


def unescape(x: str) -> str:
    for ent, ch in HTML_ENTITIES:
        x = f"replace({x}, {lit(ent)}, {lit(ch)})"
    return x


@oracle("discovery_hits")
def _():
    rx = lit("(?i)" + P.SEARCH_RE)
    pr = lit(P.PRIVILEGED_RE)
    return f"""
WITH hits AS (
  SELECT doc_id, regexp_extract(text, {rx}, 0) AS query, lang AS to_, CAST(NULL AS VARCHAR) AS cc_,
         source AS from_, split_part(text, chr(10), 1) AS subject, CAST(NULL AS VARCHAR) AS date,
         sha256(text) AS message_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS lines,
         'documents/' || CAST(doc_id AS VARCHAR) AS original_file
  FROM documents WHERE regexp_matches(text, {rx})),
kept AS (
  SELECT * FROM hits WHERE NOT coalesce(length(message_id) > 6, false)
  UNION ALL
  SELECT doc_id, query, to_, cc_, from_, subject, date, message_id, lines, original_file FROM (
    SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY doc_id) AS rn
    FROM hits WHERE length(message_id) > 6) t WHERE rn = 1)
SELECT row_number() OVER (ORDER BY doc_id) AS snum, query,
       {ellipsis('to_')} AS "to", {ellipsis('cc_')} AS cc, from_ AS "from", subject, date,
       message_id, lines, original_file,
       (coalesce(regexp_matches(to_, {pr}), false) OR coalesce(regexp_matches(from_, {pr}), false)
        OR coalesce(regexp_matches(cc_, {pr}), false)) AS privileged
FROM kept"""


@oracle("serials")
def _():
    return """
WITH dups AS (
  SELECT rowid FROM (
    SELECT rowid, max(rowid) OVER (PARTITION BY mailbox, message_id) AS keep
    FROM messages WHERE flags & 2 = 0 AND message_id IS NOT NULL) t WHERE rowid < keep)
SELECT mailbox, rowid, row_number() OVER (ORDER BY mailbox, rowid) AS snum
FROM messages WHERE rowid NOT IN (SELECT rowid FROM dups)"""


@oracle("normalized_subjects")
def _():
    return f"""
SELECT {norm_subject('subject')} AS normalized_subject, count(DISTINCT subject) AS subjects,
       count(*) AS messages
FROM messages GROUP BY 1"""


@oracle("star_load")
def _():
    return f"""
WITH flat AS (
  SELECT m.rowid, a.address AS sender_email, m.subject
  FROM messages m LEFT JOIN addresses a ON m.sender = a.rowid),
subj AS (SELECT subject, row_number() OVER (ORDER BY subject) AS subject_id
         FROM (SELECT DISTINCT subject FROM flat WHERE subject IS NOT NULL) t),
addr AS (SELECT sender_email, row_number() OVER (ORDER BY sender_email) AS sender_id
         FROM (SELECT DISTINCT sender_email FROM flat WHERE sender_email IS NOT NULL) t)
SELECT f.rowid, a.sender_id, s.subject_id, a.sender_email, s.subject,
       {norm_subject('s.subject')} AS normalized_subject
FROM flat f LEFT JOIN subj s ON f.subject = s.subject
LEFT JOIN addr a ON f.sender_email = a.sender_email"""


@oracle("mime_bodies")
def _():
    return "SELECT doc_id, 'text/plain' AS content_type, text FROM documents"


@oracle("parse_roundtrip")
def _():
    return """
WITH to_ AS (SELECT r.message_rowid, count(*) AS n_to FROM recipients r JOIN addresses a ON r.address_id = a.rowid
             WHERE r.type = 0 GROUP BY 1)
SELECT m.rowid, 'Sender ' || CAST(m.sender AS VARCHAR) AS from_name, a.address AS from_email,
       CAST(coalesce(t.n_to, 0) AS INTEGER) AS n_to, m.subject,
       m.date_sent + to_hours(CAST(m.rowid % 24 AS INTEGER)) AS date_utc,
       CASE WHEN m.rowid % 2 = 1 THEN 60 ELSE -300 END AS tz_offset_min,
       '<' || CAST(m.rowid AS VARCHAR) || '@mail.example>' AS message_id,
       CASE WHEN t.n_to IS NULL THEN 9 ELSE 10 END AS lines
FROM messages m LEFT JOIN addresses a ON m.sender = a.rowid LEFT JOIN to_ t ON m.rowid = t.message_rowid"""


REQUESTS_SQL = """
WITH req AS (
  SELECT c.c_custkey AS request_id,
         concat_ws(chr(10),
           CASE WHEN c.c_mktsegment = 'BUILDING' THEN '> Name:' ELSE '> Name: ' || c.c_name END,
           '> Email: ' || lower(replace(c.c_name, '#', '.')) || '@old.example.org',
           CASE WHEN c.c_acctbal >= 0 THEN 'Email: ' || c.c_name || ' <' || a.address || '>'
                ELSE 'Email:' END,
           'Segment: ' || c.c_mktsegment) AS body
  FROM customer c JOIN addresses a ON a.rowid = c.c_custkey),
lines AS (
  SELECT request_id, unnest(string_split(body, chr(10))) AS line,
         unnest(range(len(string_split(body, chr(10))))) AS pos
  FROM req),
kv AS (
  SELECT request_id, pos, lower(regexp_extract(line, {frx}, 1)) AS key,
         {val} AS value
  FROM lines WHERE regexp_matches(line, {frx})),
kv2 AS (
  SELECT request_id, pos, key,
         CASE WHEN key = 'email' THEN nullif(regexp_extract(value, {erx}, 1), '') ELSE value END AS value
  FROM kv WHERE value <> ''),
last AS (SELECT request_id, key, arg_max_null(value, pos) AS value FROM kv2 GROUP BY 1, 2),
fields AS (
  SELECT r.request_id,
         max(CASE WHEN key = 'email' THEN value END) AS email,
         max(CASE WHEN key = 'name' THEN value END) AS name,
         max(CASE WHEN key = 'segment' THEN value END) AS segment
  FROM req r LEFT JOIN last l ON r.request_id = l.request_id GROUP BY r.request_id),
status AS (
  SELECT *, CASE WHEN email IS NOT NULL AND name IS NOT NULL AND request_id NOT IN (
                       SELECT request_id FROM kv2 WHERE key = 'email' AND value IS NULL) THEN 'ok' ELSE 'error' END AS status
  FROM fields)""".format(frx=lit(FORM_FIELD_RE), erx=lit(EMAIL_RE),
                         val=py_strip(f"regexp_extract(line, {lit(FORM_FIELD_RE)}, 2)"))


@oracle("form_fields")
def _():
    return REQUESTS_SQL + "\nSELECT request_id, email, name, segment, status FROM status"


@oracle("reply_render")
def _():
    x = lit(P.REPLY_TEMPLATE)
    for key, val in [("name", "name"), ("email", "email"), ("segment", "segment"),
                     ("from_address", lit(P.RESPONDER_ADDRESS)),
                     ("sender_address", lit(P.RESPONDER_ADDRESS)),
                     ("cc_address", lit(P.CC_ADDRESS))]:
        x = f"replace({x}, '%{key}%', coalesce({val}, ''))"
    return REQUESTS_SQL + f"\nSELECT request_id, {x} AS reply FROM status WHERE status = 'ok'"


@oracle("first_email")
def _():
    e = lit(EMAIL_RE)
    return f"""
SELECT doc_id, regexp_extract(text, {e}, 1) AS email FROM documents
WHERE regexp_extract(text, {e}, 1) <> ''"""


@oracle("html_text")
def _():
    t = ("regexp_replace(replace(replace(html, '</div>', '</div>' || chr(10)), '<br', chr(10) || '<br'), "
         f"{lit(HTML_COMMENT_RE)}, '', 'g')")
    seg = unescape(f"regexp_replace(s, {lit(HTML_TAG_RE)}, '', 'g')")
    return f"""
SELECT page_id,
       CASE WHEN starts_with(html, '<html') OR starts_with(lower(html), '<!doctype html')
            THEN array_to_string(list_transform(string_split_regex({t}, {lit(RAW_TEXT_SPLIT_RE)}),
                   lambda s, i: CASE WHEN i % 2 = 0 THEN s ELSE {seg} END), '')
            ELSE html END AS text
FROM pages"""


@oracle("ascii_fold")
def _():
    x = "text"
    for ch, repl in FOLDED.items():
        x = f"replace({x}, {lit(ch)}, {lit(repl)})"
    return f"SELECT doc_id, regexp_replace({x}, '[^\\x00-\\x7F]', '', 'g') AS text FROM documents"


ADDRESSEES_SQL = """
WITH ad AS (
  SELECT c.c_custkey AS id, split_part(c.c_name, '#', 1) AS firstname,
         regexp_extract(c.c_name, '([^#]*)$', 1) AS lastname, a.address AS email,
         c.c_mktsegment AS segment
  FROM customer c JOIN addresses a ON a.rowid = c.c_custkey)"""


@oracle("mail_merge")
def _():
    to = "'\"' || firstname || ' ' || lastname || '\" <' || email || '>'"
    x = lit(P.MERGE_TEMPLATE)
    for f, v in sorted({"to": to, "from": lit(P.MERGE_DEFAULTS["from"]),
                        "firstname": "firstname"}.items()):
        x = f"replace({x}, '%{f}%', coalesce({v}, ''))"
    return ADDRESSEES_SQL + f"\nSELECT id, {x} AS body FROM ad"


@oracle("send_schedule")
def _():
    return ADDRESSEES_SQL + f"""
SELECT id, email, n,
       TIMESTAMP '{P.SEND_START}' + to_seconds(CAST({P.SEND_DELAY_SECONDS} * (n - 1) AS BIGINT)) AS send_at
FROM (SELECT id, email, row_number() OVER (ORDER BY id) AS n FROM ad) t"""
