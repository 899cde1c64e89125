"""SQL twins of the tier-R queries and of the RFC 2047 round trip (DuckDB dialect)."""

from __future__ import annotations

from maillake.operators.wishes import WORD_RE
from maillake.plans.oracle import ME_PRED, oracle
from maillake.plans.queries_wishes import SEARCH_TERMS


@oracle("activity_per_day")
def _():
    return """
WITH m AS (SELECT rowid, sender, CAST(date_sent AS DATE) AS day FROM messages),
s AS (SELECT sender AS address_id, day, count(*) AS sent FROM m GROUP BY 1, 2),
r AS (SELECT rc.address_id, m.day, count(*) AS received
      FROM recipients rc JOIN m ON rc.message_rowid = m.rowid WHERE rc.type IN (0, 1) GROUP BY 1, 2)
SELECT coalesce(s.address_id, r.address_id) AS address_id, coalesce(s.day, r.day) AS day,
       coalesce(s.sent, 0) AS sent, coalesce(r.received, 0) AS received
FROM s FULL OUTER JOIN r ON s.address_id = r.address_id AND s.day = r.day"""


@oracle("top_per_month")
def _():
    return """
WITH c AS (SELECT CAST(date_trunc('month', date_sent) AS DATE) AS month, sender, count(*) AS n
           FROM messages GROUP BY 1, 2)
SELECT month, sender, n, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY month ORDER BY n DESC, sender DESC) AS rank FROM c) t
WHERE rank <= 3"""


@oracle("mail_gaps")
def _():
    return """
WITH d AS (SELECT DISTINCT CAST(date_sent AS DATE) AS date FROM messages),
cal AS (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM d)
SELECT date FROM cal WHERE date NOT IN (SELECT date FROM d)"""


@oracle("missing_refs")
def _():
    return """
WITH r AS (SELECT rowid AS referenced_by,
                  CAST(sender AS VARCHAR) || '-' || strftime(CAST(date_sent AS DATE) - INTERVAL 1 MONTH, '%Y-%m') AS ref
           FROM messages WHERE starts_with(subject, 'Re: '))
SELECT DISTINCT ref, referenced_by FROM r
WHERE ref NOT IN (SELECT message_id FROM messages WHERE message_id IS NOT NULL)"""


@oracle("copies_me")
def _():
    return f"""
WITH mine AS (SELECT rowid FROM addresses WHERE {ME_PRED}),
pm AS (SELECT message_rowid, bool_or(type = 1) AS cc_me FROM recipients
       WHERE address_id IN (SELECT rowid FROM mine) GROUP BY 1)
SELECT m.sender, count(*) AS to_me, count(*) FILTER (WHERE pm.cc_me) AS cc_me,
       count(*) = count(*) FILTER (WHERE pm.cc_me) AS always
FROM pm JOIN messages m ON m.rowid = pm.message_rowid GROUP BY m.sender"""


@oracle("odd_hours")
def _():
    return """
WITH h AS (SELECT event_id, sender, CAST(hour(ts) AS DOUBLE) AS h FROM mail_events),
s AS (SELECT sender, avg(h) AS mu, stddev_samp(h) AS sd FROM h GROUP BY sender)
SELECT h.event_id FROM h JOIN s ON h.sender = s.sender
WHERE s.sd > 0 AND abs(h.h - s.mu) > 2.0 * s.sd"""


@oracle("fulltext_search")
def _():
    terms = ", ".join(f"'{t}'" for t in SEARCH_TERMS)
    rx = "(" + WORD_RE.replace("'", "''") + ")"
    return f"""
WITH tk AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{rx}', 1)) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tk WHERE term IN ({terms}) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
n AS (SELECT count(DISTINCT doc_id) AS n FROM documents),
sc AS (SELECT tf.doc_id, sum(tf.tf * ln(CAST(n.n AS DOUBLE) / df.df)) AS score
       FROM tf JOIN df ON tf.term = df.term, n GROUP BY tf.doc_id)
SELECT doc_id, round(score, 6) AS score FROM sc ORDER BY score DESC, doc_id LIMIT 10"""


@oracle("weekend_grid")
def _():
    return """
SELECT CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS ring, CAST(hour(ts) AS INTEGER) AS division,
       avg(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS mean, count(*) AS n
FROM mail_events GROUP BY 1, 2"""


@oracle("digest")
def _():
    return """
WITH f AS (SELECT rowid, subject FROM messages
           WHERE (contains(lower(subject), 'urgent') OR contains(lower(subject), 'high'))
             AND NOT contains(lower(subject), 're:')
             AND rowid NOT IN (SELECT rowid FROM messages WHERE date_sent < TIMESTAMP '1998-01-01 00:00:00'))
SELECT row_number() OVER (ORDER BY rowid) AS item, rowid, subject FROM f"""


@oracle("address_components")
def _():
    return """
WITH RECURSIVE e0 AS (SELECT DISTINCT m.sender AS src, r.address_id AS dst
                      FROM messages m JOIN recipients r ON r.message_rowid = m.rowid),
e AS (SELECT src, dst FROM e0 UNION SELECT dst, src FROM e0),
reach(node, label) AS (SELECT src, src FROM e UNION SELECT e.dst, r.label FROM reach r JOIN e ON e.src = r.node)
SELECT node, min(label) AS label FROM reach GROUP BY node"""


@oracle("rfc2047")
def _():
    return "SELECT doc_id, split_part(text, chr(10), 1) AS subject FROM documents"


@oracle("rfc2047_text")
def _():
    return "SELECT doc_id, text FROM documents"


@oracle("rfc2047_words")
def _():
    return "SELECT doc_id, text FROM documents"
