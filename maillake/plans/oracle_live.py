"""SQL twins of the live mail queries: the batch answer the stream must reach."""

from __future__ import annotations

from maillake.plans import oracle_pages, oracle_text  # noqa: F401 - their twins are used below
from maillake.plans import params as P
from maillake.plans.oracle import ORACLE, oracle
from maillake.plans.oracle_text import REQUESTS_SQL


@oracle("stream_mailbox")
def _():
    return """
SELECT '<' || CAST(rowid AS VARCHAR) || '@mail.example>' AS message_id, subject,
       date_sent + to_hours(CAST(rowid % 24 AS INTEGER)) AS date_utc, 'body' AS body
FROM messages"""


@oracle("stream_marks")
def _():
    # once a message is there it has its mark but for the moment after a clear
    return """
WITH e AS (SELECT CAST(user_id AS VARCHAR) AS id, ts, CAST(event_id AS VARCHAR) AS event,
                  CASE event_type WHEN 'error' THEN 'set' WHEN 'signup' THEN 'clear' ELSE 'mail' END AS kind FROM events),
s AS (SELECT *, count(*) FILTER (kind = 'mail') OVER w AS mails,
             last_value(CASE WHEN kind <> 'mail' THEN kind END IGNORE NULLS) OVER w AS command,
             last_value(CASE WHEN kind = 'mail' THEN event END IGNORE NULLS) OVER w AS arrived FROM e
      WINDOW w AS (PARTITION BY id ORDER BY ts, list_position(['mail', 'set', 'clear'], kind), event
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT id, CAST(ts AS VARCHAR) AS at, kind AS cause, CASE WHEN kind = 'mail' THEN event ELSE arrived END AS payload
FROM s WHERE (kind = 'mail' AND mails = 0 AND command IS DISTINCT FROM 'set') OR (kind = 'clear' AND mails > 0)"""


@oracle("stream_unread_adjusted")
def _():
    return """
WITH r AS (SELECT user_id * 100 + CAST(json_extract_string(props, '$.k') AS BIGINT) AS rowid, event_type AS mailbox, value, ts FROM events),
latest AS (SELECT rowid, arg_max(mailbox, ts) AS mailbox, arg_max(value, ts) AS value FROM r GROUP BY rowid),
m AS (SELECT mailbox, CASE WHEN rowid % 10 <> 0 THEN 'm' || CAST(rowid // 4 AS VARCHAR) END AS message_id, value < 5 AS removed,
             CASE WHEN value >= 60 THEN 1 WHEN value >= 50 THEN 2 ELSE 0 END AS flags FROM latest)
SELECT t.mailbox, count(*) FILTER (NOT removed) AS total_count, count(*) FILTER (NOT removed AND flags & 1 = 0) AS unseen_count,
       count(*) FILTER (NOT removed AND flags & 2 <> 0) AS deleted_count, count(*) FILTER (NOT removed AND flags = 0) AS unread_count,
       count(DISTINCT message_id) FILTER (NOT removed AND flags = 0)
         + count(*) FILTER (NOT removed AND flags = 0 AND message_id IS NULL AND m.mailbox IS NOT NULL) AS unread_count_adjusted_for_duplicates
FROM (SELECT DISTINCT mailbox FROM r) AS t LEFT JOIN m ON t.mailbox = m.mailbox GROUP BY t.mailbox"""


@oracle("stream_two_pass")
def _():
    return """
WITH to_ AS (SELECT DISTINCT r.message_rowid FROM recipients r JOIN addresses a ON r.address_id = a.rowid WHERE r.type = 0)
SELECT m.rowid, 'High' AS target_folder, CASE WHEN t.message_rowid IS NULL THEN 9 ELSE 10 END AS lines,
       '<' || CAST(m.rowid AS VARCHAR) || '@mail.example>' AS message_id
FROM messages m LEFT JOIN to_ t ON m.rowid = t.message_rowid WHERE m.priority = '2-HIGH' AND m.flags & 2 = 0"""


@oracle("stream_request_mail")
def _():
    size = "length('" + P.REPLY_TEMPLATE.replace("'", "''").replace("\n", "' || chr(10) || '") + "')"
    for key, value in (("%name%", "name"), ("%email%", "email"), ("%segment%", "segment"), ("%from_address%", f"'{P.RESPONDER_ADDRESS}'"),
                       ("%cc_address%", f"'{P.CC_ADDRESS}'")):
        size += f" + {P.REPLY_TEMPLATE.count(key)} * (length({value}) - {len(key)})"
    return REQUESTS_SQL + f"""
SELECT request_id, name, email, segment, status, CASE WHEN status = 'ok' THEN CAST({size} AS INTEGER) END AS reply_chars,
       CASE WHEN status = 'ok' THEN count(*) FILTER (WHERE status = 'ok') OVER (PARTITION BY email) END AS tallied FROM status"""


@oracle("discovery_files")
def _():
    return f"""
WITH h AS ({ORACLE["discovery_hits"]})
SELECT CASE WHEN privileged THEN 'priv' ELSE 'reg' END || '/s' || lpad(CAST(snum AS VARCHAR), 6, '0') || '.eml' AS name, message_id AS sha256,
       CASE WHEN privileged THEN 'priv' ELSE 'reg' END AS listed FROM h"""


@oracle("term_index_html")
def _():
    return f"""
WITH x AS ({ORACLE["term_index"]}),
p AS (SELECT term, unnest(string_split(pages, ',')) AS page, unnest(range(len(string_split(pages, ',')))) AS i FROM x)
SELECT term AS k, 0 AS i, '<h3>' || title || '</h3>' AS value FROM x
UNION ALL SELECT term, i + 1, '&nbsp;&nbsp;&nbsp;<a href=''page/' || page || '''>[page ' || page || ']</a> ' || coalesce(source, '?') || '<br>'
FROM p LEFT JOIN documents ON doc_id = CAST(page AS BIGINT)"""


@oracle("digest_bodies")
def _():
    named = " ".join(f"WHEN contains(lower(body), '{k}') THEN '{v}'" for k, v in P.PUBLICATIONS.items())
    return f"""
WITH m AS (SELECT page_id AS rowid, 'News ' || page_id || CASE WHEN page_id % 3 = 0 THEN ' (The Daily)' WHEN page_id % 7 = 0 THEN ' spam' ELSE '' END AS subject,
                  'see ' || url || ' for' || chr(10) || html AS body FROM pages)
SELECT row_number() OVER (ORDER BY rowid) AS item, rowid, subject,
       CASE WHEN rowid % 3 = 0 THEN 'The Daily' {named} ELSE lower(regexp_extract(body, 'https?://([^/:?#\\s"''<>]+)', 1)) END AS source, sha256(body) AS body_sha256
FROM m WHERE rowid % 5 <> 0 AND NOT contains(subject, 'spam')"""
