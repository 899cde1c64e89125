"""SQL twins of the registered driver queries (DuckDB dialect).

The driver registers the raw tables as views; the mail views of
``maillake.sources.driver`` are restated here as CTEs so each SQL string is
self-contained.  Keys of ``ORACLE`` equal the keys of the Spark catalog.
"""

from __future__ import annotations

from maillake.plans import params as P


def _like_any(col: str, patterns) -> str:
    return "(" + " OR ".join(f"lower({col}) LIKE '{p.lower()}'" for p in patterns) + ")"


ME_PRED = f"({_like_any('address', P.ME)} AND NOT {_like_any('address', P.NOT_ME)})"
CUTOFF = f"(TIMESTAMP '{P.ASOF}' - INTERVAL {P.DAYS} DAY)"

VIEWS_SQL = """
messages AS (
  SELECT o.o_orderkey AS rowid,
         CASE WHEN o.o_orderkey % 10 = 0 THEN NULL
              ELSE CAST(o.o_custkey AS VARCHAR) || '-' || strftime(o.o_orderdate, '%Y-%m') END AS message_id,
         o.o_custkey AS sender,
         CASE WHEN o.o_orderkey % 3 = 0 THEN 'Re: ' ELSE '' END || o.o_orderpriority AS subject,
         o.o_orderdate AS date_sent,
         CAST(CASE o.o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 WHEN 'P' THEN 2 END AS INTEGER) AS flags,
         CAST(c.c_nationkey AS BIGINT) AS mailbox,
         CAST(floor(o.o_totalprice) AS BIGINT) AS bytes,
         o.o_orderpriority AS priority
  FROM orders o LEFT JOIN (SELECT c_custkey, max(c_nationkey) AS c_nationkey FROM customer GROUP BY c_custkey) c
    ON o.o_custkey = c.c_custkey),
addresses AS (
  SELECT c.c_custkey AS rowid,
         lower(replace(c.c_name, '#', '.')) || '@' || lower(n.n_name) || '.example.org' AS address,
         '' AS comment
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
  UNION ALL
  SELECT s.s_suppkey + 10000000 AS rowid,
         lower(replace(s.s_name, '#', '.')) || '@' || lower(n.n_name) || '.example.org' AS address,
         '' AS comment
  FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey),
recipients AS (
  SELECT l_orderkey AS message_rowid,
         CAST(CASE l_linestatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 END AS INTEGER) AS type,
         l_suppkey + 10000000 AS address_id,
         l_linenumber AS position,
         l_shipdate AS date_received
  FROM lineitem),
mailboxes AS (
  SELECT CAST(n_nationkey AS BIGINT) AS rowid, lower(n_name) AS url, CAST(NULL AS BIGINT) AS source FROM nation
  UNION ALL
  SELECT CAST(n_nationkey + 100 AS BIGINT), 'label/' || lower(n_name), CAST(n_nationkey AS BIGINT)
  FROM nation WHERE n_nationkey % 5 = 0),
mail_labels AS (
  SELECT rowid AS message_rowid, mailbox + 100 AS mailbox_id FROM messages
  WHERE priority = '1-URGENT' AND mailbox % 5 = 0),
mail_events AS (
  SELECT event_id, ts, user_id AS sender, event_type AS folder, value, props FROM events)
"""


def with_views(body: str) -> str:
    """Prefix the view CTEs; a body that starts with its own WITH list is merged in."""
    body = body.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return "WITH RECURSIVE " + VIEWS_SQL.strip() + ",\n" + body[15:]
    if body[:5].upper() == "WITH ":
        return "WITH " + VIEWS_SQL.strip() + ",\n" + body[5:]
    return "WITH " + VIEWS_SQL.strip() + "\n" + body


ORACLE: dict[str, str] = {}

# Date / timestamp output columns, rendered as ISO text like the Spark side
# (``catalog.dates_as_text``).
TEXT_COLUMNS = {
    "messages_per_day": ["date"], "message_listing": ["date"], "holiday_counts": ["day"],
    "epoch_dates": ["utc_ts", "utc_date"], "pdf_dates": ["parsed"], "internal_date": ["internal_date"],
    "activity_per_day": ["day"], "top_per_month": ["month"], "mail_gaps": ["date"],
    "since_date": ["internal_date"], "parse_roundtrip": ["date_utc"], "stream_mailbox": ["date_utc"], "send_schedule": ["send_at"],
}


def oracle(name: str):
    def deco(fn):
        body = fn()
        cols = TEXT_COLUMNS.get(name)
        if cols:
            repl = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in cols)
            body = f"SELECT * REPLACE ({repl}) FROM (\n{body.strip()}\n) AS _q"
        ORACLE[name] = with_views(body)
        return fn
    return deco


@oracle("top_senders")
def _():
    return f"""
SELECT a.address AS sender_email, CAST(count(*) AS BIGINT) AS n
FROM messages m LEFT JOIN addresses a ON m.sender = a.rowid
GROUP BY a.address ORDER BY n DESC, sender_email DESC NULLS LAST LIMIT {P.TOP_N}"""


@oracle("top_recipients")
def _():
    return f"""
SELECT a.address AS rcpt_email, CAST(count(*) AS BIGINT) AS n
FROM recipients r LEFT JOIN addresses a ON r.address_id = a.rowid
WHERE r.type IN (0, 1)
GROUP BY a.address ORDER BY n DESC, rcpt_email DESC NULLS LAST LIMIT {P.TOP_N}"""


@oracle("top_flows")
def _():
    return f"""
SELECT s.address AS src, d.address AS dst, CAST(count(*) AS BIGINT) AS n
FROM messages m JOIN recipients r ON r.message_rowid = m.rowid
LEFT JOIN addresses s ON m.sender = s.rowid
LEFT JOIN addresses d ON r.address_id = d.rowid
WHERE r.type IN (0, 1)
GROUP BY s.address, d.address
ORDER BY n DESC, src DESC NULLS LAST, dst DESC NULLS LAST LIMIT {P.TOP_FLOWS_N}"""


@oracle("header_counts")
def _():
    return """
SELECT header, value, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT 'from' AS header, a.address AS value FROM messages m LEFT JOIN addresses a ON m.sender = a.rowid
  UNION ALL SELECT 'subject', subject FROM messages
  UNION ALL SELECT 'to_cc', a.address FROM recipients r LEFT JOIN addresses a ON r.address_id = a.rowid
            WHERE r.type IN (0, 1)) u
GROUP BY header, value"""


@oracle("messages_per_day")
def _():
    return f"""
SELECT CAST(date_sent AS DATE) AS date, CAST(count(*) AS BIGINT) AS n
FROM messages
WHERE sender NOT IN (SELECT rowid FROM addresses WHERE {ME_PRED})
  AND date_sent > {CUTOFF}
GROUP BY 1"""


@oracle("message_listing")
def _():
    return f"""
SELECT m.rowid AS rowid, CAST(m.date_sent AS DATE) AS date, a.address AS address, m.subject AS subject
FROM messages m LEFT JOIN addresses a ON m.sender = a.rowid
WHERE m.date_sent > {CUTOFF}
ORDER BY date, m.rowid LIMIT {P.LISTING_N}"""


@oracle("my_addresses")
def _():
    return f"""
SELECT rowid, address, comment FROM addresses WHERE rowid IN (SELECT rowid FROM addresses WHERE {ME_PRED})"""


@oracle("folder_status")
def _():
    return """
SELECT mailbox, CAST(count(*) AS BIGINT) AS messages, CAST(sum(bytes) AS BIGINT) AS total_bytes,
       max(rowid) AS max_seq
FROM messages GROUP BY mailbox"""


@oracle("copy_totals")
def _():
    return """
SELECT mailbox,
       CAST(count(*) FILTER (WHERE flags & 2 = 0) AS BIGINT) AS copied,
       CAST(count(*) FILTER (WHERE flags & 2 <> 0) AS BIGINT) AS expunged,
       CAST(sum(CASE WHEN flags & 2 = 0 THEN bytes ELSE 0 END) AS BIGINT) AS bytes_copied
FROM messages GROUP BY mailbox"""


@oracle("timewheel_long")
def _():
    return """
SELECT CAST(isodow(ts) - 1 AS INTEGER) AS ring, CAST(hour(ts) AS INTEGER) AS division,
       CAST(count(*) AS BIGINT) AS n
FROM mail_events GROUP BY 1, 2"""


@oracle("timewheel_pivot")
def _():
    cols = ",\n  ".join(f"CAST(sum(CASE WHEN division = {i} THEN n END) AS BIGINT) AS d{i:02d}"
                        for i in range(24))
    return f"""
WITH grid AS (
  SELECT isodow(ts) - 1 AS ring, hour(ts) AS division, count(*) AS n FROM mail_events GROUP BY 1, 2)
SELECT CAST(ring AS INTEGER) AS ring,
  {cols}
FROM grid GROUP BY ring"""


@oracle("grid_scaled")
def _():
    return """
WITH grid AS (
  SELECT CAST(isodow(ts) - 1 AS INTEGER) AS ring, CAST(hour(ts) AS INTEGER) AS division,
         CAST(count(*) AS BIGINT) AS n FROM mail_events GROUP BY 1, 2),
b AS (SELECT min(n) AS lo, max(n) AS hi FROM grid)
SELECT ring, division, n, lo, hi,
       CASE WHEN hi = lo THEN 0.0 ELSE CAST(n - lo AS DOUBLE) / (hi - lo) END AS level
FROM grid, b"""


@oracle("dedup_keep_newest")
def _():
    return """
SELECT mailbox, message_id, rowid FROM (
  SELECT mailbox, message_id, rowid, max(rowid) OVER (PARTITION BY mailbox, message_id) AS keep
  FROM messages WHERE flags & 2 = 0 AND message_id IS NOT NULL) t
WHERE rowid < keep"""


@oracle("dup_running")
def _():
    return """
SELECT mailbox, message_id, rowid, is_dup,
       CAST(sum(CAST(is_dup AS BIGINT)) OVER (PARTITION BY mailbox ORDER BY rowid
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS seen_count
FROM (SELECT mailbox, message_id, rowid,
             rowid > min(rowid) OVER (PARTITION BY mailbox, message_id) AS is_dup
      FROM messages) t"""


MEMBERSHIP_SQL = """
WITH mem AS (
  SELECT m.mailbox AS mailbox_id, m.rowid, m.message_id, m.flags
  FROM messages m JOIN mailboxes b ON b.rowid = m.mailbox AND b.source IS NULL
  UNION ALL
  SELECT l.mailbox_id, m.rowid, m.message_id, m.flags
  FROM mail_labels l JOIN mailboxes b ON b.rowid = l.mailbox_id
  JOIN messages m ON m.rowid = l.message_rowid AND b.source = m.mailbox)"""


@oracle("mailbox_counters")
def _():
    return MEMBERSHIP_SQL + """
SELECT mailbox_id, CAST(count(*) AS BIGINT) AS total_count,
       CAST(count(*) FILTER (WHERE flags & 1 = 0) AS BIGINT) AS unseen_count,
       CAST(count(*) FILTER (WHERE flags & 2 <> 0) AS BIGINT) AS deleted_count,
       CAST(count(*) FILTER (WHERE flags & 1 = 0 AND flags & 2 = 0) AS BIGINT) AS unread_count
FROM mem GROUP BY mailbox_id"""


@oracle("unread_adjusted")
def _():
    return MEMBERSHIP_SQL + """
SELECT mailbox_id, CAST(count(*) AS BIGINT) AS unread_count,
       CAST(count(DISTINCT message_id) + count(*) FILTER (WHERE message_id IS NULL) AS BIGINT)
         AS unread_count_adjusted_for_duplicates
FROM mem WHERE flags & 1 = 0 AND flags & 2 = 0 GROUP BY mailbox_id"""


@oracle("orphan_addresses")
def _():
    return """
SELECT rowid, address, comment FROM addresses a
WHERE NOT EXISTS (SELECT 1 FROM messages m WHERE m.sender = a.rowid)
  AND NOT EXISTS (SELECT 1 FROM recipients r WHERE r.address_id = a.rowid)"""


@oracle("cascade_recipients")
def _():
    return """
SELECT message_rowid, type, address_id, position FROM recipients r
WHERE NOT EXISTS (SELECT 1 FROM messages m WHERE m.rowid = r.message_rowid AND m.flags & 2 <> 0)"""
