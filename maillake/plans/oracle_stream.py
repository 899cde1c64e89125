"""SQL twins of the streaming queries: the batch answer the stream must reach."""

from __future__ import annotations

from maillake.plans.oracle import oracle
from maillake.plans.oracle_text import REQUESTS_SQL

MAIL_ROWS = """
WITH mr AS (
  SELECT o_orderkey AS rowid,
         CASE WHEN o_orderkey % 10 = 0 THEN NULL
              ELSE CAST(o_custkey AS VARCHAR) || '-' || strftime(o_orderdate, '%Y-%m') END AS message_id,
         CASE WHEN o_orderkey % 3 = 0 THEN 'Re: ' ELSE '' END || o_orderpriority AS subject,
         o_orderpriority AS priority, o_orderdate AS date_sent,
         CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 ELSE 2 END AS flags,
         CAST(floor(o_totalprice) AS BIGINT) AS bytes
  FROM orders)"""


@oracle("stream_archive")
def _():
    return MAIL_ROWS + """
SELECT DISTINCT message_id,
       coalesce(message_id, '#' || sha256(concat_ws('|', subject, CAST(date_sent AS VARCHAR),
                                                    CAST(bytes AS VARCHAR)))) AS dedup_key
FROM mr WHERE flags & 2 = 0"""


@oracle("stream_triage")
def _():
    # mail that arrives deleted has no row; what a rule deletes goes to the trash
    return MAIL_ROWS + """
SELECT rowid,
       CASE WHEN priority = '5-LOW' THEN 'Trash'
            WHEN priority = '1-URGENT' THEN 'Urgent'
            WHEN starts_with(subject, 'Re: ') THEN 'Replies' ELSE 'INBOX' END AS target_folder,
       array_to_string(list_sort(list_filter(
           [CASE WHEN flags & 1 <> 0 THEN '\\Seen' END, CASE WHEN priority = '1-URGENT' THEN '\\Flagged' END,
            CASE WHEN priority = '5-LOW' THEN '\\Deleted' END], lambda x: x IS NOT NULL)), ',') AS flags,
       priority = '2-HIGH' AS wants_full
FROM mr WHERE flags & 2 = 0"""


@oracle("stream_counters")
def _():
    return """
WITH ev AS (SELECT user_id AS rowid, event_type AS mailbox, CASE WHEN value >= 50 THEN 1 ELSE 0 END AS flags,
                   event_type = 'error' AS removed, ts FROM events),
latest AS (SELECT rowid, arg_max(mailbox, ts) AS mailbox, arg_max(flags, ts) AS flags,
                  arg_max(removed, ts) AS removed FROM ev GROUP BY rowid)
SELECT t.mailbox, coalesce(c.total_count, 0) AS total_count, coalesce(c.unseen_count, 0) AS unseen_count,
       coalesce(c.deleted_count, 0) AS deleted_count, coalesce(c.unread_count, 0) AS unread_count
FROM (SELECT DISTINCT mailbox FROM latest) t LEFT JOIN (
  SELECT mailbox, count(*) AS total_count,
         count(*) FILTER (WHERE flags & 1 = 0) AS unseen_count,
         count(*) FILTER (WHERE flags & 2 <> 0) AS deleted_count,
         count(*) FILTER (WHERE flags & 1 = 0 AND flags & 2 = 0) AS unread_count
  FROM latest WHERE NOT removed GROUP BY mailbox) c ON t.mailbox = c.mailbox"""


@oracle("stream_requests")
def _():
    return REQUESTS_SQL + "\nSELECT request_id, email, name, segment, status FROM status"
