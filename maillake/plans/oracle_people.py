"""SQL twins of the queries over people and the ways of mail."""

from __future__ import annotations

from maillake.plans import params as P
from maillake.plans.oracle import oracle


@oracle("persons")
def _():
    return """
WITH a AS (SELECT rowid, lower(address) AS address, CASE WHEN rowid % 10 = 0 THEN NULL ELSE rowid // 3 END AS name FROM addresses)
SELECT address, CASE WHEN name IS NULL THEN address ELSE min(address) OVER (PARTITION BY name) END AS person FROM a"""


@oracle("topic_people")
def _():
    return """
WITH s AS (SELECT m.priority AS topic, m.sender AS a, r.address_id AS b FROM messages m JOIN recipients r ON r.message_rowid = m.rowid),
p AS (SELECT priority AS topic, sender AS person FROM messages UNION SELECT topic, b FROM s),
l AS (SELECT a, b FROM s UNION SELECT b, a FROM s),
k AS (SELECT p.topic, p.person, count(*) AS linked FROM p JOIN l ON l.a = p.person JOIN p AS q ON q.topic = p.topic AND q.person = l.b GROUP BY 1, 2)
SELECT p.topic, p.person, n.people, coalesce(linked, 0) AS linked, n.people - 1 - coalesce(linked, 0) AS never_mailed
FROM p JOIN (SELECT topic, count(*) AS people FROM p GROUP BY 1) n ON n.topic = p.topic
LEFT JOIN k ON k.topic = p.topic AND k.person = p.person"""


@oracle("sender_networks")
def _():
    return """
WITH m AS (SELECT sender, CAST(date_trunc('month', date_sent) AS DATE) AS month, sender % 40 AS a, rowid % 200 AS b, rowid % 2 AS v6 FROM messages),
w AS (SELECT sender, month, CASE WHEN v6 = 1 THEN CASE WHEN a < 25 THEN '2001:db8:' || lower(hex(a)) || '::/48' END
             WHEN a >= 25 THEN '10.0.0.0/8' WHEN b >= 128 THEN '10.' || a || '.128.0/17' ELSE '10.' || a || '.0.0/16' END AS network FROM m),
c AS (SELECT sender, month, network, count(*) AS n FROM w WHERE network IS NOT NULL GROUP BY ALL),
d AS (SELECT sender, month, network FROM c QUALIFY row_number() OVER (PARTITION BY sender, month ORDER BY n DESC, network DESC) = 1)
SELECT sender, CAST(month AS VARCHAR) AS month, network,
       coalesce(lag(network) OVER (PARTITION BY sender ORDER BY month) <> network, false) AS moved FROM d"""


@oracle("hop_delays")
def _():
    def hop(at: int, to: int, late: int) -> str:
        return (f"SELECT rowid, {at} AS hop, 'r' || ((rowid * {to - 1}) % 5 + {(to - 1) * 10}) AS from_relay, "
                f"'r' || ((rowid * {to}) % 5 + {to * 10}) AS to_relay, CAST({late} AS DOUBLE) AS delay_s FROM messages")
    return hop(0, 3, 55) + " UNION ALL " + hop(1, 2, 40)


@oracle("calendar_entries")
def _():
    return """
SELECT doc_id, nullif(regexp_replace(text, '[\\r\\n]+', ' ', 'g'), '') AS summary,
       '20200101T' || lpad(CAST(doc_id % 24 AS VARCHAR), 2, '0') || '0000' AS dtstart, source AS location FROM documents"""


@oracle("suspicious_mail")
def _():
    domains = ", ".join(f"'{d}'" for d in P.SUSPICIOUS_DOMAINS)
    words = ", ".join(f"'{w}'" for w in P.SUSPICIOUS_WORDS)
    return f"""
WITH p AS (SELECT page_id, lower(regexp_extract(url, 'https?://([^/:?#]+)', 1)) AS host,
                  lower('see ' || url || ', then (' || url || ').' || chr(10) || html) AS text FROM pages)
SELECT page_id, 'url' AS kind, entry, 2 AS n FROM p, (SELECT unnest([{domains}]) AS entry) WHERE host = entry OR ends_with(host, '.' || entry)
UNION ALL
SELECT page_id, 'keyword', entry, (length(text) - length(replace(text, entry, ''))) // length(entry)
FROM p, (SELECT unnest([{words}]) AS entry) WHERE contains(text, entry)"""
