"""SQL twins of the contacts / geo / dates / report queries (DuckDB dialect)."""

from __future__ import annotations

import math

from maillake.plans.oracle import oracle
from maillake.plans.queries_misc import ARCHIVED_BEFORE, HOLIDAYS


@oracle("best_contact")
def _():
    return """
WITH c AS (SELECT c_custkey, c_name, c_mktsegment, c_acctbal, c_nationkey,
                  (c_mktsegment = 'AUTOMOBILE' AND c_acctbal < 0) AS unnamed FROM customer),
rec1 AS (SELECT c_custkey AS pk,
                CASE WHEN unnamed THEN NULL ELSE split_part(c_name, '#', 1) END AS first,
                CASE WHEN unnamed THEN NULL ELSE c_mktsegment || '-' || CAST(c_nationkey AS VARCHAR) END AS last
         FROM c),
per_order AS (
  SELECT o_custkey AS owner, o_orderkey AS seq,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'c' || o_custkey || '@gmail.example.com'
                              WHEN '2-HIGH' THEN 'c' || o_custkey || '@cs.example.edu'
                              WHEN '3-MEDIUM' THEN 'c' || o_custkey || '@agency.example.gov'
              ELSE 'c' || o_custkey || '.' || o_orderkey || '@mail.example.net' END AS address
  FROM orders),
em1 AS (SELECT rowid AS owner, CAST(0 AS BIGINT) AS seq, address FROM addresses
        UNION ALL SELECT owner, seq, address FROM per_order),
rec2 AS (SELECT c.c_custkey AS pk, 'Client' AS first, r.r_name AS last
         FROM c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey),
entries AS (
  SELECT r.first, r.last, e.address AS email, 1 AS book, r.pk, e.seq FROM rec1 r JOIN em1 e ON r.pk = e.owner
  UNION ALL
  SELECT r.first, r.last, e.address, 2, r.pk, e.seq FROM rec2 r JOIN per_order e ON r.pk = e.owner
  WHERE contains(e.address, 'gmail')),
ok AS (SELECT *, CASE WHEN contains(email, 'gmail') THEN 1 WHEN contains(email, '.edu') THEN 2 ELSE 3 END AS rnk
       FROM entries WHERE NOT (suffix(email, '.mil') OR suffix(email, '.gov'))
         AND NOT (first IS NULL AND last IS NULL)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY first, last ORDER BY rnk,
              CASE WHEN rnk = 3 THEN length(email) ELSE 0 END, book, pk, seq) AS rn,
         count(*) OVER (PARTITION BY first, last) AS n_emails,
         min(book * 1000000000000 + pk * 1000000 + seq) OVER (PARTITION BY first, last) AS first_ord
  FROM ok),
best AS (SELECT first, last, email AS best_email, n_emails, first_ord FROM ranked WHERE rn = 1)
SELECT first, last, best_email, n_emails FROM (
  SELECT *, row_number() OVER (PARTITION BY best_email ORDER BY first_ord) AS k FROM best) t
WHERE k = 1"""


def _hav(lat1, lon1, lat2, lon2):
    r = math.pi / 180.0
    return (f"(2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(({lat2} - {lat1}) * {r} / 2), 2) + "
            f"cos({lat1} * {r}) * cos({lat2} * {r}) * pow(sin(({lon2} - {lon1}) * {r} / 2), 2)))))")


@oracle("geo_nearest")
def _():
    return f"""
WITH tags AS (
  SELECT o_orderkey AS point_id,
         strftime(o_orderdate, '%Y:%m:%d %H:%M:%S') || ' UTC' AS date_created,
         CASE WHEN o_orderstatus = 'P' THEN 'n/a'
              ELSE CAST((o_custkey % 179) - 89 + (o_orderkey % 10) / 10.0 AS VARCHAR) END AS latitude,
         CAST((o_orderkey % 359) - 179.5 AS VARCHAR) AS longitude,
         'img/' || o_orderkey || '.jpg' AS path
  FROM orders),
ok AS (SELECT point_id, substr(date_created, 1, length(date_created) - 4) AS date, path,
              CAST(latitude AS DOUBLE) AS lat, CAST(longitude AS DOUBLE) AS lon
       FROM tags WHERE try_cast(latitude AS DOUBLE) IS NOT NULL),
pl AS (SELECT n_name AS place, n_nationkey * 7.0 - 84.0 AS plat, n_nationkey * 14.0 - 168.0 AS plon FROM nation),
d AS (SELECT ok.point_id, ok.date, ok.path, pl.place, {_hav('ok.lat', 'ok.lon', 'pl.plat', 'pl.plon')} AS dist
      FROM ok, pl)
SELECT point_id, date, path, place, round(dist, 6) AS distance_km FROM (
  SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY dist, place) AS rn FROM d) t
WHERE rn = 1"""


@oracle("holiday_counts")
def _():
    vals = ", ".join(f"({m}, {d}, '{n.replace(chr(39), chr(39) * 2)}')" for m, d, n in HOLIDAYS)
    return f"""
WITH years AS (SELECT DISTINCT year(date_sent) AS y FROM messages),
hol AS (SELECT make_date(CAST(y AS INTEGER), m, d) AS day, name FROM years, (VALUES {vals}) v(m, d, name)),
per_day AS (SELECT CAST(date_sent AS DATE) AS date, count(*) AS n FROM messages GROUP BY 1)
SELECT h.day, h.name, CAST(coalesce(p.n, 0) AS BIGINT) AS n FROM hol h LEFT JOIN per_day p ON h.day = p.date"""


@oracle("not_yet_copied")
def _():
    return f"""
WITH m AS (SELECT rowid, message_id, date_sent,
                  sha256(concat_ws('|', subject, strftime(date_sent, '%Y-%m-%d %H:%M:%S'),
                                   CAST(bytes AS VARCHAR))) AS raw_hash FROM messages),
held AS (SELECT message_id, raw_hash FROM m WHERE date_sent < TIMESTAMP '{ARCHIVED_BEFORE}')
SELECT rowid FROM m WHERE NOT EXISTS (
  SELECT 1 FROM held h WHERE h.message_id IS NOT DISTINCT FROM m.message_id AND h.raw_hash = m.raw_hash)"""


@oracle("dot_edges")
def _():
    return """
WITH f AS (
  SELECT s.address AS src, d.address AS dst, count(*) AS n
  FROM messages m JOIN recipients r ON r.message_rowid = m.rowid
  LEFT JOIN addresses s ON m.sender = s.rowid LEFT JOIN addresses d ON r.address_id = d.rowid
  WHERE r.type IN (0, 1) GROUP BY 1, 2)
SELECT '"' || coalesce(src, '') || '" -> "' || coalesce(dst, '') || '" [label="' || n || '",fontsize=24];' AS line
FROM f"""


@oracle("json_report")
def _():
    return """
WITH t AS (
  SELECT a.address AS sender_email, count(*) AS n
  FROM messages m LEFT JOIN addresses a ON m.sender = a.rowid
  GROUP BY 1 ORDER BY n DESC, sender_email DESC NULLS LAST LIMIT 10)
SELECT CAST(to_json({'title': 'Top senders', 'sender_email': sender_email, 'n': n}) AS VARCHAR) AS json FROM t"""


@oracle("epoch_dates")
def _():
    return """
SELECT rowid, CAST(epoch(date_sent) AS BIGINT) AS epoch,
       make_timestamp(CAST(epoch(date_sent) AS BIGINT) * 1000000) AS utc_ts,
       CAST(make_timestamp(CAST(epoch(date_sent) AS BIGINT) * 1000000) AS DATE) AS utc_date
FROM messages"""


@oracle("iso_now")
def _():
    return "SELECT rowid, strftime(date_sent, '%Y-%m-%dT%H:%M:%S') AS iso FROM messages"


@oracle("day_names")
def _():
    return """
SELECT CAST(isodow(date_sent) - 1 AS INTEGER) AS weekday, dayname(date_sent) AS day_name, count(*) AS n
FROM messages GROUP BY 1, 2"""


@oracle("flow_pairs")
def _():
    return """
SELECT m.rowid, m.sender, r.address_id, r.type, r.position
FROM messages m JOIN recipients r ON r.message_rowid = m.rowid WHERE r.type IN (0, 1)"""


PDF_TEXT = """
WITH t AS (
  SELECT o_orderkey AS rowid,
         CASE o_orderstatus WHEN 'F' THEN strftime(o_orderdate, '%A, %B %-d, %Y %I:%M:%S %p')
                            WHEN 'O' THEN strftime(o_orderdate, '%B %-d, %Y %I:%M:%S %p')
              ELSE 'not a date ' || o_orderkey END AS text
  FROM orders)"""


@oracle("pdf_dates")
def _():
    return PDF_TEXT + """
SELECT rowid, text,
       try_strptime(regexp_replace(text, '^\\w+day, ', ''), '%B %d, %Y %I:%M:%S %p') AS parsed
FROM t"""


@oracle("date_checks")
def _():
    return """
WITH t AS (
  SELECT o_orderkey AS rowid,
         CASE WHEN o_orderstatus = 'P' THEN '31-Foo-1999' ELSE strftime(o_orderdate, '%-d-%b-%Y') END AS text,
         printf('%d:%02d:%02d', o_orderkey % 24, o_orderkey % 60, (o_orderkey * 7) % 60) AS tm
  FROM orders)
SELECT rowid, text, try_strptime(text, '%d-%b-%Y') IS NOT NULL AS valid,
       regexp_replace(tm, '^(\\d):', '0\\1:') AS time
FROM t"""


@oracle("internal_date")
def _():
    return """
WITH ft AS (SELECT message_rowid AS rowid, max(date_received) AS ft FROM recipients GROUP BY 1)
SELECT m.rowid, coalesce(CASE WHEN m.priority = '5-LOW' THEN ft.ft END, m.date_sent,
                         TIMESTAMP '2001-08-02 00:00:00') AS internal_date
FROM messages m LEFT JOIN ft ON m.rowid = ft.rowid"""


@oracle("titled_reports")
def _():
    return """
WITH flat AS (SELECT m.rowid, a.address AS sender_email, m.subject
              FROM messages m LEFT JOIN addresses a ON m.sender = a.rowid),
s AS (SELECT 'Top senders' AS title, sender_email AS key, count(*) AS n FROM flat
      GROUP BY sender_email ORDER BY n DESC, key DESC LIMIT 10),
j AS (SELECT 'Top subjects' AS title, subject AS key, count(*) AS n FROM flat
      GROUP BY subject ORDER BY n DESC, key DESC LIMIT 10)
SELECT title, key, n FROM s UNION ALL SELECT title, key, n FROM j
UNION ALL SELECT 'Total', NULL, count(*) FROM flat"""


@oracle("grid_by_spec")
def _():
    return """
SELECT CAST(dayofmonth(ts) AS INTEGER) AS ring, CAST(hour(ts) AS INTEGER) AS division, count(*) AS n
FROM mail_events GROUP BY 1, 2"""


@oracle("summary_line")
def _():
    return """
WITH m AS (SELECT m.rowid, coalesce(a.address, 'No From') AS f, m.date_sent,
                  coalesce(m.subject, 'No Subject') AS s, CAST(m.rowid AS VARCHAR) AS i
           FROM messages m LEFT JOIN addresses a ON m.sender = a.rowid),
x AS (SELECT *, CASE WHEN length(i) < 2 THEN lpad(i, 2, ' ') ELSE i END AS idx FROM m)
SELECT rowid,
       idx || ' ' || rpad(substr(f, 1, 25 - length(idx)), CAST(25 - length(idx) AS INTEGER), ' ') || ' ' ||
       coalesce(strftime(date_sent, '%m/%d/%Y %H:%M'), 'No date         ') || ' ' ||
       rpad(substr(s, 1, 35), 35, ' ') AS line
FROM x"""
