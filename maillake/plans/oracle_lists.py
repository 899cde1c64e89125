"""SQL twins of the list / search / flag / folder queries (DuckDB dialect)."""

from __future__ import annotations

from maillake.plans.oracle import oracle

ALLOW_SQL = """
WITH lst AS (
  SELECT '@' || lower(n_name) || '.example.org' AS entry FROM nation WHERE n_regionkey = 1
  UNION ALL
  SELECT a.address FROM addresses a JOIN supplier s ON a.rowid = s.s_suppkey + 10000000
  WHERE s.s_acctbal < 0)"""

REPL_SQL = """
WITH rl AS (
  SELECT CAST(n.n_nationkey AS BIGINT) AS line_no, '@' || lower(n.n_name) || '.example.org' AS original,
         lower(r.r_name) || '-desk@mail.example.org' AS replacement
  FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey
  UNION ALL
  SELECT s.s_suppkey + 1000, a.address, 'blocked@mail.example.org'
  FROM addresses a JOIN supplier s ON a.rowid = s.s_suppkey + 10000000 WHERE s.s_acctbal < 0)"""


@oracle("whitelist_domain")
def _():
    return ALLOW_SQL + """
SELECT rowid, address, EXISTS (SELECT 1 FROM lst WHERE contains(address, entry)) AS listed
FROM addresses"""


@oracle("replace_lookup")
def _():
    return REPL_SQL + """
SELECT a.rowid, a.address,
  CASE WHEN a.address IS NULL THEN NULL ELSE coalesce(
    (SELECT arg_max(replacement, line_no) FROM rl WHERE rl.original = a.address),
    (SELECT arg_min(replacement, line_no) FROM rl WHERE contains(a.address, rl.original)),
    a.address) END AS replaced
FROM addresses a"""


SEARCH_SQL = """
WITH sf AS (
  SELECT m.rowid, a.address AS from_, m.subject, m.date_sent, m.bytes, m.flags,
         m.date_sent AS internal_date
  FROM messages m LEFT JOIN addresses a ON m.sender = a.rowid)"""


def _search(where: str, cols: str = "rowid") -> str:
    return SEARCH_SQL + f"\nSELECT {cols} FROM sf WHERE {where}"


@oracle("search_flag")
def _():
    return _search("flags & 1 = 0 AND flags & 2 = 0")


@oracle("search_string")
def _():
    return _search("coalesce(contains(lower(from_), 'customer.00000012'), false) "
                   "OR coalesce(contains(lower(subject), 'urgent'), false)")


@oracle("search_date")
def _():
    return _search("CAST(internal_date AS DATE) >= DATE '1998-01-01' "
                   "AND CAST(internal_date AS DATE) < DATE '1998-02-01'")


@oracle("search_size")
def _():
    return _search("bytes > 400000 AND bytes < 450000")


@oracle("search_boolean")
def _():
    return _search("(flags & 1 = 0 OR (flags & 2 <> 0 AND coalesce(contains(lower(subject), 're:'), false))) "
                   "AND rowid >= 1")


@oracle("since_date")
def _():
    return _search("CAST(internal_date AS DATE) >= DATE '2000-06-15'", "rowid, internal_date")


LISTING_SQL = """
WITH ll AS (
  SELECT rowid, '(' || CASE WHEN source IS NOT NULL THEN '\\HasNoChildren'
                            WHEN rowid >= 20 THEN '\\HasNoChildren \\Noselect'
                            ELSE '\\HasChildren' END || ') "/" "' || url || '"' AS line
  FROM mailboxes),
parsed AS (
  SELECT rowid, regexp_extract(line, '\\((.*?)\\) "(.*)" (.*)', 1) AS flags,
         regexp_extract(line, '\\((.*?)\\) "(.*)" (.*)', 2) AS delimiter,
         regexp_replace(regexp_extract(line, '\\((.*?)\\) "(.*)" (.*)', 3), '^"(.*)"$', '\\1') AS name
  FROM ll)"""


@oracle("folder_list_parse")
def _():
    return LISTING_SQL + "\nSELECT rowid, flags, delimiter, name FROM parsed"


@oracle("folder_filter")
def _():
    return LISTING_SQL + """
SELECT rowid, name FROM parsed
WHERE NOT (starts_with(name, '#') OR starts_with(name, '.'))
  AND NOT contains(lower(flags), '\\noselect')
  AND (name IN ('nation_1', 'nation_2', 'nation_3', 'label')
       OR starts_with(name, 'nation_1/') OR starts_with(name, 'nation_2/')
       OR starts_with(name, 'nation_3/') OR starts_with(name, 'label/'))
  AND name NOT IN ('label/nation_10')"""


@oracle("folder_rename")
def _():
    return """
WITH mp AS (SELECT lower(n_name) AS src, 'Region2/' || lower(n_name) AS dst FROM nation WHERE n_regionkey = 2),
f AS (SELECT b.rowid, b.url AS name, replace(coalesce(mp.dst, b.url), '.', '_') AS n
      FROM mailboxes b LEFT JOIN mp ON b.url = mp.src)
SELECT rowid, name,
       regexp_replace(CASE WHEN lower(n) = 'inbox' THEN replace(n, '/', '.')
                           ELSE 'INBOX.' || replace(n, '/', '.') END, '^\\.', '') AS target
FROM f"""


@oracle("flag_map")
def _():
    return """
SELECT rowid,
  concat_ws(',', CASE WHEN flags & 1 <> 0 THEN '\\Seen' END, CASE WHEN flags & 2 <> 0 THEN '\\Deleted' END) AS imap,
  concat(CASE WHEN flags & 1 <> 0 THEN 'S' ELSE '' END, CASE WHEN flags & 2 <> 0 THEN 'T' ELSE '' END) AS maildir,
  concat(CASE WHEN flags & 2 <> 0 THEN 'D' ELSE '' END, CASE WHEN flags & 1 <> 0 THEN 'R' ELSE '' END) AS mbox,
  concat_ws(',', CASE WHEN flags & 2 <> 0 THEN '\\Deleted' END, CASE WHEN flags & 1 <> 0 THEN '\\Seen' END) AS from_maildir,
  concat_ws(',', CASE WHEN flags & 2 <> 0 THEN '\\Deleted' END, CASE WHEN flags & 1 <> 0 THEN '\\Seen' END) AS from_mbox,
  concat_ws(',', CASE WHEN flags & 1 <> 0 THEN '\\Seen' END) AS copy_flags
FROM messages"""


@oracle("flag_edits")
def _():
    return """
WITH f AS (
  SELECT rowid, subject, priority,
         list_filter([CASE WHEN flags & 1 <> 0 THEN '\\Seen' END,
                      CASE WHEN flags & 2 <> 0 THEN '\\Deleted' END], lambda x: x IS NOT NULL) AS fl
  FROM messages),
g AS (SELECT rowid, subject,
             CASE WHEN priority = '1-URGENT' THEN list_distinct(list_concat(fl, ['\\Flagged'])) ELSE fl END AS fl
      FROM f),
h AS (SELECT rowid, CASE WHEN starts_with(subject, 'Re: ')
                         THEN list_filter(fl, lambda x: lower(x) <> '\\seen') ELSE fl END AS fl FROM g)
SELECT rowid, array_to_string(list_sort(fl), ',') AS flags FROM h"""


@oracle("flag_bits")
def _():
    return """
SELECT rowid, flags & 1 <> 0 AS seen, flags & 2 <> 0 AS deleted,
       (flags & 1 = 0 AND flags & 2 = 0) AS unread
FROM messages"""
