"""Header parsing as Column expressions.

Headers stay an ordered ``ARRAY<STRUCT<name STRING, value STRING>>`` (names
repeat and order matters), built from the raw text with built-in string
functions: no per-row Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEADER_TYPE = "array<struct<name:string,value:string>>"
# Stands for a comma outside quotes while an address list is cut (no mail text holds it).
_ITEM_END = "\x00"


def normalize_newlines(raw: Column) -> Column:
    """CRLF -> LF (texts without a CR pass untouched)."""
    return F.when(F.instr(raw, "\r") > 0, F.replace(raw, F.lit("\r\n"), F.lit("\n"))).otherwise(raw)


def head_text(raw: Column) -> Column:
    """The header block = text up to the first blank line (literal search, no regex)."""
    t = normalize_newlines(raw)
    cut = F.instr(t, "\n\n")
    return F.when(cut > 0, F.substring(t, F.lit(1), cut - 1)).otherwise(t)


def body_text(raw: Column) -> Column:
    """Text after the first blank line ('' when there is none)."""
    t = normalize_newlines(raw)
    cut = F.instr(t, "\n\n")
    return F.when(cut > 0, F.substr(t, cut + 2)).otherwise(F.lit(""))


def parse_headers(raw: Column) -> Column:
    """Unfold continuation lines and split ``Name: value`` lines, in order."""
    unfolded = F.regexp_replace(head_text(raw), r"\n[ \t]+", " ")
    lines = F.filter(F.split(unfolded, "\n", -1), lambda ln: ln.contains(":") & ~ln.startswith("From "))
    return F.transform(lines, lambda ln: F.struct(
        F.trim(F.substring_index(ln, ":", 1)).alias("name"),
        F.trim(F.substr(ln, F.instr(ln, ":") + 1)).alias("value")))


def header_all(headers: Column, name: str) -> Column:
    """Every value of a header (case-insensitive name), in order."""
    n = name.lower()
    return F.transform(F.filter(headers, lambda h: F.lower(h["name"]) == n), lambda h: h["value"])


def header(headers: Column, name: str) -> Column:
    """First value of a header, NULL when absent."""
    return F.try_element_at(header_all(headers, name), F.lit(1))


def split_addresses(value: Column) -> Column:
    """Address list -> items (commas inside quotes do not split).

    The text is cut at the quotes: a comma splits if an even number of them follows, i.e. in
    every other piece counted from the end.  Linear in the text, whatever the number of quotes.
    """
    pieces = F.split(value, '"', -1)
    marked = F.transform(pieces, lambda s, i: F.when((F.size(pieces) - 1 - i) % 2 == 0, F.replace(s, F.lit(","), F.lit(_ITEM_END)))
                         .otherwise(s))
    return F.filter(F.transform(F.split(F.array_join(marked, '"'), _ITEM_END, -1), lambda s: F.trim(s)),
                    lambda s: s != "")


def address_email(item: Column) -> Column:
    """P4 email part: text in <...>, else the bare item (quotes stripped)."""
    inside = F.regexp_extract(item, r"<([^>]*)>", 1)
    bare = F.trim(F.regexp_replace(item, r'^"|"$', ""))
    return F.when(inside != "", F.trim(inside)).otherwise(
        F.when(item.contains("<"), F.lit("")).otherwise(bare))


def address_name(item: Column) -> Column:
    """P4 real-name part ('' when there is none)."""
    n = F.trim(F.regexp_replace(item, r"<[^>]*>", ""))
    n = F.regexp_replace(n, r'^"(.*)"$', "$1")
    return F.when(item.contains("<"), n).otherwise(F.lit(""))


def parse_address(value: Column) -> Column:
    """P4 mode ``first`` (the reference): struct(name, email) of the first address."""
    first = F.try_element_at(split_addresses(value), F.lit(1))
    return F.struct(address_name(first).alias("name"), address_email(first).alias("email"))


def parse_addresses(value: Column) -> Column:
    """P4 mode ``all``: every address of the header value."""
    return F.transform(split_addresses(value), lambda it: F.struct(
        address_name(it).alias("name"), address_email(it).alias("email")))


def without_status(headers: Column) -> Column:
    """Drop Status / X-Status once their letters became flags."""
    return F.filter(headers, lambda h: ~F.lower(h["name"]).isin("status", "x-status"))


def status_letters(headers: Column) -> Column:
    """mbox flag letters = Status value + X-Status value."""
    return F.concat(F.coalesce(header(headers, "status"), F.lit("")),
                    F.coalesce(header(headers, "x-status"), F.lit("")))


def with_defaults(c: Column, default: str) -> Column:
    """``No date`` / ``No From`` / ``No Subject`` style defaults."""
    return F.coalesce(c, F.lit(default))


def message_ids(value: Column) -> Column:
    """All ``<...>`` ids of a References / In-Reply-To value."""
    return F.regexp_extract_all(F.coalesce(value, F.lit("")), F.lit(r"(<[^>]+>)"), 1)
