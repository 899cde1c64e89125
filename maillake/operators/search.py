"""Search vocabulary as Column predicates.

Each search key of the reference's IMAP search is a function returning a
Column predicate over a message frame with the columns named in ``Cols``
(defaults fit ``maillake.sources`` mail frames).  Predicates combine with
``&``, ``|``, ``~`` (``and_``, ``or_``, ``not_`` are provided for symmetry);
a filter with them pushes date and size comparisons down to Parquet.
String keys match as case-insensitive substrings.  The criteria-string
parser of the reference is not rebuilt: a query is Python composition.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Cols:
    flags: str = "imap_flags"        # ARRAY<STRING> of IMAP flags
    uid: str = "rowid"
    seq: str = "rowid"
    internal_date: str = "internal_date"
    date_sent: str = "date_sent"
    size: str = "bytes"
    sender: str = "from_"
    to: str = "to"
    cc: str = "cc"
    bcc: str = "bcc"
    subject: str = "subject"
    body: str = "body"
    headers: str = "headers"         # ARRAY<STRUCT<name,value>>


C = Cols()


def _has(cols: Cols, flag: str) -> Column:
    return F.coalesce(F.array_contains(F.col(cols.flags), flag), F.lit(False))


def _ci(col: str, s: str) -> Column:
    return F.coalesce(F.lower(F.col(col)).contains(s.lower()), F.lit(False))


def _day(d: str | dt.date) -> Column:
    return F.to_date(F.lit(str(d)))


def all_(cols: Cols = C) -> Column:
    return F.lit(True)


def answered(cols: Cols = C) -> Column:
    return _has(cols, "\\Answered")


def unanswered(cols: Cols = C) -> Column:
    return ~answered(cols)


def deleted(cols: Cols = C) -> Column:
    return _has(cols, "\\Deleted")


def undeleted(cols: Cols = C) -> Column:
    return ~deleted(cols)


def draft(cols: Cols = C) -> Column:
    return _has(cols, "\\Draft")


def undraft(cols: Cols = C) -> Column:
    return ~draft(cols)


def flagged(cols: Cols = C) -> Column:
    return _has(cols, "\\Flagged")


def unflagged(cols: Cols = C) -> Column:
    return ~flagged(cols)


def seen(cols: Cols = C) -> Column:
    return _has(cols, "\\Seen")


def unseen(cols: Cols = C) -> Column:
    return ~seen(cols)


def recent(cols: Cols = C) -> Column:
    return _has(cols, "\\Recent")


def old(cols: Cols = C) -> Column:
    return ~recent(cols)


def new(cols: Cols = C) -> Column:
    """NEW = RECENT and UNSEEN."""
    return recent(cols) & unseen(cols)


def keyword(k: str, cols: Cols = C) -> Column:
    return _has(cols, k)


def unkeyword(k: str, cols: Cols = C) -> Column:
    return ~keyword(k, cols)


def from_(s: str, cols: Cols = C) -> Column:
    return _ci(cols.sender, s)


def to(s: str, cols: Cols = C) -> Column:
    return _ci(cols.to, s)


def cc(s: str, cols: Cols = C) -> Column:
    return _ci(cols.cc, s)


def bcc(s: str, cols: Cols = C) -> Column:
    return _ci(cols.bcc, s)


def subject(s: str, cols: Cols = C) -> Column:
    return _ci(cols.subject, s)


def body(s: str, cols: Cols = C) -> Column:
    return _ci(cols.body, s)


def header(name: str, s: str, cols: Cols = C) -> Column:
    """HEADER name string: any header of that name contains the string."""
    return F.coalesce(F.exists(F.col(cols.headers), lambda h: (F.lower(h["name"]) == name.lower())
                               & F.lower(h["value"]).contains(s.lower())), F.lit(False))


def text(s: str, cols: Cols = C) -> Column:
    """TEXT: header or body contains the string."""
    hdr = F.exists(F.col(cols.headers), lambda h: F.lower(h["value"]).contains(s.lower()))
    return F.coalesce(hdr, F.lit(False)) | body(s, cols)


def larger(n: int, cols: Cols = C) -> Column:
    return F.col(cols.size) > n


def smaller(n: int, cols: Cols = C) -> Column:
    return F.col(cols.size) < n


def before(d, cols: Cols = C) -> Column:
    return F.to_date(F.col(cols.internal_date)) < _day(d)


def on(d, cols: Cols = C) -> Column:
    return F.to_date(F.col(cols.internal_date)) == _day(d)


def since(d, cols: Cols = C) -> Column:
    """SINCE (and F9's 'sent since date'): date part on or after ``d``."""
    return F.to_date(F.col(cols.internal_date)) >= _day(d)


def sentbefore(d, cols: Cols = C) -> Column:
    return F.to_date(F.col(cols.date_sent)) < _day(d)


def senton(d, cols: Cols = C) -> Column:
    return F.to_date(F.col(cols.date_sent)) == _day(d)


def sentsince(d, cols: Cols = C) -> Column:
    return F.to_date(F.col(cols.date_sent)) >= _day(d)


def uid(ids: str, cols: Cols = C, largest: Column | int | None = None) -> Column:
    return sequence_set(ids, cols.uid, largest)


def sequence_set(spec: str, col: str = "rowid", largest: Column | int | None = None) -> Column:
    """IMAP sequence set ``1,4:7,10:*`` as a predicate on ``col``.

    ``*`` is the largest number in the folder: give it as ``largest`` (see
    ``with_largest``); a range holds the numbers between its ends in either order, so
    ``20:*`` of a folder of ten messages is message ten.
    """
    def number(text: str) -> Column:
        if text.strip() != "*":
            return F.lit(int(text))
        if largest is None:
            raise ValueError("a set with * needs the largest number: see with_largest")
        return largest if isinstance(largest, Column) else F.lit(largest)

    parts = []
    for item in spec.split(","):
        ends = [number(x) for x in item.split(":", 1)]
        a, b = ends[0], ends[-1]
        parts.append(F.col(col).between(F.least(a, b), F.greatest(a, b)) if len(ends) == 2 else F.col(col) == a)
    return reduce(lambda x, y: x | y, parts)


def with_largest(df: DataFrame, col: str = "rowid", out: str = "largest") -> DataFrame:
    """Add the largest number of the folder to every row (an aggregate of one row, broadcast)."""
    return df.crossJoin(F.broadcast(df.agg(F.max(col).alias(out))))


def not_(p: Column) -> Column:
    return ~p


def or_(a: Column, b: Column) -> Column:
    return a | b


def and_(*ps: Column) -> Column:
    return reduce(lambda x, y: x & y, ps)


def unseen_undeleted(cols: Cols = C) -> Column:
    """F8 (``get_unseen_uids``)."""
    return unseen(cols) & undeleted(cols)
