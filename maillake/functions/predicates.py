"""Column predicates shared by reports and searches."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SEEN = 1      # flags bit: message has been read
DELETED = 2   # flags bit: message is marked deleted


def like_any(c: Column, patterns: Sequence[str], nocase: bool = True) -> Column:
    """SQL LIKE against any pattern; SQLite LIKE (and a NOCASE column) ignore ASCII case."""
    if not patterns:
        return F.lit(False)
    v = F.lower(c) if nocase else c
    return reduce(lambda a, b: a | b, [v.like(p.lower() if nocase else p) for p in patterns])


def is_me(address: Column, me: Sequence[str], not_me: Sequence[str]) -> Column:
    """address LIKE any of ``me`` and LIKE none of ``not_me`` (case-insensitive)."""
    return like_any(address, me) & ~like_any(address, not_me)


def within_days(ts: Column, asof: str, days: int = 365) -> Column:
    """``ts`` later than ``asof - days`` (``asof`` is a parameter so runs are repeatable)."""
    return ts > (F.to_timestamp_ntz(F.lit(asof)) - F.make_interval(days=F.lit(days)))


def is_seen(flags: Column) -> Column:
    return flags.bitwiseAND(SEEN) != 0


def is_deleted(flags: Column) -> Column:
    return flags.bitwiseAND(DELETED) != 0


def is_unread(flags: Column) -> Column:
    """Unread = not seen and not deleted (the counter triggers' condition)."""
    return (flags.bitwiseAND(SEEN) == 0) & (flags.bitwiseAND(DELETED) == 0)


def any_header_matches(headers: Sequence[Column], pattern: str) -> Column:
    """case-sensitive regex search on any header; a missing header never matches."""
    return reduce(lambda a, b: a | b,
                  [F.coalesce(h.rlike(pattern), F.lit(False)) for h in headers])


def ends_with_any(c: Column, suffixes: Sequence[str]) -> Column:
    """F5 helper: value ends with one of the suffixes (NULL -> false)."""
    if not suffixes:
        return F.lit(False)
    return reduce(lambda a, b: a | b,
                  [F.coalesce(c.endswith(s), F.lit(False)) for s in suffixes])
