"""Message flags: format letters <-> IMAP names, flag edits, copy cleaning.

SURVEY P29, P30, P31, P34, P41.  Flags are ``ARRAY<STRING>`` of IMAP
names; conversions are literal maps applied with higher-order functions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: letter -> IMAP flag, per mailbox format ------------------
MAILDIR_FLAGS = {"D": "\\Draft", "F": "\\Flagged", "P": "$Forwarded", "R": "\\Answered",
                 "S": "\\Seen", "T": "\\Deleted"}
MBOX_FLAGS = {"F": "\\Flagged", "A": "\\Answered", "R": "\\Seen", "D": "\\Deleted"}
MH_FLAGS = {"flagged": "\\Flagged", "replied": "\\Answered"}
BABYL_FLAGS = {"forwarded": "$Forwarded", "answered": "\\Answered", "deleted": "\\Deleted"}
RECENT = "\\Recent"
# ----------------------------------------------------------------------------

_FORMATS = {"maildir": MAILDIR_FLAGS, "mbox": MBOX_FLAGS, "mmdf": MBOX_FLAGS}
_LABEL_FORMATS = {"mh": MH_FLAGS, "babyl": BABYL_FLAGS}


def _map(d: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def imap_flags(letters: Column, fmt: str) -> Column:
    """Letters string (maildir ``:2,FS``, mbox Status+X-Status) -> sorted IMAP flags."""
    if fmt in _LABEL_FORMATS:
        m = _map(_LABEL_FORMATS[fmt])
        out = F.transform(letters, lambda s: m[s])  # labels / sequences are an array
    else:
        m = _map(_FORMATS[fmt])
        out = F.transform(F.split(F.coalesce(letters, F.lit("")), ""), lambda ch: m[ch])
    return F.array_sort(F.array_distinct(F.filter(out, lambda x: x.isNotNull())))


def format_flags(flags: Column, fmt: str) -> Column:
    """IMAP flags -> the format's letters (sorted), the intended reverse map."""
    rev = {v: k for k, v in (_FORMATS.get(fmt) or _LABEL_FORMATS[fmt]).items()}
    m = _map(rev)
    picked = F.array_sort(F.filter(F.transform(flags, lambda f: m[f]), lambda x: x.isNotNull()))
    return F.array_join(picked, "") if fmt in _FORMATS else picked


def add_flag(flags: Column, flag: str) -> Column:
    """P30 add: no ``\\Recent``, no doubles."""
    if flag.lower() == RECENT.lower():
        return flags
    return F.array_distinct(F.array_union(F.coalesce(flags, F.array().cast("array<string>")),
                                          F.array(F.lit(flag))))


def remove_flag(flags: Column, flag: str) -> Column:
    """P30 remove (case-insensitive)."""
    return F.filter(flags, lambda f: F.lower(f) != flag.lower())


def set_flags(new_flags: list[str]) -> Column:
    """P30 set: replace all (``\\Recent`` dropped, no doubles)."""
    keep = [f for f in dict.fromkeys(new_flags) if f.lower() != RECENT.lower()]
    return F.array(*[F.lit(f) for f in keep]).cast("array<string>")


def clean_for_copy(flags: Column, keep_dollar: bool = False, drop_deleted: bool = False) -> Column:
    """Drop ``\\Recent`` (flags are compared without case); keep system ``\\...`` flags (and ``$...`` on request)."""
    def keep(f):
        ok = f.startswith("\\") & (F.lower(f) != RECENT.lower())
        if keep_dollar:
            ok = ok | f.startswith("$")
        if drop_deleted:
            ok = ok & (F.lower(f) != "\\deleted")
        return ok
    return F.filter(flags, keep)


def flags_from_bits(bits: Column) -> Column:
    """Store bitmask (1 seen, 2 deleted) -> IMAP flags."""
    return F.filter(F.array(F.when(bits.bitwiseAND(1) != 0, F.lit("\\Seen")),
                            F.when(bits.bitwiseAND(2) != 0, F.lit("\\Deleted"))),
                    lambda x: x.isNotNull())
