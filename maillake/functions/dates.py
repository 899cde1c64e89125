"""Date and time Column functions.

Outputs are ``TIMESTAMP_NTZ`` in UTC so results do not depend on the
session time zone; header dates keep their zone offset in a separate
column (needed for local-hour grids).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "1970-01-01 00:00:00"

# --- fixed values: zone names of RFC 2822 (obsolete) dates, minutes east of UTC
ZONE_NAMES = {"UT": 0, "GMT": 0, "Z": 0, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300,
              "MST": -420, "MDT": -360, "PST": -480, "PDT": -420}
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
# ----------------------------------------------------------------------------

# d MMM yyyy H:mm[:ss] zone  (weekday and trailing comments are ignored)
HEADER_DATE_RE = (r"(\d{1,2})\s+([A-Za-z]{3})[a-z]*\s+(\d{2,4})\s+(\d{1,2}):(\d{2})(?::(\d{2}))?"
                  r"\s*([+-]\d{4}|[A-Za-z]{1,3})?")


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970-01-01 of a UTC wall-clock timestamp (no session-zone shift)."""
    t = ts.cast("timestamp_ntz")
    return (F.datediff(F.to_date(t), F.to_date(F.lit("1970-01-01"))).cast("long") * 86400
            + F.hour(t) * 3600 + F.minute(t) * 60 + F.floor(F.second(t)).cast("long"))


def from_epoch(seconds: Column) -> Column:
    """P7 ``datetime(x, 'unixepoch')`` as TIMESTAMP_NTZ (UTC)."""
    return F.to_timestamp_ntz(F.lit(EPOCH)) + F.make_dt_interval(secs=seconds.cast("long"))


def local_date(utc: Column, zone: str) -> Column:
    """P7 ``date(x, 'unixepoch', 'localtime')`` for an explicit IANA zone."""
    return F.to_date(F.from_utc_timestamp(utc.cast("timestamp"), zone))


def iso_text(ts: Column) -> Column:
    """ISO text, seconds precision."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def parse_pdf_date(text: Column) -> Column:
    """``Monday, June 1, 2020 08:00:00 PM`` (weekday optional); bad text -> NULL.

    Spark refuses ``EEEE`` in parse patterns, so the weekday is cut first.
    """
    body = F.regexp_replace(text, r"^\w+day, ", "")
    return F.try_to_timestamp(body, F.lit("MMMM d, yyyy hh:mm:ss a")).cast("timestamp_ntz")


def valid_dmy(text: Column) -> Column:
    """Text is a valid ``DD-MMM-YYYY`` date."""
    return F.try_to_timestamp(text, F.lit("d-MMM-yyyy")).isNotNull()


def fix_hour(time_text: Column) -> Column:
    """One-digit hour gets a leading zero (``8:05:00`` -> ``08:05:00``)."""
    return F.regexp_replace(time_text, r"^(\d):", "0$1:")


def parse_header_date(text: Column) -> Column:
    """P5: RFC 2822 Date header -> struct(utc TIMESTAMP_NTZ, tz_offset_min INT).

    Handles numeric zones, the obsolete zone names, missing seconds and
    two-digit years (< 50 -> 20xx, else 19xx); unparsable text -> NULL fields.
    """
    g = [F.regexp_extract(text, HEADER_DATE_RE, i) for i in range(1, 8)]
    day, mon, year, hh, mm, ss, zone = g
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.initcap(mon))
    y = year.cast("int")
    y = F.when(F.length(year) == 2, F.when(y < 50, y + 2000).otherwise(y + 1900)).otherwise(y)
    sec = F.when(ss == "", F.lit(0)).otherwise(ss.cast("int"))
    local = F.try_make_timestamp_ntz(y, month.cast("int"), day.cast("int"), hh.cast("int"),
                                     mm.cast("int"), sec)
    zmap = F.create_map(*[F.lit(x) for kv in ZONE_NAMES.items() for x in kv])
    num = zone.rlike(r"^[+-]\d{4}$")
    sign = F.when(F.substring(zone, 1, 1) == "-", F.lit(-1)).otherwise(F.lit(1))
    numeric = sign * (F.substring(zone, 2, 2).cast("int") * 60 + F.substring(zone, 4, 2).cast("int"))
    offset = (F.when(num, numeric).when(zone == "", F.lit(0))
              .otherwise(F.coalesce(zmap[F.upper(zone)], F.lit(0))))
    ok = text.rlike(HEADER_DATE_RE) & month.isNotNull() & (month > 0)
    utc = local - F.make_dt_interval(mins=offset)
    return F.struct(F.when(ok, utc).alias("utc"), F.when(ok, offset).cast("int").alias("tz_offset_min"))


def internal_date(file_time: Column, header_date: Column, ingest_time: Column) -> Column:
    """File (maildir) time, else the Date header, else the load time."""
    return F.coalesce(file_time, header_date, ingest_time)
