"""Registered driver queries: name -> (spark, sf_dir) -> DataFrame.

Each query reads the driver's whole tables through the mail views of
``maillake.sources.driver`` and runs one library operator on them.  The SQL
twin of every query with an oracle lives in ``maillake.plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maillake.functions.predicates import is_deleted
from maillake.operators import counters, dedup, stats, timegrid
from maillake.plans import params as P
from maillake.sources.driver import MailViews

QueryFn = Callable[[SparkSession, str], DataFrame]
CATALOG: dict[str, QueryFn] = {}


def dates_as_text(df: DataFrame) -> DataFrame:
    """Registered results carry dates and timestamps as ISO text (``yyyy-MM-dd``,
    ``yyyy-MM-dd HH:mm:ss``): every engine renders that the same way, whereas
    date and timestamp values come back as different Python/pandas types."""
    from pyspark.sql.types import DateType, TimestampNTZType, TimestampType
    kinds = (DateType, TimestampType, TimestampNTZType)
    if not any(isinstance(f.dataType, kinds) for f in df.schema.fields):
        return df
    return df.select(*[F.col(f.name).cast("string").alias(f.name) if isinstance(f.dataType, kinds)
                       else F.col(f.name) for f in df.schema.fields])


def query(name: str):
    def deco(fn):
        CATALOG[name] = lambda spark, sf_dir: dates_as_text(fn(MailViews(spark, sf_dir)))
        CATALOG[name].__doc__ = fn.__doc__
        return fn
    return deco


@query("top_senders")
def top_senders(v: MailViews) -> DataFrame:
    """A2 + W1: the ten most frequent senders."""
    return stats.top_senders(v.messages, v.addresses, P.TOP_N)


@query("top_recipients")
def top_recipients(v: MailViews) -> DataFrame:
    return stats.top_recipients(v.recipients, v.addresses, P.TOP_N)


@query("top_flows")
def top_flows(v: MailViews) -> DataFrame:
    return stats.top_flows(v.messages, v.recipients, v.addresses, P.TOP_FLOWS_N)


@query("header_counts")
def header_counts(v: MailViews) -> DataFrame:
    return stats.header_counts(v.messages, v.recipients, v.addresses)


@query("messages_per_day")
def messages_per_day(v: MailViews) -> DataFrame:
    return stats.messages_per_day(v.messages, v.addresses, P.ME, P.NOT_ME, P.ASOF, P.DAYS)


@query("message_listing")
def message_listing(v: MailViews) -> DataFrame:
    return stats.message_listing(v.messages, v.addresses, P.ASOF, P.DAYS, P.LISTING_N)


@query("my_addresses")
def my_addresses(v: MailViews) -> DataFrame:
    """F1 + J3: the address rows that are "me" (semi join to the pattern match)."""
    a = v.addresses
    mine = stats.me_ids(a, P.ME, P.NOT_ME).select("rowid")
    return a.join(mine, "rowid", "left_semi").select("rowid", "address", "comment")


@query("folder_status")
def folder_status(v: MailViews) -> DataFrame:
    return stats.folder_status(v.messages)


@query("copy_totals")
def copy_totals(v: MailViews) -> DataFrame:
    return stats.copy_totals(v.messages)


def _events_grid(v: MailViews) -> DataFrame:
    return timegrid.grid_long(v.mail_events, "ts", timegrid.WEEKDAY_BY_HOUR)


@query("timewheel_long")
def timewheel_long(v: MailViews) -> DataFrame:
    """P35 + A5: weekday x hour counts of mail events (long form)."""
    return _events_grid(v)


@query("timewheel_pivot")
def timewheel_pivot(v: MailViews) -> DataFrame:
    """A5 + W10: the same grid as a crosstab, one row per weekday."""
    return timegrid.grid_pivot(_events_grid(v), timegrid.WEEKDAY_BY_HOUR)


@query("grid_scaled")
def grid_scaled(v: MailViews) -> DataFrame:
    return timegrid.grid_scaled(_events_grid(v))


@query("dedup_keep_newest")
def dedup_keep_newest(v: MailViews) -> DataFrame:
    return dedup.dedup_keep_newest(v.messages)


@query("dup_running")
def dup_running(v: MailViews) -> DataFrame:
    return dedup.dup_running(v.messages)


@query("mailbox_counters")
def mailbox_counters(v: MailViews) -> DataFrame:
    return counters.mailbox_counters(v.messages, v.mailboxes, v.mail_labels)


@query("unread_adjusted")
def unread_adjusted(v: MailViews) -> DataFrame:
    return counters.unread_adjusted(v.messages, v.mailboxes, v.mail_labels)


@query("orphan_addresses")
def orphan_addresses(v: MailViews) -> DataFrame:
    return counters.orphan_addresses(v.addresses, v.messages, v.recipients).select(
        "rowid", "address", "comment")


@query("cascade_recipients")
def cascade_recipients(v: MailViews) -> DataFrame:
    """Recipients left after deleting the messages flagged deleted."""
    gone = v.messages.filter(is_deleted(F.col("flags"))).select("rowid")
    return counters.cascade_delete(v.recipients, gone).select(
        "message_rowid", "type", "address_id", "position")
