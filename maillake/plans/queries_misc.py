"""Registered queries: contacts, geo, holidays, copies, sinks' text forms, dates, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maillake.functions import dates as D
from maillake.operators import contacts, geo, stats, timegrid
from maillake.plans import reports
from maillake.plans.catalog import query
from maillake.sources.driver import MailViews

# Generic holidays (month, day, name) used by the day-count report.
HOLIDAYS = [(1, 1, "New Year's Day"), (2, 14, "Valentine's Day"), (7, 4, "Independence Day"),
            (12, 25, "Christmas")]
ARCHIVED_BEFORE = "1998-01-01 00:00:00"


def address_books(v: MailViews) -> DataFrame:
    """Two address books derived from customers and their orders (S9/U3 input)."""
    c = v.customer.select("c_custkey", "c_name", "c_mktsegment", "c_acctbal", "c_nationkey")
    unnamed = (F.col("c_mktsegment") == "AUTOMOBILE") & (F.col("c_acctbal") < 0)
    rec1 = c.select(F.col("c_custkey").alias("pk"),
                    F.when(unnamed, F.lit(None)).otherwise(F.substring_index("c_name", "#", 1)).alias("first"),
                    F.when(unnamed, F.lit(None)).otherwise(
                        F.concat_ws("-", "c_mktsegment", F.col("c_nationkey").cast("string"))).alias("last"))
    addr = v.addresses.select(F.col("rowid").alias("owner"), "address", F.lit(0).cast("long").alias("seq"))
    cust = F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    per_order = v.orders.select(
        F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("seq"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(cust, F.lit("@gmail.example.com")))
         .when(F.col("o_orderpriority") == "2-HIGH", F.concat(cust, F.lit("@cs.example.edu")))
         .when(F.col("o_orderpriority") == "3-MEDIUM", F.concat(cust, F.lit("@agency.example.gov")))
         .otherwise(F.concat(cust, F.lit("."), F.col("o_orderkey").cast("string"),
                             F.lit("@mail.example.net"))).alias("address"))
    book1 = contacts.book_emails(rec1, addr.unionByName(per_order), 1)
    # Book 2: the same customers filed by region; their gmail addresses only.
    n = v.nation.select("n_nationkey", "n_regionkey")
    r = v.region.select("r_regionkey", "r_name")
    rec2 = (c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
            .join(r, F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.col("c_custkey").alias("pk"), F.lit("Client").alias("first"),
                    F.col("r_name").alias("last")))
    book2 = contacts.book_emails(rec2, per_order.filter(F.col("address").contains("gmail")), 2)
    return contacts.union_books([book1, book2])


@query("best_contact")
def best_contact(v: MailViews) -> DataFrame:
    """One best address per person, each address kept once."""
    best = contacts.best_emails(contacts.usable(address_books(v)))
    return contacts.one_per_email(best).select("first", "last", "best_email", "n_emails")


def geotags(v: MailViews) -> DataFrame:
    """S10 shape (date_created, latitude, longitude, path) as strings, from orders."""
    o = v.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    lat = ((F.col("o_custkey") % 179) - 89 + (F.col("o_orderkey") % 10) / 10.0)
    lon = ((F.col("o_orderkey") % 359) - 179.5)
    return o.select(
        F.col("o_orderkey").alias("point_id"),
        F.concat(F.date_format("o_orderdate", "yyyy:MM:dd HH:mm:ss"), F.lit(" UTC")).alias("date_created"),
        F.when(F.col("o_orderstatus") == "P", F.lit("n/a")).otherwise(lat.cast("string")).alias("latitude"),
        lon.cast("string").alias("longitude"),
        F.concat(F.lit("img/"), F.col("o_orderkey").cast("string"), F.lit(".jpg")).alias("path"))


def gazetteer(v: MailViews) -> DataFrame:
    return v.nation.select(F.col("n_name").alias("place"),
                           (F.col("n_nationkey") * 7.0 - 84.0).alias("plat"),
                           (F.col("n_nationkey") * 14.0 - 168.0).alias("plon"))


@query("geo_nearest")
def geo_nearest(v: MailViews) -> DataFrame:
    """Nearest place of each numeric geotag, by date text."""
    tags = geo.usable_geotags(geotags(v))
    near = geo.nearest_place(tags, gazetteer(v))
    return (tags.select("point_id", "date", "path").join(near, "point_id")
            .select("point_id", "date", "path", "place",
                    F.round("distance_km", 6).alias("distance_km"))
            .orderBy("date", "point_id"))


@query("holiday_counts")
def holiday_counts(v: MailViews) -> DataFrame:
    """Mail on each holiday of every year with mail; days without mail count 0."""
    m = v.messages.select("date_sent")
    per_day = m.groupBy(F.to_date("date_sent").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    years = m.select(F.year("date_sent").alias("y")).distinct()
    hol = years.select(F.explode(F.array(*[
        F.struct(F.make_date(F.col("y"), F.lit(mo), F.lit(d)).alias("day"), F.lit(nm).alias("name"))
        for mo, d, nm in HOLIDAYS])).alias("h")).select("h.day", "h.name")
    return stats.day_counts_with_holidays(per_day, hol)


def _content_hash(m: DataFrame) -> DataFrame:
    h = F.sha2(F.concat_ws("|", "subject", F.date_format("date_sent", "yyyy-MM-dd HH:mm:ss"),
                           F.col("bytes").cast("string")), 256)
    return m.withColumn("raw_hash", h)


@query("not_yet_copied")
def not_yet_copied(v: MailViews) -> DataFrame:
    """Messages whose (Message-ID, content hash) the archive does not hold yet;
    the archive holds the mail sent before 1998."""
    from maillake.operators.dedup import not_yet_copied as nyc
    m = _content_hash(v.messages.select("rowid", "message_id", "subject", "date_sent", "bytes"))
    held = m.filter(F.col("date_sent") < F.to_timestamp_ntz(F.lit(ARCHIVED_BEFORE))).select(
        "message_id", "raw_hash")
    return nyc(m, held).select("rowid")


@query("dot_edges")
def dot_edges(v: MailViews) -> DataFrame:
    """K7: one DOT edge line per (sender, recipient) flow."""
    f = stats.flows(v.messages, v.recipients, v.addresses)
    return f.select(F.format_string('"%s" -> "%s" [label="%d",fontsize=24];',
                                    F.coalesce("src", F.lit("")), F.coalesce("dst", F.lit("")),
                                    F.col("n")).alias("line"))


@query("json_report")
def json_report(v: MailViews) -> DataFrame:
    """K6: the top-senders report as JSON lines {title, sender_email, n}."""
    t = stats.top_senders(v.messages, v.addresses, 10)
    return t.select(F.to_json(F.struct(F.lit("Top senders").alias("title"), "sender_email", "n"))
                    .alias("json"))


@query("epoch_dates")
def epoch_dates(v: MailViews) -> DataFrame:
    """Epoch seconds and back to UTC timestamp and date."""
    m = v.messages.select("rowid", D.epoch_seconds(F.col("date_sent")).alias("epoch"))
    return m.select("rowid", "epoch", D.from_epoch(F.col("epoch")).alias("utc_ts"),
                    F.to_date(D.from_epoch(F.col("epoch"))).alias("utc_date"))


@query("iso_now")
def iso_now(v: MailViews) -> DataFrame:
    """ISO text (seconds) of each message's instant."""
    return v.messages.select("rowid", D.iso_text(F.col("date_sent")).alias("iso"))


@query("day_names")
def day_names(v: MailViews) -> DataFrame:
    """P36 + W10: messages per weekday name, Monday = 0."""
    m = v.messages.select("date_sent")
    return (m.groupBy(timegrid.weekday(F.col("date_sent")).alias("weekday"),
                      timegrid.day_name(F.col("date_sent")).alias("day_name"))
            .agg(F.count(F.lit(1)).alias("n")))


@query("flow_pairs")
def flow_pairs(v: MailViews) -> DataFrame:
    """J5 + W12: sender x (To and Cc) of every message, with recipient position."""
    m = v.messages.select("rowid", "sender")
    r = v.recipients.filter(F.col("type").isin(0, 1)).select(
        F.col("message_rowid").alias("rowid"), "address_id", "type", "position")
    return m.join(r, "rowid").select("rowid", "sender", "address_id", "type", "position")


def _pdf_text(v: MailViews) -> DataFrame:
    o = v.orders.select("o_orderkey", "o_orderdate", "o_orderstatus")
    t = (F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "EEEE, MMMM d, yyyy hh:mm:ss a"))
         .when(F.col("o_orderstatus") == "O", F.date_format("o_orderdate", "MMMM d, yyyy hh:mm:ss a"))
         .otherwise(F.concat(F.lit("not a date "), F.col("o_orderkey").cast("string"))))
    return o.select(F.col("o_orderkey").alias("rowid"), t.alias("text"))


@query("pdf_dates")
def pdf_dates(v: MailViews) -> DataFrame:
    """PDF header dates with and without weekday; bad text gives NULL."""
    return _pdf_text(v).select("rowid", "text", D.parse_pdf_date(F.col("text")).alias("parsed"))


@query("date_checks")
def date_checks(v: MailViews) -> DataFrame:
    """DD-MMM-YYYY validity and two-digit hour fix-up."""
    o = v.orders.select("o_orderkey", "o_orderdate", "o_orderstatus")
    dmy = F.when(F.col("o_orderstatus") == "P", F.lit("31-Foo-1999")).otherwise(
        F.date_format("o_orderdate", "d-MMM-yyyy"))
    k = F.col("o_orderkey")
    tm = F.format_string("%d:%02d:%02d", k % 24, k % 60, (k * 7) % 60)
    return o.select(k.alias("rowid"), dmy.alias("text"), D.valid_dmy(dmy).alias("valid"),
                    D.fix_hour(tm).alias("time"))


@query("internal_date")
def internal_date(v: MailViews) -> DataFrame:
    """File time (latest delivery of low-priority mail), else Date, else load time."""
    m = v.messages.select("rowid", "date_sent", "priority")
    ft = (v.recipients.groupBy("message_rowid").agg(F.max("date_received").alias("ft"))
          .withColumnRenamed("message_rowid", "rowid"))
    j = m.join(ft, "rowid", "left")
    file_time = F.when(F.col("priority") == "5-LOW", F.col("ft"))
    return j.select("rowid", D.internal_date(file_time, F.col("date_sent"),
                                             F.to_timestamp_ntz(F.lit("2001-08-02 00:00:00")))
                    .alias("internal_date"))


@query("titled_reports")
def titled_reports(v: MailViews) -> DataFrame:
    """X5 + X6: a list of (title, SQL) reports run through spark.sql, as one long table."""
    return reports.run_titled(v)


@query("grid_by_spec")
def grid_by_spec(v: MailViews) -> DataFrame:
    """A second grid spec (day of month x hour) over mail events."""
    return timegrid.grid_long(v.mail_events, "ts", timegrid.MONTHDAY_BY_HOUR)


@query("summary_line")
def summary_line(v: MailViews) -> DataFrame:
    """P15 + P37 + P39: one fixed-width listing line per message."""
    a = v.addresses.select(F.col("rowid").alias("sender"), F.col("address").alias("from_"))
    m = v.messages.select("rowid", "sender", "subject", "date_sent").join(a, "sender", "left")
    return m.select("rowid", reports.summary_line(
        F.col("rowid").cast("string"), F.coalesce("from_", F.lit("No From")),
        F.col("date_sent"), F.coalesce("subject", F.lit("No Subject"))).alias("line"))
