"""Registered queries over people and the ways of mail: groups, persons, topics, networks, routes, invitations, suspicious links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maillake.functions import headers as H
from maillake.operators import cohesion, people, routes, similar, wishes
from maillake.plans import params as P
from maillake.plans.catalog import query
from maillake.sources.driver import MailViews


@query("cohesive_groups")
def cohesive_groups(v: MailViews) -> DataFrame:
    """R2: truss number of every link between a sender and recipients, and between neighbours on a recipient list."""
    # recipients are dealt out once, by message, for their neighbours and for the sender
    beside = Window.partitionBy("message_rowid").orderBy("position").rangeBetween(1, 1)
    r = v.recipients.filter(F.col("message_rowid").isNotNull()).select(
        "message_rowid", "address_id",
        F.when(F.col("position").isNotNull(), F.collect_set("address_id").over(beside)).otherwise(F.array()).alias("beside"))
    m = v.messages.select(F.col("rowid").alias("message_rowid"), "sender")
    linked = F.explode(F.concat(F.array("sender"), "beside")).alias("dst")
    return cohesion.truss_numbers(r.join(m, "message_rowid", "left").select(F.col("address_id").alias("src"), linked))


@query("similar_attachments")
def similar_attachments(v: MailViews) -> DataFrame:
    """Every document as an attachment: its digest and its group of similar ones."""
    return similar.similar_groups(v.bodies.select("doc_id", F.encode("text", "UTF-8").alias("content")), "doc_id")


@query("persons")
def persons(v: MailViews) -> DataFrame:
    """customers' addresses under names that three customers share, written in two ways; each tenth uses a common name."""
    k = F.col("rowid")
    evidence = v.addresses.filter(F.col("comment") == "").select(k, "address")
    name = F.when(k % 10 == 0, F.lit("Information Desk")).when(k % 2 == 0, F.format_string("Ann-Marie N%d", F.floor(k / 3))).otherwise(
        F.format_string("N%d, ann MARIE", F.floor(k / 3)))
    return people.persons(evidence.select(name.alias("name"), F.upper("address").alias("address")))


@query("topic_people")
def topic_people(v: MailViews) -> DataFrame:
    """Senders and recipients of each priority as the people of a topic; how many of them each has never mailed with."""
    m = v.messages.select("rowid", "sender", F.col("priority").alias("topic"))
    sent = m.join(v.recipients.select(F.col("message_rowid").alias("rowid"), F.col("address_id").alias("to")), "rowid")
    members = m.select("topic", F.col("sender").alias("person")).unionByName(sent.select("topic", F.col("to").alias("person")))
    return people.topic_people(members, sent.select(F.col("sender").alias("a"), F.col("to").alias("b")))


@query("sender_networks")
def sender_networks(v: MailViews) -> DataFrame:
    """Each message's address in the longest listed network, and the senders whose main network changed by month."""
    a, b = F.col("sender") % 40, F.col("rowid") % 200
    ip = F.when(F.col("rowid") % 2 == 0, F.format_string("10.%d.%d.7", a, b)).otherwise(F.format_string("2001:DB8:%s::%s", F.hex(a), F.hex(b)))
    n = v.nation.select(F.col("n_nationkey").alias("k"))
    listed = (n.select(F.format_string("10.%d.0.0/16", "k").alias("network")).union(n.select(F.format_string("2001:db8:%s::/48", F.lower(F.hex("k")))))
              .union(n.select(F.format_string("10.%d.128.0/17", "k"))).union(n.filter("k = 0").select(F.lit("10.0.0.0/8"))))
    return routes.moves(routes.with_network(v.messages.select("sender", "date_sent", ip.alias("ip")), "ip", listed), "sender", "date_sent", "network")


def routed_headers(v: MailViews) -> DataFrame:
    """Three Received lines for each message, by relays whose clocks differ, in different zones."""
    def line(by: int, late: int, zone: int) -> F.Column:
        at = F.col("date_sent") + F.make_dt_interval(secs=F.lit(late) + F.col("rowid") % 60)
        sign = "+" if zone >= 0 else "-"
        local = F.date_format(at + F.make_dt_interval(mins=F.lit(zone)), "EEE, d MMM yyyy HH:mm:ss")
        return F.concat(F.lit("Received: from host (host ["), F.format_string("10.0.%d.%d", F.lit(by), F.col("rowid") % 250), F.lit("])\n\tby r"),
                        ((F.col("rowid") * by) % 5 + by * 10).cast("string"), F.lit("; "), local, F.lit(f" {sign}{abs(zone) // 60:02d}{abs(zone) % 60:02d}\n"))

    raw = F.concat(line(3, 95, 60), line(2, 40, -330), line(1, 0, 0), F.lit("From: a@x\n\nbody\n"))
    return v.messages.select("rowid", H.parse_headers(raw).alias("headers"))


@query("hop_delays")
def hop_delays(v: MailViews) -> DataFrame:
    """R11 + P5: the time between the hops of every message."""
    return routes.hop_delays(routes.routing_table(routed_headers(v)))


@query("calendar_entries")
def calendar_entries(v: MailViews) -> DataFrame:
    """Every document as the summary of an invitation, folded into lines of 60 characters."""
    flat = F.regexp_replace("text", r"[\r\n]+", " ")
    ics = F.concat(F.lit("BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nSUMMARY;LANGUAGE="), F.col("lang"), F.lit(":"),
                   F.regexp_replace(flat, "(?s)(.{60})", "$1\r\n "), F.lit('\r\nDTSTART;TZID="Zone/A:b":20200101T'),
                   F.format_string("%02d", F.col("doc_id") % 24), F.lit("0000\r\nLOCATION:"), F.col("source"), F.lit("\r\nEND:VEVENT\r\nEND:VCALENDAR\r\n"))
    return wishes.calendar_events(v.bodies.select("doc_id", ics.alias("text")), "doc_id").select("doc_id", "summary", "dtstart", "location")


@query("suspicious_mail")
def suspicious_mail(v: MailViews) -> DataFrame:
    """Pages whose own address, named twice in running text, belongs to a listed domain, or which hold a listed word."""
    text = F.concat(F.lit("see "), F.col("url"), F.lit(", then ("), F.col("url"), F.lit(").\n"), F.col("html"))
    listed = v.spark.createDataFrame([(d,) for d in P.SUSPICIOUS_DOMAINS], "entry string")
    return wishes.suspicious(v.html_bodies.select("page_id", text.alias("text")), "page_id", "text", listed, P.SUSPICIOUS_WORDS)
