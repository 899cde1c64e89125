"""Registered queries over bodies, subjects and forms (text operators)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maillake.functions import text as T
from maillake.operators import discovery, forms, model
from maillake.operators.dedup import dedup_keep_newest
from maillake.plans import params as P
from maillake.plans.catalog import query
from maillake.plans.sequential import global_row_number
from maillake.sources.driver import MailViews


@query("discovery_hits")
def discovery_hits(v: MailViews) -> DataFrame:
    """F3 F4 P14 P16 W7 W6 K5 over whole document texts."""
    d = v.bodies
    return discovery.discovery(
        d, raw="text", to=F.col("lang"), cc=F.lit(None).cast("string"), from_=F.col("source"),
        subject=F.substring_index(F.col("text"), "\n", 1), date=F.lit(None).cast("string"),
        message_id=F.sha2(F.col("text"), 256),
        original_file=F.concat(F.lit("documents/"), F.col("doc_id").cast("string")),
        order=["doc_id"], search_pattern=P.SEARCH_RE, privileged_pattern=P.PRIVILEGED_RE)


@query("serials")
def serials(v: MailViews) -> DataFrame:
    """Serial numbers 1..n of the messages kept after duplicate removal, in folder order."""
    m = v.messages.select("mailbox", "message_id", "rowid", "flags")
    dups = dedup_keep_newest(m).select("rowid")
    kept = m.join(dups, "rowid", "left_anti").select("mailbox", "rowid")
    return global_row_number(kept, ["mailbox", "rowid"], name="snum")


@query("normalized_subjects")
def normalized_subjects(v: MailViews) -> DataFrame:
    """P13 + U4: normalised subject -> distinct subject texts and messages."""
    m = v.messages.select("subject")
    return (m.groupBy(T.normalized_subject(F.col("subject")).alias("normalized_subject"))
            .agg(F.count_distinct("subject").alias("subjects"),
                 F.count(F.lit(1)).alias("messages")))


def _messages_flat(v: MailViews) -> DataFrame:
    """K1 shape: (rowid, sender_email, subject, date_sent)."""
    a = v.addresses.select(F.col("rowid").alias("sender"), F.col("address").alias("sender_email"))
    return v.messages.select("rowid", "sender", "subject", "date_sent").join(a, "sender", "left")


@query("star_load")
def star_load(v: MailViews) -> DataFrame:
    """U4 + J16 + K2: load flat rows into dimensions with dense ids, then read back."""
    star = model.star_load(_messages_flat(v))
    s = star["subjects"].select(F.col("rowid").alias("subject_id"), "subject", "normalized_subject")
    a = star["addresses"].select(F.col("rowid").alias("sender_id"), F.col("address").alias("sender_email"))
    return (star["messages"].join(s, "subject_id", "left").join(a, "sender_id", "left")
            .select("rowid", "sender_id", "subject_id", "sender_email", "subject", "normalized_subject"))


def request_bodies(v: MailViews) -> DataFrame:
    """Form-mail requests derived from customers (one request per customer).

    A BUILDING customer sends an empty name field; a negative balance sends an
    empty email field, so the earlier quoted email line stays in force.
    """
    c = v.customer.select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    a = v.addresses.select(F.col("rowid").alias("c_custkey"), "address")
    j = c.join(a, "c_custkey")
    name_line = F.when(F.col("c_mktsegment") == "BUILDING", F.lit("> Name:")).otherwise(
        F.concat(F.lit("> Name: "), F.col("c_name")))
    old_line = F.concat(F.lit("> Email: "), F.lower(F.regexp_replace("c_name", "#", ".")),
                        F.lit("@old.example.org"))
    new_line = F.when(F.col("c_acctbal") >= 0, F.concat(
        F.lit("Email: "), F.col("c_name"), F.lit(" <"), F.col("address"), F.lit(">"))
    ).otherwise(F.lit("Email:"))
    seg_line = F.concat(F.lit("Segment: "), F.col("c_mktsegment"))
    return j.select(F.col("c_custkey").alias("request_id"),
                    F.concat_ws("\n", name_line, old_line, new_line, seg_line).alias("body"))


def rendered_messages(v: MailViews) -> DataFrame:
    """Driver messages as RFC 822 text: display-name From, To list (recipient
    order), Subject, Date in a local zone (+0100 for odd ids, -0500 otherwise),
    Message-ID, a folded header line and a one-line body."""
    a = v.addresses.select(F.col("rowid").alias("_aid"), "address")
    to = (v.recipients.filter(F.col("type") == 0).join(a, F.col("address_id") == F.col("_aid"))
          .groupBy("message_rowid")
          .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "address"))),
                                        lambda s: s["address"]), ", ").alias("to_line")))
    m = (v.messages.select("rowid", "sender", "subject", "date_sent")
         .join(a, F.col("sender") == F.col("_aid"), "left")
         .join(to, F.col("rowid") == F.col("message_rowid"), "left"))
    utc = F.col("date_sent") + F.make_dt_interval(hours=(F.col("rowid") % 24).cast("int"))
    east = F.col("rowid") % 2 == 1
    local = utc + F.make_dt_interval(mins=F.when(east, F.lit(60)).otherwise(F.lit(-300)))
    zone = F.when(east, F.lit("+0100")).otherwise(F.lit("-0500"))
    raw = F.concat(
        F.lit("Received: from relay.example\n\tby mx.example\n"),
        F.lit('From: "Sender '), F.col("sender").cast("string"), F.lit('" <'), F.col("address"), F.lit(">\n"),
        F.when(F.col("to_line").isNotNull(), F.concat(F.lit("To: "), F.col("to_line"), F.lit("\n")))
         .otherwise(F.lit("")),
        F.lit("Subject: "), F.col("subject"), F.lit("\n"),
        F.lit("Date: "), F.date_format(local, "EEE, d MMM yyyy HH:mm:ss"), F.lit(" "), zone, F.lit("\n"),
        F.lit("Message-ID: <"), F.col("rowid").cast("string"), F.lit("@mail.example>\n\nbody\n"))
    return m.select("rowid", raw.alias("raw"))


@query("parse_roundtrip")
def parse_roundtrip(v: MailViews) -> DataFrame:
    """P1-P5 + P16 over every driver message rendered as RFC 822 text."""
    from maillake.functions import headers as H
    from maillake.functions.dates import parse_header_date
    r = rendered_messages(v).withColumn("h", H.parse_headers(F.col("raw")))
    frm = H.parse_address(H.header(F.col("h"), "from"))
    d = parse_header_date(H.header(F.col("h"), "date"))
    return r.select(
        "rowid", frm["name"].alias("from_name"), frm["email"].alias("from_email"),
        F.coalesce(F.size(H.parse_addresses(H.header(F.col("h"), "to"))), F.lit(0)).alias("n_to"),
        H.header(F.col("h"), "subject").alias("subject"),
        d["utc"].alias("date_utc"), d["tz_offset_min"].alias("tz_offset_min"),
        H.header(F.col("h"), "message-id").alias("message_id"),
        T.line_count(F.col("raw")).alias("lines"))


def multipart_documents(v: MailViews) -> DataFrame:
    """Each document as a multipart/alternative message: an HTML part first, then
    the whole text as text/plain (base64 for non-English documents, 7bit else)."""
    d = v.bodies.select("doc_id", "text", "lang")
    b = F.concat(F.lit("=_b"), F.col("doc_id").cast("string"))
    b64 = F.col("lang") != "en"
    plain_body = F.when(b64, F.base64(F.encode("text", "UTF-8"))).otherwise(F.col("text"))
    raw = F.concat(
        F.lit("From: docs@mail.example\nSubject: document "), F.col("doc_id").cast("string"),
        F.lit('\nMIME-Version: 1.0\nContent-Type: multipart/alternative; boundary="'), b, F.lit('"\n\n'),
        F.lit("--"), b, F.lit("\nContent-Type: text/html; charset=utf-8\n\n<html><body><p>"),
        F.col("doc_id").cast("string"), F.lit("</p></body></html>\n"),
        F.lit("--"), b, F.lit("\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: "),
        F.when(b64, F.lit("base64")).otherwise(F.lit("7bit")), F.lit("\n\n"), plain_body, F.lit("\n"),
        F.lit("--"), b, F.lit("--\n"))
    return d.select("doc_id", raw.alias("raw"))


@query("mime_bodies")
def mime_bodies(v: MailViews) -> DataFrame:
    """P9 (+P10 ranking): the preferred body part of every multipart document message."""
    from maillake.functions import headers as H
    from maillake.functions.mime import choose_body, mime_parts
    m = multipart_documents(v).select("doc_id", H.parse_headers(F.col("raw")).alias("headers"),
                                      H.body_text(F.col("raw")).alias("body"))
    best = choose_body(mime_parts(m, "doc_id", "headers", "body"), "doc_id")
    # the part ends before the newline that precedes the next delimiter
    return best.select("doc_id", "content_type", F.regexp_replace("text", "\n$", "").alias("text"))


@query("form_fields")
def form_fields(v: MailViews) -> DataFrame:
    """P11 + F11: extracted fields per request and ok / error status."""
    return forms.form_fields(request_bodies(v), "request_id", "body", P.FORM_KEEP)


@query("reply_render")
def reply_render(v: MailViews) -> DataFrame:
    """P21 + P28: reply text for every usable request."""
    f = forms.form_fields(request_bodies(v), "request_id", "body", P.FORM_KEEP)
    keys = T.normalize_column_list("Name, Email, Segment")
    return forms.reply_render(f, "request_id", P.REPLY_TEMPLATE, keys,
                              P.RESPONDER_ADDRESS, P.CC_ADDRESS)


@query("first_email")
def first_email(v: MailViews) -> DataFrame:
    """First address in each document's whole text (documents without one are errors)."""
    d = v.bodies.select("doc_id", T.first_email(F.col("text")).alias("email"))
    return d.filter(F.col("email").isNotNull())


@query("html_text")
def html_text(v: MailViews) -> DataFrame:
    """P10: text of every HTML page (script/style text kept as the reference's parser does)."""
    return v.html_bodies.select("page_id", T.html_to_text(F.col("html"), accept_doctype=True)
                                .alias("text"))


@query("ascii_fold")
def ascii_fold(v: MailViews) -> DataFrame:
    """Documents folded to 7-bit ASCII."""
    return v.bodies.select("doc_id", T.ascii_fold(F.col("text")).alias("text"))


def addressees(v: MailViews) -> DataFrame:
    """S11 shape (first, last, email) from customers, plus the P22 display form."""
    c = v.customer.select("c_custkey", "c_name", "c_mktsegment")
    a = v.addresses.select(F.col("rowid").alias("c_custkey"), "address")
    j = c.join(a, "c_custkey")
    first = F.substring_index(F.col("c_name"), "#", 1)
    last = F.substring_index(F.col("c_name"), "#", -1)
    return j.select(F.col("c_custkey").alias("id"), first.alias("firstname"),
                    last.alias("lastname"), F.col("address").alias("email"),
                    F.col("c_mktsegment").alias("segment"),
                    T.display_address(first, last, F.col("address")).alias("to"))


@query("mail_merge")
def mail_merge(v: MailViews) -> DataFrame:
    """P19 + P20 + P22: one rendered letter per addressee."""
    return forms.mail_merge(addressees(v), P.MERGE_TEMPLATE, P.MERGE_DEFAULTS, id_col="id")


@query("send_schedule")
def send_schedule(v: MailViews) -> DataFrame:
    """Send time of each letter, one every 45 s in addressee order."""
    a = addressees(v).select("id", "email")
    return forms.send_schedule(a, ["id"], P.SEND_START, P.SEND_DELAY_SECONDS)
