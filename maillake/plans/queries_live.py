"""Registered queries of live mail: mailboxes that grow, processed marks, live adjusted unread counts.

Each lands what Spark derives from the driver tables in several steps, drains it through the stream after each, and
returns what the stream has then; the twin is the batch answer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maillake.functions import flags as FL
from maillake.functions import headers as H
from maillake.functions.mime import choose_body, mime_parts
from maillake.functions.text import line_count
from maillake.operators import discovery, forms, pages, wishes
from maillake.plans import params as P
from maillake.plans.catalog import query
from maillake.plans.queries_text import rendered_messages, request_bodies
from maillake.sinks import mailfiles, writers
from maillake.sinks.writers import mbox_record
from maillake.sources import messages as M
from maillake.sources import tables
from maillake.sources.driver import MailViews
from maillake.streaming import growing, jobs, live


@query("stream_mailbox")
def stream_mailbox(v: MailViews) -> DataFrame:
    """S7 + T1: mailboxes stream as they grow; the first look finds each cut inside its last message."""
    out = jobs.scratch_dir(v.spark, "mailbox")
    mail = (rendered_messages(v).join(v.messages.select("rowid", "sender", "date_sent"), "rowid")
            .select("rowid", "date_sent", F.format_string("box-%02d.mbox", F.pmod(F.xxhash64("rowid"), F.lit(P.MAILBOX_FILES))).alias("box"),
                    mbox_record(F.col("raw"), F.col("sender"), F.col("date_sent")).alias("value")))

    def drain(**options) -> None:
        arrived = M.parse_messages(growing.mail_stream(v.spark, out + "/boxes", **options))
        once = jobs.archive_once(arrived.withColumn("flags", F.lit(0)), "message_id", F.sha2("raw", 256))
        jobs.run_available_now(once.select("message_id", "subject", "date_sent", "body"), out + "/_checkpoint", out_dir=out + "/data")

    order = ["date_sent", "rowid"]
    mailfiles.write_mailboxes(mail.filter(F.col("date_sent") < P.ARRIVED), out + "/boxes", "box", order, "value", drop_last=20)
    drain()
    mailfiles.write_mailboxes(mail, out + "/boxes", "box", order, "value")
    drain()
    drain(settle_seconds=0)         # no more mail comes: the last messages count as whole
    return v.spark.read.parquet(out + "/data").select(
        "message_id", "subject", F.col("date_sent").alias("date_utc"), F.regexp_replace("body", r"\n+$", "").alias("body"))


def _landed(v: MailViews, df: DataFrame, folder: str) -> DataFrame:
    """Add rows to a landing folder; the folder as a stream."""
    df.write.mode("append").parquet(folder)
    return jobs.landing_stream(v.spark, folder, df.schema)


@query("stream_marks")
def stream_marks(v: MailViews) -> DataFrame:
    """T4: which events lead to processing, with ``error`` as the command set and ``signup`` as clear."""
    out = jobs.scratch_dir(v.spark, "marks")
    kind = F.when(F.col("event_type") == "error", live.SET).when(F.col("event_type") == "signup", live.CLEAR).otherwise(live.MAIL)
    rows = v.events.select(F.col("user_id").cast("string").alias("id"), kind.alias("kind"), F.col("ts").alias("at"),
                           F.lit(False).alias("deleted"), F.when(kind == live.MAIL, F.col("event_id").cast("string")).alias("payload"))
    for part in (rows.filter(F.col("at") < P.FIRST_EVENTS), rows.filter(F.col("at") >= P.FIRST_EVENTS)):
        live.run_process_once(_landed(v, part, out + "/land"), out + "/_checkpoint", out + "/data")
    return v.spark.read.parquet(out + "/data").select("id", F.col("at").cast("string").alias("at"), "cause", "payload")


@query("stream_unread_adjusted")
def stream_unread_adjusted(v: MailViews) -> DataFrame:
    """T5 + A12: live counters with the unread count adjusted for duplicates; the first events land twice, once late."""
    out = jobs.scratch_dir(v.spark, "unread")
    rowid = F.col("user_id") * 100 + F.get_json_object("props", "$.k").cast("long")
    rows = v.events.select(rowid.alias("rowid"), F.when(rowid % 10 != 0, F.concat(F.lit("m"), F.floor(rowid / 4))).alias("message_id"),
                           F.col("event_type").alias("mailbox"), (F.col("value") < 5).alias("removed"),
                           F.when(F.col("value") >= 60, 1).when(F.col("value") >= 50, 2).otherwise(0).alias("flags"), F.col("ts").alias("event_ts"))
    first, rest = rows.filter(F.col("event_ts") < P.FIRST_EVENTS), rows.filter(F.col("event_ts") >= P.FIRST_EVENTS)
    for part in (first, rest, first):
        jobs.run_available_now(_landed(v, part, out + "/land"), out + "/_checkpoint",
                               writer=live.counters_batch_writer(out + "/state", out + "/counters", message_id="message_id"))
    return live.current_counters(v.spark, out + "/state", out + "/counters")


@query("stream_two_pass")
def stream_two_pass(v: MailViews) -> DataFrame:
    """Headers are triaged as they arrive; only messages whose rule asks for the full text meet their bodies."""
    out = jobs.scratch_dir(v.spark, "twopass")
    head = v.messages.select("rowid", "subject", "priority", FL.flags_from_bits(F.col("flags")).alias("imap_flags"))
    rules = [jobs.Rule(F.col("priority") == "2-HIGH", folder="High", full=True), jobs.Rule(F.col("subject").startswith("Re: "), folder="Replies")]
    jobs.run_available_now(_landed(v, head, out + "/land"), out + "/_checkpoint", writer=jobs.triage_batch_writer(out + "/data", rules))
    triaged = v.spark.read.parquet(out + "/data")

    def transform(bodies: DataFrame) -> DataFrame:
        return bodies.select("rowid", line_count(F.col("raw")).alias("lines"), H.header(H.parse_headers(F.col("raw")), "message-id").alias("message_id"))

    full = jobs.full_pass(triaged, rendered_messages(v), "rowid", transform)
    return full.join(triaged.select("rowid", "target_folder"), "rowid").select("rowid", "target_folder", "lines", "message_id")


def request_mail(v: MailViews) -> DataFrame:
    """Requests as mail: an HTML part first, then the form as text/plain, in base64 for odd ids."""
    b, odd = F.concat(F.lit("=_r"), F.col("request_id").cast("string")), F.col("request_id") % 2 == 1
    form = F.when(odd, F.base64(F.encode("body", "UTF-8"))).otherwise(F.col("body"))
    raw = F.concat(F.lit("From: form@mail.example\nMessage-ID: <"), F.col("request_id").cast("string"), F.lit("@form.example>\nSubject: request\n"),
                   F.lit('MIME-Version: 1.0\nContent-Type: multipart/alternative; boundary="'), b, F.lit('"\n\n--'), b,
                   F.lit("\nContent-Type: text/html\n\n<p>Name: nobody</p>\n--"), b, F.lit("\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: "),
                   F.when(odd, F.lit("base64")).otherwise(F.lit("8bit")), F.lit("\n\n"), form, F.lit("\n--"), b, F.lit("--\n"))
    return request_bodies(v).select("request_id", raw.alias("raw"))


@query("stream_request_mail")
def stream_request_mail(v: MailViews) -> DataFrame:
    """Request mail as it arrives in a mailbox: body choice (P9, P10), form, reply and tally, each written once per batch."""
    out, keys = jobs.scratch_dir(v.spark, "requestmail"), ["name", "email", "segment"]
    mail = request_mail(v).select("request_id", F.lit("requests.mbox").alias("box"),
                                  mbox_record(F.col("raw"), F.lit("form@mail.example"), F.lit(None).cast("timestamp_ntz")).alias("value"))

    def write(batch: DataFrame, epoch: int) -> None:
        # the mail is stored first: the mailbox is read once, and no other Python step runs beside its readers
        jobs.write_epoch(batch, out + "/mail", epoch)
        mail = batch.sparkSession.read.parquet(f"{out}/mail/epoch={epoch}")
        best = choose_body(mime_parts(mail, "message_id", "headers", "body"), "message_id")
        request = F.regexp_extract("message_id", r"<(\d+)@", 1).cast("long")
        fields = forms.form_fields(best.select(request.alias("request_id"), F.col("text").alias("body")), "request_id", "body", keys)
        jobs.write_epoch(fields, out + "/fields", epoch, "status")
        done = batch.sparkSession.read.parquet(f"{out}/fields/epoch={epoch}").filter(F.col("status") == "ok")
        jobs.write_epoch(forms.reply_render(done, "request_id", P.REPLY_TEMPLATE, keys, P.RESPONDER_ADDRESS, P.CC_ADDRESS), out + "/replies", epoch)
        jobs.write_tally(done, out + "/tally", epoch, ["name", "email"], P.TALLY_DATE)

    for drop_last, settle in ((30, None), (0, 0)):
        mailfiles.write_mailboxes(mail, out + "/boxes", "box", ["request_id"], "value", drop_last=drop_last)
        arrived = M.parse_messages(growing.mail_stream(v.spark, out + "/boxes", settle_seconds=settle))
        jobs.run_available_now(arrived.select("message_id", "headers", "body", "raw_is_bytes"), out + "/_checkpoint", writer=write)
    fields, replies = v.spark.read.parquet(out + "/fields").drop("epoch"), v.spark.read.parquet(out + "/replies").select("request_id", "reply")
    tally = tables.read_tally(v.spark, out + "/tally").groupBy(F.col("email")).agg(F.count(F.lit(1)).alias("tallied"))
    return (fields.join(replies, "request_id", "left").join(tally, "email", "left")
            .select("request_id", "name", "email", "segment", "status", F.length("reply").alias("reply_chars"),
                    F.when(F.col("status") == "ok", F.col("tallied")).alias("tallied")))


@query("discovery_files")
def discovery_files(v: MailViews) -> DataFrame:
    """K4 + K5: discovery hits written as files and reports, read back: name, digest of the bytes, lines of the reports."""
    out = jobs.scratch_dir(v.spark, "discovery")
    hits = discovery.discovery(
        v.bodies, raw="text", to=F.col("lang"), cc=F.lit(None).cast("string"), from_=F.col("source"),
        subject=F.substring_index(F.col("text"), "\n", 1), date=F.lit(None).cast("string"), message_id=F.sha2(F.col("text"), 256),
        original_file=F.concat(F.lit("documents/"), F.col("doc_id").cast("string")), order=["doc_id"], search_pattern=P.SEARCH_RE,
        privileged_pattern=P.PRIVILEGED_RE, keep=["text"])
    writers.write_discovery(hits, out, raw="text")
    files = v.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.eml").load(out)
    name = F.regexp_extract("path", r"((?:reg|priv)/s\d+\.eml)$", 1)
    serial = F.regexp_extract("path", r"s(\d+)\.eml$", 1).cast("long")
    report = None
    for folder, part in (("reg", "report"), ("priv", "preport")):
        r = v.spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{out}/{part}").select(F.col("snum").cast("long").alias("snum"), F.lit(folder).alias("listed"))
        report = r if report is None else report.unionByName(r)
    return files.select(serial.alias("snum"), name.alias("name"), F.sha2("content", 256).alias("sha256")).join(report, "snum").select("name", "sha256", "listed")


@query("term_index_html")
def term_index_html(v: MailViews) -> DataFrame:
    """K8 + A9: the lines of the HTML term index, each page with its sender (here the document's source)."""
    d = v.bodies.select(F.col("doc_id").alias("page"), "text")
    index = pages.term_index_with_senders(d, v.bodies.select(F.col("doc_id").alias("page"), F.col("source").alias("sender")))
    return writers.term_index_html(index).select("k", "i", "value")


@query("digest_bodies")
def digest_bodies(v: MailViews) -> DataFrame:
    """Pages as mail of a digest, with the source from the subject, a keyword of the body or its first URL."""
    i = F.col("page_id")
    subject = F.concat(F.lit("News "), i.cast("string"), F.when(i % 3 == 0, F.lit(" (The Daily)")).when(i % 7 == 0, F.lit(" spam")).otherwise(F.lit("")))
    m = v.html_bodies.select(i.alias("rowid"), subject.alias("subject"), F.concat(F.lit("see "), F.col("url"), F.lit(" for\n"), F.col("html")).alias("body"))
    issued = m.filter(F.col("rowid") % 5 == 0)
    d = wishes.digest_with_bodies(m, issued, ["news"], ["spam"], P.PUBLICATIONS)
    return d.select("item", "rowid", "subject", "source", F.sha2("body", 256).alias("body_sha256"))
