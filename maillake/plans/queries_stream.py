"""Registered streaming queries (rows-only checks): each drains a driver table as a
file stream (``availableNow``) through the job and returns what the sink wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maillake.functions import flags as FL
from maillake.operators import forms
from maillake.plans import params as P
from maillake.plans.catalog import query
from maillake.plans.queries_text import request_bodies
from maillake.sources.driver import MailViews, message_id_expr
from maillake.streaming import jobs


def _orders_stream(v: MailViews) -> DataFrame:
    schema = v.orders.schema
    return jobs.landing_stream(v.spark, v.sf_dir, schema, glob="orders.parquet")


def _mail_rows(o: DataFrame) -> DataFrame:
    """Arriving orders as mail rows (same derivation as the messages view)."""
    return o.select(
        F.col("o_orderkey").alias("rowid"),
        message_id_expr(F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderdate")).alias("message_id"),
        F.concat(F.when(F.col("o_orderkey") % 3 == 0, F.lit("Re: ")).otherwise(F.lit("")),
                 F.col("o_orderpriority")).alias("subject"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_orderdate").alias("date_sent"),
        F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 0)
         .otherwise(2).cast("int").alias("flags"),
        F.floor("o_totalprice").cast("long").alias("bytes"))


@query("stream_archive")
def stream_archive(v: MailViews) -> DataFrame:
    """T1 + T2 + T4: archive each arriving message once (deleted skipped)."""
    s = _mail_rows(_orders_stream(v))
    h = F.sha2(F.concat_ws("|", "subject", F.col("date_sent").cast("string"), F.col("bytes").cast("string")), 256)
    arch = jobs.archive_once(s, "message_id", h)
    out = jobs.scratch_dir(v.spark, "archive")
    jobs.run_available_now(arch, out + "/_checkpoint", out_dir=out + "/data")
    # Which copy of a duplicate arrives first is not defined; the archived keys are.
    return v.spark.read.parquet(out + "/data").select("message_id", "dedup_key")


@query("stream_triage")
def stream_triage(v: MailViews) -> DataFrame:
    """T3 + X2: ordered rules pick folder and flags; output partitioned by folder."""
    s = _mail_rows(_orders_stream(v)).withColumn("imap_flags", FL.flags_from_bits(F.col("flags")))
    rules = [jobs.Rule(F.col("priority") == "1-URGENT", folder="Urgent", add_flags=["\\Flagged"]),
             jobs.Rule(F.col("subject").startswith("Re: "), folder="Replies"),
            jobs.Rule(F.col("priority") == "5-LOW", add_flags=["\\Deleted"]),
             jobs.Rule(F.col("priority") == "2-HIGH", full=True)]
    out = jobs.scratch_dir(v.spark, "triage")
    jobs.run_available_now(s, out + "/_checkpoint", writer=jobs.triage_batch_writer(out + "/data", rules))
    return v.spark.read.parquet(out + "/data").select(
        "rowid", "target_folder", F.array_join(F.array_sort("imap_flags"), ",").alias("flags"),
        "wants_full")


@query("stream_counters")
def stream_counters(v: MailViews) -> DataFrame:
    """T5: events change a message's folder and flags; counters follow the latest state."""
    sch = v.events.schema
    ev = jobs.landing_stream(v.spark, v.sf_dir, sch, glob="events.parquet")
    s = ev.select(F.col("user_id").alias("rowid"), F.col("event_type").alias("mailbox"),
                  F.when(F.col("value") >= 50, 1).otherwise(0).cast("int").alias("flags"),
                  (F.col("event_type") == "error").alias("removed"),
                  F.col("ts").alias("event_ts"))
    out = jobs.scratch_dir(v.spark, "counters")
    jobs.run_available_now(s, out + "/_checkpoint",
                           writer=jobs.counters_batch_writer(out + "/state", out + "/counters"))
    return jobs.current_counters(v.spark, out + "/state", out + "/counters")


@query("stream_requests")
def stream_requests(v: MailViews) -> DataFrame:
    """Arriving request mails -> fields -> ok (reply) or error, written per batch."""
    sch = v.customer.schema
    cust = jobs.landing_stream(v.spark, v.sf_dir, sch, glob="customer.parquet")
    out = jobs.scratch_dir(v.spark, "requests")

    def write(batch: DataFrame, epoch: int) -> None:
        class _V:  # the batch stands in for the customer table
            spark = batch.sparkSession
            customer = batch
            addresses = v.addresses
        bodies = request_bodies(_V)
        fields = forms.form_fields(bodies, "request_id", "body", ["name", "email", "segment"])
        jobs.write_epoch(fields, out + "/fields", epoch, "status")
        done = batch.sparkSession.read.parquet(f"{out}/fields/epoch={epoch}").filter(F.col("status") == "ok")
        replies = forms.reply_render(done, "request_id", P.REPLY_TEMPLATE, ["name", "email", "segment"],
                                     P.RESPONDER_ADDRESS, P.CC_ADDRESS)
        jobs.write_epoch(replies, out + "/replies", epoch)

    jobs.run_available_now(cust, out + "/_checkpoint", writer=write)
    return v.spark.read.parquet(out + "/fields").drop("epoch")
