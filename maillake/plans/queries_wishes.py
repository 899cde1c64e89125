"""Registered queries: declared wishes (tier R) and the Python-backed operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maillake.functions.mime import decoded_utf8_words, utf8_words, with_decoded_words, with_guessed_charset
from maillake.operators import stats, wishes
from maillake.plans import params as P
from maillake.plans.catalog import query
from maillake.sources.driver import MailViews

SEARCH_TERMS = ["license", "apache", "version"]


@query("activity_per_day")
def activity_per_day(v: MailViews) -> DataFrame:
    """Sent and received messages per address per day."""
    m = v.messages.select("rowid", "sender", F.to_date("date_sent").alias("day"))
    sent = m.select(F.col("sender").alias("address_id"), "day")
    rec = (v.recipients.filter(F.col("type").isin(0, 1)).select(F.col("message_rowid").alias("rowid"), "address_id")
           .join(m.select("rowid", "day"), "rowid").select("address_id", "day"))
    return wishes.activity_per_day(sent, rec)


@query("top_per_month")
def top_per_month(v: MailViews) -> DataFrame:
    """The three most frequent senders of every month."""
    m = v.messages.select(F.trunc(F.to_date("date_sent"), "month").alias("month"), "sender")
    counts = m.groupBy("month", "sender").agg(F.count(F.lit(1)).alias("n"))
    return wishes.top_k_per_group(counts, ["month"], "sender", "n", 3).select("month", "sender", "n", "rank")


@query("mail_gaps")
def mail_gaps(v: MailViews) -> DataFrame:
    """Days without any mail between the first and the last day with mail."""
    per_day = v.messages.groupBy(F.to_date("date_sent").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    return wishes.gaps(per_day)


@query("missing_refs")
def missing_refs(v: MailViews) -> DataFrame:
    """A reply names the sender's previous-month message; which named ids are absent."""
    m = v.messages.select("rowid", "message_id", "sender", "subject", "date_sent")
    ref = F.concat(F.col("sender").cast("string"), F.lit("-"),
                   F.date_format(F.add_months(F.to_date("date_sent"), -1), "yyyy-MM"))
    m = m.withColumn("refs", F.when(F.col("subject").startswith("Re: "), F.array(ref))
                     .otherwise(F.array().cast("array<string>")))
    return wishes.missing_references(m).select("ref", "referenced_by")


@query("copies_me")
def copies_me(v: MailViews) -> DataFrame:
    """Per sender, mail that reached me and how much of it had me on Cc."""
    mine = stats.me_ids(v.addresses, P.ME, P.NOT_ME)
    return wishes.copies_me(v.messages, v.recipients, mine).select("sender", "to_me", "cc_me", "always")


@query("odd_hours")
def odd_hours(v: MailViews) -> DataFrame:
    """Mail events at an hour unusual for their sender (|z| > 2)."""
    return wishes.odd_send_times(v.mail_events, "sender", "ts").select("event_id")


@query("fulltext_search")
def fulltext_search(v: MailViews) -> DataFrame:
    """Ten best documents for the query terms by tf-idf over whole texts."""
    return wishes.search_ranked(v.bodies, "doc_id", "text", SEARCH_TERMS)


@query("address_components")
def address_components(v: MailViews) -> DataFrame:
    """Addresses linked by mail (sender - recipient) grouped into components."""
    e = (v.messages.select(F.col("rowid").alias("message_rowid"), F.col("sender").alias("src"))
         .join(v.recipients.select("message_rowid", F.col("address_id").alias("dst")), "message_rowid")
         .select("src", "dst"))
    return wishes.connected_components(e).select("node", "label")


@query("weekend_grid")
def weekend_grid(v: MailViews) -> DataFrame:
    """weekday/weekend x hour grid of the mean event score (props.k)."""
    e = v.mail_events.withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return wishes.grid_mean(e, "ts", wishes.weekend, F.hour, "k")


@query("digest")
def digest(v: MailViews) -> DataFrame:
    """Urgent / high-priority subjects that are not replies and were not issued
    before (issued = mail before 1998), numbered into a digest."""
    m = v.messages.select("rowid", "subject", F.col("priority").alias("body"), "date_sent")
    issued = m.filter(F.col("date_sent") < F.to_timestamp_ntz(F.lit("1998-01-01 00:00:00")))
    return wishes.digest(m, issued, ["urgent", "high"], ["re:"]).select("item", "rowid", "subject")


@query("topics")
def topics(v: MailViews) -> DataFrame:
    """Dominant LDA topic of each document (iterative model fit: rows-only check)."""
    return wishes.lda_topics(v.bodies, "doc_id", "text").select("doc_id", "topic")


@query("rfc2047")
def rfc2047(v: MailViews) -> DataFrame:
    """Document first lines sent as RFC 2047 base64 words, decoded back."""
    first = F.substring_index("text", "\n", 1)
    # Spark's base64 breaks long output into MIME lines; an encoded word is one token.
    b64 = F.regexp_replace(F.base64(F.encode(first, "UTF-8")), "[\\r\\n]", "")
    enc = F.concat(F.lit("=?UTF-8?B?"), b64, F.lit("?="))
    encoded = v.bodies.select("doc_id", enc.alias("encoded"))
    return with_decoded_words(encoded, "encoded", "subject").select("doc_id", "subject")


@query("rfc2047_text")
def rfc2047_text(v: MailViews) -> DataFrame:
    """Whole documents sent as RFC 2047 base64 words (as many as needed), decoded back."""
    return v.bodies.select("doc_id", decoded_utf8_words(utf8_words(F.col("text"))).alias("text"))


@query("rfc2047_words")
def rfc2047_words(v: MailViews) -> DataFrame:
    """Whole documents sent as RFC 2047 words, decoded by the decoder for words of any charset and encoding."""
    words = v.bodies.select("doc_id", utf8_words(F.col("text")).alias("words"))
    return with_decoded_words(words, "words", "text").select("doc_id", "text")


@query("charset_guess")
def charset_guess(v: MailViews) -> DataFrame:
    """Bodies stored in UTF-16 (non-English) or UTF-8; the guess picks the encoding."""
    raw = F.when(F.col("lang") == "en", F.encode("text", "UTF-8")).otherwise(F.encode("text", "UTF-16LE"))
    g = with_guessed_charset(v.bodies.select("doc_id", "text", raw.alias("raw")), "raw", "g")
    return g.select("doc_id", F.col("g.charset").alias("charset"),
                    (F.col("g.text") == F.col("text")).alias("round_trip"))
