"""Raw mailbox records -> message frame -> star schema.

``parse_messages`` is pure projection (no shuffle): header array, the
common header fields, parsed date with its zone offset, body, size and
flags.  ``star_schema`` then builds the dimension tables with dense ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maillake.functions import flags as FL
from maillake.functions import headers as H
from maillake.functions.dates import parse_header_date
from maillake.functions.text import line_count
from maillake.operators import model

RECIPIENT_TYPES = {"to": 0, "cc": 1, "bcc": 2}


def parse_messages(raw: DataFrame, fmt: str = "mbox") -> DataFrame:
    """One row per message with parsed headers (nothing is dropped; missing headers are NULL)."""
    h = H.parse_headers(F.col("raw"))
    df = raw.withColumn("headers", h)
    hd = F.col("headers")
    date = parse_header_date(H.header(hd, "date"))
    cols = [
        "path", "file_block_start", "seq",
        # The status letters become flags below and leave the headers
        (H.without_status(hd) if "imap_flags" not in raw.columns and fmt in ("mbox", "mmdf") else hd).alias("headers"),
        H.header(hd, "from").alias("from_"),
        H.header(hd, "to").alias("to"),
        H.header(hd, "cc").alias("cc"),
        H.header(hd, "bcc").alias("bcc"),
        H.header(hd, "subject").alias("subject"),
        H.header(hd, "date").alias("date_header"),
        date["utc"].alias("date_sent"),
        date["tz_offset_min"].alias("tz_offset_min"),
        H.header(hd, "message-id").alias("message_id"),
        H.header(hd, "in-reply-to").alias("in_reply_to"),
        H.header(hd, "references").alias("references"),
        H.body_text(F.col("raw")).alias("body"),
        F.octet_length("raw").cast("long").alias("bytes"),
        line_count(F.col("raw")).alias("lines"),
        F.col("raw"),
    ]
    if "imap_flags" in raw.columns:
        cols.append(F.col("imap_flags"))
    elif fmt in ("mbox", "mmdf"):
        cols.append(FL.imap_flags(H.status_letters(hd), "mbox").alias("imap_flags"))
    else:
        cols.append(F.array().cast("array<string>").alias("imap_flags"))
    cols += [F.col(c) for c in ("raw_is_bytes", "file_time", "rowid") if c in raw.columns]
    return df.select(*cols)


def header_local_time(msgs: DataFrame) -> DataFrame:
    """Wall-clock time in the sender's own zone (for local-hour grids)."""
    return msgs.withColumn("date_local",
                           F.col("date_sent") + F.make_dt_interval(mins=F.col("tz_offset_min")))


def flat_rows(msgs: DataFrame) -> DataFrame:
    """K1 shape: header text unparsed: (message_date, sender_email, rcpt_email, subject)."""
    return msgs.select(F.col("date_header").alias("message_date"), F.col("from_").alias("sender_email"),
                       F.col("to").alias("rcpt_email"), F.col("subject"))


def recipient_rows(msgs: DataFrame, id_col: str = "message_rowid") -> DataFrame:
    """One row per (message, recipient) with type (0 to, 1 cc, 2 bcc) and position."""
    parts = []
    for name, code in RECIPIENT_TYPES.items():
        parts.append(msgs.select(F.col(id_col), F.lit(code).alias("type"),
                                 F.posexplode(F.coalesce(H.parse_addresses(F.col(name)),
                                                         F.array().cast("array<struct<name:string,email:string>>")))
                                 .alias("position", "addr")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(id_col, "type", "position", F.col("addr.email").alias("address"),
                      F.col("addr.name").alias("comment"))


def star_schema(msgs: DataFrame) -> dict[str, DataFrame]:
    """K2: messages fact + subjects / addresses / recipients dimensions, dense ids.

    ``msgs`` needs a unique ``rowid`` (e.g. from ``global_row_number`` over
    (path, file_block_start, seq)).
    """
    sender = H.parse_address(F.col("from_"))
    flat = msgs.select("rowid", sender["email"].alias("sender_email"), "subject", "date_sent")
    star = model.star_load(flat)
    rc = recipient_rows(msgs.withColumnRenamed("rowid", "message_rowid"))
    addr = star["addresses"]
    new_addr = model.build_dimension(rc.select(F.col("address")).withColumn("comment", F.lit("")),
                                     ["address", "comment"], addr)
    rcpt = (rc.join(new_addr.select(F.col("rowid").alias("address_id"), "address"), "address", "left")
            .select("message_rowid", "type", "address_id", "position"))
    subjects = star["subjects"]
    return {"messages": star["messages"], "subjects": subjects, "addresses": new_addr,
            "recipients": rcpt}

