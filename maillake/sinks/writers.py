"""Sinks.  Every writer is a distributed DataFrame write: one
part file per partition, atomic job commit, nothing through the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maillake.operators.discovery import report_frame

FLAT_COLUMNS = ["message_date", "sender_email", "rcpt_email", "subject"]


def write_flat(flat: DataFrame, path: str, rejects_path: str | None = None,
               mode: str = "errorifexists") -> None:
    """K1: (date, from, to, subject) rows; rows with no header at all go to rejects.

    The reference creates the table without IF NOT EXISTS, so a second load
    fails: the default mode keeps that (``errorifexists``).
    """
    bad = F.coalesce(*[F.col(c) for c in FLAT_COLUMNS]).isNull()
    flat.filter(~bad).select(*FLAT_COLUMNS).write.mode(mode).parquet(path)
    if rejects_path:
        flat.filter(bad).write.mode(mode).parquet(rejects_path)


def write_star(tables: dict[str, DataFrame], root: str, zap: bool = False) -> None:
    """K2: one Parquet table per star-schema table; ``zap`` = overwrite (start over)."""
    mode = "overwrite" if zap else "errorifexists"
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{root.rstrip('/')}/{name}")


def mbox_record(raw: Column, sender: Column, date: Column) -> Column:
    """K3: one mbox record: ``From <sender> <asctime date>`` line, then the message with body lines
    that start with ``From `` escaped as ``>From ``, ending in a line feed."""
    env = F.concat(F.lit("From "), F.coalesce(sender.cast("string"), F.lit("MAILER-DAEMON")), F.lit(" "),
                   F.coalesce(F.date_format(date, "EEE MMM dd HH:mm:ss yyyy"), F.lit("Thu Jan 01 00:00:00 1970")))
    body = F.regexp_replace(raw, r"(?m)^From ", ">From ")
    return F.concat(env, F.lit("\n"), F.regexp_replace(body, r"\n?$", "\n"))


def mbox_text(df: DataFrame, raw: str = "raw", sender: str = "envelope_from",
              date: str = "envelope_date") -> DataFrame:
    """K3: mbox records (``value``), each to be followed by a blank line."""
    return df.select(mbox_record(F.col(raw), F.col(sender), F.col(date)).alias("value"))


def write_mbox(df: DataFrame, path: str, **kw) -> None:
    """K3: each output part file is a valid mbox (records are whole messages)."""
    mbox_text(df, **kw).write.option("lineSep", "\n").mode("errorifexists").text(path)


def write_discovery(hits: DataFrame, root: str, raw: str = "raw") -> None:
    """K4 + K5: each kept message as a file ``reg/sNNNNNN.eml`` or ``priv/sNNNNNN.eml`` with its original bytes, and the
    reports ``report`` (regular) and ``preport`` (privileged) as CSV with the ten columns.

    ``hits`` comes from ``discovery(..., keep=[raw])``, with ``raw_is_bytes`` kept as well where the readers gave it.
    Files with other bytes are not overwritten, nor are reports.
    """
    from maillake.sinks.mailfiles import mail_octets, write_files

    name = F.concat(F.when(F.col("privileged"), F.lit("priv")).otherwise(F.lit("reg")), F.format_string("/s%06d.eml", "snum"))
    is_bytes = F.col("raw_is_bytes") if "raw_is_bytes" in hits.columns else F.lit(False)
    write_files(hits, root, name, mail_octets(F.col(raw), is_bytes))
    rep = report_frame(hits)
    rep.filter(~hits["privileged"]).write.mode("errorifexists").option("header", True).csv(f"{root}/report")
    rep.filter(hits["privileged"]).write.mode("errorifexists").option("header", True).csv(f"{root}/preport")


def json_reports(reports: dict[str, DataFrame]) -> DataFrame:
    """K6: ``{title, row...}`` JSON lines for every report row."""
    out = None
    for title, df in reports.items():
        part = df.select(F.to_json(F.struct(F.lit(title).alias("title"), *df.columns)).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


def write_json_reports(reports: dict[str, DataFrame], path: str) -> None:
    json_reports(reports).write.mode("overwrite").text(path)


def dot_lines(edges: DataFrame, src: str = "src", dst: str = "dst", n: str = "n") -> DataFrame:
    """K7: ``"a" -> "b" [label="n",fontsize=24];`` lines (wrap in ``digraph G { }`` when joining parts)."""
    return edges.select(F.format_string('"%s" -> "%s" [label="%d",fontsize=24];',
                                        F.coalesce(src, F.lit("")), F.coalesce(dst, F.lit("")),
                                        F.col(n)).alias("value"))


def write_dot(edges: DataFrame, path: str) -> None:
    dot_lines(edges).write.mode("overwrite").text(path)


def term_index_html(index: DataFrame, page_link: str = "page/{}") -> DataFrame:
    """K8: per term a heading line and one link line per page, in term order
    (the ordering key column ``k`` lets ``orderBy`` produce a sorted file).

    An index of ``term_index_with_senders`` has each page's sender after its link.
    """
    head = index.select(F.col("term").alias("k"), F.lit(0).alias("i"),
                        F.format_string("<h3>%s</h3>", F.col("title")).alias("value"))
    senders = F.col("sender_list") if "sender_list" in index.columns else F.array().cast("array<string>")
    pages = index.select(F.col("term").alias("k"), senders.alias("s"), F.posexplode(F.split("pages", ",")).alias("i", "p"))
    who = F.coalesce(F.concat(F.lit(" "), F.try_element_at("s", F.col("i") + 1)), F.lit(""))
    link = pages.select("k", (F.col("i") + 1).alias("i"), F.format_string(
        "&nbsp;&nbsp;&nbsp;<a href='%s'>[page %s]</a>%s<br>",
        F.replace(F.lit(page_link), F.lit("{}"), F.col("p")), F.col("p"), who).alias("value"))
    return head.unionByName(link)


def write_term_index(index: DataFrame, path: str) -> None:
    term_index_html(index).orderBy("k", "i").select("value").write.mode("overwrite").text(path)


def tally_rows(fields: DataFrame, cols: Sequence[str], date: str | None = None) -> DataFrame:
    """K9: the date and the kept columns."""
    d = F.lit(date).cast("date") if date else F.current_date()
    return fields.select(d.alias("date"), *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in cols])


def append_tally(fields: DataFrame, path: str, cols: Sequence[str], date: str | None = None) -> None:
    """K9: tab-separated tally rows (date + kept columns), appended; header names the date."""
    tally_rows(fields, cols, date).write.mode("append").option("sep", "\t").option("header", True).csv(path)


def write_day_counts(day_counts: DataFrame, path: str) -> None:
    """The per-day counts behind the bar chart, as CSV."""
    day_counts.write.mode("overwrite").option("header", True).csv(path)


def append_list_entries(entries: DataFrame, path: str, col: str = "entry") -> None:
    """Add entries (address or ``original :: replacement`` lines) to a list folder."""
    entries.select(F.col(col).alias("value")).write.mode("append").text(path)
