"""Registered queries: paged documents (conversations as pages, documents as index pages)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maillake.operators import pages
from maillake.plans.catalog import query
from maillake.plans.sequential import global_row_number
from maillake.session import ensure_checkpoint_dir
from maillake.sources.driver import MailViews

IMPORT_LIMIT = 200


def conversation_pages(v: MailViews) -> DataFrame:
    """Each conversation turn is a page; a user turn opens a new message (P23 stand-in)."""
    t = v.threads.select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), "role", "text")
    return t


def _assigned(v: MailViews) -> DataFrame:
    p = conversation_pages(v)
    return pages.assign_messages(p, F.col("role") == "user")


@query("first_pages")
def first_pages(v: MailViews) -> DataFrame:
    """The pages that open a message."""
    p = conversation_pages(v)
    first_block = F.concat(F.when(F.col("role") == "user", F.lit("From:\n")).otherwise(F.lit("")), F.col("text"))
    return p.filter(pages.is_first_page(first_block)).select("doc", "page")


@query("page_to_message")
def page_to_message(v: MailViews) -> DataFrame:
    """W5 + A8: pages carried forward to their message; message text in page order."""
    return pages.message_text(_assigned(v)).select(
        "doc", "message_start", "pages", "full_text")


@query("import_limit")
def import_limit(v: MailViews) -> DataFrame:
    """the pages loaded before the message count reaches the limit."""
    return pages.import_limit(_assigned(v), IMPORT_LIMIT).select("doc", "page", "message_start")


@query("term_index")
def term_index(v: MailViews) -> DataFrame:
    """A9 + F12 + P25 over whole documents (one document = one page)."""
    d = v.bodies.select(F.col("doc_id").alias("page"), "text")
    return pages.term_index(d).select("term", "n_pages", "title", "pages")


LINE_HEIGHT = 12.0
WORD_WIDTH = 10.0
BESIDE_LABEL = "the"


def page_geometry(v: MailViews) -> tuple[DataFrame, DataFrame]:
    """Page tables derived from conversation turns (S13 shape).

    Spans: one per word (line i of the turn at y0 = 12 i, word j at x0 = 10 j),
    ``pos`` = document order.  Links: one per line, a mailto link of the
    speaker (kind 2 for user turns, 1 otherwise) centred on that line.
    """
    t = v.threads.select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), "role", "text")
    lines = t.select("doc", "page", "role", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    words = lines.select("doc", "page", "line_no",
                         F.posexplode(F.split(F.trim("line"), " ", -1)).alias("word_no", "text"))
    words = words.filter(F.col("text") != "")
    spans = words.select(
        "doc", "page", (F.col("line_no") * 100000 + F.col("word_no")).cast("long").alias("pos"), "text",
        (F.col("word_no") * WORD_WIDTH).alias("x0"), (F.col("line_no") * LINE_HEIGHT).alias("y0"),
        (F.col("word_no") * WORD_WIDTH + WORD_WIDTH - 1).alias("x1"),
        (F.col("line_no") * LINE_HEIGHT + LINE_HEIGHT - 2).alias("y1"))
    links = lines.select(
        "doc", "page", F.col("line_no").cast("long").alias("pos"),
        F.when(F.col("role") == "user", F.lit(2)).otherwise(F.lit(1)).alias("kind"),
        F.concat(F.lit("mailto:"), F.col("role"), F.col("doc").cast("string"), F.lit("@chat.example")).alias("uri"),
        (F.col("line_no") * LINE_HEIGHT + 2).alias("y0"), (F.col("line_no") * LINE_HEIGHT + 6).alias("y1"))
    return spans, links


@query("link_labels")
def link_labels(v: MailViews) -> DataFrame:
    """J6 + P24: label of each mailto link = first span (document order) holding its mid-y."""
    spans, links = page_geometry(v)
    return pages.link_labels(links, spans).select("doc", "page", "link_pos", "label", "address")


@query("beside_label")
def beside_label(v: MailViews) -> DataFrame:
    """J7 + A10: text beside a label span, and link addresses concatenated per label."""
    spans, links = page_geometry(v)
    beside = pages.text_beside(spans, BESIDE_LABEL).select(
        "doc", "page", F.lit("beside").alias("kind"), F.lit(BESIDE_LABEL).alias("label"), "value")
    fields = pages.link_fields(pages.link_labels(links, spans)).select(
        "doc", "page", F.lit("links").alias("kind"), "label", "value")
    return beside.unionByName(fields)


@query("message_keywords")
def message_keywords(v: MailViews) -> DataFrame:
    """Distinct (keyword id, message) pairs; a document body is a message, its
    keywords are its noun runs; keyword ids are dense in keyword order."""
    kw = v.bodies.select(F.col("doc_id").alias("message_rowid"),
                         F.explode(pages.noun_runs(F.col("text"))).alias("keyword")).distinct()
    ensure_checkpoint_dir(v.spark)
    kw = kw.checkpoint()        # narrow rows, so that texts are tagged once
    ids = global_row_number(kw.select("keyword").distinct(), ["keyword"], name="keyword_id")
    return kw.join(ids, "keyword").select("keyword_id", "keyword", "message_rowid")
