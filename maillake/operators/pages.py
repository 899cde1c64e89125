"""Paged documents (e.g. mail printed to PDF) -> messages, fields and term index.

SURVEY W5, A8, A9, A10, F12, F13, J6, J7, P23, P24, P25, U5.  Input tables
hold already-extracted page geometry (PDF parsing itself is a per-file
library and is not rebuilt):

* ``pages(doc, page, text, first_block)``
* ``page_spans(doc, page, pos, text, x0, y0, x1, y1)``
* ``page_links(doc, page, pos, kind, uri, y0, y1)``

Ordered work (which message a page belongs to) uses the range-partitioned
carry-forward, so one huge document is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maillake.plans.sequential import carry_forward, global_row_number
from maillake.session import ensure_checkpoint_dir

MAILTO_KIND = 2          # link kind of an external URI link
TERM_MAX_PAGES = 50      # F12: a term is indexed only when it is on fewer pages

# --- fixed values: proper-noun run cleaning (P25) ---------------------------
NOUN_DROP_CHARS = ["|", "‘", "’", "“", "”"]   # removed
NOUN_SPACE_CHARS = ["*"]                                          # become a space
# ----------------------------------------------------------------------------

SENTENCE_SPLIT_RE = r"[.!?]+\s+"
TOKEN_TRIM_RE = r"^[^A-Za-z0-9]+|[^A-Za-z0-9]+$"
CAPITALISED_RE = r"^[A-Z][A-Za-z0-9'-]*$"
_SEP = "\u0001"
_PDF = "\u0002"


def is_first_page(first_block: Column) -> Column:
    """The page's first text block starts with ``From:`` and a newline."""
    return F.coalesce(first_block.startswith("From:\n"), F.lit(False))


def is_mailto(kind: Column, uri: Column) -> Column:
    """An external link whose URI is a mailto: address."""
    return (kind == MAILTO_KIND) & F.coalesce(uri.startswith("mailto:"), F.lit(False))


def assign_messages(pages: DataFrame, is_first: Column, doc: str = "doc",
                    page: str = "page") -> DataFrame:
    """Each page belongs to the latest first page at or before it (same doc);
    pages before a doc's first first-page are dropped.  Adds ``message_start``."""
    tagged = pages.withColumn("_start", F.when(is_first, F.col(page)))
    carried = carry_forward(tagged, [doc], [page], "_start", name="message_start").drop("_start")
    return carried.filter(F.col("message_start").isNotNull())


PAGE_CHUNK = 1024   # pages concatenated together before the per-message join


def message_text(assigned: DataFrame, doc: str = "doc", page: str = "page",
                 text: str = "text", chunk: int = PAGE_CHUNK) -> DataFrame:
    """Page texts of a message concatenated in page order.

    Two levels: pages are joined within chunks of ``chunk`` page numbers
    (a huge message's chunks are spread over many tasks), then the chunk
    texts are joined in chunk order, so no list ever holds more than
    ``chunk`` pages or pages/``chunk`` chunk texts.
    """
    ck = assigned.withColumn("_chunk", F.floor(F.col(page) / F.lit(chunk)))
    parts = (ck.groupBy(doc, "message_start", "_chunk")
             .agg(F.count(F.lit(1)).alias("_n"),
                  F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(page, text))),
                                           lambda s: s[text]), "").alias("_t")))
    return (parts.groupBy(doc, "message_start")
            .agg(F.sum("_n").alias("pages"),
                 F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_chunk", "_t"))),
                                          lambda s: s["_t"]), "").alias("full_text")))


def import_limit(assigned: DataFrame, limit: int, doc: str = "doc") -> DataFrame:
    """load stops when the message count reaches ``limit`` (so limit - 1 messages)."""
    msgs = assigned.select(doc, "message_start").distinct()
    numbered = global_row_number(msgs, [doc, "message_start"], name="message_no")
    kept = numbered.filter(F.col("message_no") < limit)
    return assigned.join(kept, [doc, "message_start"], "left_semi")


def link_labels(links: DataFrame, spans: DataFrame) -> DataFrame:
    """Label of each mailto link = first span (document order) on the same page
    whose [y0, y1] holds the link's mid-y; lower-cased, ':' removed; links whose label
    is empty then are dropped.

    Equi-join on (doc, page) first, then the range condition, then min_by
    over the span position: a range join with an equi key, no cross product.
    """
    lk = (links.filter(is_mailto(F.col("kind"), F.col("uri")))
          .select("doc", "page", F.col("pos").alias("link_pos"), "uri",
                  ((F.col("y0") + F.col("y1")) / 2).alias("_mid")))
    sp = spans.select("doc", "page", F.col("pos").alias("span_pos"), F.col("text").alias("_t"),
                      F.col("y0").alias("_sy0"), F.col("y1").alias("_sy1"))
    j = lk.join(sp, ["doc", "page"]).filter(F.col("_mid").between(F.col("_sy0"), F.col("_sy1")))
    best = j.groupBy("doc", "page", "link_pos", "uri").agg(
        F.min_by("_t", "span_pos").alias("_label"))
    return best.select("doc", "page", "link_pos", "uri",
                       F.replace(F.lower("_label"), F.lit(":"), F.lit("")).alias("label"),
                       F.regexp_replace("uri", "mailto:", "").alias("address")).filter(F.col("label") != "")


def link_fields(labelled: DataFrame) -> DataFrame:
    """A10: per page and label, the link addresses joined by spaces (link order)."""
    return (labelled.groupBy("doc", "page", "label")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("link_pos", "address"))),
                                          lambda s: s["address"]), " ").alias("value")))


def text_beside(spans: DataFrame, label: str) -> DataFrame:
    """Text of the spans on the label span's line (same y0 and y1), itself
    excluded, joined by a space in span order; one row per (doc, page)."""
    lab = (spans.filter(F.col("text") == label)
           .groupBy("doc", "page").agg(F.min_by(F.struct("pos", "y0", "y1"), "pos").alias("_l"))
           .select("doc", "page", F.col("_l.pos").alias("_lpos"), F.col("_l.y0").alias("y0"),
                   F.col("_l.y1").alias("y1")))
    same = spans.join(lab, ["doc", "page", "y0", "y1"]).filter(F.col("pos") != F.col("_lpos"))
    return (same.groupBy("doc", "page")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))),
                                          lambda s: s["text"]), " ").alias("value")))


def first_page_fields(links: DataFrame, spans: DataFrame) -> DataFrame:
    """E4 first-page record: per (doc, page) with at least one labelled mailto link,
    the to / from / cc addresses (A10), the subject and date text beside their
    labels (J7), the parsed date (P6); missing to / from / subject are ''."""
    from maillake.functions.dates import parse_pdf_date

    f = link_fields(link_labels(links, spans))
    wide = f.groupBy("doc", "page").pivot("label", ["to", "from", "cc"]).agg(F.first("value"))
    subj = text_beside(spans, "Subject:").withColumnRenamed("value", "subject")
    date = text_beside(spans, "Date:").withColumnRenamed("value", "date_text")
    out = wide.join(subj, ["doc", "page"], "left").join(date, ["doc", "page"], "left")
    return out.select("doc", "page",
                      F.coalesce("to", F.lit("")).alias("to"), F.coalesce("from", F.lit("")).alias("from"),
                      "cc", F.coalesce("subject", F.lit("")).alias("subject"), "date_text",
                      parse_pdf_date(F.col("date_text")).alias("date"))


def noun_runs(text: Column) -> Column:
    """P25 (re-aimed): sorted distinct runs of capitalised words, per sentence,
    the sentence's first word skipped; a run touching a ``.pdf`` token is dropped;
    vertical bars and curly quotes removed, ``*`` to space, stripped, non-empty.

    The reference tags parts of speech with a trained model; here a
    capitalised word stands for a proper noun.
    """
    def token_mark(w, i):
        t = F.regexp_replace(w, TOKEN_TRIM_RE, "")
        pdf = F.lower(w).rlike(r"\.pdf[^a-z0-9]*$")
        cap = (i > 0) & t.rlike(CAPITALISED_RE)
        return (F.when(pdf & cap, F.concat(t, F.lit(_PDF)))
                .when(pdf, F.lit(_PDF + _SEP))
                .when(cap, t).otherwise(F.lit(_SEP)))

    sentences = F.split(text, SENTENCE_SPLIT_RE, -1)
    per_sentence = F.transform(sentences, lambda s: F.split(
        F.array_join(F.transform(F.split(F.trim(s), r"\s+", -1), token_mark), " "),
        r"\s*" + _SEP + r"\s*", -1))
    runs = F.flatten(per_sentence)
    kept = F.filter(runs, lambda r: ~r.contains(_PDF))
    cleaned = F.transform(kept, lambda r: F.trim(_clean_noun(r)))
    return F.array_sort(F.array_distinct(F.filter(cleaned, lambda r: F.length(r) > 0)))


def _clean_noun(r: Column) -> Column:
    for ch in NOUN_DROP_CHARS:
        r = F.replace(r, F.lit(ch), F.lit(""))
    for ch in NOUN_SPACE_CHARS:
        r = F.replace(r, F.lit(ch), F.lit(" "))
    return r


def term_index_with_senders(pages: DataFrame, page_sender: DataFrame, page: str = "page",
                            text: str = "text", max_pages: int = TERM_MAX_PAGES) -> DataFrame:
    """A9 as the reference prints it: per term also the sender of each listed page's
    message (``page_sender(page, sender)``, e.g. from ``assign_messages`` joined to the
    first pages' From field), aligned with ``pages``; '?' when unknown.  ``senders`` is one text, ``sender_list`` the same as a list."""
    idx = term_index(pages, page, text, max_pages)
    exploded = idx.select("term", F.posexplode(F.split("pages", ",")).alias("_i", "_p"))
    ps = page_sender.select(F.col(page).cast("string").alias("_p"), F.col("sender").alias("_s"))
    j = exploded.join(ps, "_p", "left")
    froms = j.groupBy("term").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("_i", F.coalesce("_s", F.lit("?")).alias("s")))),
        lambda x: x["s"]).alias("sender_list")).withColumn("senders", F.array_join("sender_list", ","))
    return idx.join(froms, "term", "left")


def term_index(pages: DataFrame, page: str = "page", text: str = "text",
               max_pages: int = TERM_MAX_PAGES) -> DataFrame:
    """A9 + F12: lower-cased term -> display form (last page's, greatest form there),
    sorted page list, for terms on fewer than ``max_pages`` pages.

    The page count is an algebraic aggregate computed first; only terms that
    pass the rarity filter are collected, so no list ever holds more than
    ``max_pages`` entries however common a term is.
    """
    terms = pages.select(page, F.explode(noun_runs(F.col(text))).alias("form"))
    terms = terms.withColumn("term", F.lower("form"))
    # texts are tagged once: the narrow (term, page, form) rows feed both branches below
    ensure_checkpoint_dir(pages.sparkSession)
    tp = terms.groupBy("term", page).agg(F.max("form").alias("form")).checkpoint()
    counts = tp.groupBy("term").agg(F.count(F.lit(1)).alias("n_pages"))
    rare = counts.filter(F.col("n_pages") < max_pages)
    return (tp.join(rare, "term")
            .groupBy("term", "n_pages")
            .agg(F.max_by("form", page).alias("title"),
                 F.array_join(F.array_sort(F.collect_list(F.col(page))).cast("array<string>"), ",")
                 .alias("pages")))
