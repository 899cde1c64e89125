"""Registered queries: lists, searches, flags and folders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maillake.functions import flags as FL
from maillake.operators import folders, lists
from maillake.operators import search as S
from maillake.plans.catalog import query
from maillake.sources.driver import MailViews


def allow_list(v: MailViews) -> DataFrame:
    """List file derived from the tables: domains of region-1 nations and the
    addresses of suppliers with a negative balance."""
    n = v.nation.filter(F.col("n_regionkey") == 1).select(
        F.concat(F.lit("@"), F.lower("n_name"), F.lit(".example.org")).alias("entry"))
    neg = v.supplier.filter(F.col("s_acctbal") < 0).select(
        (F.col("s_suppkey") + 10_000_000).alias("rowid"))
    s = v.addresses.join(neg, "rowid", "left_semi").select(F.col("address").alias("entry"))
    return n.unionByName(s)


def replacement_list(v: MailViews) -> DataFrame:
    """Replacement file derived from the tables: nation domain -> region desk
    (partial), negative-balance supplier address -> blocked (exact)."""
    n = v.nation.join(v.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").cast("long").alias("line_no"),
        F.concat(F.lit("@"), F.lower("n_name"), F.lit(".example.org")).alias("original"),
        F.concat(F.lower("r_name"), F.lit("-desk@mail.example.org")).alias("replacement"))
    neg = v.supplier.filter(F.col("s_acctbal") < 0).select(
        (F.col("s_suppkey") + 10_000_000).alias("rowid"), "s_suppkey")
    s = v.addresses.join(neg, "rowid").select(
        (F.col("s_suppkey") + 1000).alias("line_no"), F.col("address").alias("original"),
        F.lit("blocked@mail.example.org").alias("replacement"))
    return n.unionByName(s)


@query("whitelist_domain")
def whitelist_domain(v: MailViews) -> DataFrame:
    """Is some list entry contained in the address."""
    return lists.list_contains(v.addresses, "address", allow_list(v)).select(
        "rowid", "address", "listed")


@query("replace_lookup")
def replace_lookup(v: MailViews) -> DataFrame:
    """Exact replacement, else first partial (file order), else the address."""
    return lists.replace_lookup(v.addresses, "address", replacement_list(v), partial=True).select(
        "rowid", "address", "replaced")


def search_frame(v: MailViews) -> DataFrame:
    """Messages with the columns the search keys read.

    The address side is grouped on its key, which makes it unique: a search that does not
    read the sender's text loses the join.
    """
    a = v.addresses.groupBy(F.col("rowid").alias("sender")).agg(F.max("address").alias("from_"))
    m = v.messages.join(a, "sender", "left")
    return m.select("rowid", "from_", "subject", "date_sent", "bytes", "flags",
                    F.col("date_sent").alias("internal_date"),
                    FL.flags_from_bits(F.col("flags")).alias("imap_flags"))


@query("search_flag")
def search_flag(v: MailViews) -> DataFrame:
    """UNSEEN UNDELETED."""
    return search_frame(v).filter(S.unseen_undeleted()).select("rowid")


@query("search_string")
def search_string(v: MailViews) -> DataFrame:
    """OR FROM customer.00000012 SUBJECT urgent (case-insensitive substrings)."""
    return search_frame(v).filter(S.or_(S.from_("customer.00000012"), S.subject("urgent"))
                                  ).select("rowid")


@query("search_date")
def search_date(v: MailViews) -> DataFrame:
    """SINCE 1-Jan-1998 BEFORE 1-Feb-1998 (date parts)."""
    return search_frame(v).filter(S.since("1998-01-01") & S.before("1998-02-01")).select("rowid")


@query("search_size")
def search_size(v: MailViews) -> DataFrame:
    """LARGER 400000 SMALLER 450000."""
    return search_frame(v).filter(S.larger(400000) & S.smaller(450000)).select("rowid")


@query("search_boolean")
def search_boolean(v: MailViews) -> DataFrame:
    """OR (NOT SEEN) (DELETED SUBJECT re:), within UID 1:*."""
    p = S.or_(S.not_(S.seen()), S.and_(S.deleted(), S.subject("re:"))) & S.uid("1:*", largest=F.col("largest"))
    return S.with_largest(search_frame(v)).filter(p).select("rowid")


@query("since_date")
def since_date(v: MailViews) -> DataFrame:
    """sent since 2000-06-15 (date part only)."""
    return search_frame(v).filter(S.since("2000-06-15")).select("rowid", "internal_date")


def listing_lines(v: MailViews) -> DataFrame:
    """LIST response lines for the folders (P33 input), built from the mailboxes view."""
    mb = v.mailboxes
    fl = (F.when(F.col("source").isNotNull(), F.lit("\\HasNoChildren"))
          .when(F.col("rowid") >= 20, F.lit("\\HasNoChildren \\Noselect"))
          .otherwise(F.lit("\\HasChildren")))
    return mb.select("rowid", F.format_string('(%s) "/" "%s"', fl, F.col("url")).alias("line"))


@query("folder_list_parse")
def folder_list_parse(v: MailViews) -> DataFrame:
    return folders.parse_listing(listing_lines(v)).select("rowid", "flags", "delimiter", "name")


@query("folder_filter")
def folder_filter(v: MailViews) -> DataFrame:
    """base folders nation_1..3 plus every label/ sub-folder except label/nation_10."""
    parsed = folders.parse_listing(listing_lines(v))
    return folders.folder_filter(parsed, include=["nation_1", "nation_2", "nation_3", "label"],
                                 include_subfolders=True, exclude=["label/nation_10"]
                                 ).select("rowid", "name")


@query("folder_rename")
def folder_rename(v: MailViews) -> DataFrame:
    """J13 + P32: map region-2 nations under Region2/, then '/' -> '.' with prefix INBOX."""
    mp = v.nation.filter(F.col("n_regionkey") == 2).select(
        F.lower("n_name").alias("src"), F.concat(F.lit("Region2/"), F.lower("n_name")).alias("dst"))
    f = v.mailboxes.select("rowid", F.col("url").alias("name"))
    return folders.rename_folders(f, mp, src_delim="/", dst_delim=".", dst_prefix="INBOX."
                                  ).select("rowid", "name", "target")


@query("flag_map")
def flag_map(v: MailViews) -> DataFrame:
    """P29 + P31 + P34: bits -> IMAP flags -> maildir / mbox letters -> IMAP again; copy-clean."""
    imap = FL.flags_from_bits(F.col("flags"))
    md = FL.format_flags(imap, "maildir")
    mb = FL.format_flags(imap, "mbox")
    return v.messages.select(
        "rowid",
        F.array_join(imap, ",").alias("imap"),
        md.alias("maildir"), mb.alias("mbox"),
        F.array_join(FL.imap_flags(md, "maildir"), ",").alias("from_maildir"),
        F.array_join(FL.imap_flags(mb, "mbox"), ",").alias("from_mbox"),
        F.array_join(F.array_sort(FL.clean_for_copy(F.concat(imap, F.array(F.lit(FL.RECENT))),
                                                    drop_deleted=True)), ",").alias("copy_flags"))


@query("flag_edits")
def flag_edits(v: MailViews) -> DataFrame:
    """Add \\Flagged to urgent mail, remove \\SEEN (any case) from replies."""
    m = v.messages
    f = FL.flags_from_bits(F.col("flags"))
    f = F.when(F.col("priority") == "1-URGENT", FL.add_flag(f, "\\Flagged")).otherwise(f)
    f = F.when(F.col("subject").startswith("Re: "), FL.remove_flag(f, "\\SEEN")).otherwise(f)
    return m.select("rowid", F.array_join(F.array_sort(f), ",").alias("flags"))


@query("flag_bits")
def flag_bits(v: MailViews) -> DataFrame:
    """P34 + F8: seen / deleted / unread bits per message."""
    f = F.col("flags")
    return v.messages.select(
        "rowid", (f.bitwiseAND(1) != 0).alias("seen"), (f.bitwiseAND(2) != 0).alias("deleted"),
        ((f.bitwiseAND(1) == 0) & (f.bitwiseAND(2) == 0)).alias("unread"))
