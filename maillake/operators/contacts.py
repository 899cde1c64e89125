"""Contact consolidation across address books.

Input per book: records ``(pk, first, last)`` and emails ``(address, owner)``.
Everything is an aggregate with an ordering key (``min_by``) -- partial
aggregation, so a person with a million addresses is one small partial row
per task, not one huge list.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maillake.functions.predicates import ends_with_any

# Fixed default of the reference: domains whose addresses are ignored.
IGNORE_DOMAINS = [".mil", ".gov"]


def book_emails(records: DataFrame, emails: DataFrame, book: int) -> DataFrame:
    """Person x email by owner key; ``ord`` keeps (book, emitted order)."""
    r = records.select(F.col("pk"), F.col("first"), F.col("last"))
    e = emails.select(F.col("address").alias("email"), F.col("owner").alias("pk"), "seq")
    j = r.join(e, "pk")
    return j.select("first", "last", "email",
                    F.struct(F.lit(book).alias("book"), F.col("pk"), F.col("seq")).alias("ord"))


def union_books(books: Sequence[DataFrame]) -> DataFrame:
    """All books in one frame (book number is part of ``ord``)."""
    out = books[0]
    for b in books[1:]:
        out = out.unionByName(b)
    return out


def usable(entries: DataFrame, ignore: Sequence[str] = IGNORE_DOMAINS) -> DataFrame:
    """F5 + F6: drop ignored domains and records with neither first nor last name."""
    return entries.filter(~ends_with_any(F.col("email"), list(ignore))
                          & ~(F.col("first").isNull() & F.col("last").isNull()))


def email_rank(email) -> object:
    return (F.when(email.contains("gmail"), F.lit(1))
            .when(email.contains(".edu"), F.lit(2)).otherwise(F.lit(3)))


def best_emails(entries: DataFrame) -> DataFrame:
    """A6 + A7: per (first, last): first gmail address, else first .edu, else the
    first of the shortest; ``first_ord`` = where the person was first seen."""
    rank = email_rank(F.col("email"))
    key = F.struct(rank.alias("r"), F.when(rank == 3, F.length("email")).otherwise(F.lit(0)).alias("l"),
                   F.col("ord").alias("o"))
    return entries.groupBy("first", "last").agg(
        F.min_by("email", key).alias("best_email"),
        F.min("ord").alias("first_ord"),
        F.count(F.lit(1)).alias("n_emails"))


def one_per_email(best: DataFrame) -> DataFrame:
    """One row per best email, the person seen first keeps it."""
    return (best.groupBy("best_email")
            .agg(F.min_by(F.struct("first", "last", "n_emails"), "first_ord").alias("p"))
            .select(F.col("p.first").alias("first"), F.col("p.last").alias("last"),
                    "best_email", F.col("p.n_emails").alias("n_emails")))
