"""People: one person with several addresses, and people of a topic who never mailed each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maillake.functions.text import ascii_fold
from maillake.operators.wishes import connected_components
from maillake.session import ensure_checkpoint_dir

MAX_ADDRESSES = 8       # of a name that still tells a person
MAX_NAMES = 8           # of an address that still is one person's


def name_key(name):
    """A name without case, accents, order and punctuation: ``Doe, Ann-Marie`` and ``ann marie doe`` are one."""
    words = F.regexp_extract_all(F.lower(ascii_fold(name)), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    return F.array_join(F.array_sort(words), " ")


def persons(evidence: DataFrame, name: str = "name", address: str = "address", max_addresses: int = MAX_ADDRESSES,
            max_names: int = MAX_NAMES, least_words: int = 2) -> DataFrame:
    """``address, person``: addresses used under one name are one person's, named by the smallest address.

    ``evidence`` has a row for each use of an address under a name.  The weight of a name as evidence is one in
    the number of addresses that bear it: a name of more than ``max_addresses`` (``info``, ``admin``) or of fewer
    than ``least_words`` words joins nothing, nor does an address of more than ``max_names`` names (a mailing list).
    Addresses are compared in lower case; null and empty ones are left out, and an address without telling names is
    a person of its own.
    """
    ensure_checkpoint_dir(evidence.sparkSession)
    used = (evidence.select(name_key(F.col(name)).alias("n"), F.lower(F.trim(F.col(address))).alias("a"))
            .filter("a IS NOT NULL AND a <> ''").distinct().checkpoint())      # names are made once, for four uses
    named = used.filter(F.col("n").isNotNull() & (F.size(F.split("n", " ")) >= least_words))
    telling = named.groupBy("n").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c").between(2, max_addresses)).select("n")
    own = named.groupBy("a").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") <= max_names).select("a")
    # addresses sort before names in a component's label
    pairs = named.join(telling, "n", "left_semi").join(own, "a", "left_semi")
    links = pairs.select(F.concat(F.lit("a"), "a").alias("src"), F.concat(F.lit("n"), "n").alias("dst"))
    found = connected_components(links).filter(F.col("node").startswith("a"))
    return (used.select("a").distinct().join(found.select(F.expr("substr(node, 2)").alias("a"), F.expr("substr(label, 2)").alias("p")), "a", "left")
            .select(F.col("a").alias("address"), F.coalesce("p", "a").alias("person")))


def topic_people(members: DataFrame, mailed: DataFrame) -> DataFrame:
    """``topic, person, people, linked, never_mailed``: how many others of the topic a person has and has not mailed with.

    ``members`` has (topic, person), ``mailed`` (a, b) in either direction.  Who never mailed is counted as the rest,
    so pairs of people who have nothing to do with each other are not listed.
    """
    of = members.select("topic", "person").filter("topic IS NOT NULL AND person IS NOT NULL").distinct()
    size = of.groupBy("topic").agg(F.count(F.lit(1)).alias("people"))
    ways = mailed.select("a", "b").unionByName(mailed.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    linked = (of.join(ways, of.person == ways.a).select("topic", "person", F.col("b").alias("other"))
              .join(of.select("topic", F.col("person").alias("other")), ["topic", "other"], "left_semi")
              .groupBy("topic", "person").agg(F.count(F.lit(1)).alias("linked")))
    return (of.join(size, "topic").join(linked, ["topic", "person"], "left")
            .select("topic", "person", "people", F.coalesce("linked", F.lit(0)).alias("linked"))
            .withColumn("never_mailed", F.col("people") - 1 - F.col("linked")))
