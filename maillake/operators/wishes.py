"""Declared wishes of the reference, each a table job.

R1 per-sender activity, R5 topics, R6 top-k per period, R7 gaps, R8 missing
references, R9 always-copies, R12 odd send times, R15 ranked full-text
search, R16 person = connected addresses.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD_RE = r"[a-z][a-z0-9']+"


def activity_per_day(sent: DataFrame, received: DataFrame) -> DataFrame:
    """(address, day) -> sent and received counts (full outer of two aggregates)."""
    s = sent.groupBy("address_id", "day").agg(F.count(F.lit(1)).alias("sent"))
    r = received.groupBy("address_id", "day").agg(F.count(F.lit(1)).alias("received"))
    return (s.join(r, ["address_id", "day"], "full")
            .select("address_id", "day", F.coalesce("sent", F.lit(0)).alias("sent"),
                    F.coalesce("received", F.lit(0)).alias("received")))


def top_k_per_group(counts: DataFrame, group: Sequence[str], key: str, score: str, k: int,
                    buckets: int = 64) -> DataFrame:
    """Top ``k`` rows per group by (score desc, key desc), skew-safe.

    First a top-k inside (group, hash bucket of key) -- a hot group is spread
    over ``buckets`` window partitions -- then the final top-k over at most
    ``k * buckets`` survivors per group.
    """
    order = [F.col(score).desc(), F.col(key).desc()]
    b = counts.withColumn("_b", F.pmod(F.xxhash64(key), F.lit(buckets)))
    w1 = Window.partitionBy(*group, "_b").orderBy(*order)
    pre = b.withColumn("_r", F.row_number().over(w1)).filter(F.col("_r") <= k).drop("_r", "_b")
    w2 = Window.partitionBy(*group).orderBy(*order)
    return (pre.withColumn("rank", F.row_number().over(w2).cast("long"))
            .filter(F.col("rank") <= k))


def gaps(day_counts: DataFrame, day: str = "date") -> DataFrame:
    """Days between the first and the last day with mail that have none.

    The calendar is generated from the min/max (its size is the number of
    days in the range, not the number of messages).
    """
    bounds = day_counts.agg(F.min(day).alias("lo"), F.max(day).alias("hi"))
    cal = bounds.select(F.explode(F.sequence("lo", "hi")).alias(day))
    return cal.join(day_counts.select(day), day, "left_anti")


def missing_references(msgs: DataFrame, id_col: str = "message_id",
                       refs_col: str = "refs") -> DataFrame:
    """Ids named in References / In-Reply-To that no message in the store has."""
    named = msgs.select(F.col("rowid").alias("referenced_by"),
                        F.explode(F.col(refs_col)).alias("ref")).filter(F.col("ref").isNotNull())
    have = msgs.select(F.col(id_col).alias("ref")).filter(F.col("ref").isNotNull())
    return named.join(have, "ref", "left_anti").dropDuplicates(["ref", "referenced_by"])


def copies_me(messages: DataFrame, recipients: DataFrame, me_ids: DataFrame) -> DataFrame:
    """Per sender, mail that reached me, how much of it had me on Cc, and whether always."""
    mine = recipients.join(me_ids.select(F.col("rowid").alias("address_id")), "address_id", "left_semi")
    per_msg = mine.groupBy("message_rowid").agg(F.max(F.col("type") == 1).alias("cc_me"))
    m = messages.select(F.col("rowid").alias("message_rowid"), "sender")
    j = per_msg.join(m, "message_rowid")
    out = j.groupBy("sender").agg(F.count(F.lit(1)).alias("to_me"),
                                  F.count_if("cc_me").alias("cc_me"))
    return out.withColumn("always", F.col("to_me") == F.col("cc_me"))


def odd_send_times(events: DataFrame, who: str, ts: str, z: float = 2.0) -> DataFrame:
    """Events whose hour is more than ``z`` standard deviations from the sender's mean."""
    h = events.withColumn("_h", F.hour(ts).cast("double"))
    stats_ = h.groupBy(who).agg(F.avg("_h").alias("_mu"), F.stddev_samp("_h").alias("_sd"))
    j = h.join(stats_, who)
    return j.filter((F.col("_sd") > 0) & (F.abs(F.col("_h") - F.col("_mu")) > F.lit(z) * F.col("_sd"))) \
            .drop("_h", "_mu", "_sd")


def tokens(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """R15 tokens table: (id, term, tf) from the whole lower-cased text."""
    t = df.select(id_col, F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(f"({WORD_RE})"), 1))
                  .alias("term"))
    return t.groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"))


def search_ranked(df: DataFrame, id_col: str, text: str, terms: Sequence[str], k: int = 10
                  ) -> DataFrame:
    """Tf-idf score of the query terms per document, best ``k``.

    idf = ln(N / df).  One pass over the texts counts the query terms of each document
    (a number a term, no token rows); N, df and the scores come from that narrow table,
    checkpointed so that texts are read once.
    """
    from maillake.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(f"({WORD_RE})"), 1)
    # only the query's words are kept, then each is counted
    wanted = list(dict.fromkeys(t.lower() for t in terms))
    hits = df.select(F.col(id_col), F.filter(words, lambda w: w.isin(wanted)).alias("_hits"))

    def times(term: str) -> Column:
        return F.size(F.filter(F.col("_hits"), lambda w: w == term))

    counts = [F.sum(times(t)).alias(f"_tf{i}") for i, t in enumerate(wanted)]
    per = hits.groupBy(id_col).agg(*counts).checkpoint()
    row = per.agg(F.count(F.lit(1)).alias("n"), *[F.sum((F.col(f"_tf{i}") > 0).cast("long")).alias(f"d{i}") for i in range(len(wanted))]).first()
    score = F.lit(0.0)
    for i in range(len(wanted)):
        if row[f"d{i}"]:
            score = score + F.col(f"_tf{i}") * F.log(F.lit(float(row["n"])) / F.lit(float(row[f"d{i}"])))
    found = F.lit(False)
    for i in range(len(wanted)):
        found = found | (F.col(f"_tf{i}") > 0)
    return (per.filter(found).select(id_col, F.round(score, 6).alias("score"))
            .orderBy(F.col("score").desc(), F.col(id_col)).limit(k))


def _least_below(e: DataFrame) -> DataFrame:
    """``hi, m``: the smallest of each node's smaller neighbours."""
    return e.groupBy("hi").agg(F.min("lo").alias("m"))


def _small_star(e: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are attached to the smallest of them."""
    below = e.join(_least_below(e), "hi")
    # the link to the smallest leaves as it is; every other one as the smaller neighbour's link to it
    return below.select(F.when(F.col("lo") == F.col("m"), F.col("hi")).otherwise(F.col("lo")).alias("hi"), F.col("m").alias("lo")).distinct()


def _large_star(e: DataFrame) -> DataFrame:
    """Each node's larger neighbours are re-attached to the smallest of its closed neighbourhood."""
    m = _least_below(e).withColumnRenamed("hi", "lo")
    return e.join(m, "lo", "left").select("hi", F.coalesce("m", "lo").alias("lo")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """Component label (smallest node id) of every node of an undirected graph.

    Small-star / large-star rounds (Kiveris et al., "Connected Components in
    MapReduce and Beyond", 2014): each round is a few aggregates and joins,
    emits no more edges than it reads (never all pairs of a neighbourhood),
    and the rounds needed grow with log^2 of the graph size, not its
    diameter.  Every edge is one row, from its larger end ``hi`` to its smaller end ``lo``.
    Runs until the edge set stops changing; every round's edges
    are checkpointed (short lineage, executor loss re-reads the last round).
    """
    from maillake.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(edges.sparkSession)
    # the input is read once; a null end keeps its row, as null is a node of its own
    both = F.col("src").isNotNull() & F.col("dst").isNotNull()
    given = (edges.select(F.greatest("src", "dst").alias("hi"), F.when(both, F.least("src", "dst")).alias("lo")).distinct().checkpoint())
    nodes = given.select(F.col("hi").alias("node")).unionByName(given.select(F.col("lo").alias("node"))).distinct()
    e = given.filter(F.col("hi") > F.col("lo"))

    def signature(df):
        return df.agg(F.count(F.lit(1)),
                      F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()

    sig = None
    while True:
        e = _large_star(_small_star(e)).checkpoint()
        new_sig = signature(e)
        if new_sig == sig:
            break
        sig = new_sig
    star = e.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("m"))
    return (nodes.join(star, "node", "left")
            .select("node", F.least(F.col("node"), F.coalesce("m", F.col("node"))).alias("label")))


def lda_topics(df: DataFrame, id_col: str, text: str, k: int = 5, features: int = 1 << 16,
               max_iter: int = 10, seed: int = 1) -> DataFrame:
    """Each document's dominant LDA topic (hashed term counts + pyspark.ml LDA).

    Every term counts: terms are hashed to ``features`` columns, so there is no vocabulary to
    cut or to gather.  ``max_iter`` passes of the online fit are its documented length; they read the
    stored counts, so texts are cut into words once.
    """
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import HashingTF
    from pyspark.ml.functions import vector_to_array

    from maillake.session import ensure_checkpoint_dir

    words = df.select(id_col, F.regexp_extract_all(F.lower(F.col(text)), F.lit(f"({WORD_RE})"), 1)
                      .alias("words"))
    ensure_checkpoint_dir(df.sparkSession)
    feats = HashingTF(inputCol="words", outputCol="features", numFeatures=features).transform(words).select(id_col, "features").checkpoint()
    model = LDA(k=k, maxIter=max_iter, seed=seed).fit(feats)
    dist = model.transform(feats).select(id_col, vector_to_array("topicDistribution").alias("p"))
    return dist.select(id_col, F.array_position(F.col("p"), F.array_max("p")).cast("int").alias("topic"),
                       F.array_max("p").alias("weight"))


# --- R3: more grid specs ---------------------------------------------------------
def weekend(ts: Column) -> Column:
    """0 = weekday, 1 = weekend (Saturday/Sunday)."""
    return F.when(F.weekday(ts) >= 5, F.lit(1)).otherwise(F.lit(0))


def grid_mean(df: DataFrame, ts: str, ring, division, value: str) -> DataFrame:
    """A grid of means instead of sums (ring, division, mean, n)."""
    t = F.col(ts)
    return (df.select(ring(t).alias("ring"), division(t).alias("division"), F.col(value).alias("_v"))
            .groupBy("ring", "division").agg(F.avg("_v").alias("mean"), F.count(F.lit(1)).alias("n")))


# --- R4: calendar entries -----------------------------------------------------------
VEVENT_RE = r"(?s)BEGIN:VEVENT(.*?)END:VEVENT"
#: Parameters between a property's name and its value; a quoted one may hold colons.
_PARAMETERS = r'(?:;(?:"[^"\r\n]*"|[^":\r\n])*)?'


def calendar_events(parts: DataFrame, id_col: str, text: str = "text") -> DataFrame:
    """One row per VEVENT block of a part: summary, start, end, location.

    Folded lines (a line feed, then a blank or tab) are joined first.
    """
    unfolded = F.regexp_replace(F.col(text), r"\r?\n[ \t]", "")
    ev = parts.select(id_col, F.explode(F.regexp_extract_all(unfolded, F.lit(VEVENT_RE), 1)).alias("ev"))

    def prop(name):
        v = F.regexp_extract(F.col("ev"), rf"(?mi)^{name}{_PARAMETERS}:(.*?)\r?$", 1)
        return F.when(v != "", v)
    return ev.select(id_col, prop("SUMMARY").alias("summary"), prop("DTSTART").alias("dtstart"),
                     prop("DTEND").alias("dtend"), prop("LOCATION").alias("location"))


def ip_clusters(routes: DataFrame, k: int = 8, seed: int = 1) -> DataFrame:
    """K-means over the IPv4 octets of the hops (pyspark.ml KMeans)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler
    oct_ = routes.filter(F.col("ip").isNotNull()).select(
        "ip", *[F.split("ip", r"\.")[i].cast("double").alias(f"o{i}") for i in range(4)]).distinct()
    feats = VectorAssembler(inputCols=[f"o{i}" for i in range(4)], outputCol="features").transform(oct_)
    model = KMeans(k=k, seed=seed).fit(feats)
    return model.transform(feats).select("ip", F.col("prediction").alias("cluster"))


# --- R12: header predicates --------------------------------------------------------
def lacks_spf(headers: Column) -> Column:
    """No Received-SPF header with a pass result."""
    return ~F.exists(headers, lambda h: (F.lower(h["name"]) == "received-spf")
                     & F.lower(h["value"]).startswith("pass"))


def flagged_spam(headers: Column) -> Column:
    """An X-Spam-Flag: YES or X-Spam-Status: Yes header."""
    return F.exists(headers, lambda h: F.lower(h["name"]).isin("x-spam-flag", "x-spam-status")
                    & F.lower(h["value"]).startswith("yes"))


# --- R13: attachments ----------------------------------------------------------------
def attachment_hashes(parts: DataFrame, id_col: str, content: str = "content") -> DataFrame:
    """SHA-256 of every attachment's bytes."""
    return parts.select(id_col, F.sha2(F.col(content), 256).alias("sha256"))


def known_attachments(hashes: DataFrame, hash_set: DataFrame) -> DataFrame:
    """Attachments whose hash is in a supplied hash set (semi join)."""
    return hashes.join(hash_set.select("sha256"), "sha256", "left_semi")


def same_attachments(hashes: DataFrame, id_col: str) -> DataFrame:
    """Attachment hashes shared by more than one message, with their messages."""
    g = hashes.groupBy("sha256").agg(F.count_distinct(id_col).alias("messages"))
    return g.filter(F.col("messages") > 1)


# --- R14: suspicious URLs / keywords ---------------------------------------------------
URL_RE = r"(https?://[^\s\"'<>]+)"


def urls(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """Every URL of the whole text with its host.

    Punctuation that closes a sentence or a bracket is no part of a URL; a closing round bracket stays if the URL
    has an opening one.
    """
    u = df.select(id_col, F.explode(F.regexp_extract_all(F.col(text), F.lit(URL_RE), 1)).alias("url"))
    bare = F.regexp_replace("url", r"[.,;:!?\])}]+$", "")
    bracketed = F.regexp_replace("url", r"[.,;:!?\]}]+$", "")
    u = u.withColumn("url", F.when(F.col("url").contains("("), bracketed).otherwise(bare))
    return u.withColumn("host", F.lower(F.regexp_extract("url", r"https?://([^/:?#]+)", 1)))


def parent_domains(host: Column) -> Column:
    """A host and the domains above it: ``a.b.c`` -> ``a.b.c, b.c, c``."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def suspicious(df: DataFrame, id_col: str, text: str, domains: DataFrame, keywords: Sequence[str]) -> DataFrame:
    """(id, kind, entry, n): listed domains that a text's URLs belong to (``n`` URLs), and keywords it holds (any case).

    ``domains`` (``entry``) is a table of any size: hosts are exploded to their parent domains and meet it by an
    equi-join, so ``evil.example`` covers its subdomains.  Keywords are configuration.
    """
    named = urls(df, id_col, text).select(id_col, F.explode(parent_domains(F.col("host"))).alias("entry"))
    listed = domains.select(F.lower("entry").alias("entry")).distinct()
    hits = named.join(listed, "entry").groupBy(id_col, "entry").agg(F.count(F.lit(1)).alias("n"))
    low = F.lower(F.col(text))
    times = F.array(*[F.struct(F.lit(k).alias("entry"), F.regexp_count(low, F.lit("\\Q" + k.lower() + "\\E")).cast("long").alias("n")) for k in keywords])
    words = df.select(id_col, F.explode(F.filter(times, lambda x: x["n"] > 0)).alias("x")).select(id_col, "x.entry", "x.n")
    return (hits.select(id_col, F.lit("url").alias("kind"), "entry", "n")
            .unionByName(words.select(id_col, F.lit("keyword").alias("kind"), "entry", "n")))


# --- R17: digest assembly --------------------------------------------------------------
def digest(msgs: DataFrame, issued: DataFrame, keywords: Sequence[str], delete_keywords: Sequence[str],
           id_col: str = "rowid", subject: str = "subject", body: str = "body") -> DataFrame:
    """Messages whose subject has a keyword and none of the delete keywords, not
    issued before, numbered in id order (item number) with their bodies."""
    from maillake.functions.text import contains_any
    from maillake.plans.sequential import global_row_number
    s = F.lower(F.col(subject))
    pick = msgs.filter(contains_any(s, [k.lower() for k in keywords])
                       & ~contains_any(s, [k.lower() for k in delete_keywords]))
    fresh = pick.join(issued.select(id_col), id_col, "left_anti")
    return global_row_number(fresh.select(id_col, subject, body), [id_col], name="item")


def inferred_source(subject: Column, body: Column, publications: dict[str, str]) -> Column:
    """A message's source: what its subject has in brackets at the end, else the publication named by the first
    keyword (in the given order, any case) that its body holds, else the host of the body's first URL."""
    bracketed = F.regexp_extract(subject, r"\(([^()]+)\)\s*$", 1)
    low = F.lower(body)
    named = [F.when(low.contains(k.lower()), F.lit(v)) for k, v in publications.items()]
    host = F.lower(F.regexp_extract(body, r"https?://([^/:?#\s\"'<>]+)", 1))
    return F.coalesce(F.when(bracketed != "", bracketed), *named, F.when(host != "", host))


def digest_with_bodies(msgs: DataFrame, issued: DataFrame, keywords: Sequence[str], delete_keywords: Sequence[str],
                       publications: dict[str, str], id_col: str = "rowid", subject: str = "subject", body: str = "body") -> DataFrame:
    """The digest's items with their source and body: ``item, id_col, subject, source, body``."""
    d = digest(msgs, issued, keywords, delete_keywords, id_col, subject, body)
    return d.select("item", id_col, subject, inferred_source(F.col(subject), F.coalesce(F.col(body), F.lit("")), publications).alias("source"), body)
