"""Operators on skewed input (one key holds a third of the rows) against pandas."""

import random

import pandas as pd
from pyspark.sql import functions as F

from maillake.operators import counters, dedup, wishes


def _mail(n=3000, seed=9):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        hot = i % 3 == 0
        rows.append((i, 0 if hot else rnd.randint(1, 20),
                     "HOT" if hot else (None if rnd.random() < 0.05 else f"id{rnd.randint(1, 400)}"),
                     rnd.choice([0, 1, 2])))
    return rows


def test_dedup_keep_newest_hot_id(spark):
    rows = _mail()
    df = spark.createDataFrame(rows, "rowid long, mailbox long, message_id string, flags int")
    got = sorted(r.rowid for r in dedup.dedup_keep_newest(df).collect())
    p = pd.DataFrame(rows, columns=["rowid", "mailbox", "message_id", "flags"])
    live = p[(p["flags"] & 2 == 0) & p.message_id.notna()]
    keep = live.groupby(["mailbox", "message_id"]).rowid.transform("max")
    assert got == sorted(live[live.rowid < keep].rowid.tolist())


def test_dup_running_hot_folder(spark):
    rows = _mail()
    df = spark.createDataFrame(rows, "rowid long, mailbox long, message_id string, flags int")
    got = {r.rowid: (r.is_dup, r.seen_count) for r in dedup.dup_running(df).collect()}
    p = pd.DataFrame(rows, columns=["rowid", "mailbox", "message_id", "flags"]).sort_values("rowid")
    seen, count = set(), {}
    for r in p.itertuples():
        k = (r.mailbox, r.message_id)
        dup = k in seen
        seen.add(k)
        count[r.mailbox] = count.get(r.mailbox, 0) + int(dup)
        assert got[r.rowid] == (dup, count[r.mailbox]), r.rowid


def test_top_k_hot_group(spark):
    rnd = random.Random(4)
    rows = [("m0" if i % 3 == 0 else f"m{rnd.randint(1, 9)}", f"s{rnd.randint(0, 300)}") for i in range(6000)]
    counts = spark.createDataFrame(rows, "month string, sender string").groupBy("month", "sender").agg(
        F.count(F.lit(1)).alias("n"))
    got = {(r.month, r["rank"]): (r.sender, r.n) for r in wishes.top_k_per_group(
        counts, ["month"], "sender", "n", 3, buckets=8).collect()}
    p = pd.DataFrame(rows, columns=["month", "sender"]).value_counts().reset_index(name="n")
    for month, g in p.groupby("month"):
        g = g.sort_values(["n", "sender"], ascending=[False, False]).head(3)
        for rank, r in enumerate(g.itertuples(), 1):
            assert got[(month, rank)] == (r.sender, r.n)


def test_unread_adjusted_hot_id(spark):
    rows = _mail()
    m = spark.createDataFrame(rows, "rowid long, mailbox long, message_id string, flags int")
    mb = spark.createDataFrame([(i, f"f{i}", None) for i in range(21)], "rowid long, url string, source long")
    lab = spark.createDataFrame([], "message_rowid long, mailbox_id long")
    got = {r.mailbox_id: (r.unread_count, r.unread_count_adjusted_for_duplicates)
           for r in counters.unread_adjusted(m, mb, lab).collect()}
    p = pd.DataFrame(rows, columns=["rowid", "mailbox", "message_id", "flags"])
    u = p[(p["flags"] & 1 == 0) & (p["flags"] & 2 == 0)]
    for box, g in u.groupby("mailbox"):
        want = (len(g), g.message_id.nunique() + int(g.message_id.isna().sum()))
        assert got[box] == want
