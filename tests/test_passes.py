"""Operators read their input once, and carry no more than they need through their shuffles."""

from collections import Counter

from maillake.operators import people, stats, wishes
from maillake.sinks import mailfiles


def counted(spark, rows, schema):
    """A frame of ``rows`` and an accumulator of the rows that were read from it."""
    read = spark.sparkContext.accumulator(0)

    def seen(row):
        read.add(1)
        return row

    return spark.createDataFrame(spark.sparkContext.parallelize(rows, 2).map(seen), schema), read


def test_components_read_edges_once(spark):
    rows = [(1, 2), (2, 3), (7, 7), (9, None), (5, 4), (3, 1), (1, 2), (None, 11)]
    df, read = counted(spark, rows, "src long, dst long")
    got = {(r.node, r.label) for r in wishes.connected_components(df).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (7, 7), (9, 9), (11, 11), (None, None)}
    assert read.value == len(rows)


def test_persons_read_evidence_once(spark):
    rows = [("Doe, Ann", "b@a"), ("ann doe", "a@a"), ("Info", "i@a"), (None, "n@a"), ("Ann Doe", None)]
    df, read = counted(spark, rows, "name string, address string")
    assert {(r.address, r.person) for r in people.persons(df).collect()} == {("a@a", "a@a"), ("b@a", "a@a"), ("i@a", "i@a"), ("n@a", "n@a")}
    assert read.value == len(rows)


def test_only_the_first_flows_meet_their_addresses(spark):
    messages = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 9), (5, None), (6, 3), (6, 3)], "rowid long, sender long")
    recipients = spark.createDataFrame([(1, 0, 4), (2, 1, 4), (3, 0, 5), (4, 0, 8), (5, 0, 4), (6, 0, 5), (1, 2, 5), (7, 0, 4)],
                                       "message_rowid long, type int, address_id long")
    addresses = spark.createDataFrame([(1, "a"), (2, "a"), (3, "c"), (4, "d"), (5, "d"), (5, "d"), (8, None)], "rowid long, address string")
    want = sorted(((r.n, r.src or "", r.dst or "", r) for r in stats.flows(messages, recipients, addresses).collect()), reverse=True)
    top = stats.top_flows(messages, recipients, addresses, 3)
    assert [tuple(r) for r in top.collect()] == [tuple(r) for *_, r in want[:3]] and len(want) == 4
    plan = top._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("src#") < plan.index("GlobalLimit", plan.index("Join"))        # names are joined above the limit


def test_mailbox_of_many_ranges_is_one_file(spark, tmp_path):
    rows = [(("big", "small")[i % 50 == 0] + ".mbox", (i * 7919) % 3001, f"From x\n{i} " + "ü" * (i % 40)) for i in range(3001)]
    df = spark.createDataFrame(rows, "box string, at int, value string").repartition(5)
    sizes = mailfiles.write_mailboxes(df, str(tmp_path / "boxes"), "box", ["at"], "value", drop_last=3)
    for box in ("big.mbox", "small.mbox"):
        want = "".join(v + "\n" for _, _, v in sorted((b, at, v) for b, at, v in rows if b == box)).encode()[:-3]
        assert (tmp_path / "boxes" / box).read_bytes() == want
        assert [(r.messages, r.bytes) for r in sizes.collect() if r.file == box] == [(sum(b == box for b, *_ in rows), len(want))]
    assert [p.name for p in tmp_path.iterdir()] == ["boxes"]


def test_topics_cut_texts_into_words_once(spark):
    rows = [(i, "apple pear plum" if i % 2 else "wheel brake motor") for i in range(40)]
    df, read = counted(spark, rows, "doc_id long, text string")
    wishes.lda_topics(df, "doc_id", "text", k=2, features=64).collect()
    assert read.value == len(rows)


def test_flows_are_grouped_by_numbers_only(spark):
    """Shared, missing and doubled addresses against a plain count; no text is a key of an aggregate."""
    a = [(1, "x"), (2, "y"), (3, "x"), (4, None), (5, "z"), (5, "w")]
    m = [(i, i % 7 or None) for i in range(40)]
    r = [(i, t, (i * 3 + t) % 7) for i in range(42) for t in (0, 1, 2)]
    f = stats.flows(spark.createDataFrame(m, "rowid long, sender long"), spark.createDataFrame(r, "message_rowid long, type int, address_id long"),
                    spark.createDataFrame(a, "rowid long, address string"))
    named = lambda i: [t for k, t in a if k == i] or [None]
    want = Counter((s, d) for i, sender in m for j, t, to in r if i == j and t < 2 for s in named(sender) for d in named(to))
    assert {(x.src, x.dst): x.n for x in f.collect()} == want and f.count() == len(want)
    plan = f._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Aggregate" in x and ("src#" in x or "dst#" in x)]
