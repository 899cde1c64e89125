"""Dense message ids in file order, given without moving the text."""

import pytest

from maillake.plans import ingest


@pytest.mark.parametrize("split", ["64", "333", "4096", "134217728"])
def test_ids_are_dense_and_in_file_order_at_every_split_size(spark, tmp_path, split, monkeypatch):
    for f, n in (("a.mbox", 60), ("b.mbox", 1), ("c.mbox", 25)):
        (tmp_path / f).write_text("".join(f"From x Mon Nov  1 08:00:00 2010\nSubject: {f} {i}\n\nbody {'y' * (i * 7 % 50)}\n" for i in range(n)))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        want = [f"{f} {i}" for f, n in (("a.mbox", 60), ("b.mbox", 1), ("c.mbox", 25)) for i in range(n)]
        got = ingest.parsed_mailbox(spark, str(tmp_path)).select("rowid", "subject").orderBy("rowid").collect()
        assert [(r.rowid, r.subject) for r in got] == list(enumerate(want, 1))
        monkeypatch.setattr(ingest, "MAX_BROADCAST_SPLITS", 0)
        got = ingest.parsed_mailbox(spark, str(tmp_path)).select("rowid", "subject").orderBy("rowid").collect()
        assert [(r.rowid, r.subject) for r in got] == list(enumerate(want, 1))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_text_is_not_shuffled_for_its_number(spark, mbox_file):
    plan = ingest.parsed_mailbox(spark, mbox_file)._jdf.queryExecution().executedPlan().toString()
    above = plan[:plan.rindex("FileScan text")]
    moved = [line for line in above.splitlines() if "Exchange" in line and "BroadcastExchange" not in line and "SinglePartition" not in line]
    assert not any("value" in line for line in moved)
