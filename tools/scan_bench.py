"""Mailbox scan throughput (S1 + P1-P5) by split size.

Renders the driver's documents as an mbox (one message per document,
``>From `` escaped by the K3 writer) into a fresh scratch folder, then reads
and fully parses it with different ``spark.sql.files.maxPartitionBytes``
values and prints one JSON line of MB/s per split size.

Usage: python tools/scan_bench.py [SF_DIR] [CPUS]
"""

from __future__ import annotations

import json
import os
import subprocess
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from maillake.session import local_session  # noqa: E402
from maillake.sinks.writers import write_mbox  # noqa: E402
from maillake.sources import mailbox, messages  # noqa: E402


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    cpus = sys.argv[2] if len(sys.argv) > 2 else "4"
    spark = local_session(cpus)
    out = tempfile.mkdtemp(prefix="maillake-scan-")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    raw = docs.select(
        F.concat(F.lit("From: "), F.col("source"), F.lit("@docs.example\nSubject: "),
                 F.substring_index("text", "\n", 1), F.lit("\nMessage-ID: <"), F.col("doc_id").cast("string"),
                 F.lit("@docs.example>\nDate: Mon, 1 Nov 2010 08:00:00 +0000\n\n"), F.col("text")).alias("raw"),
        F.col("source").alias("envelope_from"), F.lit(None).cast("timestamp").alias("envelope_date"))
    path = f"{out}/mbox"
    write_mbox(raw.coalesce(1), path)
    size_mb = int(subprocess.check_output(["du", "-sm", path]).split()[0])
    res = {}
    for split in ("4m", "16m", "64m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        df = messages.parse_messages(mailbox.read_mbox(spark, path))
        best = None
        for _ in range(2):
            t = time.perf_counter()
            n = df.select("message_id", "date_sent", "subject", "lines").write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t
            best = dt if best is None else min(best, dt)
        res[split] = round(size_mb / best, 1)
        del n
    count = mailbox.read_mbox(spark, path).count()
    print(json.dumps({"metric": "mbox_scan_mb_per_sec", "size_mb": size_mb, "messages": count,
                      "by_split": res, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
