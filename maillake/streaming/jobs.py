"""Structured Streaming jobs over arriving mail.

New mail lands as files in a landing folder (an external fetcher fills it:
IMAP/SMTP clients are not part of this library).  Each job is
``readStream`` -> DataFrame transformations -> sink, with the stream
checkpoint giving exactly-once progress.  ``growing`` has the sources of mail formats (S7), ``live`` the processed
marks (T4) and the live counters (T5).

* T1 archive once: skip deleted, drop repeated ids (``dropDuplicates`` over the
  whole stream, as mail may be late by any time), append to the archive.
* T3 triage: an ordered rule list -> target folder / flags per message,
  written partitioned by folder in ``foreachBatch``.
* T6 requests: form fields per message -> ok / error / reply tables.
* T2 wake-up: ``trigger(processingTime=...)`` or ``availableNow``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from maillake.functions.predicates import is_deleted
from maillake.session import ensure_checkpoint_dir
from maillake.streaming.live import counters_batch_writer, current_counters  # noqa: F401 - T5 among the jobs

# Reference settings kept as defaults (wake-up cadence of the watchers).
POLL_SECONDS = 5
IDLE_TIMEOUT_SECONDS = 120
CRON_SECONDS = 60


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/maillake-{name}-{uuid.uuid4().hex[:12]}"


def trigger_options(mode: str = "available_now", seconds: int = CRON_SECONDS) -> dict:
    """``available_now`` (drain and stop, cron-style) or ``poll`` every ``seconds``."""
    if mode == "available_now":
        return {"availableNow": True}
    if mode == "poll":
        return {"processingTime": f"{seconds} seconds"}
    raise ValueError(mode)


def landing_stream(spark: SparkSession, folder: str, schema, fmt: str = "parquet",
                   glob: str | None = None, max_files: int | None = None) -> DataFrame:
    """Newly arrived files of ``folder`` as a stream."""
    r = spark.readStream.schema(schema).format(fmt)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.load(folder)


# --- T1 -------------------------------------------------------------------------
def archive_once(stream: DataFrame, id_col: str, raw_hash: Column, flags: str = "flags") -> DataFrame:
    """Deleted mail skipped; each id archived once; id-less mail keyed by its hash.

    Every key seen stays in the stream's state, as the reference keeps seen ids for good:
    mail with an old date is archived like any other, however late it lands.  The state
    holds keys only, partitioned like any stream state and kept with the checkpoint (use the
    RocksDB state store where keys outgrow executor memory).
    """
    return (stream.filter(~is_deleted(F.col(flags)))
            .withColumn("dedup_key", F.coalesce(F.col(id_col), F.concat(F.lit("#"), raw_hash)))
            .dropDuplicates(["dedup_key"]))


# --- T3 / X2 ----------------------------------------------------------------------
@dataclass
class Rule:
    """Header predicate -> actions (target folder, flags to add, wants the full message)."""
    when: Column
    folder: str | None = None
    add_flags: Sequence[str] = field(default_factory=tuple)
    full: bool = False


def apply_rules(df: DataFrame, rules: Sequence[Rule], default_folder: str = "INBOX",
                flags: str = "imap_flags", deleted_folder: str = "Trash") -> DataFrame:
    """First matching rule (list order) decides the folder; flags of all matching
    rules are added.  Mail that arrives deleted is skipped (no row); mail that a rule marks
    deleted goes to ``deleted_folder``.  ``wants_full`` marks messages whose full text the
    next pass needs (late materialisation)."""
    folder = F.lit(default_folder)
    for r in reversed(rules):
        if r.folder is not None:
            folder = F.when(r.when, F.lit(r.folder)).otherwise(folder)
    added = F.array().cast("array<string>")
    for r in rules:
        if r.add_flags:
            added = F.when(r.when, F.array_union(added, F.array(*[F.lit(f) for f in r.add_flags]))
                           ).otherwise(added)
    full = F.lit(False)
    for r in rules:
        if r.full:
            full = full | F.coalesce(r.when, F.lit(False))
    cur = F.coalesce(F.col(flags), F.array().cast("array<string>"))
    def deleted(c):
        return F.exists(c, lambda f: F.lower(f) == "\\deleted")

    return df.filter(~deleted(cur)) \
             .withColumn("target_folder", F.when(deleted(added), F.lit(deleted_folder)).otherwise(folder)) \
             .withColumn("wants_full", full) \
             .withColumn(flags, F.array_distinct(F.array_union(cur, added)))


def full_pass(triaged: DataFrame, bodies: DataFrame, key: str,
              transform: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """X2 second pass (late materialisation): only messages whose header rules
    asked for the full text are joined to the body table and transformed."""
    wanted = triaged.filter(F.col("wants_full")).select(key)
    return transform(bodies.join(wanted, key, "left_semi"))


def write_epoch(df: DataFrame, out_dir: str, epoch: int, *partitions: str) -> None:
    """Write a batch's rows to the epoch's own folder: a batch that is tried again replaces itself."""
    df.write.mode("overwrite").partitionBy(*partitions).parquet(f"{out_dir.rstrip('/')}/epoch={epoch}")


def write_tally(fields: DataFrame, out_dir: str, epoch: int, cols: Sequence[str], date: str) -> None:
    """K9 for a stream: a batch's tally rows (date and columns, tab-separated) in the epoch's own folder."""
    from maillake.sinks.writers import tally_rows

    (tally_rows(fields, cols, date).write.mode("overwrite").option("sep", "\t").option("header", True)
     .csv(f"{out_dir.rstrip('/')}/epoch={epoch}"))


def triage_batch_writer(out_dir: str, rules: Sequence[Rule], **kw) -> Callable[[DataFrame, int], None]:
    """T3 sink: each micro-batch is triaged and written to its epoch's folder, partitioned by target folder."""
    def write(batch: DataFrame, epoch: int) -> None:
        write_epoch(apply_rules(batch, rules, **kw), out_dir, epoch, "target_folder")
    return write


def _started(df: DataFrame, checkpoint: str, writer: Callable | None, out_dir: str | None, output_mode: str,
             state_partitions: int | None, trigger: dict) -> StreamingQuery:
    """Start a stream.

    A stateful stream fixes its number of state partitions when it first
    starts (it is kept in the checkpoint); ``state_partitions`` sets it
    (default: the cluster's default parallelism) instead of inheriting the
    batch shuffle setting.
    """
    spark = df.sparkSession
    n = state_partitions or spark.sparkContext.defaultParallelism
    w = df.writeStream.option("checkpointLocation", checkpoint).outputMode(output_mode)
    if writer is not None:
        w = w.foreachBatch(writer)
    else:
        w = w.format("parquet").option("path", out_dir)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    try:
        return w.trigger(**trigger).start()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def run_available_now(df: DataFrame, checkpoint: str, writer: Callable | None = None,
                      out_dir: str | None = None, output_mode: str = "append",
                      state_partitions: int | None = None) -> StreamingQuery:
    """T2, cron-style: a stream that drains what has landed and stops."""
    q = _started(df, checkpoint, writer, out_dir, output_mode, state_partitions, trigger_options("available_now"))
    q.awaitTermination()
    return q


def run_polling(df: DataFrame, checkpoint: str, writer: Callable | None = None, out_dir: str | None = None,
                output_mode: str = "append", state_partitions: int | None = None, seconds: int = POLL_SECONDS) -> StreamingQuery:
    """T2, watching: a stream that looks for new mail every ``seconds`` until it is stopped."""
    return _started(df, checkpoint, writer, out_dir, output_mode, state_partitions, trigger_options("poll", seconds))
