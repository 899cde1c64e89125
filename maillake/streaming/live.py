"""Stream state with commands and retries: processed marks (T4) and live counters."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator, Sequence

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from maillake.functions.predicates import is_deleted, is_seen, is_unread

cloudpickle.register_pickle_by_value(sys.modules[__name__])     # executors need no copy of this module

# --- T4: processed marks ------------------------------------------------------------------
MAIL, SET, CLEAR = "mail", "set", "clear"
EVENT_SCHEMA = "id string, kind string, at timestamp_ntz, deleted boolean, payload string"
_STATE = "processed boolean, known boolean, deleted boolean, payload string"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class ProcessedMarks(StatefulProcessor):
    """The mark of each message: mail without it is processed (one output row) and gets it; commands set and clear it."""

    def __init__(self, ignore: bool):
        self.ignore = ignore

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.mark = handle.getValueState("mark", _STATE)

    def handleInputRows(self, key, rows: Iterable[Row], timerValues) -> Iterator[Row]:
        old = self.mark.get() if self.mark.exists() else None
        processed, known, deleted, payload = tuple(old) if old else (False, False, False, None)
        for r in sorted(rows, key=lambda r: (r["at"] is not None, r["at"], (MAIL, SET, CLEAR).index(r["kind"]), r["payload"] or "")):
            run = False
            if r["kind"] == MAIL:
                known, deleted, payload = True, bool(r["deleted"]), r["payload"]
                run = not deleted and (self.ignore or not processed)
            elif r["kind"] == SET:
                processed = True
            else:
                processed = False
                run = known and not deleted         # the next wake-up finds it without its mark
            if run:
                processed = True
                yield Row(id=key[0], at=r["at"], cause=r["kind"], payload=payload)
        self.mark.update((processed, known, deleted, payload))

    def close(self) -> None:
        pass


def events(mail: DataFrame, commands: DataFrame | None = None) -> DataFrame:
    """The input of ``process_once``: ``mail`` (id, at, deleted, payload) and ``commands`` (id, kind, at) as one stream."""
    rows = mail.select(F.col("id").cast("string").alias("id"), F.lit(MAIL).alias("kind"), "at", "deleted", "payload")
    if commands is None:
        return rows
    return rows.unionByName(commands.select(F.col("id").cast("string").alias("id"), "kind", "at", F.lit(False).alias("deleted"),
                                            F.lit(None).cast("string").alias("payload")))


def process_once(stream: DataFrame, ignore_processed: bool = False) -> DataFrame:
    """T4: a row (id, at, cause, payload) whenever a message is to be processed.

    A message is processed when it arrives without the processed mark, and then has it.  ``set`` marks a message,
    also before it arrives; ``clear`` takes the mark away, so that a message that is there is processed again; a
    deleted one is not.  With ``ignore_processed`` every arrival is processed.  Rows of one batch are taken in the
    order of ``at`` (nulls first; mail before commands).  Messages without an id are no input: give them a hash.

    One value for each id is kept in the RocksDB state of the stream's checkpoint.
    """
    return (stream.filter(F.col("id").isNotNull() & F.col("kind").isin(MAIL, SET, CLEAR)).groupBy("id")
            .transformWithState(ProcessedMarks(ignore_processed), "id string, at timestamp_ntz, cause string, payload string", "Append", "None"))


def run_process_once(stream: DataFrame, checkpoint: str, out_dir: str, ignore_processed: bool = False) -> StreamingQuery:
    """Drain the events and stop; the rows of ``process_once`` are appended to ``out_dir`` once each, also when a batch is tried again."""
    from maillake.streaming.jobs import run_available_now

    conf, key = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    old = conf.get(key)
    conf.set(key, ROCKSDB)
    try:
        return run_available_now(process_once(stream, ignore_processed), checkpoint, out_dir=out_dir)
    finally:
        conf.set(key, old)


def marks(spark: SparkSession, checkpoint: str) -> DataFrame:
    """``id, processed, known, deleted``: the mark of every message, read from the stream's state."""
    s = spark.read.format("statestore").option("stateVarName", "mark").load(checkpoint)
    return s.select(F.col("key.id").alias("id"), "value.processed", "value.known", "value.deleted")


def command_all(spark: SparkSession, checkpoint: str, kind: str, at: Column) -> DataFrame:
    """Commands that set or clear the mark of every message that the stream knows (``id, kind, at``), to land as input."""
    if kind not in (SET, CLEAR):
        raise ValueError(kind)
    return marks(spark, checkpoint).select("id", F.lit(kind).alias("kind"), at.cast("timestamp_ntz").alias("at"))


# --- T5: live counters -----------------------------------------------------------------------
STATE_BUCKETS = 64      # of a new state table; an existing one keeps its own number
KEPT_EPOCHS = 2         # manifests that stay: the last, and the one before for readers under way


class BucketedState:
    """Tables in hash buckets, of which an epoch writes the touched ones anew.

    Nothing is overwritten that a later step still needs: an epoch's rows go to a folder of its own, and its
    manifest (for each table and bucket the epoch that holds its rows) is written last and makes the epoch count.
    Buckets are read by path, so a batch opens what it touches; the manifest is found by the names in one folder
    that holds ``KEPT_EPOCHS`` of them.  Folders that no kept manifest names are removed.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int):
        self.spark, self.root = spark, root.rstrip("/")
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = hadoop.Path
        self.fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        epochs = self._epochs("manifest", "_SUCCESS")
        self.epoch = epochs[-1] if epochs else None
        self.held: dict[tuple[str, int], int] = {}
        self.buckets = buckets
        if self.epoch is not None:
            rows = spark.read.parquet(f"{self.root}/manifest/epoch={self.epoch}").collect()      # one row a table and bucket
            self.held = {(r["table"], r["bucket"]): r["at_epoch"] for r in rows}
            self.buckets = rows[0]["n_buckets"]

    def _epochs(self, folder: str, done: str = "") -> list[int]:
        """Epochs of a folder, in order; with ``done``, those that hold such a file."""
        at = self._path(f"{self.root}/{folder}")
        if not self.fs.exists(at):
            return []
        found = [s.getPath().getName() for s in self.fs.listStatus(at)]
        return sorted(int(n.split("=")[1]) for n in found if n.startswith("epoch=")
                      and (not done or self.fs.exists(self._path(f"{self.root}/{folder}/{n}/{done}"))))

    def bucket(self, *key: Column) -> Column:
        return F.pmod(F.xxhash64(*key), F.lit(self.buckets)).cast("int")

    def read(self, table: str, touched: Sequence[int]) -> DataFrame | None:
        """The rows of some buckets; None if there are none."""
        paths = [f"{self.root}/{table}/epoch={self.held[table, b]}/_bucket={b}" for b in touched if (table, b) in self.held]
        return self.spark.read.option("basePath", f"{self.root}/{table}").parquet(*paths).drop("epoch") if paths else None

    def write(self, table: str, rows: DataFrame, touched: Sequence[int], epoch: int) -> None:
        """Write the touched buckets (``rows`` has ``_bucket``) for an epoch."""
        at = f"{self.root}/{table}/epoch={epoch}"
        rows.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(at)      # a file a bucket
        there = {s.getPath().getName() for s in self.fs.listStatus(self._path(at))}
        for b in touched:       # a bucket without rows has no folder
            self.held.pop((table, b), None)
            if f"_bucket={b}" in there:
                self.held[table, b] = epoch

    def commit(self, epoch: int) -> None:
        rows = [(t, b, e, self.buckets) for (t, b), e in self.held.items()] or [("", -1, -1, self.buckets)]
        (self.spark.createDataFrame(rows, "table string, bucket int, at_epoch long, n_buckets int")
         .coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/epoch={epoch}"))
        kept = self._epochs("manifest", "_SUCCESS")[-KEPT_EPOCHS:]
        manifests = self.spark.read.parquet(*[f"{self.root}/manifest/epoch={e}" for e in kept])
        named: dict[str, set[int]] = {}
        for r in manifests.select("table", "at_epoch").distinct().collect():
            named.setdefault(r["table"], set()).add(r["at_epoch"])
        for table, keep in [("manifest", set(kept)), *((t, e) for t, e in named.items() if t)]:
            for e in self._epochs(table):
                if e < epoch and e not in keep:
                    self.fs.delete(self._path(f"{self.root}/{table}/epoch={e}"), True)


COUNTER_NAMES = ["total_count", "unseen_count", "deleted_count", "unread_count"]
ADJUSTED = "unread_count_adjusted_for_duplicates"


def _contribution(rows: DataFrame) -> DataFrame:
    """What signed message rows add to the counters (removed rows count nothing)."""
    f, live = F.col("flags"), ~F.col("removed")
    vals = [live, live & ~is_seen(f), live & is_deleted(f), live & is_unread(f)]
    return rows.groupBy("mailbox").agg(*[F.sum(F.when(v, F.col("_sign")).otherwise(0)).cast("long").alias(n)
                                         for v, n in zip(vals, COUNTER_NAMES, strict=True)])


def _adjusted(state: BucketedState, change: DataFrame, message_id: str, epoch: int) -> DataFrame:
    """A12's change per folder: steps of the (folder, Message-ID) reference counts from 0 or to 0; mail without an id counts singly."""
    unread = change.filter(~F.col("removed") & is_unread(F.col("flags")))
    alone = (unread.filter(F.col(message_id).isNull()).groupBy("mailbox").agg(F.sum("_sign").cast("long").alias(ADJUSTED)))
    steps = (unread.filter(F.col(message_id).isNotNull()).groupBy("mailbox", F.col(message_id).alias("_mid"))
             .agg(F.sum("_sign").cast("long").alias("_d")).filter("_d <> 0")
             .withColumn("_bucket", state.bucket(F.col("mailbox"), F.col("_mid"))).persist())
    touched = [r[0] for r in steps.select("_bucket").distinct().collect()]          # at most the number of buckets
    if not touched:
        return alone
    old = state.read("references", touched)
    if old is None:
        old = state.spark.createDataFrame([], "mailbox string, _mid string, n long, _bucket int")
    # a null folder is a folder
    same = (F.col("o.mailbox").eqNullSafe(F.col("s.mailbox"))) & (F.col("o._mid") == F.col("s._mid"))
    both = (old.alias("o").join(steps.alias("s"), same, "full")
            .select(F.coalesce("s.mailbox", "o.mailbox").alias("mailbox"), F.coalesce("s._mid", "o._mid").alias("_mid"),
                    F.coalesce("s._bucket", "o._bucket").alias("_bucket"), F.coalesce("o.n", F.lit(0)).alias("_old"),
                    (F.coalesce("o.n", F.lit(0)) + F.coalesce("s._d", F.lit(0))).alias("n"), F.col("s._d").isNotNull().alias("_stepped")).persist())
    state.write("references", both.filter("n > 0").select("mailbox", "_mid", "n", "_bucket"), touched, epoch)
    turned = (both.filter("_stepped").groupBy("mailbox")
              .agg(F.sum((F.col("n") > 0).cast("long") - (F.col("_old") > 0).cast("long")).alias(ADJUSTED)))
    return turned.unionByName(alone).groupBy("mailbox").agg(F.sum(ADJUSTED).alias(ADJUSTED))


def counters_batch_writer(state_dir: str, counters_dir: str, key: str = "rowid", ts: str = "event_ts", buckets: int = STATE_BUCKETS,
                          message_id: str | None = None) -> Callable[[DataFrame, int], None]:
    """T5: counters kept incrementally, as the store's triggers keep them; with ``message_id`` also A12's adjusted unread count.

    Per micro-batch: the latest event per message (max event time); the old rows of those messages, from the touched
    buckets of the state; each folder's change = new contributions - old ones, added to the counters (one row per
    folder).  The adjusted count needs a count of distinct Message-IDs, which does not add up: the state keeps how many
    unread messages each (folder, Message-ID) has, and a folder's count moves when that number leaves or reaches 0.

    The cost follows the batch, not the state: buckets are opened by path.  An epoch that has its manifest is skipped, a
    batch that is tried again starts from the last manifest and replaces what it wrote.  Late events older than
    the stored row change nothing.  ``current_counters`` reads the last counters, ``counters_dir/log`` holds the
    touched folders' values per epoch.
    """
    names = COUNTER_NAMES + ([ADJUSTED] if message_id else [])

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        state = BucketedState(spark, state_dir, buckets)
        if state.epoch is not None and state.epoch >= epoch:
            return
        latest = (batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), ts).alias("_r"))
                  .select("_r.*").withColumn("_bucket", state.bucket(F.col(key))).persist())
        touched = [r[0] for r in latest.select("_bucket").distinct().collect()]      # at most the number of buckets
        if not touched:
            return
        stored = state.read("rows", touched)
        if stored is not None:
            old = stored.join(latest.select(key), key, "left_semi")
            # an old row stays when it is newer than the batch's (late events)
            newer = (latest.alias("n").join(old.alias("o"), F.col(f"n.{key}") == F.col(f"o.{key}"), "left")
                     .filter(F.col(f"o.{ts}").isNull() | (F.col(f"n.{ts}") >= F.col(f"o.{ts}")))
                     .select("n.*"))
            gone = old.join(newer.select(key), key, "left_semi").withColumn("_sign", F.lit(-1))
            change = newer.withColumn("_sign", F.lit(1)).unionByName(gone)
            new_state = stored.join(newer.select(key), key, "left_anti")
            new_state = new_state.unionByName(newer.select(*new_state.columns))
        else:
            change, new_state = latest.withColumn("_sign", F.lit(1)), latest
        change = change.persist()
        delta = _contribution(change)
        if message_id:
            delta = delta.alias("d").join(_adjusted(state, change, message_id, epoch).alias("a"),
                                          F.col("d.mailbox").eqNullSafe(F.col("a.mailbox")), "left").select("d.*", f"a.{ADJUSTED}")
        current = (spark.createDataFrame([], "mailbox string, " + ", ".join(f"{n} long" for n in names)) if state.epoch is None
                   else spark.read.parquet(f"{counters_dir}/all/epoch={state.epoch}"))
        j = current.alias("c").join(delta.alias("d"), F.col("c.mailbox").eqNullSafe(F.col("d.mailbox")), "full")
        updated = j.select(F.coalesce("c.mailbox", "d.mailbox").alias("mailbox"),
                           *[(F.coalesce(F.col(f"c.{n}"), F.lit(0)) + F.coalesce(F.col(f"d.{n}"), F.lit(0))).cast("long").alias(n) for n in names])
        state.write("rows", new_state, touched, epoch)
        updated.write.mode("overwrite").parquet(f"{counters_dir}/all/epoch={epoch}")
        fresh = spark.read.parquet(f"{counters_dir}/all/epoch={epoch}")
        (fresh.alias("f").join(delta.alias("d"), F.col("f.mailbox").eqNullSafe(F.col("d.mailbox")), "left_semi")
         .write.mode("overwrite").parquet(f"{counters_dir}/log/epoch={epoch}"))
        state.commit(epoch)
        for df in (latest, change):
            df.unpersist()
    return write


def current_counters(spark: SparkSession, state_dir: str, counters_dir: str) -> DataFrame:
    """The counters (one row per folder) of the last finished epoch."""
    return spark.read.parquet(f"{counters_dir}/all/epoch={BucketedState(spark, state_dir, STATE_BUCKETS).epoch}")
