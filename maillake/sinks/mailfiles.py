"""Mail written as files of its own: one file for each message (K4), or one mbox for each mailbox (K3).

Tasks write the files, so the folder must be on a file system that pyarrow opens (a mount that all
executors share, HDFS, S3, GCS).
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from maillake.sources.paths import open_fs

cloudpickle.register_pickle_by_value(sys.modules[__name__])     # executors need no copy of this module

STAGED = 512                    # files that a task writes before it publishes them
PIECES = "-pieces-"             # ends the name of the folder of mailboxes' pieces, beside the mailboxes'
BLOCK = 1 << 20                 # bytes copied at a time


class _Written(WriterCommitMessage):
    def __init__(self, files: int, size: int):
        self.files, self.size = files, size


class _FilesWriter(DataSourceArrowWriter):
    """Writes rows (name, content) as files.

    A task stages its files in a folder of its own, then moves them to their names.  The names are the rows', so a
    task that is tried again, or runs twice, moves equal files onto equal names.  A name that holds other bytes is an
    error: nothing is overwritten.  ``_SUCCESS`` is written when all tasks have ended; staged files are then removed.
    """

    def __init__(self, path: str):
        self.path, self.job = path, uuid.uuid4().hex

    def _staging(self, base: str) -> str:
        return f"{base.rstrip('/')}/_staging-{self.job}"

    def write(self, iterator) -> _Written:
        from pyarrow import fs

        system, base = open_fs(self.path)
        mine = f"{self._staging(base)}/{uuid.uuid4().hex}"
        system.create_dir(mine, recursive=True)
        files = size = 0
        folders: set[str] = set()
        staged: list[tuple[str, str, bytes]] = []

        def publish() -> None:
            there = system.get_file_info([to for _, to, _ in staged])
            for (at, to, data), old in zip(staged, there, strict=True):
                if old.type != fs.FileType.NotFound:
                    with system.open_input_stream(to) as f:
                        if old.size != len(data) or f.read() != data:
                            raise FileExistsError(f"{to} exists and holds other bytes")
                    system.delete_file(at)
                else:
                    system.move(at, to)
            staged.clear()

        for batch in iterator:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                to = f"{base.rstrip('/')}/{name}"
                folder = to.rsplit("/", 1)[0]
                if folder not in folders:
                    system.create_dir(folder, recursive=True)
                    folders.add(folder)
                at = f"{mine}/{len(staged)}"
                with system.open_output_stream(at) as f:
                    f.write(content)
                staged.append((at, to, content))
                files, size = files + 1, size + len(content)
                if len(staged) == STAGED or sum(len(x[2]) for x in staged) > 1 << 26:
                    publish()
        publish()
        return _Written(files, size)

    def commit(self, messages) -> None:
        system, base = open_fs(self.path)
        system.create_dir(base, recursive=True)
        with system.open_output_stream(f"{base.rstrip('/')}/_SUCCESS") as f:
            f.write(f"{sum(m.files for m in messages if m)} files, {sum(m.size for m in messages if m)} bytes\n".encode())
        self._clear(system, base)

    def abort(self, messages) -> None:
        self._clear(*open_fs(self.path))

    def _clear(self, system, base: str) -> None:
        from pyarrow import fs

        if system.get_file_info(self._staging(base)).type != fs.FileType.NotFound:
            system.delete_dir(self._staging(base))


class MailFiles(DataSource):
    """``df.write.format("mail_files")`` of rows (name string, content binary); option ``path``."""

    @classmethod
    def name(cls) -> str:
        return "mail_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> _FilesWriter:
        return _FilesWriter(self.options["path"])


def mail_octets(raw: Column, is_bytes: Column) -> Column:
    """A raw message's bytes as they were read."""
    from maillake.functions.mime import octets

    return octets(raw, is_bytes)


def write_files(df: DataFrame, path: str, name: Column, content: Column) -> None:
    """One file for each row below ``path``; refuses to overwrite other bytes, and may be run again."""
    df.sparkSession.dataSource.register(MailFiles)
    (df.select(name.alias("name"), content.cast("binary").alias("content"))
     .write.format(MailFiles.name()).mode("append").option("path", path).save())


def write_mailboxes(df: DataFrame, path: str, name: str, order: Sequence[str], record: str, drop_last: int = 0) -> DataFrame:
    """K3: one mbox for each ``name``, its records (``mbox_text``'s ``value``) in ``order``; returns (file, messages, bytes).

    Records are sorted over all tasks, so that one of a large mailbox sorts no more than its range: each range writes
    its piece of every mailbox that it meets, then a task for each mailbox copies the pieces together, a block at a time.
    A task that is tried again writes pieces of its own, and the file anew.  ``drop_last`` leaves that many bytes off
    each file's end, as of a mailbox whose last message is still being written.  Runs at once.
    """
    from maillake.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    pieces = f"{path.rstrip('/')}{PIECES}{uuid.uuid4().hex}"        # beside the folder, as readers look through the folder

    def write(batches):
        system, base = open_fs(pieces)
        system.create_dir(base, recursive=True)
        out, now, at, box_at, n, size, done = None, None, None, 0, 0, 0, []
        for batch in batches:
            for box, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if box != now or out is None:
                    if out is not None:
                        out.close()
                        done.append((now, box_at, at, n, size))
                        box_at += 1
                    now, at, n, size = box, uuid.uuid4().hex, 0, 0
                    out = system.open_output_stream(f"{base.rstrip('/')}/{at}")
                data = value.encode() + b"\n"
                out.write(data)
                n, size = n + 1, size + len(data)
        if out is not None:
            out.close()
            done.append((now, box_at, at, n, size))
        if done:
            columns = zip(zip(*done, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names=["file", "box_at", "piece", "messages", "bytes"])

    def join(batches):
        system, base = open_fs(path)
        source, staged = open_fs(pieces)
        system.create_dir(base, recursive=True)
        for batch in batches:
            for box, size, found in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                left = size - drop_last
                with system.open_output_stream(f"{base.rstrip('/')}/{box}") as out:
                    for piece in found:
                        with source.open_input_stream(f"{staged.rstrip('/')}/{piece['piece']}") as f:
                            while left > 0 and (block := f.read(min(BLOCK, left))):
                                out.write(block)
                                left -= len(block)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([s - drop_last for s in batch.column(2).to_pylist()], pa.int64())],
                                             names=["file", "messages", "bytes"])

    keys = ["_box", *[f"_o{i}" for i in range(len(order))]]
    ranged = (df.select(F.col(name).alias("_box"), F.col(record).alias("_value"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
              .repartitionByRange(*keys).sortWithinPartitions(*keys).select("_box", "_value"))
    # a piece's place: its range, then its place in the range (one mailbox is one piece of a range)
    done = (ranged.mapInArrow(write, "file string, box_at long, piece string, messages long, bytes long")
            .withColumn("range", F.spark_partition_id()).checkpoint())
    boxes = done.groupBy("file").agg(F.sum("messages").alias("messages"), F.sum("bytes").alias("bytes"),
                                     F.array_sort(F.collect_list(F.struct("range", "box_at", "piece"))).alias("pieces"))
    rows = boxes.repartition("file").mapInArrow(join, "file string, messages long, bytes long").collect()       # one row a file
    system, base = open_fs(pieces)
    if rows:
        system.delete_dir(base)
    return df.sparkSession.createDataFrame(rows, "file string, messages long, bytes long")
