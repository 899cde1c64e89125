"""Mailboxes that grow, as a stream.

mbox files are a Python streaming data source.  Its offset is a byte position for each file, always at
the end of a message; a batch is the bytes between two offsets, cut into ranges of ``split_bytes``.
A task reads the messages whose ``From `` line begins in its range, so a message that two ranges
share is read once, and a batch that is tried again reads the same bytes.

Mail is taken only when it is whole: the last message of a file waits until another ``From `` line
follows, or until the file has not changed for ``settle_seconds``.  A message taken as settled must
not be added to: that is an error, and so is leaving the option out later.

Formats with a file for every message (Maildir, MH, .emlx) use Spark's own file stream.
"""

from __future__ import annotations

import sys
import time
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from fnmatch import fnmatch

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from maillake.sources import mailbox
from maillake.sources.paths import open_fs

cloudpickle.register_pickle_by_value(sys.modules[__name__])     # executors need no copy of this module

MARK = b"\nFrom "
BLOCK = 1 << 20                 # bytes read at a time
SPLIT_BYTES = 64 << 20
BATCH_BYTES = 1 << 20           # of mail in one returned Arrow batch: as rows in Python it takes several times as much
LISTING_THREADS = 16
SCHEMA = "path string, file_block_start long, seq long, envelope string, raw string, raw_is_bytes boolean"


def whole_end(f, size: int, known: int) -> int:
    """Where the last ``From `` line of the first ``size`` bytes begins: all mail before it is whole (``known``: an earlier answer)."""
    tail, at = b"", size
    while at > known:
        start = max(known, at - BLOCK)
        f.seek(start)
        tail = f.read(at - start) + tail[:len(MARK) - 1]
        found = tail.rfind(MARK)
        if found >= 0:
            return start + found + 1
        at = start
    return known


def messages(f, begin: int, start: int, stop: int, end: int, settled: bool) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of the messages of bytes ``begin..end`` whose ``From `` line begins in ``start..stop``.

    The line feed before the next ``From `` line belongs to no message, as in a batch read; at ``end``
    another ``From `` line follows unless the file is ``settled``.
    """
    at = begin if start <= begin else start - 1
    f.seek(at)
    # text before the first ``From `` line is no message; the first line of all counts as one after a line feed
    data, base = (b"\n", at - 1) if start <= begin else (b"", at)
    left, opened, scan = end - at, -1, 0
    while True:
        found = data.find(MARK, scan)
        if found >= 0:
            if opened >= 0:
                yield base + opened, data[opened:found]
            if base + found + 1 >= stop:
                return
            opened, scan = found + 1, found + 1
            continue
        if opened < 0 and base + len(data) - len(MARK) + 1 >= stop:
            return
        scan = max(scan, len(data) - len(MARK) + 1)
        if left <= 0:
            break
        cut = opened if opened >= 0 else scan
        block = f.read(min(BLOCK, left))
        left -= len(block) or left
        data, base, scan = data[cut:] + block, base + cut, scan - cut
        opened = 0 if opened >= 0 else -1
    if opened >= 0:
        rest = data[opened:]
        yield base + opened, rest if settled else rest[:-1]


def record(path: str, offset: int, mail: bytes) -> tuple:
    """A row of ``SCHEMA``: the message after its ``From `` line."""
    if mail.endswith(b"\r"):
        mail = mail[:-1]
    try:
        text, octets = mail.decode(), False
    except UnicodeDecodeError:
        text, octets = mail.decode("iso-8859-1"), True
    first, _, raw = text.partition("\n")
    return path, offset, 0, first.removeprefix("From ").rstrip("\r"), raw, octets


class _Range(InputPartition):
    def __init__(self, path: str, start: int, stop: int, begin: int, end: int, settled: bool):
        self.path, self.start, self.stop, self.begin, self.end, self.settled = path, start, stop, begin, end, settled


class _Reader(DataSourceStreamReader):
    def __init__(self, options):
        self.path = options["path"]
        self.glob = options.get("glob", "*.mbox")
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self.settle = float(options["settle_seconds"]) if options.get("settle_seconds") else None
        self.known: dict[str, dict] = {}        # the last answer for a file, with the size it was given for

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """{path: {end, settled}} of every mailbox with whole mail; only files that changed are opened, at their ends."""
        from pyarrow import fs

        system, root = open_fs(self.path)
        info = system.get_file_info(root)
        found = [info] if info.is_file else system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        files = [x for x in found if x.is_file and (info.is_file or fnmatch(x.base_name, self.glob)) and x.size]

        def end_of(x) -> dict:
            old = self.known.get(x.path, {"end": 0, "settled": False, "size": -1})
            if x.size < old["size"]:
                raise ValueError(f"{x.path}: mailbox shrank from {old['size']} to {x.size} bytes; start a new checkpoint to read it anew")
            if x.size != old["size"]:
                with system.open_input_file(x.path) as f:
                    old = {"end": whole_end(f, x.size, old["end"]), "settled": False, "size": x.size}
            if self.settle is not None and old["end"] < x.size and time.time() - x.mtime.timestamp() >= self.settle:
                old = {"end": x.size, "settled": True, "size": x.size}
            return old

        with ThreadPoolExecutor(LISTING_THREADS) as pool:
            self.known = dict(zip((x.path for x in files), pool.map(end_of, files), strict=True))
        return {p: {"end": x["end"], "settled": x["settled"]} for p, x in sorted(self.known.items()) if x["end"]}

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        out = []
        for path, to in end.items():
            old = start.get(path, {"end": 0, "settled": False})
            begin = old["end"]
            if to["end"] < begin and old["settled"]:
                raise ValueError(f"{path}: bytes to {begin} were taken as settled; keep settle_seconds, and append whole messages only")
            if to["end"] < begin:
                raise ValueError(f"{path}: mailbox shrank below byte {begin}, which was read before")
            out += [_Range(path, a, min(to["end"], a + self.split), begin, to["end"], to["settled"])
                    for a in range(begin, to["end"], self.split)]
        return out

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_()]
        system, _ = open_fs(self.path)
        p, rows, size = partition, [], 0
        with system.open_input_file(p.path) as f:
            for offset, mail in messages(f, p.begin, p.start, p.stop, p.end, p.settled):
                if mail.strip():
                    rows.append(record(p.path, offset, mail))
                    size += len(mail)
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


class GrowingMailbox(DataSource):
    """``spark.readStream.format("growing_mailbox")``: options ``path``, ``glob``, ``split_bytes``, ``settle_seconds``."""

    @classmethod
    def name(cls) -> str:
        return "growing_mailbox"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> _Reader:
        return _Reader(self.options)


#: What ``binaryFile`` gives; a file stream must be told.
_BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def mail_stream(spark: SparkSession, path: str, fmt: str = "mbox", glob: str | None = None, split_bytes: int = SPLIT_BYTES,
                settle_seconds: float | None = None) -> DataFrame:
    """Arriving mail of a folder (or one growing mbox file) as a stream of raw messages, the columns of a batch read.

    ``mbox``: files that grow and new files.  The folder must be on a file system that pyarrow opens (a mount that
    all executors share, HDFS, S3, GCS).  A file that shrinks is an error; one that is taken away and comes back is
    read anew (``archive_once`` drops mail seen before).  ``maildir``, ``mh``, ``emlx``: new files.
    """
    if fmt == "mbox":
        spark.dataSource.register(GrowingMailbox)
        r = spark.readStream.format(GrowingMailbox.name()).option("path", path).option("split_bytes", str(split_bytes))
        if glob:
            r = r.option("glob", glob)
        if settle_seconds is not None:
            r = r.option("settle_seconds", str(settle_seconds))
        return r.load()
    if fmt not in mailbox.FILE_ROWS:
        raise ValueError(f"no stream of format {fmt!r}; known: mbox, {', '.join(sorted(mailbox.FILE_ROWS))}")
    pattern, rows = mailbox.FILE_ROWS[fmt]
    r = spark.readStream.schema(_BINARY_FILE).format("binaryFile").option("recursiveFileLookup", "true")
    if glob or pattern:
        r = r.option("pathGlobFilter", glob or pattern)
    return rows(r.load(path))
