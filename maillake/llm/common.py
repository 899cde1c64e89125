"""Helpers shared by the operators of this package."""

from __future__ import annotations

import sys
import types

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the word separators of the word-based operators.
ASCII_SPACE = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; only the columns used later are read."""
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


def text_or_empty(col: str | Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.cast("string"), F.lit(""))


def text_key(text: Column) -> Column:
    """128-bit identity of a string (two independently seeded 64-bit hashes)."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(text, F.lit("second")).alias("b"))


def hashed_unit(*cols: Column) -> Column:
    """A hashed draw in (0, 1) from the first 52 bits of an MD5 (the same in every engine)."""
    digest = F.md5(F.concat_ws("|", *cols))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(16 ** 13))


def process_cache() -> dict:
    """A dictionary that lives as long as the Python worker process.

    Task functions are pickled by value, so their module globals are new for every task;
    what is costly to build (an encoder, a compiled rule set) is kept here instead.
    """
    return vars(sys.modules.setdefault("_maillake_process_cache", types.ModuleType("_maillake_process_cache")))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The given names, lengthened until no column of ``df`` has them."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir`` (set up for local runs if unset)."""
    from maillake.session import ensure_checkpoint_dir

    return ensure_checkpoint_dir(spark)


def stored(df: DataFrame) -> DataFrame:
    """Write to a new Parquet table in the shared folder and read it back: cuts lineage, is read column by column."""
    import uuid

    path = f"{shared_folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release_memory() -> None:
    """Give memory that numpy and Arrow have freed back to the system; workers outlive their tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # glibc only
    if trim is not None:
        trim(0)


def tidy(run):
    """A task function over Arrow batches that gives its freed memory back when it ends."""
    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            release_memory()

    return tidied
