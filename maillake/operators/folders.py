"""Folder listings, filters and renames.

Folder names are a small dimension (one row per folder), but everything
here is a Column expression or a join, so it applies equally to the
per-message folder column of a large table.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Listing line: (flags) "delimiter" name
LIST_LINE_RE = r'\((.*?)\) "(.*)" (.*)'


def parse_listing(lines: DataFrame, col: str = "line") -> DataFrame:
    """Flags, delimiter and name of each LIST response line (unquoted name)."""
    name = F.regexp_extract(F.col(col), LIST_LINE_RE, 3)
    return lines.select(
        "*",
        F.regexp_extract(F.col(col), LIST_LINE_RE, 1).alias("flags"),
        F.regexp_extract(F.col(col), LIST_LINE_RE, 2).alias("delimiter"),
        F.regexp_replace(name, '^"(.*)"$', "$1").alias("name"))


def folder_filter(folders: DataFrame, name: str = "name", flags: str | None = "flags",
                  include: Sequence[str] = (), include_subfolders: bool = False,
                  delimiter: str = "/", exclude: Sequence[str] = ()) -> DataFrame:
    """include list (optionally with sub-folders), exclude list, no NOSELECT,
    no names starting ``#`` or ``.``."""
    n = F.col(name)
    keep = ~(n.startswith("#") | n.startswith("."))
    if flags:
        keep = keep & ~F.coalesce(F.lower(F.col(flags)).contains("\\noselect"), F.lit(False))
    if include:
        inc = n.isin(list(include))
        if include_subfolders:
            inc = inc | reduce(lambda a, b: a | b,
                               [n.startswith(i + delimiter) for i in include])
        keep = keep & inc
    if exclude:
        keep = keep & ~n.isin(list(exclude))
    return folders.filter(keep)


def archive_folders(folders: DataFrame, name: str = "name") -> DataFrame:
    """F10 (duplicate remover's choice): names containing ``Archive`` or ``All Mail``."""
    n = F.col(name)
    return folders.filter(n.contains("Archive") | n.contains("All Mail"))


def _lit_regex(s: str) -> str:
    import re
    return re.escape(s)


def rename_expr(name: Column, src_prefix: str = "", src_delim: str = "/",
                dst_prefix: str = "", dst_delim: str = "/", root: str = "") -> Column:
    """P32 (after the J13 map): target folder name on the destination server.

    Target delimiters already in the name become ``_``; the source prefix is
    removed and the destination prefix added (INBOX excepted); the source
    delimiter becomes the destination delimiter; with ``root`` every folder
    goes under ``dst_prefix + root``, INBOX becoming the root itself.
    """
    n = name
    if dst_delim != src_delim:
        n = F.regexp_replace(n, _lit_regex(dst_delim), "_")
    if src_prefix:
        n = F.regexp_replace(n, "^" + _lit_regex(src_prefix), "")
    is_inbox = F.lower(n) == "inbox"
    if src_prefix == dst_prefix and src_delim == dst_delim:
        out = F.when(is_inbox, n).otherwise(F.concat(F.lit(src_prefix), n))
    else:
        out = n
        if src_delim != dst_delim:
            out = F.replace(out, F.lit(src_delim), F.lit(dst_delim))
        if src_prefix != dst_prefix:
            if dst_prefix:
                out = F.when(is_inbox, out).otherwise(F.concat(F.lit(dst_prefix), out))
            out = F.regexp_replace(out, "^" + _lit_regex(dst_delim), "")
    if root:
        body = F.regexp_replace(out, "^" + _lit_regex(dst_prefix), "") if dst_prefix else out
        body = F.regexp_replace(body, "^" + _lit_regex(dst_delim), "")
        out = F.when(is_inbox, F.lit(dst_prefix + root)).otherwise(
            F.concat(F.lit(dst_prefix + root + dst_delim), body))
    return out


def rename_folders(folders: DataFrame, mapping: DataFrame | None, name: str = "name",
                   out: str = "target", **kw) -> DataFrame:
    """J13 + P32: map table first (``src -> dst``, left join), then the rename rule."""
    f = folders
    if mapping is not None:
        m = mapping.select(F.col("src").alias(name), F.col("dst").alias("_mapped"))
        f = f.join(m, name, "left")
        mapped = F.coalesce(F.col("_mapped"), F.col(name))
    else:
        mapped = F.col(name)
    f = f.withColumn(out, rename_expr(mapped, **kw))
    return f.drop("_mapped") if mapping is not None else f


def read_folder_map(spark, path: str, src_delim: str = "/", dst_delim: str = "/") -> DataFrame:
    """``src: dst`` lines, ``#`` comments; ``/`` stands for each side's own delimiter."""
    t = spark.read.text(path)
    t = t.filter(~F.trim("value").startswith("#") & F.col("value").contains(":"))
    return t.select(F.replace(F.trim(F.substring_index("value", ":", 1)), F.lit("/"), F.lit(src_delim)).alias("src"),
                    F.replace(F.trim(F.expr("substr(value, instr(value, ':') + 1)")), F.lit("/"), F.lit(dst_delim)).alias("dst"))
