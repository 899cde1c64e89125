"""Files that tasks open themselves, without Spark's readers."""

from __future__ import annotations

import re
import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])     # executors need no copy of this module


def open_fs(path: str):
    """(pyarrow file system, path in it) of a local path or a URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"[A-Za-z][A-Za-z0-9+.-]+:/", path) else (fs.LocalFileSystem(), path)
