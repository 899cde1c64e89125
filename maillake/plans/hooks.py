"""User extension surface.

The reference calls a user object once per message or per mailbox.  Here:

* a DataFrame -> DataFrame function (``df.transform(fn)``) is the preferred
  hook: it stays in Catalyst;
* ``per_message`` runs a pandas function over Arrow batches of messages
  (``mapInPandas``) when the logic needs Python;
* ``per_mailbox`` computes a per-folder summary in two phases, like a
  combiner: ``partial`` summarises each Arrow batch per folder, the partial
  rows (one per batch and folder) are shuffled by folder, and ``combine``
  merges them.  No folder -- however large -- is ever gathered into one
  task; only its partial summaries are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def apply(df: DataFrame, *fns: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Chain DataFrame-level processors."""
    for fn in fns:
        df = df.transform(fn)
    return df


def per_message(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema) -> DataFrame:
    """``fn`` gets each Arrow batch of messages as a pandas frame."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield fn(b)
    return df.mapInPandas(run, schema)


def per_mailbox(df: DataFrame, folder: str,
                partial: Callable[[pd.DataFrame], pd.DataFrame], partial_schema,
                combine: Callable[[pd.DataFrame], pd.DataFrame], schema,
                merge: Callable[[pd.DataFrame], pd.DataFrame] | None = None, parts: int = 256) -> DataFrame:
    """Per-folder summary (e.g. a mailbox statistics class).

    ``partial(batch)`` returns one row per folder present in the batch (with
    the ``folder`` column); ``combine(rows)`` gets all partial rows of one
    folder and returns its final row(s).  With ``merge`` (partial rows of one folder -> one partial row) the
    rows of a folder are merged in ``parts`` parts first, so that no task has all of them and ``combine`` has that many at most.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield partial(b)
    partials = df.mapInPandas(run, partial_schema)
    if merge is not None:
        part = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts)).alias("_part")
        partials = (partials.select("*", part).groupBy(folder, "_part")
                    .applyInPandas(lambda rows: merge(rows.drop(columns="_part")), partial_schema))
    return partials.groupBy(folder).applyInPandas(combine, schema)
