"""Time grids (time wheels): ring x division counts or sums.

SURVEY P35, P36, A5, A15, W10, X4.  A grid spec is a pair of Column
functions over a timestamp; the long form ``(ring, division, value)`` is
the primary output (one partial aggregation, no skew: a hot cell is just a
bigger partial count), and the wide crosstab is a pivot over a fixed list
of divisions, so Spark needs no extra pass to discover pivot values.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ColFn = Callable[[Column], Column]


@dataclass(frozen=True)
class GridSpec:
    """(name, ring function, ring count, division function, division count)."""
    name: str
    ring: ColFn
    rings: int
    division: ColFn
    divisions: int


def weekday(ts: Column) -> Column:
    """Monday = 0 ... Sunday = 6."""
    return F.weekday(ts)


def hour(ts: Column) -> Column:
    return F.hour(ts)


def day_of_month(ts: Column) -> Column:
    return F.dayofmonth(ts)


def day_name(ts: Column) -> Column:
    """English day name (formatting with EEEE is allowed; parsing is not)."""
    return F.date_format(ts, "EEEE")


# The two specs of the reference's time wheel module.
WEEKDAY_BY_HOUR = GridSpec("weekday_hour", weekday, 7, hour, 24)
MONTHDAY_BY_HOUR = GridSpec("monthday_hour", day_of_month, 31, hour, 24)
# Year x month (one ring per year present; rings = 0 means open-ended).
YEAR_BY_MONTH = GridSpec("year_month", F.year, 0, lambda t: F.month(t) - 1, 12)


def grid_long(df: DataFrame, ts: str | Column, spec: GridSpec,
              value: str | Column | None = None) -> DataFrame:
    """A5 long form: (ring, division, n) with n = count (value None) or sum(value)."""
    t = F.col(ts) if isinstance(ts, str) else ts
    return (df.select(spec.ring(t).alias("ring"), spec.division(t).alias("division"),
                      *([] if value is None else
                        [(F.col(value) if isinstance(value, str) else value).alias("_v")]))
            .groupBy("ring", "division")
            .agg((F.count(F.lit(1)) if value is None else F.sum("_v")).alias("n")))


def division_name(i: int) -> str:
    return f"d{i:02d}"


def grid_pivot(long: DataFrame, spec: GridSpec) -> DataFrame:
    """A5 crosstab: one row per ring (Monday first), one column per division; empty cell NULL."""
    wide = long.groupBy("ring").pivot("division", list(range(spec.divisions))).agg(F.first("n"))
    return wide.select("ring", *[F.col(str(i)).alias(division_name(i))
                                 for i in range(spec.divisions)])


def grid_scaled(long: DataFrame) -> DataFrame:
    """Colour level in [0, 1] from the grid's min and max.

    The grid has at most rings x divisions cells (168 for weekday x hour), a
    bound fixed by the spec, so one window over the whole grid is cheap.
    """
    whole = Window.partitionBy()
    g = (long.withColumn("lo", F.min("n").over(whole))
         .withColumn("hi", F.max("n").over(whole)))
    lvl = F.when(F.col("hi") == F.col("lo"), F.lit(0.0)).otherwise(
        (F.col("n") - F.col("lo")).cast("double") / (F.col("hi") - F.col("lo")))
    return g.select("ring", "division", "n", "lo", "hi", lvl.alias("level"))
