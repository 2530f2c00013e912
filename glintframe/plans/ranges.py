"""Point-in-interval joins by time bins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import KEY, TS
from .neighbours import col


def within(points: DataFrame, intervals: DataFrame, start: str, end: str, key: str = KEY, ts: str = TS, bin_ns: int | None = None, how: str = "inner") -> DataFrame:
    """Join each point with the intervals of its recording that hold it, both ends included.

    An interval is dealt to every bin of ``bin_ns`` that it touches and a point to its
    own bin, so the join is an equi-join on (recording, bin) with a residual test and
    yields each pair once.  By default a bin is as long as the mean interval, found by
    a subquery: then intervals lie in two bins on average, however their lengths differ.
    """
    held = intervals.where(col(end) >= col(start)).withColumnRenamed(key, "__key")
    width = F.lit(bin_ns) if bin_ns else F.coalesce(held.select(F.greatest(F.lit(1), F.ceil(F.avg(col(end) - col(start)))).cast("bigint")).scalar(), F.lit(1))
    at = lambda c: F.floor(c / width).cast("bigint")
    point = points.withColumn("__bin", at(col(ts)))
    held = held.withColumn("__at", F.explode(F.sequence(at(col(start)), at(col(end)))))
    on = (col(key) == F.col("__key")) & (F.col("__bin") == F.col("__at"))
    return point.join(held, on & (col(ts) >= col(start)) & (col(ts) <= col(end)), how).drop("__key", "__bin", "__at")
