"""The rows of a source around each target instant, by one shuffle and two sorts.

Targets and source rows are united and sorted by time within a recording; running
windows carry the last source row forward and, over the reverse order, the next
one back.  Very long recordings can be cut into time chunks: each chunk is a window
partition of its own, and the rows at the chunks' edges (one per chunk and
direction) are carried over empty stretches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import KEY, TS

PREV, NEXT = "__prev", "__next"


def col(name: str) -> Column:
    return F.col(f"`{name}`")


def around(source: DataFrame, targets: DataFrame, columns: list[str], key: str = KEY, ts: str = TS, chunk_ns: int | None = None) -> DataFrame:
    """``targets`` with structs ``__prev`` and ``__next``: the source rows at or before, and at or after.

    A struct holds ``t`` and ``c0, c1, ...`` for ``columns``; it is null beyond the
    source's range.  An exact match is both.  Of source rows at one instant the
    smallest (by the columns in order) counts.  Null times are ignored.
    """
    keep = [c for c in targets.columns if c not in (key, ts)]
    src = F.struct(col(ts).alias("t"), *[col(c).alias(f"c{i}") for i, c in enumerate(columns)])
    left = source.where(col(ts).isNotNull()).select(col(key), col(ts), src.alias("__src"), F.lit(0).alias("__kind"))
    right = targets.select(col(key), col(ts), *[col(c).alias(f"__k{i}") for i, c in enumerate(keep)], F.lit(1).alias("__kind"))
    both = left.unionByName(right, allowMissingColumns=True)
    part = [col(key)]
    if chunk_ns:
        both = both.withColumn("__chunk", F.floor(col(ts) / F.lit(chunk_ns)))
        part.append(F.col("__chunk"))
    frame = (Window.unboundedPreceding, Window.currentRow)
    # Source rows stand before targets of the same instant in both directions.
    forward = Window.partitionBy(*part).orderBy(col(ts), "__kind", F.desc("__src")).rowsBetween(*frame)
    back = Window.partitionBy(*part).orderBy(col(ts).desc(), "__kind", F.desc("__src")).rowsBetween(*frame)
    out = both.withColumn(PREV, F.last("__src", ignorenulls=True).over(forward)).withColumn(NEXT, F.last("__src", ignorenulls=True).over(back))
    out = out.where("__kind = 1")
    if chunk_ns:
        edges = left.groupBy(col(key), F.floor(col(ts) / F.lit(chunk_ns)).alias("__chunk")).agg(F.min_by("__src", F.struct("__src")).alias("__a"), F.max("__src.t").alias("__t"), F.min(F.struct((-col(ts)).alias("o"), F.col("__src").alias("s")))["s"].alias("__b"))
        asked = right.select(col(key), F.floor(col(ts) / F.lit(chunk_ns)).alias("__chunk")).distinct()
        chunks = edges.join(asked, [key, "__chunk"], "full")
        order = Window.partitionBy(col(key)).orderBy("__chunk")
        carried = chunks.select(col(key), "__chunk", F.last("__b", True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("__before"), F.last("__a", True).over(Window.partitionBy(col(key)).orderBy(F.desc("__chunk")).rowsBetween(Window.unboundedPreceding, -1)).alias("__after"))
        out = out.join(carried, [key, "__chunk"], "left").withColumn(PREV, F.coalesce(PREV, "__before")).withColumn(NEXT, F.coalesce(NEXT, "__after"))
    return out.select(col(key), col(ts), *[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)], PREV, NEXT)
