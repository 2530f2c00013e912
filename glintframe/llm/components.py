"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import cut, discard

#: What tells one table of edges from another.
_MARK = ("count(1)", "sum(xxhash64(a, b) % 1000003)", "sum(xxhash64(b, a) % 999983)")


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges, and the least node that these edges join to each."""
    nodes = np.unique(np.concatenate([a, b]))
    x, y, least = np.searchsorted(nodes, a), np.searchsorted(nodes, b), np.arange(len(nodes))
    while True:
        low = np.minimum(least[x], least[y])
        now = least.copy()
        np.minimum.at(now, x, low)
        np.minimum.at(now, y, low)
        now = now[now]
        if (now == least).all():
            return nodes, nodes[least]
        least = now


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of each batch as stars around the least nodes of what they join."""
    for batch in batches:
        nodes, least = roots(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        far = nodes != least
        yield pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(least[far])], names=["a", "b"])


def components(edges: DataFrame, made: list[str] | None = None) -> DataFrame:
    """``node, label`` for every node of the undirected edges (``a``, ``b``, 64-bit); the label is the least node.

    Edges are contracted inside their tasks first.  Each round aggregates minima (combined
    before the shuffle) and is written to the shared folder, so a lost executor costs one
    round.  The number of rounds grows with the logarithm of a component's size.  ``made``
    gets the last folder; earlier ones are deleted when the next is written.
    """

    def written(df: DataFrame, to: list[str]) -> tuple[DataFrame, tuple]:
        seen = Observation()
        out = cut(df.observe(seen, *[F.expr(c).alias(f"m{k}") for k, c in enumerate(_MARK)]), to)
        return out, tuple(seen.get.values())

    old: list[str] = []
    now, seen = written(edges.select("a", "b").where("a <> b").mapInArrow(_contracted, "a bigint, b bigint").distinct(), old)
    while seen[0]:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e")).select("e.a", F.col("e.m").alias("b")).where("a <> b").distinct()
        new: list[str] = []
        before = seen
        now, seen = written(small, new)
        discard(edges.sparkSession, old)
        old = new
        if before == seen:
            break
    if made is not None:
        made += old
    stars = now.groupBy("a").agg(F.min("b").alias("label")).select(F.col("a").alias("node"), "label")
    return stars.union(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def joined(label: DataFrame, links: DataFrame, made: list[str] | None = None) -> DataFrame:
    """Labels of all nodes after further ``links`` between them: components of what the labels leave apart."""
    at = label.select(F.col("node").alias("a"), F.col("label").alias("x")), label.select(F.col("node").alias("b"), F.col("label").alias("y"))
    ends = links.join(at[0], "a", "left").join(at[1], "b", "left").select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"))
    again = components(ends, made).select(F.col("node").alias("label"), F.col("label").alias("least"))
    out = label.join(again, "label", "left").select("node", F.coalesce("least", "label").alias("label"))
    # Nodes that only the new links have, and labels themselves, which may have none of their own.
    return out.union(again.select(F.col("label").alias("node"), F.col("least").alias("label")).join(label, "node", "left_anti"))
