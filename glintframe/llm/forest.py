"""Near-duplicate documents by an LSH forest of MinHash signatures.

Every tree orders all sets by its own sequence of minima: the first ``SHALLOW`` name a
region, the next ones continue the order inside it.  Regions are dealt to their
owners by key, so every tree's order is a shuffle and a sort of fixed-size entries.
A region is as deep as its crowd demands: while more than ``CROWD`` sets share the
prefix, it is split by the next minimum, down to ``DEEP`` in all.  In two of the
trees, each set is compared first with one of those that share its longest common
prefix; these links contract most copies to one component.  Then the mates of every
region, in all trees, that still lie in several components are compared, by sketches
inside the tasks and exactly on the full sets.

A pair at similarity s shares a region of depth d in one of T trees with probability
1 - (1 - s**d)**T: with 64 trees at 0.8, all but 2e-15 of such pairs at depth 4, and
all but 8e-6 at depth 8, which only crowded regions have.  Nothing is capped: a
region that stays crowded at full depth is compared whole, in blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import cut, discard, mix, tuned
from .exchange import Block, Corpus, order_of, pack, unpack
from .linking import classes, labels_of, sketch, vertices

#: Trees, minima that name a region, minima of the deepest region.
TREES, SHALLOW, DEEP = 64, 4, 8
#: Sets that share a region before it is split.
CROWD = 32
#: Trees whose neighbours are compared before the regions are.
LEADING = 2
#: Text of a block.
BLOCK = 8 << 20
#: Elements that are hashed at once.
STRIP = 1024
_NONE = np.zeros(0, np.uint64)
_FACTORS = np.random.default_rng(13).integers(0, 1 << 31, (TREES * DEEP, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def minima(own: np.ndarray) -> np.ndarray:
    """The least of the elements' hashes under each of ``TREES * DEEP`` functions (at least one element)."""
    x = (own >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(_FACTORS), 0xFFFFFFFF, np.uint32)
    for a in range(0, len(x), STRIP):
        np.minimum(out, (_FACTORS * x[None, a : a + STRIP]).min(1), out=out)
    return out


def entries(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One entry for each tree and set: region key, the order inside the region (8 bits a level), vertex, tree."""
    m = np.array([minima(x) for x in sets], np.uint32).reshape(-1, TREES, DEEP).astype(np.uint64)
    region = np.broadcast_to(mix(np.arange(1, TREES + 1)), m.shape[:2]).copy()
    for k in range(SHALLOW):
        region = mix(region * np.uint64(0x9E3779B97F4A7C15) + m[:, :, k])
    inner = np.zeros(m.shape[:2], np.uint64)
    for k in range(SHALLOW, DEEP):
        inner = (inner << np.uint64(8)) | (mix(m[:, :, k].ravel()).reshape(inner.shape) >> np.uint64(56))
    vertex = np.repeat(np.arange(len(sets)), TREES)
    tree = np.tile(np.arange(TREES), len(sets))
    return region.ravel(), inner.ravel(), vertex, tree


def _ordered(block: Block, words: int):
    """Vertices of the block as in ``vertices``, then its entries in the order of their keys."""
    keys, sizes, distinct, sets = vertices(block, words)
    region, inner, vertex, tree = entries(sets)
    order = order_of(region)
    return keys, sizes, distinct, sets, region[order], inner[order], vertex[order], tree[order]


def regions(keys: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of entries: the order of the trees, the final region of each entry in it, and how many share that."""
    n = len(keys)
    order = np.lexsort((inner, keys))
    keys, inner = keys[order], inner[order]
    settled, region, members = np.zeros(n, bool), np.zeros(n, np.int64), np.zeros(n, np.int64)
    new = np.concatenate([[True], keys[1:] != keys[:-1]])[:n]
    for level in range(DEEP - SHALLOW + 1):
        if level:
            digit = inner >> np.uint64(8 * (DEEP - SHALLOW - level))
            new = new | np.concatenate([[True], digit[1:] != digit[:-1]])[:n]
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, n))
        of, many = np.repeat(begin, size), np.repeat(size, size)
        now = ~settled & ((many <= CROWD) | (level == DEEP - SHALLOW))
        region[now], members[now] = of[now], many[now]
        settled |= now
    return order, region, members


def heads(keys: np.ndarray, inner: np.ndarray, vertex: np.ndarray) -> np.ndarray:
    """Pairs of every entry with the first of those that share its longest common prefix with any other; entries are in order.

    The first of such a run is paired where a shorter prefix puts it behind another, so
    the pairs of a region are a shallow tree.
    """
    n, other = len(keys), np.full(len(keys), -1)
    for level in range(DEEP - SHALLOW, -1, -1):
        digit = inner >> np.uint64(8 * (DEEP - SHALLOW - level)) if level else np.zeros(n, np.uint64)
        begin = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (digit[1:] != digit[:-1])])[:n])
        first = np.repeat(begin, np.diff(np.append(begin, n)))
        free = (other < 0) & (first != np.arange(n))
        other[free] = first[free]
    own = np.flatnonzero(other >= 0)
    pairs = np.sort(np.stack([vertex[own], vertex[other[own]]], 1), 1)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    pairs = pairs[order]
    return pairs[np.concatenate([[True], (pairs[1:] != pairs[:-1]).any(1)])[: len(pairs)]]


def _answer(keys: np.ndarray, values: list[np.ndarray]) -> tuple[list[np.ndarray], list[float]]:
    """1 for an entry whose first region holds other sets too."""
    _, inverse, count = np.unique(keys, return_inverse=True, return_counts=True)
    return [(count > 1)[inverse].astype(np.uint64)], []


def _found(table: pa.Table) -> pa.Table:
    """At an owner: mates of final regions (each group of sets once), and neighbours in the leading trees (group null)."""
    keys = np.concatenate([_NONE, *(unpack(x) for x in table.column("keys").to_pylist())])
    inner, vertex, tree = (np.concatenate([_NONE, *(unpack(x[k]) for x in table.column("told").to_pylist())]) for k in range(3))
    order, region, members = regions(keys, inner)
    keys, vertex, tree = keys[order], vertex[order], tree[order]
    lead = tree < LEADING
    pairs = heads(keys[lead], inner[order][lead], vertex[lead])
    pick = members > 1
    region, vertex = region[pick], vertex[pick]
    by = np.lexsort((vertex, region))
    region, vertex = region[by], vertex[by]
    begin = np.flatnonzero(np.concatenate([[True], region[1:] != region[:-1]])) if len(region) else np.zeros(0, np.int64)
    name = mix(np.add.reduceat(mix(vertex), begin)) if len(begin) else _NONE
    size = np.diff(np.append(begin, len(region)))
    first = np.zeros(len(begin), bool)
    first[np.unique(name, return_index=True)[1]] = True
    keep = np.repeat(first, size)
    group, a = np.repeat(name, size)[keep].view(np.int64), vertex[keep]
    none = pa.nulls(len(pairs), pa.int64())
    return pa.table({
        "group": pa.chunked_array([pa.array(group), none]), "vertex": pa.array(np.concatenate([a, pairs[:, 0]]).view(np.int64)),
        "mate": pa.chunked_array([pa.nulls(len(a), pa.int64()), pa.array(pairs[:, 1].astype(np.uint64).view(np.int64))]),
    })


_ROW = "id {id}, n bigint, key bigint, vertex bigint, sketch array<bigint>, elements binary"


def _apply(words: int):
    def apply(block: Block, told: dict, sums: dict) -> pa.Table:
        keys, sizes, distinct, sets, _, _, vertex, _ = _ordered(block, words)
        met = np.zeros(len(sets), bool)
        met[vertex[(told[1][0] if 1 in told else _NONE) > 0]] = True
        first: dict[int, int] = {}
        for r in np.flatnonzero(sizes).tolist():
            first.setdefault(int(keys[r]), r)
        at: list[int | None] = [None] * len(block.ids)
        for v, k in enumerate(distinct.tolist()):
            if met[v]:
                at[first[k]] = v
        base = block.number << 32
        return pa.table({
            "id": block.ids, "n": pa.array(sizes), "key": pa.array(keys.view(np.int64)), "vertex": pa.array([None if v is None else base + v for v in at], pa.int64()),
            "sketch": pa.array([None if v is None else sketch(sets[v]) for v in at], pa.list_(pa.int64())),
            "elements": pa.array([None if v is None else pack(common.distinct(sets[v] >> np.uint64(16)), True) for v in at], pa.binary()),
        })

    return apply


def forest_join(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", made: list[str] | None = None) -> DataFrame:
    """Link documents whose sets of ``words``-grams have Jaccard similarity of ``percent`` hundredths or more.

    Words are ASCII-lower-cased runs of bytes other than ASCII white space; a text of
    fewer words is one n-gram; null and empty texts and those without words have no
    set and are linked with nothing.  Returns ``doc_id, n_shingles, component_id``: the
    set's size and the smallest id reachable by links.  Rows with a null id belong to
    components but name none; repeated rows are rows like others; other columns play
    no part; an empty table gives no rows.  Candidates come from the forest, links are
    confirmed on full sets (elements by 48-bit fingerprints).  The depths suit
    similarities of 0.75 and more.  ``made`` gets the folders the result is read from.
    """
    spark = tuned(docs.sparkSession)
    corpus = Corpus(docs, id_col, text_col, block_bytes=BLOCK)

    def ask(block: Block, told: dict, sums: dict) -> tuple[np.ndarray, list[np.ndarray]]:
        *_, region, inner, vertex, tree = _ordered(block, words)
        return region, [inner, vertex.astype(np.uint64) + (np.uint64(block.number) << np.uint64(32)), tree.astype(np.uint64)]

    questions = corpus.round(1, ask, _answer)
    rows = corpus.finish(_apply(words), _ROW.format(id=corpus.id_type)).withColumn("group", F.lit(None).cast("bigint"))
    found = questions.groupBy("owner").applyInArrow(_found, "group bigint, vertex bigint, mate bigint")
    # One job writes both, so they share the shuffles.
    both = cut(rows.withColumn("document", F.lit(True)).unionByName(found, allowMissingColumns=True), made)
    rows, found, spent = both.where("document").drop("group", "mate", "document"), both.where("document is null"), []
    named = rows.where("vertex is not null")
    sets, whole = cut(named.dropDuplicates(["key"]).select("key", "n", "sketch"), spent), named.select("key", "elements")
    name = named.select("vertex", "key")
    member = cut(found.where("group is not null").select("group", "vertex").distinct().join(name, "vertex").select("group", "key").distinct(), spent)
    pairs = found.where("mate is not null").select("vertex", "mate").distinct().join(name.withColumnRenamed("key", "x"), "vertex")
    pairs = pairs.join(name.select(F.col("vertex").alias("mate"), F.col("key").alias("y")), "mate")
    pairs = cut(pairs.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), spent)
    label = labels_of(member, sets, whole, percent, spent, pairs)
    out = classes(rows, label, made)
    discard(spark, spent)
    return out


def forest_duplicates(docs: DataFrame) -> DataFrame:
    """Per document: size of its set of two-word shingles, its component at 0.8, and whether it is the one kept."""
    return forest_join(docs, words=2, percent=80).withColumn("kept", F.expr("doc_id <=> component_id"))
