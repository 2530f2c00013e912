"""Exact links between the members of candidate groups of n-gram sets.

Shared by the set-similarity join and the near-duplicate forest.  Equal sets are one
vertex, told by a key.  Groups are not expanded into all pairs: of each group only
as many near pairs are compared as would join all mates that may be linked at all.
If all of them are links, no other pair can join anything.  Only groups where one is
none are looked at again.  Where a set lies in few groups, their sets are compared
inside the tasks, nearest first, and only across components, so what comes out is a
forest; where it lies in many, the near pairs of different components become rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import counted, cut, distinct, lower_ascii, mix, prefix_hash, range_hash, shuffle_width, small_enough, trim, window_hashes, word_bounds, word_hashes
from .components import components, joined
from .exchange import Block, pack, unpack

#: Members of a group that are compared at once; a larger group makes several blocks.
UNIT = 2048
#: Bytes of elements that such a block may hold.
UNIT_BYTES = 16 << 20
#: Members of small groups that one bucket takes.
BUCKET = 16384
#: 64-bit words of a parity sketch.
SKETCH = 8


def sketch(own: np.ndarray) -> np.ndarray:
    """Parities of the elements by hash bit: two sketches differ in at most as many bits as the sets in elements."""
    odd = np.bincount((mix(own) >> np.uint64(55)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def sets_of(block: Block, words: int) -> Iterator[np.ndarray]:
    """By row: sorted distinct hashes of the n-grams; a shorter text is one n-gram."""
    for i, j, offsets, data in block.parts():
        starts, ends, first = word_bounds(data := lower_ascii(data), offsets)
        codes = word_hashes(data, starts, ends)
        at, grams = window_hashes(codes, first, words)
        cut_ = np.searchsorted(at, first)
        prefix = prefix_hash(codes)
        for r in range(j - i):
            a, b = first[r], first[r + 1]
            if 0 < b - a < words:
                yield range_hash(prefix, np.array([a]), np.array([b]))
            else:
                yield distinct(grams[cut_[r] : cut_[r + 1]])


def vertices(block: Block, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Set keys and sizes by row; distinct keys in order (the vertices) and the set of each."""
    keys, sizes, held = np.zeros(len(block.ids), np.uint64), np.zeros(len(block.ids), np.int64), {}
    for r, own in enumerate(sets_of(block, words)):
        sizes[r] = len(own)
        if len(own):
            keys[r] = mix(np.array([mix(own).sum(dtype=np.uint64) + np.uint64(len(own))]))[0]
            held.setdefault(int(keys[r]), own)
    distinct = sorted(held)
    return keys, sizes, np.array(distinct, np.uint64), [held[k] for k in distinct]


def _linked(pairs: DataFrame, sets: DataFrame, whole: DataFrame, percent: int, made: list[str]) -> DataFrame:
    """Of candidate pairs (``a`` < ``b`` keys), those that are similar enough, exactly.

    ``sets`` holds sketches, ``whole`` the elements, which only sets of pairs that pass the sketches need.
    """
    left = pairs.join(sets.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a")
    both = left.join(sets.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b")
    apart = sum((F.bit_count(F.col("sa")[i].bitwiseXOR(F.col("sb")[i])) for i in range(1, SKETCH)), F.bit_count(F.col("sa")[0].bitwiseXOR(F.col("sb")[0])))
    near = cut(both.where((apart * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent)) & (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))).select("a", "b", "na", "nb"), made)
    elements = _elements(near.select(F.explode(F.array("a", "b")).alias("key")), whole, made)
    near = near.join(elements.select(F.col("key").alias("b"), F.col("elements").alias("eb")), "b").join(elements.select(F.col("key").alias("a"), F.col("elements").alias("ea")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb, ea, eb = (c.to_pylist() for c in batch.columns)
            keep, last, own = [], None, None
            for k in range(len(a)):
                if a[k] != last:
                    last, own = a[k], unpack(ea[k])
                if _similar(own, unpack(eb[k]), na[k], nb[k], percent):
                    keep.append(k)
            pick = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pick), batch.column(1).take(pick)], names=["a", "b"])

    return near.select("a", "b", "na", "nb", "ea", "eb").mapInArrow(run, "a bigint, b bigint")


def _elements(keys: DataFrame, whole: DataFrame, made: list[str]) -> DataFrame:
    """``key, elements`` of these keys, once each."""
    needed, n = counted(keys.select("key").distinct(), made)
    return cut(whole.join(small_enough(needed, n), "key", "left_semi").dropDuplicates(["key"]), made)


def _forest(label_a: np.ndarray, label_b: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Of candidate pairs, nearest first, those that join labels not yet joined by an earlier one."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    keep, left = [], len(np.unique(np.concatenate([label_a, label_b]))) - 1
    order = np.argsort(apart, kind="stable")
    for k, a, b in zip(order.tolist(), label_a[order].tolist(), label_b[order].tolist()):
        if (a := root(a)) != (b := root(b)):
            up[a] = b
            keep.append(k)
            if len(keep) == left:
                break
    return np.array(keep, np.int64)


def near_mates(member: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of group mates (``group, key, label``), near pairs (``group, a, b, la, lb, apart``) of different labels.

    Only so many, near ones first, that they join all labels of a unit that pairs whose
    sketches allow a link join at all.  Sketches are compared inside the tasks, in
    strips, so neither rows nor memory follow the square of a group.  A large group is
    dealt into blocks, and every pair of blocks is a unit.
    """
    size = member.groupBy("group").agg(F.count("*").alias("n")).where("n > 1").select("group", F.ceil(F.col("n") / UNIT).cast("int").alias("blocks"))
    rows = _units(member.join(size, "group").join(sets.select("key", "n", "sketch"), "key"))

    def compare(table: pa.Table) -> pa.Table:
        unit = _Units(table)
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        for x, y in unit.ranges():
            root = np.unique(unit.label[x:y], return_inverse=True)[1]
            for share in (2, 1):  # at most half as far apart as a link may be, then the rest
                for a, b, apart in unit.near(x, y, root, percent, share):
                    k = _forest(root[a - x], root[b - x], apart)
                    for p, q in zip(a[k], b[k]):
                        root[root == root[p - x]] = root[q - x]
                    for to, v in zip(out, (a[k], b[k], apart[k])):
                        to.append(v)
        a, b, apart = map(np.concatenate, out)
        key, label = unit.key, unit.label
        return trim(pa.table({"group": unit.group[a], "a": key[a], "b": key[b], "la": label[a], "lb": label[b], "apart": apart}))

    return rows.groupBy("bucket").applyInArrow(compare, "group bigint, a bigint, b bigint, la bigint, lb bigint, apart double")


def _near_pairs(member: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of group mates (``group, key, label``), all pairs (``a, b``) of different labels whose sketches allow a link."""
    size = member.groupBy("group").agg(F.count("*").alias("n")).where("n > 1").select("group", F.ceil(F.col("n") / UNIT).cast("int").alias("blocks"))
    rows = _units(member.join(size, "group").join(sets.select("key", "n", "sketch"), "key"))

    def compare(table: pa.Table) -> pa.Table:
        unit = _Units(table)
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
        for x, y in unit.ranges():
            root = np.unique(unit.label[x:y], return_inverse=True)[1]
            for a, b, _ in unit.near(x, y, root, percent):
                out[0].append(a)
                out[1].append(b)
        a, b = map(np.concatenate, out)
        return trim(pa.table({"a": unit.key[a], "b": unit.key[b]}))

    return rows.groupBy("bucket").applyInArrow(compare, "a bigint, b bigint").distinct()


def _units(rows: DataFrame) -> DataFrame:
    """Members of ``blocks`` blocks a group, each in every unit that its block is part of, with the unit's bucket."""
    width = shuffle_width(rows.sparkSession)
    rows = rows.withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    # Small units share buckets, more of them where there are more members; a unit of a large group is a bucket of its own.
    small = max(8 * width, math.ceil(rows.where("blocks = 1").count() / BUCKET))
    return rows.withColumn("bucket", F.xxhash64(F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("group"), F.lit(small))).otherwise(F.xxhash64("group", "i", "j"))))


class _Units:
    """The members of a bucket in the order of their units."""

    def __init__(self, table: pa.Table) -> None:
        self.table = table = table.sort_by([("group", "ascending"), ("i", "ascending"), ("j", "ascending"), ("key", "ascending")])
        self.group, self.i, self.j, self.own, self.key, self.label, self.n = (table.column(c).to_numpy() for c in ("group", "i", "j", "own", "key", "label", "n"))
        self.sketches = pa.concat_arrays(table.column("sketch").chunks).flatten().to_numpy().view(np.uint64).reshape(-1, SKETCH)

    def ranges(self) -> Iterator[tuple[int, int]]:
        begin = np.flatnonzero(np.concatenate([[True], (np.diff(self.group) != 0) | (np.diff(self.i) != 0) | (np.diff(self.j) != 0)]))
        return zip(begin.tolist(), np.append(begin[1:], len(self.group)).tolist())

    def near(self, x: int, y: int, root: np.ndarray, percent: int, share: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of the unit ``x`` to ``y``, strip by strip: pairs of different roots whose sketches allow a link, and how far apart they are.

        ``root`` may change between strips.
        """
        n, own = self.n, self.own
        for r in range(x, y, 128):
            left, right = slice(r, min(r + 128, y)), slice(x, y)
            ok = (self.key[left, None] < self.key[None, right]) & (root[left.start - x : left.stop - x, None] != root[None])
            if self.i[x] != self.j[x]:
                ok &= own[left, None] != own[None, right]
            total = n[left, None] + n[None, right]
            ok &= 100 * np.minimum(n[left, None], n[None, right]) >= percent * np.maximum(n[left, None], n[None, right])
            a, b = np.nonzero(ok)
            if not len(a):
                continue
            apart = sum(np.bitwise_count(self.sketches[r + a, k] ^ self.sketches[x + b, k]).astype(np.int64) for k in range(SKETCH))
            near = share * apart * (100 + percent) <= total[a, b] * (100 - percent)
            if near.any():
                yield a[near] + r, b[near] + x, (apart / total[a, b])[near]


def _exact_forest(member: DataFrame, sets: DataFrame, whole: DataFrame, percent: int, spent: list[str]) -> DataFrame:
    """Of group mates (``group, key, label``), links (``a, b``) that join all labels which links join at all.

    The elements go to the units, so pairs are compared exactly inside the tasks and
    never become rows; a unit holds ``UNIT`` sets and ``UNIT_BYTES`` of elements at most
    for each of its two blocks, or one larger set.
    """
    elements = _elements(member, whole, spent)
    rows = member.join(sets.select("key", "n", "sketch"), "key").join(elements, "key")
    size = rows.groupBy("group").agg(F.ceil(F.greatest(F.count("*") / UNIT, F.sum(F.octet_length("elements")) / UNIT_BYTES)).cast("int").alias("blocks"))
    rows = _units(rows.join(size, "group"))

    def compare(table: pa.Table) -> pa.Table:
        unit = _Units(table)
        packed = unit.table.column("elements")
        found: list[tuple[int, int]] = []
        for x, y in unit.ranges():
            root = np.unique(unit.label[x:y], return_inverse=True)[1]
            held: dict[int, np.ndarray] = {}
            for a, b, apart in unit.near(x, y, root, percent):
                for k in np.argsort(apart, kind="stable").tolist():
                    p, q = int(a[k]), int(b[k])
                    if root[p - x] == root[q - x]:
                        continue
                    for v in (p, q):
                        if v not in held:
                            held[v] = unpack(packed[v].as_py())
                    if _similar(held[p], held[q], int(unit.n[p]), int(unit.n[q]), percent):
                        root[root == root[p - x]] = root[q - x]
                        found.append((p, q))
        a, b = (np.array([f[k] for f in found], np.int64) for k in (0, 1))
        return trim(pa.table({"a": unit.key[a], "b": unit.key[b]}))

    return rows.groupBy("bucket").applyInArrow(compare, "a bigint, b bigint").distinct()


def _similar(x: np.ndarray, y: np.ndarray, nx: int, ny: int, percent: int) -> bool:
    both = np.sort(np.concatenate([x, y]))
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (nx + ny - shared)


def _apart(member: DataFrame, label: DataFrame) -> DataFrame:
    """Group mates with their labels, of groups that hold several labels."""
    now = member.join(label.withColumnRenamed("node", "key"), "key", "left").select("group", "key", F.coalesce("label", "key").alias("label"))
    several = now.groupBy("group").agg((F.min("label") < F.max("label")).alias("several")).where("several").select("group")
    return now.join(several, "group", "left_semi")


def labels_of(member: DataFrame, sets: DataFrame, whole: DataFrame, percent: int, spent: list[str], first: DataFrame | None = None) -> DataFrame:
    """``node, label`` of all sets that links between mates of the groups join.

    ``member``: written rows (``group, key``); ``sets``: ``key, n, sketch``; ``whole``:
    ``key, elements``; ``first``: pairs to be compared before all others.  ``spent``
    gets the folders of written tables, which the result is still read from.
    """
    if first is None:
        links, label, now = None, None, member.withColumn("label", F.col("key"))
    else:
        links = cut(_linked(first, sets, whole, percent, spent), spent)
        label = components(links, spent)
        now = cut(_apart(member, label), spent)
    near = cut(near_mates(now, sets, percent), spent)
    # Of all near pairs of two components one is enough if it is a link.
    x, y = F.least("la", "lb").alias("x"), F.greatest("la", "lb").alias("y")
    best = cut(near.groupBy(x, y).agg(F.min(F.struct("apart", "a", "b")).alias("p")).select("x", "y", "p.a", "p.b"), spent)
    more, n = counted(_linked(best.select("a", "b"), sets, whole, percent, spent), spent)
    if label is None:
        label = components(more, spent)
    elif n:
        label = joined(label, more, spent)
    # Only a group with a near pair that is no link can hold a link that joins what is still apart.
    failed, n = counted(best.join(more, ["a", "b"], "left_anti").select("x", "y"), spent)
    if n:
        label = cut(label, spent)
        open_, n = counted(near.select("group", x, y).join(failed, ["x", "y"], "left_semi").select("group").distinct(), spent)
        now = cut(_apart(member.join(small_enough(open_, n), "group", "left_semi"), label), spent)
        if first is None:  # every set lies in many groups, and few of their pairs are near
            pairs = _near_pairs(now, sets, percent).join(best.select("a", "b"), ["a", "b"], "left_anti")
            more, n = counted(_linked(pairs, sets, whole, percent, spent), spent)
        else:
            more, n = counted(_exact_forest(now, sets, whole, percent, spent), spent)
        if n:
            label = joined(label, more, spent)
    return label


def classes(rows: DataFrame, label: DataFrame, made: list[str] | None) -> DataFrame:
    """``doc_id, n_shingles, component_id`` from rows (``id, n, key``) and the labels of keys (``node, label``).

    Ids are gathered by set first, so the rows of equal sets, however many, are joined
    once, in the end.
    """
    label = label.select(F.col("node").alias("key"), "label")
    least = rows.where("n > 0").groupBy("key").agg(F.min("id").alias("id")).join(label, "key", "left").withColumn("label", F.coalesce("label", "key"))
    least = cut(least, made)
    joined = least.groupBy("label").agg(F.min("id").alias("component_id"), F.count("*").alias("sets"))
    # A set alone in its component has its own least id; only the others need their component's.
    several = joined.where("sets > 1").select("label", "component_id")
    of = least.join(several, "label", "left").select("key", F.coalesce("component_id", "id").alias("component_id"), F.lit(True).alias("known"))
    out = rows.join(of.withColumnRenamed("key", "k"), (F.col("key") == F.col("k")) & (F.col("n") > 0), "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
