"""Set-similarity self-join of word n-gram sets by PartEnum signatures.

Sets are dealt into size bands; sets that are similar enough lie in one band or in
neighbouring ones and, for a band, differ in at most ``k`` elements.  The feature
domain is partitioned into parts and each part into sub-parts; a signature is a
part without some of its sub-parts, and every choice is enumerated, so that sets
differing in at most ``k`` elements share one.  ``spare`` more parts than needed
are made: even without any ``spare`` parts of a set, one signature is shared.  That
lets a set drop signatures that hold next to nothing or that very many sets share,
as long as they lie in at most ``spare`` of its parts; the few sets with more of
them meet in the large groups after all.  Candidates are pruned by parity sketches
(never more apart than the sets are) and then compared exactly.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import cut, discard, mix, tuned
from .exchange import Block, Corpus, pack, unpack
from .linking import classes, labels_of, sketch, vertices

#: Vertices that share a signature before it counts as crowded.
CROWD = 48
#: Text of a block: less than elsewhere, as signatures of a set take more room than its text.
BLOCK = 8 << 20
#: Signatures have 48 bits: a chance group costs a comparison of sketches and gives no link.
_SHORT = ~np.uint64(0xFFFF)
_NONE = np.zeros(0, np.uint64)


@dataclass(frozen=True)
class Plan:
    """Signatures of one band: parts, sub-parts of each, how many are left out, spare parts, least content."""

    k: int
    parts: int
    sub: int
    out: int
    spare: int
    least: int


class Bands:
    """Size bands and their plans for Jaccard similarity of at least ``percent`` hundredths."""

    def __init__(self, percent: int) -> None:
        self.percent = percent
        self.low = [1]
        self.plans: dict[int, Plan] = {}

    def of(self, size: int) -> int:
        while self.low[-1] <= size:
            self.low.append(max(self.low[-1] + 1, self.low[-1] * 100 // self.percent + 1))
        return int(np.searchsorted(self.low, size, side="right")) - 1

    def all(self, sizes: np.ndarray) -> np.ndarray:
        """The bands of many sizes."""
        self.of(int(sizes.max()) if len(sizes) else 1)
        return np.searchsorted(self.low, sizes, side="right") - 1

    def most(self, a: int, b: int) -> int:
        """How many elements two similar sets of these sizes can differ in."""
        return (a + b) * (100 - self.percent) // (100 + self.percent)

    def plan(self, band: int) -> Plan:
        if band not in self.plans:
            self.of(self.low[-1])
            while len(self.low) <= band + 1:
                self.of(self.low[-1])
            top = self.low[band + 1] - 1
            k = self.most(top, top)
            if k <= 3:
                self.plans[band] = Plan(k, 1, (1, 3, 5, 6)[k], k, 0, 0)
            else:
                spare = 1 + k // 20
                parts = k // 2 + 1 + spare
                self.plans[band] = Plan(k, parts, 3, 1, spare, 4 if top * 2 >= 27 * parts else 1)
        return self.plans[band]


def signatures(sets: list[np.ndarray], bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all sets: signatures, the set and the (tag, part) of each (tag 0: own band, 1: next), which are light.

    Also the spare parts of each set by tag.  Sets of one band are handled together.
    """
    sizes = np.array([len(x) for x in sets], np.int64)
    band_of = bands.all(sizes)
    sig, vertex, part, light, spare = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)], np.zeros((len(sets), 2), np.int64)
    for band in np.unique(band_of).tolist():
        members = np.flatnonzero(band_of == band)
        for some in np.array_split(members, min(len(members), 1 + (int(sizes[members].sum()) >> 18))):
            own, m = np.concatenate([sets[v] for v in some]), len(some)
            owner = np.repeat(np.arange(m), sizes[some])
            for tag in (0, 1):
                p = bands.plan(band + tag)
                spare[some, tag] = p.spare
                cells = p.parts * p.sub
                salt = mix(np.array([band + tag + 1], np.uint64))[0]
                x = mix(own ^ salt)
                slot = owner * cells + ((x >> np.uint64(32)) * np.uint64(cells) >> np.uint64(32)).astype(np.int64)
                running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(x)[np.argsort(slot, kind="stable")], dtype=np.uint64)])
                count = np.bincount(slot, minlength=m * cells)
                end = np.cumsum(count)
                total = (running[end] - running[end - count]).reshape(m, p.parts, p.sub)
                count = count.reshape(m, p.parts, p.sub)
                for c, left in enumerate(combinations(range(p.sub), p.out)):
                    kept = np.setdiff1d(np.arange(p.sub), left)
                    name = np.arange(p.parts, dtype=np.uint64) * np.uint64(64) + np.uint64(c)
                    sig.append((mix(mix(total[:, :, kept].sum(2, dtype=np.uint64) + salt) ^ name) & _SHORT).ravel())
                    vertex.append(np.repeat(some, p.parts))
                    part.append(np.tile(np.arange(p.parts) + (tag << 32), m))
                    light.append((count[:, :, kept].sum(2) < p.least).ravel())
    return np.concatenate(sig), np.concatenate(vertex), np.concatenate(part), np.concatenate(light), spare


def _of_block(block: Block, words: int, bands: Bands):
    """All vertices' signatures as (signature, vertex) pairs in order, with the (tag, part) of each.

    Then the spare parts by vertex and tag, and the vertex and (tag, part) of every light signature, dropped or not.
    """
    keys, sizes, distinct, sets = vertices(block, words)
    sig, vertex, part, light, spare = signatures(sets, bands)
    # A signature stays unless it is light and its set can do without: at most `spare` light parts for its tag.
    tag = part >> 32
    bad = _parts_of(light, vertex, part, len(sets))
    keep = ~light | (bad[vertex, tag] > spare[vertex, tag])
    weak = vertex[light], part[light]
    sig, vertex, part = sig[keep], vertex[keep], part[keep]
    order = np.lexsort((vertex, sig))
    return keys, sizes, distinct, sets, sig[order], vertex[order], part[order], spare, weak


def _parts_of(flag: np.ndarray, vertex: np.ndarray, part: np.ndarray, n: int) -> np.ndarray:
    """By vertex and tag: parts with at least one flagged signature."""
    pair = np.unique(np.stack([vertex[flag], part[flag]], 1), axis=0) if flag.any() else np.zeros((0, 2), np.int64)
    return np.bincount(pair[:, 0] * 2 + (pair[:, 1] >> 32), minlength=2 * n).reshape(n, 2)


def _sizes_of(keys: np.ndarray) -> np.ndarray:
    _, inverse, count = np.unique(keys, return_inverse=True, return_counts=True)
    return count[inverse]


def _answer(keys: np.ndarray, values: list[np.ndarray]) -> tuple[list[np.ndarray], list[float]]:
    """0: alone, 1: in a group, 2: in a crowd."""
    n = _sizes_of(keys)
    return [((n > 1).astype(np.uint64) + (n > CROWD))], []


def _groups(table: pa.Table) -> pa.Table:
    """At an owner: the members of every group that is no crowd; equal groups once."""
    keys, told = [unpack(x) for x in table.column("keys").to_pylist()], [unpack(x[0]) for x in table.column("told").to_pylist()]
    vertex = np.concatenate([_NONE, *told])
    keys = np.concatenate([_NONE, *keys])
    n = _sizes_of(keys)
    pick = (n > 1) & (n <= CROWD)
    keys, vertex = keys[pick], vertex[pick]
    order = np.lexsort((vertex, keys))
    keys, vertex = keys[order], vertex[order]
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    name = mix(np.add.reduceat(mix(vertex), begin)) if len(begin) else _NONE
    size = np.diff(np.append(begin, len(keys)))
    first = np.zeros(len(begin), bool)
    first[np.unique(name, return_index=True)[1]] = True
    keep = np.repeat(first, size)
    return pa.table({"group": pa.array(np.repeat(name, size)[keep].view(np.int64)), "vertex": pa.array(vertex[keep].view(np.int64))})


_ROW = "id {id}, n bigint, key bigint, vertex bigint, sketch array<bigint>, elements binary, crowds array<bigint>"


def _apply(words: int, percent: int):
    def apply(block: Block, told: dict, sums: dict) -> pa.Table:
        bands = Bands(percent)
        keys, sizes, distinct, sets, sig, vertex, part, spare, weak = _of_block(block, words, bands)
        answer = told[1][0] if 1 in told else _NONE
        grouped = np.zeros(len(sets), bool)
        grouped[vertex[answer > 0]] = True
        crowded = answer > 1
        given, of = np.concatenate([vertex[crowded], weak[0]]), np.concatenate([part[crowded], weak[1]])
        # With more crowded or light parts than it can spare, a set meets others in the crowds.
        busy = _parts_of(np.ones(len(given), bool), given, of, len(sets)) > spare
        member = crowded & busy[vertex, part >> 32] if len(sets) else crowded
        crowds: list[list[int]] = [[] for _ in sets]
        for v, s in zip(vertex[member].tolist(), sig[member].view(np.int64).tolist()):
            crowds[v].append(s)
        first = {}
        for r in np.flatnonzero(sizes):
            first.setdefault(int(keys[r]), int(r))
        place = {first[int(k)]: v for v, k in enumerate(distinct) if grouped[v]}
        n = len(block.ids)
        at = [place.get(r) for r in range(n)]
        base = block.number << 32
        return pa.table({
            "id": block.ids, "n": pa.array(sizes), "key": pa.array(keys.view(np.int64)), "vertex": pa.array([None if v is None else base + v for v in at], pa.int64()),
            "sketch": pa.array([None if v is None else sketch(sets[v]) for v in at], pa.list_(pa.int64())),
            "elements": pa.array([None if v is None else pack(common.distinct(sets[v] >> np.uint64(16)), True) for v in at], pa.binary()),
            "crowds": pa.array([None if v is None else crowds[v] for v in at], pa.list_(pa.int64())),
        })

    return apply


def similarity_join(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", made: list[str] | None = None) -> DataFrame:
    """Link documents whose sets of ``words``-grams have Jaccard similarity of ``percent`` hundredths or more.

    Words are ASCII-lower-cased runs of bytes other than ASCII white space; a text
    of fewer words is one n-gram; texts without words are linked with nothing.
    Returns ``doc_id, n_shingles, component_id``: the set's size and the smallest id
    reachable by links.  Rows with a null id belong to components but name none.
    Links are compared exactly (elements by 48-bit fingerprints); equal sets are
    always linked; repeated rows are rows like others.  ``made`` gets the folders
    that the result is read from.
    """
    spark = tuned(docs.sparkSession)
    corpus = Corpus(docs, id_col, text_col, block_bytes=BLOCK)

    def ask(block: Block, told: dict, sums: dict) -> tuple[np.ndarray, list[np.ndarray]]:
        _, _, _, _, sig, vertex, *_ = _of_block(block, words, Bands(percent))
        return sig, [vertex.astype(np.uint64) + (np.uint64(block.number) << np.uint64(32))]

    questions = corpus.round(1, ask, _answer)
    rows = corpus.finish(_apply(words, percent), _ROW.format(id=corpus.id_type))
    groups = questions.groupBy("owner").applyInArrow(_groups, "group bigint, vertex bigint").distinct()
    # One job writes both, so they share the shuffles.
    both = cut(rows.withColumn("group", F.lit(None).cast("bigint")).unionByName(groups, allowMissingColumns=True), made)
    rows, groups = both.where("group is null").drop("group"), both.where("group is not null").select("group", "vertex")
    named = rows.where("vertex is not null")
    spent: list[str] = []
    sets, whole = cut(named.dropDuplicates(["key"]).select("key", "n", "sketch"), spent), named.select("key", "elements")
    named = named.select("vertex", "key", "crowds")
    member = groups.join(named.select("vertex", "key"), "vertex").select("group", "key").union(named.select(F.explode("crowds").alias("group"), "key"))
    label = labels_of(cut(member.distinct(), spent), sets, whole, percent, spent)
    out = classes(rows, label, made)
    discard(spark, spent)
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per document: size of its set of three-word shingles, and its component at 0.9."""
    return similarity_join(docs, words=3, percent=90)
