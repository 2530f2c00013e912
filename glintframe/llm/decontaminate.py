"""Benchmark decontamination by SimHash over item-sized windows.

A document's windows of as many words as a benchmark item get a 128-bit SimHash of
their five-word shingles.  Fingerprints within ``RADIUS`` of an item's are found by
a multi-index of eight 16-bit blocks: buckets keyed by (block, value), probed with
every value near the window's own.  Blocks' radii add up so that a fingerprint within
``RADIUS`` is near in one of them at least, so the probes find all of them.  An item
with one such window is verified by the exact weighted Jaccard similarity of the
shingles (weight: occurrences), at all windows of the document.
Windows with too few shingles of items of their size for the similarity get no
fingerprint.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, lower_ascii, mix, prefix_hash, byte_codes, range_hash, tuned, utf8_buffers, window_hashes

SHINGLE, SIMILARITY = 5, 0.8
#: At similarity 0.8 the fingerprints of a pair differ in 19 of 128 bits on average (deviation 4.1); none of
#: 18,000 such pairs of 9 to 180 shingles differed in more than 36.
RADIUS, BLOCKS = 36, 8
#: Bits by which each block is probed: one more than each, added up, is one more than the radius.
NEAR = [(RADIUS + 1 - BLOCKS + b) // BLOCKS for b in range(BLOCKS)]
#: Benchmark text that one broadcast index may hold; more text makes more indexes, applied one after another.
INDEX_BYTES = 8 << 20

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_POP16 = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)
_SALT = np.uint64(0xC2B2AE3D27D4EB4F)


def shingle_codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of lower-cased bytes and, by document, the first one's index.

    Words are runs of ASCII letters and digits and of characters beyond ASCII; a
    text of fewer than five words is one shingle, a text without words none.
    """
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = _WORD[data]
    inner = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    glued = np.unique(inner[_WORD[data[inner - 1]] & _WORD[data[inner]]]) if len(inner) else inner
    if len(glued):
        starts, ends = np.sort(np.concatenate([starts, glued])), np.sort(np.concatenate([ends, glued]))
    first = np.searchsorted(starts, offsets)
    words = range_hash(prefix_hash(byte_codes(data)), starts, ends)
    at, hashes = window_hashes(words, first, SHINGLE)
    short = np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < SHINGLE))
    if len(short):
        prefix = prefix_hash(words)
        at = np.concatenate([at, first[short]])
        hashes = np.concatenate([hashes, range_hash(prefix, first[short], first[short + 1])])
        order = np.argsort(at, kind="stable")
        at, hashes = at[order], hashes[order]
    return hashes, np.searchsorted(at, first)


def _text(text: str) -> np.ndarray:
    data = lower_ascii(np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8))
    return shingle_codes(data, np.array([0, len(data)]))[0]


def fingerprints(shingles: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHash (two 64-bit halves) of the windows of ``size`` shingles at the starts."""
    low, high = int(starts[0]), int(starts[-1]) + size
    part = shingles[low:high]
    bits = np.unpackbits(np.stack([part, mix(part ^ _SALT)], 1).view(np.uint8), axis=1).astype(np.int32) * 2 - 1
    total = np.zeros((len(part) + 1, 128), np.int32)
    np.cumsum(bits, axis=0, out=total[1:])
    votes = total[starts - low + size] - total[starts - low]
    return np.packbits(votes > 0, axis=1).view(np.uint64)


def similarities(shingles: np.ndarray, size: int, own: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of each window of ``size`` shingles and an item (sorted shingles, occurrences).

    An occurrence counts in the windows that hold it but not also the one that lies as
    many occurrences before it as the item has: of these, no more than the item has count.
    """
    n, rank = len(shingles), np.searchsorted(own, shingles)
    place = np.flatnonzero(own[np.minimum(rank, len(own) - 1)] == shingles)
    order = np.lexsort((place, rank[place]))
    place, kind = place[order], rank[place][order]
    earlier = np.arange(len(place)) - count[kind]
    before = np.maximum(earlier, 0)
    same = (earlier >= 0) & (kind[before] == kind)
    low = np.maximum(np.where(same, place[before], -1) + 1, place - size + 1)
    shared = np.zeros(n + 2, np.int64)
    keep = low <= place
    np.add.at(shared, np.maximum(low[keep], 0), 1)
    np.add.at(shared, place[keep] + 1, -1)
    shared = np.cumsum(shared)[: n - size + 1]
    return shared / (size + int(count.sum()) - shared)


class MultiIndex:
    """Fingerprints in buckets by the value of each block."""

    def __init__(self, prints: np.ndarray) -> None:
        self.blocks = prints.view(np.uint16).reshape(len(prints), BLOCKS)
        self.order = [np.argsort(x, kind="stable") for x in self.blocks.T]
        self.begin = [np.searchsorted(x[o], np.arange((1 << 16) + 1)) for x, o in zip(self.blocks.T, self.order)]
        self.filled = [np.diff(x) > 0 for x in self.begin]
        self.probes = [np.flatnonzero(_POP16 <= t).astype(np.uint16) for t in NEAR]

    def candidates(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs (query, entry) that some block's probes meet."""
        split, found = queries.view(np.uint16).reshape(len(queries), BLOCKS), [np.zeros(0, np.int64)]
        for at in range(0, len(queries), 256):
            for b in range(BLOCKS):
                values = split[at : at + 256, b, None] ^ self.probes[b]
                q, k = np.nonzero(self.filled[b][values])
                value = values[q, k].astype(np.int64)
                first, size = self.begin[b][value], self.begin[b][value + 1] - self.begin[b][value]
                entry = self.order[b][np.repeat(first, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
                found.append(np.repeat(q + at, size) * len(self.blocks) + entry)
        pairs = np.unique(np.concatenate(found))
        return pairs // max(1, len(self.blocks)), pairs % max(1, len(self.blocks))

    def within(self, queries: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (query, entry) whose fingerprints differ in at most ``radius`` bits."""
        q, e = self.candidates(queries)
        keep = _POP16[queries.view(np.uint16).reshape(len(queries), BLOCKS)[q] ^ self.blocks[e]].sum(1) <= radius
        return q[keep], e[keep]


class Benchmark:
    """The items of one index."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.ids, self.counts, sizes, prints, self.holders = [], [], [], [], defaultdict(set)
        for item, text in items:
            shingles = _text(text)
            if not len(shingles):
                continue
            self.ids.append(item)
            self.counts.append(np.unique(shingles, return_counts=True))
            sizes.append(len(shingles))
            prints.append(fingerprints(shingles, np.zeros(1, np.int64), len(shingles)))
            for x in self.counts[-1][0].tolist():
                self.holders[x].add(len(shingles))
        self.sizes = np.array(sizes, np.int64)
        self.index = MultiIndex(np.concatenate([np.zeros((0, 2), np.uint64), *prints]))
        self.known = np.array(sorted(self.holders), np.uint64)
        self.hint = np.zeros(1 << 20, bool)
        self.hint[self.known >> np.uint64(44)] = True

    def hits(self, shingles: np.ndarray) -> np.ndarray:
        """Places of shingles that some item holds."""
        maybe = np.flatnonzero(self.hint[shingles >> np.uint64(44)])
        x = shingles[maybe]
        return maybe[self.known[np.minimum(np.searchsorted(self.known, x), len(self.known) - 1)] == x] if len(self.known) else maybe[:0]

    def matches(self, shingles: np.ndarray, hits: np.ndarray) -> dict[int, tuple[int, float, int]]:
        """For one document, by item: matching windows, the best similarity, the first matching start."""
        sizes: dict[int, list[int]] = defaultdict(list)
        for p in hits.tolist():
            for m in self.holders[int(shingles[p])]:
                sizes[m].append(p)
        out: dict[int, tuple[int, float, int]] = {}
        n = len(shingles)
        for size, places in sizes.items():
            m = min(size, n)
            held = np.zeros(n + 1, np.int64)
            held[np.array(places) + 1] = 1
            held = np.cumsum(held)
            # A window shares no more with an item than the shingles that items of this size hold.
            starts = np.flatnonzero((held[m:] - held[: n - m + 1]) * (1 + SIMILARITY) >= SIMILARITY * (m + size) - 1e-9)
            met: set[int] = set()
            for at in range(0, len(starts), 4096):
                some = starts[at : at + 4096]
                _, e = self.index.within(np.concatenate([fingerprints(shingles, run, m) for run in np.split(some, np.flatnonzero(np.diff(some) > m) + 1)]))
                met.update(np.unique(e[self.sizes[e] == size]).tolist())
            for k in met:
                x = similarities(shingles, m, *self.counts[k])
                good = np.flatnonzero(x >= SIMILARITY)
                if len(good):
                    out[k] = (len(good), float(x.max()), int(good[0]))
        return out

    def scan(self, column: pa.Array) -> list[tuple]:
        """Of a column of texts: row, item, matching windows, best similarity, first start."""
        low = pa.array([None if t is None else t if t.isascii() else t.lower() for t in column.to_pylist()], pa.string())
        offsets, data = utf8_buffers(low)
        found: list[tuple] = []
        for i, j in chunks(np.diff(offsets)):
            shingles, first = shingle_codes(lower_ascii(data[offsets[i] : offsets[j]]), offsets[i : j + 1] - offsets[i])
            hits = self.hits(shingles)
            cut = np.searchsorted(hits, first)
            for d in np.flatnonzero(np.diff(cut)):
                got = self.matches(shingles[first[d] : first[d + 1]], hits[cut[d] : cut[d + 1]] - first[d])
                found += [(i + d, self.ids[k], *v) for k, v in sorted(got.items())]
        return found


def _indexes(benchmark: DataFrame, id_col: str, text_col: str) -> list[list[tuple[int, str]]]:
    """The items, in parts of at most ``INDEX_BYTES`` of text (a longer item is a part alone)."""
    items = benchmark.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    parts = max(1, math.ceil(2 * total / INDEX_BYTES))
    part = F.pmod(F.xxhash64("id", "text"), F.lit(parts))
    return [sorted(((r["id"], r["text"]) for r in items.where(part == p).collect()), key=lambda x: (x[0] is None, x)) for p in range(parts)]


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Documents with a window at least 0.8 similar to a benchmark item of its size.

    Returns one row for each such document and item: ``doc_id, item_id, n_windows``
    (starts of matching windows), ``similarity`` (the best) and ``first_word``.  A
    document shorter than the item is one window.  An item of fewer than five words is
    one shingle, so it is found only in documents of exactly these words.  Texts that are null or have no
    words match nothing; repeated rows are judged each; items with equal text are
    all reported.  The index that is broadcast is bounded by ``INDEX_BYTES``.
    """
    spark = tuned(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, item_id bigint, n_windows bigint, similarity double, first_word bigint"

    def apply(items: list[tuple[int, str]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Benchmark(shared.value)
            for b in batches:
                cols = list(zip(*index.scan(b.column(1)))) or [()] * 5
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(cols[0], pa.int64())), *(pa.array(c, t) for c, t in zip(cols[1:], (pa.int64(), pa.int64(), pa.float64(), pa.int64())))], names=["doc_id", "item_id", "n_windows", "similarity", "first_word"])

        return rows.mapInArrow(run, schema)

    parts = [apply(items) for items in _indexes(benchmark, item_col, item_text)]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``contamination`` would not report, with all their columns; no shuffle."""
    spark, at = tuned(docs.sparkSession), docs.columns.index(text_col)

    def apply(rows: DataFrame, items: list[tuple[int, str]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Benchmark(shared.value)
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                keep[[x[0] for x in index.scan(b.column(at))]] = False
                yield b.filter(pa.array(keep))

        return rows.mapInArrow(run, docs.schema)

    for items in _indexes(benchmark, item_col, item_text):
        docs = apply(docs, items)
    return docs


def contaminated_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each contaminated document and item."""
    return contamination(docs, benchmark).withColumn("similarity", F.round("similarity", 9))


CONTAMINATION_SQL = r"""
WITH d AS (SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\x{80}-\x{10FFFF}]+') AS ws FROM documents),
i AS (SELECT item_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\x{80}-\x{10FFFF}]+') AS ws FROM benchmark),
ds AS (SELECT id, len(ws) AS n, unnest(range(greatest(len(ws) - 4, 1))) AS p, ws FROM d WHERE len(ws) > 0),
ix AS (SELECT id, unnest(range(greatest(len(ws) - 4, 1))) AS p, ws FROM i WHERE len(ws) > 0),
dh AS (SELECT id, p, greatest(n - 4, 1) AS n, array_to_string(ws[p + 1:p + 5], ' ') AS s FROM ds),
ic AS (SELECT id AS item, array_to_string(ws[p + 1:p + 5], ' ') AS s, count(*) AS c FROM ix GROUP BY ALL),
im AS (SELECT item, sum(c) AS m FROM ic GROUP BY item),
hits AS (SELECT dh.id, p, n, item, s, c, least(m, n)::BIGINT AS w, m::BIGINT AS m FROM dh JOIN ic USING (s) JOIN im USING (item)),
starts AS (SELECT DISTINCT id, item, w, m, unnest(range(greatest(p - w + 1, 0), least(p, n - w) + 1)) AS a FROM hits),
per AS (SELECT starts.id, starts.item, starts.w, starts.m, a, s, least(count(*), any_value(c)) AS shared FROM starts JOIN hits ON hits.id = starts.id AND hits.item = starts.item AND p BETWEEN a AND a + starts.w - 1 GROUP BY ALL),
sims AS (SELECT id, item, a, sum(shared)::DOUBLE / (w + m - sum(shared)) AS x FROM per GROUP BY id, item, a, w, m)
SELECT id AS doc_id, item AS item_id, count(*)::BIGINT AS n_windows, round(max(x), 9) AS similarity, min(a)::BIGINT AS first_word FROM sims WHERE x >= 0.8 GROUP BY id, item"""
