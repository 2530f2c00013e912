"""Alignment of two tokenizers by deduplicated segments.

A text is cut before runs of white space, where neither vocabulary can merge across:
``splits`` verifies that no entry of either has a blank after anything that is not
white space.  Both encode a segment as they would inside the whole text, so a text's
tokens are its segments' tokens in order.  Blocks of the corpus name their distinct
segments; these are shuffled and sorted by content, and every distinct segment is
encoded and aligned once, in a stream of its sorted copies.  The alignments go back
to the blocks that named the segment, which compose their documents from them.  A
block names a segment once, so the commonest word is no hot key.

Counts of linked id pairs are one round of questions and answers over the blocks
(see ``exchange``): all pairs of one id lie with one owner, which knows the highest.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_codes, distinct, prefix_hash, range_hash, tuned
from .exchange import ANSWER, Block, Corpus, grouped, look_up, pack

#: Text of a block: little, as a segment and its alignment take several times their text.
BLOCK = 5 << 20
#: ``segments`` of ``aligned`` travel as this step of the answers.
_ALIGNED, _COUNTED = 0, 1
_NONE = np.zeros(0, np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
#: Last bytes of the white space characters beyond ASCII, by the bytes before.
_WIDE = ((0xC2, None, (0x85, 0xA0)), (0x9A, 0xE1, (0x80,)), (0x80, 0xE2, (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)), (0x81, 0xE2, (0x9F,)), (0x80, 0xE3, (0x80,)))


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Pair:
    """Both tokenizers, loaded where they are used, and the bytes of their entries."""

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        table = byte_level()
        entries = {i: t for t, i in self.a.get_vocab(with_added_tokens=False).items()}
        self.a_bytes = [bytes(table[c] for c in entries.get(i, "")) for i in range(max(entries) + 1)]
        pieces = [(self.b.id_to_piece(i), self.b.is_byte(i), self.b.is_control(i) or self.b.is_unknown(i)) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if byte else b"" if none else p.replace("▁", " ").encode() for p, byte, none in pieces]
        self.a_size, self.b_size = (np.array([len(x) for x in entries], np.int64) for entries in (self.a_bytes, self.b_bytes))
        self.splits = not any(_merges(x) for x in (*self.a_bytes, *self.b_bytes))

    def encode(self, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of segments that begin with a blank: how many ids of A, of B, and groups each has; ids of A, of B; group sizes in A, in B.

        Segments whose bytes either tokenizer does not spell have none.
        """
        texts = [x.decode() for x in segments]
        first = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        second = self.b.encode([t[1:] for t in texts], out_type=int, num_threads=1)
        size = np.array([len(x) for x in segments], np.int64)
        while True:
            n_a, n_b = (np.array([len(x) for x in ids], np.int64) for ids in (first, second))
            a, b = (np.array([i for x in ids for i in x], np.int64) for ids in (first, second))
            end_a, end_b = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
            spelt_a = np.diff(np.append(0, end_a)[np.append(0, np.cumsum(n_a))])
            spelt_b = np.diff(np.append(0, end_b)[np.append(0, np.cumsum(n_b))])
            good = ((spelt_a == size) & (spelt_b == size)) | ((n_a == 0) & (n_b == 0))
            if good.all():
                want = b"".join(x for x, n in zip(segments, n_a.tolist()) if n)
                if b"".join([self.a_bytes[i] for i in a.tolist()]) == want == b"".join([self.b_bytes[i] for i in b.tolist()]):
                    break
                good = np.array([b"".join(self.a_bytes[i] for i in x) == w == b"".join(self.b_bytes[i] for i in y) for x, y, w in zip(first, second, segments)])
            first, second = ([x if ok else [] for x, ok in zip(ids, good.tolist())] for ids in (first, second))
        both = np.intersect1d(end_a, end_b, assume_unique=True)
        in_a, in_b = (np.diff(np.append(0, np.searchsorted(e, both, side="right"))) for e in (end_a, end_b))
        edge = np.append(0, np.cumsum(np.where(n_a > 0, size, 0)))
        n_groups = np.diff(np.searchsorted(both, edge, side="right"))
        return np.column_stack([n_a, n_b, n_groups]), a, b, in_a, in_b


def _merges(entry: bytes) -> bool:
    """Whether a vocabulary entry has a blank after something that is not white space."""
    at = entry.find(b" ", 1)
    while at > 0:
        if not entry[:at].decode(errors="replace")[-1].isspace():
            return True
        at = entry.find(b" ", at + 1)
    return False


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the segments of texts begin that each start with a blank: at the start, and at blanks after no white space.

    A blank that ends a text does not begin a segment.
    """
    at = np.flatnonzero(data == 0x20)
    at = at[(at > 0)]
    head = np.zeros(len(data) + 1, bool)
    head[offsets] = True
    at = at[~head[at] & ~head[at + 1]]
    space = _SPACE[data[at - 1]]
    wide = np.flatnonzero(data[at - 1] >= 0x80)
    p1, p2, p3 = (data[np.maximum(at[wide] - k, 0)] for k in (1, 2, 3))
    for middle, lead, last in _WIDE:
        space[wide] |= np.isin(p1, last) & (p2 == middle) & ((p3 == lead) if lead else True)
    begin = np.zeros(len(data) + 1, bool)
    begin[offsets[:-1][np.diff(offsets) > 0]] = True
    begin[at[~space]] = True
    return np.flatnonzero(begin)


@dataclass
class Segmented:
    """The segments of a block: the row and the distinct segment of each, and where a copy of each distinct one lies."""

    row: np.ndarray
    of: np.ndarray
    count: int
    source: list[tuple[int, int, int]]
    parts: list[np.ndarray]

    @classmethod
    def of_block(cls, block: Block, splits: bool) -> Segmented:
        rows, keys, begins, ends, part, parts = [], [_NONE], [], [], [], []
        for i, j, offsets, data in block.parts():
            full = np.diff(offsets) > 0
            text = np.insert(data, offsets[:-1][full], np.uint8(0x20))
            offsets = offsets + np.concatenate([[0], np.cumsum(full)])
            begin = cuts(text, offsets) if splits else offsets[:-1][full]
            end = np.append(begin[1:], len(text))[: len(begin)]
            rows.append(np.searchsorted(offsets, begin, side="right") - 1 + i)
            keys.append(range_hash(prefix_hash(byte_codes(text)), begin, end))
            begins.append(begin)
            ends.append(end)
            part.append(np.full(len(begin), len(parts)))
            parts.append(text)
        join = lambda x: np.concatenate([np.zeros(0, np.int64), *x])
        order, new, _ = grouped(np.concatenate(keys))
        of = np.empty(len(order), np.int64)
        of[order] = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(order))))
        first = order[new]
        source = list(zip(join(part)[first].tolist(), join(begins)[first].tolist(), join(ends)[first].tolist()))
        return cls(join(rows), of, len(new), source, parts)

    def segments(self) -> list[bytes]:
        return [self.parts[p][a:b].tobytes() for p, a, b in self.source]


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places starts[k] .. starts[k] + sizes[k] - 1 of all k, one after the other."""
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def _encoded(batches: Iterator[pa.RecordBatch], pair: Pair) -> Iterator[pa.RecordBatch]:
    """Alignments of segments that come sorted, each encoded once, as answers to the blocks that named them.

    An answer holds four numbers a segment (its place in the block, how many ids of A,
    of B, and groups) and, after one another, ids of A, ids of B, and both group sizes.
    """
    last: bytes | None = None  # the last segment, and its alignment
    known = np.zeros((1, 3), np.int64), [np.zeros(0, np.int64)] * 4
    for batch in batches:
        segments, of, new = batch.column("segment").to_pylist(), [], []
        before = last
        for s in segments:
            if s != before:
                new.append(s)
                before = s
            of.append(len(new))  # 0 is the last one before
        heads, *parts = pair.encode(new) if new else (np.zeros((0, 3), np.int64), *[np.zeros(0, np.int64)] * 4)
        heads = np.concatenate([known[0], heads])
        parts = [np.concatenate([k, x]) for k, x in zip(known[1], parts)]
        n_a, n_b, n_groups = heads.T
        # One after another: ids of A and B and both group sizes of the first segment, then of the next.
        size = n_a + n_b + 2 * n_groups
        begin = np.cumsum(size) - size
        flat = np.empty(size.sum(), np.int64)
        at = begin
        for n, x in zip((n_a, n_b, n_groups, n_groups), parts):
            flat[_ragged(at, n)] = x
            at = at + n
        last = before
        known = heads[-1:], [x[len(x) - int(n[-1]) :] for n, x in zip((n_a, n_b, n_groups, n_groups), parts)]
        block, index = batch.column("block").to_numpy(), batch.column("index").to_numpy()
        order = np.argsort(block, kind="stable")
        of_row = np.array(of, np.int64)[order]
        cut_ = np.flatnonzero(np.concatenate([[True], np.diff(block[order]) != 0])) if len(order) else order
        told = []
        for x, y in zip(cut_, np.append(cut_[1:], len(order))):
            mine = of_row[x:y]
            told.append([pack(np.column_stack([index[order[x:y]], heads[mine]]).ravel()), pack(flat[_ragged(begin[mine], size[mine])])])
        n = len(cut_)
        yield pa.RecordBatch.from_arrays(
            [pa.array(block[order[cut_]]), pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, _ALIGNED, np.int32)), pa.array(told, pa.list_(pa.binary())), pa.array([[]] * n, pa.list_(pa.float64()))],
            names=["block", "owner", "step", "told", "sums"],
        )


class Aligned:
    """A block's segments with their alignments."""

    def __init__(self, block: Block, told: dict, splits: bool) -> None:
        self.parts = parts = Segmented.of_block(block, splits)
        heads, flat = told[_ALIGNED] if _ALIGNED in told else (_NONE, _NONE)
        heads, flat = heads.astype(np.int64).reshape(-1, 4), flat.astype(np.int64)
        size = heads[:, 1] + heads[:, 2] + 2 * heads[:, 3]
        begin = np.cumsum(size) - size
        order = np.argsort(heads[:, 0], kind="stable")
        heads, begin = heads[order], begin[order]
        self.n_a, self.n_b, self.n_groups = heads[:, 1], heads[:, 2], heads[:, 3]
        self.a, self.b = flat[_ragged(begin, self.n_a)], flat[_ragged(begin + self.n_a, self.n_b)]
        after = begin + self.n_a + self.n_b
        self.in_a, self.in_b = flat[_ragged(after, self.n_groups)], flat[_ragged(after + self.n_groups, self.n_groups)]
        # Texts with a segment that has no tokens have none at all.
        self.live = np.ones(len(block.ids), bool)
        self.live[parts.row[self.n_a[parts.of] == 0]] = False
        self.live[np.diff(block.offsets) == 0] = False

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All links of the distinct segments: the segment and both ids."""
        links = self.in_a * self.in_b
        of = np.repeat(np.repeat(np.arange(self.parts.count), self.n_groups), links)
        place = _ragged(np.zeros(len(links), np.int64), links)
        wide = np.repeat(self.in_b, links)
        a = self.a[np.repeat(np.cumsum(self.in_a) - self.in_a, links) + place // np.maximum(wide, 1)]
        b = self.b[np.repeat(np.cumsum(self.in_b) - self.in_b, links) + place % np.maximum(wide, 1)]
        return of, a, b

    def groups(self) -> list[bytes]:
        """Of each distinct segment, its groups as decimal ids, each with the mark that follows it."""
        size = self.in_a + self.in_b
        begin = np.cumsum(size) - size
        ids, mark = np.empty(size.sum(), np.int64), np.full(size.sum(), ord(","), np.uint8)
        ids[_ragged(begin, self.in_a)] = self.a
        ids[_ragged(begin + self.in_a, self.in_b)] = self.b
        mark[begin + self.in_a - 1] = ord("|")
        mark[begin + size - 1] = ord(";")
        wide = np.ones(len(ids), np.int64)
        for k in range(1, 10):
            wide += ids >= 10**k
        at = np.cumsum(wide + 1) - wide - 1
        text = np.empty(int((wide + 1).sum()), np.uint8)
        text[at + wide] = mark
        for k in range(int(wide.max(initial=0))):
            has = np.flatnonzero(wide > k)
            text[at[has] + wide[has] - 1 - k] = ord("0") + ids[has] // 10**k % 10
        of_segment = np.append(at, len(text))[np.append(0, np.cumsum(self.n_a + self.n_b))]
        data, edge = text.tobytes(), of_segment.tolist()
        return [data[x:y] for x, y in zip(edge[:-1], edge[1:])]

    def of_rows(self, values: np.ndarray) -> np.ndarray:
        """Sums of the segments' values by row, zero for rows without tokens."""
        total = np.concatenate([[0], np.cumsum(values[self.parts.of])])
        edge = np.searchsorted(self.parts.row, np.arange(len(self.live) + 1))
        return np.where(self.live, total[edge[1:]] - total[edge[:-1]], 0)


def pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One key for a pair of ids (b below 65,536): all pairs of one a share their leading 48 bits."""
    return (a.astype(np.uint64) * np.uint64(0x9E3779B97F4B) << np.uint64(16)) | b.astype(np.uint64)


def _live_links(al: Aligned) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All links: segment and pair key; the distinct keys of those in texts that have tokens, and which segments these are."""
    of, a, b = al.links()
    keys = pair_keys(a, b)
    alive = np.zeros(al.parts.count, bool)
    alive[al.parts.of[al.live[al.parts.row]]] = True
    return of, keys, distinct(keys[alive[of]]), alive


def _ask(block: Block, told: dict, splits: bool) -> tuple[np.ndarray, list[np.ndarray]]:
    """The id pairs of the block and how many of its documents hold each linked."""
    al = Aligned(block, told, splits)
    of, keys, known, alive = _live_links(al)
    n, segments = max(1, len(known)), max(1, al.parts.count)
    inside = alive[of]
    pairs = distinct(of[inside] * n + look_up(keys[inside], known, np.arange(n)))  # of each segment, in its order
    edge = np.searchsorted(pairs, np.arange(segments + 1) * n)
    on = al.live[al.parts.row]
    held = distinct(al.parts.row[on] * segments + al.parts.of[on])
    row, segment = held // segments, held % segments
    many = edge[segment + 1] - edge[segment]
    docs = distinct(np.repeat(row, many) * n + pairs[_ragged(edge[segment], many)] % n)
    count = np.bincount(docs % n, minlength=n)[: len(known)]
    return known, [count.astype(np.uint64)]


def _answer(keys: np.ndarray, values: list[np.ndarray]) -> tuple[list[np.ndarray], list[float]]:
    """Twice a pair's count over all blocks, plus one where no pair of the same A id has more."""
    order, begin, known = grouped(keys)
    if not len(begin):
        return [_NONE], []
    total = np.add.reduceat(values[0][order], begin)
    first = np.flatnonzero(np.concatenate([[True], np.diff(known >> np.uint64(16)) > 0]))
    best = np.repeat(np.maximum.reduceat(total, first), np.diff(np.append(first, len(total))))
    out = np.empty(len(keys), np.uint64)
    out[order] = np.repeat(total * np.uint64(2) + (total == best), np.diff(np.append(begin, len(keys))))
    return [out], []


def _composed(block: Block, told: dict, splits: bool) -> pa.Table:
    al = Aligned(block, told, splits)
    of, keys, asked, alive = _live_links(al)
    answer = (told[_COUNTED][0] if _COUNTED in told else _NONE).astype(np.int64)
    value, inside = np.zeros(len(of), np.int64), alive[of]
    if len(asked):
        value[inside] = look_up(keys[inside], asked, answer)
    segments = max(1, al.parts.count)
    edge = np.searchsorted(of, np.arange(segments + 1))
    by_segment = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[edge])[: al.parts.count]
    shown = al.groups()
    edge_ = np.searchsorted(al.parts.row, np.arange(len(block.ids) + 1)).tolist()
    number = al.parts.of.tolist()
    groups = [b"".join([shown[k] for k in number[x:y]])[:-1] if ok else b"" for x, y, ok in zip(edge_[:-1], edge_[1:], al.live.tolist())]
    columns = {
        "n_a": al.n_a, "n_b": al.n_b, "n_groups": al.n_groups, "n_links": by_segment(np.ones(len(of), np.int64)),
        "n_best": by_segment(value & 1), "count_sum": by_segment(value >> 1),
    }
    return pa.table({"id": block.ids, **{k: pa.array(al.of_rows(v)) for k, v in columns.items()}, "groups": pa.array(groups, pa.binary()).cast(pa.string())})


def align_tokenizers(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of both tokenizers over every whole text, grouped where both end at one byte.

    A (a byte-level ``tokenizers`` file) reads a blank and the text, B (a sentencepiece
    model that adds a blank) the text; their paths must be readable on every executor.
    Returns ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups``: tokens,
    groups and links (pairs of tokens that share a group); links whose number of documents
    in the corpus is the highest of their A id, ties included; the sum of these numbers over
    all links; and the groups as ``a1,a2|b1;a3|b2,b3``.  Texts that are null or empty, or whose
    tokens of either kind do not spell the blank and the text, have none: zeros and ''.
    Rows that share an id, or have none, are documents like all others, and other columns
    play no part; an empty table gives no rows.
    """
    tuned(docs.sparkSession)
    splits = Pair(a_path, b_path).splits
    corpus = Corpus(docs, id_col, text_col, block_bytes=BLOCK)

    def named(block: Block) -> pa.Table:
        segments = Segmented.of_block(block, splits).segments()
        n = len(segments)
        return pa.table({"block": pa.array(np.full(n, block.number, np.int32)), "index": pa.array(np.arange(n, dtype=np.int32)), "segment": pa.array(segments, pa.binary())})

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _encoded(batches, Pair(a_path, b_path))

    asked = corpus.each(named, "block int, index int, segment binary")
    asked = asked.repartition(corpus.width, "segment").sortWithinPartitions("segment")
    corpus.answers = asked.mapInArrow(encode, ANSWER).repartition(corpus.width, "block")
    corpus.round(_COUNTED, lambda block, told, sums: _ask(block, told, splits), _answer)
    out = corpus.finish(lambda block, told, sums: _composed(block, told, splits), f"id {corpus.id_type}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups string")
    return out.withColumnRenamed("id", "doc_id")


def alignment_digests(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Per document: the counts of ``align_tokenizers`` and the digest of its groups."""
    out = align_tokenizers(docs, a_path, b_path)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256"))
