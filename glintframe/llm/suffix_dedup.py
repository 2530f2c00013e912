"""Suffix dedup: groups of equal suffixes, limited in depth, in three passes of fingerprints.

This finds the groups that a suffix array ordered to the depth of the window (400
bytes, or a number of words) would hold, but it does not order suffixes by the
alphabet, and its passes are not digits of the text: see the README for the figures
of a radix sort over all suffixes.  The first pass groups suffixes by their anchor,
a 200-byte gram chosen by content inside the window: suffixes that are alone with
their anchor leave at once, which are nearly all.  The second is the run of text
that an anchor's windows cover together; where all of an anchor's suffixes agree on
it they are settled as a group.  Only mixed groups go to the last pass, the window
itself.  Groups are told apart by 128 bits (anchor and run) or 96 (window and half
of its anchor), so chance does not join them at any size of corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import anchored
from .common import byte_codes, mix, range_hash, word_bounds, word_hashes
from .exchange import Block, Corpus, grouped, look_up

#: Bytes of a window.
WINDOW = 400
_NONE = np.zeros(0, np.uint64)


@dataclass(frozen=True)
class Depth:
    """How many tokens of a suffix count, and what a token is: a byte, or a word with the white space after it."""

    window: int = WINDOW
    words: bool = False

    def anchored(self, data: np.ndarray, offsets: np.ndarray):
        """What ``anchors.anchored`` gives, then the byte where each token begins, and the end."""
        if not self.words:
            return *anchored(byte_codes(data), offsets, self.window, self.window // 2), None
        starts, ends, first = word_bounds(data, offsets)
        begin = np.append(starts, len(data))
        stop = offsets[1:][np.diff(first) > 0]
        last = first[1:][np.diff(first) > 0] - 1
        end = begin[1:].copy()
        end[last] = stop
        return *anchored(word_hashes(data, starts, ends), first, self.window, self.window // 2), (starts, end)


def _anchors(block: Block, depth: Depth):
    """By chunk: rows, offsets, bytes, prefix, tokens; by anchor: first and last window start, the two digits."""
    for i, j, offsets, data in block.parts():
        at, place, grams, prefix, tokens = depth.anchored(data, offsets)
        new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (np.diff(at) != 1)])) if len(at) else np.zeros(0, np.int64)
        low, high = at[new], at[np.append(new[1:], len(at)) - 1] if len(at) else at
        yield i, j, offsets, data, tokens, prefix, low, high, mix(grams[place[new]]) if len(at) else _NONE, range_hash(prefix, low, high + depth.window) ^ mix(place[new] - low if len(at) else low)


def _pairs(block: Block, depth: Depth) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (anchor, run) pairs by anchor, and how often each occurs in the block."""
    parts = [p[-2:] for p in _anchors(block, depth)]
    anchor, run = np.concatenate([_NONE, *(p[0] for p in parts)]), np.concatenate([_NONE, *(p[1] for p in parts)])
    order = np.lexsort((run, anchor))
    anchor, run = anchor[order], run[order]
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (run[1:] != run[:-1])])) if len(anchor) else np.zeros(0, np.int64)
    return anchor[new], run[new], np.diff(np.append(new, len(anchor)))


def _ask_anchors(block: Block, depth: Depth) -> tuple[np.ndarray, list[np.ndarray]]:
    anchor, run, count = _pairs(block, depth)
    return anchor, [run, (count > 1).astype(np.uint64)]


def _answer_anchors(keys: np.ndarray, values: list[np.ndarray]) -> tuple[list[np.ndarray], list[float]]:
    """For each (anchor, run): 1 where the run repeats, plus 2 where its windows must be sent.

    Windows are sent for anchors with several runs; a run that repeats is sent by one block only.
    """
    run, many = values
    order = np.lexsort((run, keys))
    begin = np.flatnonzero(np.concatenate([[True], (np.diff(keys[order]) > 0) | (run[order][1:] != run[order][:-1])])[: len(keys)])
    size = np.diff(np.append(begin, len(keys)))
    repeats = np.zeros(len(keys), bool)
    repeats[order] = np.repeat((size > 1) | (np.maximum.reduceat(many[order], begin) > 0), size) if len(begin) else False
    lead = np.zeros(len(keys), bool)
    lead[order[begin]] = True
    _, inverse, runs = np.unique(keys, return_inverse=True, return_counts=True)
    mixed = np.bincount(inverse, lead, len(runs))[inverse] > 1
    return [repeats + 2 * (mixed & lead).astype(np.uint64)], []


def _settled(block: Block, told: dict, depth: Depth):
    """As ``_anchors``, with each anchor's first digit and its answer."""
    anchor, run, _ = _pairs(block, depth)
    pair = mix(anchor ^ mix(run))
    order = np.argsort(pair)
    pair, answer = pair[order], (told[1][0] if 1 in told else _NONE)[order]
    for *head, a, r in _anchors(block, depth):
        yield *head, a, look_up(mix(a ^ mix(r)), pair, answer)


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All starts from low to high of each range, and the range of each."""
    size = high - low + 1
    owner = np.repeat(np.arange(len(low)), size)
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + low[owner], owner


def _ask_windows(block: Block, told: dict, depth: Depth) -> tuple[np.ndarray, list[np.ndarray]]:
    keys, counts, checks, led = [_NONE], [np.zeros(0, np.int64)], [_NONE], set()
    for *_, prefix, low, high, anchor, answer in _settled(block, told, depth):
        pick = np.flatnonzero(answer >= 2)
        if not len(pick):
            continue
        whole = range_hash(prefix, low[pick], high[pick] + depth.window)
        first = np.array([int(w) not in led for w in whole]) & (np.isin(np.arange(len(whole)), np.unique(whole, return_index=True)[1]))
        led.update(map(int, whole))
        pick = pick[first]  # a run that the block holds several times is sent once, as repeated
        start, owner = _spread(low[pick], high[pick])
        keys.append(range_hash(prefix, start, start + depth.window))
        counts.append((1 + (answer[pick] & np.uint64(1)).astype(np.int64))[owner])
        checks.append((anchor[pick] >> np.uint64(32))[owner])
    order, begin, distinct = grouped(np.concatenate(keys))
    if not len(begin):
        return distinct, [_NONE, _NONE]
    count = np.add.reduceat(np.concatenate(counts)[order], begin)
    return distinct, [(count > 1).astype(np.uint64), np.concatenate(checks)[order[begin]]]


def _answer_windows(keys: np.ndarray, values: list[np.ndarray]) -> tuple[list[np.ndarray], list[float]]:
    many, check = values  # a window is the same where its digit and 32 bits of its anchor's are
    order = np.lexsort((check, keys))
    new = np.concatenate([[True], (np.diff(keys[order]) > 0) | (check[order][1:] != check[order][:-1])])[: len(keys)]
    begin, out = np.flatnonzero(new), np.zeros(len(keys), np.uint64)
    if len(begin):
        out[order] = np.repeat(np.add.reduceat(1 + many[order], begin) > 1, np.diff(np.append(begin, len(keys))))
    return [out], []


def _apply(block: Block, told: dict, depth: Depth) -> pa.Table:
    keys = _ask_windows(block, told, depth)[0]
    repeated = keys[(told[2][0] if 2 in told else _NONE) > 0]
    out: list[list] = [[], [], [], []]
    for i, j, offsets, data, tokens, prefix, low, high, _, answer in _settled(block, told, depth):
        # Windows of repeated runs all repeat; those sent alone do where their own digit does.
        cover = np.zeros(len(prefix), np.int64)
        done = (answer & np.uint64(1)) > 0
        np.add.at(cover, low[done], 1)
        np.add.at(cover, high[done] + depth.window, -1)
        open_ = np.flatnonzero((answer >= 2) & ~done)
        if len(open_) and len(repeated):
            start, _ = _spread(low[open_], high[open_])
            key = range_hash(prefix, start, start + depth.window)
            start = start[repeated[np.minimum(np.searchsorted(repeated, key), len(repeated) - 1)] == key]
            np.add.at(cover, start, 1)
            np.add.at(cover, start + depth.window, -1)
        gone = np.cumsum(cover)[:-1] > 0
        if tokens:
            mask = np.zeros(len(data) + 1, np.int32)
            np.add.at(mask, tokens[0][gone], 1)
            np.add.at(mask, tokens[1][gone], -1)
            gone = np.cumsum(mask)[:-1] > 0
        head = np.zeros(len(data), bool)
        head[offsets[:-1][offsets[:-1] < len(data)]] = True
        begins = gone & np.concatenate([[True], ~gone[:-1]])[: len(gone)] | gone & head
        ends = np.flatnonzero(gone & np.concatenate([(~gone | head)[1:], [True]])[: len(gone)]) + 1
        begins = np.flatnonzero(begins)
        size = np.diff(offsets)
        kept = np.concatenate([[0], np.cumsum(~gone)])[offsets]
        cut = np.searchsorted(begins, offsets)
        spans = [[{"start": int(a), "bytes": int(b - a)} for a, b in zip(begins[x:y] - o, ends[x:y] - o)] for x, y, o in zip(cut[:-1], cut[1:], offsets[:-1])]
        out[0].append(pa.array(size))
        out[1].append(pa.array(size - np.diff(kept)))
        out[2].append(pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("bytes", pa.int64())]))))
        out[3].append(pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(kept.astype(np.int32)), pa.py_buffer(data[~gone])]))
    return pa.table([block.ids, pa.array(block.more), *(pa.concat_arrays(c) for c in out)], names=["id", "more", "n_bytes", "n_removed", "spans", "kept"])


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, words: bool = False) -> DataFrame:
    """Remove every byte under a string of ``window`` tokens that starts anywhere else too.

    Tokens are bytes, or with ``words`` runs other than ASCII white space, which are
    removed with the white space after them.  Returns ``doc_id, n_bytes, n_removed,
    spans, kept``: the maximal removed runs and the remaining bytes (cut characters
    are possible, so they are binary).  A null text counts as empty; matches never
    cross rows, and rows that share an id, or have none, are rows like all others.
    """
    depth = Depth(window, words)
    corpus = Corpus(docs, id_col, text_col)
    corpus.round(1, lambda block, told, sums: _ask_anchors(block, depth), _answer_anchors)
    corpus.round(2, lambda block, told, sums: _ask_windows(block, told, depth), _answer_windows)
    out = corpus.finish(lambda block, told, sums: _apply(block, told, depth), f"id {corpus.id_type}, more int, n_bytes bigint, n_removed bigint, spans array<struct<start:bigint,bytes:bigint>>, kept binary")
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "spans", "kept")


def suffix_digests(docs: DataFrame) -> DataFrame:
    """Per document: bytes, removed bytes, removed runs and the digest of the rest."""
    return suffix_dedup(docs).select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
