"""Substring dedup by relative Lempel-Ziv parsing.

The reference of a document is every document with a smaller id.  References are
indexed by their windows of 13 words: each with the smallest id that holds it and
its place there.  A document is parsed greedily: a factor starts at a window that
the index holds, and grows while the reference goes on word by word as the document
does.  Factors of 13 words and more are duplicate spans.  Where a factor ends, the
windows over the boundary are looked up as well, so a match that another reference
holds across it gives a factor that overlaps.  Removed are the words of the factors.

The index holds one reference for each window, so a factor is the longest match
with the first document that holds its windows, and not with any document; the words
covered are the same, as every window of a longer match is in the index too.
Windows whose anchor occurs in one document only cannot repeat and are never sent.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import anchored
from .common import mix, range_hash, word_bounds, word_hashes
from .exchange import Block, Corpus, grouped

WINDOW, GRAM = 13, 5
_SIGN = np.uint64(1 << 63)
SPANS = "spans array<struct<start:bigint,words:bigint,reference:bigint,place:bigint>>"
_NONE = np.zeros(0, np.uint64)


def _ordinal(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids as unsigned integers of the same order, and which are not null."""
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    return ids.fill_null(0).to_numpy().astype(np.int64).view(np.uint64) ^ _SIGN, known


def _windows(block: Block):
    """By chunk: rows, bytes, word bounds, first words, window starts, anchor places and keys, prefix."""
    for i, j, offsets, data in block.parts():
        starts, ends, first = word_bounds(data, offsets)
        codes = word_hashes(data, starts, ends)
        at, place, grams, prefix = anchored(codes, first, WINDOW, GRAM)
        owner = np.searchsorted(first, at, side="right") - 1 + i
        yield i, j, offsets, data, starts, ends, first, at, place, grams, prefix, owner


def _anchor_pairs(block: Block) -> tuple[np.ndarray, np.ndarray]:
    ids, known = _ordinal(block.ids)
    keys, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for *_, at, place, grams, prefix, owner in _windows(block):
        new = np.concatenate([[True], (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])]) & known[owner] if len(at) else np.zeros(0, bool)
        keys.append(mix(grams[place[new]]))
        docs.append(ids[owner[new]])
    return np.concatenate(keys), np.concatenate(docs)


def _ask_anchors(block: Block, told: dict, sums: dict) -> tuple[np.ndarray, list[np.ndarray]]:
    keys, docs = _anchor_pairs(block)
    order, begin, distinct = grouped(keys)
    if not len(begin):
        return distinct, [np.zeros(0, np.uint64)]
    ranked = docs[order]
    return distinct, [(np.minimum.reduceat(ranked, begin) != np.maximum.reduceat(ranked, begin)).astype(np.uint64)]


def _answer_anchors(keys: np.ndarray, values: list[np.ndarray]) -> tuple[list[np.ndarray], list[float]]:
    """May the anchor occur in several documents?  Two blocks count as two, though rows that share an id lie in several."""
    _, inverse, count = np.unique(keys, return_inverse=True, return_counts=True)
    several = count + np.bincount(inverse, values[0], len(count)) > 1
    return [several[inverse].astype(np.uint64)], []


def _shared_windows(block: Block, told: dict):
    """As ``_windows``, with the windows whose anchor several documents hold: start, place in the document, key, anchor, document."""
    keys, _ = _anchor_pairs(block)
    distinct, shared = np.unique(keys), told[1][0] if 1 in told else np.zeros(0, np.uint64)
    known = _ordinal(block.ids)[1]
    distinct = distinct[shared > 0]
    for i, *head, at, place, grams, prefix, owner in _windows(block):
        head = [i, *head]
        anchor = grams[place] if len(at) else np.zeros(0, np.uint64)
        found = np.zeros(len(at), bool)
        if len(distinct) and len(at):
            new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
            x = mix(anchor[new])
            k = np.minimum(np.searchsorted(distinct, x), len(distinct) - 1)
            found = np.repeat(distinct[k] == x, np.diff(np.append(new, len(at))))
            found &= known[owner]
        own = owner[found]
        yield *head, at[found], (at[found] - head[-1][own - i]).astype(np.uint64), range_hash(prefix, at[found], at[found] + WINDOW), mix(anchor[found]), own


def _ask_windows(block: Block, told: dict, sums: dict) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of each window: the smallest id here that holds it, where it first stands in that document, a check."""
    ids, _ = _ordinal(block.ids)
    keys, docs, places, checks = [_NONE], [_NONE], [_NONE], [_NONE]
    for *_, place, key, anchor, owner in _shared_windows(block, told):
        keys.append(key)
        docs.append(ids[owner])
        places.append(place)
        checks.append(anchor >> np.uint64(32))
    keys, docs, places, checks = map(np.concatenate, (keys, docs, places, checks))
    order, begin, distinct = grouped(keys)
    if not len(begin):
        return distinct, [_NONE] * 3
    low, place = _first_place(docs[order], places[order], begin)
    return distinct, [low, place, checks[order[begin]]]


def _first_place(docs: np.ndarray, places: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each run of rows: the smallest id, and the smallest place with that id."""
    low = np.minimum.reduceat(docs, begin)
    own = docs == np.repeat(low, np.diff(np.append(begin, len(docs))))
    return low, np.minimum.reduceat(np.where(own, places, ~np.uint64(0)), begin)


def _answer_windows(keys: np.ndarray, values: list[np.ndarray]) -> tuple[list[np.ndarray], list[float]]:
    docs, places, checks = values
    order = np.lexsort((checks, keys))
    begin = np.flatnonzero(np.concatenate([[True], (np.diff(keys[order]) > 0) | (checks[order][1:] != checks[order][:-1])])[: len(keys)])
    out = [np.zeros(len(keys), np.uint64), np.zeros(len(keys), np.uint64)]
    if len(begin):
        size = np.diff(np.append(begin, len(keys)))
        for to, v in zip(out, _first_place(docs[order], places[order], begin)):
            to[order] = np.repeat(v, size)
    return out, []


def factors(at: np.ndarray, reference: np.ndarray, place: np.ndarray) -> list[dict]:
    """The greedy parse of one document: from its windows that a reference holds (start, id and place there), the factors.

    A factor starts at the first window that no factor before it holds whole, and grows
    word by word while the reference goes on there as the document does.  The windows
    over the boundary of two factors are windows like others, so what they cover starts
    a factor of its own, which overlaps.
    """
    if not len(at):
        return []
    new = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (reference[1:] != reference[:-1]) | (np.diff(place) != 1)]))
    last = np.append(new[1:], len(at)) - 1
    return [{"start": int(a), "words": int(b - a + WINDOW), "reference": int(r), "place": int(p)} for a, b, r, p in zip(at[new], at[last], reference[new], place[new])]


def _apply(block: Block, told: dict, sums: dict) -> pa.Table:
    ids, _ = _ordinal(block.ids)
    parts = list(_shared_windows(block, told))
    keys = np.unique(np.concatenate([_NONE, *(p[-3] for p in parts)]))
    low, place_of = told[2] if 2 in told else (_NONE, _NONE)
    out: list[list] = [[], [], [], []]
    for i, j, offsets, data, starts, ends, first, at, _, key, _, owner in parts:
        index = np.searchsorted(keys, key)
        reference, place = low[index], place_of[index].astype(np.int64)
        hit = reference < ids[owner]
        at, reference, place, owner = at[hit], (reference[hit] ^ _SIGN).view(np.int64), place[hit], owner[hit]
        cut = np.searchsorted(owner, np.arange(i, j + 1))
        parsed = [factors(at[a:b] - first[k], reference[a:b], place[a:b]) for k, (a, b) in enumerate(zip(cut[:-1], cut[1:]))]
        # Removed are the words of the factors.
        cover = np.zeros(len(starts) + 1, np.int64)
        spans = np.array([(first[k] + f["start"], f["words"]) for k, fs in enumerate(parsed) for f in fs], np.int64).reshape(-1, 2)
        np.add.at(cover, spans[:, 0], 1)
        np.add.at(cover, spans.sum(1), -1)
        kept = np.cumsum(cover)[:-1] == 0
        n_kept = np.concatenate([[0], np.cumsum(kept)])[first]
        words = np.diff(first)
        # A kept word that is not the last kept one of its document is followed by one space.
        index = np.flatnonzero(kept)
        mask = np.zeros(len(data) + 1, np.int8)
        np.add.at(mask, starts[index], 1)
        np.add.at(mask, ends[index], -1)
        mask = np.cumsum(mask[:-1]).astype(bool)
        final = n_kept[1:][np.diff(n_kept) > 0] - 1
        inner = np.ones(len(index), bool)
        inner[final] = False
        body = data.copy()
        body[ends[index[inner]]] = 0x20
        mask[ends[index[inner]]] = True
        size = np.concatenate([[0], np.cumsum(mask)])[offsets].astype(np.int32)
        body = body[mask]
        out[0].append(pa.array(words))
        out[1].append(pa.array(words - np.diff(n_kept)))
        out[2].append(pa.array(parsed, pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "words", "reference", "place")]))))
        out[3].append(pa.Array.from_buffers(pa.string(), j - i, [None, pa.py_buffer(size), pa.py_buffer(body)]))
    return pa.table([block.ids, *(pa.concat_arrays(c) for c in out)], names=["doc_id", "n_words", "n_removed", "spans", "kept"])


def rlz_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every word under a 13-word window that also starts in a document of smaller id.

    Words are runs of bytes other than ASCII white space.  Returns ``doc_id,
    n_words, n_removed, spans, kept``: the factors with their reference and the place
    there, and the kept words joined by one space.  A null text has no words.  A row with
    a null id is kept whole and is no reference; rows that share an id are not
    references of each other (and place is the first in any of them).  Windows are
    compared by fingerprints of 64 bits and 32 bits of their anchor's.
    """
    corpus = Corpus(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")))
    corpus.round(1, _ask_anchors, _answer_anchors)
    corpus.round(2, _ask_windows, _answer_windows)
    return corpus.finish(_apply, f"doc_id bigint, n_words bigint, n_removed bigint, {SPANS}, kept string")


def rlz_digests(docs: DataFrame) -> DataFrame:
    """Per document: words, removed words and the digest of the kept ones."""
    return rlz_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


RLZ_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 11)) AS i, ws FROM w WHERE len(ws) >= 13),
h AS (SELECT doc_id, i, md5_number(array_to_string(ws[i:i + 12], ' ')) AS k FROM g),
m AS (SELECT k, min(doc_id) AS first FROM h GROUP BY k),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM h JOIN m USING (k) WHERE first < doc_id),
gone AS (SELECT doc_id, list(p) AS ps FROM r GROUP BY doc_id),
t AS (SELECT w.doc_id, ws, ps, (SELECT count(*) FROM r WHERE r.doc_id = w.doc_id) AS n FROM w LEFT JOIN gone ON gone.doc_id = w.doc_id),
words AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS s FROM words ANTI JOIN r USING (doc_id, p) GROUP BY doc_id)
SELECT t.doc_id, len(ws)::BIGINT AS n_words, n::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM t LEFT JOIN kept USING (doc_id)"""
