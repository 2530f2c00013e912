"""Quality by a generalised additive model with pairwise interactions.

Learning is cyclic boosting: round after round, each feature in turn gets a
shallow tree on its binned values, whose leaves are added to the feature's lookup
table; then the feature pairs with the largest remaining gain get two-way
tables the same way.  A score is the logistic function of the sum of looked-up
values, so scoring is binning and vectorised additions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, held_out, lower_ascii, tuned, utf8_buffers, window_hashes, word_bounds, word_hashes

#: Labelled documents that a model learns from, at most (those of smallest id hash).
MAX_LABELLED = 20_000

FEATURES = ("log_bytes", "upper", "symbols", "exclaims", "bars", "digits", "blanks", "stops", "non_ascii", "word_bytes", "log_words", "distinct_words", "distinct_triples", "distinct_lines", "marked_words")


def _set(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_UPPER, _LETTER = _set("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_SYMBOL, _EXCLAIM, _BAR, _DIGIT, _STOP = _set("#$%&*+<=>@\\^_`{}~/"), _set("!"), _set("|"), _set("0123456789"), _set(".,;:?")
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_PLAIN = _LETTER.copy()
_PLAIN[128:] = True
_ODD_END = ~(_PLAIN | _STOP | _DIGIT | _BLANK | _set("\"')-"))


def _distinct(owner: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Different hashes (to 40 bits) by owner."""
    if n > 1 << 24:
        raise ValueError("too many documents in one chunk")
    key = np.sort(owner.astype(np.uint64) << np.uint64(40) | hashes >> np.uint64(24))
    new = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    return np.bincount((new >> np.uint64(40)).astype(np.int64), minlength=n)


def _features(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    size = np.diff(offsets)
    starts, ends, first = word_bounds(data, offsets)
    words = np.diff(first)

    seen = np.bincount(np.repeat(np.arange(n) * 256, size) + data, minlength=n * 256).reshape(n, 256)

    def share(table: np.ndarray, of: np.ndarray) -> np.ndarray:
        return seen[:, table].sum(1) / np.maximum(of, 1)

    letters = share(_LETTER, np.ones(n))
    out = np.empty((n, len(FEATURES)))
    out[:, 0] = np.log1p(size)
    out[:, 1] = share(_UPPER, letters)
    for k, table in enumerate((_SYMBOL, _EXCLAIM, _BAR, _DIGIT, _BLANK, _STOP), 2):
        out[:, k] = share(table, size)
    out[:, 8] = share(np.arange(256) > 127, size)
    out[:, 9] = (size - share(_BLANK, np.ones(n))) / np.maximum(words, 1)
    out[:, 10] = np.log1p(words)
    owner = np.repeat(np.arange(n), words)
    codes = word_hashes(lower_ascii(data), starts, ends)
    out[:, 11] = _distinct(owner, codes, n) / np.maximum(words, 1)
    at, triples = window_hashes(codes, first, 3)
    out[:, 12] = _distinct(owner[at], triples, n) / np.maximum(words - 2, 1)
    out[:, 12][words < 3] = 1
    breaks = np.flatnonzero(data == 10)
    line_start = np.union1d(breaks + 1, offsets[:-1])
    line_start = line_start[line_start < len(data)]
    line_end = np.append(line_start[1:], len(data))
    line_owner = np.searchsorted(offsets, line_start, side="right") - 1
    lines = np.bincount(line_owner, minlength=n)
    out[:, 13] = _distinct(line_owner, word_hashes(data, line_start, line_end), n) / np.maximum(lines, 1)
    odd = _ODD_END[data[ends - 1]] if len(ends) else np.zeros(0, bool)
    out[:, 14] = np.bincount(owner, weights=odd, minlength=n) / np.maximum(words, 1)
    return out


def text_features(column: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` for each text; a null text counts as empty."""
    offsets, data = utf8_buffers(column)
    parts = [_features(offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]]) for i, j in chunks(np.diff(offsets))]
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


@dataclass
class Gam:
    """Bin edges and lookup tables; pairs use the coarse edges."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def logit(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for k, (edges, table) in enumerate(zip(self.edges, self.tables)):
            total += table[np.searchsorted(edges, x[:, k], side="right")]
        for (i, j), table in zip(self.pairs, self.pair_tables):
            total += table[np.searchsorted(self.coarse[i], x[:, i], side="right"), np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


_DAMP = 1.0


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + _DAMP)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """A best-first tree over ordered bins: the step of every bin, from gradients and curvatures."""
    parts, cg, ch = [(0, len(g))], np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    while len(parts) < leaves:
        best = (1e-9, None, 0)
        for a, b in parts:
            if b - a > 1:
                at = np.arange(a + 1, b)
                win = _gain(cg[at] - cg[a], ch[at] - ch[a]) + _gain(cg[b] - cg[at], ch[b] - ch[at]) - _gain(cg[b] - cg[a], ch[b] - ch[a])
                k = int(win.argmax())
                if win[k] > best[0]:
                    best = (win[k], (a, b), int(at[k]))
        if best[1] is None:
            break
        a, b = best[1]
        parts.remove((a, b))
        parts += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + _DAMP)
    return out


def _cross(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of a two-way histogram on both axes: its gain over none, and the step of every cell."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    tg, th = cg[-1, -1], ch[-1, -1]
    a, b = cg[:-1, :-1], ch[:-1, :-1]
    quads = [(a, b), (cg[:-1, -1:] - a, ch[:-1, -1:] - b), (cg[-1:, :-1] - a, ch[-1:, :-1] - b)]
    quads.append((tg - sum(q[0] for q in quads), th - sum(q[1] for q in quads)))
    win = sum(_gain(*q) for q in quads) - _gain(tg, th)
    i, j = np.unravel_index(int(win.argmax()), win.shape)
    out = np.empty_like(g)
    for (qg, qh), rows, cols in zip(quads, (slice(0, i + 1), slice(0, i + 1), slice(i + 1, None), slice(i + 1, None)), (slice(0, j + 1), slice(j + 1, None), slice(0, j + 1), slice(j + 1, None))):
        out[rows, cols] = qg[i, j] / (qh[i, j] + _DAMP)
    return float(win[i, j]), out


def fit_gam(x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.1, bins: int = 48, coarse: int = 10, pairs: int = 6, leaves: int = 3) -> Gam:
    """Learn from features and 0/1 labels; without both labels the model is a constant."""
    if not len(y):
        return Gam()
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = Gam(intercept=float(np.log(share / (1 - share))))
    if y.min() == y.max():
        return model
    quantiles = lambda v, n: np.unique(np.quantile(v, np.linspace(0, 1, n + 1)[1:-1]))
    model.edges = [quantiles(x[:, k], bins) for k in range(x.shape[1])]
    model.coarse = [quantiles(x[:, k], coarse) for k in range(x.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    at = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(model.edges)]
    rough = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(model.coarse)]
    f = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-f))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for k, b in enumerate(at):
            g, h = slopes()
            n = len(model.tables[k])
            step = rate * _tree(np.bincount(b, g, n), np.bincount(b, h, n), leaves)
            model.tables[k] += step
            f += step[b]

    def histogram(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shape = (len(model.coarse[i]) + 1, len(model.coarse[j]) + 1)
        cell = rough[i] * shape[1] + rough[j]
        g, h = slopes()
        return cell, np.bincount(cell, g, shape[0] * shape[1]).reshape(shape), np.bincount(cell, h, shape[0] * shape[1]).reshape(shape)

    found = []
    for i in range(x.shape[1]):
        for j in range(i):
            if len(model.coarse[i]) and len(model.coarse[j]):
                found.append((_cross(*histogram(i, j)[1:])[0], i, j))
    model.pairs = [(i, j) for _, i, j in sorted(found, reverse=True)[:pairs]]
    model.pair_tables = [np.zeros((len(model.coarse[i]) + 1, len(model.coarse[j]) + 1)) for i, j in model.pairs]
    for _ in range(rounds // 3):
        for k, (i, j) in enumerate(model.pairs):
            cell, g, h = histogram(i, j)
            step = rate * _cross(g, h)[1]
            model.pair_tables[k] += step
            f += step.ravel()[cell]
    return model


def train_quality(docs: DataFrame, labels: DataFrame, target: str = "quality", modulus: int = 5, remainder: int = 0, max_labelled: int = MAX_LABELLED) -> Gam:
    """Learn ``target`` (0 or 1) from the labelled documents outside the held-out fold.

    At most ``max_labelled`` labels are used, those of smallest id hash, whether or not a
    document has their id, and of the documents with these ids at most twice as many rows
    (ids may repeat), again by hash: both bound the sample that one model is fitted on.
    Several labels of one id count by majority (a tie as 1); labels other than 0
    and 1 and null ids are ignored.  Only text features are inputs.
    """
    tuned(docs.sparkSession)
    order = F.xxhash64("__id")
    chosen = (
        labels.select(F.col("doc_id").alias("__id"), F.col(target).cast("int").alias("__y"))
        .where(F.col("__id").isNotNull() & F.col("__y").isin(0, 1) & ~held_out(F.col("__id"), modulus, remainder))
        .orderBy(order, "__id", "__y").limit(max_labelled)
        .groupBy("__id").agg((F.avg("__y") >= 0.5).cast("int").alias("__y"))
    )
    # max_labelled ids bound what is broadcast
    rows = docs.select(F.col("doc_id").alias("__id"), F.col("text").alias("__text")).join(F.broadcast(chosen), "__id").select("__text", "__y", order.alias("__h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = text_features(b.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), b.column(1), b.column(2)], names=["x", "y", "h"])

    got = rows.mapInArrow(run, "x array<double>, y int, h bigint").orderBy("h", "y", "x").limit(2 * max_labelled).toArrow()
    if not got.num_rows:
        return Gam()
    return fit_gam(np.array(got.column("x").to_pylist()), np.array(got.column("y").to_pylist(), float))


def with_quality(docs: DataFrame, model: Gam, text_col: str = "text", out: str = "quality_score") -> DataFrame:
    """``docs`` with a column ``out``: the probability of label 1, from the whole text.

    Every input row and column stays.  A null text scores as an empty one.
    Columns of ``docs`` that are called ``out`` are replaced.
    """
    tuned(docs.sparkSession)
    docs = docs.drop(out) if out in docs.columns else docs
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.score(text_features(b.column(at))))], names=[*b.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))


#: A document scoring below this is rejected.
THRESHOLD = 0.3


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: the fold, the score and the decision."""
    rows = docs.select("doc_id", "text")
    return with_quality(rows, train_quality(rows, labels), out="score").select(
        "doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
