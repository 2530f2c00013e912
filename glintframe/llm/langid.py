"""Language identification by a byte convolutional network.

Bytes are embedded, filters of several widths slide over fixed-length windows,
each filter keeps its maximum over the window, and a softmax over the learned
languages follows.  The network is trained in numpy on a bounded sample of
labelled text and applied to every window of every whole text; a document's
probabilities are the length-weighted geometric mean over its windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, held_out, tuned, utf8_buffers

#: Bytes of one window.
WINDOW = 256
#: Labelled documents that a model learns from; with more languages than that, one of each.
MAX_LABELLED = 4_000
#: Windows of one document that training may use.
WINDOWS_PER_DOC = 4
WIDTHS = (2, 3, 4)

_LETTER = regex.compile(r"\p{L}").search


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut each text into windows: zero-padded rows, their owner, their number of bytes."""
    size = np.diff(offsets)
    count = -(-size // WINDOW)
    owner = np.repeat(np.arange(len(size)), count)
    index = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[:-1][owner] + index * WINDOW
    length = np.minimum(WINDOW, offsets[1:][owner] - start)
    padded = np.concatenate([data, np.zeros(WINDOW, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[start].copy() if len(start) else np.zeros((0, WINDOW), np.uint8)
    rows[np.arange(WINDOW) >= length[:, None]] = 0
    return rows, owner, length


@dataclass
class ByteCnn:
    """Parameters by name; ``classes`` are the learned languages in order."""

    classes: list[str] = field(default_factory=list)
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def fresh(classes: list[str], dim: int = 8, filters: int = 12, seed: int = 7) -> ByteCnn:
        r = np.random.default_rng(seed)
        w = {"embed": r.normal(0, 0.5, (256, dim))}
        for k in WIDTHS:
            w[f"filter{k}"] = r.normal(0, 1 / np.sqrt(k * dim), (k * dim, filters))
            w[f"bias{k}"] = np.zeros(filters)
        w["dense"] = r.normal(0, 0.1, (filters * len(WIDTHS), len(classes)))
        w["out"] = np.zeros(len(classes))
        return ByteCnn(classes, {k: v.astype(np.float32) for k, v in w.items()})

    def _unfold(self, rows: np.ndarray, k: int) -> np.ndarray:
        e = self.weights["embed"][rows]
        n, length, dim = e.shape
        view = np.lib.stride_tricks.sliding_window_view(e, k, axis=1)  # n, length-k+1, dim, k
        return view.transpose(0, 1, 3, 2).reshape(n, length - k + 1, k * dim)

    def train(self, rows: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 4e-3, seed: int = 3) -> ByteCnn:
        """Adam on the cross entropy; gradients run through max pooling to the byte embedding."""
        r, w = np.random.default_rng(seed), self.weights
        m, v, t = {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}, 0
        dim = w["embed"].shape[1]
        for _ in range(epochs):
            order = r.permutation(len(y))
            for i in range(0, len(order), batch):
                pick = order[i : i + batch]
                x, n = rows[pick], len(pick)
                pooled, kept = [], []
                for k in WIDTHS:
                    u = self._unfold(x, k)
                    z = u @ w[f"filter{k}"] + w[f"bias{k}"]
                    best = z.argmax(1)
                    top = np.take_along_axis(z, best[:, None], 1)[:, 0]
                    pooled.append(np.maximum(top, 0))
                    kept.append((u, best, top > 0))
                h = np.concatenate(pooled, 1)
                p = _softmax(h @ w["dense"] + w["out"])
                p[np.arange(n), y[pick]] -= 1
                p /= n
                grad = {"dense": h.T @ p, "out": p.sum(0), "embed": np.zeros_like(w["embed"])}
                back = p @ w["dense"].T
                width = len(w["bias2"])
                for j, k in enumerate(WIDTHS):
                    u, best, on = kept[j]
                    d = back[:, j * width : (j + 1) * width] * on
                    at = u[np.arange(n)[:, None], best]  # n, filters, k*dim
                    grad[f"filter{k}"] = np.einsum("nfd,nf->df", at, d)
                    grad[f"bias{k}"] = d.sum(0)
                    into = d[:, :, None] * w[f"filter{k}"].T[None]  # n, filters, k*dim
                    for s in range(k):
                        np.add.at(grad["embed"], x[np.arange(n)[:, None], best + s], into[:, :, s * dim : (s + 1) * dim])
                t += 1
                for name, g in grad.items():
                    m[name] += 0.1 * (g - m[name])
                    v[name] += 0.001 * (g * g - v[name])
                    w[name] -= rate * (m[name] / (1 - 0.9**t)) / (np.sqrt(v[name] / (1 - 0.999**t)) + 1e-8)
        return self

    def tables(self) -> dict[int, list[np.ndarray]]:
        """Filter responses of all byte pairs (and single bytes), which add up to any width."""
        w, dim = self.weights, self.weights["embed"].shape[1]
        one = lambda k, s: w["embed"] @ w[f"filter{k}"][s * dim : (s + 1) * dim]
        pair = lambda k, s: (one(k, s)[:, None] + one(k, s + 1)[None]).reshape(65536, -1).astype(np.float32)
        return {k: [pair(k, s) for s in range(0, k - 1, 2)] + ([one(k, k - 1).astype(np.float32)] if k % 2 else []) for k in WIDTHS}

    def log_probabilities(self, rows: np.ndarray, tables: dict[int, list[np.ndarray]], batch: int = 64) -> np.ndarray:
        w, out = self.weights, []
        for i in range(0, len(rows), batch):
            x = rows[i : i + batch].astype(np.intp)
            pairs, pooled = x[:, :-1] * 256 + x[:, 1:], []
            for k in WIDTHS:
                last = WINDOW - k + 1
                z = None
                for s, table in enumerate(tables[k]):
                    index = pairs[:, 2 * s : 2 * s + last] if len(table) > 256 else x[:, 2 * s : 2 * s + last]
                    part = table.take(index, axis=0)
                    z = part if z is None else np.add(z, part, out=z)
                pooled.append(np.maximum(z.max(1) + w[f"bias{k}"], 0))
            out.append(np.log(_softmax(np.concatenate(pooled, 1) @ w["dense"] + w["out"]) + 1e-12))
        return np.concatenate(out) if out else np.zeros((0, len(self.classes)), np.float32)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train_langid(docs: DataFrame, modulus: int = 3, remainder: int = 1, max_labelled: int = MAX_LABELLED) -> ByteCnn:
    """Learn from documents with a language outside the held-out fold.

    Every language present is learned.  At most ``max_labelled`` documents are used
    (but one of each language at least), dealt evenly over the languages, each with
    up to ``WINDOWS_PER_DOC`` windows from even places of its text.
    """
    tuned(docs.sparkSession)
    rows = docs.select(F.col("text").alias("__text"), F.col("lang").cast("string").alias("__lang"), F.col("doc_id").alias("__id"))
    rows = rows.where(F.col("__lang").isNotNull() & F.col("__text").rlike(r"\p{L}") & ~held_out(F.col("__id"), modulus, remainder))
    counts = {r["__lang"]: r["count"] for r in rows.groupBy("__lang").count().collect()}
    langs = sorted(counts)
    if not langs:
        return ByteCnn()
    each = max(1, max_labelled // len(langs))
    size = F.greatest(F.length("__text") - WINDOW, F.lit(0))
    pieces = F.array(*[F.substring(F.col("__text"), (1 + size * F.lit(i) / (WINDOWS_PER_DOC - 1)).cast("int"), F.lit(WINDOW)) for i in range(WINDOWS_PER_DOC)])
    # The pieces are cut before the top-k, which then holds a kilobyte a row, whatever the text's length.
    cut = rows.select("__lang", F.array_distinct(pieces).alias("__p"), F.xxhash64("__id", "__text").alias("__h"))
    # Of a language, rows of small hash: of many, a share by the hash's other bits before the top-k, which then meets a few thousand rows.
    share = docs.sparkSession.createDataFrame([(x, min(1.0, 8 * each / counts[x])) for x in langs], "__lang string, __share double")
    cut = cut.join(F.broadcast(share), "__lang").where(F.pmod(F.xxhash64("__h"), F.lit(1 << 30)) < F.col("__share") * (1 << 30))
    first = cut.withColumn("__r", F.row_number().over(Window.partitionBy("__lang").orderBy("__h", "__p"))).where(F.col("__r") <= each)
    got = first.select("__lang", F.explode("__p").alias("p")).collect()
    code = {x: i for i, x in enumerate(langs)}
    texts = sorted((code[r["__lang"]], r["p"].encode()[:WINDOW]) for r in got)
    data, off = np.frombuffer(b"".join(t for _, t in texts), np.uint8), np.cumsum([0, *(len(t) for _, t in texts)])
    x, owner, _ = windows(data, off)
    return ByteCnn.fresh(langs).train(x, np.array([c for c, _ in texts])[owner])


def identify(docs: DataFrame, model: ByteCnn, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` for every row, from every window of the text.

    A null text, one without a letter, and any text under a model without
    languages gives ``und`` with score 0.  Repeated rows are judged each.
    """
    spark = tuned(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.tables() if model.classes else {}
        for b in batches:
            offsets, data = utf8_buffers(b.column(1))
            n = b.num_rows
            total, weight = np.zeros((n, max(1, len(model.classes)))), np.zeros(n)
            if model.classes:
                for i, j in chunks(np.diff(offsets)):
                    x, owner, length = windows(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    np.add.at(total, owner + i, model.log_probabilities(x, tables) * length[:, None])
                    np.add.at(weight, owner + i, length)
            p = _softmax(total / np.maximum(weight, 1)[:, None])
            best = p.argmax(1)
            known = [bool(model.classes) and t is not None and _LETTER(t) is not None for t in b.column(1).to_pylist()]
            names = [model.classes[k] if ok else "und" for k, ok in zip(best, known)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(np.where(known, p.max(1), 0.0))], names=["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def language_of_documents(docs: DataFrame) -> DataFrame:
    """Per document: the fold, the predicted language and its probability."""
    return identify(docs, train_langid(docs)).select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score")
