"""Counting of 64-bit keys over a corpus by questions and answers.

Documents are dealt into blocks, once.  A round lets every block ask
about its distinct keys: the keys go, sorted and packed, to the task that owns
their leading bits; that task combines what all blocks said about a key and
answers each block in the order of its question.  Blocks are read again from the
same shuffle, derive the same keys and line the answers up.  A key travels once
for each block, however often it occurs, so no key is a hot key, and both blocks
and owners grow in number, not in size, with the corpus.

Up to ``DIRECT`` blocks, each sends one message to every owner.  Beyond, that square
would cost more than the keys themselves: about the root of n blocks then share a
hub for each range of about as many owners.  A hub sorts what its blocks ask, asks
the owners of its range in their place and deals the answers back, so a round takes
4 * n * sqrt(n) messages, and every key travels twice.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, block_count, chunks, mix, shuffle_width, trim, tuned, utf8_buffers

_ZSTD = pa.Codec("zstd", 1)
#: Text that a task gathers before it writes out bundles.
BUNDLE_BYTES = 32 << 20
#: Blocks up to which every block has a message for every owner (4,096 empty messages weigh a fiftieth of a block).
DIRECT = 4096
#: Equal rows of one partition that go to one block.
EQUAL_ROWS = 64
QUESTION = "block int, owner int, keys binary, told array<binary>"
ANSWER = "block int, owner int, step int, told array<binary>, sums array<double>"
_TOLD = pa.list_(pa.binary())


def pack(values: np.ndarray, ordered: bool = False) -> bytes:
    """Unsigned integers by byte planes, compressed; ordered ones as differences."""
    x = np.ascontiguousarray(values).astype(np.uint64)
    if ordered and len(x):
        x = np.diff(x, prepend=np.uint64(0))
    top = int(x.max()).bit_length() if len(x) else 0
    width = -(-top // 8)
    raw = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T[:width]).tobytes()
    return bytes([width | 128 * ordered]) + len(x).to_bytes(8, "little") + (_ZSTD.compress(raw, asbytes=True) if raw else b"")


def unpack(data: bytes) -> np.ndarray:
    width, n = data[0] & 127, int.from_bytes(data[1:9], "little")
    out = np.zeros((n, 8), np.uint8)
    if width and n:
        out[:, :width] = np.frombuffer(_ZSTD.decompress(data[9:], n * width, asbytes=True), np.uint8).reshape(width, n).T
    x = out.view(np.uint64).reshape(n)
    return np.cumsum(x, dtype=np.uint64) if data[0] & 128 else x


def order_of(keys: np.ndarray) -> np.ndarray:
    """An order that sorts the keys: leading bits and place are sorted as one integer, which is fast."""
    if len(keys) >= 1 << 22:
        return np.argsort(keys, kind="stable")
    low = np.uint64((1 << 22) - 1)
    order = (np.sort(keys & ~low | np.arange(len(keys), dtype=np.uint64)) & low).astype(np.int64)
    ranked = keys[order]
    lead = ranked & ~low
    if (tied := np.flatnonzero((lead[1:] == lead[:-1]) & (ranked[1:] < ranked[:-1]))).size:  # keys that differ in the low bits only
        for value in np.unique(lead[tied]):
            i, j = np.searchsorted(lead, value, "left"), np.searchsorted(lead, value, "right")
            order[i:j] = order[i:j][np.argsort(ranked[i:j], kind="stable")]
    return order


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order that sorts the keys, where each distinct key begins in it, and the distinct keys."""
    order = order_of(keys)
    ranked = keys[order]
    begin = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return order, begin, ranked[begin]


def least(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the smallest value of each."""
    order, begin, distinct = grouped(keys)
    return distinct, np.minimum.reduceat(values[order], begin) if len(begin) else values[:0]


def totals(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sum of each one's values."""
    order, begin, distinct = grouped(keys)
    return distinct, np.add.reduceat(values[order], begin) if len(begin) else values[:0]


def look_up(keys: np.ndarray, known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Values of keys that are all among the sorted ``known``."""
    if not len(known):
        return np.zeros(len(keys), values.dtype)
    if len(keys) < 1000:
        return values[np.searchsorted(known, keys)]
    order, out = order_of(keys), np.empty(len(keys), values.dtype)
    out[order] = values[np.searchsorted(known, keys[order])]
    return out


@dataclass
class Block:
    """The documents of one block: ids, text offsets, text bytes, and the integer that came with each."""

    number: int
    ids: pa.Array
    offsets: np.ndarray
    data: np.ndarray
    more: np.ndarray

    def parts(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Chunks of whole documents: first and last row, offsets, bytes."""
        for i, j in chunks(np.diff(self.offsets)):
            yield i, j, self.offsets[i : j + 1] - self.offsets[i], self.data[self.offsets[i] : self.offsets[j]]


def _unbundled(table: pa.Table) -> Block:
    parts = pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in table.column("body").to_pylist()])
    whole = lambda name: pa.concat_arrays(parts.column(name).chunks)
    return Block(table.column("block")[0].as_py(), whole("id"), *utf8_buffers(whole("text")), parts.column("more").to_numpy())


def _bundles(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Rows of one block as one compressed table: text travels and waits at half its size.

    A row's block follows from its hash alone, and for every further ``EQUAL_ROWS`` equal
    rows another one, so neither an id nor a text can fill a block, and a repeated task
    deals its rows as before in whatever order they come.
    """
    held, size = [], 0
    met: dict[int, int] = {}

    def flush() -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        block = table.column("block").to_numpy()
        order = np.argsort(block, kind="stable")
        table, block = table.take(pa.array(order)).drop_columns("block"), block[order]
        begin = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        bodies = []
        for a, b in zip(begin, np.append(begin[1:], len(block))):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=_ZSTD)) as writer:
                writer.write_table(table.slice(a, b - a).combine_chunks())
            bodies.append(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array(block[begin]), pa.array(bodies, pa.binary())], names=["block", "body"])

    for batch in batches:
        deal = batch.column("deal").to_pylist()
        turn = []
        for h in deal:
            met[h] = k = met.get(h, -1) + 1
            turn.append(k // EQUAL_ROWS)
        block = mix(np.array(deal, np.int64).view(np.uint64) + mix(np.array(turn, np.uint64))) % np.uint64(n)
        batch = batch.drop_columns("deal").append_column("block", pa.array(block.astype(np.int32)))
        held.append(batch)
        size += batch.nbytes
        if size >= BUNDLE_BYTES:
            yield flush()
            held, size = [], 0
    if size or any(b.num_rows for b in held):
        yield flush()


#: What a block asks: sorted distinct keys and, for each, the values told with it.
Asking = Callable[[Block, dict[int, list[np.ndarray]], dict[int, np.ndarray]], tuple[np.ndarray, list[np.ndarray]]]
#: What an owner answers: from all keys asked and the values told, values in the same order, and sums.
Answering = Callable[[np.ndarray, list[np.ndarray]], tuple[list[np.ndarray], list[float]]]


def _edges(n: int, parts: np.ndarray) -> np.ndarray:
    """The first key of each of these owners (``n`` for the end is no key and has none).

    Keys that share their leading 48 bits lie with one owner.
    """
    return np.array([(int(o) << 48) // n << 16 for o in parts], np.uint64)


def _bounds(keys: np.ndarray, n: int, low: int = 0, high: int | None = None, step: int = 1) -> np.ndarray:
    """Where the shares of the sorted keys of owners ``low`` to ``high`` begin, ``step`` owners together; owner o has those from about o * 2**64 / n."""
    return np.concatenate([[0], np.searchsorted(keys, _edges(n, np.arange(low + step, n if high is None else high, step))), [len(keys)]]).astype(np.int64)


def _questions(sender: int, to: np.ndarray, keys: np.ndarray, values: list[np.ndarray], at: np.ndarray) -> pa.Table:
    """One message for each receiver: its slice of the sorted keys, and what is told with them."""
    cut = [slice(a, b) for a, b in zip(at[:-1], at[1:])]
    return pa.table({
        "block": pa.array(np.full(len(to), sender, np.int32)), "owner": pa.array(to.astype(np.int32)),
        "keys": pa.array([pack(keys[s], True) for s in cut], pa.binary()), "told": pa.array([[pack(v[s]) for v in values] for s in cut], _TOLD),
    })


def _asked(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """Of the questions to one receiver: senders, all keys, all values told, where each sender's begin, and the end."""
    keys = [unpack(x) for x in table.column("keys").to_pylist()]
    told = [[unpack(x) for x in row] for row in table.column("told").to_pylist()]
    return table.column("block").to_numpy(), np.concatenate(keys), [np.concatenate(x) for x in zip(*told)], np.cumsum([0, *map(len, keys)])


def _answers(receivers: np.ndarray, sender: int, step: int, values: list[np.ndarray], ends: np.ndarray, sums: list[float]) -> pa.Table:
    return pa.table({
        "block": pa.array(receivers.astype(np.int32)), "owner": pa.array(np.full(len(receivers), sender, np.int32)), "step": pa.array(np.full(len(receivers), step, np.int32)),
        "told": pa.array([[pack(v[a:b]) for v in values] for a, b in zip(ends[:-1], ends[1:])], _TOLD), "sums": pa.array([sums] * len(receivers), pa.list_(pa.float64())),
    })


def _told(table: pa.Table) -> tuple[dict[int, list[np.ndarray]], dict[int, np.ndarray]]:
    """By step: the values that all senders answered, in the order of their ranges, and the sums over all senders."""
    told: dict[int, list[list[np.ndarray]]] = {}
    sums: dict[int, np.ndarray] = {}
    for step, _, k in sorted(zip(table.column("step").to_pylist(), table.column("owner").to_pylist(), range(table.num_rows))):
        told.setdefault(step, []).append([unpack(x) for x in table.column("told")[k].as_py()])
        sums[step] = sums.get(step, 0) + np.array(table.column("sums")[k].as_py())
    return {s: [np.concatenate(x) for x in zip(*v)] for s, v in told.items()}, sums


class Corpus:
    """Documents dealt into blocks; see the module's text.

    ``docs`` is read once for each job over the corpus; rows must come back in the
    same partitions, as they do from files.
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", more: str = "", block_bytes: int = BLOCK_BYTES) -> None:
        """``more``: a SQL expression of an integer that comes with every document."""
        self.spark = tuned(docs.sparkSession)
        rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.expr(more or "0").cast("int").alias("more"))
        self.n = n = max(block_count(rows, "text", block_bytes), min(8, shuffle_width(self.spark)))
        self.id_type = rows.schema["id"].dataType.simpleString()
        self.width = max(n, shuffle_width(self.spark))
        dealt = rows.withColumn("deal", F.xxhash64("id", "text", "more", F.spark_partition_id()))
        self.blocks = dealt.mapInArrow(lambda batches: _bundles(batches, n), "block int, body binary").repartition(self.width, "block")
        self.answers: DataFrame | None = None

    def each(self, run: Callable[[Block], pa.Table], schema: str) -> DataFrame:
        """Apply ``run`` to every block, without any answers."""
        return self.blocks.groupBy("block").applyInArrow(lambda t: trim(run(_unbundled(t))), schema)

    def _each(self, run: Callable[[Block, dict, dict], pa.Table], schema: str) -> DataFrame:
        """Apply ``run`` to every block with the answers of all rounds so far."""
        if self.answers is None:
            return self.blocks.groupBy("block").applyInArrow(lambda t: trim(run(_unbundled(t), {}, {})), schema)
        both = lambda left, right: trim(run(_unbundled(left), *_told(right)))
        return self.blocks.groupBy("block").cogroup(self.answers.groupBy("block")).applyInArrow(both, schema)

    def round(self, step: int, ask: Asking, answer: Answering) -> DataFrame:
        """Ask from every block, answer at every owner, and keep the answers as ``step``.

        Returns the questions as dealt to their owners.
        """
        n = self.n
        wide = 1 if n <= DIRECT else math.isqrt(n - 1) + 1  # owners that a hub asks, and blocks that it asks for
        ranges = -(-n // wide)

        def asked(block: Block, told: dict, sums: dict) -> pa.Table:
            keys, values = ask(block, told, sums)
            hub = np.arange(ranges) + (block.number // wide * ranges if wide > 1 else 0)
            return _questions(block.number, hub, keys, values, _bounds(keys, n, step=wide))

        def passed_on(table: pa.Table) -> pa.Table:
            """At a hub: the questions of its blocks as one, to the owners of its range."""
            hub = table.column("owner")[0].as_py()
            _, keys, values, _ = _asked(table)
            order, low = order_of(keys), hub % ranges * wide
            keys, high = keys[order], min(low + wide, n)
            return _questions(hub, np.arange(low, high), keys, [v[order] for v in values], _bounds(keys, n, low, high))

        def answered(table: pa.Table) -> pa.Table:
            senders, keys, values, ends = _asked(table)
            values, sums = answer(keys, values)
            return trim(_answers(senders, table.column("owner")[0].as_py(), step, values, ends, sums))

        def passed_back(table: pa.Table, answers: pa.Table) -> pa.Table:
            """At a hub: the owners' answers, put back into the order of each block's question."""
            senders, keys, _, ends = _asked(table)
            values, sums = (x[step] for x in _told(answers))
            order = order_of(keys)
            back = [np.empty_like(v) for v in values]
            for to, v in zip(back, values):
                to[order] = v
            return _answers(senders, table.column("owner")[0].as_py(), step, back, ends, list(sums))

        dealt = lambda df, by: df.repartition(self.width, by)
        questions = first = dealt(self._each(asked, QUESTION), "owner")
        if wide > 1:
            questions = dealt(first.groupBy("owner").applyInArrow(passed_on, QUESTION), "owner")
        answers = dealt(questions.groupBy("owner").applyInArrow(answered, ANSWER), "block")
        if wide > 1:
            hubs = first.withColumnRenamed("owner", "hub").groupBy("hub")
            answers = dealt(hubs.cogroup(answers.groupBy("block")).applyInArrow(lambda q, a: passed_back(q.rename_columns(["block", "owner", "keys", "told"]), a), ANSWER), "block")
        self.answers = answers if self.answers is None else self.answers.unionByName(answers)
        return questions

    def finish(self, run: Callable[[Block, dict, dict], pa.Table], schema: str) -> DataFrame:
        return self._each(run, schema)
