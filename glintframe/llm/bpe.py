"""Byte-level BPE by a sentencepiece model that is serialised straight from a rank file.

Each vocabulary entry becomes a piece whose bytes are written as printable
characters, scored by the negative rank, with the identity normaliser.  The
model then merges exactly as the ranks say; ids are the ranks.
"""

from __future__ import annotations

import base64
import re
import struct
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, tuned

#: Pre-tokens whose ids a worker remembers before it starts again.
CACHE_ENTRIES = 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _byte_characters() -> list[str]:
    """A printable character for every byte: itself where printable, else from U+0100 on."""
    keep = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in keep else chr(next(spare)) for b in range(256)]


BYTE_CHARACTERS = _byte_characters()
_TO_PRINTABLE = dict(enumerate(BYTE_CHARACTERS))
#: A byte that no UTF-8 text holds, written as a space.
_SEPARATOR = b"\xff"
_JOINED = _TO_PRINTABLE | {0xFF: " "}


def printable(raw: bytes) -> str:
    return raw.decode("latin-1").translate(_TO_PRINTABLE)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value & (1 << 64) - 1)


def _block(field: int, body: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(body)) + body


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """The serialised model: piece id = rank, then one unknown piece at the end.

    Ranks must run from 0 without gaps and hold all 256 single bytes.
    """
    order = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in order] != list(range(len(order))):
        raise ValueError("ranks must run from 0 without gaps")
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("every single byte must have a rank")
    piece = lambda text, score, kind: _block(1, _block(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _number(3, kind))
    pieces = [piece(printable(t), -float(i), 1) for i, t in enumerate(order)]
    pieces.append(piece("<unk>", 0.0, 2))
    trainer = _number(3, 2) + _number(4, len(pieces)) + _number(40, len(order)) + b"".join(_number(f, -1) for f in (41, 42, 43))
    normalizer = _block(1, b"identity") + b"".join(_number(f, 0) for f in (3, 4, 5))
    return b"".join(pieces) + _block(2, trainer) + _block(3, normalizer)


def _class(characters: list[int]) -> str:
    """A character class of the given sorted code points, as ranges."""
    out, i = [], 0
    while i < len(characters):
        j = i
        while j + 1 < len(characters) and characters[j + 1] == characters[j] + 1:
            j += 1
        out.append(f"\\U{characters[i]:08x}-\\U{characters[j]:08x}")
        i = j + 1
    return "[" + "".join(out) + "]"


class PreTokenizer:
    """``findall`` of the pattern; a faster equal form where the text allows it.

    The standard library's ``re`` knows no Unicode categories, but for texts
    without characters on which its classes differ from ``\\p{L}``, ``\\p{N}`` and
    white space (underscores, letter-like numbers, separators U+001C to U+001F
    and so on) the pattern below means the same.  Other texts take the pattern itself.
    """

    SAME_AS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    FAST = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?[^\s\w]+|\s+(?!\S)|\s+"

    def __init__(self, pattern: str) -> None:
        import regex

        self.exact = regex.compile(pattern).findall
        self.fast = self.odd = None
        if pattern == self.SAME_AS:
            odd = [ord("_")]
            space, letter = regex.compile(r"\s"), regex.compile(r"\p{L}")
            for c in range(1 << 16):
                x, kind = chr(c), unicodedata.category(chr(c))
                word, digit = x.isalnum(), kind == "Nd"
                if kind == "Cn" or (word and not digit) != (letter.match(x) is not None) or kind in ("Nl", "No") or x.isspace() != (space.match(x) is not None):
                    odd.append(c)
            odd += [*range(0x1C, 0x20), *range(1 << 16, sys.maxunicode + 1)]  # one range above U+FFFF keeps the search fast
            self.fast, self.odd = re.compile(self.FAST).findall, re.compile(_class(sorted(set(odd)))).search

    def __call__(self, text: str) -> list[str]:
        return self.exact(text) if self.fast is None or self.odd(text) else self.fast(text)


class Encoder:
    """Encodes and decodes by the model; lives in one worker."""

    def __init__(self, model: bytes, pattern: str) -> None:
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = PreTokenizer(pattern)
        back = {c: b for b, c in _TO_PRINTABLE.items()}
        self.size = self.pieces.get_piece_size() - 1
        self.bytes_of = [bytes(map(back.__getitem__, self.pieces.id_to_piece(i))) for i in range(self.size)]
        self.rank_of = {t: i for i, t in enumerate(self.bytes_of)}
        self.known: dict[str, bytes] = {}

    def learn(self, words: set[str]) -> None:
        if len(self.known) > CACHE_ENTRIES:
            self.known.clear()
        rest = []
        for w in words:
            if w in self.known:
                continue
            i = self.rank_of.get(w.encode())
            if i is None:
                rest.append(w)
            else:
                self.known[w] = struct.pack("<i", i)
        for i in range(0, len(rest), 5000):  # one call for many words: a space is no piece, so it parts them as unknown
            words = rest[i : i + 5000]
            ids = np.array(self.pieces.EncodeAsIds(_SEPARATOR.join(map(str.encode, words)).decode("latin-1").translate(_JOINED)) + [self.size], "<i4")
            at, ids = np.flatnonzero(ids == self.size) * 4, ids.tobytes()
            self.known.update(zip(words, map(ids.__getitem__, map(slice, [0, *(at[:-1] + 4).tolist()], at.tolist()))))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as consecutive little-endian 32-bit integers."""
        out: list[bytes] = []
        for i, j in chunks(np.array([len(t or "") for t in texts], np.int64)):
            split = [self.split(t) if t else [] for t in texts[i:j]]
            self.learn(set().union(*split))
            out += [b"".join(map(self.known.__getitem__, words)) for words in split]
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<i4").tolist()))


_ENCODERS: dict[tuple[int, str], Encoder] = {}


def _encoder(model: bytes, pattern: str) -> Encoder:
    key = (hash(model), pattern)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(model, pattern)
    return _ENCODERS[key]


def byte_bpe(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each text, then decode its ids.

    Returns ``doc_id`` (as given), ``ids array<int>`` and ``decoded binary``, one
    row per input row.  A null or empty text has no ids and decodes to nothing;
    repeated rows are encoded each; an empty table gives an empty result; columns
    other than the two named are not read.  The model (about a megabyte, fixed by
    the vocabulary) is the only thing that is broadcast.
    """
    spark = tuned(docs.sparkSession)
    shared = spark.sparkContext.broadcast(sentencepiece_model(read_ranks(ranks_path)))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value, pattern)
        for batch in batches:
            ids = encoder.encode(batch.column(1).to_pylist())
            offsets = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) // 4 for x in ids], out=offsets[1:])
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<i4")))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array([encoder.decode(x) for x in ids], pa.binary())], names=["doc_id", "ids", "decoded"])

    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded binary")


def byte_bpe_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Per document: number of ids, digest of the ids as text, digest of the decoded bytes."""
    out = byte_bpe(docs, ranks_path, pattern)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
