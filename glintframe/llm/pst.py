"""A probabilistic suffix tree over words: training and scoring of a whole corpus.

States are contexts of up to two preceding words.  A context stays in the tree only
where a divergence test says that it predicts its next word better than its parent
(the next shorter context that stayed): the log likelihood ratio over the context's
training occurrences, each left out of its own estimate, must exceed ``MARGIN``.
Next-word distributions are smoothed towards the parent's, the root being the
add-one unigram.  A word is scored by the longest context that stayed.

Counts of words, pairs and triples are gathered over all training documents by
questions and answers (``exchange``), so nothing is collected or broadcast and the
tree grows with the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, mix, word_bounds, word_hashes
from .exchange import Block, Corpus, grouped, look_up, totals

#: Least log likelihood ratio (natural) of a context that stays.
MARGIN = 3.0
#: Steps of a log likelihood ratio.
UNIT = 1 << 16
#: Training occurrences that a context of one word, and of two, needs to be a candidate.
LEAST_ONE, LEAST_TWO = 2, 4
#: Weight of the parent's distribution, in occurrences.
PRIOR_ONE, PRIOR_TWO = 8.0, 4.0

_END, _START = np.uint64(0x8D2F1A6B39C4E705), np.uint64(0x51E7C3D2980B6FA4)
_TWO, _THREE, _STEP = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)
_ONE_BIT = np.uint64(1)
#: Pairs, triples and contexts have fingerprints of 56 bits, words of 64.
_SHORT = ~np.uint64(0xFF)


def _tokens(block: Block) -> dict[str, np.ndarray]:
    """All tokens of the block: code, the two before, row, and whether the row trains."""
    codes, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for i, j, offsets, data in block.parts():
        data = lower_ascii(data)
        starts, ends, first = word_bounds(data, offsets)
        words = np.insert(word_hashes(data, starts, ends), first[1:], _END)
        codes.append(words)
        rows.append(np.repeat(np.arange(i, j), np.diff(first) + 1))
    word, row = np.concatenate(codes), np.concatenate(rows)
    begin = np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else np.zeros(0, bool)
    one = np.where(begin, _START, np.concatenate([[_START], word[:-1]])[: len(word)])
    second = np.concatenate([[False], begin[:-1]])[: len(word)] | begin
    two = np.where(second, _START, np.concatenate([[_START, _START], word[:-2]])[: len(word)])
    return {"word": word, "one": one, "two": two, "row": row, "begin": begin, "train": block.more[row] > 0}


def _uni(t: dict) -> np.ndarray:
    return mix(t["word"]) & ~_ONE_BIT


def _pair(one: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(one * _TWO + word) & _SHORT | _ONE_BIT


def _triple(t: dict) -> np.ndarray:
    return mix((t["two"] * _THREE + t["one"]) * _TWO + t["word"]) & _SHORT


def _sum_answer(keys: np.ndarray, values: list[np.ndarray]) -> tuple[list[np.ndarray], list[float]]:
    """Counts over all blocks; the sums are N and V of the words (keys with a clear low bit)."""
    distinct, count = totals(keys, values[0])
    word = ((distinct & _ONE_BIT) == 0) & (count > 0)
    return [look_up(keys, distinct, count)], [float(count[word].sum()), float(word.sum())]


def _ask_counts(block: Block, told: dict, sums: dict) -> tuple[np.ndarray, list[np.ndarray]]:
    t = _tokens(block)
    train = t["train"].astype(np.uint64)
    keys, count = totals(np.concatenate([_uni(t), _pair(t["one"], t["word"])]), np.concatenate([train, train]))
    return keys, [count]


def _first(block: Block, told: dict, sums: dict) -> dict[str, np.ndarray]:
    """Tokens with their counts, contexts' counts and the root's probabilities."""
    t = _tokens(block)
    uni, pair = _uni(t), _pair(t["one"], t["word"])
    n = len(uni)
    order, begin, _ = grouped(np.concatenate([uni, pair]))
    count = np.empty(2 * n)
    count[order] = np.repeat(told[1][0].astype(np.float64), np.diff(np.append(begin, 2 * n))) if n else 0
    t["c1"], t["c2"] = count[:n], count[n:]
    total, kinds = sums[1] if 1 in sums else (0.0, 0.0)
    t["total"] = total
    t["p0"] = (t["c1"] + 1) / (total + kinds + 1)
    before = np.concatenate([[0.0], t["c1"][:-1]])[:n]
    ends = t["c1"][t["word"] == _END]
    t["n1"] = np.where(t["begin"], ends[0] if len(ends) else 0.0, before)  # occurrences of the one-word context
    t["n2"] = np.where(t["begin"], 0.0, np.concatenate([[0.0], t["c2"][:-1]])[:n])  # and of the two-word context
    t["p1"] = (t["c2"] + PRIOR_ONE * t["p0"]) / (t["n1"] + PRIOR_ONE)
    return t


def _ratio(t: dict, count: str, size: str, parent: np.ndarray, prior: float, pick: np.ndarray) -> np.ndarray:
    """Log ratio of each picked training occurrence, left out of its own context, to the parent, in whole ``UNIT``s.

    Whole numbers add up to the same sum however the corpus is dealt into blocks.
    """
    c, n, p = t[count][pick], t[size][pick], parent[pick]
    return np.rint((np.log((c - 1 + prior * p) / (n - 1 + prior)) - np.log(p)) * UNIT).astype(np.int64)


def _signed(x: np.ndarray) -> np.ndarray:
    """Small numbers of either sign as small unsigned ones."""
    return ((x << 1) ^ (x >> 63)).view(np.uint64)


def _unsigned(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(1)).astype(np.int64) ^ -(x & np.uint64(1)).astype(np.int64)


def _tell(sums: tuple[np.ndarray, np.ndarray], asks: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """One question of two kinds: contexts with partial ratios (low bit clear), n-grams with counts (set)."""
    keys = np.concatenate([sums[0] & ~_ONE_BIT, asks | _ONE_BIT])
    order = np.argsort(keys, kind="stable")
    return keys[order], [np.concatenate([_signed(sums[1]), counts])[order]]


def _mixed_answer(keys: np.ndarray, values: list[np.ndarray]) -> tuple[list[np.ndarray], list[float]]:
    """Contexts: 1 where the ratios of all blocks add up to more than the margin.  N-grams: their count."""
    counted = (keys & _ONE_BIT) > 0
    out = np.zeros(len(keys), np.uint64)
    distinct, count = totals(keys[counted], values[0][counted])
    out[counted] = look_up(keys[counted], distinct, count)
    distinct, ratio = totals(keys[~counted], _unsigned(values[0][~counted]))
    out[~counted] = look_up(keys[~counted], distinct, (ratio > MARGIN * UNIT).astype(np.uint64))
    return [out], []


def _context_one(t: dict, pick: np.ndarray) -> np.ndarray:
    return mix(t["one"][pick] ^ _STEP) & _SHORT


def _context_two(t: dict, pick: np.ndarray) -> np.ndarray:
    return mix(t["two"][pick] * _THREE + t["one"][pick] ^ _STEP) & _SHORT


def _second_question(t: dict):
    one = np.flatnonzero(t["n1"] >= LEAST_ONE)
    train = one[t["train"][one]]
    ratios = totals(_context_one(t, train), _ratio(t, "c2", "n1", t["p0"], PRIOR_ONE, train))
    # A context that only held-out documents of the block hold is asked about too.
    rest = np.setdiff1d(np.unique(_context_one(t, one)), ratios[0], assume_unique=True)
    ratios = (np.concatenate([ratios[0], rest]), np.concatenate([ratios[1], np.zeros(len(rest), np.int64)]))
    two = np.flatnonzero(t["n2"] >= LEAST_TWO)
    grams, counts = totals(_triple(t)[two] | _ONE_BIT, t["train"][two].astype(np.uint64))
    return _tell(ratios, grams, counts), one, two


def _ask_second(block: Block, told: dict, sums: dict) -> tuple[np.ndarray, list[np.ndarray]]:
    return _second_question(_first(block, told, sums))[0]


def _second(block: Block, told: dict, sums: dict) -> dict[str, np.ndarray]:
    """Adds which one-word contexts stayed, the parent probability, and the triples' counts."""
    t = _first(block, told, sums)
    (keys, _), one, two = _second_question(t)
    answer = told[2][0]
    t["stay1"] = np.zeros(len(t["word"]), bool)
    t["stay1"][one] = look_up(_context_one(t, one), keys, answer) > 0
    t["parent"] = np.where(t["stay1"], t["p1"], t["p0"])
    t["c3"] = np.zeros(len(t["word"]))
    t["c3"][two] = look_up(_triple(t)[two] | _ONE_BIT, keys, answer)
    t["two_at"] = two
    return t


def _third_question(t: dict):
    two = t["two_at"]
    train = two[t["train"][two]]
    ratios = totals(_context_two(t, train), _ratio(t, "c3", "n2", t["parent"], PRIOR_TWO, train))
    rest = np.setdiff1d(np.unique(_context_two(t, two)), ratios[0], assume_unique=True)
    return _tell((np.concatenate([ratios[0], rest]), np.concatenate([ratios[1], np.zeros(len(rest), np.int64)])), np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def _ask_third(block: Block, told: dict, sums: dict) -> tuple[np.ndarray, list[np.ndarray]]:
    return _third_question(_second(block, told, sums))


def _score(block: Block, told: dict, sums: dict) -> pa.Table:
    t = _second(block, told, sums)
    two, n = t["two_at"], len(block.ids)
    keys = _third_question(t)[0]
    stay2 = np.zeros(len(t["word"]), bool)
    stay2[two] = look_up(_context_two(t, two), keys, told[3][0]) > 0
    p = np.where(stay2, (t["c3"] + PRIOR_TWO * t["parent"]) / (t["n2"] + PRIOR_TWO), t["parent"])
    add = lambda x: np.bincount(t["row"], x, n)
    depth = t["stay1"].astype(np.int64) + stay2
    return pa.table({
        "id": block.ids, "train": pa.array(block.more > 0), "n_tokens": pa.array(add(None).astype(np.int64)), "n_known": pa.array(add(t["c1"] > 0).astype(np.int64)),
        "train_tokens": pa.array(np.full(n, int(t["total"]))), "base_score": pa.array(add(np.log10(t["p0"]))), "score": pa.array(add(np.log10(p))), "mean_depth": pa.array(add(np.where(stay2, 2, depth)) / np.maximum(add(None), 1)),
    })


def suffix_tree_scores(docs: DataFrame, train: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on the rows where the SQL expression ``train`` is true; score every row.

    Tokens are ASCII-lower-cased words and one end of text; a null text has the end
    alone.  Returns ``doc_id, n_tokens, n_known`` (seen in training), ``train_tokens``,
    ``base_score`` (add-one unigram) and ``score`` (the tree), both as log10
    probability of the whole text, and ``mean_depth`` of the states used.  Without
    training rows every token has probability 1.  Repeated rows count each.
    """
    corpus = Corpus(docs, id_col, text_col, more=f"CASE WHEN {train} THEN 1 ELSE 0 END")
    corpus.round(1, _ask_counts, _sum_answer)
    corpus.round(2, _ask_second, _mixed_answer)
    corpus.round(3, _ask_third, _mixed_answer)
    out = corpus.finish(_score, f"id {corpus.id_type}, train boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, mean_depth double")
    return out.withColumnRenamed("id", "doc_id")


def language_model_scores(docs: DataFrame) -> DataFrame:
    """Per document: the fold, token counts, the unigram's and the tree's log10 probability."""
    train = "crc32(cast(coalesce(cast(doc_id as string), 'null') as binary)) % 7 <> 2"
    out = suffix_tree_scores(docs.select("doc_id", "text"), train)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "mean_depth")
