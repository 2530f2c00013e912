"""Phrase collocations from word-id suffix arrays.

Every block of the corpus is a shard: its words become integers, one sequence holds
all pieces of its texts, and prefix doubling (depths 1, 2 and 4) orders the suffixes
as far as the longest phrase.  Intervals of suffixes that share their first n words
(neighbours with a longest common prefix of n or more) are the shard's n-grams, and
their widths the counts.  Counts are merged by key over all shards in rounds of
questions and answers: words and pairs first, then triples whose pairs are frequent,
then quadruples whose triples are.  A phrase that is frequent has only frequent
parts, so nothing frequent is left out, and what is rare is never sent again.

For each frequent phrase one shard is told to speak: it writes the phrase and the
counts of its parts.  Scores, the drop of phrases inside longer ones and the report
are plain DataFrame steps over these rows.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_codes, cut, lower_ascii, mix, prefix_hash, range_hash
from .exchange import Block, Corpus, grouped, look_up

#: Words of the longest phrase.
LONGEST = 4
#: Occurrences of a candidate in its language.
LEAST = 30
#: Phrases reported for each language.
MOST = 2000
#: Text of a shard: about 1.3 million words of prose, so that pairs of ranks and places fit 64 bits.
BLOCK = 8 << 20
_NONE = np.zeros(0, np.uint64)
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAP = _BREAK.copy()
_GAP[[0x20, 0x09]] = True


def _pair_order(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of pairs of ranks, and where each distinct pair begins in it."""
    n, high, low = len(high), high.astype(np.uint64), low.astype(np.uint64)
    if n < 1 << 21:  # pair and place fit one integer
        pair = (high << np.uint64(21)) | low
        both = np.sort((pair << np.uint64(21)) | np.arange(n, dtype=np.uint64)) if int(high.max(initial=0)) < 1 << 22 else None
    else:
        pair, both = (high << np.uint64(32)) | low, None
    order = np.argsort(pair, kind="stable") if both is None else (both & np.uint64((1 << 21) - 1)).astype(np.int64)
    ranked = pair[order]
    return order, np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if n else np.zeros(0, np.int64)


class Shard:
    """The words of a block as one sequence, and its suffixes ordered by their first ``LONGEST`` words."""

    def __init__(self, block: Block) -> None:
        self.data = lower_ascii(block.data)
        languages = pc.fill_null(block.ids.cast(pa.string()), "und").to_pylist()
        self.languages = sorted(set(languages))
        number = {x: k for k, x in enumerate(self.languages)}
        salt = np.array([range_hash(prefix_hash(byte_codes(c)), np.array([0]), np.array([len(c)]))[0] for c in (np.frombuffer(b"lang" + x.encode(), np.uint8) for x in self.languages)], np.uint64)
        language = np.array([number[x] for x in languages], np.int64)
        starts, ends, codes, owner, pieces = [], [], [], [], []
        base = 0
        for i, j, offsets, data in block.parts():
            data = self.data[block.offsets[i] : block.offsets[j]]
            inside = np.zeros(len(data) + 2, bool)
            inside[1:-1] = ~_GAP[data]
            head = np.zeros(len(data) + 1, bool)
            head[offsets] = True
            a = np.flatnonzero(inside[1:-1] & (~inside[:-2] | head[:-1]))
            b = np.flatnonzero(inside[1:-1] & (~inside[2:] | head[1:])) + 1
            breaks = np.concatenate([[0], np.cumsum(_BREAK[data])])
            own = np.searchsorted(offsets, a, side="right") - 1 + i
            codes.append(range_hash(prefix_hash(byte_codes(data)), a, b))
            starts.append(a + block.offsets[i])
            ends.append(b + block.offsets[i])
            owner.append(own)
            pieces.append(breaks[a] + base)
            base += int(breaks[-1]) + 1
        join = lambda x: np.concatenate([np.zeros(0, np.int64), *x])
        self.starts, self.ends, owner, piece = join(starts), join(ends), join(owner), join(pieces)
        self.language = language[owner] if len(owner) else owner
        self.codes = mix(np.concatenate([_NONE, *codes]) ^ (salt[self.language] if len(owner) else _NONE))
        n = len(self.codes)
        # Words from each place to the end of its piece, LONGEST at most.
        self.room = np.ones(n, np.int64)
        for k in range(1, LONGEST):
            self.room[: n - k] += (self.room[: n - k] == k) & (piece[: n - k] == piece[k:]) & (owner[: n - k] == owner[k:])
        self._order()

    def _order(self) -> None:
        """Prefix doubling: ranks by 1, 2 and 4 words; a suffix that ends in its piece stands before longer ones."""
        n = len(self.codes)
        order, begin, distinct = grouped(self.codes)
        rank = np.zeros(n, np.int64)
        rank[order] = np.repeat(np.arange(1, len(begin) + 1), np.diff(np.append(begin, n)))
        ranks, width = {1: rank}, 1
        while width < LONGEST:
            after = np.zeros(n, np.int64)
            more = np.flatnonzero(self.room > width)
            after[more] = rank[more + width]
            order, begin = _pair_order(rank, after)
            rank = np.zeros(n, np.int64)
            rank[order] = np.repeat(np.arange(1, len(begin) + 1), np.diff(np.append(begin, n)))
            width *= 2
            ranks[width] = rank
        self.suffixes, self.ranks = order, ranks
        # Longest common prefixes of neighbours in the order.
        low, high = order[:-1], order[1:]
        room = np.minimum(self.room[low], self.room[high])
        lcp = (ranks[1][low] == ranks[1][high]).astype(np.int64)
        pair = (lcp == 1) & (room >= 2)
        pair[pair] = ranks[1][low[pair] + 1] == ranks[1][high[pair] + 1]
        lcp[pair] = 2
        for k in range(3, LONGEST + 1):
            on = (lcp == k - 1) & (room >= k)
            on[on] = ranks[1][low[on] + k - 1] == ranks[1][high[on] + k - 1]
            lcp[on] = k
        self.lcp = lcp

    def intervals(self, n: int, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams: the place of one suffix of each interval, and the interval's width.

        ``allowed``: by place, whether an n-gram that begins there counts at all.
        """
        long = (self.room >= n)[self.suffixes]
        if allowed is not None:
            long &= allowed[self.suffixes]
        begin = np.concatenate([[True], self.lcp < n])[: len(self.suffixes)] & long
        of = np.cumsum(begin) - 1
        first = self.suffixes[begin]
        return first, np.bincount(of[long], minlength=len(first)) if len(first) else np.zeros(0, np.int64)

    def keys(self, place: np.ndarray, n: int) -> np.ndarray:
        """One key for n words from each place, the same in all shards."""
        key = mix(self.codes[place] + np.uint64(n))
        for k in range(1, n):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + self.codes[place + k])
        return key

    def spread(self, n: int, place: np.ndarray, value: np.ndarray, allowed: np.ndarray | None = None) -> np.ndarray:
        """By place: the value of the n-gram that begins there, 0 where none (counted) does."""
        long = (self.room >= n)[self.suffixes]
        if allowed is not None:
            long &= allowed[self.suffixes]
        begin = np.concatenate([[True], self.lcp < n])[: len(self.suffixes)] & long
        out = np.zeros(len(self.suffixes), np.int64)
        if len(place):
            out[self.suffixes[long]] = value[(np.cumsum(begin) - 1)[long]]
        return out


def _sorted(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    order, begin, distinct = grouped(keys)
    return distinct, [np.add.reduceat(counts[order].astype(np.uint64), begin) if len(begin) else _NONE]


def _grams(shard: Shard, lengths: tuple[int, ...], allowed: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """Keys and counts of the shard's n-grams of these lengths, and one place of each."""
    keys, counts, places = [_NONE], [np.zeros(0, np.int64)], []
    for n in lengths:
        first, width = shard.intervals(n, allowed.get(n))
        keys.append(shard.keys(first, n))
        counts.append(width)
        places.append((n, first))
    return np.concatenate(keys), np.concatenate(counts), places


def _merge(least: int):
    def answer(keys: np.ndarray, values: list[np.ndarray]) -> tuple[list[np.ndarray], list[float]]:
        """Twice the count over all shards, plus one for the shard that is to speak; 0 for rare phrases."""
        order, begin, _ = grouped(keys)
        if not len(begin):
            return [_NONE], []
        total = np.add.reduceat(values[0][order], begin)
        total = np.where(total >= np.uint64(least), total, np.uint64(0))
        out = np.zeros(len(keys), np.uint64)
        out[order] = np.repeat(total << np.uint64(1), np.diff(np.append(begin, len(keys))))
        out[order[begin]] += (total > 0).astype(np.uint64)
        return [out], []

    return answer


#: Lengths counted together, by round.
ROUNDS = ((1, 2), (3,), (4,))


class Counted:
    """A shard with the global counts of its n-grams as far as the rounds have gone."""

    def __init__(self, block: Block, told: dict) -> None:
        self.shard = shard = Shard(block)
        self.count: dict[int, np.ndarray] = {}
        self.speaks: dict[int, np.ndarray] = {}
        self.allowed: dict[int, np.ndarray] = {}
        for step, lengths in enumerate(ROUNDS):
            self._allow(lengths)
            if step not in told:
                break
            keys, counts, places = _grams(shard, lengths, self.allowed)
            asked = _sorted(keys, counts)[0]
            answer = look_up(keys, asked, told[step][0].astype(np.int64)) if len(asked) else np.zeros(0, np.int64)
            at = 0
            for n, first in places:
                value = answer[at : at + len(first)]
                at += len(first)
                self.count[n] = shard.spread(n, first, value >> 1, self.allowed.get(n))
                self.speaks[n] = first[value & 1 > 0]

    def _allow(self, lengths: tuple[int, ...]) -> None:
        """A phrase counts where both its longest parts are frequent."""
        for n in lengths:
            if n - 1 in self.count:
                part = self.count[n - 1] > 0
                ok = np.zeros(len(part), bool)
                ok[:-1] = part[:-1] & part[1:]
                self.allowed[n] = ok

    def ask(self, step: int) -> tuple[np.ndarray, list[np.ndarray]]:
        keys, counts, _ = _grams(self.shard, ROUNDS[step], self.allowed)
        return _sorted(keys, counts)


_SPOKEN = "lang string, words int, phrase string, a bigint, n bigint, parts array<struct<l:bigint,r:bigint>>, inner array<string>"


def _spoken(block: Block, told: dict) -> pa.Table:
    """The phrases of two words and more for which this shard speaks, and one row for the words of each language."""
    c = Counted(block, told)
    s, text = c.shard, c.shard.data
    rows: list[tuple] = []
    for n in range(2, LONGEST + 1):
        places = c.speaks.get(n, np.zeros(0, np.int64))
        part = {(i, k): c.count[k][places + i] for k in range(1, n) for i in range(n - k + 1)}
        total = c.count[n][places] if len(places) else places
        for x, p in enumerate(places.tolist()):
            w = [text[a:b].tobytes().decode() for a, b in zip(s.starts[p : p + n].tolist(), s.ends[p : p + n].tolist())]
            cuts = [{"l": int(part[0, k][x]), "r": int(part[k, n - k][x])} for k in range(1, n)]
            inner = [" ".join(w[i : i + k]) for k in range(2, n) for i in range(n - k + 1)]
            rows.append((s.languages[s.language[p]], n, " ".join(w), int(total[x]), None, cuts, inner))
    for k, many in enumerate(np.bincount(s.language, minlength=len(s.languages)).tolist()):
        rows.append((s.languages[k], 1, None, None, many, [], []))
    pair = pa.struct([("l", pa.int64()), ("r", pa.int64())])
    types = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.list_(pair), pa.list_(pa.string())]
    return pa.table([pa.array(list(x), t) for x, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], names=["lang", "words", "phrase", "a", "n", "parts", "inner"])


def phrase_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, made: list[str] | None = None) -> DataFrame:
    """Frequent phrases of two to four words by language, with the counts of the parts of every cut.

    Columns: ``lang, words, phrase, a, n, parts, inner``; rows of one word hold the
    number of words ``n`` that one shard has in a language.
    """
    corpus = Corpus(docs, lang_col, text_col, block_bytes=BLOCK)
    for step in range(len(ROUNDS)):
        corpus.round(step, lambda block, told, sums, step=step: Counted(block, told).ask(step), _merge(least))
    return cut(corpus.finish(lambda block, told, sums: _spoken(block, told), _SPOKEN), made)


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, most: int = MOST) -> DataFrame:
    """The strongest phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    Texts are ASCII-lower-cased, cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and into
    words at blanks and tabs; a null language is ``und``, a null text has no words.
    A candidate has two to four words and occurs ``least`` times in its language; of
    its cuts the one with the lowest score counts (ties: the fewest words left), and
    it drops out where a longer candidate that holds it has 80 % of its occurrences.
    Scores are quotients of exact integers.  A repeated row counts as often as it
    stands there; an empty table gives no rows.  Keys of phrases have 64 bits.
    """
    rows = phrase_counts(docs, lang_col, text_col, least)
    words = rows.where("words = 1").groupBy("lang").agg(F.sum("n").cast("long").alias("n"))
    phrases = rows.where("words > 1")
    longer = phrases.select("lang", F.explode("inner").alias("phrase"), F.col("a").alias("f")).groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    kept = phrases.drop("n", "inner").join(longer, ["lang", "phrase"], "left").where("f is null or 100 * cast(f as decimal(20,0)) < 80 * cast(a as decimal(20,0))")
    # A sum or product may pass 64 bits, so both are decimals; the quotient is at most a million.
    score = "(2000000 * cast(a as decimal(20,0))) div (cast(p.l as decimal(20,0)) + cast(p.r as decimal(20,0)))"
    cuts = kept.withColumn("cuts", F.expr(f"transform(parts, (p, k) -> struct({score} as score, k, p.l as l, p.r as r))"))
    best = cuts.select("lang", "phrase", "a", F.array_min("cuts").alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "c.score")
    rank = F.expr("row_number() over (partition by lang order by score desc, a desc, phrase)")
    top = best.withColumn("rank", rank).where(F.col("rank") <= most).withColumn("rank", F.col("rank").cast("long"))
    # The words of a language are one number for each of them: a table as small as the list of languages.
    return top.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: ``collocations`` over ``documents`` as DuckDB SQL.
COLLOCATION_SQL = rf"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents),
listed AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
placed AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM listed),
grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM placed, (VALUES (1), (2), (3), (4)) AS t(k) WHERE i + k - 1 <= len(w)),
counts AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f) AS n FROM counts WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE k > 1 AND f >= {LEAST}),
inner_places AS (SELECT lang, k, w, a, m, unnest(range(1, k - m + 2)) AS i FROM candidates, (VALUES (2), (3)) AS t(m) WHERE m < k),
longer AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS f FROM inner_places GROUP BY ALL),
kept AS (SELECT c.* FROM candidates c LEFT JOIN longer USING (lang, phrase) WHERE longer.f IS NULL OR 100::HUGEINT * longer.f < 80::HUGEINT * c.a),
cuts AS (SELECT *, unnest(range(1, k)) AS c FROM kept),
scored AS (
    SELECT cuts.lang, cuts.phrase, cuts.a, cuts.c, x.f AS l, y.f AS r, (2000000::HUGEINT * cuts.a) // (x.f::HUGEINT + y.f) AS score
    FROM cuts JOIN counts x ON x.lang = cuts.lang AND x.phrase = array_to_string(cuts.w[1:cuts.c], ' ')
    JOIN counts y ON y.lang = cuts.lang AND y.phrase = array_to_string(cuts.w[cuts.c + 1:cuts.k], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= {MOST}
"""
