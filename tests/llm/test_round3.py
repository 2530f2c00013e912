"""Operators 11 to 13, the shared linking, and texts longer than a chunk."""

import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from brute import lower, prose, words
from brute_alignment import align

from glintframe.llm import alignment, collocations, common, components, forest, linking, partenum, queries, rlz, suffix_dedup

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def frame(spark, rows, parts=3):
    """Documents with other columns, one of which clashes with names used inside."""
    rows = [(i, t, "en", "s", 0, "clash") for i, t in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, block string").repartition(parts)


# --- shared parts ------------------------------------------------------------------------


def thue_morse(n):
    return "".join("ab"[k.bit_count() & 1] for k in range(n))


def test_hash_tells_thue_morse_apart():
    for n in (64, 512, 1024, 2048, 5000):
        one = thue_morse(n)
        both = np.frombuffer((one + one.translate(str.maketrans("ab", "ba"))).encode(), np.uint8)
        h = common.word_hashes(both, np.array([0, n]), np.array([n, 2 * n]))
        assert h[0] != h[1], n
        shifted = np.frombuffer(("xyz" + one).encode(), np.uint8)
        assert common.word_hashes(shifted, np.array([3]), np.array([3 + n]))[0] == h[0]


def test_operators_tell_thue_morse_apart(spark):
    head = " ".join(f"w{k}" for k in range(12))
    one = thue_morse(1024)
    two = one.translate(str.maketrans("ab", "ba"))
    docs = frame(spark, [(1, f"{head} {one}"), (2, f"{head} {two}")])
    assert {r["doc_id"]: r["component_id"] for r in partenum.near_duplicates(docs).collect()} == {1: 1, 2: 2}
    assert {r["doc_id"]: r["n_removed"] for r in rlz.rlz_digests(docs).collect()} == {1: 0, 2: 0}
    assert {r["doc_id"]: r["component_id"] for r in forest.forest_join(docs, 1, 90).collect()} == {1: 1, 2: 2}
    text = one[:512] * 4  # long windows over two letters
    docs = frame(spark, [(1, "x" + text), (2, "y" + text.translate(str.maketrans("ab", "ba")) + "z")])
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.suffix_digests(docs).collect()}
    windows = Counter(t[i : i + 400] for t in ("x" + text, "y" + text.translate(str.maketrans("ab", "ba")) + "z") for i in range(len(t) - 399))
    for i, t in ((1, "x" + text), (2, "y" + text.translate(str.maketrans("ab", "ba")) + "z")):
        gone = {p for k in range(len(t) - 399) if windows[t[k : k + 400]] > 1 for p in range(k, k + 400)}
        assert got[i] == len(gone)


@pytest.mark.parametrize("shared", [399, 400])
def test_passage_of_sixty_words_goes_by_its_bytes(spark, shared):
    """A passage of over 50 words goes by words; by the contract's bytes only if the string that repeats has 400."""
    passage = " ".join(f"w{k:04}" for k in range(60))
    passage += "x" * (shared - 2 - len(passage))  # the blanks around it repeat too
    texts = {1: f"xa {passage} two", 2: f"yb {passage} four", 3: "nothing else " * 3}
    docs = frame(spark, texts.items())
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.suffix_digests(docs).collect()}
    gone = shared if shared == 400 else 0
    assert {k: v[:3] for k, v in got.items()} == {k: (len(t), gone * (k < 3), int(gone > 0 and k < 3)) for k, t in texts.items()}
    by_words = {r["doc_id"]: bytes(r["kept"]).decode() for r in suffix_dedup.suffix_dedup(docs, window=50, words=True).collect()}
    assert by_words == {1: "xa two", 2: "yb four", 3: texts[3]}


def test_distinct():
    r = np.random.default_rng(3)
    for n in (0, 1, 1000):
        x = r.integers(0, 50, n, dtype=np.uint64)
        assert (common.distinct(x) == np.unique(x)).all()


def test_components(spark):
    r = random.Random(7)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1100)] + [(5000, k) for k in range(4000, 4200)]
    up = {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    want = {x: root(x) for e in edges if e[0] != e[1] for x in e}
    df = spark.createDataFrame(edges, "a long, b long").repartition(4)
    made = []
    assert {r["node"]: r["label"] for r in components.components(df, made).collect()} == want
    half = components.components(df.where("a < 2000 and b % 3 > 0"), made)
    more = components.joined(half, df.where("not (a < 2000 and b % 3 > 0)"), made)
    rows = [(r["node"], r["label"]) for r in more.collect()]
    assert len(rows) == len(want) and {n: want[lab] for n, lab in rows} == want and len({lab for _, lab in rows}) == len(set(want.values()))
    assert components.components(df.where("a < 0")).count() == 0


# --- 11 alignment ------------------------------------------------------------------------


def odd_texts():
    r = random.Random(11)
    base = [
        None, "", " ", "   ", "a", " a", "a ", "two  blanks", "\ttab\there", "line\nline \n next", "é ü 漢字 かな \U0001f600 x", "a b 　c　 d  e", "▁ piece mark ▁x",
        "<|endoftext|> <s> </s> <0x41> <unk>", "x" * 3000, "ab" * 900 + " " + "  " * 50 + "end", "ﬁ ligature Å", "don't we'll I'm 3.14 1,000", "\x00\x01\x7f control", "trailing \n ", " \n lead", "\x1c sep \x85 next", "é combining",
    ]
    alphabet = "ab éß漢 　\n\t ▁.,'12"
    base += ["".join(r.choice(alphabet) for _ in range(r.randrange(1, 60))) for _ in range(120)]
    return base + [prose(r, r.randrange(1, 120)) for _ in range(60)] + ["same text here"] * 20


def test_alignment(spark):
    rows = [(k % 7 if k > 150 else k, t) for k, t in enumerate(odd_texts())] + [(None, "no id here"), (None, None)]
    docs = frame(spark, rows, 4)
    got = [tuple(r) for r in alignment.alignment_digests(docs, A, B).select(*COLUMNS).collect()]
    assert Counter(got) == Counter(align(rows))
    assert sum(g[1] == 0 for g in got) > 3  # texts that B does not spell
    assert alignment.align_tokenizers(docs.limit(0), A, B).count() == 0


def test_alignment_of_a_long_text(spark):
    r = random.Random(12)
    rows = [(1, prose(r, 60_000, 5000)), (2, "z" * 300_000 + " end"), (3, prose(r, 50))]
    docs = frame(spark, rows)
    assert Counter(tuple(x) for x in alignment.alignment_digests(docs, A, B).select(*COLUMNS).collect()) == Counter(align(rows))


def test_vocabularies_are_verified():
    pair = alignment.Pair(A, B)
    assert pair.splits
    assert alignment._merges(b"a b") and alignment._merges(" x y".encode()) and not alignment._merges(b"  x") and not alignment._merges(b"\n x") and not alignment._merges(b" ")
    texts = [" plain", " ▁", "  two"]
    heads, *_ = pair.encode([t.encode() for t in texts])
    assert heads[1].tolist() == [0, 0, 0] and heads[0, 0] and heads[2, 1]


# --- 12 collocations ---------------------------------------------------------------------


def brute_collocations(rows, least, most):
    import re

    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text or "")):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    gone = {(lang, w[i : i + k]) for (lang, w), a in found.items() for k in range(2, len(w)) for i in range(len(w) - k + 1) if 100 * a >= 80 * found[lang, w[i : i + k]]}
    out, rank = [], Counter()
    ranked = []
    for (lang, w), a in found.items():
        if (lang, w) not in gone:
            score, k = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
            ranked.append((lang, -score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    for lang, score, a, phrase, left, right in sorted(ranked):
        rank[lang] += 1
        if rank[lang] <= most:
            out.append((lang, rank[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return out


def collocation_rows():
    r = random.Random(2)
    base = ["new", "york", "city", "of", "the", "united", "states", "é", "Big", "APPLE", " x", "a'b", "漢"]
    rows = [(r.choice(["en", "de", None, "und", ""]), "".join(r.choice(base) + r.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "!?"]) for _ in range(r.randrange(60)))) for _ in range(300)]
    return rows + [("en", None), ("en", ""), ("xx", " ., ")] + [("en", "one phrase that repeats itself")] * 40 + [("zz", "lone word " * 200)]


@pytest.mark.parametrize("least,most", [(30, 2000), (3, 7)])
def test_collocations(spark, least, most):
    rows = collocation_rows()
    docs = spark.createDataFrame([(k, lang, t, "x") for k, (lang, t) in enumerate(rows)], "doc_id long, lang string, text string, rank string").repartition(5)
    got = [tuple(r) for r in collocations.collocations(docs, least=least, most=most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").orderBy("lang", "rank").collect()]
    assert got == brute_collocations(rows, least, most)
    assert collocations.collocations(docs.limit(0)).count() == 0


def test_collocations_over_several_shards(spark, monkeypatch):
    monkeypatch.setattr(collocations, "BLOCK", 2000)
    rows = collocation_rows()
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    got = [tuple(r) for r in collocations.collocations(docs, least=5).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").orderBy("lang", "rank").collect()]
    assert got == brute_collocations(rows, 5, 2000)


def test_collocations_of_a_long_text(spark):
    r = random.Random(4)
    rows = [("en", " ".join(f"w{r.randrange(40)}" for _ in range(120_000))), ("en", "w1 w2 w3, " * 100)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    got = [tuple(x) for x in collocations.collocations(docs, most=50).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").orderBy("lang", "rank").collect()]
    assert got == brute_collocations(rows, 30, 50)


def test_suffixes_are_ordered():
    from glintframe.llm.exchange import Block

    r = random.Random(6)
    text = " ".join(r.choice("abc") + ("." if r.random() < 0.1 else "") for _ in range(400))
    data = np.frombuffer(text.encode(), np.uint8)
    s = collocations.Shard(Block(0, pa.array(["en"]), np.array([0, len(data)]), data, np.zeros(1)))
    tail = lambda p: tuple(s.ranks[1][p : p + s.room[p]])
    assert [tail(p) for p in s.suffixes] == sorted(tail(p) for p in range(len(s.codes)))
    for k, (p, q) in enumerate(zip(s.suffixes[:-1], s.suffixes[1:])):
        x, y = tail(p), tail(q)
        assert s.lcp[k] == next((i for i in range(5) if x[: i + 1] != y[: i + 1] or i == min(len(x), len(y))), 4)


# --- 13 forest, and 6 --------------------------------------------------------------------


def brute_components(rows, w, percent):
    sets = []
    for _, t in rows:
        x = words(lower(t or ""))
        sets.append(frozenset(tuple(x[i : i + w]) for i in range(len(x) - w + 1)) if len(x) >= w else frozenset([tuple(x)] if x else []))
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if i and 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
                up[root(a)] = root(b)
    least = defaultdict(list)
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[root(k)].append(d)
    return Counter((d, len(sets[k]), (min(least[root(k)]) if least[root(k)] else d) if sets[k] else d) for k, (d, _) in enumerate(rows))


def family(r, size, vocabulary, members, edits):
    first = [f"v{r.randrange(vocabulary)}" for _ in range(size)]
    out = [first]
    for _ in range(members - 1):
        w = list(r.choice(out))
        for _ in range(r.randrange(edits + 1)):
            w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
        out.append(w)
    return [" ".join(w) for w in out]


def near_rows():
    r = random.Random(21)
    rows = []
    for size, members, edits in ((5, 6, 1), (9, 8, 1), (30, 12, 3), (120, 30, 6), (400, 10, 25), (3, 5, 0)):
        for _ in range(4):
            rows += family(r, size, 10**6, members, edits)
    rows += ["", None, "  \t", "one", "One", "one two", "ONE  two", "one two three"] + [rows[40]] * 9
    r.shuffle(rows)
    return [(k if k % 11 else (k // 2 if k % 2 else None), t) for k, t in enumerate(rows)]


@pytest.mark.parametrize("operator,w,percent", [(forest.forest_join, 2, 80), (forest.forest_join, 5, 80), (partenum.similarity_join, 3, 90)])
def test_near_duplicates(spark, operator, w, percent):
    rows = near_rows()
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in operator(frame(spark, rows), w, percent).collect())
    assert got == brute_components(rows, w, percent)
    assert operator(frame(spark, rows).limit(0), w, percent).count() == 0


def test_crowded_regions(spark, monkeypatch):
    """One large family, small crowds, small units and shuffled keys: every phase of the linking takes part."""
    monkeypatch.setattr(forest, "CROWD", 3)
    monkeypatch.setattr(linking, "UNIT", 16)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    r = random.Random(23)
    rows = list(enumerate(family(r, 60, 10**6, 120, 4) + family(r, 60, 40, 40, 9)))
    want = brute_components(rows, 2, 80)
    for operator in (forest.forest_join, partenum.similarity_join):
        assert Counter((x["doc_id"], x["n_shingles"], x["component_id"]) for x in operator(frame(spark, rows, 5), 2, 80).collect()) == want


def test_kept(spark):
    rows = [(5, "a b c d"), (3, "a b c d"), (None, "a b c d"), (9, ""), (None, None)]
    got = Counter((r["doc_id"], r["component_id"], r["kept"]) for r in forest.forest_duplicates(frame(spark, rows)).collect())
    assert got == Counter([(5, 3, False), (3, 3, True), (None, 3, False), (9, 9, True), (None, None, True)])


def test_forest_finds_pairs_at_the_threshold():
    r = np.random.default_rng(5)
    found = 0
    for _ in range(60):
        pool = r.integers(0, 1 << 64, 110, dtype=np.uint64)
        a, b = pool[:99], np.concatenate([pool[:88], pool[99:110]])  # 88 shared of 110
        keys, inner, *_ = forest.entries([a, b])
        deep = [keys[:64] == keys[64:], (keys[:64] == keys[64:]) & (inner[:64] == inner[64:])]
        assert deep[0].any()
        found += deep[1].any()
    assert found >= 59


@pytest.mark.parametrize("text", ["one", "among others"])
def test_sets_of_very_long_texts(spark, text):
    r = random.Random(31)
    long = " ".join(f"{r.randrange(10**9):x}" for _ in range(600_000))
    rows = [(1, long)] + ([(2, long.replace(long[:6], "edited", 1)), (3, "short text of words")] if text != "one" else [])
    for operator, w, percent in ((partenum.similarity_join, 3, 90), (forest.forest_join, 2, 80)):
        got = {x["doc_id"]: x["component_id"] for x in operator(frame(spark, rows, 2), w, percent).collect()}
        assert got == ({1: 1, 2: 1, 3: 3} if text != "one" else {1: 1})


@pytest.mark.parametrize("n", [11, 12, 13])
def test_new_operators_are_registered(n):
    assert any(k.startswith(f"op{n}_") for k in queries.queries())


def test_collocation_sql(spark, tmp_path):
    import duckdb

    docs = spark.createDataFrame([(k, lang, t) for k, (lang, t) in enumerate(collocation_rows())], "doc_id long, lang string, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    names = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = c.sql(queries.oracle_sql()["op12_phrase_collocations"]).select(", ".join(names)).fetchall()
    got = [tuple(r) for r in queries.op12_phrase_collocations(spark, str(tmp_path)).select(*names).collect()]
    assert sorted(got) == sorted(want) and got
