import base64
import gzip
import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from brute import lower, prose, sha, words

from glintframe.llm import anchors, bpe, common, decontaminate, exchange, imi, langid, partenum, pst, quality_gam, rlz, suffix_dedup, warc


def collect(df, key="doc_id"):
    out = defaultdict(list)
    for r in df.collect():
        out[r[key]].append(r)
    return out


# --- shared parts ------------------------------------------------------------------------


def test_pack_and_order():
    r = np.random.default_rng(0)
    for n in (0, 1, 7, 5000):
        for high in (1, 2, 300, 1 << 40, (1 << 64) - 1):
            x = r.integers(0, high, n, dtype=np.uint64, endpoint=True)
            assert (exchange.unpack(exchange.pack(x)) == x).all() and (exchange.unpack(exchange.pack(np.sort(x), True)) == np.sort(x)).all()
            o = exchange.order_of(x)
            assert (x[o] == np.sort(x)).all() and len(set(o.tolist())) == n


def test_words_and_windows():
    texts = ["a bb\tccc", "", "dd", " e ", "f"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.cumsum([0, *map(len, texts)])
    s, e, first = common.word_bounds(data, off)
    assert [bytes(data[a:b]).decode() for a, b in zip(s, e)] == ["a", "bb", "ccc", "dd", "e", "f"] and first.tolist() == [0, 3, 3, 4, 5, 6]
    at, _ = common.window_hashes(common.word_hashes(data, s, e), first, 2)
    assert at.tolist() == [0, 1]


def test_anchor_depends_on_content_only():
    r = np.random.default_rng(1)
    shared = r.integers(0, 4, 500, dtype=np.uint8)
    a, b = (np.concatenate([r.integers(0, 4, n, dtype=np.uint8), shared, r.integers(0, 4, 50, dtype=np.uint8)]) for n in (33, 140))
    found = []
    for x, shift in ((a, 33), (b, 140)):
        at, place, grams, _ = anchors.anchored(common.byte_codes(x), np.array([0, len(x)]), 60, 20)
        found.append({int(s - shift): (int(p - shift), int(grams[p])) for s, p in zip(at, place) if shift <= s <= shift + 440})
    assert found[0] == found[1] and len(found[0]) == 441


# --- 1 WARC ------------------------------------------------------------------------------


def test_warc(spark):
    html = '<!DOCTYPE html><html lang="FR"><head><title>A &amp; b</title><script>var t="</p>";</script></head><body><p>One<br>two &lt;x&gt;</p><a href="/l?a=1&amp;b=2" title="a > b">link</a><!-- no --><div>end'
    pages = spark.createDataFrame([(1, "http://a/", html), (2, None, None), (3, "http://b/", ""), (1, "http://a/", html)], "page_id long, url string, html string")
    out = warc.derive(warc.page_responses(pages)).collect()
    assert len(out) == 8
    con = [r for r in out if r["record_type"] == "conversion" and r["target_uri"] == "http://a/"]
    assert bytes(con[0]["block"]).decode() == "A & b\nOne\ntwo <x>\nlink\nend" and con[0]["record_id"] == con[1]["record_id"]
    meta = next(r for r in out if r["record_type"] == "metadata" and r["target_uri"] == "http://a/")
    assert bytes(meta["block"]).decode().split("\r\n") == ["content-type: text/html; charset=utf-8", "html-lang: fr", "title: A & b", "outlink: /l?a=1&b=2", ""]
    source = {r["record_id"]: r for r in warc.page_responses(pages).collect()}
    for r in out:
        assert r["refers_to"] in source and [tuple(h) for h in r["headers"]] == [tuple(h) for h in source[r["refers_to"]]["headers"]]
        assert r["block_digest"] == "sha1:" + base64.b32encode(hashlib.sha1(bytes(r["block"])).digest()).decode()
        assert r["payload_digest"] == warc.digest(bytes(source[r["refers_to"]]["block"]))
    assert warc.derive(warc.page_responses(pages.limit(0))).count() == 0


def test_warc_files(spark, tmp_path):
    pages = spark.createDataFrame([("http://a/", "<p>caf&eacute;</p>")], "url string, html string")
    records = warc.derive(warc.page_responses(pages))
    (tmp_path / "x.warc.gz").write_bytes(b"".join(bytes(r["warc"]) for r in warc.with_bytes(records).collect()))
    back = {r["record_id"]: r for r in warc.read_warc(spark, str(tmp_path)).collect()}
    for r in records.collect():
        assert all(back[r["record_id"]][c] == r[c] for c in ("record_type", "refers_to", "block", "block_digest", "payload_digest", "content_type", "headers"))
    body = "<p>é</p>".encode("latin-1")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=ISO-8859-1\r\nServer: s\r\n\r\n" + body
    raw = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x>\r\nWARC-Target-URI: http://c/\r\nWARC-Date: d\r\nContent-Length: %d\r\n\r\n" % len(http) + http + b"\r\n\r\n"
    (tmp_path / "y.warc").write_bytes(gzip.compress(raw))
    got = [r for r in warc.derive(warc.read_warc(spark, str(tmp_path / "y.warc"))).collect() if r["record_type"] == "conversion"]
    assert bytes(got[0]["block"]).decode() == "é" and [h["name"] for h in got[0]["headers"]] == ["Content-Type", "Server"] and got[0]["refers_to"] == "<urn:x>"


# --- 2 decontamination -------------------------------------------------------------------


def plain(text):
    import re

    return re.findall("[a-z0-9\x80-\U0010ffff]+", (text or "").lower())


def shingles(w):
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []


def similarity(a, b):
    return sum((a & b).values()) / sum((a | b).values())


def brute_contamination(docs, items):
    out = {}
    for d, t in docs:
        s = shingles(plain(t))
        for i, u in items:
            own = Counter(shingles(plain(u)))
            size = sum(own.values())
            if not s or not size:
                continue
            m = min(size, len(s))
            x = [similarity(Counter(s[a : a + m]), own) for a in range(len(s) - m + 1)]
            good = [k for k, v in enumerate(x) if v >= 0.8]
            if good:
                out[d, i] = (len(good), round(max(x), 9), good[0])
    return out


def test_contamination(spark):
    r = random.Random(3)
    items = [(i, prose(r, n)) for i, n in enumerate([3, 5, 15, 30, 60, 60])] + [(6, None), (7, ""), (8, "same same same same same same same same")]
    docs = [(0, None), (1, ""), (2, items[0][1]), (3, "same " * 30)]
    for i in range(4, 60):
        w = prose(r, r.randrange(60)).split()
        p = items[r.randrange(6)][1].upper().split()
        for _ in range(r.choice([0, 0, 1, 2, 4])):
            p[r.randrange(len(p))] = "edit"
        docs.append((i, " ".join(w[: len(w) // 2] + p + w[len(w) // 2 :])))
    df = spark.createDataFrame([(*x, "c") for x in docs + docs[:5]], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = collect(decontaminate.contaminated_documents(df, bench))
    flat = {(k, r["item_id"]): (r["n_windows"], r["similarity"], r["first_word"]) for k, v in got.items() for r in v}
    want = brute_contamination(docs, items)
    assert flat == want and len(want) > 20 and len(got[2]) == 2 * len({k for k in want if k[0] == 2})
    kept = {r["doc_id"] for r in decontaminate.without_contaminated(df, bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in want}
    assert decontaminate.contamination(df.limit(0), bench).count() == 0 and decontaminate.contamination(df, bench.limit(0)).count() == 0


def test_hamming_index_misses_nothing():
    r = np.random.default_rng(0)
    e = r.integers(0, 1 << 63, (300, 2), dtype=np.uint64)
    q = e[r.integers(0, 300, 200)].copy()
    for row in q:
        for b in r.choice(128, r.integers(0, 60), replace=False):
            row[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    apart = np.array([[sum(int(x).bit_count() for x in a ^ b) for b in e] for a in q])
    got = set(zip(*(x.tolist() for x in decontaminate.MultiIndex(e).within(q))))
    assert got == set(zip(*(x.tolist() for x in np.nonzero(apart <= decontaminate.RADIUS)))) and len(got) > 50
    assert sum(t + 1 for t in decontaminate.NEAR) == decontaminate.RADIUS + 1
    r = np.random.default_rng(1)
    q, _ = decontaminate.MultiIndex(e).candidates(r.integers(0, 1 << 63, (200, 2), dtype=np.uint64))
    assert len(q) < 0.3 * 200 * len(e)  # unrelated pairs that the probes meet


def test_similarities_of_all_windows():
    r = random.Random(4)
    for _ in range(60):
        s, own = [r.randrange(12) for _ in range(r.randrange(1, 60))], Counter(r.randrange(12) for _ in range(r.randrange(1, 20)))
        m = min(sum(own.values()), len(s))
        kinds = np.array(sorted(own), np.uint64)
        got = decontaminate.similarities(np.array(s, np.uint64), m, kinds, np.array([own[int(k)] for k in kinds]))
        assert got.tolist() == [similarity(Counter(s[a : a + m]), own) for a in range(len(s) - m + 1)]


def test_fingerprints_stay_within_the_radius():
    """At similarity 0.8 and more, fingerprints differ by more than the radius next to never."""
    r = np.random.default_rng(2)
    far = 0
    for _ in range(400):
        n = int(r.integers(10, 80))
        a = r.integers(0, 1 << 63, n, dtype=np.uint64)
        b = a.copy()
        b[: int(n * 0.11)] = r.integers(0, 1 << 63, int(n * 0.11), dtype=np.uint64)
        x, y = (decontaminate.fingerprints(s, np.zeros(1, np.int64), n)[0] for s in (a, b))
        far += sum(int(v).bit_count() for v in x ^ y) > decontaminate.RADIUS
    assert far == 0


# --- 3 nearest neighbours ----------------------------------------------------------------


def test_nearest(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(900, 16))
    rows = [(i, [float(v) for v in x[i]]) for i in range(900)] + [(900 + i, [float(v) for v in x[7]]) for i in range(60)]
    rows += [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [None] * 16), (2080, [1.0, 2.0]), (2100, [float("inf")] * 16), rows[3]]
    got = collect(imi.nearest(spark.createDataFrame([(*t, "c") for t in rows], "vec_id long, embedding array<double>, q string"), "vec_id % 20 = 0"), "query_id")
    ok = {i: np.array(v) for i, v in rows if i < 2000}
    ids = np.array(sorted(ok))
    e = np.stack([ok[i] for i in ids])
    assert set(got) == {i for i in ok if i % 20 == 0}
    hit = 0
    for q, found in got.items():
        found.sort(key=lambda f: f["rank"])
        assert [f["rank"] for f in found] == list(range(1, 21)) and q not in {f["vec_id"] for f in found}
        s = e @ ok[q]
        for f in found:
            assert f["score"] == pytest.approx(float(ok[q] @ ok[f["vec_id"]]))
        assert [(-f["score"], f["vec_id"]) for f in found] == sorted((-f["score"], f["vec_id"]) for f in found)
        order = [i for i in ids[np.lexsort((ids, -s.round(12)))] if i != q][:20]
        hit += len(set(order) & {f["vec_id"] for f in found})
    assert hit / (20 * len(got)) >= 0.9
    few = imi.nearest(spark.createDataFrame(rows[:5], "vec_id long, embedding array<double>"), "vec_id = 0").collect()
    assert len(few) == 4
    assert imi.nearest(spark.createDataFrame([], "vec_id long, embedding array<double>"), "true").count() == 0


def test_heap_visits_pairs_in_order():
    r = np.random.default_rng(0)
    books = imi.Codebooks(r.normal(size=(5, 2)), r.normal(size=(6, 2)))
    a, b, held = r.random(5), r.random(6), r.integers(0, 4, 30)
    order = np.argsort((a[:, None] + b).ravel())
    for enough in (1, 10, 30, 1000):
        seen = books.visit(a, b, held, enough)
        n = int(seen.sum())
        assert set(np.flatnonzero(seen)) == set(order[:n]) and (held[order[:n]].sum() >= enough or n == 30) and (n == 0 or held[order[: n - 1]].sum() < enough)


def test_shards_hold_cells_and_only_visited_cells_are_multiplied():
    r = np.random.default_rng(3)
    held = np.array([0, 3, 5, 40, 0, 1, 9, 2, 0])
    shards = imi.Shards.of(held, most=10)
    cell = np.repeat(np.arange(9), held)
    at = shards.place(cell, np.arange(len(cell)))
    assert (shards.low[at] <= cell).all() and (cell < shards.high[at]).all() and len(set(at[cell == 3])) == 4 and shards.count.tolist() == [1, 1, 1, 4, 1, 1, 1, 1, 1]
    assert all(np.bincount(at[cell != 3]) <= 10)
    q, e, seen = r.normal(size=(6, 4)), r.normal(size=(len(cell), 4)), r.random((6, 9)) < 0.4
    score, n = imi.visited_scores(q, seen, e, cell)
    assert n == seen[:, cell].sum() and np.allclose(score, np.where(seen[:, cell], q @ e.T, -np.inf))


# --- 4 language model --------------------------------------------------------------------


def brute_tree(rows, trains):
    tok = [[*words(lower(t or "")), None] for _, t in rows]
    c1, c2, c3, n1, n2 = Counter(), Counter(), Counter(), Counter(), Counter()

    def contexts(ts):
        for i, w in enumerate(ts):
            yield w, ts[i - 1] if i else "<s>", None if i == 0 else ts[i - 2] if i > 1 else "<s>"

    for ts, on in zip(tok, trains):
        for w, a, b in contexts(ts) if on else ():
            c1[w] += 1
            c2[a, w] += 1
            n1[a] += 1
            if b is not None:
                c3[b, a, w] += 1
                n2[b, a] += 1
    n, v = sum(c1.values()), len(c1)
    p0 = lambda w: (c1[w] + 1) / (n + v + 1)
    p1 = lambda a, w: (c2[a, w] + pst.PRIOR_ONE * p0(w)) / (n1[a] + pst.PRIOR_ONE)
    gain = lambda c, m, p, prior: c * (math.log((c - 1 + prior * p) / (m - 1 + prior)) - math.log(p))
    d1, d2 = defaultdict(float), defaultdict(float)
    for (a, w), c in c2.items():
        if n1[a] >= pst.LEAST_ONE:
            d1[a] += gain(c, n1[a], p0(w), pst.PRIOR_ONE)
    par = lambda a, w: p1(a, w) if d1.get(a, 0) > pst.MARGIN else p0(w)
    for (b, a, w), c in c3.items():
        if n2[b, a] >= pst.LEAST_TWO:
            d2[b, a] += gain(c, n2[b, a], par(a, w), pst.PRIOR_TWO)
    out = []
    for ts in tok:
        score = 0.0
        for w, a, b in contexts(ts):
            p = par(a, w)
            if b is not None and d2.get((b, a), 0) > pst.MARGIN:
                p = (c3[b, a, w] + pst.PRIOR_TWO * p) / (n2[b, a] + pst.PRIOR_TWO)
            score += math.log10(p)
        out.append((len(ts), sum(c1[w] > 0 for w in ts), n, sum(math.log10(p0(w)) for w in ts), score))
    return out, sum(x > pst.MARGIN for x in d1.values()), sum(x > pst.MARGIN for x in d2.values())


def test_suffix_tree(spark, corpus):
    r = random.Random(1)
    rows = corpus + [(100 + i, " ".join(r.choice(["a b c", "a b d", "x b e"]) for _ in range(30))) for i in range(30)] + [(5, corpus[5][1]), (None, "a b c")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = collect(pst.suffix_tree_scores(df, "coalesce(doc_id, 1) % 7 <> 2"))
    want, ones, twos = brute_tree(rows, [(1 if d is None else d) % 7 != 2 for d, _ in rows])
    assert ones > 3 and twos > 1
    for (d, _), x in zip(rows, want):
        r = got[d][0]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == x[:3] and r["base_score"] == pytest.approx(x[3]) and r["score"] == pytest.approx(x[4], rel=1e-6)
    assert pst.suffix_tree_scores(df.limit(0), "true").count() == 0 and all(x["score"] == 0 for v in collect(pst.suffix_tree_scores(df, "false")).values() for x in v)


# --- 5 language identification -----------------------------------------------------------


def test_language_id(spark):
    r = random.Random(0)
    sound = {"aa": "aeiou", "bb": "bcdfg", "cc": "äöüßñ"}
    text = lambda k: " ".join("".join(r.choice(sound[k] + "xyz") for _ in range(r.randrange(2, 9))) for _ in range(r.randrange(5, 120)))
    rows = [(i, text(k := r.choice(list(sound))), k) for i in range(240)] + [(900, None, "aa"), (901, "", "aa"), (902, "12 !?", "bb"), (903, text("aa"), None)]
    got = collect(langid.language_of_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    assert all(got[i][0]["lang_pred"] == "und" and got[i][0]["score"] == 0 for i in (900, 901, 902))
    held = [(got[i][0], k) for i, _, k in rows[:240] if got[i][0]["held_out"]]
    assert np.mean([r["lang_pred"] == k for r, k in held]) > 0.95 and all(0 <= r["score"] <= 1 for r, _ in held) and len(held) > 40
    none = langid.language_of_documents(spark.createDataFrame(rows[:5], "doc_id long, text string, lang string").selectExpr("doc_id", "text", "cast(null as string) lang")).collect()
    assert {r["lang_pred"] for r in none} == {"und"}


def test_cnn_tables_equal_convolution():
    r = np.random.default_rng(0)
    m = langid.ByteCnn.fresh(["a", "b", "c"])
    x = r.integers(0, 256, (5, langid.WINDOW)).astype(np.uint8)
    h = np.concatenate([np.maximum((m._unfold(x, k) @ m.weights[f"filter{k}"] + m.weights[f"bias{k}"]).max(1), 0) for k in langid.WIDTHS], 1)
    want = np.log(langid._softmax(h @ m.weights["dense"] + m.weights["out"]))
    assert np.allclose(m.log_probabilities(x, m.tables()), want, atol=1e-4)


def test_langid_learns_every_language(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 2, raising=False)  # the bound there was
    rows = [(i, f"word {i}", lang) for i, lang in enumerate(["a"] * 60 + ["b"] * 30 + ["c"] * 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for most in (4_000, 30, 1):
        assert langid.train_langid(df, max_labelled=most).classes == ["a", "b", "c"]


def brute_language(model, text):
    """Window by window and filter by filter, in plain loops."""
    w, data = model.weights, (text or "").encode()
    total = np.zeros(len(model.classes))
    for at in range(0, len(data), langid.WINDOW):
        part = data[at : at + langid.WINDOW]
        e = w["embed"][np.frombuffer(part.ljust(langid.WINDOW, b"\0"), np.uint8)]
        h = [max(0, max(float(e[i : i + k].ravel() @ w[f"filter{k}"][:, f] + w[f"bias{k}"][f]) for i in range(langid.WINDOW - k + 1))) for k in langid.WIDTHS for f in range(len(w["bias2"]))]
        z = np.array(h) @ w["dense"] + w["out"]
        total += len(part) * (z - z.max() - math.log(np.exp(z - z.max()).sum()))
    p = np.exp(total / max(1, len(data)))
    p /= p.sum()
    return (model.classes[int(p.argmax())], float(p.max())) if any(c.isalpha() for c in text or "") else ("und", 0.0)


def test_language_equals_brute_force(spark):
    r = random.Random(6)
    model = langid.ByteCnn.fresh(["a", "b", "c"], seed=2)
    rows = [(i, prose(r, r.choice([1, 30, 90]))) for i in range(6)] + [(10, None), (11, "\u00b2 \u00bd \u2167 12"), (12, "\u03a9"), (13, "")]
    got = collect(langid.identify(spark.createDataFrame(rows, "doc_id long, text string"), model))
    for d, t in rows:
        name, score = brute_language(model, t)
        assert got[d][0]["lang_pred"] == name and got[d][0]["score"] == pytest.approx(score, abs=1e-4)


# --- 6 similarity join -------------------------------------------------------------------


def brute_join(rows, n, percent):
    sets = []
    for _, t in rows:
        w = words(lower(t or ""))
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b, k = sets[j], len(a & sets[j])
            if k and 100 * k >= percent * (len(a) + len(b) - k):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [(d, len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(rows)]


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80)])
def test_similarity_join(spark, corpus, n, percent, monkeypatch):
    rows = corpus + [(30, corpus[30][1]), (None, corpus[30][1]), (None, "alone in here")]
    monkeypatch.setattr(partenum, "CROWD", 6)  # so that crowds, too, are met
    df = spark.createDataFrame([(*x, "c") for x in rows], "doc_id long, text string, label string")
    got = sorted((tuple(r) for r in partenum.similarity_join(df, n, percent).collect()), key=repr)
    assert got == sorted(brute_join(rows, n, percent), key=repr)
    assert partenum.similarity_join(df.limit(0), n, percent).count() == 0


@pytest.mark.parametrize("percent", [80, 90])
def test_similar_sets_share_a_signature(percent):
    r = np.random.default_rng(0)
    bands = partenum.Bands(percent)
    for _ in range(300):
        n = int(r.choice([2, 9, 12, 25, 40, 90, 300, 900]))
        a = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
        swap = int(r.integers(0, bands.most(n, n) // 2 + 1))
        b = np.unique(np.concatenate([a[swap:], r.integers(0, 1 << 63, swap, dtype=np.uint64)]))
        inter = len(np.intersect1d(a, b))
        if 100 * inter < percent * (len(a) + len(b) - inter):
            continue
        sig, vertex, part, light, spare = partenum.signatures([a, b], bands)
        bad = partenum._parts_of(light, vertex, part, 2)
        keep = ~light | (bad[vertex, part >> 32] > spare[vertex, part >> 32])
        assert np.intersect1d(sig[keep & (vertex == 0)], sig[keep & (vertex == 1)]).size
        apart = sum(int(x).bit_count() for x in (partenum.sketch(a) ^ partenum.sketch(b)).view(np.uint64))
        assert apart <= len(np.setxor1d(a, b))


def test_light_and_crowded_parts_count_together():
    seen = 0
    for n in range(92, 161):
        data = np.frombuffer(" ".join(f"w{n}x{k}" for k in range(n)).encode(), np.uint8)
        block = exchange.Block(0, pa.array([1]), np.array([0, len(data)]), data, np.zeros(1, np.int64))
        bands = partenum.Bands(80)
        sets = partenum.vertices(block, 1)[3]
        _, vertex, part, light, spare = partenum.signatures(sets, bands)
        weak, spare = np.unique(part[light & (part >> 32 == 0)]), int(spare[0, 0])
        if not 0 < len(weak) <= spare:
            continue
        seen += 1
        sig, _, of = partenum._of_block(block, 1, bands)[4:7]
        other = [k for k in range(bands.plan(bands.of(n)).parts) if k not in weak]
        for crowded, joins in ((spare, True), (spare - len(weak), False)):  # beyond what the set can spare, and within
            told = {1: [2 * np.isin(of, other[:crowded]).astype(np.uint64)]}
            crowds = partenum._apply(1, 80)(block, told, {}).column("crowds")[0].as_py()
            assert bool(crowds) == joins
    assert seen > 3


# --- 7 byte-level BPE --------------------------------------------------------------------


def test_bpe_equals_tiktoken(spark, corpus):
    import public_tokenizers
    import tiktoken

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    ranks = bpe.read_ranks(path)
    reference = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(0)
    odd = ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(0xD800), r.randrange(0xE000, 0x110000), 0x1C, 0x85, 0xA0, 0x5F, 0xB2, 10, 32])) for _ in range(30)) for _ in range(300)]
    rows = corpus + [(1000 + i, t) for i, t in enumerate([*odd, "don't  stop\n\n 12²", "a" * 5000, "<|endoftext|>", "Ⅷ_x ​ 👍🏽"])]
    df = spark.createDataFrame([(*x, "c") for x in rows], "doc_id long, text string, ids string")
    got = collect(bpe.byte_bpe(df, path, pattern))
    for d, t in rows:
        assert got[d][0]["ids"] == reference.encode_ordinary(t or "") and bytes(got[d][0]["decoded"]).decode() == (t or "")
    digests = collect(bpe.byte_bpe_digests(df, path, pattern))
    for d, t in rows[:20]:
        ids = reference.encode_ordinary(t or "")
        assert tuple(digests[d][0][1:]) == (len(ids), sha(" ".join(map(str, ids))), sha(t or ""))
    assert bpe.byte_bpe(df.limit(0), path, pattern).count() == 0


# --- 8 suffix dedup ----------------------------------------------------------------------


def brute_suffix(rows, window):
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i : i + window] for b in raw for i in range(len(b) - window + 1))
    out = []
    for (d, _), b in zip(rows, raw):
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - window + 1):
            if seen[b[i : i + window]] > 1:
                gone[i : i + window] = True
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0]) if len(b) else 0
        out.append((d, len(b), int(gone.sum()), runs, sha(bytes(np.frombuffer(b, np.uint8)[~gone[:-1]]))))
    return out


def test_suffix_dedup(spark, corpus):
    rows = corpus + [(60, corpus[20][1]), (None, corpus[22][1])]
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, kept int")
    got = sorted((tuple(r) for r in suffix_dedup.suffix_digests(df).collect()), key=repr)
    assert got == sorted(brute_suffix(rows, 400), key=repr)
    assert suffix_dedup.suffix_dedup(df.limit(0)).count() == 0


def test_hubs_change_nothing(spark, corpus, monkeypatch):
    """The same results where blocks ask by hubs, in n * sqrt(n) messages and not n * n."""
    rows = corpus + [(7, "one id on very many rows " * 20)] * 400
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, kept int").repartition(2)
    monkeypatch.setattr(exchange, "block_count", lambda *_: 30)
    corpus_ = exchange.Corpus(df)
    sizes = [r["n"] for r in corpus_._each(lambda block, told, sums: pa.table({"n": [len(block.ids)]}), "n bigint").collect()]
    assert sum(sizes) == len(rows) and max(sizes) < 200  # 400 equal rows are not one block's
    results, messages = [], []
    for direct in (4096, 4):
        monkeypatch.setattr(exchange, "DIRECT", direct)
        messages.append(exchange.Corpus(df).round(1, pst._ask_counts, pst._sum_answer).count())
        results.append([sorted(map(tuple, f(df).collect()), key=repr) for f in (suffix_dedup.suffix_digests, rlz.rlz_digests, partenum.near_duplicates)])
        results[-1].append(sorted(((r["doc_id"], r["n_known"], r["train_tokens"], round(r["score"], 9)) for r in pst.language_model_scores(df).collect()), key=repr))
    assert results[0] == results[1] and messages[0] == len(sizes) * 30 and messages[1] <= 6 * 5 * 6


def test_suffix_dedup_of_words(spark, corpus):
    rows = [(d, t) for d, t in corpus if d >= 6]
    got = collect(suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"), window=20, words=True))
    w = {d: words(t) for d, t in rows}
    seen = Counter(tuple(x[i : i + 20]) for x in w.values() for i in range(len(x) - 19))
    for d, x in w.items():
        gone = {k for i in range(len(x) - 19) if seen[tuple(x[i : i + 20])] > 1 for k in range(i, i + 20)}
        assert words(bytes(got[d][0]["kept"]).decode()) == [v for k, v in enumerate(x) if k not in gone]


# --- 9 quality ---------------------------------------------------------------------------


def test_quality(spark, docs):
    r = random.Random(0)
    good = lambda: prose(r, r.randrange(20, 90), 10_000)
    bad = lambda: " ".join(w.upper() + "!!" for w in prose(r, r.randrange(5, 30)).split()) if r.random() < 0.5 else "same words again. " * r.randrange(5, 30)
    rows = [(i, good() if (y := int(r.random() < 0.7)) else bad(), y) for i in range(400)]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5, None), (6, 9), (7, rows[7][2])], "doc_id long, quality int")
    got = collect(quality_gam.quality_scores(df, labels))
    held = [(got[i][0], y) for i, _, y in rows if got[i][0]["held_out"]]
    assert np.mean([x["predicted"] == y for x, y in held]) > 0.95 and len(held) > 40
    assert got[900][0]["score"] == got[901][0]["score"] and 0 <= got[900][0]["score"] <= 1
    flat = quality_gam.quality_scores(df, labels.limit(0)).collect()
    assert {x["score"] for x in flat} == {0.5}
    kept = quality_gam.with_quality(docs, quality_gam.Gam())
    assert kept.columns == [*docs.columns, "quality_score"] and kept.count() == docs.count()


def test_quality_equals_brute_force(spark):
    """Features counted in plain Python, bins looked up one by one and added."""
    import re

    def count(text):
        b = (text or "").encode()
        w, lines = words(text), [x for x in re.findall(rb"[^\n]*\n?", b) if x]
        low = [lower(x) for x in w]
        share = lambda chars, of: sum(b.count(c.encode()) for c in chars) / max(of, 1)
        letters = sum(chr(c).isalpha() and c < 128 for c in b)
        plain = lambda c: c > 127 or chr(c).isalnum() or chr(c) in ".,;:?\"')-"
        triples = {tuple(low[i : i + 3]) for i in range(len(w) - 2)}
        return [
            math.log1p(len(b)), share("ABCDEFGHIJKLMNOPQRSTUVWXYZ", letters), share("#$%&*+<=>@\\^_`{}~/", len(b)), share("!", len(b)), share("|", len(b)), share("0123456789", len(b)),
            share(" \t\n\v\f\r", len(b)), share(".,;:?", len(b)), sum(c > 127 for c in b) / max(1, len(b)), sum(len(x.encode()) for x in w) / max(1, len(w)), math.log1p(len(w)),
            len(set(low)) / max(1, len(w)), len(triples) / (len(w) - 2) if len(w) > 2 else 1, len(set(lines)) / max(1, len(lines)), sum(not plain(x.encode()[-1]) for x in w) / max(1, len(w)),
        ]

    r = random.Random(2)
    texts = [None, "", "x", "Ab|c! #1\n\nAb|c! #1\n"] + [prose(r, r.randrange(1, 60)).replace(" ", r.choice([" ", "\n", "! "])) for _ in range(40)]
    x = np.array([count(t) for t in texts])
    model = quality_gam.fit_gam(x, (x[:, 10] > 3).astype(float))
    assert model.pairs and np.allclose(quality_gam.text_features(pa.array(texts)), x)
    for row, s in zip(x, collect(quality_gam.with_quality(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model)).items()):
        total = model.intercept + sum(t[sum(e <= v for e in edges)] for edges, t, v in zip(model.edges, model.tables, row))
        total += sum(t[sum(e <= row[i] for e in model.coarse[i]), sum(e <= row[j] for e in model.coarse[j])] for (i, j), t in zip(model.pairs, model.pair_tables))
        assert s[1][0]["quality_score"] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, total)))))


def test_gam_learns_an_interaction():
    r = np.random.default_rng(0)
    x = r.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = quality_gam.fit_gam(x[:3000], y[:3000])
    assert m.pairs[0] in ((1, 0), (0, 1)) and ((m.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95
    assert len(quality_gam.fit_gam(x[:0], y[:0]).score(x)) == 4000


# --- 10 relative Lempel-Ziv --------------------------------------------------------------


def test_rlz(spark, corpus):
    rows = corpus + [(30, corpus[30][1]), (None, corpus[30][1])]
    first = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - 12):
            if d is not None:
                k = tuple(w[i : i + 13])
                first[k] = min(first.get(k, d), d)
    want = []
    for d, t in rows:
        w = words(t)
        gone = {k for i in range(len(w) - 12) if d is not None and first[tuple(w[i : i + 13])] < d for k in range(i, i + 13)}
        want.append((d, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    df = spark.createDataFrame([(*x, "c") for x in rows], "doc_id long, text string, kept string")
    assert sorted((tuple(r) for r in rlz.rlz_digests(df).collect()), key=repr) == sorted(want, key=repr)
    spans = collect(rlz.rlz_dedup(df))[95][0]["spans"]
    assert spans and all(s["words"] >= 13 and s["reference"] < 95 for s in spans)
    text = dict(corpus)
    for d, found in collect(rlz.rlz_dedup(df.where("doc_id <> 30"))).items():
        own, covered = words(text.get(d)), set()
        for f in found[0]["spans"] if d is not None else []:  # every factor stands in its reference, at its place
            assert f["reference"] < d and own[f["start"] : f["start"] + f["words"]] == words(text[f["reference"]])[f["place"] : f["place"] + f["words"]]
            covered |= set(range(f["start"], f["start"] + f["words"]))
        assert len(covered) == found[0]["n_removed"]
    assert rlz.rlz_dedup(df.limit(0)).count() == 0


def test_factors_break_where_the_reference_does():
    at, ref = np.array([3, 4, 5, 6, 7, 20]), np.array([1, 1, 1, 1, 2, 2])
    got = rlz.factors(at, ref, np.array([10, 11, 40, 41, 42, 0]))
    assert [(f["start"], f["words"], f["reference"], f["place"]) for f in got] == [(3, 14, 1, 10), (5, 14, 1, 40), (7, 13, 2, 42), (20, 13, 2, 0)]
