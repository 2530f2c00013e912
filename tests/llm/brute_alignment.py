"""Brute force of the tokenizer alignment: whole texts, no segments."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from glintframe.llm.alignment import byte_level


def align(rows):
    """By row of (doc_id, text): the columns of the registered query."""
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    table = byte_level()
    count, docs = Counter(), []
    for doc_id, text in rows:
        whole = b" " + (text or "").encode()
        x = [(i, bytes(table[c] for c in a.id_to_token(i))) for i in (a.encode(" " + text, add_special_tokens=False).ids if text else [])]
        y = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in (b.encode(text) if text else [])]
        if not text or b"".join(t for _, t in x) != whole or b"".join(t for _, t in y) != whole:
            docs.append((doc_id, [], [], []))
            continue
        ends, at = [], 0
        for part in (x, y):
            at, own = 0, []
            for _, t in part:
                at += len(t)
                own.append(at)
            ends.append(own)
        both = sorted(set(ends[0]) & set(ends[1]))
        groups, i, j = [], 0, 0
        for e in both:
            g, h = [], []
            while i < len(x) and ends[0][i] <= e:
                g.append(x[i][0])
                i += 1
            while j < len(y) and ends[1][j] <= e:
                h.append(y[j][0])
                j += 1
            groups.append((g, h))
        links = [(p, q) for g, h in groups for p in g for q in h]
        count.update(set(links))
        docs.append((doc_id, groups, links, [len(x), len(y)]))
    best = defaultdict(int)
    for (p, _), n in count.items():
        best[p] = max(best[p], n)
    out = []
    for doc_id, groups, links, sizes in docs:
        if not groups:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        shown = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((doc_id, *sizes, len(groups), len(links), sum(count[k] == best[k[0]] for k in links), sum(count[k] for k in links), hashlib.sha256(shown.encode()).hexdigest()))
    return out
