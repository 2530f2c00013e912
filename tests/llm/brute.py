"""Plain helpers of the brute-force versions."""

import hashlib
import re

WORD = re.compile("[^\x20\x09-\x0d]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text):
    return WORD.findall(text or "")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def prose(r, n, vocabulary=300):
    base = ["alpha", "beta", "Gamma", "delta", "é", "zzz", "Ωmega", "tau."]
    return " ".join(r.choice(base) + str(r.randrange(vocabulary)) for _ in range(n))
