"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
import string
from collections import defaultdict

import numpy as np
import xxhash

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def line_dedup(docs, min_chars=40, min_docs=5):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    held = defaultdict(set)
    for i, t in docs:
        if i is not None:
            for x in (t or "").split("\n"):
                if len(key(x)) >= min_chars:
                    held[key(x)].add(i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(key(x)) < min_chars or len(held[key(x)]) < min_docs or max(held[key(x)]) == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def components(nodes, linked):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def simhash(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]).encode(), 42) for i in range(max(1, len(words) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def suffix_dedup(docs, window=50):
    texts = [(i, (t or "").encode()) for i, t in docs]
    first = {}
    for i, b in texts:
        for p in range(len(b) - window + 1 if i is not None else 0):
            s = b[p : p + window]
            first[s] = min(i, first.get(s, i))
    out = []
    for i, b in texts:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - window + 1 if i is not None else 0):
            if first[b[p : p + window]] < i:
                gone[p : p + window] = True
        spans = np.flatnonzero(np.diff(gone.astype(int), prepend=0, append=0))
        out.append((i, bytes(np.frombuffer(b, np.uint8)[~gone]), len(b), int(gone.sum()), [(int(a), int(z)) for a, z in zip(spans[::2], spans[1::2])]))
    return out


def words(text):
    return re.findall(r"\w+", (text or "").lower())


def shingles(w, n=5):
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()
