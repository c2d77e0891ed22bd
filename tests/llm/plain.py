"""Plain, quadratic versions of the operators."""

import hashlib
import re

import numpy as np
import xxhash

SPACE = re.compile(rb"[^\x20\x09-\x0D]+")
BENCH = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return SPACE.findall((text or "").encode())


def shingles(text, size):
    w = words((text or "").encode().lower().decode())
    if not w:
        return []
    return [b" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] or [b" ".join(w)]


def simhash(text, size):
    s = [xxhash.xxh64_intdigest(x, 42) for x in shingles(text, size)]
    return sum((2 * sum(h >> b & 1 for h in s) > len(s)) << b for b in range(64)) if s else 0


def closure(n, linked):
    label = list(range(n))
    for _ in range(n):
        moved = False
        for i in range(n):
            for j in range(i):
                if label[i] != label[j] and linked(i, j):
                    low, high = sorted((label[i], label[j]))
                    label = [low if x == high else x for x in label]
                    moved = True
        if not moved:
            break
    return label


def repeated(docs, n):
    """Positions by place in ``docs`` (id, text) that are covered by a window that starts earlier elsewhere."""
    first = {}
    w = [words(t) for _, t in docs]
    for k, (i, _) in enumerate(docs):
        for s in range(len(w[k]) - n + 1):
            if i is not None:
                key = tuple(w[k][s : s + n])
                first[key] = min(first.get(key, (i, s)), (i, s))
    out = []
    for k, (i, _) in enumerate(docs):
        gone = set()
        for s in range(len(w[k]) - n + 1):
            if i is not None and first[tuple(w[k][s : s + n])] != (i, s):
                gone.update(range(s, s + n))
        out.append(gone)
    return out


def kept(text, gone):
    return b" ".join(x for k, x in enumerate(words(text)) if k not in gone)


def bench_words(text):
    return BENCH.findall((text or "").encode().lower())


def hits(text, items, n=10):
    w = bench_words(text)
    cover, names = set(), set()
    for i, t in items:
        x = bench_words(t)
        k = min(n, len(x))
        grams = {tuple(x[s : s + k]) for s in range(len(x) - k + 1)} if k else set()
        for s in range(len(w) - k + 1) if k else ():
            if tuple(w[s : s + k]) in grams:
                cover.update(range(s, s + k))
                names.add(str(i))
    return len(w), len(cover), sorted(names)


def sha(data):
    return hashlib.sha256(data).hexdigest()


def bits(a, b):
    return int(np.bitwise_count(np.frombuffer(a, np.uint64) ^ np.frombuffer(b, np.uint64)).sum())
