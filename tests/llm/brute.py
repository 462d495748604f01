"""Plain versions of what the operators return, for small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def decontaminate(docs, items, size=10):
    wins = defaultdict(set)
    for item, text in items:
        w = ALNUM.findall(lower(text or ""))
        for s in range(max(len(w) - size + 1, min(1, len(w)))):
            wins[tuple(w[s:s + size])].add(str(item))
    lengths = {len(w) for w in wins}
    out = []
    for doc, text in docs:
        w = ALNUM.findall(lower(text or ""))
        hit, which = set(), set()
        for n in lengths:
            for s in range(len(w) - n + 1):
                if (key := tuple(w[s:s + n])) in wins:
                    hit |= set(range(s, s + n))
                    which |= wins[key]
        out.append((doc, len(w), len(hit), len(which), hashlib.sha256(",".join(sorted(which)).encode()).hexdigest(), bool(hit)))
    return out


def shingle_set(text, n=3):
    w = SPACED.findall(lower(text or ""))
    if len(w) < n:
        return {tuple(w)} if w else set()
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}


def components(docs, percent=90):
    sets = [(d, shingle_set(t)) for d, t in docs]
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[root(i)] = min(d, least.get(root(i), d))
    return [(d, len(s), least[root(i)]) for i, (d, s) in enumerate(sets)]


def repeated_words(docs, size=13):
    first = {}
    words = {d: SPACED.findall(t or "") for d, t in docs}
    for d, w in words.items():
        for s in range(len(w) - size + 1):
            key = tuple(w[s:s + size])
            first[key] = min(d, first.get(key, d))
    out = []
    for d, w in words.items():
        gone = set()
        for s in range(len(w) - size + 1):
            if first[tuple(w[s:s + size])] < d:
                gone |= set(range(s, s + size))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def repeated_bytes(docs, size=200):
    seen = Counter()
    data = [(d, (t or "").encode()) for d, t in docs]
    for _, b in data:
        seen.update(b[s:s + size] for s in range(len(b) - size + 1))
    out = []
    for d, b in data:
        gone = bytearray(len(b))
        for s in range(len(b) - size + 1):
            if seen[b[s:s + size]] > 1:
                gone[s:s + size] = b"\x01" * size
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = len(re.findall(b"\x01+", bytes(gone)))
        out.append((d, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def fold(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4
