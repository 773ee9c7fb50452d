"""Plain single-process versions of the operators' contracts, for small fixtures."""

import collections
import hashlib
import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
TERMS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def benchmark_hits(docs, items, size=13):
    """Per document: words, hit words, found items."""
    windows = collections.defaultdict(set)
    for item, text in items:
        w = TERMS.findall(lower(text))
        for s in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[s : s + size])].add(item)
    out = []
    for doc, text in docs:
        w, hit, found = TERMS.findall(lower(text)), set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit |= set(range(s, s + n))
                    found |= windows[tuple(w[s : s + n])]
        out.append((doc, len(w), len(hit), sorted(str(i) for i in found if i is not None)))
    return out


def kept_bytes(docs, length=50):
    """Per document: bytes, removed bytes, removed runs, digest of what stays."""
    first = {}
    for doc, text in docs:
        data = (text or "").encode()
        for i in range(len(data) - length + 1 if doc is not None else 0):
            first[data[i : i + length]] = min(doc, first.get(data[i : i + length], doc))
    out = []
    for doc, text in docs:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1 if doc is not None else 0):
            if first[data[i : i + length]] < doc:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc, len(data), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(data, gone, strict=True) if not g)).hexdigest()))
    return out


def shingles(text, size):
    w = WORDS.findall(lower(text))
    if len(w) < size:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def components(docs, size, percent=80):
    """Set size and smallest reachable id of every document; ids are distinct."""
    sets, parent = {d: shingles(t, size) for d, t in docs}, {d: d for d, _ in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = collections.defaultdict(list)
    for doc in sorted(sets):
        shared = collections.Counter()
        for s in sets[doc]:
            shared.update(holders[s])
            holders[s].append(doc)
        for other, n in shared.items():
            if 100 * n >= percent * (len(sets[doc]) + len(sets[other]) - n):
                a, b = sorted((root(doc), root(other)))
                parent[b] = a
    return {d: (len(sets[d]), root(d)) for d in sets}


def smallest_capacity(sizes, shards):
    """Smallest capacity for which a greedy walk needs no more than the given shards."""

    def needed(capacity):
        used, room = 1, capacity
        for s in sizes:
            if s > room:
                used, room = used + 1, capacity
            room -= s
        return used

    low, high = max(sizes), sum(sizes)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if needed(middle) <= shards else (middle + 1, high)
    return low
