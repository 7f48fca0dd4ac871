"""Plain versions of the operators, for comparison on small tables."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import xxhash


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def fingerprint(text, k=4):
    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash(docs, k=4, errors=4):
    """docs: {id: text} -> {id: (fingerprint, component)}"""
    f = {d: fingerprint(t, k) for d, t in docs.items()}
    ids = sorted(docs)
    x = np.array([f[d] for d in ids], np.uint64)
    links = []
    for i, d in enumerate(ids):
        near = np.flatnonzero(np.bitwise_count(x[i + 1 :] ^ x[i]) <= errors)
        links += [(d, ids[i + 1 + j]) for j in near.tolist()]
    c = roots(ids, links)
    return {d: (f[d], c[d]) for d in ids}


def substrings(docs, window=20):
    """docs: {id: text} -> {id: (n_words, n_removed, kept)}"""
    seen, out = set(), {}
    for d in sorted(docs):
        words = re.findall(r"[^\x20\x09-\x0d]+", docs[d] or "")
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            w = tuple(words[s : s + window])
            if w in seen:
                gone[s : s + window] = [True] * window
            seen.add(w)
        out[d] = (len(words), sum(gone), " ".join(w for w, g in zip(words, gone, strict=True) if not g))
    return out


def contamination(docs, items, window=10):
    """docs: {id: text}, items: [(id, text)] -> {id: (n_words, n_hit, sorted item ids)}"""
    word = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    lower = str.maketrans({c: c + 32 for c in range(65, 91)})
    split = lambda t: word.findall((t or "").translate(lower))
    windows = defaultdict(set)
    for i, t in items:
        w = split(t)
        if i is not None and w:
            n = min(window, len(w))
            for s in range(len(w) - n + 1):
                windows[tuple(w[s : s + n])].add(str(i))
    sizes = {len(w) for w in windows}
    out = {}
    for d, t in docs.items():
        w = split(t)
        hit, met = [False] * len(w), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                found = windows.get(tuple(w[s : s + n]))
                if found:
                    met |= found
                    hit[s : s + n] = [True] * n
        out[d] = (len(w), sum(hit), sorted(met))
    return out


def vectors(rows, threshold=0.9):
    """rows: [(id, vector)] -> {id: (n_links, component)}"""
    good = {}
    for i, v in rows:
        if v is not None and len(v) and None not in list(v):
            x = np.array(v, np.float64)
            if np.isfinite(x).all() and x.any():
                good[i] = x / np.linalg.norm(x)
    ids = [i for i, _ in rows]
    links = [(a, b) for a in good for b in good if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] >= threshold]
    c, n = roots(ids, links), defaultdict(int)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return {i: (n[i], c[i]) for i in ids}


def packed_well(rows, docs, encode, length=2048, end_id=1):
    """Checks rows (doc_id, start, length, crc, doc_tokens, sequence_id, offset) against docs {id: text}."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for d, start, n, crc, total, sequence, offset in rows:
        by_doc[d].append((start, n, crc, total))
        by_sequence[sequence].append((offset, n))
    assert set(by_doc) == set(docs)
    for d, pieces in by_doc.items():
        ids = np.array([*encode(docs[d] or ""), end_id], "<u4")
        at = 0
        for start, n, crc, total in sorted(pieces):
            assert (start, total) == (at, len(ids)) and n > 0
            assert crc == zlib.crc32(ids[start : start + n].tobytes())
            at += n
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= length
    used = sum(n for p in by_sequence.values() for _, n in p)
    return 1 - used / (length * len(by_sequence))


# --- a linear-chain field with two states, by all labellings ---


def labellings(n, lift, bias, transitions):
    """(log partition, probability of state 1 at each token, expected transitions) of a chain of n tokens."""
    from itertools import product

    total, ones, steps = 0.0, np.zeros(n), np.zeros((2, 2))
    for y in product((0, 1), repeat=n):
        w = np.exp(sum((bias + lift.get(t, 0.0)) * s for t, s in enumerate(y)) + sum(transitions[a][b] for a, b in zip(y, y[1:], strict=False)))
        total += w
        ones += w * np.array(y, float)
        for a, b in zip(y, y[1:], strict=False):
            steps[a, b] += w
    return np.log(total), ones / total, steps / total


def field_likelihood(v, lengths, places, owned, gold, bases, ridge=0.1):
    k = owned.shape[1]
    weights, bias, transitions = v[:k], v[k], v[k + 1 :].reshape(2, 2)
    value = -ridge / 2 * float(v @ v)
    for n, at, base in zip(lengths, places, bases, strict=True):
        lift = {int(t): float(owned[base + i] @ weights) for i, t in enumerate(at)}
        y = np.zeros(n, int)
        for i, t in enumerate(at):
            y[t] = int(gold[base + i])
        value += sum((bias + lift.get(t, 0.0)) * s for t, s in enumerate(y)) + sum(transitions[a][b] for a, b in zip(y, y[1:], strict=False))
        value -= labellings(n, lift, bias, transitions)[0]
    return float(value)
