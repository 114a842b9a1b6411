"""Plain Python versions of the operators, for small inputs."""

import hashlib
import math
import re
import struct
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(b):
    return hashlib.sha256(b).hexdigest()


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return frozenset()
    if len(w) < k:
        return frozenset([tuple(w)])
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def near_duplicates(docs, k, num, den):
    sets = {}
    for d, t in docs:
        sets.setdefault(d, []).append(shingles(t, k))
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    index, items = {}, [(d, s) for d, many in sets.items() for s in many if s]
    for i, (d, s) in enumerate(items):
        common = Counter(j for tok in s for j in index.get(tok, ()))
        for tok in s:
            index.setdefault(tok, []).append(i)
        for j, n in common.items():
            e, u = items[j]
            if den * n >= num * (len(s) + len(u) - n):
                a, b = find(d), find(e)
                root[max(a, b)] = min(a, b)
    return sorted((d, len(s), find(d)) for d, many in sets.items() for s in many)


def substring_dedup(docs, length=200):
    seen = Counter()
    raws = [(d, (t or "").encode()) for d, t in docs]
    for _, b in raws:
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for d, b in raws:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        runs = len([m for m in re.finditer(b"\x01+", bytes(gone))])
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), runs, sha(kept)))
    return sorted(out, key=str)


def line_dedup(docs, min_chars=40, min_docs=5):
    def key(line):
        return line.strip("\x20\x09\x0a\x0b\x0c\x0d").translate(LOWER)

    holders = {}
    for d, t in docs:
        for k in {key(x) for x in (t or "").split("\n")}:
            holders.setdefault(k, set()).add(-(1 << 63) if d is None else d)
    hot = {k: max(h) for k, h in holders.items() if len(k) >= min_chars and len(h) >= min_docs}
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in hot or hot[key(x)] == (-(1 << 63) if d is None else d)]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


M64 = (1 << 64) - 1


def mix64(x):
    x ^= x >> 32
    x = x * 0xD6E8FEB86659FD93 & M64
    x ^= x >> 29
    x = x * 0xC2B2AE3D27D4EB4F & M64
    return x ^ (x >> 32)


def quality_buckets(text, values, base, run, buckets):
    """Buckets of a text's words and word pairs; ``values`` holds a number per byte."""
    words = []
    for w in WORD.findall((text or "").translate(LOWER)):
        raw = w.encode()
        total = sum(values[b] * pow(base, i, 1 << 64) for i, b in enumerate(raw))
        words.append(mix64((total + len(raw)) & M64))
    pairs = [run if a == b else mix64((a * base + b + 2) & M64) for a, b in zip(words, words[1:])]
    return [mix64(h) % buckets for h in words + pairs]


def resample(docs, labels, share, seed, values, base, run, buckets, smoothing):
    """[(doc_id, text, log weight, key)] of every row, and the rows drawn."""
    marks = {}
    for d, y in labels:
        if d is not None and y is not None:
            marks.setdefault(d, set()).add(y)
    good = {d for d, ys in marks.items() if len(ys) == 1 and max(ys) > 0}
    raw, target, found = Counter(), Counter(), [quality_buckets(t, values, base, run, buckets) for _, t in docs]
    for (d, _), f in zip(docs, found):
        raw.update(f)
        if d in good:
            target.update(f)
    r, t = sum(raw.values()), sum(target.values())
    scored = []
    for (d, text), f in zip(docs, found):
        weight = sum(math.log((target[b] + smoothing) / (raw[b] * t / max(r, 1) + smoothing)) for b in f) if t else 0.0
        draw = 42 if d is None else xxhash.xxh64_intdigest(struct.pack("<q", d), seed=42)
        u = ((mix64(draw ^ seed) >> 11) + 0.5) / 2.0**53
        scored.append((d, text, weight, weight - math.log(-math.log(u))))
    k = math.ceil(share * len(docs) - 1e-9)
    cut = sorted((s[3] for s in scored), reverse=True)[k - 1] if k else math.inf
    return scored, [s for s in scored if s[3] >= cut]
