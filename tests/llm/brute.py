"""Plain Python versions of the contracts, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def op1(rows, min_sites=10):
    """rows: (doc_id, text, source)"""
    sites, first = defaultdict(set), {}
    strip = lambda x: x.strip(" \t\n\x0b\x0c\r")
    for d, t, s in rows:
        for i, x in enumerate((t or "").split("\n")):
            if x := strip(x):
                sites[x] |= {s} - {None}
                first[x] = min(first.get(x, (d, i)), (d, i))
    out = {}
    for d, t, _ in rows:
        lines = (t or "").split("\n")
        left = [x for i, x in enumerate(lines) if not strip(x) or len(sites[strip(x)]) < min_sites or first[strip(x)] == (d, i)]
        out[d] = (0 if t is None else len(lines), len(lines) - len(left), sha("\n".join(left)))
    return out


def op2(rows, n=50):
    first = {}
    texts = sorted((d, (t or "").encode()) for d, t in rows)
    for d, b in texts:
        for i in range(len(b) - n + 1):
            first.setdefault(b[i : i + n], d)
    out = {}
    for d, b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if first[b[i : i + n]] < d:
                gone[i : i + n] = b"\1" * n
        runs = len(re.findall(b"\1+", bytes(gone)))
        out[d] = (len(b), sum(gone), runs, sha(bytes(x for x, g in zip(b, gone) if not g)))
    return out


def words4(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def op4(rows, items, n=10):
    known, lengths = defaultdict(set), set()
    for i, t in items:
        w = words4(t)
        m = min(n, len(w))
        if m:
            lengths.add(m)
            for k in range(len(w) - m + 1):
                known[tuple(w[k : k + m])].add(i)
    out = {}
    for d, t in rows:
        w = words4(t)
        hit, found = set(), set()
        for m in lengths:
            for k in range(len(w) - m + 1):
                if (x := tuple(w[k : k + m])) in known:
                    hit |= set(range(k, k + m))
                    found |= known[x]
        out[d] = (len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit))
    return out


def words7(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def op7(rows):
    out = {}
    for d, t in rows:
        w = words7(t)
        wins = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        rep = set()
        for i in range(len(w) - 4):
            if wins[tuple(w[i : i + 5])] > 1:
                rep |= set(range(i, i + 5))
        lines = [x for x in (t or "").split("\n") if words7(x)]
        out[d] = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(rep), len(w) < 10 or 100 * len(rep) > 20 * len(w))
    return out


def shingles9(t):
    w = words7("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def op9(rows, percent=75):
    sets = {d: shingles9(t) for d, t in rows}
    has, parent = defaultdict(list), {d: d for d in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d in sorted(sets):
        for s in sets[d]:
            has[s].append(d)
    seen = set()
    for ids in has.values():
        for i, a in enumerate(ids):
            for b in ids[:i]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    n = len(sets[a] & sets[b])
                    if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                        x, y = sorted((top(a), top(b)))
                        parent[y] = x
    return {d: (len(s), top(d), top(d) == d) for d, s in sets.items()}


def op8(rows, encode, end=2):
    out, start = {}, 0
    for d, t in sorted(rows):
        ids = [*encode(t or ""), end]
        out[d] = (start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)))
        start += len(ids)
    return out


def terms11(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def op11(rows, items, depth=20):
    """item_id, rank, doc_id, score, in order; a null id comes after others of equal score."""
    docs = [(d, Counter(terms11(t))) for d, t in rows]
    n_docs, length = sum(1 for _, c in docs if c), sum(sum(c.values()) for _, c in docs)
    df = Counter(w for _, c in docs for w in c)
    weight = {w: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * k + 1))) for w, k in df.items()}
    out = []
    for i, t in items:
        asked, scores = Counter(terms11(t)), []
        for d, c in docs:
            m = 75 + 25 * sum(c.values()) * n_docs // length if length else 0
            score = sum(times * weight[w] * (1_000_000_000 * c[w] // (1000 * c[w] + 12 * m)) for w, times in asked.items() if c[w])
            if score > 0:
                scores.append((-score, d is None, d or 0, d))
        out += [(i, k, d, -s) for k, (s, _, _, d) in enumerate(sorted(scores, key=lambda x: x[:3])[:depth], 1)]
    return out


def op13(rows, slips=97):
    n = Counter()
    for d, t in rows:
        for w in re.findall("[a-zÀ-ÿ]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")):
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            k = h % len(w)
            w = w[:k] + w[k + 1 :] if h % slips == 0 else w
            if len(w) >= 5:
                n[w] += 1
    n = {w: c for w, c in n.items() if c >= 3}
    near, cuts = defaultdict(set), defaultdict(set)
    for w in n:
        for p in range(len(w)):
            rest = w[:p] + w[p + 1 :]
            cuts[p, rest].add(w)
            if rest in n:
                near[w].add(rest)
                near[rest].add(w)
    for ws in cuts.values():
        for w in ws:
            near[w] |= ws - {w}
    best = {w: min(near[w], key=lambda x: (-n[x], x)) for w in n if near[w]}
    form = {w: x for w, x in best.items() if n[x] >= 2 * n[w]}
    out = {}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None)
    return out
