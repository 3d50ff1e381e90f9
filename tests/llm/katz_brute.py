"""Katz backoff over n-grams, told plainly with dictionaries."""

import math
import re
import zlib
from collections import Counter


def factors(counts, k=5):
    """Katz's factors; from a log-linear fit of the counts of counts where they are no factors; else absolute discounting."""
    n = Counter(counts)
    if not n[1]:
        return lambda r: 1.0
    good = katz_factors(n, k)
    if not all(0 < x <= 1 for x in good) and n[1] > n[2] > 0:
        slope = fitted_slope(n)
        good = katz_factors({r: r**slope for r in range(1, k + 2)}, k)
    if not all(0 < x <= 1 for x in good):
        good = [(r - n[1] / (n[1] + 2 * n[2])) / r if n[2] else (r - 0.5) / r for r in range(1, k + 1)]
    return lambda r: good[r - 1] if r <= k else 1.0


def katz_factors(n, k):
    c = (k + 1) * n.get(k + 1, 0) / n[1]
    return [((r + 1) * n.get(r + 1, 0) / n[r] / r - c) / (1 - c) if n.get(r) and c < 1 else -1 for r in range(1, k + 1)]


def fitted_slope(n):
    r = sorted(x for x in n if n[x])
    z = [2 * n[x] / ((r[i + 1] if i + 1 < len(r) else 2 * x - (r[i - 1] if i else 0)) - (r[i - 1] if i else 0)) for i, x in enumerate(r)]
    x, y = [math.log(v) for v in r], [math.log(v) for v in z]
    mx, my = sum(x) / len(x), sum(y) / len(y)
    return sum((a - mx) * (b - my) for a, b in zip(x, y)) / sum((a - mx) ** 2 for a in x)


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def katz(rows, modulus=10, order=2):
    """Results by id; a function from histories (tuples of words) to functions from words to probabilities; P(w); P of an unknown word."""
    train = [words_of(t) for i, t in rows if zlib.crc32(str(i).encode()) % modulus]
    uni = Counter(w for d in train for w in d)
    total, v = sum(uni.values()), len(uni)
    f = factors(uni.values())
    kept = sum(f(c) * c for c in uni.values())
    div = total if total - kept > 1e-9 * max(total, 1) else total + 1
    p = {w: f(c) * c / div for w, c in uni.items()}
    unk = 1 - kept / div if total else 1.0
    tables = {}
    for n in range(2, order + 1):
        grams = Counter(h + (w,) for d in train for h, w in contexts(d, n))
        by = {}
        for g, c in grams.items():
            by.setdefault(g[:-1], {})[g[-1]] = c
        tables[n] = factors(grams.values()), by
    known = {}

    def cond(h):
        if not h:
            return lambda w: p.get(w, unk)
        if h not in known:
            g, by = tables[len(h) + 1]
            seen, shorter = by.get(h), cond(h[1:])
            if not seen:
                known[h] = shorter
            else:
                n = sum(seen.values())
                kept = sum(g(c) * c for c in seen.values())
                dv = n if n - kept > 1e-9 * n else n + 1
                a = (1 - kept / dv) / (1 - sum(map(shorter, seen)))
                known[h] = lambda w: g(seen[w]) * seen[w] / dv if w in seen else a * shorter(w)
        return known[h]

    out = {}
    for i, t in rows:
        d = words_of(t)
        score = sum(math.log10(cond(h)(w)) for h, w in contexts(d, order))
        base = sum(math.log10((uni[w] + 0.1) / (total + 0.1 * (v + 1))) for w in d)
        out[i] = (zlib.crc32(str(i).encode()) % modulus == 0, len(d), sum(w in uni for w in d), total, base, score)
    return out, cond, p, unk


def contexts(d, n):
    full = ["<start>"] * (n - 1) + d
    return [(tuple(full[i : i + n - 1]), full[i + n - 1]) for i in range(len(d))]
