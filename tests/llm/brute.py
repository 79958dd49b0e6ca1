"""Plain Python versions of what the operators compute."""

import re
from collections import Counter, defaultdict
from itertools import combinations

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    often = Counter(windows)
    repeated = {p for k, w in enumerate(windows) if often[w] > 1 for p in (k, k + 1, k + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(repeated),
        "base_failed": len(words) < 50 or 100 * len(repeated) > 50 * len(words),
    }


def base_spans(text):
    text = text or ""
    assign = r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out = [("assign", 0, m.start(), m.end()) for m in re.finditer(assign, text) if len(m[2]) >= 8]
    out += [("access", 1, m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [("hex", 2, m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(f"{k}:{a}:{b}" for k, _, a, b in sorted(out, key=lambda s: (s[2], s[1])))


def shingles(text, width):
    words = WORD.findall((text or "").translate(LOWER))
    width = min(width, len(words))
    return frozenset(tuple(words[k : k + width]) for k in range(len(words) - width + 1)) if words else frozenset()


def near(rows, width=2):
    """doc_id -> (size of the set, component), all pairs compared."""
    sets, parent = {d: shingles(x, width) for d, x in rows}, {d: d for d, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        s, t = sets[a], sets[b]
        if s and t and 100 * len(s & t) >= 80 * len(s | t):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def sequences(pieces, capacity=4096):
    """Checks offsets and lengths of packed pieces (sequence, offset, length)."""
    by = defaultdict(list)
    for s, o, n in pieces:
        by[s].append((o, n))
    for placed in by.values():
        at = 0
        for o, n in sorted(placed):
            assert o == at
            at += n
        assert at <= capacity
    return len(by)


def ftrl(rows, epochs, alpha, beta, l1, l2, positive):
    """FTRL-proximal logistic regression as its paper states it, one coordinate at a time; the bias has no L1 term."""
    import math

    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        cut = 0.0 if i == -1 else l1
        return 0.0 if abs(z[i]) <= cut else -(z[i] - math.copysign(cut, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(epochs):
        for places, label in rows:
            w = {i: weight(i) for i in [*places, -1]}
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(w.values())))))
            g = (p - label) * (positive if label else 1.0)
            for i, wi in w.items():
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * wi
                n[i] += g * g
    return {i: weight(i) for i in z if i == -1 or weight(i)}
