"""Simple-8b: several small integers in each 64-bit word, chosen by a 4-bit selector.

Selectors 2 to 15 pack 60 to 1 values of 1 to 60 bits, selector 1 stands for 240 zeros, and selector 0 is the escape: the
next word is one raw 64-bit value. Each word takes as many values as fit. Both directions work on whole blocks of arrays.
"""

from __future__ import annotations

import numpy as np

#: (values, bits) by selector; selector 0 is the escape.
PACKING = ((1, 64), (240, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
COUNTS = np.array([n for n, _ in PACKING])
LONGEST = 240
#: Largest value of each packing by falling width, and the packings too narrow for each small value.
LIMITS = np.array([(1 << b) - 1 for _, b in PACKING[1:]], np.uint64)
NARROW = np.searchsorted(LIMITS, np.arange(1 << 16, dtype=np.uint64)).astype(np.int8)


def encode(values: np.ndarray) -> np.ndarray:
    """Words of a block of unsigned integers of up to 64 bits."""
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64)
    values = values.astype(np.uint64)
    most = int(values.max())
    # bits of each value, as the number of packings that are too narrow for it
    widths = np.searchsorted(LIMITS, values).astype(np.int8) if most > len(NARROW) - 1 else NARROW[values]
    choice = np.zeros(n, np.int8)
    fits = np.ones(n + LONGEST, bool)  # places after the end take anything
    for selector in range(len(PACKING) - 1, 0, -1):  # by rising count: a longer packing that fits replaces a shorter one
        np.less(widths, selector, out=fits[:n])
        runs, length, count = fits, 1, int(COUNTS[selector])
        while 2 * length <= count:
            runs, length = runs[:-length] & runs[length:], 2 * length
        if count > length:
            runs = runs[: length - count] & runs[count - length :]
        choice[runs[:n]] = selector
    jumps, starts, k = COUNTS[choice].tolist(), [], 0
    while k < n:
        starts.append(k)
        k += jumps[k]
    starts = np.array(starts)
    chosen = choice[starts]
    escaped = chosen == 0
    places = np.arange(len(starts)) + np.cumsum(escaped) - escaped
    words = np.zeros(len(starts) + int(escaped.sum()), np.uint64)
    padded = np.concatenate([values, np.zeros(LONGEST, np.uint64)])
    for selector in np.unique(chosen).tolist():
        own = chosen == selector
        if selector == 0:
            words[places[own] + 1] = values[starts[own]]
            continue
        count, bits = PACKING[selector]
        packed = np.full(int(own.sum()), selector << 60, np.uint64)
        for j in range(count if bits else 0):
            packed |= padded[starts[own] + j] << np.uint64(bits * j)
        words[places[own]] = packed
    return words


def decode(words: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` values of a block."""
    selectors = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    for k in np.flatnonzero(selectors == 0).tolist():
        if not raw[k]:
            raw[k + 1] = True
    heads = np.flatnonzero(~raw)
    selectors = selectors[heads]
    ends = np.cumsum(COUNTS[selectors])
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    begins = ends - COUNTS[selectors]
    for selector in np.unique(selectors).tolist():
        own = selectors == selector
        if selector == 0:
            out[begins[own]] = words[heads[own] + 1]
            continue
        count, bits = PACKING[selector]
        held, mask = words[heads[own]], np.uint64((1 << bits) - 1)
        for j in range(count if bits else 0):
            out[begins[own] + j] = held >> np.uint64(bits * j) & mask
    return out[:n]
