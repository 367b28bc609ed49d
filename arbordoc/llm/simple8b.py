"""Simple-8b in numpy: unsigned integers in 64-bit words, packed and unpacked by whole blocks."""

from __future__ import annotations

import numpy as np

BLOCK = 1024
WIDTHS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.uint64)
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 1, 0], np.int64)
ESCAPE, HIGH = 14, 15
LOW60 = np.uint64((1 << 60) - 1)
PAD = 60
#: kind k: a value below LIMITS[k] (2 to the power WIDTHS[k]) and not below the limit before; kind 14 needs an escape.
LIMITS = np.uint64(1) << WIDTHS
SMALL_KIND = np.searchsorted(LIMITS, np.arange(1 << 16, dtype=np.uint64), "right").astype(np.uint8)


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit words, number of words of each block of BLOCK ids; the last block may be shorter).

    The top four bits of a word select how many ids of what width it holds, as many as fit from where it begins. A value of 60 bits or more takes
    an escape: selector 14 with its low 60 bits, then selector 15 with the rest. A block's last word may have unused places.
    The choice for every position comes from sliding maxima of the widths; then all blocks are walked at once, a word of each at a time.
    """
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    nb = -(-n // BLOCK)
    v = np.zeros((nb, BLOCK + PAD), np.uint64)
    flat = np.zeros(nb * BLOCK, np.uint64)
    flat[:n] = ids
    v[:, :BLOCK] = flat.reshape(nb, BLOCK)
    top = int(flat.max())
    kind = SMALL_KIND[v.astype(np.uint16)] if top < 1 << 16 else np.searchsorted(LIMITS, v.ravel(), "right").astype(np.uint8).reshape(v.shape)
    choice = np.full((nb, BLOCK), ESCAPE, np.uint8)
    windows, have = {1: kind}, 1
    for k in range(13, -1, -1):
        c = int(COUNTS[k])
        if c > 1:
            p = max(x for x in windows if x < c)
            w = windows[p]
            while 2 * p < c:
                w = np.maximum(w[:, : w.shape[1] - p], w[:, p:])
                p *= 2
            s = c - p
            windows[c] = np.maximum(w[:, : w.shape[1] - s], w[:, s:])
        choice[windows[c][:, :BLOCK] <= k] = k
    size = np.full(nb, BLOCK)
    size[-1] = n - (nb - 1) * BLOCK
    begins = np.zeros((nb, BLOCK), bool)
    rows, at = np.arange(nb), np.zeros(nb, np.int64)
    while len(rows):
        begins[rows, at] = True
        at = at + COUNTS[choice[rows, at]]
        go = at < size[rows]
        if not go.all():
            rows, at = rows[go], at[go]
    r, a = np.nonzero(begins)
    sel = choice[r, a]
    words = np.zeros(len(sel), np.uint64)
    ravel = v.ravel()
    base = r * (BLOCK + PAD) + a
    for k in np.unique(sel):
        i = np.flatnonzero(sel == k)
        if k == ESCAPE:
            words[i] = ravel[base[i]] & LOW60
        else:
            c = int(COUNTS[k])
            out = ravel[base[i]]
            for j in range(1, c):
                out |= ravel[base[i] + j] << (WIDTHS[k] * np.uint64(j))
            words[i] = out
        words[i] |= np.uint64(k) << np.uint64(60)
    per = np.bincount(r, minlength=nb)
    esc = np.flatnonzero(sel == ESCAPE)
    if len(esc):
        high = (ravel[base[esc]] >> np.uint64(60)) | (np.uint64(HIGH) << np.uint64(60))
        words = np.insert(words, esc + 1, high)
        per = per + np.bincount(r[esc], minlength=nb)
    return words, per


def unpack(words: np.ndarray, per: np.ndarray, n: int) -> np.ndarray:
    """The n ids (uint64) of whole blocks; per: the number of words of each block. All blocks but the last hold BLOCK ids."""
    nb = len(per)
    if not nb:
        return np.zeros(0, np.uint64)
    sel = (words >> np.uint64(60)).astype(np.int64)
    c = COUNTS[sel]
    row = np.repeat(np.arange(nb), per)
    upto = np.cumsum(c) - c
    first = np.cumsum(per) - per
    base = upto - upto[np.minimum(first, len(words) - 1)][row] + row * (BLOCK + PAD)
    out = np.zeros(nb * (BLOCK + PAD), np.uint64)
    for k in np.unique(sel):
        i = np.flatnonzero(sel == k)
        if k == HIGH:
            continue
        if k == ESCAPE:
            out[base[i]] = (words[i] & LOW60) | (words[i + 1] << np.uint64(60))
            continue
        mask = np.uint64((1 << int(WIDTHS[k])) - 1)
        for j in range(int(COUNTS[k])):
            out[base[i] + j] = (words[i] >> (WIDTHS[k] * np.uint64(j))) & mask
    return out.reshape(nb, BLOCK + PAD)[:, :BLOCK].ravel()[:n]
