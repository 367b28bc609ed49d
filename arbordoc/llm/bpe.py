"""Byte-level BPE by speculation: greedy longest match proposes, pair checks verify, exact merging mends what fails."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_type, lean, load
from .hashing import Table

OTHER, LETTER, NUMBER, SPACE, END = range(5)
SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Letters and numbers that are newer than this Python's tables of characters.
NEWER = {
    LETTER: "1c89-1c8a a7cb-a7cd a7da-a7dc 105c0-105f3 10d4a-10d65 10d6f-10d85 10ec2-10ec4 11380-11389 1138b-1138b 1138e-1138e 11390-113b5 113b7-113b7 113d1-113d1 113d3-113d3 11bc0-11be0 13460-143fa 16100-1611d 16d40-16d6c 18cff-18cff 1e5d0-1e5ed 1e5f0-1e5f0",
    NUMBER: "10d40-10d49 116d0-116e3 11bf0-11bf9 16130-16139 16d70-16d79 1ccf0-1ccf9 1e5f1-1e5fa",
}
FAR = np.int32(1 << 30)  # no merge has this rank


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(1)
def char_classes() -> np.ndarray:
    """The class of every code point, as the splitting pattern sees it."""
    kinds = {"L": LETTER, "N": NUMBER}
    t = np.array([kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)], np.uint8)
    for kind, ranges in NEWER.items():
        for r in ranges.split():
            a, b = (int(x, 16) for x in r.split("-"))
            t[a : b + 1] = kind
    t[SPACES] = SPACE
    return t


def split_words(cp: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First positions of the pattern's words in a text's code points, and whether each is an end mark. ends: positions of the marks that end the pieces of text.

    The pattern is 's|'t|'re|'ve|'m|'ll|'d| ?letters| ?numbers| ?others|space(?!non-space)|space, over whole arrays: a word begins where the class changes;
    the last character of a white-space run before a word stands alone, or is the word's first if it is U+0020; a contraction takes an apostrophe that begins a word.
    """
    c = char_classes()[cp]
    c[ends] = END
    n = len(c)
    prev = np.empty(n, np.uint8)
    prev[0], prev[1:] = END, c[:-1]
    start = c != prev
    start[ends] = True
    start[ends[:-1] + 1] = True
    after = np.flatnonzero((prev == SPACE) & (c != SPACE) & (c != END))
    start[after - 1] = True
    blank = cp[after - 1] == 32
    start[after[blank]] = False
    a = np.flatnonzero((cp == 39) & start & (c == OTHER))
    a = a[a + 2 < n]
    one, two = cp[a + 1], cp[a + 2]
    short = np.isin(one, [ord(x) for x in "stmd"])
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    # an end mark may be any character: it can't be part of a contraction
    short &= c[a + 1] == LETTER
    long &= (c[a + 1] == LETTER) & (c[a + 2] == LETTER)
    hit = short | long
    start[a[hit] + 1] = False
    start[a[hit] + np.where(short[hit], 2, 3)] = True
    at = np.flatnonzero(start)
    return at, c[at] == END


class Bpe:
    """Encoder and decoder of one vocabulary file. Results equal those of its own library, special tokens' strings in texts included."""

    LONG, SHORT = 1024, 64  # bytes of words that are not proposed for at once with others, and of those that are merged at once with others

    def __init__(self, path: str, max_words: int = 400_000):
        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
        vocab = d["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in d["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token = [b""] * size
        for t, i in vocab.items():
            self.token[i] = bytes(byte[x] for x in t)
        for t, i in self.special.items():
            self.token[i] = t.encode()
        self.lens = np.array([len(t) for t in self.token], np.int64)
        self.flat = np.frombuffer(b"".join(self.token), np.uint8)
        self.offs = np.cumsum(self.lens) - self.lens
        self.size = size
        self.rank = np.full(size, -1, np.int64)
        self.left, self.right = np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for r, m in enumerate(d["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            a, b, ab = vocab[a], vocab[b], vocab[a + b]
            self.merges.setdefault((a, b), (r, ab))
            if self.rank[ab] < 0:
                self.rank[ab], self.left[ab], self.right[ab] = r, a, b
        self.byte_id = [vocab[next(c for c, x in byte.items() if x == b)] for b in range(256)]
        self.byte_ids = np.array(self.byte_id, np.int64)
        self.pairs = Table()  # pair of tokens (key: a * size + b + 1) to the number of its merge, which is its rank
        keys = [a * size + b + 1 for a, b in self.merges]
        self.made = np.zeros(max([r for r, _ in self.merges.values()], default=0) + 1, np.int64)
        for r, ab in self.merges.values():
            self.made[r] = ab
        self.pairs.add(np.array(keys, np.uint64), np.array([r for r, _ in self.merges.values()], np.int32))
        self._trie({"".join(chr(byte[x]) for x in t).encode("latin-1"): i for t, i in vocab.items()})
        self.checked = Table(16)  # pairs of neighbours that were checked, to whether they are compatible
        self.mark = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.max_words = max_words
        self._forget()

    def _trie(self, tokens: dict[bytes, int]) -> None:
        """Edges (key: state * 256 + byte + 1) to states, and the token that ends in each state, or -1."""
        states, accepts = {b"": 0}, {0: -1}
        for t, i in tokens.items():
            for k in range(1, len(t) + 1):
                states.setdefault(t[:k], len(states))
            accepts[states[t]] = i
        self.accept = np.full(len(states), -1, np.int32)
        self.accept[list(accepts)] = list(accepts.values())
        keys = np.array([states[p[:-1]] * 256 + p[-1] + 1 for p in states if p], np.uint64)
        self.edges = Table()
        self.edges.add(keys, np.array([v for p, v in states.items() if p], np.int32))
        self.first = self.edges.get(np.arange(1, 257, dtype=np.uint64))

    def _forget(self) -> None:
        """Empties the word cache: word 0 is the empty one, then one for each special token."""
        self.words = Table(16)
        self.special_word = {t: k + 1 for k, t in enumerate(self.special)}
        ids = list(self.special.values())
        self.n_words, self.n_ids, self.n_chars = 1 + len(ids), len(ids), 0
        self.ids, self.chars = np.array(ids, np.uint32), np.zeros(1, np.uint32)
        self.w_off = np.array([0, *range(len(ids))], np.int64)  # where a word's ids and code points begin, and how many there are
        self.w_len = np.array([0] + [1] * len(ids), np.int64)
        self.c_off, self.c_len = np.zeros(self.n_words, np.int64), np.zeros(self.n_words, np.int64)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of neighbours: does merging keep the boundary between them?

        The boundary's two sides are unmade step by step, the side that was made last first (of equal tokens the right one, as merging goes from left to right).
        The boundary breaks if, at some step, both sides have a merge that comes before either side was merged further.
        """
        ok = np.ones(len(a), bool)
        at = np.arange(len(a))
        x, y = np.asarray(a, np.int64), np.asarray(b, np.int64)
        lx = ly = np.full(len(a), FAR)
        while len(at):
            m = self.pairs.get((x * self.size + y + 1).astype(np.uint64), FAR)
            broken = (m < FAR) & (m < lx) & (m <= ly)
            ok[at[broken]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~broken & ((rx >= 0) | (ry >= 0))
            at, x, y, lx, ly, rx, ry = at[go], x[go], y[go], lx[go], ly[go], rx[go], ry[go]
            one = rx > ry
            lx, ly = np.where(one, rx, lx), np.where(one, ly, ry)
            x, y = np.where(one, self.right[x], x), np.where(one, y, self.left[y])
        return ok

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: always the pair of lowest rank, the leftmost first. n log n, so very long words are no trap."""
        ids = [self.byte_id[b] for b in word]
        n = len(ids)
        nxt, prv, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        get = self.merges.get
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, ab = heapq.heappop(heap)
            j = nxt[i] if alive[i] else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j] = ab, False
            k = nxt[i] = nxt[j]
            if k < n:
                prv[k] = i
                if m := get((ab, ids[k])):
                    heapq.heappush(heap, (m[0], i, ab, ids[k], m[1]))
            if (h := prv[i]) >= 0 and (m := get((ids[h], ab))):
                heapq.heappush(heap, (m[0], h, ids[h], ab, m[1]))
        return [t for t, live in zip(ids, alive) if live]

    def merge_many(self, raw: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of many short words at once: in each round every word merges its pair of lowest rank, the leftmost of equals. raw: the words' bytes, size of them for each."""
        ids = self.byte_ids[raw]
        own = np.repeat(np.arange(len(size)), size)
        done_ids, done_own = [], []
        pair = np.full(len(ids), FAR)  # rank of the pair that begins here

        def look(at):
            at = at[at + 1 < len(ids)]
            at = at[own[at] == own[at + 1]]
            pair[at] = self.pairs.get((ids[at] * self.size + ids[at + 1] + 1).astype(np.uint64), FAR)

        look(np.arange(len(ids)))
        while len(ids):
            first = np.flatnonzero(np.diff(own, prepend=-1))
            low = np.minimum.reduceat(pair, first)
            n = np.diff(first, append=len(ids))
            if low.max() == FAR:
                live = np.repeat(low < FAR, n)
                done_ids.append(ids[~live])
                done_own.append(own[~live])
                ids, own, pair = ids[live], own[live], pair[live]
                if not len(ids):
                    break
                n, low = n[low < FAR], low[low < FAR]
            at = np.flatnonzero(pair == np.repeat(low, n))
            at = at[np.flatnonzero(np.diff(own[at], prepend=-1))]
            ids[at] = self.made[pair[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            pair[at] = FAR
            at = at - np.arange(len(at))
            ids, own, pair = ids[keep], own[keep], pair[keep]
            left = at[(at > 0)] - 1
            pair[left[own[left] == own[left + 1]]] = FAR
            look(left)
            look(at)
        ids, own = np.concatenate([*done_ids, ids]), np.concatenate([*done_own, own])
        order = np.argsort(own, kind="stable")
        return ids[order], np.bincount(own, minlength=len(size))

    def propose(self, raw: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Greedy longest match in all words at once: tokens, their words (rising), and for each word whether tokens cover it."""
        end = np.cumsum(size)
        pos, own, good = end - size, np.flatnonzero(size), np.ones(len(size), bool)
        pos = pos[own]
        toks, owns = [], []
        while len(own):
            state, at, on = self.first[raw[pos]], pos + 1, np.arange(len(own))
            best, stop = np.full(len(own), -1, np.int32), pos.copy()
            go = state >= 0
            while True:
                on, state, at = on[go], state[go], at[go]
                if not len(on):
                    break
                got = self.accept[state]
                hit = got >= 0
                best[on[hit]], stop[on[hit]] = got[hit], at[hit]
                go = at < end[own[on]]
                on, state, at = on[go], state[go], at[go]
                state = self.edges.get(state.astype(np.uint64) * np.uint64(256) + raw[at] + np.uint64(1))
                at = at + 1
                go = state >= 0
            ok = best >= 0
            good[own[~ok]] = False
            toks.append(best[ok])
            owns.append(own[ok])
            more = ok & (stop < end[own])
            own, pos = own[more], stop[more]
        toks, owns = np.concatenate([np.zeros(0, np.int32), *toks]), np.concatenate([np.zeros(0, np.int64), *owns])
        order = np.argsort(owns, kind="stable")
        return toks[order].astype(np.int64), owns[order], good

    def encode_words(self, raw: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one word after the other, and the number of ids of each. raw: the words' bytes, size of them for each."""
        stop = np.cumsum(size)
        part = size <= self.LONG
        if not part.all():  # a proposal takes as many rounds as the longest word has tokens, so the longest are merged on their own
            exact = {i: self.merge(raw[stop[i] - size[i] : stop[i]].tobytes()) for i in np.flatnonzero(~part).tolist()}
            ids, k = self.encode_words(raw[np.repeat(part, size)], size[part])
            return _spread(part, ids, k, exact)
        tok, own, good = self.propose(raw, size)
        n = np.bincount(own, minlength=len(size))
        within = np.flatnonzero(own[1:] == own[:-1])
        key = (tok[within] * self.size + tok[within + 1] + 1).astype(np.uint64)
        told = self.checked.get(key)
        if (told < 0).any():
            new = np.unique(key[told < 0])
            pair = new.astype(np.int64) - 1
            if self.checked.n + len(new) > self.max_words:
                self.checked = Table(16)
                new = np.unique(key)
                pair = new.astype(np.int64) - 1
            self.checked.add(new, self.compatible(pair // self.size, pair % self.size).astype(np.int32))
            told = self.checked.get(key)
        good[own[within[told == 0]]] = False
        failed = np.flatnonzero(~good)
        if not len(failed):
            return tok, n
        small = ~good & (size <= self.SHORT)
        exact = {i: self.merge(raw[stop[i] - size[i] : stop[i]].tobytes()) for i in failed.tolist() if not small[i]}
        merged, k = self.merge_many(raw[np.repeat(small, size)], size[small])
        n[small] = k
        n[~good & ~small] = 0
        out = np.empty(n.sum(), np.int64)
        out[np.repeat(good, n)] = tok[good[own]]
        out[np.repeat(small, n)] = merged
        part = good | small
        return _spread(part, out, n[part], exact)

    def _learn(self, cp: np.ndarray, size: np.ndarray, hashes: np.ndarray | None) -> np.ndarray:
        """Adds words (code points, size of them for each) to the store, and to the table if hashes are given. Returns their numbers."""
        wide = (cp >= 0x80).astype(np.int8) + (cp >= 0x800) + (cp >= 0x10000) + np.int8(1)
        n_bytes = np.add.reduceat(wide, np.cumsum(size) - size, dtype=np.int64)
        raw = np.frombuffer(cp.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8) if len(cp) < n_bytes.sum() else cp.astype(np.uint8)
        ids, n = self.encode_words(raw, n_bytes)
        k, w, c = self.n_ids + len(ids), self.n_words + len(size), self.n_chars + len(cp)
        self.ids, self.chars = _room(self.ids, k), _room(self.chars, c)
        self.w_off, self.w_len, self.c_off, self.c_len = (_room(x, w) for x in (self.w_off, self.w_len, self.c_off, self.c_len))
        self.ids[self.n_ids : k], self.chars[self.n_chars : c] = ids, cp
        self.w_len[self.n_words : w], self.c_len[self.n_words : w] = n, size
        self.w_off[self.n_words : w] = self.n_ids + np.cumsum(n) - n
        self.c_off[self.n_words : w] = self.n_chars + np.cumsum(size) - size
        numbers = np.arange(self.n_words, w)
        if hashes is not None:
            self.words.add(hashes, numbers.astype(np.int32))
        self.n_ids, self.n_words, self.n_chars = k, w, c
        return numbers

    def word_numbers(self, cp: np.ndarray, at: np.ndarray, is_end: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """The number in the store of every word of a text (words tile it; at: where each begins). Words are found by a hash over the array, then compared."""
        size = np.diff(at, append=len(cp))
        power, inverse = _powers(len(cp))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((cp + np.uint32(1)) * power[: len(cp)])])
        h = (sums[at + size] - sums[at]) * inverse[at]
        h ^= h >> np.uint64(29)
        h[h == 0] = 1
        w = self.words.get(h).astype(np.int64)
        w[is_end] = marks
        miss = np.flatnonzero(w < 0)
        if len(miss):
            new, first, back = np.unique(h[miss], return_index=True, return_inverse=True)
            first = miss[first]
            w[miss] = self._learn(_gather(cp, at[first], size[first]), size[first], new)[back]
        # two words may have one hash: those that aren't what the store has are worked out on their own
        same = self.chars[np.repeat(self.c_off[w] - at, np.where(is_end, 0, size)) + np.flatnonzero(np.repeat(~is_end, size))] == np.delete(cp, at[is_end]) if (self.c_len[w] == size)[~is_end].all() else None
        if same is None or not same.all():
            words = np.flatnonzero(~is_end)
            odd = [i for i in words.tolist() if self.c_len[w[i]] != size[i] or (self.chars[self.c_off[w[i]] : self.c_off[w[i]] + size[i]] != cp[at[i] : at[i] + size[i]]).any()]
            w[odd] = self._learn(_gather(cp, at[odd], size[odd]), size[odd], None)
        return w

    def encode(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts as uint32, number of ids of each text). Null texts have none."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        pieces = pc.fill_null(texts, "")
        marks = np.zeros(len(pieces), np.int64)
        last = np.arange(len(pieces))
        joined = _joined(pieces)
        if self.mark and self.mark.search(joined):
            cut, found, last = [], [], []
            for t in pieces.to_pylist():
                p = 0
                for m in self.mark.finditer(t):
                    cut.append(t[p : m.start()])
                    found.append(self.special_word[m.group()])
                    p = m.end()
                cut.append(t[p:])
                found.append(0)
                last.append(len(cut) - 1)
            pieces, marks = pa.array(cut, pa.string()), np.array(found)
            joined = _joined(pieces)
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum(pc.utf8_length(pieces).to_numpy().astype(np.int64) + 1) - 1
        at, is_end = split_words(cp, ends)
        if self.n_words > self.max_words or self.n_chars > 16 * self.max_words:
            self._forget()
        w = self.word_numbers(cp, at, is_end, marks)
        n = self.w_len[w]
        upto = np.cumsum(n)
        ids = self.ids[np.repeat(self.w_off[w] - (upto - n), n) + np.arange(upto[-1])]
        total = upto[np.flatnonzero(is_end)[last]]
        return ids, np.diff(total, prepend=0)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids, special tokens included; each run that isn't UTF-8 becomes U+FFFD."""
        if not len(ids):
            return b""
        n = self.lens[ids]
        upto = np.cumsum(n)
        raw = self.flat[np.repeat(self.offs[ids] - (upto - n), n) + np.arange(upto[-1])].tobytes()
        return raw.decode("utf-8", "replace").encode()


def _spread(part: np.ndarray, ids: np.ndarray, k: np.ndarray, exact: dict[int, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, and their numbers: those of the words in part (k of each), and between them the others'."""
    if not exact:
        return ids, k
    n = np.zeros(len(part), np.int64)
    n[part], n[~part] = k, [len(x) for x in exact.values()]
    out = np.empty(n.sum(), np.int64)
    out[np.repeat(part, n)], out[np.repeat(~part, n)] = ids, [t for x in exact.values() for t in x]
    return out, n


def _room(a: np.ndarray, n: int) -> np.ndarray:
    """a, or a longer copy of it that has n entries at least."""
    return a if n <= len(a) else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])


def _gather(x: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Pieces of x, one after the other: size entries from each position on."""
    upto = np.cumsum(size)
    return x[np.repeat(at - (upto - size), size) + np.arange(upto[-1] if len(upto) else 0)]


def _joined(texts: pa.Array) -> str:
    """All texts, each followed by U+0000."""
    offs = pa.array([0, len(texts)], pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(offs, texts), "\0")[0].as_py() + "\0"


@lru_cache(1)
def _powers_of(n: int) -> tuple[np.ndarray, np.ndarray]:
    step = 0x9E3779B97F4A7C15
    return tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, b, np.uint64))]) for b in (step, pow(step, -1, 1 << 64)))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd number and of its inverse modulo 2**64, n at least."""
    return _powers_of(1 << max(20, (n - 1).bit_length()))


@lru_cache(2)
def bpe_of(path: str) -> Bpe:
    return Bpe(path)


def portions(batch: pa.RecordBatch, column: int, limit: int = 1_000_000):
    """batch in slices of at least one row and, from two rows on, at most limit bytes in column."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    begin = total = 0
    for i, s in enumerate(size.tolist()):
        if i > begin and total + s > limit:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += s
    if begin < batch.num_rows:
        yield batch.slice(begin)


def cut_bytes(data: bytes | np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A binary array of pieces of data with the given lengths in bytes."""
    offs = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    a = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offs.tobytes()), pa.py_buffer(data)])
    return a.cast(pa.binary())


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """id, n_tokens, ids: every whole text's token ids as little-endian unsigned 32-bit integers in a binary column.

    Method: texts are split into words over whole arrays; words not seen before get a greedy longest-match proposal, each pair of neighbouring tokens is checked for
    whether merging would keep the boundary, and words with a pair that fails are merged exactly. A sequence of tokens is the BPE encoding if all its neighbours
    pass, so the result is exact. Words and their ids are kept in a cache of a bounded number of words in each worker.
    A null or empty text gives 0 ids; null ids and repeated rows pass through; an empty table gives an empty result; other columns are ignored. Row-wise: no shuffle.
    vocabulary: path of a tokenizers JSON file, the same on all executors.
    """
    path = vocabulary or default_vocabulary()

    def run(batches):
        bpe = bpe_of(path)
        for b in batches:
            for p in portions(b, 1):
                ids, n = bpe.encode(p.column(1))
                yield pa.RecordBatch.from_arrays([p.column(0), pa.array(n, pa.int64()), cut_bytes(ids.astype("<u4").tobytes(), n * 4)], names=["i", "n", "ids"])

    out = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(lean(run), f"i {id_type(docs, id_col)}, n long, ids binary")
    return out.toDF(id_col, "n_tokens", "ids")


def decode(df: DataFrame, ids_col: str = "ids", out_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """df with ids_col replaced by the text of its ids, under the name out_col, with "_" after it while df has another column of that name. Null ids give an empty text; an empty table gives an empty result."""
    path = vocabulary or default_vocabulary()
    at = df.columns.index(ids_col)
    fields = [f for i, f in enumerate(df.schema.fields) if i != at]
    while any(f.name == out_col for f in fields):
        out_col += "_"

    def run(batches):
        bpe = bpe_of(path)
        for b in batches:
            for p in portions(b, at, 4_000_000):
                texts = [bpe.decode(np.frombuffer(x.as_py() or b"", "<u4")) for x in p.column(at)]
                cols = [c for i, c in enumerate(p.columns) if i != at]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(texts, pa.binary()).cast(pa.string())], names=[*names, out_col])

    names = [f"c{i}" for i in range(len(fields))]
    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, fields)] + [T.StructField(out_col, T.StringType())])
    return df.mapInArrow(lean(run), schema).toDF(*[f.name for f in fields], out_col)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, keep_ids: bool = True) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256, and ids unless keep_ids is false: encodes every whole text as `encode` does, decodes the ids as `decode` does, and takes digests of both.

    One Python worker does both for a task, so an executor holds half as many of them as with the two operators one after the other.
    """
    path = vocabulary or default_vocabulary()
    names = ["i", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 5 if keep_ids else 4]

    def run(batches):
        bpe = bpe_of(path)
        for b in batches:
            for p in portions(b, 1):
                ids, n = bpe.encode(p.column(1))
                raw, stops = ids.astype("<u4").tobytes(), np.cumsum(n).tolist()
                own, back = [], []
                for k, stop in zip(n.tolist(), stops):
                    own.append(hashlib.sha256(raw[4 * (stop - k) : 4 * stop]).hexdigest())
                    back.append(hashlib.sha256(bpe.decode(ids[stop - k : stop])).hexdigest())
                cols = [p.column(0), pa.array(n, pa.int64()), pa.array(own), pa.array(back), cut_bytes(raw, n * 4)]
                yield pa.RecordBatch.from_arrays(cols[: len(names)], names=names)

    types = [id_type(docs, id_col), "long", "string", "string", "binary"]
    out = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(lean(run), ", ".join(f"{c} {t}" for c, t in zip(names, types)))
    return out.toDF(id_col, *names[1:])


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of documents, whole texts, encoded and decoded again. A null text is empty: no ids. See round_trip."""
    return round_trip(load(spark, sf_dir, "documents"), keep_ids=False)
