"""Encoding of many JSON texts that differ in their integers only: what they share is encoded once.

Where the integers' heads have the same lengths and no two values are equal that would be shared, all else in the encoded documents is equal, pointers and sizes included. So a text's
own integers are put into a template made from the first such text. Texts of any other kind go through the encoder.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from operator import ge
from typing import Any

from .encoder import DEFAULT, Options, encode, write_document
from .wire import wire_of

#: Of a text's bytes: every digit as 0, and all but digits and signs as blanks.
MASK = bytes(48 if 48 <= c <= 57 else c for c in range(256))
NUMBERS = bytes(c if 48 <= c <= 57 or c == 45 else 32 for c in range(256))
#: An encoder forgets its templates when they are so many, and stops making them when most of the first texts had no use of one.
MOST, TRIAL = 20_000, 20_000


class Slot(bytes):
    """The head of an integer."""


class Template:
    def __init__(self, pieces: list[bytes], same: list[list[tuple[int, int]]], least: list[int]):
        self.pieces, self.same, self.least = pieces, same, least
        self.size = sum(map(len, pieces))


def _ranges(value: Any) -> tuple[list[int], dict[str, list[tuple[int, int]]]]:
    """The integers of a value in order and, by the shape of each container, which of them it holds (from, to)."""
    numbers: list[int] = []
    by_shape: dict[str, list[tuple[int, int]]] = {}

    def walk(v: Any) -> str:
        if type(v) is int:
            numbers.append(v)
            return "#"
        if not isinstance(v, dict | list):
            return json.dumps(v)
        at = len(numbers)
        told = [json.dumps(k) + walk(x) for k, x in v.items()] if isinstance(v, dict) else [walk(x) for x in v]
        shape = ("{%s}" if isinstance(v, dict) else "[%s]") % ",".join(told)
        by_shape.setdefault(shape, []).append((at, len(numbers)))
        return shape

    walk(value)
    return numbers, by_shape


class TextEncoder:
    """JSON text to an encoded document, or to its size. Equal to encode(parse(text)) for every text."""

    def __init__(self, parse, fmt: str = "text", options: Options | None = None):
        self.parse, self.fmt, self.options = parse, fmt, options or DEFAULT
        self.int_head = wire_of(fmt, tuple(self.options.refs)).heads["int"]
        self.small = [self.int_head(2 * x) for x in range(2049)]
        self.sizes = [len(h) for h in self.small]
        self.on = not self.options.refs
        self.made: dict[bytes, dict[bytes, Template | None] | None] = {}
        self.n_made = self.n_seen = 0

    def __call__(self, text: str) -> bytes:
        found = self.find(text) if self.on else None
        if found is None:
            return encode(self.parse(text), self.fmt, self.options)
        pieces = found[0].pieces.copy()
        pieces[1::2] = found[1]
        return b"".join(pieces)

    def size(self, text: str) -> int:
        found = self.find(text) if self.on else None
        return len(encode(self.parse(text), self.fmt, self.options)) if found is None else found[0].size

    def find(self, text: str) -> tuple[Template, list[bytes]] | None:
        """The template of a text and the heads for its slots, from the left."""
        if "\\" in text:
            return None
        if self.n_seen == TRIAL and 4 * self.n_made > 3 * TRIAL:
            self.on = False
            self.made.clear()
            return None
        self.n_seen += 1
        raw = text.encode()
        mask = raw.translate(MASK)
        kept = self.made.get(mask, self.made)
        if kept is None:
            return None
        try:
            numbers = list(map(int, raw.translate(NUMBERS).split()))
        except ValueError:  # a sign that isn't a number's
            self.made[mask] = None
            return None
        int_head, small, sizes = self.int_head, self.small, self.sizes
        heads, kinds, large = [], bytearray(), []
        for x in numbers:
            if 0 <= x <= 2048:
                heads.append(small[x])
                kinds.append(sizes[x])
                continue
            head = int_head(2 * x if x >= 0 else -2 * x - 1)
            heads.append(head)
            if -2048 <= x < 0:
                kinds.append(len(head))
            elif x % 100000 and -(10**18) < x < 10**18:
                kinds.append(128 + len(head))
                large.append(x)
            else:
                return None
        if len(large) > 1 and len(set(large)) < len(large):
            return None
        heads.reverse()
        key = bytes(kinds)
        try:
            template = kept[key]
        except KeyError:
            template = self.make(text, mask, key, numbers, heads)
        if template is None or not all(map(ge, map(abs, numbers), template.least)):
            return None
        for ranges in template.same:
            if len({tuple(numbers[a:b]) for a, b in ranges}) < len(ranges):
                return None
        return template, heads

    def make(self, text: str, mask: bytes, key: bytes, numbers: list[int], heads: list[bytes]) -> Template | None:
        if self.n_made % MOST == MOST - 1:
            self.made.clear()
        self.n_made += 1
        value = self.parse(text)
        told, by_shape = _ranges(value)
        # containers with a number that isn't small differ, as those numbers do
        same = [small for r in by_shape.values() if len(small := [(a, b) for a, b in r if a < b and max(key[a:b]) < 128]) > 1]
        if any(len({tuple(numbers[a:b]) for a, b in ranges}) < len(ranges) for ranges in same):
            return None
        template = None
        if told != numbers:  # digits in strings, or fractions
            self.made[mask] = None
        else:
            parts: list[bytes] = []
            write_document(value, self.fmt, self.options, parts.append, lambda n: Slot(self.int_head(n)))
            pieces = list(_alternate(parts))
            if pieces[1::2] == heads:
                # a number of more digits begins with none that is zero: such a text is no JSON
                least = [10 ** (len(t) - 1) if len(t) > 1 else 0 for t in mask.translate(NUMBERS).replace(b"-", b"").split()]
                template = Template(pieces, same, least)
            self.made.setdefault(mask, {})[key] = template
        return template


def _alternate(parts: list[bytes]) -> Iterator[bytes]:
    """Fixed bytes and slots in turn."""
    fixed: list[bytes] = []
    for p in parts:
        if type(p) is Slot:
            yield b"".join(fixed)
            yield p
            fixed = []
        else:
            fixed.append(p)
    yield b"".join(fixed)
