"""The two wire forms of a document: how a node's tag and number are written, and how strings and offsets are packed.

A node is [body][tag and number], read from its right end. Both forms share all structure (see encoder.py and cursor.py); only what is in this module differs.
"""

from __future__ import annotations

import binascii
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

#: The digits of base 64, most significant first in numbers.
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ-_"
DIGIT = {c: i for i, c in enumerate(ALPHABET.encode())}
#: Each byte's value as a digit, -1 for what is none.
VALUES = [DIGIT.get(b, -1) for b in range(256)]
#: Numbers below 4096 as two digits, and without leading zeros.
PAIRS = [a + b for a in ALPHABET for b in ALPHABET]
SHORT = [p.lstrip("0") for p in PAIRS]

#: The literals, by name; the binary form's code is the position here.
LITERALS: tuple[tuple[str, str], ...] = (("n", "null"), ("t", "true"), ("f", "false"), ("u", "undef"), ("inf", "inf"), ("nif", "ninf"), ("nan", "nan"))


class CodecError(ValueError):
    """The bytes are not a document."""


class Undefined:
    """A value that is stored but absent: JSON output drops it from maps and writes null in lists."""

    __slots__ = ()

    def __repr__(self) -> str:
        return "UNDEFINED"

    def __bool__(self) -> bool:
        return False

    def __reduce__(self) -> str:
        return "UNDEFINED"  # workers get their own module's value, so that identity holds


UNDEFINED = Undefined()
CONSTANTS = {"null": None, "true": True, "false": False, "undef": UNDEFINED, "inf": float("inf"), "ninf": float("-inf"), "nan": float("nan")}


def to_base64(n: int) -> str:
    """Digits of n >= 0 without leading zeros; zero has none."""
    if n < 0:
        raise ValueError(f"negative: {n}")
    out = ""
    while n >= 4096:
        out = PAIRS[n & 4095] + out
        n >>= 12
    return SHORT[n] + out


def from_base64(s: bytes | str) -> int:
    n = 0
    for c in s.encode() if isinstance(s, str) else s:
        if c not in DIGIT:
            raise CodecError(f"not a digit: {chr(c)!r}")
        n = n * 64 + DIGIT[c]
    return n


def zigzag(n: int) -> int:
    return 2 * n if n >= 0 else -2 * n - 1


def unzigzag(z: int) -> int:
    return z // 2 if z % 2 == 0 else -(z + 1) // 2


@dataclass(slots=True)
class Node:
    """What stands at a right end: its kind, number (or a name's text), where its tag begins, and where the bytes that belong to it begin."""

    kind: str
    number: int
    tag_at: int
    right: int
    left: int
    name: str = ""

    @property
    def body(self) -> int:
        return self.tag_at - self.left


#: The text form's tags.
TEXT_TAGS = {"int": "+", "exp": "*", "str": ",", "name": "'", "list": ";", "map": ":", "ptr": "^", "chain": ".", "index": "#"}
#: The binary form's tags.
BINARY_TAGS = {"int": 0, "exp": 1, "str": 2, "hex": 3, "name": 4, "list": 5, "map": 6, "ptr": 7, "chain": 8, "index": 9, "b64": 10}
SIZED = ("str", "list", "map", "chain")
TEXT_CONSTANTS = {long: b"'" + short.encode() for short, long in LITERALS}
CODES = {long: i for i, (_, long) in enumerate(LITERALS)}


@lru_cache(1 << 16)
def text_head(kind: str, n: int) -> bytes:
    return (TEXT_TAGS[kind] + to_base64(n)).encode()


@lru_cache(1 << 16)
def binary_head(kind: str, n: int) -> bytes:
    rest = []
    while n >= 8:
        # the lowest bits go into extension bytes until three are left for the tag byte
        rest.append(0x80 | n & 0x7F)
        n >>= 7
    return bytes([n << 4 | BINARY_TAGS[kind], *reversed(rest)])


#: The kinds whose heads are most of a document, each with a table of the heads of small numbers.
COMMON = ("int", "ptr", "list", "map", "str")
SHORT_BYTES, PAIR_BYTES = [p.encode() for p in SHORT], [p.encode() for p in PAIRS]


def text_heads(kind: str) -> Callable[[int], bytes]:
    """text_head of one kind, without a cache that many different numbers would only fill."""
    tag = TEXT_TAGS[kind].encode()
    small = [tag + d for d in SHORT_BYTES]

    def head(n: int) -> bytes:
        if n < 4096:
            return small[n]
        return tag + SHORT_BYTES[n >> 12] + PAIR_BYTES[n & 4095] if n < 1 << 24 else tag + to_base64(n).encode()

    return head


def binary_heads(kind: str) -> Callable[[int], bytes]:
    """binary_head of one kind, without a cache that many different numbers would only fill."""
    tag, whole = BINARY_TAGS[kind], binary_head.__wrapped__
    small = [whole(kind, n) for n in range(4096)]

    def head(n: int) -> bytes:
        if n < 4096:
            return small[n]
        if n < 1 << 17:
            return bytes((n >> 10 & 0x70 | tag, n >> 7 & 0x7F | 0x80, n & 0x7F | 0x80))
        if n < 1 << 24:
            return bytes((n >> 17 & 0x70 | tag, n >> 14 & 0x7F | 0x80, n >> 7 & 0x7F | 0x80, n & 0x7F | 0x80))
        return whole(kind, n)

    return head


class TextWire:
    """ASCII tag, then the number in base 64."""

    name = "text"
    least_layout = 1

    def __init__(self, ref_names: tuple[str, ...] = ()):
        self.kinds = {v.encode()[0]: k for k, v in TEXT_TAGS.items()}
        self.heads = {k: text_heads(k) for k in COMMON}

    head = staticmethod(text_head)

    def constant(self, what: str) -> bytes:
        return TEXT_CONSTANTS[what]

    def ref(self, name: str) -> bytes:
        return b"'" + name.encode()

    def string(self, s: str) -> bytes:
        raw = s.encode("utf-8", "surrogatepass") if s.isascii() else s.encode("utf-8", "replace")
        return raw + self.head("str", len(raw))

    def slot_width(self, most: int) -> int:
        return max(1, len(to_base64(most)))

    def slot(self, n: int, width: int) -> bytes:
        return to_base64(n).rjust(width, "0").encode()

    def read_slot(self, data: bytes) -> int:
        return from_base64(data)

    def tag(self, data: bytes, right: int) -> tuple[str, int, int]:
        """Kind, number and where the tag begins."""
        at, n, bits = right - 1, 0, 0
        while at >= 0 and (d := VALUES[data[at]]) >= 0:
            n |= d << bits
            bits += 6
            at -= 1
        if at < 0:
            raise CodecError("no tag")
        kind = self.kinds.get(data[at])
        if kind is None:
            raise CodecError(f"unknown tag {chr(data[at])!r} at {at}")
        return kind, n, at

    def node(self, data: bytes, right: int) -> Node:
        kind, n, at = self.tag(data, right)
        if kind == "name":
            return Node(kind, 0, at, right, at, data[at + 1 : right].decode())
        return Node(kind, n, at, right, at - n if kind in SIZED else at)

    def text(self, data: bytes, x: Node) -> str:
        return data[x.left : x.tag_at].decode("utf-8", "replace")


HEX = re.compile(r"[0-9a-f]+")
B64 = re.compile(r"[0-9a-zA-Z_-]+")


def classify(s: str) -> str:
    """How the binary form stores a string: 'hex', 'b64' or 'str' as it is. Short strings are never packed."""
    if len(s) < 4:
        return "str"
    return "hex" if HEX.fullmatch(s) else "b64" if B64.fullmatch(s) else "str"


#: The digits of RFC 4648, whose codec packs and unpacks them.
RFC = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
TO_RFC, FROM_RFC = bytes.maketrans(ALPHABET.encode(), RFC), bytes.maketrans(RFC, ALPHABET.encode())


def pack_digits(s: str, bits: int) -> bytes:
    """bits per character, big-endian, padded at the left for hex digits (bits = 4) and at the right for base 64 (bits = 6)."""
    if bits == 4:
        return bytes.fromhex(s.rjust(len(s) + len(s) % 2, "0"))
    size = (6 * len(s) + 7) // 8
    return binascii.a2b_base64(s.encode().translate(TO_RFC) + b"A" * (-len(s) % 4))[:size]


def unpack_digits(data: bytes, length: int, bits: int) -> str:
    if bits == 4:
        return data.hex()[-length:] if length else ""
    return binascii.b2a_base64(data, newline=False).translate(FROM_RFC)[:length].decode()


class BinaryWire:
    """One byte 0vvvtttt with the tag and the number's top bits, then 7 bits a byte with the top bit set, big-endian."""

    name = "binary"
    least_layout = 2

    def __init__(self, ref_names: tuple[str, ...] = ()):
        self.kinds = {v: k for k, v in BINARY_TAGS.items()}
        self.by_tag = [self.kinds.get(i) for i in range(16)]
        self.refs = sorted(ref_names)
        self.heads = {k: binary_heads(k) for k in COMMON}

    head = staticmethod(binary_head)

    def constant(self, what: str) -> bytes:
        return self.head("name", CODES[what])

    def ref(self, name: str) -> bytes:
        return self.head("name", len(LITERALS) + self.refs.index(name))

    def string(self, s: str) -> bytes:
        kind = classify(s)
        if kind == "hex":
            return pack_digits(s, 4) + self.head("hex", len(s))
        if kind == "b64":
            return pack_digits(s, 6) + self.head("b64", len(s))
        raw = s.encode("utf-8", "replace")
        return raw + self.head("str", len(raw))

    def slot_width(self, most: int) -> int:
        return max(1, (most.bit_length() + 7) // 8)

    def slot(self, n: int, width: int) -> bytes:
        return n.to_bytes(width, "big")

    def read_slot(self, data: bytes) -> int:
        return int.from_bytes(data, "big")

    def tag(self, data: bytes, right: int) -> tuple[str, int, int]:
        """Kind, number and where the tag begins."""
        at = right - 1
        if at > 0:  # most tags have one byte or two
            n = data[at]
            if n < 0x80 and (kind := self.by_tag[n & 15]) is not None:
                return kind, n >> 4, at
            if (top := data[at - 1]) < 0x80 <= n and (kind := self.by_tag[top & 15]) is not None:
                return kind, top >> 4 << 7 | n & 0x7F, at - 1
        while at >= 0 and data[at] & 0x80:
            at -= 1
        if at < 0:
            raise CodecError("no tag")
        top = data[at]
        kind = self.kinds.get(top & 15)
        if kind is None:
            raise CodecError(f"unknown tag {top & 15} at {at}")
        n = top >> 4
        if at + 1 < right:
            for k in data[at + 1 : right]:
                n = n << 7 | k & 0x7F
        return kind, n, at

    def node(self, data: bytes, right: int) -> Node:
        kind, n, at = self.tag(data, right)
        if kind == "name":
            own = n - len(LITERALS)
            name = LITERALS[n][0] if own < 0 else self.refs[own] if own < len(self.refs) else f"#{own}"
            return Node(kind, n, at, right, at, name)
        body = n if kind in SIZED else (n + 1) // 2 if kind == "hex" else (6 * n + 7) // 8 if kind == "b64" else 0
        return Node(kind, n, at, right, at - body)

    def text(self, data: bytes, x: Node) -> str:
        raw = data[x.left : x.tag_at]
        if x.kind == "str":
            return raw.decode("utf-8", "replace")
        return unpack_digits(raw, x.number, 4 if x.kind == "hex" else 6)


WIRES = {"text": TextWire, "binary": BinaryWire}


@lru_cache(64)
def wire_of(fmt: str, ref_names: tuple[str, ...] = ()):
    if fmt not in WIRES:
        raise ValueError(f"format must be one of {sorted(WIRES)}, not {fmt!r}")
    return WIRES[fmt](ref_names)
