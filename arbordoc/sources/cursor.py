"""Bytes to values: whole documents, or only the nodes on the way to a key, an index, a path or a prefix."""

from __future__ import annotations

import json
import math
import sys
from collections.abc import Iterator, Mapping
from typing import Any

from .wire import CONSTANTS, LITERALS, SIZED, UNDEFINED, CodecError, Node, wire_of

NAMES = {short: long for short, long in LITERALS}
MAX_HOPS = 100
STRINGS = ("str", "hex", "b64", "chain")


class Document:
    """A document's bytes with the means to walk them. Nodes are given by their right end; the root ends where the bytes end."""

    def __init__(self, data: bytes, fmt: str = "text", refs: Mapping[str, Any] | None = None):
        self.data, self.refs = bytes(data), dict(refs) if refs else {}
        self.wire = wire_of(fmt, tuple(self.refs)) if refs else wire_of(fmt)
        self.root = len(self.data)
        self._nodes: dict[int, Node] = {}
        self._layouts: dict[int, tuple[str, ...]] = {}

    def node(self, right: int) -> Node:
        """The node that ends at right, with all bytes that belong to it. Nodes that were read are kept while the document is open."""
        x = self._nodes.get(right)
        if x is None:
            kind, n, at = self.wire.tag(self.data, right)
            if kind in SIZED and n <= at:
                x = Node(kind, n, at, right, at - n)
            elif kind == "int" or kind == "ptr":
                x = Node(kind, n, at, right, at)
            else:
                x = self._read(right)
            self._nodes[right] = x
        return x

    def _skip(self, right: int) -> int:
        """Where the node that ends at right begins."""
        kind, n, at = self.wire.tag(self.data, right)
        if kind in SIZED and n <= at:
            return at - n
        return at if kind == "int" or kind == "ptr" else self.node(right).left

    def _read(self, right: int) -> Node:
        x = self.wire.node(self.data, right)
        if x.kind == "exp":
            base = self.wire.node(self.data, x.tag_at)
            if base.kind != "int":
                raise CodecError(f"an exponent without a number at {x.tag_at}")
            x = Node("exp", x.number, x.tag_at, right, base.left)
        elif x.kind == "index":
            x = Node("index", x.number, x.tag_at, right, x.tag_at - (x.number >> 3) * ((x.number & 7) + 1))
        if x.left < 0:
            raise CodecError(f"the node at {x.tag_at} is longer than the document")
        return x

    def target(self, right: int) -> Node:
        """The node at right, pointers followed."""
        x = self._nodes.get(right) or self.node(right)
        if x.kind != "ptr":
            return x
        for _ in range(MAX_HOPS):
            x = self.node(right)
            if x.kind != "ptr":
                return x
            right = x.tag_at - x.number
            if right <= 0:
                raise CodecError("a pointer leads out of the document")
        raise CodecError("pointers in a circle")

    def parts(self, x: Node) -> tuple[tuple[str, ...] | None, Node | None, int]:
        """Of a container: the keys of a shared layout, the index, and where the children's right end is."""
        right, keys, index = x.tag_at, None, None
        if x.kind == "map" and right > x.left:
            last = self.node(right)
            if last.kind == "name":
                ref = self.refs.get(last.name)
                if not isinstance(ref, Mapping | list | tuple):
                    raise CodecError(f"no layout is known by the name {last.name!r}")
                keys, right = tuple(ref), last.left
            elif last.kind == "ptr" and (t := self.target(right)).kind in ("map", "list"):
                keys, right = self.layout(t), last.left
        if right > x.left and (last := self.node(right)).kind == "index":
            index, right = last, last.left
        return keys, index, right

    def layout(self, x: Node) -> tuple[str, ...]:
        if x.right not in self._layouts:
            self._layouts[x.right] = tuple(self.value(r) for r in self.children(x)) if x.kind == "list" else tuple(k for k, _ in self.entries(x))
        return self._layouts[x.right]

    def children(self, x: Node) -> Iterator[int]:
        """Right ends of a container's children, in order; of a map without a layout of its own these are key, value, key, value..."""
        _, _, right = self.parts(x)
        while right > x.left:
            yield right
            right = self._skip(right)

    def entries(self, x: Node) -> Iterator[tuple[str, int]]:
        """(key, right end of the value) of a map, in stored order."""
        keys, _, right = self.parts(x)
        if keys is not None:
            for k, r in zip(keys, self.children(x)):
                yield k, r
            return
        while right > x.left:
            key = self.string(self.target(right))
            right = self._skip(right)
            yield key, right
            right = self._skip(right)

    def count(self, x: Node) -> int:
        """Number of children (entries of a map); from the index where there is one."""
        keys, index, _ = self.parts(x)
        if index is not None:
            return index.number >> 3
        return len(keys) if keys is not None else sum(1 for _ in self.children(x)) // (2 if x.kind == "map" else 1)

    def slot(self, index: Node, i: int) -> int:
        width = (index.number & 7) + 1
        at = index.left + i * width
        return index.left - self.wire.read_slot(self.data[at : at + width])

    def string(self, x: Node) -> str:
        if x.kind == "chain":
            out, right = [], x.tag_at
            while right > x.left:
                out.append(self.string(self.target(right)))
                right = self.node(right).left
            return "".join(out)
        if x.kind not in STRINGS:
            raise CodecError(f"a string was expected at {x.tag_at}, not {x.kind}")
        return self.wire.text(self.data, x)

    def is_string(self, right: int) -> bool:
        return self.target(right).kind in STRINGS

    def find(self, x: Node, key: str) -> int | None:
        """Right end of a key's value. With an index of its own keys, by bisection; else along the entries."""
        if x.kind != "map":
            return None
        keys, index, right = self.parts(x)
        if keys is None and index is not None:
            i = self._lower_bound(index, key.encode())
            if i < index.number >> 3:
                right = self.slot(index, i)
                if self.string(self.target(right)) == key:
                    return self.node(right).left
            return None
        if keys is not None and index is not None:
            return self.slot(index, keys.index(key)) if key in keys else None
        if keys is not None:
            return self._nth(x, right, keys.index(key)) if key in keys else None
        return next((r for k, r in self.entries(x) if k == key), None)

    def _nth(self, x: Node, right: int, i: int) -> int | None:
        """Right end of a container's child i, where the first ends at right."""
        for _ in range(i):
            if right <= x.left:
                return None
            right = self._skip(right)
        return right if right > x.left else None

    def _lower_bound(self, index: Node, key: bytes) -> int:
        lo, hi = 0, index.number >> 3
        while lo < hi:
            mid = (lo + hi) // 2
            if self.string(self.target(self.slot(index, mid))).encode() < key:
                lo = mid + 1
            else:
                hi = mid
        return lo

    def prefix(self, x: Node, prefix: str) -> Iterator[tuple[str, int]]:
        """Entries whose key begins with prefix: by bisection and in byte order with an index, else in stored order. Not a map: none."""
        if x.kind != "map":
            return
        keys, index, _ = self.parts(x)
        if keys is not None or index is None:
            yield from ((k, r) for k, r in self.entries(x) if k.startswith(prefix))
            return
        for i in range(self._lower_bound(index, prefix.encode()), index.number >> 3):
            right = self.slot(index, i)
            key = self.string(self.target(right))
            if not key.startswith(prefix):
                return
            yield key, self.node(right).left

    def at(self, x: Node, i: int) -> int | None:
        """Right end of a list's element; None beyond its ends."""
        if x.kind != "list" or i < 0:
            return None
        _, index, right = self.parts(x)
        if index is not None:
            return self.slot(index, i) if i < index.number >> 3 else None
        return self._nth(x, right, i)

    def seek(self, path: list[str], strict: bool = False) -> int | None:
        """Right end of what a path leads to. Elements of lists are given by digits. strict: raise KeyError with the reason instead of giving None."""
        right = self.root
        for depth, step in enumerate(path):
            x = self.target(right)
            if x.kind == "name" and x.name in self.refs:
                inner = walk(self.refs[x.name], path[depth:], strict)
                raise LookupError(inner)
            if x.kind == "list":
                if not (step.isascii() and step.isdigit()):
                    found, why = None, f"{step!r} is not an index of a list"
                else:
                    found, why = self.at(x, int(step)), f"index {step} is out of range (length {self.count(x)})"
            elif x.kind == "map":
                found, why = self.find(x, step), f"key {step!r} is missing"
            else:
                found, why = None, f"{x.kind} has no key {step!r}"
            if found is None:
                if strict:
                    raise KeyError(why)
                return None
            right = found
        return right

    def get(self, path: list[str], strict: bool = False) -> Any:
        """The value at a path; UNDEFINED where there is none."""
        try:
            right = self.seek(path, strict)
        except LookupError as e:
            if isinstance(e, KeyError):
                raise
            return e.args[0]
        return UNDEFINED if right is None else self.value(right)

    def value(self, right: int | None = None, memo: dict[int, Any] | None = None) -> Any:
        """The value of the node that ends at right (the root). Shared nodes give the same object. Unknown refs give UNDEFINED."""
        return self._value(self.root if right is None else right, {} if memo is None else memo)[0]

    def _value(self, right: int, memo: dict[int, Any]) -> tuple[Any, int]:
        """The value of the node that ends at right, and where the node begins. Nodes are objects only where more than their number is asked."""
        kind, n, at = self.wire.tag(self.data, right)
        if kind == "int":
            return (n >> 1) ^ -(n & 1), at
        if kind == "str":
            if n > at:
                raise CodecError(f"the node at {at} is longer than the document")
            return self.data[at - n : at].decode("utf-8", "replace"), at - n
        if kind == "ptr":
            to = self.target(right).right
            return (memo[to] if to in memo else self._value(to, memo)[0]), at
        if kind == "list":
            left = self._left(at, n)
            if right in memo:
                return memo[right], left
            v: Any = []
            memo[right] = v
            inner = self._first(right, at, left, True)[1]
            while inner > left:
                c, inner = self._value(inner, memo)
                v.append(c)
            return v, left
        if kind == "map":
            left = self._left(at, n)
            if right in memo:
                return memo[right], left
            v = memo[right] = {}
            keys, inner = self._first(right, at, left, False)
            if keys is None:
                while inner > left:
                    k, inner = self._value(inner, memo)
                    if type(k) is not str:
                        raise CodecError(f"a string was expected before {inner}")
                    v[k], inner = self._value(inner, memo)
            else:
                for k in keys:
                    if inner <= left:
                        break
                    v[k], inner = self._value(inner, memo)
            return v, left
        x = self.node(right)
        if kind == "exp":
            m, e = (((n >> 1) ^ -(n & 1)) for n in (self.wire.node(self.data, x.tag_at).number, x.number))
            v = m * 10**e if 0 <= e <= 30 else float(f"{m}e{e}")
            if v in (math.inf, -math.inf):  # the digits of the largest numbers are rounded up; infinity has a name of its own
                v = math.copysign(sys.float_info.max, m)
        elif kind in STRINGS:
            v = self.string(x)
        elif kind == "name":
            v = CONSTANTS[NAMES[x.name]] if x.name in NAMES else self.refs.get(x.name, UNDEFINED)
        else:
            raise CodecError(f"{kind} can't stand alone")
        return v, x.left

    @staticmethod
    def _left(at: int, n: int) -> int:
        if n > at:
            raise CodecError(f"the node at {at} is longer than the document")
        return at - n

    def _first(self, right: int, at: int, left: int, is_list: bool) -> tuple[tuple[str, ...] | None, int]:
        """Of the container that ends at right: the keys of a shared layout and where the children's right end is, as parts tells them."""
        if at > left:
            kind = self.wire.tag(self.data, at)[0]
            if kind == "index" or not is_list and kind in ("ptr", "name"):
                keys, _, inner = self.parts(self.node(right))
                return keys, inner
        return None, at

    def nodes(self) -> Iterator[dict[str, Any]]:
        """Every encoded node once, parents first and children from right to left, as stored: pointers, chains and indexes stay what they are."""
        todo = [(self.root, -1, 0, 0)]
        number = 0
        while todo:
            right, parent, ord_, depth = todo.pop()
            x = self.node(right)
            yield {"node": number, "parent": parent, "ord": ord_, "depth": depth, "kind": x.kind, "tag": self.data[x.tag_at : right].decode("latin-1"), "number": x.number, "name": x.name, "left": x.left, "tag_at": x.tag_at, "right": right, "size": x.body, "leads_to": x.tag_at - x.number if x.kind == "ptr" else None}
            inner = []
            if x.kind in ("list", "map", "chain", "exp"):
                r = x.tag_at
                while r > x.left:
                    inner.append((r, number, len(inner), depth + 1))
                    r = self.node(r).left
            todo += inner[::-1]
            number += 1


def decode(data: bytes, fmt: str = "text", refs: Mapping[str, Any] | None = None) -> Any:
    """The value of a whole document."""
    return Document(data, fmt, refs).value()


def walk(value: Any, path: list[str], strict: bool = False) -> Any:
    """The value at a path of plain values, by the rules of Document.get."""
    for step in path:
        if isinstance(value, list | tuple) and step.isascii() and step.isdigit() and int(step) < len(value):
            value = value[int(step)]
        elif isinstance(value, Mapping) and step in value:
            value = value[step]
        elif strict:
            raise KeyError(f"nothing at {step!r}")
        else:
            return UNDEFINED
    return value


def plain(value: Any, inside_list: bool = True) -> Any:
    """value as JSON can write it: UNDEFINED goes from maps and becomes null elsewhere, and so do NaN and the infinities."""
    kind = type(value)
    if kind is str or kind is int or value is None:
        return value
    if kind is dict or isinstance(value, Mapping):
        return {k: v if type(v) is str else plain(v) for k, v in value.items() if v is not UNDEFINED}
    if isinstance(value, list | tuple):
        return [plain(v) for v in value]
    if value is UNDEFINED or isinstance(value, float) and not math.isfinite(value):
        return None
    return int(value) if isinstance(value, float) and value == int(value) and abs(value) < 2**53 else value


COMPACT = json.JSONEncoder(ensure_ascii=False, separators=(",", ":"))


def to_json(value: Any, indent: int | None = None) -> str:
    return COMPACT.encode(plain(value)) if indent is None else json.dumps(plain(value), ensure_ascii=False, indent=indent, separators=(",", ": "))
