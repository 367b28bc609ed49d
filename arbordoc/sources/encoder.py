"""Values to bytes: one encoder for both wire forms."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from decimal import Decimal
from functools import lru_cache
from typing import Any

from .wire import UNDEFINED, wire_of, zigzag

SAFE = 2**53 - 1
PLAIN = (str, int, float, type(None))


@dataclass(frozen=True)
class Options:
    """Per call, never global. Containers with more than index_over children get an index, strings longer than chain_over are split at delimiters after prefixes
    already known, and containers of fewer than share_below nodes are shared when they repeat."""

    index_over: float = 16
    chain_over: int = 24
    delimiters: str = "/."
    share_below: float = 32
    refs: Mapping[str, Any] = field(default_factory=dict)

    def __post_init__(self):
        if not self.delimiters.isascii():
            raise ValueError("delimiters must be ASCII")


def split_number(x: int | float) -> tuple[int, int]:
    """x as (m, e) with x = m * 10**e, m without trailing zeros. A fraction keeps 14 significant digits (15 where it is very large or small); integers are exact."""
    if x == int(x) and abs(x) < 10**21:
        n = int(x)
        if abs(n) < 10:
            return n, 0
        digits = str(n)
        m = digits.rstrip("0")
        return int(m), len(digits) - len(m)
    size = math.floor(math.log10(abs(x))) if isinstance(x, float) else len(str(abs(x))) - 1
    whole, _, rest = f"{x if isinstance(x, float) else Decimal(x):.{13 if -7 < size < 14 else 14}e}".partition(".")
    rest, _, exp = rest.partition("e")
    digits = whole + rest
    m = digits.rstrip("0")
    return int(m), int(exp) - len(rest) + len(digits) - len(m)


def identity(value: Any) -> str:
    """Text that is equal for equal values of one type and different for all others: order of keys counts, and no string is taken for a list."""
    if isinstance(value, str):
        return "s" + json.dumps(value)
    if isinstance(value, list | tuple):
        return "[" + ",".join(map(identity, value)) + "]"
    if isinstance(value, Mapping):
        return "{" + ",".join(f"{json.dumps(k)}:{identity(v)}" for k, v in value.items()) + "}"
    if value is UNDEFINED:
        return "u"
    if isinstance(value, float) and value == value and abs(value) < 1e300 and value == int(value):
        value = int(value)
    return "c" + repr(value)


@lru_cache(16)
def any_of(delimiters: str) -> re.Pattern | None:
    return re.compile(f"[{re.escape(delimiters)}]") if delimiters else None


def utf16_length(s: str) -> int:
    return len(s) if s.isascii() else len(s.encode("utf-16-le", "surrogatepass")) // 2


FLAT = frozenset((str, int))


def _cheap(v: Any) -> bool:
    if v is None or v is UNDEFINED or isinstance(v, bool):
        return True
    if isinstance(v, str):
        return utf16_length(v) <= 1
    return isinstance(v, int | float) and v == v and abs(v) <= 2048 and v == int(v)


def _key(v: Any) -> Any:
    """What tells a value that is no container from others of any kind, as a dictionary's key."""
    if isinstance(v, str):
        return v
    if isinstance(v, float) and (v != v or abs(v) >= 1e300):
        return "float", repr(v)
    return ("constant", id(v)) if v is None or v is UNDEFINED or isinstance(v, bool) else v  # 1 and 1.0 are one value, and equal as keys


def write_document(document: Any, fmt: str, o: Options, emit: Callable[[bytes], Any], int_head: Callable[[int], bytes] | None = None) -> int:
    """Gives the document's bytes to emit, piece by piece, and returns their number. Its functions share their state as variables, which many small documents gain from."""
    wire = wire_of(fmt, tuple(o.refs))
    head, heads = wire.head, wire.heads
    int_head, ptr_head, list_head, map_head = int_head or heads["int"], heads["ptr"], heads["list"], heads["map"]
    index_over, share_below, chain_over, least_layout = o.index_over, o.share_below, o.chain_over, wire.least_layout
    ref_names = {identity(v): k for k, v in o.refs.items()} if o.refs else {}
    seen: dict[Any, tuple[int, int]] = {}
    layouts: dict[tuple[str, ...], int | str] = {}
    for name, v in o.refs.items():
        keys = tuple(v) if isinstance(v, Mapping | list | tuple) else ()
        if keys and all(isinstance(k, str) for k in keys):
            layouts[keys] = name
    prefixes: set[str] = set()
    small: dict[int, Any] = {}
    known: dict[tuple, Any] = {}
    delimiter = any_of(o.delimiters)
    pos = 0

    def put(data: bytes) -> None:
        nonlocal pos
        emit(data)
        pos += len(data)

    def measure(value: Any) -> tuple[int, Any]:
        """Number of nodes below and with value, and its key. Small containers are noted with theirs: one object for all that are equal, order of keys included."""
        if isinstance(value, PLAIN):
            return 1, _key(value)
        if type(value) is dict or not isinstance(value, list | tuple) and isinstance(value, Mapping):
            own: Any = tuple(value.values())
            n = 1 + 2 * len(own)
            if not FLAT.issuperset(map(type, own)):
                n, told = 1 + len(own), []
                for v in own:
                    m, k = (1, v) if (kind := type(v)) is str or kind is int else measure(v)
                    n += m
                    told.append(k)
                own = tuple(told)
            parts: tuple = ("{", tuple(value), own)
        elif isinstance(value, list | tuple):
            n, told = 1, ["["]
            for v in value:
                m, k = (1, v) if (kind := type(v)) is str or kind is int else measure(v)
                n += m
                told.append(k)
            parts = tuple(told)
        else:
            return 1, _key(value)
        if n >= share_below:
            return n, None
        own = small[id(value)] = known.setdefault(parts, (len(known),))
        return n, own

    def write(v: Any, may_ref: bool = True) -> None:
        nonlocal pos
        if may_ref and ref_names and (name := ref_names.get(identity(v))) is not None:
            return put(wire.ref(name))
        kind = type(v)
        if kind is str:
            if len(v) < 2 and not ref_names and _cheap(v):
                return string(v)
            key = v
        elif kind is int:
            if -2048 <= v <= 2048 and not ref_names:
                return number(v)
            key = v
        elif v is None or v is UNDEFINED or kind is bool:
            return body(v)
        elif isinstance(v, PLAIN):
            if not ref_names and _cheap(v):
                return body(v)
            key = _key(v)
        else:
            key = small.get(id(v))
        if key is None:
            return body(v)
        if (before_now := seen.get(key)) is not None:
            short = ptr_head(pos - before_now[0])
            if len(short) < before_now[1]:
                emit(short)
                pos += len(short)
                return
        before = pos
        if kind is str:
            string(v)
        elif kind is int:
            number(v)
        else:
            body(v)
        seen[key] = pos, pos - before

    def body(v: Any) -> None:
        kind = type(v)
        if kind is dict:
            mapping(v)
        elif isinstance(v, str):
            string(v)
        elif v is None or v is UNDEFINED or isinstance(v, bool):
            put(wire.constant("undef" if v is UNDEFINED else "null" if v is None else "true" if v else "false"))
        elif isinstance(v, int | float):
            number(v)
        elif isinstance(v, list | tuple):
            start = pos
            children(v)
            put(list_head(pos - start))
        elif isinstance(v, Mapping):
            mapping(v)
        else:
            raise TypeError(f"can't encode {type(v).__name__}")

    def number(x: int | float) -> None:
        nonlocal pos
        if type(x) is int and -(10**21) < x < 10**21 and (x % 100000 or not x):  # with fewer than five zeros at its end it is written as it is
            data = int_head(2 * x if x >= 0 else -2 * x - 1)
            emit(data)
            pos += len(data)
            return
        if isinstance(x, float) and not math.isfinite(x):
            return put(wire.constant("nan" if x != x else "inf" if x > 0 else "ninf"))
        m, e = split_number(x)
        if 0 <= e < 5:
            return put(int_head(zigzag(m * 10**e)))
        put(int_head(zigzag(m)) + head("exp", zigzag(e)))

    def string(s: str) -> None:
        nonlocal pos
        if delimiter and 2 * len(s) > chain_over and utf16_length(s) > chain_over:
            cuts = [m.start() for m in delimiter.finditer(s, 1)]
            cut = next((i for i in reversed(cuts) if s[:i] in prefixes), None)
            if cut is not None:
                start = pos
                write(s[cut:], False)
                write(s[:cut], False)
                return put(head("chain", pos - start))
            prefixes.update(s[:i] for i in cuts)
        data = wire.string(s)
        emit(data)
        pos += len(data)

    def index(ends: list[int]) -> None:
        far = [pos - e for e in ends]
        width = wire.slot_width(max(far))
        if width > 8:
            raise OverflowError("container too large for an index")
        put(b"".join([wire.slot(d, width) for d in far]))
        put(head("index", len(ends) * 8 + width - 1))

    def children(values: Any) -> None:
        nonlocal pos
        ends: list[int] | None = [] if len(values) > index_over else None
        for v in reversed(values):
            if type(v) is int and -2048 <= v <= 2048 and not ref_names:
                data = int_head(2 * v if v >= 0 else -2 * v - 1)
                emit(data)
                pos += len(data)
            else:
                write(v)
            if ends is not None:
                ends.append(pos)
        if ends is not None:
            index(ends[::-1])

    def mapping(v: Mapping[str, Any]) -> None:
        nonlocal pos
        keys = tuple(v)
        shared = layouts.get(keys)
        if shared is None and not all([isinstance(k, str) for k in keys]):
            raise TypeError("keys must be strings")
        start = pos
        if len(keys) < least_layout:
            shared = None
        if shared is not None:
            children(list(v.values()))
            data = wire.ref(shared) if isinstance(shared, str) else ptr_head(pos - shared)
            pos += len(data)
            emit(data)
            data = map_head(pos - start)
            pos += len(data)
            emit(data)
            return
        ends: dict[str, int] = {}
        for k in reversed(keys):
            write(v[k])
            write(k, False)
            ends[k] = pos
        if len(keys) > index_over:
            index([ends[k] for k in sorted(keys, key=lambda k: k.encode("utf-8", "replace"))])
        put(map_head(pos - start))
        if keys:
            layouts[keys] = pos

    try:
        measure(document)
        write(document)
    finally:
        measure = write = body = string = children = mapping = None  # type: ignore[assignment]  # they hold each other, and would wait for the garbage collector
    return pos


DEFAULT = Options()


def encode(value: Any, fmt: str = "text", options: Options | None = None) -> bytes:
    """value (None, bool, int, float, str, list, dict, UNDEFINED) as one document."""
    parts: list[bytes] = []
    write_document(value, fmt, options or DEFAULT, parts.append)
    return b"".join(parts)


def encode_to(value: Any, put: Callable[[int, bytes], Any], fmt: str = "text", options: Options | None = None, chunk_size: int = 65536) -> int:
    """Calls put(offset, chunk) while the document is written, with chunks of chunk_size bytes but for the last, so no more than a chunk and a node is held. Returns the number of bytes."""
    held, done = bytearray(), 0

    def emit(data: bytes) -> None:
        nonlocal done
        held.extend(data)
        whole = len(held) // chunk_size * chunk_size
        for at in range(0, whole, chunk_size):
            put(done + at, bytes(held[at : at + chunk_size]))
        if whole:
            del held[:whole]
            done += whole

    size = write_document(value, fmt, options or DEFAULT, emit)
    if held:
        put(done, bytes(held))
    return size


def encode_chunks(value: Any, fmt: str = "text", options: Options | None = None, chunk_size: int = 65536) -> Iterator[tuple[int, bytes]]:
    """The bytes of encode as (offset, chunk) with chunks of chunk_size bytes, but for the last. Holds the whole document, which encode_to doesn't."""
    data = encode(value, fmt, options)
    for at in range(0, len(data), chunk_size):
        yield at, data[at : at + chunk_size]
