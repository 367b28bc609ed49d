"""Values as indented text."""

from __future__ import annotations

import json
import re

from .cursor import plain
from .wire import UNDEFINED


def bare(key: str) -> str:
    return key if re.fullmatch(r"[A-Za-z_][A-Za-z0-9_-]*", key) else json.dumps(key, ensure_ascii=False)


def scalar(v) -> str:
    if v is UNDEFINED:
        return "undefined"
    if isinstance(v, float) and (v != v or v in (float("inf"), float("-inf"))):
        return {"nan": "NaN", "inf": "Infinity", "-inf": "-Infinity"}[str(v)]
    return json.dumps(plain(v), ensure_ascii=False)


def tree(v, width: int = 80, depth: int = 0) -> str:
    """Indented text; a container of scalars stays on one line if it fits."""
    pairs = [(f"{bare(k)}: ", x) for k, x in v.items()] if isinstance(v, dict) else [("", x) for x in v] if isinstance(v, list) else None
    if pairs is None:
        return scalar(v)
    a, b = "{}" if isinstance(v, dict) else "[]"
    if not pairs:
        return a + b
    if not any(isinstance(x, dict | list) and x for _, x in pairs):
        line = f"{a} " + ", ".join(k + tree(x) for k, x in pairs) + f" {b}"
        if len(line) <= width - 2 * depth:
            return line
    pad = "  " * (depth + 1)
    return f"{a}\n" + "".join(f"{pad}{k}{tree(x, width, depth + 1)}\n" for k, x in pairs) + "  " * depth + b
