"""What a terminal shows: colours and hexdumps."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping

#: Terminal colours by kind of token.
COLOURS: Mapping[str, str] = {"key": "\x1b[36m", "string": "\x1b[32m", "number": "\x1b[33m", "boolean": "\x1b[35m", "null": "\x1b[90m"}
PLAIN = "\x1b[0m"
TOKEN = re.compile(r'(?P<string>"(?:[^"\\]|\\.)*")|(?P<null>-?Infinity\b)|(?P<number>-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)|(?P<word>[A-Za-z_][A-Za-z0-9_-]*)')


def token_kind(text: str, token: re.Match) -> str | None:
    """key, string, number, boolean or null; None for a word that is none of them."""
    if re.match(r"\s*:", text[token.end() : token.end() + 8]):
        return "key"
    if token.lastgroup != "word":
        return token.lastgroup
    return {"true": "boolean", "false": "boolean", "null": "null", "undefined": "null", "NaN": "null"}.get(token[0])


def coloured(text: str, colours: Mapping[str, str] = COLOURS) -> str:
    """JSON or tree text with each key and value in its colour; without the colours it is the same text."""

    def paint(token: re.Match) -> str:
        kind = token_kind(text, token)
        return f"{colours[kind]}{token[0]}{PLAIN}" if kind in colours else token[0]

    return TOKEN.sub(paint, text)


def wants_colour(flag: bool | None, terminal: bool) -> bool:
    """The flag, else FORCE_COLOR (but for 0 and false), else NO_COLOR, else whether a terminal reads."""
    if flag is not None:
        return flag
    if os.environ.get("FORCE_COLOR", "0") not in ("", "0", "false"):
        return True
    return terminal and not os.environ.get("NO_COLOR")


def hexdump(data: bytes) -> str:
    """Two hex digits a byte, 16 bytes a line."""
    return "".join(data[i : i + 16].hex(" ") + "\n" for i in range(0, len(data), 16))
