"""python -m arbordoc.cli show | convert | inspect | stats | hexdump | demo | completions | help: one document at a time, without Spark."""

from __future__ import annotations

import argparse
import json
import os
import re
import sys
from collections.abc import Iterable

from .operators.inspection import ast
from .sources.cursor import to_json
from .sources.display import coloured, hexdump, wants_colour
from .sources.documents import format_of_name, parse_bytes, render_bytes, render_to
from .sources.encoder import Options, encode
from .sources.tree import tree

FORMATS = ("tree", "json", "text", "binary")
SAMPLE = {"title": "orchard", "rows": [{"tree": "apple", "age": 12}, {"tree": "pear", "age": 7}], "open": True, "note": None}
#: The shells' hooks ask `complete` for candidates, one a line.
COMPLETION = """_arbordoc() {
    mapfile -t COMPREPLY < <(python -m arbordoc.cli complete -- "${COMP_WORDS[@]:1:COMP_CWORD}" 2>/dev/null)
}
complete -o default -F _arbordoc arbordoc
"""
SHELLS = {"bash": COMPLETION, "zsh": "autoload -U +X bashcompinit && bashcompinit\n" + COMPLETION.replace("mapfile -t COMPREPLY < <(", "COMPREPLY=(${(f)\"$(").replace("2>/dev/null)", '2>/dev/null)"})')}


class PathError(LookupError):
    pass


def follow(v, path: list[str]):
    """The value at a path; PathError with the reason otherwise."""
    for step in path:
        if isinstance(v, list):
            if not re.fullmatch(r"[0-9]+", step):
                raise PathError(f"{step!r} is not an index of a list")
            if int(step) >= len(v):
                raise PathError(f"index {step} is out of range (length {len(v)})")
            v = v[int(step)]
        elif isinstance(v, dict):
            if step not in v:
                raise PathError(f"key {step!r} is missing")
            v = v[step]
        else:
            raise PathError(f"no key {step!r} in a {type(v).__name__}")
    return v


def raw(src: str) -> bytes:
    if src == "-":
        return sys.stdin.buffer.read()
    with open(src, "rb") as f:
        return f.read()


def read(src: str, fmt: str | None = None):
    return parse_bytes(raw(src), fmt or (format_of_name(src) if src != "-" else None))


def put(data: bytes, to: str | None) -> None:
    if to in (None, "-"):
        sys.stdout.buffer.write(data)
        sys.stdout.flush()
    else:
        with open(to, "wb") as f:
            f.write(data)


def output_format(flag: str | None) -> str:
    """The flag, else ARBORDOC_FORMAT, else a tree on a terminal and JSON elsewhere."""
    return flag or os.environ.get("ARBORDOC_FORMAT") or ("tree" if sys.stdout.isatty() else "json")


def nearest(typed: str, known: Iterable[str]) -> str | None:
    """The known word with the fewest edits from a mistyped one: a third of its own length at most, or two."""
    best = min(((edits(typed, k), i, k) for i, k in enumerate(known)), default=None)
    return best[2] if best and best[0] <= max(2, len(best[2]) // 3) else None


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def completions(words: list[str], commands: dict[str, argparse.ArgumentParser]) -> list[str]:
    """What the last word may go on as: commands, options, formats, or keys and indexes at the path so far. Nothing where the shell's file names are meant."""
    *before, typed = words or [""]
    if not before:
        found = list(commands)
    elif before[0] not in commands:
        found = []
    elif typed.startswith("-"):
        found = options_of(commands[before[0]])
    elif before[-1] in ("-f", "--format", "--from", "--to"):
        found = list(FORMATS)
    elif before[0] == "completions":
        found = list(SHELLS)
    elif before[0] == "show" and len(before) > 1:
        try:
            v = follow(read(before[1]), before[2:])
        except (PathError, OSError, ValueError):
            return []
        found = list(v) if isinstance(v, dict) else [str(i) for i in range(len(v))] if isinstance(v, list) else []
    else:
        found = []
    return [x for x in found if x.startswith(typed)]


def options_of(p: argparse.ArgumentParser) -> list[str]:
    return [o for action in p._actions for o in action.option_strings]


def demo(colour: bool) -> str:
    """One value in every form."""
    paint = coloured if colour else str
    text, binary = encode(SAMPLE), encode(SAMPLE, "binary")
    parts = ("tree", paint(tree(SAMPLE))), ("json", paint(json.dumps(SAMPLE, indent=2))), (f"text, {len(text)} bytes", text.decode()), (f"binary, {len(binary)} bytes", hexdump(binary).rstrip("\n"))
    return "\n\n".join(f"{title}\n{body}" for title, body in parts) + "\n"


def parsers() -> tuple[argparse.ArgumentParser, dict[str, argparse.ArgumentParser]]:
    p = argparse.ArgumentParser(prog="arbordoc", description=__doc__)
    p.add_argument("--version", action="version", version="0.1.0")
    sub = p.add_subparsers(dest="command", required=True)
    show = sub.add_parser("show", help="print a document, or the value at a path of it")
    show.add_argument("file", nargs="?", default="-")
    show.add_argument("path", nargs="*")
    show.add_argument("-f", "--format", choices=FORMATS)
    show.add_argument("-w", "--width", type=int, default=80)
    show.add_argument("-o", "--output")
    show.add_argument("--color", action=argparse.BooleanOptionalAction, help="colours, whether or not a terminal reads")
    conv = sub.add_parser("convert", help="write a document in another format")
    conv.add_argument("src")
    conv.add_argument("dst")
    conv.add_argument("--from", dest="from_", choices=FORMATS[1:])
    conv.add_argument("--to", choices=FORMATS)
    conv.add_argument("--index-over", type=float, default=16)
    conv.add_argument("--chain-over", type=int, default=24)
    conv.add_argument("--delimiters", default="/.")
    conv.add_argument("--share-below", type=float, default=32)
    for name, text in (("inspect", "print the encoding's nodes as JSON"), ("stats", "print sizes in all formats"), ("hexdump", "print a file's bytes")):
        sub.add_parser(name, help=text).add_argument("file", nargs="?", default="-")
    sub.add_parser("demo", help="print a sample in every form")
    sub.add_parser("completions", help="print a shell's hook for completions").add_argument("shell", choices=SHELLS)
    sub.add_parser("help", help="print the help of a command").add_argument("topic", nargs="?")
    return p, dict(sub.choices)


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    p, commands = parsers()
    if argv[:2] == ["complete", "--"]:
        put("".join(x + "\n" for x in completions(argv[2:], commands)).encode(), None)
        return 0
    if argv and not argv[0].startswith("-") and argv[0] not in commands:
        near = nearest(argv[0], commands)
        print(f"arbordoc: unknown command {argv[0]!r}" + (f"; did you mean {near!r}?" if near else ""), file=sys.stderr)
        return 2
    a, rest = p.parse_known_args(argv)
    if rest:
        near = nearest(rest[0].partition("=")[0], options_of(commands[a.command]))
        print(f"arbordoc {a.command}: unknown argument {rest[0]!r}" + (f"; did you mean {near!r}?" if near else ""), file=sys.stderr)
        return 2
    try:
        if a.command == "show":
            v, fmt = follow(read(a.file), a.path), output_format(a.format)
            data = (tree(v, a.width) + "\n").encode() if fmt == "tree" else render_bytes(v, fmt) + (b"\n" if fmt != "binary" else b"")
            terminal = a.output in (None, "-") and sys.stdout.isatty()
            put(coloured(data.decode()).encode() if fmt in ("tree", "json") and wants_colour(a.color, terminal) else data, a.output)
        elif a.command == "convert":
            to = a.to or format_of_name(a.dst)
            if to is None:
                p.error("the format of DST isn't known: pass --to")
            v, options = read(a.src, a.from_), Options(a.index_over, a.chain_over, a.delimiters, a.share_below)
            if a.dst == "-":
                render_to(sys.stdout.buffer, v, to, options)
                sys.stdout.flush()
            else:
                with open(a.dst, "wb") as f:
                    render_to(f, v, to, options)
        elif a.command == "hexdump":
            put(hexdump(raw(a.file)).encode(), None)
        elif a.command == "demo":
            put(demo(wants_colour(None, sys.stdout.isatty())).encode(), None)
        elif a.command == "completions":
            put(SHELLS[a.shell].encode(), None)
        elif a.command == "help":
            put((commands.get(a.topic, p)).format_help().encode(), None)
        elif a.command == "inspect":
            put((json.dumps(ast(encode(read(a.file)))) + "\n").encode(), None)
        else:
            v = read(a.file)
            sizes = {"json": len(to_json(v).encode()), "text": len(encode(v)), "binary": len(encode(v, "binary"))}
            put("".join(f"{k:7}{n:12}  {100 * (1 - n / sizes['json']):5.1f} % smaller\n" for k, n in sizes.items()).encode(), None)
    except PathError as e:
        print(f"arbordoc: {e}", file=sys.stderr)
        return 2
    except (OSError, ValueError) as e:
        print(f"arbordoc: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
