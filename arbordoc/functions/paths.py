"""Lookups by key, index and path in VARIANT and JSON columns, with and without errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Step = str | int


def json_path(*steps: Step) -> str:
    """The path expression of keys (strings) and indexes (integers)."""
    out = "$"
    for s in steps:
        if isinstance(s, int):
            out += f"[{s}]"
        elif '"' in s:
            raise ValueError(f"a key with a double quote needs lookup by map entries: {s!r}")
        else:
            out += f'["{s}"]'
    return out


def path_get(json: Column, *steps: Step, to: str = "string") -> Column:
    """The scalar at a path of JSON text, NULL if missing (JSON null too). Keys that JSON paths can't write (with an apostrophe or a question mark, "*", "") go through VARIANT."""
    if any(isinstance(s, str) and (s in ("", "*") or "'" in s or "?" in s) for s in steps):
        return F.try_variant_get(F.try_parse_json(json), json_path(*steps), "string").cast(to)
    path = "$" + "".join(f"[{s}]" if isinstance(s, int) else f"['{s}']" for s in steps)
    return F.get_json_object(json, path).cast(to)


def variant_at(v: Column, *steps: Step, to: str = "variant") -> Column:
    """The value at a path of a VARIANT: NULL if missing or not of the type; JSON null stays a VARIANT null."""
    return F.try_variant_get(v, json_path(*steps), to)


def has_key(v: Column, key: str) -> Column:
    """Is the key there, with JSON null too?"""
    if '"' in key:  # no path can write it
        return F.coalesce(F.array_contains(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")), key), F.lit(False))
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)) & variant_at(v, key).isNotNull()


def is_json_null(v: Column, *steps: Step) -> Column:
    return F.coalesce(F.is_variant_null(variant_at(v, *steps)), F.lit(False))


def is_missing(v: Column, *steps: Step) -> Column:
    return variant_at(v, *steps).isNull()


def path_strict(v: Column, *steps: Step, to: str = "variant") -> Column:
    """As variant_at, but a step that leads nowhere raises an error that tells the step and what stands there.

    Steps of lists are integers from 0 on (digits of a string too), those of maps are keys.
    """
    out = v
    for s in steps:
        kind = F.schema_of_variant(out)
        is_list, is_map = kind.startswith("ARRAY"), kind.startswith("OBJECT")
        digits = isinstance(s, int) or s.isascii() and s.isdigit()
        here = F.coalesce(kind, F.lit("NULL"))
        in_list = variant_at(out, int(s)) if digits and int(s) >= 0 else F.lit(None)
        in_map = variant_at(out, str(s))
        bad_list = f"index {s} is out of range" if digits else f"{s!r} is not an index of a list"
        fail = lambda text: F.raise_error(F.concat(F.lit(text + ", in "), here))  # noqa: E731, B023
        ok = F.when(is_list, in_list.isNotNull()).when(is_map, in_map.isNotNull()).otherwise(F.lit(False))
        told = F.when(is_list, fail(bad_list)).when(is_map, fail(f"key {s!r} is missing")).otherwise(fail(f"no key {s!r} in a scalar"))
        step = F.when(is_list, in_list).otherwise(in_map) if digits and int(s) >= 0 else in_map
        out = F.when(ok, step).otherwise(F.parse_json(told.cast("string")))
    return out if to == "variant" else F.variant_get(out, "$", to)


def string_equals(v: Column, text: str) -> Column:
    """False, never an error, for what isn't a string."""
    return F.coalesce((F.schema_of_variant(v) == "STRING") & (F.try_variant_get(v, "$", "string") == text), F.lit(False))


def string_compare(v: Column, text: str) -> Column:
    """-1, 0 or 1 in byte order; NULL for what isn't a string."""
    s = F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
    return F.when(s < text, -1).when(s == text, 0).when(s > text, 1)


def string_has_prefix(v: Column, prefix: str) -> Column:
    return F.coalesce((F.schema_of_variant(v) == "STRING") & F.startswith(F.try_variant_get(v, "$", "string"), F.lit(prefix)), F.lit(False))


def child_count(v: Column) -> Column:
    """Children of a list or entries of a map; 0 for scalars."""
    kind = F.schema_of_variant(v)
    n = F.when(kind.startswith("ARRAY"), F.size(F.try_variant_get(v, "$", "array<variant>"))).when(kind.startswith("OBJECT"), F.size(F.try_variant_get(v, "$", "map<string,variant>")))
    return n.otherwise(0).cast("long")
