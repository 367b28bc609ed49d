"""Numeric and string codecs as column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.wire import ALPHABET

DIGITS = 11  # base-64 digits of a 64-bit integer


def b64_stringify(n: Column) -> Column:
    """Digits of a non-negative integer in base 64, without leading zeros (zero: ''). Negative: error."""
    n = n.cast("long")  # shifts of 32-bit integers count modulo 32
    parts = [F.substr(F.lit(ALPHABET), (F.shiftrightunsigned(n, 6 * i).bitwiseAND(F.lit(63)) + 1).cast("int"), F.lit(1)) for i in range(DIGITS - 1, -1, -1)]
    text = F.ltrim(F.concat(*parts), F.lit("0"))
    return F.when(n < 0, F.raise_error(F.concat(F.lit("negative: "), n.cast("string"))).cast("string")).otherwise(text)


def b64_parse(s: Column) -> Column:
    """The integer of base-64 digits ('' is 0). Another character: error."""
    value = F.aggregate(F.split(s, ""), F.lit(0).cast("long"), lambda a, c: F.when(F.length(c) == 0, a).otherwise(a * 64 + F.position(c, F.lit(ALPHABET)) - 1))
    return F.when(is_b64(s), value).otherwise(F.raise_error(F.concat(F.lit("not base 64: "), s)).cast("long"))


def is_b64(s: Column) -> Column:
    return s.rlike(r"\A[0-9a-zA-Z_-]*\z")


def b64_size(n: Column) -> Column:
    """Number of base-64 digits of n (0 for 0)."""
    return F.length(b64_stringify(n)).cast("long")


def zigzag(x: Column) -> Column:
    return F.when(x >= 0, x * 2).otherwise(x * -2 - 1)


def from_zigzag(z: Column) -> Column:
    return F.when(z.bitwiseAND(F.lit(1)) == 0, F.shiftright(z, 1)).otherwise(-(F.shiftright(z, 1)) - 1)


def split_number(x: Column) -> Column:
    """struct(base, exp) with x = base * 10**exp and no trailing zeros in base; for integers (a single digit keeps exp 0). For fractions see split_fraction."""
    digits = x.cast("string")
    zeros = F.length(digits) - F.length(F.regexp_replace(digits, "0+$", ""))
    one = F.abs(x) < 10
    return F.struct(
        F.when(one, x).otherwise(F.regexp_replace(digits, "0+$", "").cast("long")).alias("base"),
        F.when(one, F.lit(0)).otherwise(zeros).cast("long").alias("exp"),
    )


def split_fraction(x: Column) -> Column:
    """The same for doubles: 14 significant digits (15 for the very large or small), rounded from the shortest digits that tell the double. NULL for NaN and the infinities."""
    x = x.cast("double")
    near = (F.abs(x) >= 1e-6) & (F.abs(x) < 1e14)
    text = F.when(near, F.format_string("%.13e", x)).otherwise(F.format_string("%.14e", x))
    digits = F.regexp_replace(F.regexp_extract(text, r"^(-?[0-9.]+)e", 1), r"\.", "")
    bare = F.regexp_replace(digits, "0+$", "")
    exp = F.regexp_extract(text, r"e([-+][0-9]+)$", 1).cast("int") - F.when(near, 13).otherwise(14) + F.length(digits) - F.length(bare)
    whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
    told = F.when(whole, split_number(F.when(whole, x).cast("long"))).otherwise(F.struct(bare.cast("long").alias("base"), exp.cast("long").alias("exp")))
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(told)


def varint_size(v: Column) -> Column:
    """Bytes of the binary form's tag and number: three bits in the first, seven in each further one."""
    out = F.when(v < 8, F.lit(1))
    for n in range(2, 10):
        out = out.when(v < (1 << (3 + 7 * (n - 1))), F.lit(n))
    return out.otherwise(F.lit(10)).cast("long")


def classify_string(s: Column) -> Column:
    """0: as it is; 1: lower-case hex digits; 2: base-64 digits. Fewer than four characters: 0."""
    return F.when(F.length(s) < 4, 0).when(s.rlike(r"\A[0-9a-f]+\z"), 1).when(s.rlike(r"\A[0-9a-zA-Z_-]+\z"), 2).otherwise(0).cast("long")


def hex_pack(s: Column) -> Column:
    """Hex digits as bytes; an odd number of digits is padded at the left."""
    return F.unhex(F.when(F.length(s) % 2 == 1, F.concat(F.lit("0"), s)).otherwise(s))


def hex_unpack(b: Column, length: Column) -> Column:
    return F.lower(F.right(F.hex(b), length))


def b64_pack(s: Column) -> Column:
    """Base-64 digits, six bits each, as bytes (zero bits at the end). The alphabet is mapped to the one of RFC 4648, whose decoder does the packing."""
    rfc = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    padded = F.concat(F.translate(s, ALPHABET, rfc), F.repeat(F.lit("A"), F.pmod(-F.length(s), F.lit(4)).cast("int")))
    return F.substring(F.unbase64(padded), F.lit(1), F.ceil(F.length(s) * 6 / 8).cast("int"))


def b64_unpack(b: Column, length: Column) -> Column:
    rfc = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    return F.left(F.translate(F.base64(b), rfc, ALPHABET), length)


def byte_length(s: Column) -> Column:
    return F.octet_length(s).cast("long")


def identity_key(v: Column) -> Column:
    """A key that is equal for equal values: digest of the JSON text with the type before it. A VARIANT doesn't keep the order of keys; where that counts, use documents.doc_identity."""
    return F.sha2(F.concat(F.schema_of_variant(v), F.lit(":"), F.to_json(v)), 256)


def edit_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b).cast("long")


def is_suggestion(typed: Column, known: Column) -> Column:
    """Near enough to be offered for a mistyped word: a third of its length, two at least."""
    return F.levenshtein(typed, known) <= F.greatest(F.lit(2), F.floor(F.length(typed) / 3).cast("int"))


def is_bare_key(k: Column) -> Column:
    """May the key stand without quotes in tree output?"""
    return k.rlike(r"\A[A-Za-z_][A-Za-z0-9_-]*\z")


def quoted_key(k: Column) -> Column:
    return F.when(is_bare_key(k), k).otherwise(F.regexp_replace(F.to_json(F.array(k)), r"^\[|\]$", ""))


def type_label(v: Column) -> Column:
    """array, object, null, or the scalar's name, of a VARIANT."""
    s = F.schema_of_variant(v)
    return F.when(s.startswith("ARRAY"), "array").when(s.startswith("OBJECT"), "object").when(s == "VOID", "null").when(s == "BOOLEAN", "boolean").when(s == "STRING", "string").otherwise("number")


def percent_smaller(size: Column, than: Column) -> Column:
    return F.round((1 - size / than) * 100, 1)
