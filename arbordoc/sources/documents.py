"""Reading, writing and converting collections of documents, and codecs as column functions."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator, Mapping
from itertools import islice
from typing import Any, BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .cursor import Document, decode, to_json
from .encoder import DEFAULT, Options, encode, encode_to, identity
from .templates import TextEncoder
from .tree import tree
from .wire import UNDEFINED, CodecError, wire_of

#: Endings of file names and what they hold; callers with other endings pass their own table.
EXTENSIONS: Mapping[str, str] = {".json": "json", ".jsonc": "json", ".adt": "text", ".adb": "binary"}

#: The ending of written files by format; trees are written, not read.
ENDINGS: Mapping[str, str] = {"json": ".json", "text": ".adt", "binary": ".adb", "tree": ".txt"}


def format_of_name(path: str, extensions: Mapping[str, str] = EXTENSIONS) -> str | None:
    return next((f for e, f in extensions.items() if path.lower().endswith(e)), None)


def format_column(path: Column, extensions: Mapping[str, str] = EXTENSIONS) -> Column:
    """The format by the path's ending, NULL for others."""
    out = None
    for e, f in extensions.items():
        hit = F.endswith(F.lower(path), F.lit(e))
        out = F.when(hit, f) if out is None else out.when(hit, f)
    return out


def strip_comments(text: str) -> str:
    """JSON text without // and /* */ comments outside strings. A comment becomes a space, so tokens stay apart."""
    out, i, n = [], 0, len(text)
    while i < n:
        c = text[i]
        if c == '"':
            j = i + 1
            while j < n and text[j] != '"':
                j += 2 if text[j] == "\\" else 1
            out.append(text[i : j + 1])
            i = j + 1
        elif text.startswith("//", i):
            end = text.find("\n", i)
            i = n if end < 0 else end
            out.append(" ")
        elif text.startswith("/*", i):
            end = text.find("*/", i + 2)
            i = n if end < 0 else end + 2
            out.append(" ")
        else:
            out.append(c)
            i += 1
    return "".join(out)


def _once(pairs):
    out = dict(pairs)
    if len(out) != len(pairs):
        raise CodecError("a key is repeated")
    return out


#: Plain JSON at a position of a text; StopIteration where none begins.
SCAN = json.JSONDecoder().scan_once


def _n_keys(value: Any) -> int:
    n, todo = 0, [value]
    for x in todo:
        if type(x) is dict:
            n += len(x)
            todo += x.values()
        elif type(x) is list:
            todo += x
    return n


def parse_json(text: str) -> Any:
    """A value from JSON text with comments allowed; repeated keys are an error."""
    if "\\" not in text:
        # colons outside strings are as many as the keys of the text: if the value has as many keys as there are colons at all, none is repeated
        try:
            value, end = SCAN(text, 0)
            if end == len(text) and text.count(":") == _n_keys(value):
                return value
        except (StopIteration, json.JSONDecodeError):
            pass
    try:
        return json.loads(text, object_pairs_hook=_once)
    except json.JSONDecodeError:  # most texts have no comments: these are looked for only where the text doesn't parse
        return json.loads(strip_comments(text), object_pairs_hook=_once)


def detect_format(data: bytes) -> str:
    """json if it parses as JSON, text if a whole text-form document ends where the bytes end, else binary if that form decodes. CodecError if none does."""
    trimmed = data.strip()
    try:
        parse_json(trimmed.decode())
        return "json"
    except (ValueError, UnicodeDecodeError):
        pass
    for fmt, raw in (("text", trimmed), ("binary", data)):
        try:
            d = Document(raw, fmt)
            if d.target(d.root).left >= 0 and d.node(d.root).left == 0:
                d.value()
                return fmt
        except (ValueError, LookupError, RecursionError):
            continue
    raise CodecError("no format fits")


def parse_bytes(data: bytes, fmt: str | None = None, refs: Mapping[str, Any] | None = None) -> Any:
    """A value from bytes; white space around JSON and text-form documents is ignored."""
    fmt = fmt or detect_format(data)
    if fmt == "json":
        return parse_json(data.decode())
    return decode(data.strip() if fmt == "text" else data, fmt, refs)


def render_bytes(value: Any, fmt: str, options: Options | None = None) -> bytes:
    return to_json(value).encode() if fmt == "json" else encode(value, fmt, options)


def render_to(out: BinaryIO, value: Any, fmt: str, options: Options | None = None) -> int:
    """Writes value to an open file and returns the number of bytes; encoded documents chunk by chunk."""
    if fmt not in ("json", "tree"):
        return encode_to(value, lambda _, chunk: out.write(chunk), fmt, options)
    data = to_json(value).encode() if fmt == "json" else (tree(value) + "\n").encode()
    out.write(data)
    return len(data)


def _per_value(f: Callable[[Any], Any], out_type: pa.DataType) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    def run(batches):
        for b in batches:
            yield pa.array([None if x is None else f(x) for x in b.to_pylist()], out_type)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return run


def _guard(f: Callable[[Any], Any], strict: bool) -> Callable[[Any], Any]:
    """Errors give None unless strict (PERMISSIVE and FAILFAST)."""

    def g(x):
        try:
            return f(x)
        except (ValueError, LookupError, RecursionError):
            if strict:
                raise
            return None

    return g


_ENCODERS: dict[tuple, TextEncoder] = {}


def text_encoder(fmt: str = "text", options: Options | None = None) -> TextEncoder:
    """The process's encoder of JSON texts; with refs, which may be any values, a new one."""
    o = options or DEFAULT
    if o.refs:
        return TextEncoder(parse_json, fmt, o)
    key = fmt, o.index_over, o.chain_over, o.delimiters, o.share_below
    if key not in _ENCODERS:
        _ENCODERS[key] = TextEncoder(parse_json, fmt, o)
    return _ENCODERS[key]


def doc_encode(j: Column, fmt: str = "text", options: Options | None = None) -> Column:
    """JSON text to an encoded document. NULL stays NULL; text that isn't JSON is an error."""
    return F.arrow_udf(_per_value(lambda s: text_encoder(fmt, options)(s), pa.binary()), "binary")(j)


def doc_identity(j: Column) -> Column:
    """A key of JSON text that is equal for equal values only: the order of keys counts, 1 and 1.0 are one value."""
    return F.arrow_udf(_per_value(lambda s: hashlib.sha256(identity(parse_json(s)).encode()).hexdigest(), pa.string()), "string")(j)


def doc_sizes(j: Column, options: Options | None = None) -> Column:
    """struct(text, binary): the bytes of both encodings of JSON text."""

    def sizes(s):
        return {f: text_encoder(f, options).size(s) for f in ("text", "binary")}

    return F.arrow_udf(_per_value(sizes, pa.struct([("text", pa.int64()), ("binary", pa.int64())])), "struct<text:bigint,binary:bigint>")(j)


def doc_bytes(payload: Column, path: list[str] = [], fmt: str = "text") -> Column:  # noqa: B006
    """struct(left, right, raw): where the node at a path stands in the document, pointers followed, and its own bytes. NULL where there is none."""

    def raw(b):
        d = Document(b, fmt)
        right = d.seek(path)
        if right is None:
            return None
        x = d.target(right)
        return {"left": x.left, "right": x.right, "raw": d.data[x.left : x.right]}

    return F.arrow_udf(_per_value(raw, pa.struct([("left", pa.int64()), ("right", pa.int64()), ("raw", pa.binary())])), "struct<left:bigint,right:bigint,raw:binary>")(payload)


def doc_tree(j: Column, width: int = 80) -> Column:
    """JSON text as indented tree text."""
    return F.arrow_udf(_per_value(lambda s: tree(parse_json(s), width), pa.string()), "string")(j)


def doc_decode(payload: Column, fmt: str = "text", refs: Mapping[str, Any] | None = None, strict: bool = True) -> Column:
    """An encoded document to JSON text (parse_json makes a VARIANT of it)."""
    return F.arrow_udf(_per_value(_guard(lambda b: to_json(decode(b, fmt, refs)), strict), pa.string()), "string")(payload)


def doc_get(payload: Column, path: list[str], fmt: str = "text", refs: Mapping[str, Any] | None = None, strict: bool = False) -> Column:
    """The value at a path as JSON text, from the bytes: only nodes on the way are read. NULL where there is none; strict: an error that tells why."""

    def get(b):
        v = Document(b, fmt, refs).get(path, strict)
        return None if v is UNDEFINED else to_json(v)

    return F.arrow_udf(_per_value(get, pa.string()), "string")(payload)


def doc_prefix(payload: Column, prefix: str, path: list[str] = [], fmt: str = "text", limit: int | None = None) -> Column:  # noqa: B006
    """Entries of the map at a path whose keys begin with prefix, as map<string, JSON text>; by bisection where the map has an index. limit: read no further than so many."""

    def scan(b):
        d = Document(b, fmt)
        right = d.seek(path)
        return [] if right is None else [(k, to_json(d.value(r))) for k, r in islice(d.prefix(d.target(right), prefix), limit)]

    return F.arrow_udf(_per_value(scan, pa.map_(pa.string(), pa.string())), "map<string,string>")(payload)


def doc_count(payload: Column, path: list[str] = [], fmt: str = "text") -> Column:  # noqa: B006
    """Number of children of the container at a path."""

    def count(b):
        d = Document(b, fmt)
        right = d.seek(path)
        return None if right is None or (x := d.target(right)).kind not in ("list", "map") else d.count(x)

    return F.arrow_udf(_per_value(count, pa.int64()), "long")(payload)


def doc_get_and_count(payload: Column, path: list[str], counted: list[str], fmt: str = "text") -> Column:
    """struct(value, n): what doc_get gives for path and doc_count for counted, from bytes that are opened once. Two functions of an encoded column would encode it twice."""

    def read(b):
        d = Document(b, fmt)
        v, right = d.get(path), d.seek(counted)
        n = None if right is None or (x := d.target(right)).kind not in ("list", "map") else d.count(x)
        return {"value": None if v is UNDEFINED else to_json(v), "n": n}

    return F.arrow_udf(_per_value(read, pa.struct([("value", pa.string()), ("n", pa.int64())])), "struct<value:string,n:bigint>")(payload)


def read_documents(spark: SparkSession, path: str, fmt: str | None = None, extensions: Mapping[str, str] = EXTENSIONS, strict: bool = True) -> DataFrame:
    """(path, format, payload, json): one row per file, by Spark's own file reader, so any store that it reads will do. fmt None: by ending, then by content.

    JSON files may have comments. strict False: files that can't be decoded have a NULL json.
    """

    def run(batches):
        for b in batches:
            fmts, texts = [], []
            for name, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    f = fmt or format_of_name(name, extensions) or detect_format(raw)
                    t = to_json(parse_bytes(raw, f))
                except (ValueError, LookupError, RecursionError):
                    if strict:
                        raise
                    f, t = fmt or format_of_name(name, extensions), None
                fmts.append(f)
                texts.append(t)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fmts, pa.string()), b.column(1), pa.array(texts, pa.string())], names=["path", "format", "payload", "json"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, format string, payload binary, json string")


def read_json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON texts, one per line, comments allowed: as VARIANT (column doc), or as columns of a declared schema, which prunes and pushes down."""
    if schema is None:
        return spark.read.option("singleVariantColumn", "doc").option("allowComments", "true").json(path)
    return spark.read.schema(schema).option("allowComments", "true").json(path)


def write_documents(df: DataFrame, json_col: str, name_col: str, path: str, fmt: str, options: Options | None = None) -> DataFrame:
    """One file per row under path, named by name_col with the format's ending (json, text, binary, or tree: indented text for readers). Returns (name, bytes). A task that runs again writes the same files again.

    path: a URI that pyarrow's file systems open, shared by all executors.
    """
    wire_of(fmt) if fmt not in ENDINGS else None
    ending = ENDINGS[fmt]

    def run(batches):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(path)
        store.create_dir(base, recursive=True)
        for b in batches:
            sizes = []
            for name, j in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with store.open_output_stream(f"{base}/{name}{ending}") as out:
                    sizes.append(render_to(out, parse_json(j), fmt, options))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64())], names=["name", "bytes"])

    return df.select(F.col(name_col).cast("string"), json_col).mapInArrow(run, "name string, bytes long")


def convert(spark: SparkSession, src: str, dst: str, to: str, options: Options | None = None) -> int:
    """Reads documents from src and writes each in the format `to` under dst, by the name of its file. Returns the number of files.

    Files that differ in their endings only keep these (x.json and x.jsonc become x.json.adb and x.jsonc.adb); two files of one name are an error.
    """
    base, full = (F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1), F.regexp_extract("path", r"([^/]*)$", 1))
    names = spark.read.format("binaryFile").load(src).select(base.alias("base"), full.alias("full")).groupBy("base").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("full").alias("k")).where("n > 1")
    if twice := names.where("n > k").first():
        raise ValueError(f"several files have the name {twice['base']!r}")
    docs = read_documents(spark, src).select("json", base.alias("base"), full.alias("full")).join(names, "base", "left")
    docs = docs.select("json", F.when(F.col("n").isNull(), F.col("base")).otherwise(F.col("full")).alias("name"))
    return write_documents(docs, "json", "name", dst, to, options).count()


def size_stats(df: DataFrame, json_col: str, options: Options | None = None) -> DataFrame:
    """n_docs and the total bytes as JSON and in both forms, with the share that each form saves."""
    j = F.col(json_col)
    per = df.where(j.isNotNull()).select(F.octet_length(j).cast("long").alias("j"), doc_sizes(j, options).alias("s")).select("j", F.col("s.text").alias("t"), F.col("s.binary").alias("b"))
    s = per.agg(F.count(F.lit(1)).alias("n_docs"), *[F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (("j", "json_bytes"), ("t", "text_bytes"), ("b", "binary_bytes"))])
    share = lambda c: F.round((1 - F.try_divide(F.col(c), F.col("json_bytes"))) * 100, 1)
    return s.withColumn("text_smaller", share("text_bytes")).withColumn("binary_smaller", share("binary_bytes"))
