"""Enumeration: keys, elements, entries, and the table of all nodes of a document."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODE_SCHEMA = "path string, parent_path string, depth int, ord int, key string, kind string, str_val string, int_val long, num_val double, bool_val boolean, n_children int"


def keys(j: Column) -> Column:
    """Keys of a JSON object in stored order."""
    return F.json_object_keys(j)


def explode_entries(df: DataFrame, json_col: str, outer: bool = False) -> DataFrame:
    """df with key, pos and value (VARIANT) for each child of the JSON text in json_col: map entries in key order, list elements by pos (key NULL)."""
    join = "left join" if outer else "inner join"
    cols = ", ".join(f"d.`{c}`" for c in df.columns)
    return df.sparkSession.sql(f"select {cols}, e.pos, e.key, e.value from {{d}} d {join} lateral variant_explode(try_parse_json(d.`{json_col}`)) e on true", d=df)


def elements(df: DataFrame, array_col: str, value: str = "value", pos: str = "pos") -> DataFrame:
    """One row per element of an array column, with its position."""
    return df.select(*[c for c in df.columns if c != array_col], F.posexplode(array_col).alias(pos, value))


def _walk(root) -> Iterator[tuple]:
    todo = [("$", None, 0, 0, None, root)]
    while todo:
        path, parent, depth, ord_, key, v = todo.pop()
        row = [path, parent, depth, ord_, key, None, None, None, None, None, 0]
        if isinstance(v, dict):
            row[5], row[10] = "map", len(v)
            inner = [(f"{path}.{k}", path, depth + 1, i, k, x) for i, (k, x) in enumerate(v.items())]
        elif isinstance(v, list):
            row[5], row[10] = "list", len(v)
            inner = [(f"{path}[{i}]", path, depth + 1, i, None, x) for i, x in enumerate(v)]
        else:
            inner = []
            if v is None:
                row[5] = "null"
            elif isinstance(v, bool):
                row[5], row[9] = "bool", v
            elif isinstance(v, str):
                row[5], row[6] = "str", v
            elif isinstance(v, int) and -(2**63) <= v < 2**63:
                row[5], row[7] = "int", v
            elif isinstance(v, int | float):
                row[5], row[8] = "float", float(v)
            else:
                row[5] = "undef"
        yield tuple(row)
        todo += inner[::-1]


def node_rows(df: DataFrame, id_cols: list[str], payload: str, decoder) -> DataFrame:
    """id columns and one row per node, in document order; payload goes through decoder (Python, per value). A payload that is NULL or can't be decoded gives no rows.

    Rows are made batch by batch, so a task's memory doesn't grow with the number of nodes.
    """
    n = len(id_cols)
    fields = df.select(*id_cols).schema.fields
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [NODE_SCHEMA])
    kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.float64(), pa.bool_(), pa.int32())
    names = [f.name for f in fields] + [f"n{i}" for i in range(len(kinds))]

    def run(batches):
        for b in batches:
            at, rows = [], []

            def out():
                take = pa.array(at, pa.int64())
                cols = list(zip(*rows)) or [[]] * len(kinds)
                return pa.RecordBatch.from_arrays([*(b.column(i).take(take) for i in range(n)), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=names)  # noqa: B023

            for i, raw in enumerate(b.column(n)):
                raw = raw.as_py()
                if raw is None:
                    continue
                try:
                    value = decoder(raw)
                except ValueError:
                    continue
                for row in _walk(value):
                    at.append(i)
                    rows.append(row)
                    if len(rows) >= 20_000:
                        yield out()
                        at, rows = [], []
            yield out()

    return df.select(*id_cols, payload).mapInArrow(run, schema)


def node_table_json(df: DataFrame, id_cols: list[str], json_col: str) -> DataFrame:
    """The node table of JSON texts: keeps the order of keys, and tells JSON null from what is missing."""
    return node_rows(df, id_cols, json_col, json.loads)


def nesting(j: Column) -> Column:
    """How deep the containers of a JSON text stand in each other: 0 for a scalar."""
    brackets = F.regexp_replace(F.regexp_replace(j, r'"(?:\\.|[^"\\])*"', ""), r"[^\[\]{}]", "")
    step = lambda a, c: F.when(c.isin("[", "{"), F.struct((a["now"] + 1).alias("now"), F.greatest(a["most"], a["now"] + 1).alias("most"))).when(c.isin("]", "}"), F.struct((a["now"] - 1).alias("now"), a["most"].alias("most"))).otherwise(a)
    return F.aggregate(F.split(brackets, ""), F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step, lambda a: a["most"])


def node_table_sql(df: DataFrame, id_col: str, json_col: str, levels: int = 100) -> DataFrame:
    """(id, path, kind, value as JSON text, depth) by variant_explode, applied to its own rows as often as the deepest document asks (one pass finds that): JVM only; keys come in
    alphabetical order. Documents of more than `levels` levels are an error.

    Each level is made from the documents where they are, without a shuffle, so a task reads its own partition of df and no more.
    """
    spark = df.sparkSession
    roots = df.select(F.col(id_col).alias("id"), F.lit("$").alias("path"), F.try_parse_json(json_col).alias("v"), F.lit(0).alias("depth"))
    deepest = roots.agg(F.max(nesting(F.to_json("v")))).first()[0] or 0
    if deepest > levels:
        raise ValueError(f"documents have {deepest} levels, more than {levels}")
    out = level = roots
    for _ in range(deepest):
        level = spark.sql("""
            select n.id, n.path || case when e.key is null then '[' || e.pos || ']' else '.' || e.key end as path, e.value as v, n.depth + 1 as depth
            from {level} n, lateral variant_explode(n.v) e""", level=level)
        out = out.unionAll(level)
    schema = F.schema_of_variant("v")
    kind = F.when(schema.startswith("OBJECT"), "map").when(schema.startswith("ARRAY"), "list").otherwise("scalar")
    return out.select(F.col("id").alias(id_col), "path", kind.alias("kind"), F.to_json("v").alias("value"), "depth")
