"""The encoding itself as rows: one row per encoded node."""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from ..sources.cursor import Document, to_json

FIELDS = (("node", "int", pa.int32()), ("parent", "int", pa.int32()), ("ord", "int", pa.int32()), ("depth", "int", pa.int32()), ("kind", "string", pa.string()), ("tag", "string", pa.string()), ("number", "long", pa.int64()), ("name", "string", pa.string()), ("left", "long", pa.int64()), ("tag_at", "long", pa.int64()), ("right", "long", pa.int64()), ("size", "long", pa.int64()), ("leads_to", "long", pa.int64()))


def encoding_nodes(df: DataFrame, id_col: str, payload_col: str, fmt: str = "text", refs: Mapping[str, Any] | None = None) -> DataFrame:
    """id and one row per encoded node (see Document.nodes): pointers, chains, layouts and indexes stay rows. left: where the node's bytes begin; right: where they end.

    A child's parent is the node number within its document; ord counts from the right end, which is the logical order. NULL payloads give no rows.
    """

    def run(batches):
        for b in batches:
            at, rows = [], []
            for i, raw in enumerate(b.column(1)):
                if raw.as_py() is not None:
                    for x in Document(raw.as_py(), fmt, refs).nodes():
                        at.append(i)
                        rows.append(x)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), *(pa.array([r[n] for r in rows], t) for n, _, t in FIELDS)], names=["id", *(n for n, _, _ in FIELDS)])

    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(id_col, payload_col).mapInArrow(run, f"id {kind}, " + ", ".join(f"`{n}` {t}" for n, t, _ in FIELDS))
    return out.withColumnRenamed("id", id_col)


def resolve(nodes: DataFrame, id_col: str, hops: int = 100) -> DataFrame:
    """nodes with `resolved`: the node number that a pointer leads to at last (a pointer's own number for other nodes is their own). At most `hops` joins, but
    only while pointers lead to pointers; each is written, so that the next starts from it."""
    ends = nodes.select(F.col(id_col).alias("_d"), F.col("right").alias("_r"), F.col("node").alias("_n"), F.col("leads_to").alias("_l"))
    cur = nodes.withColumn("_to", F.col("leads_to")).withColumn("resolved", F.when(F.col("leads_to").isNull(), F.col("node")))
    for _ in range(hops):
        hit = cur.join(ends, (F.col(id_col) == F.col("_d")) & (F.col("_to") == F.col("_r")), "left")
        # of nodes that end at one place, the innermost pointer's target is the one that isn't a part of another
        cur = cut(hit.withColumn("resolved", F.coalesce("resolved", F.when(F.col("_l").isNull(), F.col("_n")))).withColumn("_to", F.col("_l")).select(*nodes.columns, "_to", "resolved"))
        if cur.where("_to is not null").isEmpty():
            break
    return cur.drop("_to")


def semantic_nodes(nodes: DataFrame, id_col: str) -> DataFrame:
    """Without what only serves the encoding: indexes, and the name or pointer that stands for the keys of a map with a shared layout."""
    told = resolve(nodes, id_col)
    one = nodes.select(F.col(id_col).alias("_d"), F.col("node").alias("_n"), F.col("kind").alias("_k"))
    up, to = (one.toDF("_d", "_n", k).alias(a) for a, k in (("up", "_up"), ("to", "_to")))
    x = told.join(up, (F.col(id_col) == F.col("up._d")) & (F.col("parent") == F.col("up._n")), "left")
    x = x.join(to, (F.col(id_col) == F.col("to._d")) & (F.col("resolved") == F.col("to._n")), "left")
    # the keys of a map are strings, so such a first child is no key
    layout = (F.col("_up") == "map") & (F.col("ord") == 0) & ((F.col("kind") == "name") | (F.col("kind") == "ptr") & F.col("_to").isin("map", "list"))
    return x.where((F.col("kind") != "index") & ~F.coalesce(layout, F.lit(False))).select(*nodes.columns)


ENTRY = "pos long, key string, at long, kind string, value string"


def encoding_entries(df: DataFrame, id_col: str, payload_col: str, path: list[str] = [], fmt: str = "text", prefix: str | None = None, key: str | None = None, at: int | None = None, refs: Mapping[str, Any] | None = None) -> DataFrame:  # noqa: B006
    """id and one row per child of the container at a path: pos, key (NULL in lists), at (the right end of the child's node, pointers followed), its kind, and its value as JSON text.

    prefix: only keys that begin with it; key: only this key; at: only the child at this position. They read no more of the document than they must: keys are found by bisection
    where the map has an index (pos is NULL then). Other children stay unread. NULL payloads, and paths that lead nowhere or to no container, give no rows.
    """

    def rows(raw):
        d = Document(raw, fmt, refs)
        right = d.seek(path)
        x = None if right is None else d.target(right)
        if x is None or x.kind not in ("list", "map"):
            return
        if key is not None:
            found = [] if (r := d.find(x, key)) is None else [(None, key, r)]
        elif prefix is not None:
            found = ((None, k, r) for k, r in d.prefix(x, prefix))
        elif x.kind == "list":
            found = ((i, None, r) for i, r in enumerate(d.children(x))) if at is None else [] if (r := d.at(x, at)) is None else [(at, None, r)]
        else:
            found = ((i, k, r) for i, (k, r) in enumerate(d.entries(x)) if at is None or i == at)
        for i, k, r in found:
            t = d.target(r)
            yield i, k, t.right, t.kind, to_json(d.value(r))

    def run(batches):
        for b in batches:
            own, out = [], []
            for i, raw in enumerate(b.column(1)):
                if raw.as_py() is not None:
                    got = list(rows(raw.as_py()))
                    own += [i] * len(got)
                    out += got
            cols = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(own, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string())))], names=["id", "pos", "key", "at", "kind", "value"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, payload_col).mapInArrow(run, f"id {kind}, {ENTRY}").withColumnRenamed("id", id_col)


def ast(data: bytes, fmt: str = "text", refs: Mapping[str, Any] | None = None) -> dict[str, Any]:
    """The nodes of one document as a tree: tag, left, right, size, children."""
    made: dict[int, dict[str, Any]] = {}
    for x in Document(data, fmt, refs).nodes():
        me = made[x["node"]] = {"tag": x["tag"], "kind": x["kind"], "left": x["left"], "right": x["right"], "size": x["size"]}
        if x["parent"] >= 0:
            made[x["parent"]].setdefault("children", []).append(me)
    return made[0]


def ast_json(data: bytes, fmt: str = "text") -> str:
    return json.dumps(ast(data, fmt))
