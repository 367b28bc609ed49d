"""Column functions, operators, sources, streams and the command line on small inputs."""

import json
import re

import pytest
from pyspark.sql import functions as F

from arbordoc import cli
from arbordoc.functions import arrays, paths, scalars
from arbordoc.operators import inspection, layouts, lookup, nodes
from arbordoc.sources import datasource, display, documents
from arbordoc.sources.cursor import decode
from arbordoc.sources.encoder import encode
from arbordoc.sources.tree import tree
from arbordoc.sources.wire import CodecError, binary_head
from arbordoc.streaming import events
from conftest import SF


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_b64_scalars(spark):
    r = one(spark, a=scalars.b64_stringify(F.lit(0)), b=scalars.b64_stringify(F.lit(4095)), c=scalars.b64_parse(F.lit("__")), d=scalars.b64_parse(F.lit("")), e=scalars.b64_size(F.lit(64)), f=scalars.is_b64(F.lit("a b")))
    assert tuple(r) == ("", "__", 4095, 0, 2, False)
    for bad in (scalars.b64_stringify(F.lit(-1)), scalars.b64_parse(F.lit("a b"))):
        with pytest.raises(Exception, match="negative|base 64"):
            one(spark, x=bad)


def test_more_scalars(spark):
    v = F.parse_json(F.lit('[1,"x",null,true,{"a":1}]'))
    labels = [scalars.type_label(paths.variant_at(v, i)) for i in range(5)]
    assert list(one(spark, **{f"l{i}": x for i, x in enumerate(labels)})) == ["number", "string", "null", "boolean", "object"]
    r = one(spark, a=scalars.is_suggestion(F.lit("shw"), F.lit("show")), b=scalars.quoted_key(F.lit("a b")), c=scalars.quoted_key(F.lit("ab")), d=scalars.percent_smaller(F.lit(25), F.lit(100)))
    assert tuple(r) == (True, '"a b"', "ab", 75.0)


def test_strict_path_errors(spark):
    v = F.parse_json(F.lit('{"a":[1,2],"b":null}'))
    assert one(spark, x=paths.path_strict(v, "a", "1", to="int"))[0] == 2
    for steps in (("a", 5), ("a", "x"), ("c",), ("a", 0, "y"), ("a", "-1")):
        with pytest.raises(Exception, match="index|key"):
            one(spark, x=paths.path_strict(v, *steps).cast("string"))
    r = one(spark, miss=paths.is_missing(v, "c"), null=paths.is_json_null(v, "b"), has=paths.has_key(v, "b"), n=paths.child_count(v))
    assert tuple(r) == (True, True, True, 2)


def test_arrays(spark):
    a = F.array(*map(F.lit, (3, 10, 9)))
    r = one(spark, s=arrays.sort_as_text(a), v=arrays.sort_by_value(a), sl=arrays.slice_(a, 1, 99), e=arrays.slice_(a, 5), f=arrays.find_index(a, lambda x: x > 50), at=arrays.at(a, 7))
    assert [list(r.s), list(r.v), list(r.sl), list(r.e), r.f, r.at] == [[10, 3, 9], [3, 9, 10], [10, 9], [], -1, None]


def test_node_table_keeps_order_and_null(spark):
    df = spark.createDataFrame([(1, '{"b":null,"a":[1,2.5,"x",true]}'), (2, None), (3, "not json")], "id int, j string")
    rows = nodes.node_table_json(df, ["id"], "j").collect()
    assert [(r.path, r.kind, r.n_children) for r in rows] == [("$", "map", 2), ("$.b", "null", 0), ("$.a", "list", 4), ("$.a[0]", "int", 0), ("$.a[1]", "float", 0), ("$.a[2]", "str", 0), ("$.a[3]", "bool", 0)]
    assert {r.path for r in nodes.node_table_sql(df.where("id = 1"), "id", "j").collect()} == {r.path for r in rows}
    assert nodes.explode_entries(df.where("id = 1"), "j").count() == 2
    assert nodes.explode_entries(df.where("id < 3"), "j", outer=True).count() == 3


def test_lookup_operators(spark):
    df = spark.createDataFrame([("é",), ("a",), (None,), ("ab",)], "k string")
    assert sorted(r.k for r in lookup.prefix_scan(df, "k", "").collect()) == ["a", "ab", "é"]
    assert lookup.prefix_scan(df, "k", "a", limit=1).count() == 1
    assert {r.k for r in lookup.prefix_bounds(df, "k", "é").collect()} == {"é"}
    assert {r.k: r["rank"] for r in lookup.sorted_rank(df.dropna(), "k").collect()} == {"a": 0, "ab": 1, "é": 2}
    assert {r.k: r.v for r in lookup.resolve_refs(df, "k", spark.createDataFrame([("a", 1)], "n string, v int"), "n", "v", "v").collect()} == {"é": None, "a": 1, None: None, "ab": None}
    chain = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 5), (5, 4)], "i int, t int")
    assert {r.i: r.final for r in lookup.follow_pointers(chain, "i", "t").collect()} == {1: 1, 2: 1, 3: 1, 4: None, 5: None}


def test_layouts_and_cheap(spark):
    df = spark.createDataFrame([('{"b":1,"a":2}',), ('{"a":1,"b":2}',), ('{"b":3,"a":3}',)], "j string")
    assert {(r.layout, r.n_docs, r.layout_id) for r in layouts.layout_catalogue(df, "j").collect()} == {("b,a", 2, 1), ("a,b", 1, 0)}
    v = F.parse_json(F.lit('[1, 5000, "x", "xy", null, [1]]'))
    r = one(spark, **{f"c{i}": layouts.is_cheap(paths.variant_at(v, i)) for i in range(6)})
    assert list(r) == [True, False, True, False, True, False]


def test_inspection(spark):
    df = spark.createDataFrame([(1, bytearray(encode([{"x": 1}, {"x": 1}]))), (2, None)], "id int, p binary")
    n = inspection.encoding_nodes(df, "id", "p")
    rows = inspection.resolve(n, "id").collect()
    ptr = next(r for r in rows if r.kind == "ptr")
    assert next(r for r in rows if r.node == ptr.resolved).kind == "map"
    assert inspection.semantic_nodes(n, "id").count() == n.count()
    assert json.loads(inspection.ast_json(encode([1])))["children"][0]["tag"] == "+2"


def test_comments_and_detection():
    assert documents.parse_json('{"a": 1, // note\n "u": "http://x" /* more */}') == {"a": 1, "u": "http://x"}
    with pytest.raises(CodecError):
        documents.parse_json('{"a":1,"a":2}')
    v = {"a": [1, "xyz", None]}
    for fmt in ("json", "text", "binary"):
        data = documents.render_bytes(v, fmt)
        assert documents.detect_format(data) == fmt and documents.parse_bytes(data) == v
    assert documents.parse_bytes(b" " + encode(v) + b"\n", "text") == v


def test_files_round_trip(spark, tmp_path):
    src, dst = tmp_path / "src", tmp_path / "dst"
    src.mkdir()
    value = {f"/route/{i:03d}": {"title": f"t{i}", "auth": i % 2 == 0} for i in range(50)}
    (src / "a.json").write_text(json.dumps(value) + "// end")
    (src / "b.adt").write_bytes(encode(value) + b"\n")
    assert documents.convert(spark, str(src), f"file://{dst}", "binary") == 2
    back = documents.read_documents(spark, str(dst)).collect()
    assert [json.loads(r.json) for r in back] == [value, value] and {r.format for r in back} == {"binary"}
    (src / "bad.adt").write_bytes(b"!!")
    assert documents.read_documents(spark, str(src), strict=False).where("json is null").count() == 1
    with pytest.raises(Exception, match="tag"):
        documents.read_documents(spark, str(src)).collect()
    datasource.register(spark)
    entries = spark.read.format("arbordoc").load(str(dst))
    assert entries.count() == 100
    assert {r.key for r in entries.where(F.col("key").startswith("/route/01")).collect()} == {f"/route/01{i}" for i in range(10)}
    assert entries.where("key = '/route/007' and value like '%t7%'").count() == 2
    out = tmp_path / "out"
    spark.createDataFrame([("x", '{"k":[1,2]}')], "name string, json string").write.format("arbordoc").option("format", "text").mode("append").save(str(out))
    assert decode((out / "x.adt").read_bytes()) == {"k": [1, 2]}


def test_codec_columns(spark):
    df = spark.createDataFrame([('{"a":{"b":[1,2]},"ab":3}',), (None,)], "j string").select(documents.doc_encode(F.col("j"), "binary").alias("p"))
    r = df.select(documents.doc_get(F.col("p"), ["a", "b", "1"], "binary").alias("x"), documents.doc_get(F.col("p"), ["no"], "binary").alias("y"), documents.doc_prefix(F.col("p"), "a", fmt="binary").alias("m"), documents.doc_decode(F.col("p"), "binary").alias("j")).collect()
    assert r[0].x == "2" and r[0].y is None and r[0].m == {"a": '{"b":[1,2]}', "ab": "3"} and json.loads(r[0].j)["ab"] == 3
    assert tuple(r[1]) == (None, None, None, None)


def test_streaming_equals_batch(spark, tmp_path):
    batch = spark.read.parquet(f"{SF}/events.parquet")
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    s = events.stream_events(spark, str(tmp_path / "in"), 10)
    q = events.tumbling_stats(s).writeStream.outputMode("complete").format("memory").queryName("told").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("told").collect())) == sorted(map(tuple, events.tumbling_stats(batch).collect()))
    assert events.first_of_each(batch, "user_id").count() == batch.select("user_id").distinct().count()


def test_command_line(tmp_path, capsysbinary):
    f, g = tmp_path / "x.json", tmp_path / "x.adb"
    f.write_text('{"name":"n","tags":["a","b"],"deep":{"x":{"y":[1,2]}}}')
    assert cli.main(["show", str(f), "tags", "1"]) == 0
    assert capsysbinary.readouterr().out == b'"b"\n'
    assert cli.main(["convert", str(f), str(g)]) == 0 and decode(g.read_bytes(), "binary")["name"] == "n"
    assert cli.main(["show", str(g), "-f", "tree"]) == 0
    assert b"tags: [ \"a\", \"b\" ]" in capsysbinary.readouterr().out
    assert cli.main(["show", str(f), "tags", "9"]) == 2 and cli.main(["show", str(f), "zzz"]) == 2 and cli.main(["show", "/no/file"]) == 1
    assert cli.main(["inspect", str(f)]) == 0 and cli.main(["stats", str(f)]) == 0
    assert b"binary" in capsysbinary.readouterr().out


def test_colours_and_hexdump(monkeypatch):
    v = {"a b": "x: 1", "on": True, "no": None, "n": [-1.5, 2e9], "f": float("-inf")}
    for text in (tree(v), json.dumps(v, indent=1)):
        shown = display.coloured(text)
        assert re.sub(r"\x1b\[[0-9]*m", "", shown) == text
        kinds = {k: re.findall(re.escape(c) + r"(.*?)\x1b\[0m", shown) for k, c in display.COLOURS.items()}
        assert kinds["string"] == ['"x: 1"'] and kinds["boolean"] == ["true"] and kinds["null"] == ["null", "-Infinity"]
        assert [float(x) for x in kinds["number"]] == [-1.5, 2e9] and [k.strip('"') for k in kinds["key"]] == list(v)
    assert display.hexdump(bytes(range(18))) == "00 01 02 03 04 05 06 07 08 09 0a 0b 0c 0d 0e 0f\n10 11\n" and display.hexdump(b"") == ""
    monkeypatch.delenv("FORCE_COLOR", raising=False)
    monkeypatch.setenv("NO_COLOR", "1")
    assert not display.wants_colour(None, True) and display.wants_colour(True, False)
    monkeypatch.setenv("FORCE_COLOR", "1")
    assert display.wants_colour(None, False) and not display.wants_colour(False, True)
    monkeypatch.setenv("FORCE_COLOR", "0")
    monkeypatch.setenv("NO_COLOR", "")
    assert display.wants_colour(None, True) and not display.wants_colour(None, False)


def test_more_of_the_command_line(tmp_path, capsysbinary):
    f = tmp_path / "x.json"
    f.write_text('{"name":"n","nest":{"x":[1,2]}}')
    out = lambda *argv: (cli.main(list(argv)), capsysbinary.readouterr())
    assert out("show", str(f), "--color", "-f", "json")[1].out.count(b"\x1b[0m") == 6
    assert b"\x1b" not in out("show", str(f), "--no-color")[1].out
    assert out("hexdump", str(f))[1].out.startswith(b"7b 22 6e 61")
    assert out("complete", "--", "sh")[1].out == b"show\n" and out("complete", "--", "show", str(f), "n")[1].out == b"name\nnest\n"
    assert out("complete", "--", "show", str(f), "nest", "x", "")[1].out == b"0\n1\n" and out("complete", "--", "convert", "--t")[1].out == b"--to\n"
    assert out("complete", "--", "show", "/no/file", "")[1].out == b"" and out("complete", "--", "what", "")[1].out == b""
    for shell in cli.SHELLS:
        assert b"complete -o default" in out("completions", shell)[1].out
    code, said = out("shwo", str(f))
    assert code == 2 and b"did you mean 'show'" in said.err
    code, said = out("show", str(f), "--fromat=json")
    assert code == 2 and b"did you mean '--format'" in said.err
    assert b"did you mean" not in out("qqqqqqqq")[1].err
    assert b"--index-over" in out("help", "convert")[1].out and b"completions" in out("help")[1].out
    told = out("demo")[1].out
    assert encode(cli.SAMPLE) in told and display.hexdump(encode(cli.SAMPLE, "binary")).encode() in told
    assert out("convert", str(f), "-", "--to", "tree")[1].out == b'{\n  name: "n"\n  nest: {\n    x: [ 1, 2 ]\n  }\n}\n'


def test_trees_are_written(spark, tmp_path):
    df = spark.createDataFrame([("x", '{"k":[1,2]}')], "name string, json string")
    assert documents.write_documents(df, "json", "name", f"file://{tmp_path}/a", "tree").first().bytes == len("{\n  k: [ 1, 2 ]\n}\n")
    datasource.register(spark)
    df.write.format("arbordoc").option("format", "tree").mode("append").save(str(tmp_path / "b"))
    assert (tmp_path / "a" / "x.txt").read_text() == (tmp_path / "b" / "x.txt").read_text() == tree({"k": [1, 2]}) + "\n"
    with pytest.raises(ValueError, match="format must be"):
        documents.write_documents(df, "json", "name", f"file://{tmp_path}/a", "yaml")


def test_shared_containers_have_one_target(spark):
    shared = {"x": [1, 2, 3]}
    df = spark.createDataFrame([(1, bytearray(encode([shared, 5, shared, shared])))], "id int, p binary")
    rows = inspection.resolve(inspection.encoding_nodes(df, "id", "p"), "id").where("depth = 1").orderBy("ord").collect()
    assert rows[0].resolved == rows[2].resolved == rows[3].resolved != rows[1].resolved


def test_layouts_are_told_apart_by_keys(spark):
    df = spark.createDataFrame([('{"a,b":3}',), ('{"a":1,"b":2}',)], "j string")
    assert sorted((r.layout, list(r["keys"]), r.n_docs, r.layout_id) for r in layouts.layout_catalogue(df, "j").collect()) == [("a,b", ["a", "b"], 1, 0), ("a,b", ["a,b"], 1, 1)]


def test_any_key_in_a_path(spark):
    j = F.lit(json.dumps({"it's": {"x?": 1}, "*": 2, "": 3, "a.b": 4, 'q"q': 5}))
    got = one(spark, a=paths.path_get(j, "it's", "x?", to="int"), b=paths.path_get(j, "*", to="int"), c=paths.path_get(j, "", to="int"), d=paths.path_get(j, "a.b", to="int"), e=paths.has_key(F.parse_json(j), 'q"q'), f=paths.has_key(F.parse_json(j), "no"), g=paths.has_key(F.parse_json(F.lit("[1]")), "0"), n=paths.child_count(F.parse_json(j)))
    assert tuple(got) == (1, 2, 3, 4, True, False, False, 5)


def test_pointer_plans_stay_small(spark):
    chain = spark.createDataFrame([(i, i - 1 if i % 40 else None) for i in range(80)], "i int, t int")
    ends = lookup.follow_pointers(chain, "i", "t")
    assert {r.i: r.final for r in ends.collect()} == {i: i - i % 40 for i in range(80)}
    assert ends._jdf.queryExecution().optimizedPlan().collectLeaves().size() <= 4


def test_convert_keeps_endings_that_differ(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "x.json").write_text("[1]")
    (src / "x.jsonc").write_text("[2] // two")
    (src / "y.json").write_text("[3]")
    assert documents.convert(spark, str(src), f"file://{tmp_path}/dst", "text") == 3
    assert {f.name: decode(f.read_bytes()) for f in (tmp_path / "dst").iterdir()} == {"x.json.adt": [1], "x.jsonc.adt": [2], "y.adt": [3]}


def test_data_source_overwrites_and_aborts(spark, tmp_path):
    datasource.register(spark)
    put = lambda rows, mode: spark.createDataFrame(rows, "name string, json string").write.format("arbordoc").option("format", "binary").mode(mode).save(str(tmp_path))
    put([("a", "1"), ("b", "2")], "append")
    put([("b", "3"), ("c", "4")], "append")
    held = lambda: {f.name: decode(f.read_bytes(), "binary") for f in tmp_path.iterdir()}
    assert held() == {"a.adb": 1, "b.adb": 3, "c.adb": 4}
    put([("d", "5")], "overwrite")
    assert held() == {"d.adb": 5}
    for bad in ([("e", "1"), ("f", "not json")], [("e", "1"), ("e", "2")]):
        with pytest.raises(Exception):
            put(bad, "append")
        assert held() == {"d.adb": 5}


def test_identity_bytes_tree_and_fractions(spark):
    from arbordoc.sources.encoder import split_number

    rows = ['{"a":1,"b":2}', '{"b":2,"a":1}', '{"a": 1.0, "b": 2}']
    a, b, c = (r.k for r in spark.createDataFrame([(r,) for r in rows], "j string").select(documents.doc_identity(F.col("j")).alias("k")).collect())
    assert a == c != b
    raw = spark.createDataFrame([(bytearray(encode({"x": [1, 2], "y": "text"})),)], "p binary").select(documents.doc_bytes(F.col("p"), ["y"]).alias("y"), documents.doc_bytes(F.col("p"), ["z"]).alias("z"), documents.doc_prefix(F.col("p"), "", limit=1).alias("one")).first()
    assert bytes(raw.y.raw) == b"text,4" and raw.y.right - raw.y.left == 6 and raw.z is None and len(raw.one) == 1
    assert one(spark, t=documents.doc_tree(F.lit('{"a b":[1,null]}')))[0] == '{\n  "a b": [ 1, null ]\n}'
    xs = [0.1, -2.5, 1e-9, 123456.789, 1e21, 3.0, 1 / 3, 5e-300, 1.7e308, 2e15 + 0.5]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(scalars.split_fraction(F.col("x")).alias("s")).collect()
    assert [tuple(r.s) for r in got] == [split_number(x) for x in xs]


def test_nodes_tile_the_bytes(spark):
    """Every node's children and its own tag cover its bytes without gaps, and semantic nodes are the values, keys and pointers only."""
    import random

    from arbordoc.sources.encoder import Options

    rng = random.Random(3)

    def value(depth):
        kind = rng.randrange(6 if depth else 4)
        if kind == 4:
            return [value(depth - 1) for _ in range(rng.randint(0, 5))]
        if kind == 5:
            return {k: value(depth - 1) for k in rng.sample(["a", "b", "long key", "/x/y", "z"], rng.randint(0, 4))}
        return [rng.randint(-9999, 9999), rng.random(), rng.choice(["x", "some text", "deadbeef", "/a/long/path/with/many/parts/of/it"]), None][kind]

    for fmt in ("text", "binary"):
        docs = [value(4) for _ in range(40)] + [[{"a": 1, "b": 2}, {"a": 3, "b": 4}, {"a": 5, "b": 6}]]
        df = spark.createDataFrame([(i, bytearray(encode(v, fmt, Options(index_over=3)))) for i, v in enumerate(docs)], "id int, p binary")
        nodes_ = inspection.encoding_nodes(df, "id", "p", fmt)
        of = {(r.id, r.node): r for r in nodes_.collect()}
        inner = {}
        for (i, _), r in of.items():
            inner.setdefault((i, r.parent), []).append(r)
        for i, p in ((r.id, r.p) for r in df.collect()):
            assert (of[i, 0].left, of[i, 0].right) == (0, len(p))
        for key, r in of.items():
            assert r.left + r["size"] == r.tag_at < r.right
            own = sorted(inner.get(key, []), key=lambda c: c.left)
            if r.kind in ("list", "map", "chain"):
                edges = [r.left, *(c.right for c in own)]
                assert [c.left for c in own] == edges[:-1] and edges[-1] == r.tag_at
            assert [c.ord for c in own] == list(range(len(own)))[::-1]
        kept = inspection.semantic_nodes(nodes_, "id").collect()
        gone = {(r.id, r.node) for r in of.values()} - {(r.id, r.node) for r in kept}
        assert len(kept) + len(gone) == len(of) and {of[k].kind for k in gone} == {"index", "ptr"}
        assert sum(k[0] == len(docs) - 1 and of[k].kind == "ptr" for k in gone) == 2  # the second and third map have the first one's keys


def test_sizes_are_those_of_the_encoders(spark):
    values = [[1, {"a": "text"}], {"k": [1.5, None] * 9}, "x"]
    r = documents.size_stats(spark.createDataFrame([(json.dumps(v, separators=(",", ":")),) for v in values] + [(None,)], "j string"), "j").first()
    total = [sum(len(f(v)) for v in values) for f in (lambda v: json.dumps(v, separators=(",", ":")), encode, lambda v: encode(v, "binary"))]
    assert tuple(r)[:4] == (3, *total) and r.text_smaller == round((1 - total[1] / total[0]) * 100, 1)


def test_encoding_entries(spark):
    df = spark.createDataFrame([(1, bytearray(encode({"ab": [5, {"x": 1}], "ac": 2, "b": "t"}))), (2, None), (3, bytearray(encode(7)))], "id int, p binary")
    rows = lambda **kw: [(r.id, r.pos, r.key, r.kind, r.value) for r in inspection.encoding_entries(df, "id", "p", **kw).collect()]
    assert rows() == [(1, 0, "ab", "list", '[5,{"x":1}]'), (1, 1, "ac", "int", "2"), (1, 2, "b", "str", '"t"')]
    assert rows(prefix="a") == [(1, None, "ab", "list", '[5,{"x":1}]'), (1, None, "ac", "int", "2")]
    assert rows(key="b") == [(1, None, "b", "str", '"t"')] and rows(key="no") == [] and rows(at=1) == [(1, 1, "ac", "int", "2")]
    assert rows(path=["ab"], at=1) == [(1, 1, None, "map", '{"x":1}')] and rows(path=["zz"]) == []


def test_node_table_sql_reaches_the_deepest_document_and_no_further(spark):
    deep = "[" * 12 + '"]}[{"' + "]" * 12
    df = spark.createDataFrame([(1, deep), (2, '{"a\\"[[":{"b":null}}'), (3, "7"), (4, "no json"), (5, None)], "id long, j string")
    got = nodes.node_table_sql(df, "id", "j").collect()
    assert sorted(r.depth for r in got if r.id == 1) == list(range(13))
    assert {(r.path, r.kind) for r in got if r.id == 2} == {("$", "map"), ('$.a"[[', "map"), ('$.a"[[.b', "scalar")}
    assert [(r.path, r.kind, r.value) for r in got if r.id in (3, 4, 5)] == [("$", "scalar", "7"), ("$", "scalar", None), ("$", "scalar", None)]
    with pytest.raises(ValueError, match="12 levels"):
        nodes.node_table_sql(df, "id", "j", levels=11)


def test_varint_size_is_that_of_the_binary_form(spark):
    sizes = [v for n in range(1, 10) for v in ((1 << 3 + 7 * (n - 1)) - 1, 1 << 3 + 7 * (n - 1)) if v < 1 << 63] + [899999**2]
    rows = spark.createDataFrame([(v,) for v in sizes], "v long").select("v", scalars.varint_size(F.col("v")).alias("n")).collect()
    assert all(r.n == len(binary_head("int", r.v)) for r in rows)
