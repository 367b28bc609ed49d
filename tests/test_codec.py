"""Golden encodings, round trips, lookups in the bytes, and errors."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from arbordoc.sources.cursor import UNDEFINED, Document, decode, plain, to_json
from arbordoc.sources.documents import parse_json
from arbordoc.sources.encoder import Options, encode, encode_chunks, encode_to, identity, split_number
from arbordoc.sources.templates import TextEncoder
from arbordoc.sources.wire import ALPHABET, CodecError, classify, from_base64, pack_digits, to_base64, unpack_digits, unzigzag, zigzag

PEOPLE = [{"name": "alice", "age": 1}, {"name": "bob", "age": 2}, {"name": "charlie", "age": 3}]
GOLDEN = [
    (0, "+"), (1, "+2"), (-1, "+1"), (42, "+1k"), (-42, "+1j"), (3.14, "+9Q*3"), (0.5, "+a*1"), (1000000, "+2*c"),
    ("hello world", "hello world,b"), (True, "'t"), (False, "'f"), (None, "'n"), (UNDEFINED, "'u"),
    (math.nan, "'nan"), (math.inf, "'inf"), (-math.inf, "'nif"),
    ([1, 2, 3], "+6+4+2;6"), ([[1, 2, 3]], "+6+4+2;6;8"), ([], ";"), ({}, ":"), ([[1], [2]], "+4;2+2;2;8"),
    ({"color": "red", "size": 42}, "+1ksize,4red,3color,5:l"), ([{"a": 1}], "+2a,1:5;7"),
    (["hello", "hello"], "hello,5^;8"), ([{"x": 1}, {"x": 1}], "+2x,1:5^;8"),
    (PEOPLE, "+6age,3charlie,7name,4:m+4bob,3^7:9+2alice,5^k:b;M"),
]
TUNED = [
    ([1, 2, 3], Options(index_over=2), "+6+4+2024#o;b"),
    (list(range(12)), Options(index_over=10), "+m+k+i+g+e+c+a+8+6+4+2+013579bdfhjl#1w;C"),
    ({"c": 3, "a": 1, "b": 2}, Options(index_over=2), "+4b,1+2a,1+6c,15a0#o:k"),
    ([[1, 2], [3, 4]], Options(index_over=0), "+8+602#g;8+4+202#g;80a#g;o"),
    (PEOPLE[:2], Options(index_over=1), "+4age,3bob,3name,4b0#g:m+2alice,507#g^d:f0h#g;J"),
    (["hello", "world"], Options(refs={"H": "hello"}), "world,5'H;9"),
    (["hello", 42], Options(refs={"H": "hello", "X": 42}), "'X'H;4"),
    ([{"a": 1, "b": 2}, {"a": 3, "b": 4}], Options(refs={"S": ["a", "b"]}), "+8+6'S:6+4+2'S:6;g"),
    ({"a": 1, "b": 2}, Options(refs={"O": {"a": 3, "b": 4}}), "+4+2'O:6"),
    (["/foo/bar/baz", "/foo/bar/qux", "/foo/quux"], Options(chain_over=0), "/foo/quux,9/bar/qux,8/foo,4.g/baz,4/bar,4.c^g.g;L"),
]


@pytest.mark.parametrize("value,text", GOLDEN)
def test_golden(value, text):
    assert encode(value).decode() == text
    assert repr(decode(text.encode())) == repr(value)


@pytest.mark.parametrize("value,options,text", TUNED)
def test_golden_with_options(value, options, text):
    assert encode(value, "text", options).decode() == text
    for fmt in ("text", "binary"):
        assert decode(encode(value, fmt, options), fmt, options.refs) == value


scalars = st.none() | st.booleans() | st.integers(-(2**63), 2**63 - 1) | st.text(max_size=40) | st.sampled_from(["deadbeef", "abc_DEF-9", "/a/b.c/" * 6 + "x"])
values = st.recursive(scalars, lambda v: st.lists(v, max_size=20) | st.dictionaries(st.text(max_size=12), v, max_size=20), max_leaves=60)


@settings(max_examples=150, deadline=None)
@given(values, st.sampled_from(["text", "binary"]), st.sampled_from([0, 2, 16]), st.sampled_from([0, 24]))
def test_round_trip(value, fmt, index, chain):
    o = Options(index_over=index, chain_over=chain)
    assert decode(encode(value, fmt, o), fmt) == value


@given(st.floats(allow_nan=False, allow_infinity=False))
def test_floats_keep_14_digits(x):
    for fmt in ("text", "binary"):
        assert decode(encode(x, fmt), fmt) == pytest.approx(x, rel=1e-13, abs=0)


@given(st.integers(0, 2**70))
def test_base64_and_zigzag(n):
    assert from_base64(to_base64(n)) == n
    assert unzigzag(zigzag(n)) == n and unzigzag(zigzag(-n)) == -n


@given(st.text("0123456789abcdef", min_size=1), st.text("0189azAZ-_", min_size=1))
def test_packing(h, b):
    assert unpack_digits(pack_digits(h, 4), len(h), 4) == h
    assert unpack_digits(pack_digits(b, 6), len(b), 6) == b


def test_classify():
    assert [classify(s) for s in ("abc", "abcd", "abcg", "ab d", "abcd\n", "")] == ["str", "hex", "b64", "str", "str", "str"]


def test_binary_head_boundaries():
    sizes = {0: 1, 7: 1, 8: 2, 1023: 2, 1024: 3, 131071: 3, 131072: 4}
    for n, size in sizes.items():
        assert len(encode(n // 2 if n % 2 == 0 else -(n + 1) // 2, "binary")) in (size, size + len(encode(0, "binary")))


def test_numbers():
    assert split_number(1000000) == (1, 6) and split_number(5) == (5, 0) and split_number(3.14) == (314, -2)
    assert encode(-0.0) == encode(0)


@pytest.mark.parametrize("fmt", ["text", "binary"])
def test_lookup_in_the_bytes(fmt):
    value = {f"field_{i:03d}": {"v": i, "w": [i] * 3} for i in range(200)} | {"length": 5}
    d = Document(encode(value, fmt), fmt)
    root = d.target(d.root)
    assert d.count(root) == 201
    assert d.get(["field_150", "v"]) == 150 and d.get(["field_150", "w", "2"]) == 150 and d.get(["length"]) == 5
    assert d.get(["field_150", "w", "3"]) is UNDEFINED and d.get(["nothing"]) is UNDEFINED and d.get(["field_001", "v", "x"]) is UNDEFINED
    assert [k for k, _ in d.prefix(root, "field_19")] == [f"field_19{i}" for i in range(10)]
    assert len(list(d.prefix(root, ""))) == 201
    for path in (["nothing"], ["field_001", "w", "9"], ["field_001", "w", "-1"], ["field_001", "v", "x"]):
        with pytest.raises(KeyError):
            d.get(path, strict=True)


def test_prefix_in_shared_layouts_and_other_nodes():
    d = Document(encode(PEOPLE))
    second = d.target(d.at(d.target(d.root), 1))
    assert [k for k, _ in d.prefix(second, "a")] == ["age"]
    assert list(d.prefix(d.target(d.root), "a")) == []


def test_shared_containers_are_one_object():
    v = decode(encode([{"x": [1, 2]}, {"x": [1, 2]}]))
    assert v[0] is v[1]


def test_no_collisions():
    v = ["[1,2,3]", [1, 2, 3], [None], [math.nan], [UNDEFINED], {"a": UNDEFINED}, {}]
    assert repr(decode(encode(v))) == repr(v)
    assert len({identity(x) for x in v}) == len(v)


def test_undefined_in_json():
    assert to_json({"a": UNDEFINED, "b": [UNDEFINED, math.nan]}) == '{"b":[null,null]}'
    assert plain(UNDEFINED) is None


def test_unknown_ref_is_undefined():
    assert decode(b"'nobody") is UNDEFINED


@pytest.mark.parametrize("data", [b"", b"123", b"!5", b"abc,9", b"^9", b"+1;9"])
def test_corrupt(data):
    with pytest.raises(CodecError):
        decode(data)


def test_wrong_values():
    for v in (object(), {1: 2}, b"x"):
        with pytest.raises(TypeError):
            encode(v)
    with pytest.raises(ValueError):
        Options(delimiters="é")


def test_chunks():
    v = ["some text %d" % i for i in range(100)]
    parts = list(encode_chunks(v, chunk_size=64))
    assert b"".join(p for _, p in parts) == encode(v)
    assert [at for at, _ in parts] == list(range(0, len(encode(v)), 64))


@pytest.mark.parametrize("fmt", ["text", "binary"])
@pytest.mark.parametrize("size", [1, 7, 64, 65536])
def test_chunks_while_writing(fmt, size):
    v, got = {"rows": ["some text %d" % i for i in range(100)], "more": list(range(40))}, []
    whole = encode(v, fmt)
    assert encode_to(v, lambda at, chunk: got.append((at, chunk)), fmt, chunk_size=size) == len(whole)
    assert b"".join(c for _, c in got) == whole and [at for at, _ in got] == list(range(0, len(whole), size))


def test_nodes_cover_the_document():
    data = encode(PEOPLE)
    n = list(Document(data).nodes())
    assert n[0]["left"] == 0 and n[0]["right"] == len(data) and n[0]["kind"] == "list"
    assert sum(x["kind"] == "ptr" for x in n) == 2
    assert all(x["parent"] < x["node"] for x in n)


@pytest.mark.parametrize("fmt", ["text", "binary"])
def test_numbers_at_the_limits(fmt):
    for n in (0, 9, 10, 99_999, 100_000, 1_200_000, 10**20 + 1, 10**21 - 1, 2**53):
        for x in (n, -n, float(n)):
            assert decode(encode(x, fmt), fmt) == x
    # from 10**21 on, integers keep 15 significant digits, as fractions do
    for n in (10**21 + 1, 2**70):
        m, e = split_number(n)
        assert e > 5 and decode(encode(n, fmt), fmt) == m * 10**e != n
    assert split_number(-0.1) == (-1, -1) and split_number(1e-7) == (1, -7) and split_number(2 / 3) == (66666666666667, -14)


def test_digits_are_packed_and_unpacked():
    for size in range(20):
        digits = (ALPHABET * 2)[7 * size % 64 :][:size]
        number = 0
        for c in digits:
            number = number * 64 + ALPHABET.index(c)
        packed = pack_digits(digits, 6)
        assert packed == (number << (-6 * size % 8)).to_bytes((6 * size + 7) // 8, "big") and unpack_digits(packed, size, 6) == digits
    for n in (0, 1, 63, 64, 4095, 4096, 2**24 - 1, 2**24, 2**63):
        assert from_base64(to_base64(n)) == n and not to_base64(n).startswith("0")


TEXTS = [
    '{"items":[{"n":1,"p":17448},{"n":2,"p":9213}]}', '{"items":[{"n":1,"p":17449},{"n":2,"p":9214}]}', '{"items":[{"n":1,"p":99999},{"n":2,"p":1000}]}', '{"items":[{"n":1,"p":17448},{"n":2,"p":17448}]}',
    '{"items":[{"n":1,"p":1},{"n":2,"p":2}]}', '{"items":[{"n":1,"p":1},{"n":1,"p":1}]}', '{"items":[{"n":3,"p":4},{"n":5,"p":6}]}', '{"a":12345,"b":[12345,1]}', '{"a":12345,"b":[12346,1]}', '{"a":1.5,"b":"x12"}', '{"a":2.5,"b":"x13"}',
    '[100000,-2049,2049]', '[100001,-2048,2048]', '[300000,-2049,2049]', '["1",2]', '["2",2]', '{"a": -7}', '{"a": -8}', '"a-b"', "[1e2]", "[3e4]", '{"é":7}', '{"é":8}', "12 // seven", "[true,1]", "[true,2]",
]


@pytest.mark.parametrize("fmt", ["text", "binary"])
@pytest.mark.parametrize("share_below", [32, 3])
def test_texts_that_differ_in_integers_are_encoded_as_each_alone(fmt, share_below):
    o = Options(index_over=2, share_below=share_below)
    e = TextEncoder(parse_json, fmt, o)
    for t in TEXTS * 2:
        alone = encode(parse_json(t), fmt, o)
        assert e(t) == alone and e.size(t) == len(alone), t
    assert e.n_made < len(TEXTS)


def test_a_template_takes_no_text_that_is_no_json():
    e = TextEncoder(parse_json)
    e('{"a":12}')
    for bad in ('{"a":02}', '{"a":1,"a":2}'):
        with pytest.raises(ValueError):
            e(bad)
        with pytest.raises(ValueError):
            e.size(bad)
