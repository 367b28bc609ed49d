"""Queries on the test tables that apply the engine's operators, and equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import arrays, paths, scalars
from ..operators import inspection, layouts, lookup, nodes
from ..session import spread, table
from ..sources import documents
from ..sources.encoder import Options
from ..sources.wire import ALPHABET
from ..streaming.events import tumbling_stats

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def int_arrays(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sort_array(F.collect_list(F.col("l_quantity").cast("long"))).alias("a"))


ARRAYS = "with t as (select l_orderkey k, list(cast(l_quantity as bigint) order by cast(l_quantity as bigint)) a from lineitem group by 1) "
PART_JSON = """concat('{"b":', case when p_partkey % 3 = 0 then 'null' else cast(p_size as varchar) end, case when p_partkey % 2 = 0 then concat(',"a":', cast(p_partkey as varchar)) else '' end, '}')"""
PARTS = f"with t as (select p_partkey k, {PART_JSON} j from part) "


def part_docs(s: SparkSession, d: str) -> DataFrame:
    """Irregular documents: b may be null, a may be missing."""
    return table(s, d, "part").select(F.col("p_partkey").alias("k"), F.expr(PART_JSON.replace("varchar", "string")).alias("j"))


def order_docs(s: SparkSession, d: str) -> DataFrame:
    """Nested documents: an order with its lines."""
    line = F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"))
    lines = spread(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey")
    return lines.groupBy(F.col("l_orderkey").alias("k")).agg(F.to_json(F.struct(F.sort_array(F.collect_list(line)).alias("items"))).alias("j"))


ORDERS = "with t as (select l_orderkey k, to_json({'items': list({'n': l_linenumber, 'p': l_partkey} order by l_linenumber, l_partkey)}) j from lineitem group by 1) "

# lookups


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) v from events")
def path_get(s, d):
    return table(s, d, "events").select("event_id", paths.path_get(F.col("props"), "k", to="long").alias("v"))


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) v from events")
def path_get_variant(s, d):
    return table(s, d, "events").select("event_id", paths.variant_at(F.parse_json("props"), "k", to="long").alias("v"))


@query("select event_type, count(*) n, sum(cast(json_extract_string(props, '$.k') as bigint))::bigint total from events where cast(json_extract_string(props, '$.k') as bigint) >= 50 group by 1")
def path_filter_agg(s, d):
    v = paths.path_get(F.col("props"), "k", to="long")
    return table(s, d, "events").where(v >= 50).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(v).alias("total"))


@query(ORDERS + "select k, cast(json_extract_string(j, '$.items[0].p') as bigint) v from t")
def path_strict(s, d):
    return order_docs(s, d).select("k", paths.path_strict(F.parse_json("j"), "items", 0, "p", to="long").alias("v"))


@query("select page_id, url from pages where starts_with(url, 'https://blog.')")
def key_prefix(s, d):
    return lookup.prefix_scan(table(s, d, "pages").select("page_id", "url"), "url", "https://blog.")


@query("select page_id, url from pages where starts_with(url, 'https://m.')")
def key_prefix_range(s, d):
    return lookup.prefix_bounds(table(s, d, "pages").select("page_id", "url"), "url", "https://m.")


@query("select page_id, cast(row_number() over (order by url, page_id) - 1 as bigint) rank from pages")
def sorted_key_rank(s, d):
    return lookup.sorted_rank(table(s, d, "pages").select("page_id", "url"), "url", "page_id").select("page_id", "rank")


@query(PARTS + "select k, json_type(j, '$.b') = 'NULL' b_null, json_type(j, '$.a') is null a_missing, json_type(j, '$.b') is not null has_b from t")
def null_vs_missing(s, d):
    v = F.parse_json("j")
    return part_docs(s, d).select("k", paths.is_json_null(v, "b").alias("b_null"), paths.is_missing(v, "a").alias("a_missing"), paths.has_key(v, "b").alias("has_b"))


@query("""select event_id, false eq, cast(null as int) cmp, false pre from events where event_id % 2 = 0
union all select event_id, event_type = 'click', case when event_type < 'login' then -1 when event_type = 'login' then 0 else 1 end, starts_with(event_type, 'p') from events where event_id % 2 = 1""")
def string_nodes(s, d):
    v = F.when(F.col("event_id") % 2 == 0, F.to_variant_object(F.array("value"))).otherwise(F.parse_json(F.concat(F.lit('"'), "event_type", F.lit('"'))))
    return table(s, d, "events").select("event_id", paths.string_equals(v, "click").alias("eq"), paths.string_compare(v, "login").alias("cmp"), paths.string_has_prefix(v, "p").alias("pre"))


@query("select c_custkey, n_name from customer left join nation on c_nationkey = n_nationkey")
def ref_resolve(s, d):
    c = table(s, d, "customer").select("c_custkey", "c_nationkey")
    return lookup.resolve_refs(c, "c_nationkey", table(s, d, "nation"), "n_nationkey", "n_name", "n_name").select("c_custkey", "n_name")


@query("select p_partkey, case when p_partkey % 7 = 0 then p_partkey else p_partkey - p_partkey % 7 end final from part where p_partkey % 7 = 0 or p_partkey - p_partkey % 7 in (select p_partkey from part)")
def pointer_chain(s, d):
    p = table(s, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 7 != 0, F.col("p_partkey") - 1).alias("to"))
    return lookup.follow_pointers(p, "p_partkey", "to", 8).where("final is not null").select("p_partkey", "final")


@query("select array_to_string(list(seg order by pos), '') url, page_id from (select page_id, unnest(string_split(url, '/')) || '/' seg, generate_subscripts(string_split(url, '/'), 1) pos from pages) group by page_id")
def chain_concat(s, d):
    return table(s, d, "pages").select(F.array_join(F.transform(F.split("url", "/"), lambda x: F.concat(x, F.lit("/"))), "").alias("url"), "page_id")


# enumeration


@query("select event_id, array_to_string(json_keys(props), ',') ks from events")
def object_keys(s, d):
    return table(s, d, "events").select("event_id", F.array_join(nodes.keys(F.col("props")), ",").alias("ks"))


@query("select event_id, e.key as key, cast(e.value as bigint) v from events, lateral json_each(props) e")
def explode_entries(s, d):
    e = nodes.explode_entries(table(s, d, "events").select("event_id", "props"), "props")
    return e.select("event_id", "key", F.variant_get("value", "$", "long").alias("v"))


@query(ORDERS + "select k, json_array_length(j, '$.items')::bigint n from t")
def child_count(s, d):
    return order_docs(s, d).select("k", paths.child_count(paths.variant_at(F.parse_json("j"), "items")).alias("n"))


@query(ARRAYS + "select k, unnest(a) v, generate_subscripts(a, 1) - 1 pos from t")
def list_elements(s, d):
    return nodes.elements(int_arrays(s, d), "a", "v").select("k", "v", F.col("pos").cast("long"))


NODES = ORDERS + """select k, replace(e.fullkey, '"', '') path, case e.type when 'OBJECT' then 'map' when 'ARRAY' then 'list' else 'scalar' end kind from t, lateral json_tree(j) e"""


@query(NODES)
def node_table(s, d):
    n = nodes.node_table_json(order_docs(s, d), ["k"], "j")
    return n.select("k", "path", F.when(F.col("kind").isin("map", "list"), F.col("kind")).otherwise("scalar").alias("kind"))


@query(NODES)
def node_table_recursive(s, d):
    return nodes.node_table_sql(order_docs(s, d), "k", "j").select("k", "path", "kind")


# array methods


@query(ARRAYS + "select k, a[2] v, a[-1] last from t")
def array_get(s, d):
    a = F.col("a")
    return int_arrays(s, d).select("k", arrays.at(a, 1).alias("v"), arrays.at(a, -1).alias("last"))


@query(ARRAYS + "select k, array_to_string(list_slice(a, 2, 3), ',') v, array_to_string(a[-2:], ',') tail from t")
def array_slice(s, d):
    a = F.col("a")
    return int_arrays(s, d).select("k", arrays.join(arrays.slice_(a, 1, 3)).alias("v"), arrays.join(arrays.slice_(a, -2)).alias("tail"))


@query(ARRAYS + "select k, len(list_filter(a, lambda x: x % 2 = 0))::bigint v from t")
def array_filter(s, d):
    return int_arrays(s, d).select("k", F.size(arrays.filter_(F.col("a"), lambda x: x % 2 == 0)).cast("long").alias("v"))


@query(ARRAYS + "select k, array_to_string(list_transform(a, lambda x: x * 2), ',') v from t")
def array_map(s, d):
    return int_arrays(s, d).select("k", arrays.join(arrays.map_(F.col("a"), lambda x: x * 2)).alias("v"))


@query(ARRAYS + "select k, list_sum(a)::bigint v from t")
def array_reduce(s, d):
    return int_arrays(s, d).select("k", arrays.reduce_(F.col("a"), lambda x, y: x + y, F.lit(0).cast("long")).alias("v"))


@query(ARRAYS + "select k, list_filter(a, lambda x: x > 25)[1] v, coalesce(list_position(list_transform(a, lambda x: x > 25), true), 0)::bigint - 1 i from t")
def array_find(s, d):
    a = F.col("a")
    return int_arrays(s, d).select("k", arrays.find(a, lambda x: x > 25).alias("v"), arrays.find_index(a, lambda x: x > 25).alias("i"))


@query(ARRAYS + "select k, len(list_filter(a, lambda x: not (x > 5))) = 0 every_, len(list_filter(a, lambda x: x > 45)) > 0 some_ from t")
def every_some(s, d):
    a = F.col("a")
    return int_arrays(s, d).select("k", arrays.every(a, lambda x: x > 5).alias("every_"), arrays.some(a, lambda x: x > 45).alias("some_"))


@query(ARRAYS + "select k, coalesce(list_position(a, 10), 0)::bigint - 1 v, list_contains(a, 10) has from t")
def index_of_includes(s, d):
    a = F.col("a")
    return int_arrays(s, d).select("k", arrays.index_of(a, F.lit(10)).alias("v"), arrays.includes(a, F.lit(10)).alias("has"))


@query(ARRAYS + "select k, array_to_string(list_reverse(a), ',') rev, array_to_string(list_concat(a, a), ',') twice, array_to_string(flatten(list_transform(a, lambda x: [x, x + 1])), ',') fm from t")
def array_reshape(s, d):
    a = F.col("a")
    return int_arrays(s, d).select("k", arrays.join(arrays.reverse(a)).alias("rev"), arrays.join(arrays.concat(a, a)).alias("twice"), arrays.join(arrays.flat_map(a, lambda x: F.array(x, x + 1))).alias("fm"))


@query("with t as (select l_orderkey k, list(cast(l_quantity as bigint) order by cast(cast(l_quantity as bigint) as varchar)) a from lineitem group by 1) select k, array_to_string(a, ',') v from t")
def array_sort_text(s, d):
    return int_arrays(s, d).select("k", arrays.join(arrays.sort_as_text(F.col("a"))).alias("v"))


# scalars


@query("select event_id, case when x >= 0 then x * 2 else -x * 2 - 1 end z from (select event_id, event_id * 37 - 150000 x from events)")
def zigzag(s, d):
    return table(s, d, "events").select("event_id", scalars.zigzag(F.col("event_id") * 37 - 150000).alias("z"))


@query("select event_id, case when z % 2 = 0 then z // 2 else -((z + 1) // 2) end x from (select event_id, event_id * 13 z from events)")
def from_zigzag(s, d):
    return table(s, d, "events").select("event_id", scalars.from_zigzag(F.col("event_id") * 13).alias("x"))


@query(f"select o_orderkey, ltrim(array_to_string(list_transform(range(10, -1, -1), lambda i: substr('{ALPHABET}', ((((o_orderkey * 7919) >> (6 * i)::bigint) & 63) + 1)::bigint, 1)), ''), '0') v from orders")
def b64_stringify(s, d):
    return table(s, d, "orders").select("o_orderkey", scalars.b64_stringify(F.col("o_orderkey") * 7919).alias("v"))


@query(f"select page_id, list_reduce(list_transform(string_split(substr(md5(url), 1, 8), ''), lambda c: (instr('{ALPHABET}', c) - 1)::bigint), lambda a, c: a * 64 + c) v from pages")
def b64_parse(s, d):
    return table(s, d, "pages").select("page_id", scalars.b64_parse(F.substring(F.md5("url"), 1, 8)).alias("v"))


@query("select o_orderkey, case when v < 8 then 1 when v < 1024 then 2 when v < 131072 then 3 when v < 16777216 then 4 when v < 2147483648 then 5 else 6 end::bigint n from (select o_orderkey, o_orderkey * o_orderkey v from orders)")
def varint_size(s, d):
    return table(s, d, "orders").select("o_orderkey", scalars.varint_size(F.col("o_orderkey") * F.col("o_orderkey")).alias("n"))


@query("""select page_id, case when length(t) < 4 then 0 when regexp_full_match(t, '[0-9a-f]+') then 1 when regexp_full_match(t, '[0-9a-zA-Z_-]+') then 2 else 0 end::bigint c
from (select page_id, case page_id % 4 when 0 then md5(url) when 1 then url when 2 then replace(substr(md5(url), 1, 12), 'a', 'Z_') else substr(url, 1, 3) end t from pages)""")
def classify_string(s, d):
    t = F.expr("case page_id % 4 when 0 then md5(url) when 1 then url when 2 then replace(substr(md5(url), 1, 12), 'a', 'Z_') else substr(url, 1, 3) end")
    return table(s, d, "pages").select("page_id", scalars.classify_string(t).alias("c"))


@query("select page_id, substr(md5(url), 1, 7 + page_id % 5) hex, substr(replace(md5(url), 'f', '_'), 1, 9 + page_id % 4) b64, ceil((9 + page_id % 4) * 6 / 8.0)::bigint n from pages")
def digit_packing(s, d):
    p = table(s, d, "pages")
    h, b = F.expr("substr(md5(url), 1, cast(7 + page_id % 5 as int))"), F.expr("substr(replace(md5(url), 'f', '_'), 1, cast(9 + page_id % 4 as int))")
    packed = scalars.b64_pack(b)
    return p.select("page_id", scalars.hex_unpack(scalars.hex_pack(h), F.length(h)).alias("hex"), scalars.b64_unpack(packed, F.length(b)).alias("b64"), F.octet_length(packed).cast("long").alias("n"))


@query("select o_orderkey, case when x < 10 then x else rtrim(x::varchar, '0')::bigint end base, case when x < 10 then 0 else length(x::varchar) - length(rtrim(x::varchar, '0')) end::bigint exp from (select o_orderkey, o_orderkey * 50 x from orders)")
def split_number(s, d):
    n = scalars.split_number(F.col("o_orderkey") * 50)
    return table(s, d, "orders").select("o_orderkey", n["base"].alias("base"), n["exp"].alias("exp"))


@query("select a.n_name a, b.n_name b, levenshtein(a.n_name, b.n_name)::bigint d from nation a join nation b on a.n_regionkey = b.n_regionkey")
def edit_distance(s, d):
    n = table(s, d, "nation")
    pairs = n.select(F.col("n_name").alias("a"), "n_regionkey").join(n.select(F.col("n_name").alias("b"), "n_regionkey"), "n_regionkey")
    return pairs.select("a", "b", scalars.edit_distance(F.col("a"), F.col("b")).alias("d"))


@query("select doc_id, cast(strlen(text) as bigint) n from documents")
def byte_length(s, d):
    return table(s, d, "documents").select("doc_id", scalars.byte_length(F.col("text")).alias("n"))


@query("select p_partkey, regexp_full_match(p_brand, '[A-Za-z_][A-Za-z0-9_-]*') bare, regexp_full_match(p_name, '[A-Za-z_][A-Za-z0-9_-]*') name_bare from part")
def bare_keys(s, d):
    return table(s, d, "part").select("p_partkey", scalars.is_bare_key(F.col("p_brand")).alias("bare"), scalars.is_bare_key(F.col("p_name")).alias("name_bare"))


# what encoders share


@query("select l_orderkey k, cast(to_json(list({'n': l_linenumber, 'p': l_partkey} order by l_linenumber, l_partkey)) as varchar) j from lineitem group by 1")
def nest_orders(s, d):
    line = F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"))
    return table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.to_json(F.sort_array(F.collect_list(line))).alias("j"))


@query("select page_id, regexp_extract(url, '^(.+)[/.][^/.]*$', 1) v from pages")
def chain_prefix(s, d):
    return table(s, d, "pages").select("page_id", layouts.chain_prefix(F.col("url")).alias("v"))


@query("select prefix, count(*) uses from (select unnest(list_filter(list_transform(range(2, length(url) + 1), lambda i: case when substr(url, i, 1) in ('/', '.') then substr(url, 1, i - 1) end), lambda x: x is not null)) prefix from pages) group by 1 having count(*) >= 2")
def prefix_catalogue(s, d):
    return layouts.prefix_catalogue(table(s, d, "pages"), "url")


@query(PARTS + ", l as (select array_to_string(json_keys(j), ',') layout, count(*) n_docs from t group by 1) select layout, n_docs, (dense_rank() over (order by layout) - 1)::bigint layout_id from l")
def layout_share(s, d):
    return layouts.layout_catalogue(part_docs(s, d), "j").drop("keys")


@query("select p_brand, p_size, min(p_partkey) as first, count(*) uses from part group by 1, 2")
def value_catalogue(s, d):
    return layouts.value_catalogue(table(s, d, "part"), ["p_brand", "p_size"], "p_partkey")


@query("select p_partkey, min(p_partkey) over (partition by p_brand) as first, p_partkey = min(p_partkey) over (partition by p_brand) is_first from part")
def value_dedup(s, d):
    return layouts.with_first_use(table(s, d, "part").select("p_partkey", "p_brand"), ["p_brand"], "p_partkey").select("p_partkey", "first", "is_first")


@query("select l_orderkey k, count(*) > 4 indexed from lineitem group by 1")
def index_threshold(s, d):
    return int_arrays(s, d).select("k", layouts.needs_index(F.size("a"), 4).alias("indexed"))


# codecs


def _round_trip(s, d, fmt):
    e = spread(table(s, d, "events").select("event_id", "event_type", "props"), "event_id", "event_type", "props")
    e = e.select("event_id", F.to_json(F.struct("event_id", "event_type", F.parse_json("props").alias("props"))).alias("j"))
    p = e.select("event_id", documents.doc_encode(F.col("j"), fmt).alias("p"))
    v = F.parse_json(documents.doc_decode(F.col("p"), fmt))
    return p.select("event_id", v.alias("v")).select("event_id", F.variant_get("v", "$.event_type", "string").alias("event_type"), F.variant_get("v", "$.props.k", "long").alias("k"))


ROUND_TRIP = "select event_id, event_type, cast(json_extract_string(props, '$.k') as bigint) k from events"


@query(ROUND_TRIP)
def codec_roundtrip_text(s, d):
    return _round_trip(s, d, "text")


@query(ROUND_TRIP)
def codec_roundtrip_binary(s, d):
    return _round_trip(s, d, "binary")


@query(ORDERS + "select k, cast(json_extract_string(j, '$.items[1].p') as bigint) v, json_array_length(j, '$.items')::bigint n from t")
def codec_lookup(s, d):
    p = order_docs(s, d).select("k", documents.doc_encode(F.col("j"), "binary", Options(index_over=2)).alias("p"))
    r = p.select("k", documents.doc_get_and_count(F.col("p"), ["items", "1", "p"], ["items"], "binary").alias("r"))
    return r.select("k", F.col("r.value").cast("long").alias("v"), F.col("r.n").alias("n"))


def _nation_map(s, d):
    n = table(s, d, "nation")
    return n.groupBy("n_regionkey").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("n_name", "n_nationkey")))).alias("j"))


@query("select n_regionkey, n_name as key, n_nationkey::bigint v from nation where starts_with(n_name, 'NATION_1')")
def codec_prefix(s, d):
    p = _nation_map(s, d).select("n_regionkey", documents.doc_encode(F.col("j"), "text", Options(index_over=1)).alias("p"))
    e = p.select("n_regionkey", F.explode(documents.doc_prefix(F.col("p"), "NATION_1")).alias("key", "v"))
    return e.select("n_regionkey", "key", F.col("v").cast("long").alias("v"))


@query("select n_regionkey, n_name as key, n_nationkey::varchar as value from nation")
def encoding_entries(s, d):
    p = _nation_map(s, d).select("n_regionkey", documents.doc_encode(F.col("j"), "binary", Options(index_over=1)).alias("p"))
    return inspection.encoding_entries(p, "n_regionkey", "p", fmt="binary").select("n_regionkey", "key", "value")


@query("select n_regionkey, n_name as key, n_nationkey::varchar as value from nation where starts_with(n_name, 'NATION_2')")
def encoding_keys_filtered(s, d):
    p = _nation_map(s, d).select("n_regionkey", documents.doc_encode(F.col("j"), "text", Options(index_over=1)).alias("p"))
    return inspection.encoding_entries(p, "n_regionkey", "p", prefix="NATION_2").select("n_regionkey", "key", "value")


@query(ORDERS + "select k, cast(json_extract(j, '$.items[1]') as varchar) as value from t where json_array_length(j, '$.items') > 1")
def encoding_at(s, d):
    p = order_docs(s, d).select("k", documents.doc_encode(F.col("j"), "binary", Options(index_over=2)).alias("p"))
    return inspection.encoding_entries(p, "k", "p", ["items"], "binary", at=1).select("k", "value")


@query()
def encoding_nodes(s, d):
    p = _nation_map(s, d).select("n_regionkey", documents.doc_encode(F.col("j")).alias("p"))
    return inspection.encoding_nodes(p, "n_regionkey", "p")


@query()
def size_stats(s, d):
    return documents.size_stats(order_docs(s, d), "j")


# extensions: joins, aggregates, windows and streams over documents


@query("select time_bucket(interval 1 hour, ts) window_start, event_type, count(*) n, sum(cast(json_extract_string(props, '$.k') as bigint))::bigint sum_k from events group by 1, 2")
def ext_event_windows(s, d):
    return tumbling_stats(table(s, d, "events"))


@query("select n_name, count(*) n, sum(cast(c_custkey as bigint))::bigint keys from customer join nation on c_nationkey = n_nationkey group by 1")
def ext_join_agg(s, d):
    c = lookup.resolve_refs(table(s, d, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", table(s, d, "nation"), "n_nationkey", "n_name", "n_name")
    return c.where("n_name is not null").groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("keys"))


@query("select user_id, event_id, event_id - lag(event_id) over (partition by user_id order by ts, event_id) gap from events")
def ext_window(s, d):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return table(s, d, "events").select("user_id", "event_id", (F.col("event_id") - F.lag("event_id").over(w)).alias("gap"))
