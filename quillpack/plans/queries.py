"""The query catalogue: every operator of the library over the test tables, with its SQL for DuckDB where SQL has it.

Encoded bytes are compared as hexadecimal text. Decoding queries encode a column
and read it back, so their SQL is the plain column.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillpack.functions import codecs as c
from quillpack.functions import fallback, values
from quillpack.functions import wire as w
from quillpack.operators import layout, streams, trees
from quillpack.plans import sql
from quillpack.plans.records import Added, Case, Field, MadeOptional, MadeTransient, Record, Removed, Union, decode_record, read_header
from quillpack.sources import generators

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def add(name: str, of: str, build: Callable[[DataFrame], DataFrame], oracle: str | None) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(table(spark, sf_dir, of))
    if oracle:
        ORACLE[name] = oracle


def encoded(name: str, of: str, keys: list[str], codec: c.Codec | Callable[[Column], Column], x: str | Callable[[], Column], oracle: str, where: str = "") -> None:
    """Query of the keys and the bytes of x; oracle is SQL for its hexadecimal text."""
    value = lambda: F.expr(x) if isinstance(x, str) else x()
    enc = codec.enc if isinstance(codec, c.Codec) else codec
    add(name, of, lambda df: df.select(*keys, F.hex(enc(value())).alias("bytes")), f"SELECT {', '.join(keys)}, {oracle} AS bytes FROM {of} {where}")


def decoded(name: str, of: str, keys: list[str], codec: c.Codec, x: str, oracle: str, read: c.Codec | None = None, shown: Callable[[Column], Column] = lambda v: v) -> None:
    def build(df: DataFrame) -> DataFrame:
        rows = df.select(*keys, codec.enc(F.expr(x)).alias("b"))
        return rows.select(*keys, shown((read or codec).decode(F.col("b"))).alias("value"))

    add(name, of, build, f"SELECT {', '.join(keys)}, {oracle} AS value FROM {of}")


ORDER, LINE, PART, NATION, CUSTOMER, EVENT = ["o_orderkey"], ["l_orderkey", "l_linenumber"], ["p_partkey"], ["n_nationkey"], ["c_custkey"], ["event_id"]

# numbers
encoded("encode_i64", "orders", ORDER, c.i64, "-o_orderkey", sql.be("-o_orderkey", 8))
decoded("decode_i64", "orders", ORDER, c.i64, "-o_orderkey", "-o_orderkey")
encoded("encode_i32", "nation", NATION, c.i32, "n_nationkey - 3", sql.be("n_nationkey - 3", 4))
decoded("decode_i32", "nation", NATION, c.i32, "n_nationkey - 3", "n_nationkey - 3")
encoded("encode_i8", "part", PART, c.i8, "p_size - 25", sql.be("p_size - 25", 1))
encoded("encode_i16", "part", PART, c.i16, "p_size * 100 - 2500", sql.be("p_size * 100 - 2500", 2))
encoded(
    "encode_u64", "orders", ORDER,
    c.u64,
    "cast(18446744073709551615 as decimal(20,0)) - o_orderkey",
    "lpad(hex(18446744073709551615::UHUGEINT - o_orderkey::UHUGEINT),16,'0')",
)
encoded(
    "encode_i128", "orders", ORDER,
    c.i128,
    "cast(o_orderkey as decimal(38,0)) * cast(18446744073709551616 as decimal(38,0)) + o_custkey",
    "lpad(hex(o_orderkey),16,'0') || lpad(hex(o_custkey),16,'0')",
)
encoded("encode_f64", "lineitem", LINE, c.f64, "l_extendedprice", sql.f64("l_extendedprice"))
decoded("decode_f64", "lineitem", LINE, c.f64, "l_extendedprice", "l_extendedprice")
encoded("encode_f32", "lineitem", LINE, c.f32, "cast(l_quantity as float)", sql.f32("l_quantity"))
encoded("encode_var_u32", "lineitem", LINE, c.var_u32, "l_partkey * 997", sql.var_u32("l_partkey * 997"))
decoded("decode_var_u32", "lineitem", LINE, c.var_u32, "l_partkey * 997", "l_partkey * 997")
encoded("encode_var_i32", "part", PART, c.var_i32, "(p_size - 25) * 1000", sql.var_i32("(p_size - 25) * 1000"))
decoded("decode_var_i32", "part", PART, c.var_i32, "(p_size - 25) * 1000", "((p_size - 25) * 1000)::BIGINT")
decoded("decode_nonzero_guard", "lineitem", LINE, c.nonzero(c.i32), "l_linenumber", "l_linenumber")
encoded("encode_bool", "lineitem", LINE, c.boolean, "l_returnflag = 'R'", "CASE WHEN l_returnflag = 'R' THEN '01' ELSE '00' END")

# text and bytes
first = "substring(p_name, 1, 1)"
wide = c.Options(utf16_chars=True)
encoded("encode_char", "part", PART, c.char(), first, sql.var_u32(f"ascii({first})"))
decoded("decode_char", "part", PART, c.char(), first, first)
encoded("encode_char_u16", "part", PART, c.char(wide), first, sql.be(f"ascii({first})", 2))
decoded("decode_char_u16", "part", PART, c.char(wide), first, first)
encoded("encode_string", "customer", CUSTOMER, c.string, "c_name", sql.string("c_name"))
add(
    "encode_text", "documents",
    lambda df: df.select("doc_id", F.md5(F.hex(c.string.enc(F.col("text")))).alias("digest"), c.string.size(F.col("text")).cast("bigint").alias("size")),
    f"SELECT doc_id, md5({sql.string('text')}) AS digest, {sql.size_of_string('text')}::BIGINT AS size FROM documents",
)
decoded("decode_string", "documents", ["doc_id"], c.string, "text", "text")
encoded("encode_url", "pages", ["page_id"], c.url, "url", sql.string("url"))
decoded("decode_url", "pages", ["page_id"], c.url, "url", "url")
encoded("encode_bytes", "part", PART, c.block, "encode(p_brand, 'utf-8')", sql.block("encode(p_brand)"))
decoded("decode_bytes", "part", PART, c.block, "encode(p_brand, 'utf-8')", "p_brand", shown=lambda v: F.decode(v, "utf-8"))
digest = "md5(o_orderkey::VARCHAR)"
spark_digest = "md5(cast(o_orderkey as string))"
encoded(
    "encode_uuid", "orders", ORDER,
    c.uuid,
    f"regexp_replace({spark_digest}, '(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})', '$1-$2-$3-$4-$5')",
    f"upper({digest})",
)
decoded(
    "decode_uuid", "orders", ORDER,
    c.uuid,
    spark_digest,
    "regexp_replace(md5(o_orderkey::VARCHAR), '(.{8})(.{4})(.{4})(.{4})(.{12})', '\\1-\\2-\\3-\\4-\\5')",
)
encoded(
    "encode_mac", "orders", ORDER,
    c.mac,
    f"rtrim(':', regexp_replace(left({spark_digest}, 12), '(..)', '$1:'))",
    f"upper(left({digest}, 12))",
)
octets = [f"(o_orderkey // {256**k}) % 256" for k in (2, 1, 0)]
encoded(
    "encode_ipv4", "orders", ORDER,
    c.ipv4,
    "concat_ws('.', 10, (o_orderkey div 65536) % 256, (o_orderkey div 256) % 256, o_orderkey % 256)",
    "'000A' || " + " || ".join(sql.be(o, 1) for o in octets),
)
v6 = "concat('2001:db8::', lower(hex(o_orderkey % 65536)))"
add(
    "encode_ipv6", "orders",
    lambda df: df.select("o_orderkey", F.hex(fallback.ip(F.expr(v6))).alias("bytes")),
    f"SELECT o_orderkey, '0120010DB8' || repeat('0', 20) || {sql.be('o_orderkey % 65536', 2)} AS bytes FROM orders",
)
add(
    "decode_ip", "orders",
    lambda df: df.select("o_orderkey", fallback.ip_of(fallback.ip(F.expr(f"if(o_orderkey % 2 = 0, '10.1.2.3', {v6})"))).alias("value")),
    "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '10.1.2.3' ELSE '2001:db8::' || lower(hex(o_orderkey % 65536)) END AS value FROM orders",
)
bits = [f"(p_partkey >> {k}) & 1" for k in range(8)]
encoded(
    "encode_bitvec", "part", PART,
    c.bit_array,
    "transform(sequence(0, 7), k -> (shiftright(p_partkey, k) & 1) = 1)",
    "'01' || " + sql.be(" + ".join(f"(({b}) << {7 - k})" for k, b in enumerate(bits)), 1),
)

# options, results, bounds, ranges
clicked = "nullif(event_type, 'click')"
encoded("encode_option", "events", EVENT, c.option(c.string), clicked, sql.option(clicked, sql.string("event_type")))
decoded("decode_option", "events", EVENT, c.option(c.string), clicked, clicked)
money = "cast(s_acctbal * 100 as bigint)"
result = c.result_of(c.i64, c.string)
value = f"if(s_acctbal >= 0, named_struct('ok', {money}, 'err', cast(null as string)), named_struct('ok', cast(null as bigint), 'err', s_name))"
encoded(
    "encode_result", "supplier", ["s_suppkey"],
    result,
    value,
    f"CASE WHEN s_acctbal >= 0 THEN '01' || {sql.be('trunc(s_acctbal * 100)', 8)} ELSE '00' || {sql.string('s_name')} END",
)
decoded(
    "decode_result", "supplier", ["s_suppkey"],
    result,
    value,
    "coalesce(CASE WHEN s_acctbal >= 0 THEN trunc(s_acctbal * 100)::BIGINT::VARCHAR END, s_name)",
    shown=lambda v: F.coalesce(v["ok"].cast("string"), v["err"]),
)
encoded(
    "encode_bound", "orders", ORDER,
    c.bound(c.i64),
    "named_struct('kind', cast(o_orderkey % 3 as tinyint), 'value', o_custkey)",
    f"CASE o_orderkey % 3 WHEN 0 THEN '00' WHEN 1 THEN '01' || {sql.be('o_custkey', 8)} ELSE '02' || {sql.be('o_custkey', 8)} END",
)
encoded(
    "encode_range", "orders", ORDER,
    c.range_of(c.i64),
    "named_struct('start', o_custkey, 'end', o_custkey + o_orderkey)",
    f"{sql.be('o_custkey', 8)} || {sql.be('o_custkey + o_orderkey', 8)}",
)

# time
encoded(
    "encode_duration", "events", EVENT,
    c.duration,
    "named_struct('secs', cast(event_id as decimal(20,0)), 'nanos', event_id % 1000)",
    f"{sql.be('event_id', 8)} || {sql.be('event_id % 1000', 4)}",
)
encoded(
    "encode_timestamp", "events", EVENT,
    c.timestamp,
    "ts",
    f"{sql.be('epoch_us(ts) // 1000000', 8)} || {sql.be('(epoch_us(ts) % 1000000) * 1000', 4)}",
)
decoded("decode_timestamp", "events", EVENT, c.timestamp, "ts", "epoch_us(ts)", shown=F.unix_micros)
encoded("encode_date", "orders", ORDER, c.date, "to_date(o_orderdate)", sql.date("o_orderdate"))
decoded("decode_date", "orders", ORDER, c.date, "to_date(o_orderdate)", "o_orderdate::DATE::VARCHAR", shown=lambda v: v.cast("string"))
encoded("encode_time", "events", EVENT, c.time_of_day, lambda: c.day_nanos(F.col("ts")), sql.time("ts"))
encoded("encode_datetime_naive", "events", EVENT, c.datetime_naive, "ts", f"{sql.date('ts')} || {sql.time('ts')}")
encoded(
    "encode_datetime_offset", "events", EVENT,
    c.datetime_offset,
    "named_struct('local', ts + interval 2 hours, 'offset', 7200)",
    f"{sql.date('(ts + INTERVAL 2 HOUR)')} || {sql.time('(ts + INTERVAL 2 HOUR)')} || '00' || {sql.var_i32('7200')}",
)
encoded(
    "encode_datetime_zone", "events", EVENT,
    c.datetime_zone,
    "named_struct('utc', ts, 'tz', 'Europe/Paris')",
    f"{sql.date('ts')} || {sql.time('ts')} || '01' || {sql.string(chr(39) + 'Europe/Paris' + chr(39))}",
)
add(
    "encode_weekday_month", "orders",
    lambda df: df.select("o_orderkey", F.hex(F.concat(c.weekday.enc(F.weekday("o_orderdate") + 1), c.month.enc(F.month("o_orderdate")))).alias("bytes")),
    f"SELECT o_orderkey, {sql.be('isodow(o_orderdate)', 1)} || {sql.be('month(o_orderdate)', 1)} AS bytes FROM orders",
)
add(
    "encode_offset_tz", "nation",
    lambda df: df.select("n_nationkey", F.hex(F.concat(c.offset.enc((F.col("n_nationkey") - 12) * 3600), c.zone.enc(F.col("n_name")))).alias("bytes")),
    f"SELECT n_nationkey, '00' || {sql.var_i32('(n_nationkey - 12) * 3600')} || '01' || {sql.string('n_name')} AS bytes FROM nation",
)

# decimals and JSON
price = "cast(o_totalprice as decimal(12,2))"
encoded("encode_decimal_text", "orders", ORDER, c.decimal(12, 2), price, sql.string(f"({price}::VARCHAR)"))
decoded("decode_decimal_text", "orders", ORDER, c.decimal(12, 2), price, f"{price}::VARCHAR", shown=lambda v: v.cast("string"))
cents = "((cast(o_totalprice as decimal(12,2)) * 100)::BIGINT)"
minimal = f"(CASE WHEN {cents} BETWEEN -128 AND 127 THEN '01' || {sql.be(cents, 1)} WHEN {cents} BETWEEN -32768 AND 32767 THEN '02' || {sql.be(cents, 2)} WHEN {cents} BETWEEN -8388608 AND 8388607 THEN '03' || {sql.be(cents, 3)} WHEN {cents} BETWEEN -2147483648 AND 2147483647 THEN '04' || {sql.be(cents, 4)} ELSE '05' || {sql.be(cents, 5)} END)"
encoded(
    "encode_decimal_binary", "orders", ORDER,
    c.decimal(12, 2, c.Options(binary_decimals=True)),
    price,
    f"'0000000000000002' || {minimal}",
)
encoded("encode_bigint", "orders", ORDER, c.bigint64, f"cast({price} * 100 as bigint)", minimal)
decoded("decode_bigint", "orders", ORDER, c.bigint64, f"cast({price} * 100 as bigint)", cents)
ten = "concat(o_orderkey, repeat('0', 40))"
add(
    "bigint_wide_roundtrip", "orders",
    lambda df: df.select("o_orderkey", fallback.bigint_of(fallback.bigint(F.expr(f"concat('-', {ten})"))).alias("value")),
    "SELECT o_orderkey, CASE WHEN o_orderkey = 0 THEN '0' ELSE '-' || o_orderkey || repeat('0', 40) END AS value FROM orders",
)
two = "cast(o_orderkey as decimal(38,0)) * cast(18446744073709551616 as decimal(38,0))"
# of a key: its width as two's complement, and its bytes
WIDTHS = [(n, 1 << (8 * n - 1)) for n in range(1, 8)]
least_key = "(CASE WHEN o_orderkey = 0 THEN '0100' " + " ".join(f"WHEN o_orderkey < {half} THEN '{8 + n:02X}' || {sql.be('o_orderkey', n)} || repeat('0', 16)" for n, half in WIDTHS) + " END)"
add(
    "encode_bigint_wide", "orders",
    lambda df: df.select("o_orderkey", F.hex(fallback.bigint(F.expr(f"cast({two} as string)"))).alias("bytes")),
    f"SELECT o_orderkey, {least_key} AS bytes FROM orders",
)
add(
    "encode_decimal_binary_wide", "orders",
    lambda df: df.select("o_orderkey", F.hex(fallback.big_decimal(F.expr(f"concat(cast({two} as string), 'E-50')"))).alias("bytes")),
    f"SELECT o_orderkey, '0000000000000032' || {least_key} AS bytes FROM orders",
)
add(
    "decimal_wide_roundtrip", "orders",
    lambda df: df.select("o_orderkey", fallback.big_decimal_of(fallback.big_decimal(F.expr("concat('0.', repeat('7', 60), o_orderkey)"))).alias("value")),
    "SELECT o_orderkey, '0.' || repeat('7', 60) || o_orderkey AS value FROM orders",
)
json_rows = lambda df: df.select("event_id", F.to_json(F.struct(F.col("event_id").alias("a"), F.col("event_type").alias("b"))).alias("j"))
add(
    "encode_json_text", "events",
    lambda df: json_rows(df).select("event_id", F.hex(c.json_text.enc(F.col("j"))).alias("bytes")),
    """SELECT event_id, """ + sql.block("encode('{\"a\":' || event_id || ',\"b\":\"' || event_type || '\"}')") + " AS bytes FROM events",
)
add(
    "encode_json_binary", "events",
    lambda df: json_rows(df).select("event_id", F.hex(fallback.json_binary(F.col("j"))).alias("bytes")),
    f"SELECT event_id, '0904' || {sql.string(chr(39) + 'a' + chr(39))} || '03' || {sql.be('event_id', 8)} || {sql.string(chr(39) + 'b' + chr(39))} || '07' || {sql.string('event_type')} AS bytes FROM events",
)
add(
    "encode_json_by_option", "events",
    lambda df: json_rows(df).select("event_id", *[F.md5(F.hex(fallback.json_encoded(F.col("j"), c.Options(binary_json=x)))).alias(name) for x, name in ((False, "text"), (True, "tree"))], *[(fallback.json_decoded(fallback.json_encoded(F.col("j"), c.Options(binary_json=x)), c.Options(binary_json=x)) == F.col("j")).alias(f"same_{name}") for x, name in ((False, "text"), (True, "tree"))]),
    "SELECT event_id, md5(" + sql.block("encode('{\"a\":' || event_id || ',\"b\":\"' || event_type || '\"}')") + f") AS text, md5('0904' || {sql.string(chr(39) + 'a' + chr(39))} || '03' || {sql.be('event_id', 8)} || {sql.string(chr(39) + 'b' + chr(39))} || '07' || {sql.string('event_type')}) AS tree, true AS same_text, true AS same_tree FROM events",
)
add(
    "json_binary_roundtrip", "events",
    lambda df: df.select("event_id", (fallback.json_of_binary(fallback.json_binary(F.col("props"))) == F.to_json(F.parse_json("props"))).alias("same")),
    "SELECT event_id, true AS same FROM events",
)

# nested
words = "split(p_name, ' ')"
items = "string_split(p_name, ' ')"
count = f"{sql.var_u32(f'2*len({items})')}"
of_x = sql.string("x")
encoded("encode_array_string", "part", PART, c.sequence(c.string), words, f"{count} || {sql.joined(items, of_x)}")
decoded("decode_array_string", "part", PART, c.sequence(c.string), words, "p_name", shown=lambda v: F.array_join(v, " "))
encoded(
    "encode_array_f32", "embeddings", ["vec_id"],
    c.sequence(c.f32),
    "embedding",
    f"{sql.var_u32('2*len(embedding)')} || {sql.joined('embedding', sql.f32('x'))}",
)
decoded(
    "decode_array_i64", "orders", ORDER,
    c.sequence(c.i64),
    "array(o_orderkey, o_custkey)",
    "o_orderkey || ',' || o_custkey",
    shown=lambda v: F.array_join(v.cast("array<string>"), ","),
)
encoded(
    "encode_iter_unknown", "part", PART,
    c.sequence(c.string, False),
    words,
    "'01' || " + sql.joined(items, f"'01' || {of_x}") + " || '00'",
)
decoded(
    "decode_iter_unknown", "nation", NATION,
    c.sequence(c.string, False),
    "split(n_name, '')",
    "n_name",
    shown=lambda v: F.array_join(v, ""),
)
distinct = f"list_sort(list_distinct({items}))"
encoded("encode_set", "part", PART, c.set_of(c.string), words, f"{sql.var_u32(f'2*len({distinct})')} || {sql.joined(distinct, of_x)}")
decoded(
    "list_to_set", "part", PART,
    c.sequence(c.string),
    f"concat({words}, {words})",
    f"array_to_string({distinct}, ' ')",
    read=c.set_of(c.string),
    shown=lambda v: F.array_join(F.array_sort(v), " "),
)
encoded("encode_nonempty", "part", PART, c.nonempty(c.string), words, f"{count} || {sql.joined(items, of_x)}")
add(
    "encode_map", "lineitem",
    lambda df: df.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity")).groupBy("l_orderkey").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("int"))))).alias("m")).select("l_orderkey", F.hex(c.map_of(c.i32, c.i32).enc(F.col("m"))).alias("bytes")),
    f"SELECT l_orderkey, {sql.var_u32('2*count(*)')} || string_agg('00' || {sql.be('l_linenumber', 4)} || {sql.be('l_quantity', 4)}, '' ORDER BY l_linenumber) AS bytes FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL) GROUP BY l_orderkey",
)
add(
    "decode_map", "orders",
    lambda df: df.select("o_orderkey", c.map_of(c.string, c.i64).enc(F.create_map(F.lit("b"), F.col("o_custkey"), F.lit("a"), F.col("o_orderkey"))).alias("b")).select("o_orderkey", c.map_of(c.string, c.i64).decode(F.col("b"))["b"].alias("value")),
    "SELECT o_orderkey, o_custkey AS value FROM orders",
)
pair = c.tuple_of(c.i64, c.string)
encoded(
    "encode_tuple2", "lineitem", LINE,
    pair,
    "named_struct('_0', l_orderkey, '_1', l_returnflag)",
    f"'00' || {sql.be('l_orderkey', 8)} || {sql.string('l_returnflag')}",
)
eight = c.tuple_of(c.i64, c.i64, c.i64, c.i32, c.f64, c.f64, c.string, c.string)
encoded(
    "encode_tuple8", "lineitem", LINE,
    eight,
    "named_struct('_0', l_orderkey, '_1', l_partkey, '_2', l_suppkey, '_3', l_linenumber, '_4', l_quantity, '_5', l_extendedprice, '_6', l_returnflag, '_7', l_linestatus)",
    f"'00' || {sql.be('l_orderkey', 8)} || {sql.be('l_partkey', 8)} || {sql.be('l_suppkey', 8)} || {sql.be('l_linenumber', 4)} || {sql.f64('l_quantity')} || {sql.f64('l_extendedprice')} || {sql.string('l_returnflag')} || {sql.string('l_linestatus')}",
)
encoded("encode_tuple1", "orders", ORDER, c.tuple_of(c.i64), "named_struct('_0', o_custkey)", f"'00' || {sql.be('o_custkey', 8)}")
as_record = Record((Field("key", c.i64), Field("flag", c.string)))
decoded(
    "tuple_to_record", "lineitem", LINE,
    pair,
    "named_struct('_0', l_orderkey, '_1', l_returnflag)",
    "l_orderkey || l_returnflag",
    read=as_record.codec(),
    shown=lambda v: F.concat(v["key"].cast("string"), v["flag"]),
)
encoded("encode_transparent", "orders", ORDER, c.i64, "o_custkey", sql.be("o_custkey", 8))
encoded("encode_unit", "orders", ORDER, c.unit, "o_custkey", "''")

# records and their history
CUSTOMERS = Record((Field("c_custkey", c.i64), Field("c_name", c.string), Field("c_nationkey", c.i32)))
record_hex = f"'00' || {sql.be('c_custkey', 8)} || {sql.string('c_name')} || {sql.be('c_nationkey', 4)}"


def customer_bytes(df: DataFrame) -> DataFrame:
    return df.select("c_custkey", "c_mktsegment", "c_name", "c_nationkey", CUSTOMERS.enc(F.struct("c_custkey", "c_name", "c_nationkey")).alias("b"))


def roundtrip_by_segment(df: DataFrame) -> DataFrame:
    rows = decode_record(customer_bytes(df), "b", CUSTOMERS, 0)
    wrong = ~(F.col("decoded.c_name").eqNullSafe(F.col("c_name")) & F.col("decoded.c_nationkey").eqNullSafe(F.col("c_nationkey")) & F.col("decoded.c_custkey").eqNullSafe(F.col("c_custkey")))
    return rows.groupBy("c_mktsegment").agg(F.count("*").alias("n_rows"), F.sum(F.octet_length("b")).alias("bytes"), F.sum(wrong.cast("int")).alias("mismatches"))


add(
    "encode_record_v0", "customer",
    roundtrip_by_segment,
    f"SELECT c_mktsegment, count(*) AS n_rows, sum(13 + {sql.size_of_string('c_name')})::BIGINT AS bytes, 0::BIGINT AS mismatches FROM customer GROUP BY c_mktsegment",
)
add(
    "encode_record_bytes", "customer",
    lambda df: customer_bytes(df).select("c_custkey", F.hex("b").alias("bytes")),
    f"SELECT c_custkey, {record_hex} AS bytes FROM customer",
)
add(
    "decode_record_v0", "customer",
    lambda df: decode_record(customer_bytes(df).select("c_custkey", "b"), "b", CUSTOMERS, 0).select("c_custkey", "decoded.c_name", "decoded.c_nationkey"),
    "SELECT c_custkey, c_name, c_nationkey FROM customer",
)

PRODUCT = Record(
    (Field("field_a", c.string), Field("new_field_1", c.boolean), Field("field_b", c.i32)),
    (Added("new_field_1", True), MadeOptional("field_b"), Removed("field_b"), MadeTransient("field_a", "unset")),
)
even = "c_custkey % 2 = 0"
A, N, B = sql.string("c_name"), f"(CASE WHEN {even} THEN '01' ELSE '00' END)", sql.be("c_nationkey", 4)
optional_b = f"(CASE WHEN c_custkey % 3 = 0 THEN '00' ELSE '01' || {B} END)"
REMOVED_B = "0E" + b"field_b".hex().upper()
REMOVED_A = "0E" + b"field_a".hex().upper()
half = lambda h: f"(2 * (length({h}) // 2))"
PRODUCT_HEX = [
    f"'00' || {A} || {B}",
    f"'01' || {sql.var_u32(half(f'{A} || {B}'))} || '02' || {A} || {B} || {N}",
    f"'02' || {sql.var_u32(half(f'{A} || {optional_b}'))} || '0201FF' || {A} || {optional_b} || {N}",
    f"'03' || {sql.var_u32(half(A))} || '0203{REMOVED_B}0301' || {A} || {N}",
    f"'0400' || '0203{REMOVED_B}030103{REMOVED_A}' || {N}",
]


def products(df: DataFrame, version: int) -> DataFrame:
    """Customers as one version of PRODUCT; every third has no field_b where it is optional."""
    b = F.when(F.lit(version >= 2) & (F.col("c_custkey") % 3 == 0), F.lit(None)).otherwise(F.col("c_nationkey"))
    value = F.struct(F.col("c_name").alias("field_a"), F.expr(even).alias("new_field_1"), b.cast("int").alias("field_b"))
    return df.select("c_custkey", PRODUCT.at(version).enc(value).alias("b"))


for version, name in enumerate(("encode_product_v0", "encode_record_v1_added", "encode_record_v2_optional", "encode_record_v3_removed", "encode_record_v4_transient")):
    add(name, "customer", lambda df, v=version: products(df, v).select("c_custkey", F.hex("b").alias("bytes")), f"SELECT c_custkey, {PRODUCT_HEX[version]} AS bytes FROM customer")

header_of = lambda df: products(df, 3).select("c_custkey", read_header(F.col("b"), F.lit(1)).alias("h"))
add(
    "decode_header", "customer",
    lambda df: header_of(df).select("c_custkey", F.col("h.version").alias("version"), F.get("h.sizes", F.lit(0)).alias("first_chunk"), F.array_join("h.removed", ",").alias("removed")),
    f"SELECT c_custkey, 3 AS version, {sql.size_of_string('c_name')}::INTEGER AS first_chunk, 'field_b,field_b' AS removed FROM customer",
)


def evolve(name: str, writer: int, reader: int) -> None:
    """Reads bytes of one version as another: value columns as text, and the error code."""
    fields = [f.name for f in PRODUCT.at(reader).read_fields()]

    def build(df: DataFrame) -> DataFrame:
        rows = decode_record(products(df, writer), "b", PRODUCT, reader)
        return rows.select("c_custkey", *[F.col(f"decoded.{f}").alias(f) for f in fields], F.col("decoded._error").alias("error"))

    none = "c_custkey % 3 = 0"
    a = "'unset'" if reader == 4 else "c_name" if writer < 4 else None
    n = "true" if writer == 0 else f"({even})"
    b = "c_nationkey" if writer < 2 else f"CASE WHEN {none} THEN NULL ELSE c_nationkey END" if writer == 2 else "NULL::INTEGER" if reader == 2 else None
    error = "NULL::VARCHAR"
    if a is None or b is None and reader in (0, 1):
        error = f"'{w.REMOVED}'"
    elif writer == 2 and reader < 2:
        error = f"CASE WHEN {none} THEN '{w.NONE_FOUND}' END"
    shown = {"field_a": a or "NULL::VARCHAR", "new_field_1": n, "field_b": b or "NULL::INTEGER"}
    columns = [f"CASE WHEN ({error}) IS NULL THEN {shown[f]} END AS {f}" for f in fields]
    add(name, "customer", build, f"SELECT c_custkey, {', '.join(columns)}, {error} AS error FROM customer")


NAMED = {(0, 1): "evolve_v1_to_v2", (1, 0): "evolve_v2_to_v1", (1, 2): "evolve_v2_to_v3", (2, 1): "evolve_v3_to_v2_some", (2, 0): "evolve_v3_to_v1_some", (0, 3): "evolve_v1_to_v4", (3, 2): "evolve_v4_to_v3_none", (0, 4): "evolve_v1_to_v5", (3, 4): "evolve_transient_read", (3, 0): "evolve_v4_to_v1_error"}
for writer in range(5):
    for reader in range(5):
        evolve(NAMED.get((writer, reader), f"evolve_v{writer + 1}_to_v{reader + 1}"), writer, reader)

# unions
Purchase = Record((Field("value", c.f64),))
EVENTS = Union((Case("view"), Case("click"), Case("purchase", Purchase), Case("signup", c.i64), Case("error", c.string)))
EVENTS_BY_NAME = Union(EVENTS.cases, sorted_ids=True)


def event_value() -> Column:
    return F.struct(
        F.col("event_type").alias("case"),
        F.when(F.col("event_type") == "purchase", F.struct("value")).alias("purchase"),
        F.when(F.col("event_type") == "signup", F.col("user_id")).alias("signup"),
        F.when(F.col("event_type") == "error", F.col("props")).alias("error"),
    )


def union_hex(ids: dict[str, int]) -> str:
    bodies = {"purchase": f"'00' || {sql.f64('value')}", "signup": sql.be("user_id", 8), "error": sql.string("props")}
    return "CASE event_type " + " ".join(f"WHEN '{k}' THEN '00' || {sql.var_u32(str(i))} || {bodies.get(k, chr(39) + '00' + chr(39))}" for k, i in ids.items()) + " END"


encoded("encode_union", "events", EVENT, EVENTS.enc, event_value, union_hex(EVENTS.ids()))
encoded("encode_union_sorted", "events", EVENT, EVENTS_BY_NAME.enc, event_value, union_hex(EVENTS_BY_NAME.ids()))


def read_events(df: DataFrame, union: Union) -> DataFrame:
    return df.select("event_id", EVENTS.enc(event_value()).alias("b")).select("event_id", union.codec().try_decode(F.col("b")).alias("d"))


add(
    "decode_union", "events",
    lambda df: read_events(df, EVENTS).select("event_id", "d.value.case", F.col("d.value.purchase.value").alias("value"), F.col("d.value.signup").alias("user_id")),
    "SELECT event_id, event_type AS \"case\", CASE WHEN event_type = 'purchase' THEN value END AS value, CASE WHEN event_type = 'signup' THEN user_id END AS user_id FROM events",
)
add(
    "union_case_counts", "events",
    lambda df: df.select(EVENTS.enc(event_value()).alias("b")).groupBy(w.read_var_u32(F.col("b"), F.lit(2))["v"].alias("id")).agg(F.count("*").alias("n"), F.sum(F.octet_length("b")).alias("bytes")),
    "SELECT id, count(*) AS n, sum(length(h) // 2)::BIGINT AS bytes FROM (SELECT (CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END)::BIGINT AS id, " + union_hex(EVENTS.ids()) + " AS h FROM events) GROUP BY id",
)
OLDER = Union(EVENTS.cases[:4])
add(
    "evolve_union_added_case", "events",
    lambda df: read_events(df, OLDER).select("event_id", "d.value.case", F.col("d._error").alias("error")),
    f"SELECT event_id, CASE WHEN event_type <> 'error' THEN event_type END AS \"case\", CASE WHEN event_type = 'error' THEN '{w.BAD_CONSTRUCTOR}' END AS error FROM events",
)
HIDDEN = Union((Case("view"), Case("draft", c.string, transient=True), Case("click"), *EVENTS.cases[2:]))
add(
    "union_transient_guard", "events",
    lambda df: read_events(df, HIDDEN).select("event_id", "d.value.case"),
    "SELECT event_id, event_type AS \"case\" FROM events",
)
PAID = Record((Field("value", c.f64), Field("currency", c.string)), (Added("currency", "EUR"),))
PAID_EVENTS = Union((*EVENTS.cases[:2], Case("purchase", PAID), *EVENTS.cases[3:]))
UNPAID_EVENTS = Union((*EVENTS.cases[:2], Case("purchase", PAID.at(0)), *EVENTS.cases[3:]))


def paid_events(df: DataFrame, newer: Column) -> DataFrame:
    """All events through unions whose purchases have a history, written by its last version where newer and by its first elsewhere."""
    value = event_value().withField("purchase", F.when(F.col("event_type") == "purchase", F.struct("value", F.lit("USD").alias("currency"))))
    both = F.when(newer, PAID_EVENTS.enc(value)).otherwise(UNPAID_EVENTS.enc(event_value()))
    return df.select("event_id", both.alias("b")).select("event_id", PAID_EVENTS.codec().try_decode(F.col("b")).alias("d"))


add(
    "evolve_union_case", "events",
    lambda df: paid_events(df, F.lit(False)).where("d.value.case = 'purchase'").select("event_id", "d.value.purchase.value", "d.value.purchase.currency"),
    "SELECT event_id, value, 'EUR' AS currency FROM events WHERE event_type = 'purchase'",
)
add(
    "evolve_union_case_all", "events",
    lambda df: paid_events(df, F.col("event_id") % 2 == 1).select("event_id", "d.value.case", "d.value.purchase.value", "d.value.purchase.currency", F.col("d.value.signup").alias("user_id"), F.col("d.value.error").alias("props"), F.col("d._error").alias("error")),
    "SELECT event_id, event_type AS \"case\", CASE WHEN event_type = 'purchase' THEN value END AS value, CASE WHEN event_type = 'purchase' THEN CASE WHEN event_id % 2 = 1 THEN 'USD' ELSE 'EUR' END END AS currency, CASE WHEN event_type = 'signup' THEN user_id END AS user_id, CASE WHEN event_type = 'error' THEN props END AS props, NULL AS error FROM events",
)

# sizes
total = f"13 + {sql.size_of_string('c_name')}"
add(
    "serialized_size_row", "customer",
    lambda df: df.select("c_custkey", CUSTOMERS.codec().size(F.struct("c_custkey", "c_name", "c_nationkey")).cast("bigint").alias("size")),
    f"SELECT c_custkey, ({total})::BIGINT AS size FROM customer",
)
add(
    "serialized_size_by_group", "documents",
    lambda df: df.groupBy("lang").agg(F.sum(c.string.size(F.col("text")).cast("bigint")).alias("bytes"), F.count("*").alias("n")),
    f"SELECT lang, sum({sql.size_of_string('text')})::BIGINT AS bytes, count(*) AS n FROM documents GROUP BY lang",
)
add(
    "format_size_comparison", "customer",
    lambda df: df.select(F.octet_length(F.to_json(F.struct("c_custkey", "c_name", "c_nationkey"))).alias("json"), CUSTOMERS.codec().size(F.struct("c_custkey", "c_name", "c_nationkey")).alias("codec"), F.octet_length(F.concat_ws(",", "c_custkey", "c_name", "c_nationkey")).alias("csv")).agg(*[F.sum(x).alias(x) for x in ("json", "codec", "csv")]),
    f"SELECT sum(strlen('{{\"c_custkey\":' || c_custkey || ',\"c_name\":\"' || c_name || '\",\"c_nationkey\":' || c_nationkey || '}}'))::BIGINT AS json, sum({total})::BIGINT AS codec, sum(strlen(c_custkey || ',' || c_name || ',' || c_nationkey))::BIGINT AS csv FROM customer",
)

# state over ordered rows
ids = "WITH f AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1 AS is_new FROM events), g AS (SELECT *, sum(is_new::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM f), h AS (SELECT *, (first(n) OVER (PARTITION BY user_id, event_type ORDER BY event_id))::BIGINT AS string_id FROM g) "
word = f"CASE WHEN is_new THEN {sql.string('event_type')} ELSE {sql.var_i32('-string_id')} END"
add(
    "dedup_ids", "events",
    lambda df: streams.dedup_ids(df, "user_id", "event_id", "event_type").select("event_id", "string_id", "is_new"),
    ids + "SELECT event_id, string_id, is_new FROM h",
)
add(
    "dedup_encode", "events",
    lambda df: streams.dedup_encode(df, "user_id", "event_id", "event_type").select("event_id", F.hex("bytes").alias("bytes")),
    ids + f"SELECT event_id, {word} AS bytes FROM h",
)
add(
    "dedup_decode", "events",
    lambda df: streams.dedup_decode(streams.dedup_encode(df, "user_id", "event_id", "event_type").select("user_id", "event_id", "bytes"), "user_id", "event_id", "bytes").select("event_id", "text"),
    "SELECT event_id, event_type AS text FROM events",
)
add(
    "dedup_savings", "events",
    lambda df: streams.dedup_encode(df, "user_id", "event_id", "event_type").groupBy("event_type").agg(F.sum(F.octet_length("bytes")).alias("deduplicated"), F.sum(c.string.size(F.col("event_type"))).alias("plain")),
    ids + f"SELECT event_type, sum(length({word}) // 2)::BIGINT AS deduplicated, sum({sql.size_of_string('event_type')})::BIGINT AS plain FROM h GROUP BY event_type",
)
add(
    "ref_backrefs", "conversations",
    lambda df: streams.back_references(df, "conv_id", "turn", F.col("role")).select("conv_id", "turn", "ref"),
    "WITH f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) = 1 AS fresh FROM conversations), g AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM f) SELECT conv_id, turn, CASE WHEN fresh THEN 0 ELSE first(n) OVER (PARTITION BY conv_id, role ORDER BY turn) END::BIGINT AS ref FROM g",
)

# layout and envelopes
PARTS = lambda: CUSTOMERS.parts(F.struct("c_custkey", "c_name", "c_nationkey"))
named = f"size_of AS (SELECT c_custkey, {sql.size_of_string('c_name')} AS s FROM customer)"
add(
    "layout_segments", "customer",
    lambda df: layout.segments(df, "c_custkey", PARTS()),
    f"WITH {named} SELECT c_custkey, pos, label, start::BIGINT AS start, len::BIGINT AS len FROM (SELECT c_custkey, 0 AS pos, 'version' AS label, 0 AS start, 1 AS len FROM size_of UNION ALL SELECT c_custkey, 1, 'c_custkey', 1, 8 FROM size_of UNION ALL SELECT c_custkey, 2, 'c_name', 9, s FROM size_of UNION ALL SELECT c_custkey, 3, 'c_nationkey', 9 + s, 4 FROM size_of)",
)
add(
    "layout_coverage", "customer",
    lambda df: layout.coverage(df, "c_custkey", PARTS(), CUSTOMERS.enc(F.struct("c_custkey", "c_name", "c_nationkey"))),
    f"SELECT c_custkey, ({total})::BIGINT AS bytes, ({total})::BIGINT AS covered, true AS exact FROM customer",
)
# version and key are 9 bytes and so a row; the name has rows of its own, of which a last one below 8 bytes takes the nation in
add(
    "layout_rows", "customer",
    lambda df: layout.wrapped(df, "c_custkey", PARTS()).select("c_custkey", "row", "start", "len", "labels"),
    f"""WITH {named}, name_rows AS (SELECT c_custkey, s, k, least(16, s - 16 * k) AS n, s <= 16 * (k + 1) AS is_last FROM size_of, range(0, 100) r(k) WHERE 16 * k < s)
    SELECT c_custkey, 0 AS row, 0::BIGINT AS start, 9::BIGINT AS len, 'version,c_custkey' AS labels FROM size_of
    UNION ALL SELECT c_custkey, (k + 1)::INTEGER, (9 + 16 * k)::BIGINT, (CASE WHEN is_last AND n < 8 THEN n + 4 ELSE n END)::BIGINT, CASE WHEN is_last AND n < 8 THEN 'c_name,c_nationkey' ELSE 'c_name' END FROM name_rows
    UNION ALL SELECT c_custkey, (k + 2)::INTEGER, (9 + s)::BIGINT, 4::BIGINT, 'c_nationkey' FROM name_rows WHERE is_last AND n >= 8""",
)
add(
    "hex_dump", "customer",
    lambda df: customer_bytes(df).select("c_custkey", layout.hex_dump(F.col("b")).alias("dump")),
    "SELECT c_custkey, rtrim(regexp_replace(regexp_replace(lower(" + record_hex + "), '(..)', '\\1 ', 'g'), '((?:.. ){15}..) ', E'\\\\1\\n', 'g'), E' \\n') AS dump FROM customer",
)
add(
    "envelope_roundtrip", "customer",
    lambda df: customer_bytes(df).select("c_custkey", layout.envelope(F.col("b")).alias("e")).select("c_custkey", F.hex("e").alias("bytes"), F.hex(layout.open_envelope(F.col("e"))).alias("inner_bytes")),
    f"SELECT c_custkey, '03' || {record_hex} AS bytes, {record_hex} AS inner_bytes FROM customer",
)
add(
    "payload_indirection", "documents",
    lambda df: df.select("doc_id", F.md5(F.hex(layout.payload(F.encode("text", "utf-8"), 1024))).alias("digest")),
    "SELECT doc_id, md5(CASE WHEN strlen(text) > 1024 THEN '01' || upper(md5(text)) || '10' || upper(md5(text)) ELSE '00' || " + sql.block("encode(text)") + " END) AS digest FROM documents",
)


def payload_roundtrip(df: DataFrame) -> DataFrame:
    data = F.encode("text", "utf-8")
    rows = df.select("doc_id", layout.payload(data, 1024).alias("b"))
    return layout.resolved_payloads(rows, "doc_id", "b", layout.stored_payloads(data, df, 1024)).select("doc_id", F.md5("data").alias("digest"))


add("payload_roundtrip", "documents", payload_roundtrip, "SELECT doc_id, md5(text) AS digest FROM documents")
chunks = lambda df: layout.pack_chunks(df.select("event_id", c.string.enc(F.col("event_type")).alias("b")), F.floor(F.col("event_id") / 64), "event_id", "b")
one = sql.string("event_type")
add(
    "chunk_pack", "events",
    lambda df: chunks(df).select("bucket", "first", "n", F.hex("chunk").alias("bytes")),
    f"SELECT event_id // 64 AS bucket, min(event_id) AS first, count(*)::INTEGER AS n, string_agg({sql.var_u32(f'length({one}) // 2')} || {one}, '' ORDER BY event_id) AS bytes FROM events GROUP BY 1",
)
add(
    "chunk_unpack", "events",
    lambda df: layout.unpack_chunks(chunks(df)).select("bucket", "place", c.string.decode(F.col("data")).alias("text")),
    "SELECT event_id // 64 AS bucket, (row_number() OVER (PARTITION BY event_id // 64 ORDER BY event_id) - 1)::INTEGER AS place, event_type AS text FROM events",
)
add(
    "compress_roundtrip", "documents",
    lambda df: df.select("doc_id", F.md5(fallback.inflated(fallback.compressed(F.encode("text", "utf-8")))).alias("digest")),
    "SELECT doc_id, md5(text) AS digest FROM documents",
)
add(
    "compress_ratio", "documents",
    lambda df: df.groupBy("lang").agg(F.avg(F.octet_length(fallback.compressed(F.encode("text", "utf-8"))) / F.greatest(F.octet_length("text"), F.lit(1))).alias("ratio")),
    None,
)

# decoding of the codecs above
decoded("decode_i8", "part", PART, c.i8, "p_size - 25", "(p_size - 25)::TINYINT")
decoded("decode_i16", "part", PART, c.i16, "p_size * 100 - 2500", "(p_size * 100 - 2500)::SMALLINT")
decoded("decode_u8", "part", PART, c.u8, "p_size + 200", "(p_size + 200)::SMALLINT")
decoded("decode_u16", "part", PART, c.u16, "p_size + 65000", "p_size + 65000")
decoded("decode_u32", "orders", ORDER, c.u32, "4294967295 - o_orderkey", "4294967295 - o_orderkey")
decoded(
    "decode_u64", "orders", ORDER,
    c.u64,
    "cast(18446744073709551615 as decimal(20,0)) - o_orderkey",
    "(18446744073709551615::UHUGEINT - o_orderkey::UHUGEINT)::VARCHAR",
    shown=lambda v: v.cast("string"),
)
decoded("decode_isize", "orders", ORDER, c.isize, "-o_orderkey", "-o_orderkey")
i128 = "cast(o_orderkey as decimal(38,0)) * cast(18446744073709551616 as decimal(38,0)) + o_custkey"
decoded(
    "decode_i128", "orders", ORDER,
    c.i128,
    f"-({i128})",
    "(-(o_orderkey::HUGEINT * 18446744073709551616::HUGEINT + o_custkey::HUGEINT))::VARCHAR",
    shown=lambda v: v.cast("string"),
)
decoded("decode_f32", "lineitem", LINE, c.f32, "cast(l_quantity as float)", "l_quantity", shown=lambda v: v.cast("double"))
decoded("decode_bool", "lineitem", LINE, c.boolean, "l_returnflag = 'R'", "l_returnflag = 'R'")
decoded(
    "decode_mac", "orders", ORDER,
    c.mac,
    f"left({spark_digest}, 12)",
    f"rtrim(regexp_replace(left({digest}, 12), '(..)', '\\1:', 'g'), ':')",
)
decoded(
    "decode_bitvec", "part", PART,
    c.bit_array,
    "transform(sequence(0, 7), k -> (shiftright(p_partkey, k) & 1) = 1)",
    "(" + " || ".join(f"({b})" for b in bits) + ")",
    shown=lambda v: F.array_join(v.cast("array<int>").cast("array<string>"), ""),
)
decoded(
    "decode_duration", "events", EVENT,
    c.duration,
    "named_struct('secs', cast(event_id as decimal(20,0)), 'nanos', event_id % 1000)",
    "event_id || '.' || (event_id % 1000)",
    shown=lambda v: F.concat_ws(".", v["secs"].cast("string"), v["nanos"].cast("string")),
)
of_day = "(epoch_us(ts) % 86400000000) * 1000"
add(
    "decode_time", "events",
    lambda df: df.select("event_id", c.time_of_day.enc(c.day_nanos(F.col("ts"))).alias("b")).select("event_id", c.time_of_day.decode(F.col("b")).alias("value")),
    f"SELECT event_id, {of_day} AS value FROM events",
)
shown_time = lambda v: F.date_format(v, "yyyy-MM-dd HH:mm:ss.SSSSSS")
as_shown = lambda ts: f"strftime({ts}, '%Y-%m-%d %H:%M:%S.%f')"
decoded("decode_datetime_naive", "events", EVENT, c.datetime_naive, "ts", as_shown("ts"), shown=shown_time)
decoded(
    "decode_datetime_offset", "events", EVENT,
    c.datetime_offset,
    "named_struct('local', ts + interval 2 hours, 'offset', 7200)",
    as_shown("(ts + INTERVAL 2 HOUR)") + " || ' 7200'",
    shown=lambda v: F.concat_ws(" ", shown_time(v["local"]), v["offset"].cast("string")),
)
decoded(
    "decode_datetime_zone", "events", EVENT,
    c.datetime_zone,
    "named_struct('utc', ts, 'tz', 'Europe/Paris')",
    as_shown("ts") + " || ' Europe/Paris'",
    shown=lambda v: F.concat_ws(" ", shown_time(v["utc"]), v["tz"]),
)
decoded("decode_weekday", "orders", ORDER, c.weekday, "weekday(o_orderdate) + 1", "isodow(o_orderdate)::TINYINT")
decoded("decode_month", "orders", ORDER, c.month, "month(o_orderdate)", "month(o_orderdate)::TINYINT")
decoded("decode_offset", "nation", NATION, c.offset, "(n_nationkey - 12) * 3600", "(n_nationkey - 12) * 3600")
decoded("decode_tz", "nation", NATION, c.zone, "n_name", "n_name")
decoded(
    "decode_decimal_binary", "orders", ORDER,
    c.decimal(12, 2, c.Options(binary_decimals=True)),
    f"-{price}",
    f"(-{price})::VARCHAR",
    shown=lambda v: v.cast("string"),
)
decoded(
    "decode_decimal_binary_long", "orders", ORDER,
    c.decimal_binary(18, 12),
    "cast(o_orderkey as decimal(31,12)) / 100000 + 0.000000000001",
    "(o_orderkey::DECIMAL(18,12) / 100000 + 0.000000000001::DECIMAL(18,12))::DECIMAL(18,12)::VARCHAR",
    shown=lambda v: v.cast("string"),
)
add(
    "decode_json_text", "events",
    lambda df: json_rows(df).select("event_id", c.json_text.decode(c.json_text.enc(F.col("j"))).alias("value")),
    """SELECT event_id, '{"a":' || event_id || ',"b":"' || event_type || '"}' AS value FROM events""",
)
decoded(
    "decode_bound", "orders", ORDER,
    c.bound(c.i64),
    "named_struct('kind', cast(o_orderkey % 3 as tinyint), 'value', o_custkey)",
    "(o_orderkey % 3) || CASE WHEN o_orderkey % 3 > 0 THEN ' ' || o_custkey ELSE '' END",
    shown=lambda v: F.concat_ws(" ", v["kind"].cast("string"), v["value"].cast("string")),
)
decoded(
    "decode_range", "orders", ORDER,
    c.range_of(c.i64),
    "named_struct('start', o_custkey, 'end', o_custkey + o_orderkey)",
    "o_custkey || ' ' || (o_custkey + o_orderkey)",
    shown=lambda v: F.concat_ws(" ", v["start"].cast("string"), v["end"].cast("string")),
)
decoded(
    "decode_tuple2", "lineitem", LINE,
    pair,
    "named_struct('_0', l_orderkey, '_1', l_returnflag)",
    "l_orderkey || ' ' || l_returnflag",
    shown=lambda v: F.concat_ws(" ", v["_0"].cast("string"), v["_1"]),
)
decoded("decode_tuple1", "orders", ORDER, c.tuple_of(c.i64), "named_struct('_0', o_custkey)", "o_custkey", shown=lambda v: v["_0"])
decoded("decode_nonempty", "part", PART, c.nonempty(c.string), words, "p_name", shown=lambda v: F.array_join(v, " "))
decoded(
    "decode_array_f32", "embeddings", ["vec_id"],
    c.sequence(c.f32),
    "embedding",
    f"md5({sql.joined('embedding', sql.f32('x'))})",
    shown=lambda v: F.md5(F.hex(c.joined(v, c.f32.enc))),
)
decoded(
    "decode_empty_arrays", "part", PART,
    c.sequence(c.bit_array),
    "array(cast(array() as array<boolean>), array(p_size > 25))",
    "CASE WHEN p_size > 25 THEN '0 8 true' ELSE '0 8 false' END",
    shown=lambda v: F.concat_ws(" ", F.size(v[0]).cast("string"), F.size(v[1]).cast("string"), v[1][0].cast("string")),
)
decoded("decode_units", "part", PART, c.sequence(c.unit), "array_repeat(cast(null as string), p_size)", "p_size", shown=F.size)

# newer writers: bytes with steps that the reader has never heard of
LATER = Record((*CUSTOMERS.fields, Field("c_mktsegment", c.string), Field("c_acctbal", c.f64)), (Added("c_mktsegment"), Removed("gone"), MadeOptional("c_nationkey"), Added("c_acctbal")))


def from_later(df: DataFrame) -> DataFrame:
    nation = F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey"))
    value = F.struct("c_custkey", "c_name", nation.alias("c_nationkey"), "c_mktsegment", "c_acctbal")
    rows = decode_record(df.select("c_custkey", LATER.enc(value).alias("b")), "b", CUSTOMERS, 0)
    return rows.select("c_custkey", "decoded.c_name", "decoded.c_nationkey", F.col("decoded._error").alias("error"))


even_only = lambda x: f"CASE WHEN c_custkey % 2 = 0 THEN {x} END"
add(
    "evolve_unknown_writer", "customer",
    from_later,
    f"SELECT c_custkey, {even_only('c_name')} AS c_name, {even_only('c_nationkey')} AS c_nationkey, CASE WHEN c_custkey % 2 = 1 THEN '{w.NONE_FOUND}' END AS error FROM customer",
)
OUTER = Record((Field("id", c.i64), Field("rows", c.sequence(PRODUCT.codec())), Field("last", c.option(PRODUCT.at(1).codec()))), (Added("last"),))


def nested_records(df: DataFrame) -> DataFrame:
    """Records with a history in an array and an option of a record with one."""
    newest = F.struct(F.col("c_name").alias("field_a"), F.expr(even).alias("new_field_1"), F.col("c_nationkey").alias("field_b"))
    value = F.struct(F.col("c_custkey").alias("id"), F.array(newest, newest).alias("rows"), F.when(F.expr(even), newest).alias("last"))
    rows = decode_record(df.select("c_custkey", OUTER.enc(value).alias("b")), "b", OUTER, 1)
    shown = F.array_join(F.transform("decoded.rows", lambda r: F.concat_ws(" ", r["field_a"], r["new_field_1"].cast("string"))), ",")
    return rows.select("c_custkey", shown.alias("rows"), "decoded.last.field_b", "decoded.last.field_a", F.col("decoded._error").alias("error"))


unset = f"'unset ' || ({even})::VARCHAR"
add(
    "evolve_nested", "customer",
    nested_records,
    f"SELECT c_custkey, {unset} || ',' || {unset} AS rows, CASE WHEN {even} THEN c_nationkey END AS field_b, CASE WHEN {even} THEN c_name END AS field_a, NULL::VARCHAR AS error FROM customer",
)
add(
    "evolve_nested_older_reader", "customer",
    lambda df: decode_record(nested_bytes(df), "b", OUTER, 0).select("c_custkey", F.size("decoded.rows").alias("n"), F.col("decoded._error").alias("error")),
    "SELECT c_custkey, 2 AS n, NULL::VARCHAR AS error FROM customer",
)


def nested_bytes(df: DataFrame) -> DataFrame:
    row = F.struct(F.col("c_name").alias("field_a"), F.expr(even).alias("new_field_1"), F.col("c_nationkey").alias("field_b"))
    return df.select("c_custkey", OUTER.enc(F.struct(F.col("c_custkey").alias("id"), F.array(row, row).alias("rows"), row.alias("last"))).alias("b"))


def guarded(df: DataFrame) -> DataFrame:
    """Events through a union in which 'error' is transient: writing it fails, so those rows are told apart before."""
    union = Union((*EVENTS.cases[:4], Case("error", c.string, transient=True)))
    fine = F.col("event_type") != "error"
    written = F.when(fine, union.enc(event_value()))
    refused = F.when(~fine, F.lit(w.TRANSIENT_CASE))
    return df.select("event_id", F.hex(written).alias("bytes"), refused.alias("error"))


add(
    "union_transient_refused", "events",
    guarded,
    f"SELECT event_id, CASE WHEN event_type <> 'error' THEN {union_hex(EVENTS.ids())} END AS bytes, CASE WHEN event_type = 'error' THEN '{w.TRANSIENT_CASE}' END AS error FROM events",
)

# values of recursive types
DYNAMIC, DYNAMIC_BYTES = values.dynamic_value(), values.dynamic_value(byte_lists=True)


def dynamic(df: DataFrame) -> Column:
    """A record of a text, a number, an option and a variant that holds a list."""
    case = lambda name, x: F.struct(x.alias(name))
    items = [F.to_json(case("String", F.col("event_type"))), F.to_json(case("S64", F.col("user_id")))]
    paid = F.when(F.col("event_type") == "purchase", F.to_json(case("Option", case("F64", F.col("value"))))).otherwise(F.lit('{"Option":null}'))
    listed = F.concat(F.lit('{"Variant":{"case_idx":3,"case_value":{"List":['), F.to_json(case("U8", F.col("event_id") % 256)), F.lit(',{"Bool":true}]}}}'))
    return F.concat(F.lit('{"Record":['), F.concat_ws(",", *items, paid, listed), F.lit("]}"))


variant = f"'0010' || '00' || '00000003' || '01' || '000D' || '04' || '0001' || {sql.be('event_id % 256', 1)} || '0000' || '01'"
dynamic_hex = f"'000F' || '08' || '000C' || {sql.string('event_type')} || '0008' || {sql.be('user_id', 8)} || CASE WHEN event_type = 'purchase' THEN '0013' || '01' || '000A' || {sql.f64('value')} ELSE '001300' END || {variant}"
add(
    "encode_dynamic_value", "events",
    lambda df: df.select("event_id", F.hex(DYNAMIC.enc(dynamic(df))).alias("bytes")),
    f"SELECT event_id, {dynamic_hex} AS bytes FROM events",
)
add(
    "dynamic_value_roundtrip", "events",
    lambda df: df.select("event_id", (F.parse_json(DYNAMIC.decode(DYNAMIC.enc(dynamic(df)))).cast("string") == F.parse_json(dynamic(df)).cast("string")).alias("same")),
    "SELECT event_id, true AS same FROM events",
)
byte_list = lambda: F.concat(F.lit('{"List":['), F.array_join(F.transform(F.sequence(F.lit(0), F.col("p_size")), lambda k: F.concat(F.lit('{"U8":'), k.cast("string"), F.lit("}"))), ","), F.when(F.col("p_size") % 2 == 0, ',{"Bool":false}').otherwise(""), F.lit("]}"))
hexes = "range(0, p_size + 1)"
add(
    "encode_byte_list", "part",
    lambda df: df.select("p_partkey", F.hex(DYNAMIC_BYTES.enc(byte_list())).alias("bytes")),
    f"SELECT p_partkey, '000D' || CASE WHEN p_size % 2 = 1 THEN '01' || {sql.var_u32('p_size + 1')} || {sql.joined(hexes, sql.be('x', 1))} ELSE '00' || {sql.var_u32('2 * (p_size + 2)')} || {sql.joined(hexes, chr(39) + '0001' + chr(39) + ' || ' + sql.be('x', 1))} || '000000' END AS bytes FROM part",
)
add(
    "byte_list_roundtrip", "part",
    lambda df: df.select("p_partkey", (DYNAMIC_BYTES.decode(DYNAMIC_BYTES.enc(byte_list())) == byte_list()).alias("same")),
    "SELECT p_partkey, true AS same FROM part",
)


def error_text() -> Column:
    """An error with as many causes as the key modulo three, each with one place."""
    place = lambda: F.struct(F.col("o_orderpriority").alias("class"), F.lit(None).cast("string").alias("method"), F.lit("orders.rs").alias("file"), F.col("o_custkey").alias("line"))
    none = F.lit('"cause":null')
    one = lambda depth, cause: F.concat(F.lit(f'{{"class_name":"E{depth}","message":'), F.to_json(F.struct(F.col("o_orderstatus").alias("m"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col("o_orderstatus").alias("m")))) - 6), F.lit(',"stack_trace":['), F.to_json(place(), {"ignoreNullFields": "false"}), F.lit("],"), cause, F.lit("}"))
    causes = [none]
    for depth in (2, 1):
        inner = F.concat(F.lit('"cause":'), one(depth, causes[0]))
        causes.insert(0, F.when(F.col("o_orderkey") % 3 >= depth, inner).otherwise(none))
    return one(0, causes[0])


place_hex = f"'00' || '01' || {sql.string('o_orderpriority')} || '00' || '01' || {sql.string(chr(39) + 'orders.rs' + chr(39))} || {sql.var_u32('o_custkey')}"
level_hex = lambda depth, cause: f"'00' || {sql.string(chr(39) + f'E{depth}' + chr(39))} || {sql.string('o_orderstatus')} || '02' || {place_hex} || {cause}"
second = f"CASE WHEN o_orderkey % 3 >= 2 THEN '01' || {level_hex(2, chr(39) + '00' + chr(39))} ELSE '00' END"
first_cause = f"CASE WHEN o_orderkey % 3 >= 1 THEN '01' || {level_hex(1, second)} ELSE '00' END"
add(
    "encode_exception", "orders",
    lambda df: df.select("o_orderkey", F.hex(values.EXCEPTION.enc(error_text())).alias("bytes")),
    f"SELECT o_orderkey, {level_hex(0, first_cause)} AS bytes FROM orders",
)
add(
    "exception_roundtrip", "orders",
    lambda df: df.select("o_orderkey", (F.parse_json(values.EXCEPTION.decode(values.EXCEPTION.enc(error_text()))).cast("string") == F.parse_json(error_text()).cast("string")).alias("same")),
    "SELECT o_orderkey, true AS same FROM orders",
)
twice = lambda: F.to_json(F.array("event_type", F.lit("x"), "event_type", F.lit("x"), "props"))
add(
    "dedup_in_value", "events",
    lambda df: df.select("event_id", F.hex(values.WORDS.enc(twice())).alias("bytes")),
    f"SELECT event_id, '0A' || {sql.string('event_type')} || '0278' || '01' || '03' || {sql.string('props')} AS bytes FROM events",
)
add(
    "dedup_in_value_roundtrip", "events",
    lambda df: df.select("event_id", (values.WORDS.decode(values.WORDS.enc(twice())) == twice()).alias("same")),
    "SELECT event_id, true AS same FROM events",
)


def ring() -> Column:
    """Three nodes: a cycle where the key is odd, else a list."""
    node = lambda x: F.to_json(F.struct(x.alias("label")))
    of = lambda x, following: F.concat(F.regexp_replace(node(x), "[}]$", ""), F.lit(',"next":'), following, F.lit("}"))
    back = F.when(F.col("event_id") % 2 == 1, "0").otherwise("null")
    return F.concat(F.lit('{"value":0,"objects":['), F.concat_ws(",", of(F.col("event_type"), F.lit("1")), of(F.lit("b"), F.lit("2")), of(F.col("user_id").cast("string"), back)), F.lit("]}"))


add(
    "encode_ref_cycle", "events",
    lambda df: df.select("event_id", F.hex(values.NODES.enc(ring())).alias("bytes")),
    f"SELECT event_id, '00' || {sql.string('event_type')} || '0100' || '0262' || '0100' || {sql.string('user_id::VARCHAR')} || CASE WHEN event_id % 2 = 1 THEN '0101' ELSE '00' END AS bytes FROM events",
)
add(
    "ref_cycle_roundtrip", "events",
    lambda df: df.select("event_id", (F.parse_json(values.NODES.decode(values.NODES.enc(ring()))).cast("string") == F.parse_json(ring()).cast("string")).alias("same")),
    "SELECT event_id, true AS same FROM events",
)


def wide_text() -> Column:
    """A part as the JSON of a record with fields of many kinds."""
    x = F.col
    no_places = F.array().cast("array<struct<class:string,method:string,file:string,line:int>>")
    failure = F.struct(x("p_brand").alias("class_name"), x("p_type").alias("message"), no_places.alias("stack_trace"), F.lit(None).cast("string").alias("cause"))
    element = lambda name: F.struct(x(name).alias("id"))
    identity = F.expr("regexp_replace(md5(cast(p_partkey as string)), '(.{8})(.{4})(.{4})(.{4})(.{12})', '$1-$2-$3-$4-$5')")
    either = F.when(x("p_size") % 2 == 0, F.struct(F.lit(True).alias("ok"), F.lit(None).cast("string").alias("err"))).otherwise(F.struct(F.lit(None).cast("boolean").alias("ok"), x("p_name").alias("err")))
    first = F.struct(F.struct(F.struct(element("p_name").alias("elem")).alias("First")).alias("ok"))
    second = F.struct(F.struct(identity.alias("uuid"), x("p_type").alias("desc")).alias("Second"))
    fields = {
        "byte": x("p_size") - 25, "short": x("p_size") * 100, "int": x("p_partkey"), "long": x("p_partkey") * 1_000_000_000, "float": x("p_size") / 2, "double": x("p_retailprice"),
        "boolean": x("p_size") % 2 == 0, "string": x("p_name"), "uuid": identity, "exception": failure, "list": F.array(element("p_brand"), element("p_name")),
        "array": F.array(x("p_partkey"), x("p_size").cast("bigint")), "vector": F.array(element("p_type")), "set": F.array("p_brand", "p_brand"),
        "either": either, "tried": first, "option": F.when(x("p_size") % 3 > 0, F.create_map(x("p_brand"), second)),
    }
    return F.to_json(F.struct(*[value.alias(name) for name, value in fields.items()]))


of_part = lambda name: sql.string(name)
element_hex = lambda name: f"'00' || {of_part(name)}"
identity_hex = "upper(md5(p_partkey::VARCHAR))"
failure_hex = f"'00' || {of_part('p_brand')} || {of_part('p_type')} || '00' || '00'"
cached_hex = "0C" + b"cached".hex().upper()
second_size = f"(17 + {sql.size_of_string('p_type')})"
second_hex = f"'0001' || '01' || {sql.var_u32(f'2 * {second_size}')} || '03{cached_hex}' || {identity_hex} || '01' || {of_part('p_type')}"
first_chunk = " || ".join((
    sql.be("p_size - 25", 1), sql.be("p_size * 100", 2), sql.be("p_partkey", 4), sql.be("p_partkey * 1000000000", 8), sql.f32("p_size / 2.0"), sql.f64("p_retailprice"),
    "CASE WHEN p_size % 2 = 0 THEN '01' ELSE '00' END", identity_hex, failure_hex, "'04'", element_hex("p_brand"), element_hex("p_name"),
    "'04'", sql.be("p_partkey", 8), sql.be("p_size", 8), "'02'", element_hex("p_type"), f"CASE WHEN p_size % 2 = 0 THEN '0101' ELSE '00' || {of_part('p_name')} END",
    f"'01' || '0000' || '00' || {element_hex('p_name')}", f"CASE WHEN p_size % 3 > 0 THEN '01' || '02' || '00' || {of_part('p_brand')} || {second_hex} ELSE '00' END",
))
add(
    "encode_wide_record", "part",
    lambda df: df.select("p_partkey", F.hex(values.WIDE.enc(wide_text())).alias("bytes")),
    f"SELECT p_partkey, '03' || {sql.var_u32('length(c)')} || '01F1' || {sql.var_u32(f'2 * {sql.size_of_string("p_name")}')} || {sql.var_u32('2 * (1 + ' + sql.size_of_string('p_brand') + ')')} || c || {of_part('p_name')} || '02' || {of_part('p_brand')} AS bytes FROM (SELECT *, {first_chunk} AS c FROM part)",
)
add(
    "wide_record_roundtrip", "part",
    lambda df: df.select("p_partkey", values.WIDE.decode(values.WIDE.enc(wide_text())).alias("j")).select("p_partkey", F.get_json_object("j", "$.string").alias("string"), F.get_json_object("j", "$.double").cast("double").alias("price")),
    "SELECT p_partkey, p_name AS string, p_retailprice AS price FROM part",
)
QUERIES["generate_typed_values"] = lambda spark, sf_dir: generators.typed_values(spark).select("name", F.octet_length(DYNAMIC_BYTES.enc(F.col("value"))).alias("size"))
ORACLE["generate_typed_values"] = "SELECT * FROM (VALUES ('simple', 6), ('medium', 61), ('complex', 172), ('list', 6005), ('binary', 65542)) AS t(name, size)"

# generated data and recursive values
QUERIES["generate_log_batch"] = lambda spark, sf_dir: generators.log_batch(spark, 1000, 600).select("idx", "kind", "ts_ms", "token", F.md5(F.hex("payload")).alias("digest"))
kinds = ", ".join(f"'{k}'" for k in generators.KINDS)
counted = "array_to_string(list_transform(range(600), lambda i: lpad(hex((id + i % 251) % 256), 2, '0')), '')"
ORACLE["generate_log_batch"] = f"SELECT id AS idx, ([{kinds}])[id % 8 + 1] AS kind, 1700000000000 + 37 * id AS ts_ms, '00000000-0000-0000-0000-' || lpad(lower(hex(id)), 12, '0') AS token, md5({counted}) AS digest FROM (SELECT unnest(range(1000)) AS id)"
for size in (16, 256, 1024, 16384):
    QUERIES[f"generate_log_batch_{size}"] = lambda spark, sf_dir, n=size: generators.log_batch(spark, 500, n).select("idx", "kind", "ts_ms", "token", F.md5(F.hex("payload")).alias("digest"))
    ORACLE[f"generate_log_batch_{size}"] = ORACLE["generate_log_batch"].replace("range(600)", f"range({size})").replace("range(1000)", "range(500)")
QUERIES["generate_event_log"] = lambda spark, sf_dir: generators.event_log(spark, 10_000).select("idx", "kind", "ts_ms", "function_type", "key", "convention", F.octet_length("payload").alias("size"))
QUERIES["generate_tagged_payloads"] = lambda spark, sf_dir: generators.tagged_payloads(spark, 100).select("id", F.size("tags").alias("n_tags"), F.octet_length("payload").alias("size"))
ORACLE["generate_tagged_payloads"] = "SELECT unnest(range(100)) AS id, 32 AS n_tags, 65536 AS size"
QUERIES["generate_trees"] = lambda spark, sf_dir: generators.complete_trees(spark)
nodes = "(SELECT unnest(range(16 * 127)) AS id)"
ORACLE["generate_trees"] = f'SELECT id // 127 AS tree, id % 127 + 1 AS node, CASE WHEN id % 127 < 63 THEN 2 * (id % 127 + 1) END AS "left", CASE WHEN id % 127 < 63 THEN 2 * (id % 127 + 1) + 1 END AS "right" FROM {nodes}'
QUERIES["encode_tree"] = lambda spark, sf_dir: trees.encode_trees(generators.complete_trees(spark, 16, 2), 2).select("tree", F.hex("b").alias("bytes"))
leaf = lambda n: f"00{n:016X}0000"
inner = lambda n: f"00{n:016X}01{leaf(2 * n)}01{leaf(2 * n + 1)}"
ORACLE["encode_tree"] = f"SELECT unnest(range(16)) AS tree, '00{1:016X}01{inner(2)}01{inner(3)}' AS bytes"


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
