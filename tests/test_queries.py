"""Registered queries against their SQL in DuckDB, at the smallest scale."""

import duckdb
import pytest

from quillpack.plans import queries as catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = "encode_i64 encode_u64 encode_f64 encode_var_i32 decode_string encode_map encode_set encode_tuple8 encode_record_v0 encode_record_v2_optional evolve_v3_to_v2_some decode_union union_case_counts dedup_encode dedup_decode ref_backrefs layout_segments hex_dump chunk_unpack encode_datetime_offset encode_decimal_binary json_binary_roundtrip compress_roundtrip encode_ipv6 decode_ip bigint_wide_roundtrip encode_bigint_wide encode_decimal_binary_wide decimal_wide_roundtrip generate_log_batch generate_tagged_payloads generate_trees encode_tree generate_typed_values encode_dynamic_value dynamic_value_roundtrip encode_byte_list encode_exception exception_roundtrip dedup_in_value encode_ref_cycle ref_cycle_roundtrip evolve_unknown_writer evolve_nested evolve_nested_older_reader union_transient_refused layout_rows layout_coverage payload_roundtrip decode_i128 decode_bitvec decode_datetime_zone decode_decimal_binary_long decode_empty_arrays decode_units encode_wide_record wide_record_roundtrip encode_json_by_option".split()


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(repr([None if x != x or x is None else float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) for x in r]) for r in frame.where(frame.notna(), None).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", SOME)
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert rows(catalogue.queries()[name](spark, SF).toPandas()) == rows(con.sql(catalogue.oracle_sql()[name]).df())


def test_every_query_is_callable_and_oracles_have_queries():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())
    assert len(catalogue.queries()) > 100
