"""Registered queries against their SQL on the smallest tables, and the driver's entry points."""

import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
CHECKED = ["decode_transport_counts", "packet_fields", "app_packets", "sticky_block", "classified_packets_lite", "classified_packets_classic", "canonical_flow_stats", "direction_pairs", "flow_sessions_idle", "rate_per_window", "block_reason", "host_signature_match", "signature_rule_hits", "fingerprint_rules", "flow_verdicts", "first_flight_contiguous", "first_flight_text", "first_flight_capped", "listed_addresses", "captures_in_parts", "malformed_frames", "frame_totals", "link_fields", "tcp_state_flows", "text_forms", "explain_verdicts", "prometheus_text"]


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"create view {name.split('.')[0]} as select * from '{SF}/{name}'")
    return con


def _rows(df):
    df = df[sorted(df.columns)]
    return sorted(map(repr, df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, duck, name):
    from flowlens.plans import catalog

    got, want = catalog.QUERIES[name](spark, SF).toPandas(), duck.sql(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and _rows(got) == _rows(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_queries_without_sql(spark):
    from flowlens.plans import catalog

    assert catalog.explain_trace(spark, SF).count() == 12
    assert catalog.sample_capture(spark, SF).filter("blocked").count() == 6
