"""Queries against their SQL on events of more users than two octets hold."""

import os

import pytest

SF = "/root/testdata/sf0.001"
FLOWS = ["canonical_flow_stats", "captures_in_parts", "classification_totals", "classified_packets", "classified_packets_classic", "classified_packets_lite", "explain_verdicts", "fingerprint_flows", "flow_sessions_idle", "flow_stats", "forward_drop", "label_flows", "link_fields", "packet_fields"]


def _rows(df):
    df = df[sorted(df.columns)]
    return sorted(map(repr, df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)))


@pytest.fixture(scope="module")
def many_users(tmp_path_factory):
    """A few events of users with the same address and port, if octets beyond 255 were cut to two digits."""
    import duckdb

    if not os.path.isdir(SF):
        pytest.skip("no tables")
    con, path = duckdb.connect(), tmp_path_factory.mktemp("users")
    # 65,536 + 256 * 10 + x would be 4,096 + x, whose port is the same
    con.sql(f"create table events as select event_id + i * 1000 as event_id, ts, u + user_id % 40 as user_id, event_type, value, '{{\"k\": ' || event_id % 7 || '}}' as props from '{SF}/events.parquet', (values (0, 0), (1, 4096), (2, 68096), (3, 899000)) t(i, u) where event_id < 300")
    con.sql(f"copy events to '{path}/events.parquet'")
    return con, f"file://{path}"


@pytest.mark.parametrize("name", FLOWS)
def test_users_beyond_two_octets(spark, many_users, name):
    from flowlens.plans import catalog

    con, path = many_users
    got, want = catalog.QUERIES[name](spark, path).toPandas(), con.sql(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and _rows(got) == _rows(want)
