"""Registered queries: coverage of the inventory and agreement with their SQL."""

import os
import re
import sys

import pytest

from tests.conftest import SF_DIR

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

# queries without SQL: a trained model, a block cipher, and the union of parts checked one by one
NO_SQL = {"d4_dga_trained", "e1_run_detectors", "e10_anonymize"}
COUNTS = {"s": 19, "p": 30, "w": 44, "j": 15, "a": 22, "t": 8, "v": 5, "d": 20, "u": 6, "f": 3, "e": 10, "r": 8}


def test_every_operator_has_a_query():
    from brookwatch.catalog import ORACLES, QUERIES
    found = {(m[1], int(m[2])) for q in QUERIES if (m := re.match(r"([a-z])(\d+)_", q))}
    missing = [f"{g}{i}" for g, n in COUNTS.items() for i in range(1, n + 1) if (g, i) not in found]
    assert not missing
    assert set(QUERIES) - set(ORACLES) == NO_SQL and set(ORACLES) <= set(QUERIES)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    from check_oracle import TABLES
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_DIR}/{t}.parquet')")
    return con


SAMPLE = ["p15_format_extended", "w28_mpls", "w38_schedule", "a5_bidirectional", "a8_ip", "t7_port_dst", "t8_daily_average", "v5_sliding_restart",
          "j7_cidr_join", "j8_objects_by_address", "j12_best_rule", "d1_port_scan", "d5_dns_tunnel", "d7_icmp_tunnel", "d13_asset_features",
          "d17_object_thresholds", "e6_topn_cache", "e9_retention_by_size", "s7_write_pipe", "s11_event_table", "r2_slot_detector", "r4_sessions",
          "r4_sessions_closed", "r7_stream_pairs", "r8_stream_late_flows"]


@pytest.mark.parametrize("name", SAMPLE)
def test_spark_equals_sql(spark, duck, name):
    from brookwatch.catalog import ORACLES, QUERIES
    from check_oracle import rows_of
    df = QUERIES[name](spark, SF_DIR)
    cur = duck.execute(ORACLES[name])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, cur.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry
    rows = entry.entry(spark).collect()
    assert len(rows) == 10 and rows == sorted(rows, key=lambda r: (-r.bytes, r.value))
