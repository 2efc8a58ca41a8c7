"""Streams give the rows of the batch operators."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from brookwatch import fixtures
from brookwatch.catalog import QUERIES
from brookwatch.catalog.registry import folder
from brookwatch.operators import merges
from brookwatch.operators.aggregate import port_table
from brookwatch.detectors.base import counters
from brookwatch.detectors.scans import closing_port_scans, port_scan_events
from brookwatch.rules import Rule, Window
from brookwatch.session import shared_dir
from brookwatch.streaming import flowstreams as st

from .conftest import SF_DIR

T0 = 1704067200
KEY = ["srcaddr", "dstaddr", "prot"]
SENTINEL = dict(first=T0 + 5 * 86400, last=T0 + 5 * 86400, srcaddr=1, dstaddr=2, prot=6, tos=1,
                srcport=1, dstport=1)


@pytest.fixture(scope="module")
def slots(spark, flows):
    """Flow files of six parts of a morning, oldest first, then a closing flow."""
    path = folder(spark)
    f = flows.where(F.col("first") < T0 + 6 * 3600).cache()
    for i in range(6):
        f.where((F.col("first") >= T0 + i * 3600) & (F.col("first") < T0 + (i + 1) * 3600)).coalesce(1).write.mode("append").parquet(path)
    last = f.limit(1).withColumns({k: F.lit(v).cast(f.schema[k].dataType) for k, v in SENTINEL.items()})
    last.coalesce(1).write.mode("append").parquet(path)
    return path, f


def stream(spark, slots):
    path, f = slots
    return st.read_flow_stream(spark, path, f.schema, files_per_batch=1)


def rows(df, cols):
    return sorted(tuple(r) for r in df.where("srcaddr <> 1" if "srcaddr" in df.columns else "true").select(*cols).collect())


def test_slot_and_hour_counters(spark, slots):
    f = slots[1]
    cols = ["time", "srcaddr", "prot", "first", "last", "flows", "pkts", "bytes"]
    got = st.run_available(st.slot_counters(st.event_time(stream(spark, slots)), ["srcaddr", "prot"]), ["time", "srcaddr", "prot"])
    want = f.groupBy((F.col("first") - F.col("first") % 300).alias("time"), "srcaddr", "prot").agg(*counters())
    assert rows(got, cols) == rows(want, cols)
    closed = st.run_available(st.hourly_features(st.event_time(stream(spark, slots)), ["srcaddr", "prot"]), mode="append")
    want = f.groupBy((F.col("first") - F.col("first") % 3600).alias("hour"), "srcaddr", "prot").agg(*counters())
    cols[0] = "hour"
    assert rows(closed, cols) == rows(want, cols)


def test_sessions_equal_gap_merge(spark, slots):
    f = slots[1]
    got = st.run_available(st.sessions(st.event_time(stream(spark, slots)), KEY), mode="append")
    want = merges.merge_gaps(f.groupBy(*KEY, "first", "last").agg(F.count("*").alias("flows"), F.sum("pkts").alias("pkts"),
                                                                  F.sum("bytes").alias("bytes")), KEY)
    cols = [*KEY, "first", "last", "flows", "pkts", "bytes"]
    assert rows(got, cols) == rows(want, cols)


def test_sliding_ports_equal_batch(spark, slots):
    f = slots[1]
    got = st.run_available(st.sliding_ports(st.event_time(stream(spark, slots)), "1 hour"), mode="append")
    want = merges.sliding_port_stats(port_table(f), width=3600, clear_after=10**9)
    cols = ["slot", "prot", "dstport", "flows", "pkts", "bytes"]
    # the batch form gives a row only for slots the port was seen in
    seen = want.select("slot", "prot", "dstport")
    got = got.where("dstport <> 1")
    assert rows(got.join(seen, ["slot", "prot", "dstport"], "left_semi"), cols) == rows(want, cols)


def test_pairs_equal_batch(spark, slots):
    f = slots[1]

    def turned(x):
        return x.withColumns({"first": F.col("first") + 300 * (F.col("bytes") % 3), "srcaddr": F.col("dstaddr"), "dstaddr": F.col("srcaddr"),
                              "srcport": F.col("dstport"), "dstport": F.col("srcport"), "tos": 1 - F.col("tos")})
    got = st.run_available(st.pair_slots(stream(spark, slots), turned(stream(spark, slots))), mode="append")
    want = st.pair_slots(f, turned(f))
    # an unanswered request comes out once its time bound has passed
    got = got.where("sport <> 1")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert want.where("res_slot is null").count() > 0


def test_event_dedup(spark):
    path = folder(spark)
    events = spark.createDataFrame([(T0, "a"), (T0, "b")], "time bigint, obj string")
    for _ in range(3):
        events.coalesce(1).write.mode("append").parquet(path)
    s = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = st.run_available(st.dedup_events(s, events.columns), mode="append")
    assert sorted(map(tuple, got.collect())) == [(T0, "a"), (T0, "b")]
    assert st.dedup_events(events.union(events), events.columns).count() == 2


def test_late_slot_is_dropped_and_counted(spark, slots):
    path, f = slots[0] + "-late", slots[1]
    early = f.where(F.col("first") < T0 + 3600)
    # the watermark that drops late rows is the one known a batch before
    f.where(F.col("first") >= T0 + 3 * 3600).coalesce(1).write.mode("append").parquet(path)
    f.where(F.col("first") >= T0 + 4 * 3600).coalesce(1).write.mode("append").parquet(path)
    early.coalesce(1).write.mode("append").parquet(path)
    s = st.read_flow_stream(spark, path, f.schema, files_per_batch=1)
    got = st.run_available(st.slot_counters(st.event_time(s), ["prot"]), ["time", "prot"])
    assert got.where(F.col("time") < T0 + 3600).count() == 0
    on_time, late = st.split_late(f, F.lit(T0 + 4 * 3600))
    assert late.count() == f.where(F.col("first") - F.col("first") % 300 + 900 < T0 + 4 * 3600).count()
    assert on_time.count() + late.count() == f.count()


def _scan_files(spark, make_flows, parts):
    """A stream folder and the steps that write one file each."""
    path = folder(spark)
    frames = [make_flows(*part) for part in parts]
    frames[0].limit(0).write.parquet(path)
    steps = [lambda f=f: f.coalesce(1).write.mode("append").parquet(path) for f in frames]
    return st.read_flow_stream(spark, path, frames[0].schema), steps


def test_a_scan_spread_over_batches_is_found_once(spark, make_flows):
    """Two peers in each of two batches of one slot; one comes too late, a later flow closes the slot."""
    def probe(peer, first):
        return dict(srcaddr=7, dstaddr=peer, dstport=22, first=first, last=first)
    stream, steps = _scan_files(spark, make_flows, [
        [probe(1, T0 + 10), probe(2, T0 + 20)], [probe(2, T0 + 250), probe(3, T0 + 260)], [probe(4, T0 + 3000)],
        [probe(5, T0 + 30)], [probe(6, T0 + 9000)]])
    rules = [Rule(1, 2, min=3)]
    got, dropped = st.run_deliveries(closing_port_scans(st.event_time(stream)), steps,
                                     lambda scans: port_scan_events(scans, rules, Window(T0, T0 + 86400, step=300)))
    assert [(r.time, r.alarm_value) for r in got.collect()] == [(T0, 3)]
    assert dropped == 1


def test_late_flows_are_set_aside_by_delivery(spark, make_flows):
    stream, steps = _scan_files(spark, make_flows, [
        [dict(first=T0 + 3000)], [dict(first=T0 + 10), dict(first=T0 + 2399), dict(first=T0 + 2101)], [dict(first=T0 + 2400)]])
    got = {(r["first"] - T0, r.late) for r in st.split_arrivals(stream, steps).collect()}
    assert got == {(3000, False), (10, True), (2399, True), (2101, True), (2400, False)}


def test_arrivals_go_on_from_an_earlier_call_and_keep_what_is_asked(spark, make_flows):
    stream, steps = _scan_files(spark, make_flows, [
        [dict(first=T0 + 3000)], [dict(first=T0 + 10), dict(first=T0 + 2399), dict(first=T0 + 2101)], [dict(first=T0 + 2400)]])
    base = folder(spark)
    for step in steps:
        st.split_arrivals(stream, [step], handle=lambda rows: rows.where("late"), base=base)
    got = {(r["first"] - T0, r.late, r.dstport) for r in st.split_arrivals(stream, [], base=base).collect()}
    assert got == {(10, True, 80), (2399, True, 80), (2101, True, 80)}


@pytest.mark.parametrize("streamed", [False, True])
def test_repeats_are_alike_in_all_columns(spark, streamed):
    rows = [(T0, 1, "a", "bc", ["x, y"]), (T0, 1, "ab", "c", ["x, y"]), (T0, 1, "ab", "c", ["x", "y"]), (T0, 1, None, "", None),
            (T0, 1, "", None, None), (T0, 1, "-", "", None), (T0, None, "", "", []), (T0 + 1, 1, "a", "bc", ["x, y"])]
    flows = spark.createDataFrame([*rows, *rows[:5]], "first bigint, port int, a string, b string, l array<string>")
    path = folder(spark)
    flows.coalesce(1).write.parquet(path)
    timed = st.event_time(st.read_flow_stream(spark, path, flows.schema) if streamed else flows)
    want = timed.dropDuplicates(timed.columns).select("first", "port")
    got = st.drop_repeats(timed, ["first", "port"])
    if streamed:
        got, want = (st.run_available(x, mode="append") for x in (got, want))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == len(rows)


def test_late_flows_write_no_second_copy(spark):
    """Flows delivered once; of those on time only what is counted is written, the late ones are set aside whole."""
    before = set(Path(shared_dir(spark)).iterdir())
    late = sum(r.flows for r in QUERIES["r8_stream_late_flows"](spark, SF_DIR).collect() if r.late)
    made = set(Path(shared_dir(spark)).iterdir()) - before
    whole = [d for d in made if not (d / "rows").exists()]
    assert len(whole) == 1 and len(made) == 3
    for d in made - set(whole):
        rows = spark.read.parquet(str(d / "rows"))
        if "late" in rows.columns:
            assert {str(r.late).lower() for r in rows.collect()} == {"true"} and rows.count() == late > 0
            assert set(spark.read.parquet(str(whole[0])).columns) < set(rows.columns)
        else:
            assert rows.drop("batch").columns == ["first"]


def test_shared_folder(spark):
    assert shared_dir(spark) == shared_dir(spark)


def test_fixture_streams(spark):
    assert fixtures.flows(spark, "/root/testdata/sf0.001").count() == spark.read.parquet(
        "/root/testdata/sf0.001/lineitem.parquet").count()
