"""Life cycle, sources, requests, anonymisation."""

import random

import pytest
from pyspark.sql import functions as F

from brookwatch.catalog.registry import folder
from brookwatch.functions.predicates import w_port, w_proto
from brookwatch.plans import job
from brookwatch.plans import lifecycle as lc
from brookwatch.plans import requests as rq
from brookwatch.plans.anonymize import anonymize, anonymous_addresses
from brookwatch.plans.run import KINDS, Config, all_events, read_switches, run_detectors
from brookwatch.rules import Pattern, Rule, Window, read_objects, read_pattern_rows, read_rules
from brookwatch.schema import EVENT_SCHEMA
from brookwatch.sources import exports, flowtable, lists, textflows

T0 = 1704067200
EVENTS = [(T0, 2, 1, 1, "a", 1, 2, "x", 0), (T0, 2, 1, 1, "b", 1, 2, "x", 0)]


def test_upsert_events(spark):
    def events(*rows):
        return spark.createDataFrame(list(rows), EVENT_SCHEMA)
    changed = (*EVENTS[0][:6], 3, *EVENTS[0][7:])
    new = events(EVENTS[0], changed, (T0 + 1, 2, 1, 1, None, 1, 2, None, 0), (T0 + 1, 2, 1, 1, None, 1, 2, None, 0))
    assert lc.upsert_events(events(*EVENTS), new, T0 + 86400).count() == 4
    assert lc.upsert_events(events(*EVENTS), new, T0 + 86401).count() == 1     # older than a day
    assert lc.upsert_events(events(*EVENTS), events(), T0).count() == 2


def delete_files(sizes, now, max_life, max_size, low_water):
    """Oldest files first: until the size fits, then until the age fits."""
    files = sorted(sizes)
    total = sum(b for _, b in files)
    size_done = not max_size or total < max_size
    life_done = not max_life or now - files[0][0] < max_life
    gone = []
    for slot, size in files:
        if not size_done:
            if total > low_water * max_size // 100:
                total -= size
                gone.append(slot)
                continue
            size_done = True
        if not life_done:
            if slot < now - max_life * low_water // 100:
                gone.append(slot)
                continue
            life_done = True
        if size_done and life_done:
            break
    return gone


@pytest.mark.parametrize("life,size,water", [(0, 3000, 90), (0, 10**9, 95), (40000, 0, 95), (40000, 2500, 50), (10**7, 1000, 0), (0, 0, 95)])
def test_retention_plan(spark, life, size, water):
    rnd = random.Random(size + life)
    sizes = [(T0 + 300 * i, rnd.randrange(1, 40)) for i in range(400)]
    df = spark.createDataFrame(sizes, "slot bigint, bytes bigint")
    now = T0 + 300 * 400
    got = sorted(r.slot for r in lc.retention_plan(df, now, life, size, water).collect())
    assert got == delete_files(sizes, now, life, size, water or 95)


# published sample key and address pairs of the prefix-preserving scheme
KEY = bytes([21, 34, 23, 141, 51, 164, 207, 128, 19, 10, 91, 22, 73, 144, 125, 16, 216, 152, 143, 131, 121, 121, 101, 39, 98,
             87, 76, 45, 42, 132, 34, 2])
PAIRS = {"128.11.68.132": "135.242.180.132", "129.118.74.4": "134.136.186.123", "130.132.252.244": "133.68.164.234",
         "141.223.7.43": "141.167.8.160", "141.233.145.108": "141.129.237.235", "152.163.225.39": "151.140.114.167"}


def test_anonymous_addresses_match_published_pairs(spark):
    from brookwatch.functions.address import ipv4_num, ipv4_str
    df = spark.createDataFrame([(a,) for a in PAIRS], "t string").select("t", ipv4_num("t").alias("a"))
    mapped = anonymous_addresses(df.select("a"), "a", KEY)
    got = {r.x: r.y for r in mapped.select(ipv4_str("a").alias("x"), ipv4_str("anon").alias("y")).collect()}
    assert got == PAIRS


def test_anonymize_keeps_prefixes(spark, wide):
    few = wide.limit(200).cache()
    out = anonymize(few, KEY)
    assert out.columns == few.columns and out.count() == 200
    assert out.agg(F.sum("srcas")).first()[0] == 0
    old = [r.srcaddr for r in few.select("srcaddr").distinct().collect()]
    new = {r._a: r.anon for r in anonymous_addresses(few.select(F.col("srcaddr").alias("_a")).distinct(), "_a", KEY).collect()}
    for a in old[:12]:
        for b in old[:12]:
            assert (a ^ b).bit_length() == (new[a] ^ new[b]).bit_length()
    six = spark.createDataFrame([("2001:db8::1",), ("2001:db8::2",)], "a string")
    x, y = (r.anon.split(":")[:7] for r in anonymous_addresses(six, "a", KEY).orderBy("a").collect())
    assert x == y


def test_pipe_round_trip_v6(spark, wide):
    f = wide.limit(20).withColumns({"srcaddr": F.lit("2001:db8::ff"), "dstaddr": F.lit("::1"), "http_url": F.lit("/a|b\nc")})
    back = textflows.parse_pipe(textflows.pipe_lines(f))
    r = back.first()
    assert (r.af, r.sip, r.dip, r.srcaddr, r.http_url) == (10, "2001:db8::ff", "::1", None, "/a b c")
    assert back.count() == 20
    assert textflows.parse_pipe(spark.createDataFrame([("1|2|3",)], "value string")).count() == 0


def test_flow_table_prunes(spark, flows):
    path = folder(spark)
    flowtable.write_flows(flows, path, files_per_day=4)
    part = flowtable.read_flows(spark, path, devid=1, start=T0 + 3600, end=T0 + 7200)
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(devid" in plan and "PushedFilters: [IsNotNull(slot), GreaterThanOrEqual(slot" in plan
    assert part.count() == flows.where(f"first - first % 300 between {T0 + 3600} and {T0 + 7200}").count()
    assert flowtable.clamp_range(flowtable.with_partitions(flows), 0, 10) is None


def test_profile_channels(spark, wide):
    chans = {"all": ([], F.lit(True)), "none": (["nowhere"], F.lit(True)), "web": ([], w_port(80) & w_proto("tcp"))}
    got = {r.channel: r["count"] for r in flowtable.profile_split(wide, chans).groupBy("channel").count().collect()}
    assert got == {"all": wide.count(), "web": wide.where(w_port(80)).count()}


def test_lists_and_patterns(spark, tmp_path):
    (tmp_path / "ips").write_text("# head\n\n 10.0.0.1 \n10.0.0.2, spam, more\nnot-an-ip\n")
    assert sorted(map(tuple, lists.read_ip_list(spark, str(tmp_path / "ips")).collect())) == [
        (167772161, ""), (167772162, "spam, more")]
    (tmp_path / "intel").write_text('k1,src,btc\nk2,"a, \\"b\\"",eth\n#x,y,z\n')
    assert sorted(map(tuple, lists.read_intel(spark, str(tmp_path / "intel")).collect())) == [
        ("k1", "src", "btc"), ("k2", 'a, "b"', "eth")]
    rows = ["PORT_SCAN,,,,80,TCP,100,200,,,", "PORT_SCAN,,,,,,100,,,,", "SRV,,,,ssh,,,5,,,", "# no", ""]
    (tmp_path / "pats").write_text("\n".join(rows))
    pats = read_pattern_rows(lists.read_patterns(spark, str(tmp_path / "pats")))
    assert sorted(pats, key=str) == sorted([Pattern("PORT_SCAN", dport="80", protocol="TCP", peers=100, flows=200), Pattern("PORT_SCAN", peers=100),
                                            Pattern("SRV", dport="ssh", flows=5)], key=str)


def test_address_lists_of_both_families(spark, tmp_path):
    (tmp_path / "ips").write_text("10.0.0.1, a\n2001:db8::1\n10.0.0.0/24,net\n2001:db8::/32 , six\n10.0.0.0/33\nhost\n::1/129\n1.2.3/8\n")
    assert sorted(map(tuple, lists.read_networks(spark, str(tmp_path / "ips")).collect())) == [
        ("10.0.0.0/24", "net"), ("10.0.0.1", "a"), ("2001:db8::/32", "six"), ("2001:db8::1", "")]
    assert sorted(map(tuple, lists.refused_networks(spark, str(tmp_path / "ips")).collect())) == [
        ("1.2.3/8", "no network address"), ("10.0.0.0/33", "no prefix length"), ("::1/129", "no prefix length"), ("host", "no address")]
    assert [tuple(r) for r in lists.read_ip_list(spark, str(tmp_path / "ips")).collect()] == [(167772161, "a")]


def test_pipe_lines_of_both_families_and_refused_ones(spark, make_flows):
    f = make_flows(dict(), dict(bytes=5), dict(bytes=6)).withColumns({
        "srcaddr": F.when(F.col("bytes") == 5, "2001:db8::7").otherwise("10.0.0.1"),
        "dstaddr": F.when(F.col("bytes") == 5, "fe80::1").otherwise("10.0.0.2")})
    good = textflows.pipe_lines(f)
    back = textflows.parse_pipe(good, text_addresses=True)
    assert sorted((r.af, r.srcaddr, r.dstaddr, r.bytes) for r in back.collect()) == [
        (2, "10.0.0.1", "10.0.0.2", 6), (2, "10.0.0.1", "10.0.0.2", 1000), (10, "2001:db8::7", "fe80::1", 5)]
    numbers = sorted((r.srcaddr or 0, r.sip) for r in textflows.parse_pipe(good).collect())
    assert numbers == [(0, "2001:db8::7"), (167772161, "10.0.0.1"), (167772161, "10.0.0.1")]
    line = good.first().value
    lines = spark.createDataFrame([(line,), ("a|b",), (line.replace("|", "|z", 1),), ("",)], "value string")
    assert textflows.parse_pipe(lines).count() == 1
    assert sorted(r.reason for r in textflows.refused_lines(lines).collect()) == ["1 fields", "2 fields", "first is no number"]


def _tables(spark, out):
    return {part: sorted(map(str, spark.read.parquet(f"{out}/{part}").collect())) for part in ("events", "features/kind=threat",
                                                                                             "details/kind=threat", "topn")}


def test_a_run_repeated_leaves_the_same_tables(spark, flows, tmp_path):
    cfg = Config(rules={"threat": [Rule(2, 13)], "port_scan": [Rule(1, 2, min=3)]},
                 enabled=read_switches(["port_scan = enable", "threat = enable"]))
    asked = rq.TopnRequest("IP", srcdst="src", step=3600, limit=3)
    out, windows = str(tmp_path / "job"), [Window(T0 + i * 21600, T0 + (i + 1) * 21600) for i in range(2)]
    for w in windows:
        job.run_slot(flows, cfg, w, out, [asked], only=["threat", "port_scan"])
    first = _tables(spark, out)
    job.run_slot(flows, cfg, windows[0], out, [asked], only=["threat", "port_scan"])
    assert _tables(spark, out) == first and first["events"] and first["topn"]
    want = sorted(map(tuple, (e for w in windows for e in all_events(run_detectors(flows, Config(cfg.rules, enabled={
        k: k in ("threat", "port_scan") for k in KINDS}), w)).collect())))
    assert sorted(map(tuple, job.read_events(spark, out).collect())) == want
    day = T0 + 21600 + 86400
    assert {r.time for r in job.read_events(spark, out, now=day).collect()} == {T0 + 21600}
    assert job.drop_expired(spark, out, now=day) == 1 and job.read_events(spark, out).where(F.col("time") == T0).count() == 0
    assert job.request_features(spark, out, "threat", T0, T0 + 50000).count() > 0
    assert job.read_topn(spark, out, asked, T0, T0 + 1).count() > 0
    with pytest.raises(ValueError):
        job.request_features(spark, out, "nothing", T0, T0 + 1)


def test_a_window_bounds_days_and_slots(spark, flows, tmp_path):
    path = str(tmp_path / "flows")
    flowtable.write_flows(flows, path)
    plan = Window(T0 + 600, T0 + 900).clip(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    assert "dt" in plan.split("PartitionFilters")[1].split("]")[0] and "slot" in plan.split("Filter (")[1]


def test_json_omits_empty_fields(spark):
    df = spark.createDataFrame([(167772161, "", 3), (167772162, "né", 4)], "sip bigint, qname string, flows int")
    got = sorted(r.json for r in exports.features_to_json(df).collect())
    assert got == ['{"sip":"10.0.0.1","flows":3}', '{"sip":"10.0.0.2","qname":"abnormal character","flows":4}']


def test_requests(spark, flows):
    a, b = rq.TopnRequest("IP", srcdst="src", step=3600, limit=3), rq.TopnRequest("PROTO", step=3600)
    assert a.key() != b.key() and a.key() == rq.TopnRequest("IP", srcdst="src", step=3600, limit=3).key()
    cache = rq.build_topn_cache(flows, [a, b]).cache()
    got = rq.lookup(cache, a, T0, T0 + 7200)
    want = rq.answer(flows.where(F.col("first") < T0 + 7200), a)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_rules_from_a_table(spark):
    df = spark.sql("""SELECT * FROM VALUES (2, 5, 'TCP', array(1, 2), 'WITHOUT'), (1, 3, CAST(NULL AS STRING), NULL, 'WITHIN')
                      AS t(config_id, min, protocol, weekday, coverrange)""")
    one, two = read_rules(df).orderBy("config_id").collect()
    assert (one.config_id, one.protocol, len(one.weekday), two.weekday, two.coverrange) == (1, "", 7, [1, 2], "WITHOUT")
    assert one.etime == [23, 59, 59] and one.min == 3
    assert len(read_objects(spark.range(20000).withColumn("direction", F.lit("IN")))) == 20000


def test_run_enabled_detectors(spark, flows):
    cfg = Config(rules={"port_scan": [Rule(1, 2, min=3)], "threat": [Rule(2, 13)], "bw": [Rule(3, 5, data_type="bps")]},
                 enabled=read_switches(["# x", "threat = disable", "port_scan = enable"]))
    out = run_detectors(flows, cfg, Window(T0, T0 + 86400))
    # no lists, no objects, threat switched off; without rules features alone
    assert set(out) == {"port_scan", "ip_scan", "dnstunnel_scored", "url_content", "malicious_url", "icmptunnel", "tcpinit",
                        "service"}
    assert [n for n, det in out.items() if det.events is not None] == ["port_scan"]
    assert out["ip_scan"].features is not None and out["ip_scan"].details is None
    assert all_events(out).select("type_id").distinct().collect()[0].type_id == 2


def test_feature_query_overlap(spark):
    rows = [(1, 2, 6, T0, T0 + 50, 2, 1, 1, T0), (1, 2, 6, T0 + 4000, T0 + 4100, 5, 1, 1, T0 + 3600)]
    df = spark.createDataFrame(rows, "srcaddr bigint, dstaddr bigint, prot int, first bigint, last bigint, flows bigint, "
                                     "pkts bigint, bytes bigint, hour bigint")
    got = lc.query_features(df, "ip_scan", ["srcaddr", "dstaddr", "prot"], T0 + 60, T0 + 5000).collect()
    assert [(r.flows, r.duration) for r in got] == [(5, 100)]
    assert lc.query_features(df, "ip_scan", ["srcaddr", "dstaddr", "prot"], T0, T0 + 5000).count() == 2
    assert lc.query_features(df, "dnstunnel", ["srcaddr", "dstaddr", "prot"], T0, T0 + 5000).collect()[0].flows == 7
    with pytest.raises(ValueError):
        lc.query_features(df, "no_such_kind", ["srcaddr", "dstaddr", "prot"], T0, T0 + 5000)
