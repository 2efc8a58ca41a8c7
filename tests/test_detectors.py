"""Detectors on small hand-written tables: hits and misses."""

import pytest
from pyspark.sql import functions as F

from brookwatch import detectors as d
from brookwatch.detectors.scoring import batch_scorer, model_scorer, name_score, train_scorer
from brookwatch.detectors.web import factor
from brookwatch.rules import MonitoredObject, Pattern, Rule, Window

T0 = 1704067200
SLOT = Window(T0, T0 + 300)
A, B = 167772161, 3232235521          # 10.0.0.1, 192.168.0.1


def objs(det):
    return sorted(r.obj for r in det.events.collect())


@pytest.mark.parametrize("pattern, text", [
    (r".*union\s+select.*", "select"), ("/admin", "/admin"), (r"/a\.php\?id=\d+", "/a.php?id="), ("abcd|efgh", ""), ("(abcd|efgh)ijkl", "ijkl"),
    ("abcde?f", "abcd"), ("abcde+fghijk", "fghijk"), ("abc{0,3}defg", "defg"), ("[a-z]+wxyz", "wxyz"), ("(?i)select", ""), (r"\Qabcd\E", ""),
    ("abcd*", ""), ("ab(cdefgh)?ij", ""), (r"abcd\x41efgh", ""), ("", "")])
def test_plain_text_of_a_pattern(pattern, text):
    assert factor(pattern) == text


def test_port_scan(make_flows):
    rows = [dict(dstaddr=B + i, dstport=22) for i in range(5)] + [dict(dstaddr=B + i, dstport=23) for i in range(2)]
    rows += [dict(dstaddr=B + i, dstport=22, tos=0, srcaddr=A + 1) for i in range(5)]      # responses do not count
    rows += [dict(dstaddr=B + i, dstport=22, first=T0 + 300) for i in range(20)]            # next slot
    f = make_flows(*rows)
    det = d.detect_port_scan(f, [Rule(7, 2, min=5, protocol="TCP")], [Pattern("PORT_SCAN", peers=2, flows=3)], SLOT)
    (e,) = det.events.collect()
    assert (e.obj, e.alarm_value, e.thres_value, e.value_type, e.time) == ("10.0.0.1:>:22 TCP ", 5, 5, "peerips", T0)
    assert [(r.dstport, r.peers) for r in det.features.collect()] == [(22, 5)]
    assert det.details.count() == 5 and {r.obj for r in det.details.collect()} == {e.obj}


def test_port_scan_maximum_and_schedule(make_flows):
    f = make_flows(*[dict(dstaddr=B + i) for i in range(5)])
    assert objs(d.detect_port_scan(f, [Rule(1, 2, min=1, max=5)], [], SLOT)) == []
    assert objs(d.detect_port_scan(f, [Rule(1, 2, min=1, max=6)], [], SLOT)) == ["10.0.0.1:>:80 TCP "]
    assert objs(d.detect_port_scan(f, [Rule(1, 2, min=1, weekday=(0,))], [], SLOT)) == []
    assert objs(d.detect_port_scan(f, [Rule(1, 2, min=1, weekday=(0,), coverrange="WITHOUT")], [], SLOT)) != []


def test_ip_scan_leaves_udp_out(make_flows):
    f = make_flows(*[dict(dstport=p) for p in range(1, 5)], *[dict(dstport=p, prot=17) for p in range(1, 9)])
    assert objs(d.detect_ip_scan(f, [Rule(1, 8, min=4)], [], SLOT)) == ["10.0.0.1:>192.168.0.1: TCP "]


def test_ip_scan_v6(make_flows):
    f = make_flows(*[dict(dstport=p) for p in range(1, 5)]).withColumns(
        {"srcaddr": F.lit("2001:db8::1"), "dstaddr": F.lit("2001:db8::2")})
    rule = Rule(1, 8, min=4, sip="2001:db8::/64")
    assert objs(d.detect_ip_scan(f, [rule], [], SLOT)) == ["[2001:db8::1]:>[2001:db8::2]: TCP "]
    assert objs(d.detect_ip_scan(f, [Rule(1, 8, min=4, sip="10.0.0.1")], [], SLOT)) == []


def test_dns_intel(spark, make_flows):
    intel = spark.createDataFrame([("bad.com", "c2")], "n string, class string").select(F.md5(F.col("n").cast("binary")).alias("md5"), "class")
    f = make_flows(dict(qname="bad.com", qtype=1, prot=17), dict(qname="bad.com", qtype=1, prot=17), dict(qname="good.com", qtype=1, prot=17),
                   dict(qname="bad.com", qtype=28, prot=17), dict(qname="-bad", qtype=1, prot=17))
    rules = [Rule(1, 4, qcount=1), Rule(2, 4, qname="good.com"), Rule(3, 4, ip="10.0.1.0/24")]
    det = d.detect_dns_intel(f, rules, intel, SLOT)
    assert objs(det) == ["10.0.0.1:>192.168.0.1:  good.com", "10.0.0.1:>192.168.0.1: c2 bad.com"]
    assert det.features.count() == 3


NAME = "q1w2e3r4t5y6u7i8o9p0.com"


def test_dga_first_matching_rule_takes_the_name(spark, make_flows):
    f = make_flows(dict(qname=NAME, prot=17), dict(qname="z" + NAME, prot=17), dict(qname="www.example.com", prot=17),
                   dict(qname="x" + NAME[:-3] + "safe", prot=17))
    white = spark.createDataFrame([("safe",)], "name string")
    rules = [Rule(1, 12, min=50, qcount=5), Rule(2, 12, min=50)]
    assert objs(d.detect_dga(f, rules, white, SLOT)) == []          # rule 1 takes both names, too few
    det = d.detect_dga(f, [Rule(1, 12, min=50, sip="10.9.0.0/16"), Rule(2, 12, min=50, qcount=1, data_type="x")], white, SLOT)
    (e,) = det.events.collect()
    assert (e.config_id, e.obj, e.model_id) == (2, "10.0.0.1:>192.168.0.1:  ", 1)
    assert det.details.count() == 2


def test_plugged_scorers(spark, make_flows):
    f = make_flows(dict(qname=NAME, prot=17), dict(qname="example.com", prot=17))
    half = batch_scorer(lambda: lambda codes: (codes > 0).sum(axis=1) / 128)
    got = {r.qname: r.score for r in d.detect_dns_tunnel_scored(f, [Rule(1, 14, min=1)], SLOT, half).features.collect()}
    assert got == {NAME: len(NAME) * 100 // 128, "example.com": 11 * 100 // 128}
    words = [f"shop{i}.com" for i in range(40)] + [f"{i * 7919:x}q{i * 104729:x}z.com" for i in range(1, 41)]
    rows = spark.createDataFrame([(x, int(i >= 40)) for i, x in enumerate(words)], "text string, label int")
    model = train_scorer(rows, features=512)
    scored = {r.text: r.score for r in model_scorer(model)(rows, "text").collect()}
    assert all(0 <= s <= 100 for s in scored.values()) and scored[words[60]] > scored[words[5]]
    assert spark.range(1).select(name_score(F.lit("www.example.com"))).first()[0] == 0


def test_dns_tunnel(spark, make_flows):
    none = spark.createDataFrame([], "name string")
    long = ["abcdefghij0123456789klmnop" + str(i) + ".evil.com" for i in range(3)]
    f = make_flows(*[dict(qname=n, qtype=16, prot=17, dstport=53, first=T0 + i) for i, n in enumerate(long)],
                   dict(qname=long[0], qtype=16, prot=17, dstport=53, first=T0 + 9, srcaddr=A + 1),    # seen before
                   dict(qname="aaaaaaaaaaaaaaaaaaaaaaaaaa.dull.com", qtype=1, prot=17, dstport=53),
                   dict(qname="dnscat.0011223344556677.x.org", qtype=15, prot=17, dstport=53))
    det = d.detect_dns_tunnel(f, [Rule(1, 7, detvalue=4, fqcount=2)], none, SLOT)
    got = {r.obj: r.alarm_value for r in det.events.collect()}
    assert got == {"10.0.0.1:>192.168.0.1: TUN evil.com": 3, "10.0.0.1:>192.168.0.1: TUN dnscat": 1}
    white = spark.createDataFrame([("evil.com",)], "name string")
    assert objs(d.detect_dns_tunnel(f, [Rule(1, 7, detvalue=4)], white, SLOT)) == ["10.0.0.1:>192.168.0.1: TUN dnscat"]


@pytest.mark.parametrize("rule,rows,hit", [
    (dict(if1=1, if2=9, if3=9), [dict(icmp_data="data1", dstport=13 * 256), dict(icmp_data="data2", dstport=13 * 256)], True),
    (dict(if1=1, if2=9, if3=9), [dict(icmp_data="data1", dstport=8 * 256), dict(icmp_data="data2", dstport=0)], False),
    (dict(if1=9, if2=9, if3=9), [dict(icmp_data="dat1"), dict(icmp_data="dat2", tos=0, rev=1), dict(icmp_data="dat3", tos=0, rev=1)], True),
    (dict(if1=9, if2=1, if3=9), [dict(icmp_data="dat1"), dict(icmp_data="dat2", tos=0, rev=1)], True),
    (dict(if1=9, if2=9, if3=1), [dict(icmp_data="dat1", icmp_payload_len=4), dict(icmp_data="dat1", icmp_payload_len=5)], True),
    (dict(if1=0, if2=0, if3=0), [dict(icmp_data="AAAA"), dict(icmp_data="..x."), dict(icmp_data="xabcdefghijklmnopqrstuvwx"), dict(icmp_data="")], False),
])
def test_icmp_tunnel(make_flows, rule, rows, hit):
    base = dict(prot=1, dstport=8 * 256, srcport=0)
    full = []
    for r in rows:
        r = dict(r)
        if r.pop("rev", 0):
            r |= dict(srcaddr=B, dstaddr=A)
        full.append(base | r)
    assert bool(objs(d.detect_icmp_tunnel(make_flows(*full), [Rule(1, 11, **rule)], SLOT))) == hit


def test_url_attacks(make_flows):
    f = make_flows(dict(http_url="/a?id=1 union select", http_ret_code=200), dict(http_url="/a?id=1 union select", http_ret_code=0),
                   dict(http_url="/dump", http_ret_code=200, bytes=5000), dict(http_url="/dump/x", http_ret_code=200, bytes=9000))
    rules = [Rule(1, 9, sub_type=2, pat=".*select"), Rule(2, 9, sub_type=1, pat=".*union.*"), Rule(3, 9, sub_type=5, min=4999, pat="/dump")]
    got = sorted((r.config_id, r.obj) for r in d.detect_url_attacks(f, rules, SLOT).events.collect())
    assert got == [(2, "10.0.0.1:40000>192.168.0.1:80 TCP SQL_INJECT"), (3, "10.0.0.1:40000>192.168.0.1:80 TCP PULL_DB")]


def test_outreach(spark, make_flows):
    assets = spark.createDataFrame([("10.0.0.0/24",)], "cidr string")
    f = make_flows(dict(bytes=600), dict(bytes=600), dict(bytes=5000, srcaddr=A + 65536))
    assert objs(d.detect_outreach(f, [Rule(1, 10, min=1200)], assets, SLOT)) == ["10.0.0.1:>192.168.0.1:80 TCP "]
    assert objs(d.detect_outreach(f, [Rule(1, 10, min=1200, dip="8.8.8.8")], assets, SLOT)) == []
    assert objs(d.detect_outreach(f, [Rule(1, 10, min=1200, sip="10.1.0.0/16")], assets, SLOT)) == ["10.1.0.1:>192.168.0.1:80 TCP "]


def test_outreach_v6_with_mixed_assets(spark, make_flows):
    assets = spark.createDataFrame([("10.0.0.0/24",), ("2001:db8::/64",)], "cidr string")
    f = make_flows(dict(bytes=600)).withColumns({"srcaddr": F.lit("2001:db8::5"), "dstaddr": F.lit("2001:db9::1")})
    assert objs(d.detect_outreach(f, [Rule(1, 10, min=1)], assets, SLOT)) == ["[2001:db8::5]:>[2001:db9::1]:80 TCP "]
    out = f.withColumn("srcaddr", F.lit("2001:db8:1::5"))
    assert objs(d.detect_outreach(out, [Rule(1, 10, min=1)], assets, SLOT)) == []
    assert objs(d.detect_outreach(make_flows(dict(bytes=9)), [Rule(1, 10, min=1)], assets, SLOT)) == ["10.0.0.1:>192.168.0.1:80 TCP "]


def test_mining_and_threats(spark, make_flows):
    f = make_flows(dict(threat_type="Mining", threat_name="XMR"), dict(qname="pool.org", prot=17, tos=0),
                   dict(dstaddr=B + 9), dict(srcaddr=B + 9, dstaddr=A))
    dom = spark.createDataFrame([("pool.org", "btc")], "n string, coin string").select(F.md5(F.col("n").cast("binary")).alias("md5"), "coin")
    ips = spark.createDataFrame([(B + 9, "eth")], "ip bigint, coin string")
    got = {(r.obj, r.model_id, r.alarm_value) for r in d.detect_mining(f, [Rule(1, 15)], dom, ips, SLOT).events.collect()}
    assert got == {("10.0.0.1:>192.168.0.1: TCP XMR ", 3, 1), ("192.168.0.1:>10.0.0.1: UDP btc pool.org", 2, 1),
                   ("10.0.0.1:>192.168.0.10: TCP eth ", 2, 2)}
    assert objs(d.detect_threats(f, [Rule(1, 13)], SLOT)) == ["192.168.0.1:>10.0.0.1:80 TCP mining xmr"]


def test_listed_addresses(spark, make_flows):
    ips = spark.createDataFrame([(B, "c2")], "ip bigint, class string")
    f = make_flows(dict(bytes=30000), dict(tos=0, srcaddr=B, dstaddr=A), dict(prot=17, srcaddr=B, dstaddr=A, bytes=90000),
                   dict(prot=17, bytes=60000))
    det = d.detect_suspicious(f, ips, [Rule(1, 6, min=100, data_type="Bps")], SLOT)
    got = {(r.obj, r.alarm_value) for r in det.events.collect()}
    assert got == {("192.168.0.1:>10.0.0.1: TCP c2", 100), ("192.168.0.1:>10.0.0.1: UDP c2", 200)}
    assert {(r.prot, r.ti_mark) for r in det.features.collect()} == {(6, True), (17, True), (17, False)}
    assert objs(d.detect_black_list(f, ips, [Rule(1, 5, min=1, max=150, data_type="bps")], SLOT)) == ["192.168.0.1:>10.0.0.1: TCP "]


def test_object_thresholds(make_flows):
    mos = [MonitoredObject(1, moip="192.168.0.1", direction="IN"), MonitoredObject(2, moip="192.168.0.1", direction="ALL")]
    f = make_flows(dict(bytes=60000))
    rows = d.detect_object_thresholds(f, mos, [Rule(1, 1, min=100, max=200, moid=1, data_type="Bps"),
                                               Rule(2, 1, min=1, moid=2, data_type="Bps"),
                                               Rule(3, 1, min=100, max=201, moid=1, data_type="Bps")], SLOT).events.collect()
    assert {(r.config_id, r.thres_value, r.alarm_value, r.obj) for r in rows} == {
        (1, 200, 200, "192.168.0.1:80>10.0.0.1: TCP 1"), (3, 100, 200, "192.168.0.1:80>10.0.0.1: TCP 1")}


def test_tcp_init_and_popular(make_flows):
    f = make_flows(dict(), dict(tos=0, srcaddr=B, dstaddr=A, srcport=80, dstport=40000), dict(dstport=81), dict(dstport=82, tcp_flags=20))
    marks = {r.dport: r.srv_mark for r in d.detect_tcp_init(f, SLOT).features.collect()}
    assert marks == {80: "res", 81: "req"}
    rows = d.popular_services(f, T0 + 86400, 1, 50).collect()
    assert {(r.dstport, r.clients) for r in rows} == {(80, 1), (81, 1), (82, 1)}
    assert d.popular_services(f, T0 + 86400, 1, 0).count() == 0


def test_asset_services(spark, make_flows):
    assets = spark.createDataFrame([("192.168.0.0/24",)], "cidr string")
    f = make_flows(dict(), dict(tos=0, srcaddr=B, dstaddr=A, srcport=80, dstport=40000),
                   dict(tos=0, srcaddr=B, dstaddr=A, srcport=80, dstport=40000))
    det = d.detect_asset_services(f, assets, [Rule(1, 3, min=2, port="80")], [Pattern("SRV", flows=1)], SLOT)
    (e,) = det.events.collect()
    assert (e.obj, e.alarm_value, e.value_type) == (":>192.168.0.1:80 TCP ", 2, "flow_count")
    assert sorted((r.srv_mark, r.flows) for r in det.features.collect()) == [(0, 1), (1, 2)]


def test_empty_flows(spark, make_flows):
    f = make_flows(dict()).limit(0)
    none = spark.createDataFrame([], "ip bigint, class string")
    assert d.detect_port_scan(f, [Rule(1, 2)], [], SLOT).events.count() == 0
    assert d.detect_suspicious(f, none, [Rule(1, 6, data_type="Bps")], SLOT).events.count() == 0
