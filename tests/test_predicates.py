"""Single-flow predicate cases: match or no match."""

import pytest
from pyspark.sql import functions as F

from brookwatch.functions import predicates as w
from brookwatch.rules import MonitoredObject

RECORD = dict(af=2, prot=6, srcaddr=0xAC200701, dstaddr=0x0A0A0A0B, srcport=63, dstport=255, srcas=123, dstas=456, next_as=7,
              prev_as=8, pkts=1000, bytes=2000, out_pkts=10, out_bytes=20, aggr_flows=1, first=1089534600, last=1089534610,
              msec_first=10, msec_last=10, tos=5, dst_tos=9, tcp_flags=1, input=5, output=6, src_mask=11, dst_mask=13,
              src_vlan=12, dst_vlan=20, ip_nexthop=0xAC200701, bgp_nexthop=0xAC200702, ip_router=0xAC200703, engine_type=1,
              engine_id=2, exporter_sysid=3, in_src_mac=0x1234567890AA, out_dst_mac=0x2feeddccbbab,
              in_dst_mac=0xaffeaffeaffe, out_src_mac=0xffeeddccbbaa, mpls=[1010 << 4, 2020 << 4, (3030 << 4) | 10, (4040 << 4) | 1],
              fwd_status=1, dir=1, client_latency=11, server_latency=22, app_latency=33, ident="channel1", pname="ssh", qname="",
              qtype=0)

CASES = [
    (lambda: w.w_family(4), 1), (lambda: w.w_family(6), 0),
    (lambda: w.w_proto("tcp"), 1), (lambda: w.w_proto("udp"), 0), (lambda: w.w_proto(6), 1),
    (lambda: w.w_ip("172.32.7.1"), 1), (lambda: w.w_ip("172.32.7.1", side="src"), 1), (lambda: w.w_ip("172.32.7.1", side="dst"), 0),
    (lambda: w.w_ip("10.10.10.11", "172.32.7.1", side="both"), 1), (lambda: w.w_ip("1.2.3.4", "10.10.0.0/16"), 1),
    (lambda: w.w_net("172.32/16"), 1), (lambda: w.w_net("172.32.7.0", "255.255.255.0", side="src"), 1),
    (lambda: w.w_net("172.33/16"), 0), (lambda: w.w_net("172.32.7.9/24"), 1),
    (lambda: w.w_port(63), 1), (lambda: w.w_port(255, side="src"), 0), (lambda: w.w_port(62, cmp=">"), 1),
    (lambda: w.w_port(63, side="src", cmp="<"), 0), (lambda: w.w_port(1, 255), 1), (lambda: w.w_port(1, 2), 0),
    (lambda: w.w_as(123, side="src"), 1), (lambda: w.w_as(457), 0), (lambda: w.w_as(1, 456), 1), (lambda: w.w_as(7, side="next"), 1),
    (lambda: w.w_as(8, side="prev", cmp=">"), 0),
    (lambda: w.w_packets(1000), 1), (lambda: w.w_packets("1k"), 1), (lambda: w.w_packets(1000, ">"), 0), (lambda: w.w_packets(10, way="out"), 1),
    (lambda: w.w_bytes("2k"), 1), (lambda: w.w_bytes("1m", "<"), 1), (lambda: w.w_bytes("2k", ">"), 0),
    (lambda: w.w_flows(1), 1), (lambda: w.w_duration(10000), 1), (lambda: w.w_pps(100), 1), (lambda: w.w_bps(1600), 1), (lambda: w.w_bpp(2), 1),
    (lambda: w.w_tos(5), 1), (lambda: w.w_tos(9, side="dst"), 1), (lambda: w.w_tos(6, side="either"), 0),
    (lambda: w.w_flags("F"), 1), (lambda: w.w_flags("S"), 0), (lambda: w.w_flags("S", negate=True), 1), (lambda: w.w_flags("SF"), 0),
    (lambda: w.w_flags("SF", negate=True), 0), (lambda: w.w_flags(1), 1), (lambda: w.w_flags(1, ">"), 0),
    (lambda: w.w_if(5, side="in"), 1), (lambda: w.w_if(5, side="out"), 0), (lambda: w.w_if(6), 1),
    (lambda: w.w_mask(11, side="src"), 1), (lambda: w.w_mask(11, side="dst"), 0), (lambda: w.w_vlan(20), 1), (lambda: w.w_vlan(21), 0),
    (lambda: w.w_next_ip("172.32.7.1"), 1), (lambda: w.w_next_ip("172.32.7.2"), 0), (lambda: w.w_bgpnext_ip("172.32.7.2"), 1),
    (lambda: w.w_router_ip("172.32.7.0/30"), 1), (lambda: w.w_sysid(3), 1), (lambda: w.w_engine("type", 1), 1), (lambda: w.w_engine("id", 1), 0),
    (lambda: w.w_mac("12:34:56:78:90:aa", "in_src"), 1), (lambda: w.w_mac(0x1234567890AA, "dst"), 0),
    (lambda: w.w_mac("af:fe:af:fe:af:fe", "in"), 1), (lambda: w.w_mac("ff:ee:dd:cc:bb:aa"), 1),
    (lambda: w.w_mpls_label(1, 1010), 1), (lambda: w.w_mpls_label(2, 2020, "<"), 0), (lambda: w.w_mpls_exp(3, 5), 1),
    (lambda: w.w_mpls_eos(4040), 1), (lambda: w.w_mpls_eos(3030), 0), (lambda: w.w_mpls_any(2020), 1), (lambda: w.w_mpls_any(5050), 0),
    (lambda: w.w_mpls_label(10, 0), 0),
    (lambda: w.w_fwdstat("Forw"), 1), (lambda: w.w_fwdstat(16), 0), (lambda: w.w_dir("egress"), 1), (lambda: w.w_dir(0), 0),
    (lambda: w.w_latency("client", 11), 1), (lambda: w.w_latency("server", 22, ">"), 0), (lambda: w.w_latency("app", 32, ">"), 1),
    (lambda: w.w_ident("channel1"), 1), (lambda: w.w_ident("none"), 0), (lambda: w.w_icmp_type(0), 0),
    (lambda: w.w_l7(pname="ssh"), 1), (lambda: w.w_l7(pname="ssh", qtype=0), 0), (lambda: w.w_l7(pname="dns", qtype=0), 1),
    (lambda: ~w.w_proto("tcp") | w.w_port(63) & w.w_any(), 1),
    (lambda: w.request_filter(w.w_proto(6), ip="10.10.10.11", port1=63, port2=255), 1),
    (lambda: w.request_filter(None, ip1="10.10.10.12"), 0),
    (lambda: w.object_filter(MonitoredObject(1, moip="172.32.0.0/16", moport="<64", direction="OUT", pip="!1.1.1.1")), 1),
    (lambda: w.object_filter(MonitoredObject(1, moip="172.32.0.0/16", direction="IN")), 0),
    (lambda: w.object_filter(MonitoredObject(1, moip="!172.32.0.0/16", direction="ALL")), 0),
    (lambda: w.object_filter(MonitoredObject(1, moport="!255", direction="IN", protocol="6")), 0),
    (lambda: w.stat_limit("bytes", "+1k"), 1), (lambda: w.stat_limit("bytes", "-2k"), 0),
]


def test_cases(spark):
    row = spark.createDataFrame([RECORD]).withColumn("mpls", F.col("mpls").cast("array<int>"))
    got = row.select(*[c().alias(f"c{i}") for i, (c, _) in enumerate(CASES)]).first()
    wrong = [i for i, (_, want) in enumerate(CASES) if bool(got[i]) != bool(want)]
    assert not wrong


V6 = [("fe80::2110:abcd:1234:0", "fe80::/10", 1), ("fe80::2110:abcd:1234:0", "fe80::2110:abcd:1234:0", 1),
      ("fe80::2110:abcd:1234:0", "fe80::2110:abcd:1234:1", 0), ("fe80::2110:abcd:1234:0", "fe80::2110:abcd:1234:0/112", 1),
      ("fe80::2110:abcd:1235:0", "fe80::2110:abcd:1234:0/111", 1), ("fe80::2110:abcd:1236:0", "fe80::2110:abcd:1234:0/111", 0),
      ("2001:db8::1", "2001:db8::/32", 1), ("2001:db9::1", "2001:db8::/32", 0), ("8000::1", "::/1", 0), ("::1", "::/1", 1)]


@pytest.mark.parametrize("address,net,want", V6)
def test_ipv6_prefix(spark, address, net, want):
    from brookwatch.functions.address import in_prefix6
    row = spark.range(1).select(F.lit(address).alias("a"))
    assert row.select(in_prefix6("a", net)).first()[0] == bool(want)
