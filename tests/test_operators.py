import functools
import random

import pytest
from pyspark.sql import functions as F

from brookwatch.functions import predicates as w
from brookwatch.operators import aggregate, joins, merges, ranges, rulematch, sweep, topn
from brookwatch.rules import MonitoredObject, Rule

T0 = 1704067200


def merge_one_by_one(rows, gap=3600):
    """Time-ordered merge of (start, end, flows) into touching records."""
    out = []
    for s, e, n in sorted(rows):
        if out and s <= out[-1][1] + gap:
            out[-1] = (out[-1][0], max(out[-1][1], e), out[-1][2] + n)
        else:
            out.append((s, e, n))
    return out


def gap_frame(spark, rows):
    df = spark.createDataFrame(rows, "k string, first bigint, last bigint, flows bigint")
    return merges.merge_gaps(df, ["k"])


def test_gap_boundaries(spark):
    rows = [("a", T0, T0 + 10, 1), ("a", T0 + 10 + 3599, T0 + 4000, 1), ("a", T0 + 4000 + 3600, T0 + 7700, 1),
            ("a", T0 + 7700 + 3601, T0 + 11400, 1), ("nested", T0, T0 + 20000, 1), ("nested", T0 + 100, T0 + 200, 1),
            ("nested", T0 + 23600, T0 + 23700, 1), ("nested", T0 + 27301, T0 + 27302, 1)]
    got = sorted((r.k, r["first"], r["last"], r.flows) for r in gap_frame(spark, rows).collect())
    assert got == [("a", T0, T0 + 7700, 3), ("a", T0 + 11301, T0 + 11400, 1), ("nested", T0, T0 + 23700, 3),
                   ("nested", T0 + 27301, T0 + 27302, 1)]


def test_gap_merge_against_brute_force(spark):
    rnd = random.Random(3)
    rows = []
    for k in "abc":
        for _ in range(150):
            s = T0 + rnd.randrange(0, 10**6 if k == "a" else 2 * 10**5)
            rows.append((k, s, s + rnd.randrange(0, 9000), rnd.randrange(1, 5)))
    want = [(k, *m) for k in "abc" for m in merge_one_by_one([r[1:] for r in rows if r[0] == k])]
    got = [(r.k, r["first"], r["last"], r.flows) for r in gap_frame(spark, rows).collect()]
    assert sorted(got) == sorted(want)


def test_range_join_against_brute_force(spark):
    rnd = random.Random(5)
    ips = [rnd.randrange(0, 2**32) for _ in range(300)] + [0, 2**32 - 1, 2**31]
    nets = [(i, lo, min(lo + rnd.randrange(0, 2**rnd.randrange(1, 32)), 2**32 - 1))
            for i, lo in enumerate(rnd.randrange(0, 2**32) for _ in range(40))]
    nets += [(100, 0, 2**32 - 1), (101, 5, 5), (102, 2**31, 2**31 + 2)]
    df = spark.createDataFrame([(i,) for i in ips], "ip bigint")
    r = spark.createDataFrame(nets, "net int, lo bigint, hi bigint")
    got = sorted((x.ip, x.net) for x in ranges.range_join(df, "ip", r).collect())
    assert got == sorted((ip, n) for ip in ips for n, lo, hi in nets if lo <= ip <= hi)
    some = r.where("net < 20 or net > 100")
    inside = {ip for ip in ips for n, lo, hi in nets if (n < 20 or n > 100) and lo <= ip <= hi}
    assert sorted(x.ip for x in ranges.in_ranges(df, "ip", some).collect()) == sorted(i for i in ips if i in inside)
    assert sorted(x.ip for x in ranges.in_ranges(df, "ip", some, anti=True).collect()) == sorted(i for i in ips if i not in inside)


def test_empty_ranges(spark):
    df = spark.createDataFrame([(1,)], "ip bigint")
    none = spark.createDataFrame([], "net int, lo bigint, hi bigint")
    assert ranges.range_join(df, "ip", none).count() == 0
    assert ranges.in_ranges(df, "ip", none).count() == 0
    assert ranges.in_ranges(df, "ip", none, anti=True).count() == 1


def test_networks_of_both_families_on_one_table(spark):
    """Texts of either family meet the networks of their own; numbers meet the IPv4 ones."""
    ips = ["10.0.0.1", "10.0.1.7", "192.168.0.1", "2001:db8::1", "2001:db8:1::1", "::ffff:10.0.0.1", None]
    df = spark.createDataFrame([(i, ip) for i, ip in enumerate(ips)], "id int, ip string")
    nets = spark.createDataFrame([("10.0.0.0/23",), ("10.0.0.1",), ("0.0.0.0/0",), ("2001:db8::/48",), ("::/0",)], "cidr string")
    got = sorted((r.id, r.cidr) for r in ranges.cidr_join(df, "ip", nets).collect())
    assert got == [(0, "0.0.0.0/0"), (0, "10.0.0.0/23"), (0, "10.0.0.1"), (1, "0.0.0.0/0"), (1, "10.0.0.0/23"), (2, "0.0.0.0/0"),
                   (3, "2001:db8::/48"), (3, "::/0"), (4, "::/0"), (5, "::/0")]
    some = nets.where("cidr LIKE '%/23' OR cidr LIKE '%/48'")
    assert {r.id: r.hit for r in ranges.mark_nets(df, "ip", some, "hit").collect()} == {
        0: True, 1: True, 2: False, 3: True, 4: False, 5: False, 6: False}
    number = spark.createDataFrame([(167772161,), (0,)], "ip bigint")
    assert sorted((r.ip, r.cidr) for r in ranges.cidr_join(number, "ip", nets).collect()) == [
        (0, "0.0.0.0/0"), (167772161, "0.0.0.0/0"), (167772161, "10.0.0.0/23"), (167772161, "10.0.0.1")]


def test_sweep_against_brute_force(spark):
    rnd = random.Random(4)
    found = [(lo, lo + rnd.randrange(0, 60)) for lo in (rnd.randrange(200) for _ in range(50))]
    cuts, cover = sweep.sweep(found)
    df = spark.range(-5, 300).select("id", sweep.rank_of(F.col("id"), cuts).alias("rank"))
    for r in df.collect():
        assert r.rank == sum(c <= r.id for c in cuts)
        assert sorted(i for rank, i in cover if rank == r.rank) == [i for i, (lo, end) in enumerate(found) if lo <= r.id < end]
    texts = ["10.0.0.9", "10.0.0.10", "9.255.0.0", "::1", "2001:db8::", "2001:db8::ffff", "fe80::1"]
    keyed = spark.createDataFrame([(t,) for t in texts], "ip string").orderBy(sweep.order_key("ip")).collect()
    assert [r.ip for r in keyed] == ["9.255.0.0", "10.0.0.9", "10.0.0.10", "::1", "2001:db8::", "2001:db8::ffff", "fe80::1"]


def test_objects_of_both_families_on_one_table(spark):
    rows = [("10.0.0.1", "192.168.0.1", 5, 80, 6), ("2001:db8::1", "2001:db8::9", 5, 80, 6), ("2001:db8::1", "10.0.0.1", 5, 80, 17)]
    f = spark.createDataFrame(rows, "srcaddr string, dstaddr string, srcport int, dstport int, prot int")
    mos = [MonitoredObject(1, moip="10.0.0.0/24"), MonitoredObject(2, moip="2001:db8::/32", direction="OUT", pip="!2001:db8::/64"),
           MonitoredObject(3, moip="!10.0.0.1", direction="IN"), MonitoredObject(4, moport="80", pip="2001:db8::1", direction="IN")]
    got = sorted((r.moid, rows.index((r.srcaddr, r.dstaddr, r.srcport, r.dstport, r.prot))) for r in joins.match_mo(f, mos).collect())
    assert got == [(1, 0), (1, 2), (2, 2), (3, 0), (3, 1), (4, 1), (4, 2)]
    assert got == sorted((m.id, i) for m in mos for i, r in enumerate(rows)
                         if f.where(w.object_filter(m)).where(F.struct(*f.columns) == F.struct(*map(F.lit, r))).count())
    # on a table of numbers an IPv6 object matches nothing
    n = f.limit(1).withColumns({"srcaddr": F.lit(167772161), "dstaddr": F.lit(3232235521)})
    assert [r.moid for r in joins.match_mo(n, mos).collect()] == [1, 3]
    assert n.where(w.w_ip("2001:db8::1", "10.0.0.1")).count() == 1 and n.where(w.w_net("2001:db8::/32")).count() == 0


def test_prefix_join_v6(spark):
    df = spark.createDataFrame([("2001:db8::1",), ("2001:db9::1",), ("fe80::1",)], "ip string")
    nets = spark.createDataFrame([("2001:db8::/32",), ("2001:db8::1",), ("2000::/3",)], "cidr string")
    got = sorted((r.ip, r.cidr) for r in ranges.cidr_join(df, "ip", nets).collect())
    assert got == [("2001:db8::1", "2000::/3"), ("2001:db8::1", "2001:db8::/32"), ("2001:db8::1", "2001:db8::1"),
                   ("2001:db9::1", "2000::/3")]


def test_most_specific_class_decides_even_when_it_fails(spark):
    keys = spark.createDataFrame([(1, 22, 6, 5), (1, 80, 6, 5), (2, 22, 17, 5)], "ip int, dstport int, prot int, peers int")
    rules = [Rule(1, sip="1", port="22", protocol="6", min=9), Rule(2, sip="1", min=1), Rule(3, min=1), Rule(4, sip="1", min=99)]
    matchers = {"sip": rulematch.words(F.col("ip")), "port": rulematch.words(F.col("dstport")),
                "protocol": rulematch.words(F.col("prot"))}
    out = rulematch.best_rule(keys, rules, matchers)
    got = {(r.ip, r.dstport): r.rule.config_id for r in out.collect()}
    assert got == {(1, 22): 1, (1, 80): 2, (2, 22): 3}
    met = {(r.ip, r.dstport) for r in out.where(rulematch.passes("peers")).collect()}
    assert met == {(1, 80), (2, 22)}
    assert rulematch.best_rule(keys, [], matchers).where("rule is not null").count() == 0


def test_top_per_group_parts_agree(spark, monkeypatch):
    rnd = random.Random(11)
    rows = [("hot" if i % 3 else f"g{i % 7}", rnd.randrange(500), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v int, id int")
    order = [F.col("v").desc(), F.col("id")]
    plain = sorted(map(tuple, topn.top_per_group(df, ["g"], order, 20).collect()))
    monkeypatch.setattr(topn, "RANK_LIMIT", 5)
    assert sorted(map(tuple, topn.top_per_group(df, ["g"], order, 20).collect())) == plain
    assert topn.top_per_group(df, ["g"], order, 0).count() == 3000


def test_partial_limit_before_ranking_shuffle(flows):
    plan = topn.topn_by_step(flows, "CONV", step=3600)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_bidirectional_takes_the_first_direction(make_flows):
    f = make_flows(dict(srcaddr=9, srcport=53, dstaddr=1, dstport=999, prot=17, first=T0 + 5, last=T0 + 5, pkts=1, bytes=10),
                   dict(srcaddr=1, srcport=999, dstaddr=9, dstport=53, prot=17, first=T0 + 9, last=T0 + 9, pkts=2, bytes=20),
                   dict(srcaddr=1, srcport=0, dstaddr=9, dstport=0, prot=1), dict(srcaddr=9, srcport=0, dstaddr=1, dstport=0, prot=1))
    rows = {(r.srcaddr, r.prot): r for r in aggregate.bidir_flows(f).collect()}
    r = rows[(9, 17)]
    assert (r.pkts, r.bytes, r.out_pkts, r.out_bytes, r.flows) == (1, 10, 2, 20, 2)
    assert (1, 1) in rows and (9, 1) in rows and len(rows) == 3


def test_two_sided_element_counts_equal_sides_once(make_flows):
    f = make_flows(dict(srcaddr=5, dstaddr=5, bytes=7), dict(srcaddr=5, dstaddr=6, bytes=3))
    got = {r.value: (r.flows, r.bytes) for r in topn.element_stat(f, "ip").collect()}
    assert got == {5: (2, 10), 6: (1, 3)}


def test_object_match_routes_agree(flows):
    rnd = random.Random(2)
    mos = []
    for i in range(40):
        mos.append(MonitoredObject(
            i, moip=rnd.choice(["", "10.0.0.0/28", "192.168.0.4", "!192.168.0.0/28", "192.168.0.16/29", "10.0.0.3"]),
            moport=rnd.choice(["", "80", "<100", "!22", ">30000"]), protocol=rnd.choice(["", "TCP", "17"]),
            pip=rnd.choice(["", "192.168.0.0/29", "!10.0.0.0/27"]), pport=rnd.choice(["", "443", "!53"]),
            direction=rnd.choice(["IN", "OUT", "ALL"])))
    cols = ["srcaddr", "dstaddr", "srcport", "dstport", "prot", "first", "bytes"]
    f = flows.select(*cols)
    by_filter = [f.where(w.object_filter(m)).select(F.lit(m.id).alias("moid"), F.lit(m.direction).alias("direction"), "bytes") for m in mos]
    a = functools.reduce(lambda x, y: x.unionByName(y), by_filter).groupBy("moid", "direction").agg(
        F.count("*").alias("n"), F.sum("bytes").alias("b"))
    b = joins.match_mo(f, mos).groupBy("moid", "direction").agg(F.count("*").alias("n"), F.sum("bytes").alias("b"))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_include_exclude(make_flows):
    f = make_flows(dict(dstport=1), dict(dstport=2), dict(dstport=3))
    keep = lambda i, e: sorted(r.dstport for r in joins.filter_labels(
        f, [w.w_port(p) for p in i], [w.w_port(p) for p in e]).collect())
    assert keep([], []) == [1, 2, 3]
    assert keep([1, 2], [2]) == [1]
    assert keep([], [3]) == [1, 2]


def test_service_pairing_drops_clients(make_flows):
    f = make_flows(
        dict(srcaddr=1, srcport=5000, dstaddr=2, dstport=80, tos=1), dict(srcaddr=2, srcport=80, dstaddr=1, dstport=5000, tos=0),
        # answers without requests, and a responder that is also a client
        dict(srcaddr=3, srcport=81, dstaddr=1, dstport=5001, tos=0),
        dict(srcaddr=4, srcport=82, dstaddr=1, dstport=83, tos=1), dict(srcaddr=1, srcport=5002, dstaddr=4, dstport=82, tos=1))
    got = sorted((r.addr, r.port, r.srv_mark, r.flows) for r in joins.pair_services(f, F.lit("")).collect())
    assert got == [(2, 80, 0, 1), (2, 80, 1, 1)]


def test_sliding_totals(spark):
    rows = [(T0 + 300 * i, 6, 80, 1, 1, 1) for i in range(6)] + [(T0 + 300 * 13, 6, 80, 1, 1, 1)]
    df = spark.createDataFrame(rows, "slot bigint, prot int, dstport int, flows bigint, pkts bigint, bytes bigint")
    got = {(r.slot - T0) // 300: r.flows for r in merges.sliding_port_stats(df, width=900).collect()}
    assert got == {0: 1, 1: 2, 2: 3, 3: 3, 4: 3, 5: 3, 13: 1}
    # a gap of more than 1800 s restarts the totals
    got = {(r.slot - T0) // 300: r.flows for r in merges.sliding_port_stats(df).collect()}
    assert got[5] == 6 and got[13] == 1


@pytest.mark.parametrize("by", [["srcip"], ["srcip4/24", "proto"], None])
def test_empty_input(flows, by):
    assert aggregate.aggregate_flows(flows.limit(0), by).count() == 0


def test_ipv6_objects_at_any_number(spark):
    """Objects of either family on text addresses, few and many, by the same rows."""
    f = spark.createDataFrame([("2001:db8::1", "2001:db8::2", 1, 2, 6)],
                              "srcaddr string, dstaddr string, srcport int, dstport int, prot int")
    for n in (3, 20):
        mos = [MonitoredObject(i, moip="2001:db8::1", direction="OUT") for i in range(n)]
        assert joins.match_mo(f, mos).count() == n
