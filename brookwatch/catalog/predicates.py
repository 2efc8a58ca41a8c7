"""Flow predicates (W): totals of the matching flows per protocol."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixtures
from ..functions import address as a
from ..functions import predicates as w
from ..functions import timefn
from ..operators import aggregate, topn
from ..plans import lifecycle
from ..rules import MonitoredObject, Rule
from .registry import DOMAIN, END, START, event_sql, ip_sql, on_flows, register, value_counts  # noqa: F401

_TOTALS = ("prot, count(*) AS n, CAST(sum(pkts) AS BIGINT) AS pkts, CAST(sum(bytes) AS BIGINT) AS bytes")


def totals(flows: DataFrame) -> DataFrame:
    return flows.groupBy("prot").agg(F.count(F.lit(1)).alias("n"), F.sum("pkts").alias("pkts"),
                                     F.sum("bytes").alias("bytes"))


def predicate(name: str, cond: Callable[[], Column], sql: str, wide: bool = True) -> None:
    on_flows(name, lambda f: totals(f.where(cond())), f"SELECT {_TOTALS} FROM flows WHERE {sql} GROUP BY ALL",
             wide=wide)


_D = "(1000 * (last - first) + msec_last - msec_first)"
predicate("w1_logic", lambda: w.w_any() & (w.w_proto("tcp") | ~w.w_port(53)) & ~(w.w_bytes(20000, "<")),
          "(prot = 6 OR NOT (srcport = 53 OR dstport = 53)) AND NOT bytes < 20000", wide=False)
predicate("w2_comparator", lambda: w.w_all(w.w_packets(10, ">"), w.w_packets(40, "<")) | w.w_packets(3),
          "(pkts > 10 AND pkts < 40) OR pkts = 3", wide=False)
predicate("w3_ident", lambda: w.w_ident("north"), "ident = 'north'")
predicate("w4_family", lambda: w.w_family(4) & ~w.w_family(6), "af = 2")
predicate("w5_proto", lambda: w.w_proto("udp") | w.w_proto(1), "prot IN (17, 1)", wide=False)
predicate("w6_packets", lambda: w.w_packets(25, ">") & w.w_packets(3, "<", way="out"), "pkts > 25 AND out_pkts < 3")
predicate("w7_bytes", lambda: w.w_bytes("30k", ">") & w.w_bytes(500, ">", way="out"),
          "bytes > 30000 AND out_bytes > 500")
predicate("w8_flows", lambda: w.w_flows(1, ">"), "aggr_flows > 1")
predicate("w9_rates", lambda: w.w_pps(1, "<") | (w.w_bps("10k", ">") & w.w_bpp(1500, ">") & w.w_duration(20000, "<")),
          f"coalesce(1000 * pkts // nullif({_D}, 0), 0) < 1 OR (coalesce(8000 * bytes // nullif({_D}, 0), 0) > 10000 "
          f"AND coalesce(bytes // nullif(pkts, 0), 0) > 1500 AND {_D} < 20000)")
predicate("w10_tos", lambda: w.w_tos(1) & w.w_tos(8, side="dst", cmp=">"), "tos = 1 AND dst_tos > 8")
predicate("w11_flags", lambda: w.w_flags("AR") | w.w_flags("SF"), "(tcp_flags & 20) = 20 OR (tcp_flags & 3) = 3",
          wide=False)
predicate("w11_flags_negated", lambda: w.w_flags("R", negate=True) & w.w_flags(20, ">"),
          "(tcp_flags & 4) = 0 AND tcp_flags > 20", wide=False)
predicate("w12_ip", lambda: w.w_ip("192.168.0.5", "10.0.0.7") & w.w_ip("10.0.0.7", side="dst"),
          "(srcaddr IN (3232235525, 167772167) OR dstaddr IN (3232235525, 167772167)) AND dstaddr = 167772167",
          wide=False)
predicate("w13_ip_list", lambda: w.w_ip("192.168.0.0/29", "10.0.0.40", side="src"),
          "srcaddr BETWEEN 3232235520 AND 3232235527 OR srcaddr = 167772200", wide=False)
predicate("w14_next_ip", lambda: w.w_next_ip("172.16.0.3", "172.16.0.4/31"),
          "ip_nexthop = 2886729731 OR ip_nexthop BETWEEN 2886729732 AND 2886729733")
predicate("w15_bgpnext_ip", lambda: w.w_bgpnext_ip("172.16.2.1"), "bgp_nexthop = 2886730241")
predicate("w16_router_ip", lambda: w.w_router_ip("172.16.3.2"), "ip_router = 2886730498")
predicate("w17_latency", lambda: w.w_latency("client", 2500, ">") & w.w_latency("server", 3000, "<")
          & ~w.w_latency("app", 100, "<"), "client_latency > 2500 AND server_latency < 3000 AND app_latency >= 100")
predicate("w18_engine", lambda: w.w_sysid(2) & (w.w_engine("type", 1) | w.w_engine("id", 2, ">")),
          "exporter_sysid = 2 AND (engine_type = 1 OR engine_id > 2)")
predicate("w19_port", lambda: w.w_port(80, side="dst") | w.w_port(45000, side="src", cmp=">") | w.w_port(22),
          "dstport = 80 OR srcport > 45000 OR srcport = 22 OR dstport = 22", wide=False)
predicate("w20_port_list", lambda: w.w_port(80, 443, 8080) & ~w.w_port(443, 80, side="both"),
          "(srcport IN (80, 443, 8080) OR dstport IN (80, 443, 8080)) "
          "AND NOT (srcport IN (443, 80) AND dstport IN (443, 80))", wide=False)
predicate("w21_icmp", lambda: w.w_icmp_type(13) | (w.w_icmp_type(8) & w.w_icmp_code(0)),
          "prot = 1 AND (dstport >> 8 = 13 OR (dstport >> 8 = 8 AND dstport & 255 = 0))", wide=False)
predicate("w22_as", lambda: w.w_as(64501, 64503) & w.w_as(64601, side="next") | w.w_as(64701, side="prev", cmp=">"),
          "((srcas IN (64501, 64503) OR dstas IN (64501, 64503)) AND next_as = 64601) OR prev_as > 64701")
predicate("w23_mask", lambda: w.w_mask(24, side="src") | w.w_mask(21, side="dst"), "src_mask = 24 OR dst_mask = 21")
predicate("w24_net", lambda: w.w_net("192.168.0.16", "255.255.255.240", side="src") | w.w_net("10.0.0.32/28"),
          "srcaddr BETWEEN 3232235536 AND 3232235551 OR srcaddr BETWEEN 167772192 AND 167772207 "
          "OR dstaddr BETWEEN 167772192 AND 167772207", wide=False)
predicate("w25_if", lambda: w.w_if(2, side="in") & ~w.w_if(3, side="out"), "input = 2 AND output <> 3")
predicate("w26_vlan", lambda: w.w_vlan(103) | w.w_vlan(105, side="dst"),
          "src_vlan = 103 OR dst_vlan = 103 OR dst_vlan = 105")
predicate("w27_mac", lambda: w.w_mac("00:00:00:00:ad:9c", "in") | w.w_mac(55560, "dst"),
          "in_src_mac = 44444 OR in_dst_mac = 44444 OR in_dst_mac = 55560 OR out_dst_mac = 55560")
predicate("w28_mpls", lambda: w.w_mpls_label(1, 1010, ">") & w.w_mpls_exp(1, 3) | w.w_mpls_eos(2005)
          | w.w_mpls_any(3007),
          "(mpls1 >> 4 > 1010 AND (mpls1 >> 1) & 7 = 3) OR (CASE WHEN (mpls2 & 1) = 1 THEN mpls2 ELSE mpls3 END) >> 4 "
          "= 2005 OR 3007 IN (mpls1 >> 4, mpls2 >> 4, mpls3 >> 4)")
predicate("w29_fwdstat_dir", lambda: w.w_fwdstat("forw") & w.w_dir("egress") | w.w_fwdstat(128),
          "(fwd_status = 1 AND dir = 1) OR fwd_status = 128")
predicate("w30_l7", lambda: w.w_l7(pname="ssh") | w.w_l7(pname="dns", qtype=28) | w.w_l7(pname="http", qtype=1),
          "pname = 'ssh' OR qtype = 28")
on_flows("w31_window_absolute", lambda f: totals(timefn.time_window(f, "2024/01/01.06-2024/01/01.12:30")),
         f"SELECT {_TOTALS} FROM flows WHERE first >= {START + 6 * 3600} AND last <= {START + 45000} GROUP BY ALL")
on_flows("w31_window_relative", lambda f: totals(timefn.time_window(f, "-7200")),
         f"SELECT {_TOTALS} FROM flows WHERE first >= (SELECT max(last) FROM flows) - 7200 GROUP BY ALL")
on_flows("w32_partial_date", lambda f: totals(timefn.time_window(f, "2024/01/01.13")),
         f"SELECT {_TOTALS} FROM flows WHERE first >= {START + 13 * 3600} GROUP BY ALL")
on_flows("w33_stat_limit",
         lambda f: (topn.element_stat(f, "dstip").where(w.stat_limit("bytes", "+10m") & w.stat_limit("pkts", "-60k"))
                    .select("value", "flows", "pkts", "bytes")),
         "SELECT dstaddr AS value, count(*) AS flows, CAST(sum(pkts) AS BIGINT) AS pkts, "
         "CAST(sum(bytes) AS BIGINT) AS bytes FROM flows GROUP BY ALL HAVING sum(bytes) > 10000000 AND sum(pkts) < 60000")
predicate("w34_request_filter", lambda: w.request_filter(w.w_proto(6), ip="192.168.0.3", proto=6, port=80, port1=80),
          "prot = 6 AND 3232235523 IN (srcaddr, dstaddr) AND 80 IN (srcport, dstport)",
          wide=False)
_MOS = [MonitoredObject(1, moip="192.168.0.0/28", moport="80", direction="IN"),
        MonitoredObject(2, moip="192.168.0.4", direction="OUT", protocol="TCP", pport=">30000"),
        MonitoredObject(3, moip="!192.168.0.0/27", moport="!22", direction="ALL")]
predicate("w35_object_filter", lambda: w.w_or(*[w.object_filter(m) for m in _MOS]),
          "(dstaddr BETWEEN 3232235520 AND 3232235535 AND dstport = 80) OR (srcaddr = 3232235524 AND prot = 6 "
          "AND dstport > 30000) OR (NOT (srcaddr BETWEEN 3232235520 AND 3232235551 "
          "OR dstaddr BETWEEN 3232235520 AND 3232235551) AND NOT (srcport = 22 OR dstport = 22))", wide=False)
predicate("w36_cidr", lambda: a.in_cidr("srcaddr", "10.0.0.5/29") | a.in_cidr("dstaddr", "192.168.0.30"),
          "srcaddr BETWEEN 167772165 AND 167772172 OR dstaddr = 3232235550", wide=False)


def _v6(column: str) -> Column:
    return F.concat(F.lit("2001:db8::"), F.lower(F.hex(a.shr(column, 16))), F.lit(":"),
                    F.lower(F.hex(F.col(column).bitwiseAND(F.lit(65535)))))


predicate("w37_prefix6", lambda: a.in_prefix6(_v6("srcaddr"), "2001:db8::c0a8:10/124")
          | a.in_prefix6(_v6("dstaddr"), "2001:db8::/96") & a.in_prefix6(_v6("dstaddr"), "2001:db8::a00:0/113"),
          "srcaddr BETWEEN 3232235536 AND 3232235551 OR dstaddr BETWEEN 167772160 AND 167804927", wide=False)
_WORK = Rule(1, weekday=(1, 2, 3, 4, 5), stime=(9, 30, 0), etime=(17, 45, 30))
_OFF = Rule(2, weekday=(0, 1), stime=(8, 0, 0), etime=(18, 0, 0), coverrange="WITHOUT")
_SOD = "((first + 28800) % 86400)"
predicate("w38_schedule", lambda: timefn.schedule_ok("first", _WORK)
          & timefn.schedule_ok("first", _OFF, zone="Asia/Shanghai"),
          f"first % 86400 BETWEEN 34200 AND 63930 AND NOT (dayofweek(make_timestamp((first + 28800) * 1000000)) IN (0, 1)"
          f" AND {_SOD} BETWEEN 28800 AND 64800)", wide=False)
predicate("w38_schedule_exact", lambda: timefn.schedule_ok("first", _WORK, exact=True),
          "(first % 86400) // 3600 BETWEEN 9 AND 17 AND (first % 3600) // 60 BETWEEN 30 AND 45 "
          "AND first % 60 BETWEEN 0 AND 30", wide=False)


def _valid_name(f: DataFrame) -> DataFrame:
    from ..functions.text import is_domain
    rows = f.where(F.col("qname") != "").select(
        is_domain().alias("plain"), is_domain(F.concat(F.lit("-"), "qname")).alias("dashed"),
        is_domain(F.concat("qname", F.lit("."))).alias("dotted"))
    return rows.groupBy("plain", "dashed", "dotted").agg(F.count(F.lit(1)).alias("n"))


on_flows("w39_domain_pattern", _valid_name,
         f"SELECT plain, dashed, dotted, count(*) AS n FROM (SELECT {DOMAIN} AS plain, "
         f"{DOMAIN.replace('qname', chr(39) + '-' + chr(39) + ' || qname', 1)} AS dashed, "
         f"{DOMAIN.replace('qname', 'qname || ' + chr(39) + '.' + chr(39), 1)} AS dotted "
         "FROM flows WHERE qname <> '') t GROUP BY ALL")
_OCT = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
value_counts("w40_address_text", {
    "v4": (lambda: a.is_ipv4_text(F.concat(a.ipv4_str("srcaddr"), F.when(F.col("pkts") > 20, "0").otherwise(""))),
           f"regexp_full_match(concat({ip_sql('srcaddr')}, CASE WHEN pkts > 20 THEN '0' ELSE '' END), "
           f"'{_OCT}(\\.{_OCT}){{3}}')"),
    "cidr": (lambda: a.is_ipv4_cidr_text(F.concat(a.ipv4_str("srcaddr"), F.lit("/"), F.col("pkts").cast("string"))),
             "pkts <= 32"),
    "v6": (lambda: a.is_ipv6_text(F.concat(_v6("srcaddr"), F.when(F.col("pkts") > 20, "::1").otherwise(""))),
           "pkts <= 20")})


def _scan_features(f: DataFrame) -> DataFrame:
    from ..detectors.base import counters
    return f.where((F.col("srcport") != 0) & (F.col("dstport") != 0)).groupBy(
        "srcaddr", "dstaddr", "prot", "dstport").agg(*counters(), F.count_distinct("srcport").alias("peers"))


def _feature_query(f: DataFrame) -> DataFrame:
    feats = _scan_features(f)
    cond = lifecycle.feature_filter(feats, START + 3600, START + 50000, ip=3232235523, proto=6, flows=2, peers=2)
    return feats.where(cond)


on_flows("w41_feature_filter", _feature_query,
         f"""SELECT * FROM (SELECT srcaddr, dstaddr, prot, dstport, min(first) AS first, max(last) AS last,
           count(*) AS flows, CAST(sum(pkts) AS BIGINT) AS pkts, CAST(sum(bytes) AS BIGINT) AS bytes,
           count(DISTINCT srcport) AS peers FROM flows WHERE srcport <> 0 AND dstport <> 0 GROUP BY ALL) t
         WHERE last >= {START + 3600} AND first <= {START + 50000} AND 3232235523 IN (srcaddr, dstaddr)
           AND prot = 6 AND flows >= 2 AND peers >= 2""")


def threat_events(f: DataFrame) -> DataFrame:
    from ..detectors import detect_threats
    from .registry import DAY_SLOTS
    rules = [Rule(7, type_id=13), Rule(9, type_id=13)]
    return detect_threats(f, rules, DAY_SLOTS).events


THREAT_EVENTS = f"""threat_events AS (
  SELECT {event_sql("concat(CASE WHEN lower(threat_type) = 'mining' THEN " + ip_sql('dstaddr') + " ELSE " +
                    ip_sql('srcaddr') + " END, ':>', CASE WHEN lower(threat_type) = 'mining' THEN " + ip_sql('srcaddr')
                    + " ELSE " + ip_sql('dstaddr') + " END, ':', dstport, ' TCP ', lower(threat_type), ' ', "
                    "lower(threat_name))", "0", "count(*)", "'fps'", "3", "13", "config_id", "first - first % 300")}
  FROM flows, (VALUES (7), (9)) r(config_id)
  WHERE threat_type <> '' AND (tos & 1) = 1
  GROUP BY first - first % 300, devid, srcaddr, dstaddr, dstport, prot, lower(threat_type), lower(threat_name), config_id)"""

on_flows("w42_event_query",
         lambda f: lifecycle.query_events(threat_events(f), START + 3600, START + 7200, 13, [9, 11]),
         f"SELECT * FROM threat_events WHERE time >= {START + 3600} AND time < {START + 7200} AND config_id IN (9, 11)",
         THREAT_EVENTS)


def _evidence_of(f: DataFrame) -> DataFrame:
    from ..detectors import detect_threats
    from .registry import DAY_SLOTS
    det = detect_threats(f, [Rule(7, type_id=13)], DAY_SLOTS)
    return lifecycle.query_event_details(det.details, START + 7200, START + 36000, type_id=13).select(
        "time", "type_id", "model_id", "obj", "srcaddr", "srcport", "dstaddr", "dstport", "prot", "flows", "bytes")


on_flows("w43_evidence_query", _evidence_of,
         f"""SELECT CAST(first - first % 300 AS BIGINT) AS time, 13 AS type_id, 3 AS model_id,
           concat(CASE WHEN lower(threat_type) = 'mining' THEN {ip_sql('dstaddr')} ELSE {ip_sql('srcaddr')} END, ':>',
             CASE WHEN lower(threat_type) = 'mining' THEN {ip_sql('srcaddr')} ELSE {ip_sql('dstaddr')} END, ':', dstport,
             ' TCP ', lower(threat_type), ' ', lower(threat_name)) AS obj,
           srcaddr, srcport, dstaddr, dstport, prot, count(*) AS flows, CAST(sum(bytes) AS BIGINT) AS bytes
         FROM flows WHERE threat_type <> '' AND (tos & 1) = 1
           AND first - first % 300 BETWEEN {START + 7200} AND {START + 36000} GROUP BY ALL""")


def packets(spark, sf: str) -> DataFrame:
    """Decoded packets derived from the ``events`` table."""
    ev = fixtures.table(spark, sf, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return ev.select(
        F.call_function("div", micros, F.lit(1000000)).alias("time_sec"), (micros % 1000000).alias("time_usec"),
        (F.lit(167772160) + F.col("user_id") % 256).alias("sip"),
        (F.lit(3232235520) + F.col("event_id") % 64).alias("dip"),
        (F.lit(20000) + F.col("event_id") % 1000).cast("int").alias("sport"),
        F.lit(80).alias("dport"), F.lit(6).alias("protocol"), F.col("props").alias("payload"))


PACKETS_SQL = """packets AS (SELECT epoch_us(ts) // 1000000 AS time_sec, epoch_us(ts) % 1000000 AS time_usec,
  167772160 + user_id % 256 AS sip, 3232235520 + event_id % 64 AS dip,
  CAST(20000 + event_id % 1000 AS INTEGER) AS sport, 80 AS dport, 6 AS protocol, props AS payload FROM events)"""


def _packet_lookup(spark, sf: str) -> DataFrame:
    p = packets(spark, sf)
    at = p.select(F.min(F.struct("time_sec", "time_usec")).alias("m")).first().m
    return lifecycle.packet_evidence(p, at.time_sec, at.time_usec)


register("w44_packet_lookup", _packet_lookup,
         f"WITH {PACKETS_SQL} SELECT * FROM packets WHERE time_sec * 1000000 + time_usec = "
         "(SELECT min(time_sec * 1000000 + time_usec) FROM packets)")


# All predicates counted in one pass.
_COUNTS = {"tcp": (lambda: w.w_proto("tcp"), "prot = 6"), "low_port": (lambda: w.w_port(1024, cmp="<"),
                                                                       "srcport < 1024 OR dstport < 1024"),
           "requests": (lambda: w.w_tos(1), "tos = 1"), "resets": (lambda: w.w_flags("AR"), "(tcp_flags & 20) = 20"),
           "named": (lambda: w.w_l7(qname="") == F.lit(False), "qname <> ''"),
           "servers": (lambda: w.w_net("192.168/16", side="dst"), "dstaddr BETWEEN 3232235520 AND 3232301055")}
on_flows("w_counts", lambda f: f.agg(*[F.count(F.when(c(), 1)).alias(n) for n, (c, _) in _COUNTS.items()]),
         "SELECT " + ", ".join(f"count(CASE WHEN {s} THEN 1 END) AS {n}" for n, (_, s) in _COUNTS.items())
         + " FROM flows")
