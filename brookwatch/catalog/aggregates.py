"""Aggregations (A)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggregate as ag
from ..operators import topn
from .registry import COUNTERS, END, REQ, SPAN, START, on_flows

_SUMS = ("CAST(sum(pkts) AS BIGINT) AS pkts, CAST(sum(bytes) AS BIGINT) AS bytes, "
         "CAST(sum(out_pkts) AS BIGINT) AS out_pkts, CAST(sum(out_bytes) AS BIGINT) AS out_bytes, "
         "CAST(sum(aggr_flows) AS BIGINT) AS flows, bit_or(tcp_flags) AS tcp_flags")
_NARROW = ("CAST(sum(pkts) AS BIGINT) AS pkts, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(0 AS BIGINT) AS out_pkts, "
           "CAST(0 AS BIGINT) AS out_bytes, count(*) AS flows, bit_or(tcp_flags) AS tcp_flags")

on_flows("a1_five_tuple", ag.aggregate_flows,
         f"SELECT srcaddr, srcport, dstaddr, dstport, prot, {SPAN}, {_NARROW} FROM flows GROUP BY ALL")
on_flows("a1_preaggregated", ag.aggregate_flows,
         f"SELECT srcaddr, srcport, dstaddr, dstport, prot, {SPAN}, {_SUMS} FROM flows GROUP BY ALL", wide=True)

_CUSTOM = {"srcas": "srcas", "dstport": "dstport", "proto": "prot", "tos": "tos", "router": "ip_router",
           "inif": "input", "mpls1": "mpls1 >> 4", "insrcmac": "in_src_mac"}
on_flows("a2_custom_fields", lambda f: ag.aggregate_flows(f, by=list(_CUSTOM)),
         "SELECT " + ", ".join(f"{c} AS {n}" for n, c in _CUSTOM.items()) + f", {SPAN}, {_SUMS} FROM flows GROUP BY ALL",
         wide=True)
_CUSTOM2 = {"srcip": "srcaddr", "next": "ip_nexthop", "bgpnext": "bgp_nexthop", "nextas": "next_as",
            "prevas": "prev_as", "dstas": "dstas", "outif": "output", "srcvlan": "src_vlan", "dstvlan": "dst_vlan",
            "srcmask": "src_mask", "dstmask": "dst_mask", "dsttos": "dst_tos", "outdstmac": "out_dst_mac",
            "indstmac": "in_dst_mac", "outsrcmac": "out_src_mac", "mpls2": "mpls2 >> 4", "dstip": "dstaddr",
            "srcport": "srcport", "srctos": "tos"}
on_flows("a2_all_fields", lambda f: ag.aggregate_flows(f, by=list(_CUSTOM2)),
         "SELECT " + ", ".join(f"{c} AS {n}" for n, c in _CUSTOM2.items()) + f", {SPAN}, {_SUMS} FROM flows GROUP BY ALL",
         wide=True)
on_flows("a3_subnets", lambda f: ag.aggregate_flows(f, by=["srcip4/28", "dstip4/30", "proto"]),
         f"SELECT (srcaddr >> 4) << 4 AS srcip4, (dstaddr >> 2) << 2 AS dstip4, prot AS proto, {SPAN}, {_NARROW} "
         "FROM flows GROUP BY ALL")


def _v6_flows(f: DataFrame) -> DataFrame:
    """The same flows with IPv6 addresses: 2001:db8::<v4> as text."""
    from .predicates import _v6
    return f.withColumns({"srcaddr": _v6("srcaddr"), "dstaddr": _v6("dstaddr")})


on_flows("a3_subnets_v6", lambda f: ag.aggregate_flows(_v6_flows(f), by=["dstip6/124", "proto"]),
         "SELECT replace(concat('2001:db8::', lower(to_hex(dstaddr >> 16)), ':', "
         "lower(to_hex((dstaddr & 65535) >> 4 << 4))), ':0', ':0') AS dstip6, prot AS proto, "
         f"{SPAN}, {_NARROW} FROM flows GROUP BY ALL")
on_flows("a4_record_mask", lambda f: ag.aggregate_flows(f, by=["srcnet", "dstnet"]),
         "SELECT (srcaddr >> (32 - src_mask)) << (32 - src_mask) AS srcnet, "
         f"(dstaddr >> (32 - dst_mask)) << (32 - dst_mask) AS dstnet, {SPAN}, {_SUMS} FROM flows GROUP BY ALL",
         wide=True)

_BIDIR = f"""marked AS (SELECT *, prot IN (6, 17) AND (srcaddr > dstaddr OR (srcaddr = dstaddr AND srcport > dstport)) AS back
    FROM flows),
  paired AS (SELECT CASE WHEN back THEN dstaddr ELSE srcaddr END AS la, CASE WHEN back THEN dstport ELSE srcport END AS lp,
      CASE WHEN back THEN srcaddr ELSE dstaddr END AS ha, CASE WHEN back THEN srcport ELSE dstport END AS hp, prot,
      min((first * 1000 + msec_first) * 2 + CASE WHEN back THEN 1 ELSE 0 END) % 2 = 1 AS lead_back, {SPAN},
      CAST(sum(CASE WHEN back THEN 0 ELSE pkts END) AS BIGINT) AS fp, CAST(sum(CASE WHEN back THEN 0 ELSE bytes END) AS BIGINT) AS fb,
      CAST(sum(CASE WHEN back THEN pkts ELSE 0 END) AS BIGINT) AS rp, CAST(sum(CASE WHEN back THEN bytes ELSE 0 END) AS BIGINT) AS rb,
      count(*) AS flows, bit_or(tcp_flags) AS tcp_flags FROM marked GROUP BY la, lp, ha, hp, prot)"""
on_flows("a5_bidirectional", lambda f: ag.aggregate_flows(f, bidir=True),
         """SELECT CASE WHEN lead_back THEN ha ELSE la END AS srcaddr, CASE WHEN lead_back THEN hp ELSE lp END AS srcport,
           CASE WHEN lead_back THEN la ELSE ha END AS dstaddr, CASE WHEN lead_back THEN lp ELSE hp END AS dstport, prot,
           first_ms, last_ms, CASE WHEN lead_back THEN rp ELSE fp END AS pkts, CASE WHEN lead_back THEN rb ELSE fb END AS bytes,
           CASE WHEN lead_back THEN fp ELSE rp END AS out_pkts, CASE WHEN lead_back THEN fb ELSE rb END AS out_bytes,
           flows, tcp_flags FROM paired""", _BIDIR)
on_flows("a6_guess_direction",
         lambda f: (ag.guess_direction(f).groupBy("srcaddr", "srcport", "dstaddr", "input", "srcas")
                    .agg(F.count(F.lit(1)).alias("n"), F.sum("pkts").alias("pkts"), F.sum("out_bytes").alias("out_bytes"))),
         """SELECT CASE WHEN s THEN dstaddr ELSE srcaddr END AS srcaddr, CASE WHEN s THEN dstport ELSE srcport END AS srcport,
           CASE WHEN s THEN srcaddr ELSE dstaddr END AS dstaddr, CASE WHEN s THEN output ELSE input END AS input,
           CASE WHEN s THEN dstas ELSE srcas END AS srcas, count(*) AS n,
           CAST(sum(CASE WHEN s THEN out_pkts ELSE pkts END) AS BIGINT) AS pkts,
           CAST(sum(CASE WHEN s THEN bytes ELSE out_bytes END) AS BIGINT) AS out_bytes
         FROM (SELECT *, srcport < 1024 AND dstport > 1024 AS s FROM flows) t GROUP BY ALL""", wide=True)

_RATES = ("coalesce(1000 * pkts // nullif(last_ms - first_ms, 0), 0) AS pps, "
          "coalesce(8000 * bytes // nullif(last_ms - first_ms, 0), 0) AS bps, "
          "coalesce(bytes // nullif(pkts, 0), 0) AS bpp")


def element_sql(keys: str, source: str = "flows") -> str:
    """Statistic rows of grouping expressions ``keys``."""
    return (f"(SELECT {keys}, {SPAN}, count(*) AS flows, CAST(sum(pkts) AS BIGINT) AS pkts, "
            f"CAST(sum(bytes) AS BIGINT) AS bytes FROM {source} GROUP BY ALL)")


def _element(name: str, element: str, source: str, by_proto: bool = False, wide: bool = True) -> None:
    keys = "value, prot" if by_proto else "value"
    on_flows(name, lambda f: topn.element_stat(f, element, by_proto),
             f"SELECT *, {_RATES} FROM {element_sql(keys, source)} e", wide=wide)


def _one(column: str) -> str:
    return f"(SELECT {column} AS value, * FROM flows) v"


def _two(a: str, b: str) -> str:
    return f"(SELECT {a} AS value, * FROM flows UNION ALL SELECT {b} AS value, * FROM flows WHERE {a} <> {b}) v"


_element("a7_srcip", "srcip", _one("srcaddr"), wide=False)
_element("a7_dstport", "dstport", _one("dstport"), wide=False)
for _e, _c in (("nhip", "ip_nexthop"), ("router", "ip_router"), ("srctos", "tos"), ("dir", "dir"), ("nextas", "next_as"),
               ("inif", "input"), ("dstmask", "dst_mask"), ("srcvlan", "src_vlan"), ("insrcmac", "in_src_mac"),
               ("mpls1", "mpls1 >> 4"), ("mpls2", "mpls2 >> 4"), ("cl", "client_latency")):
    _element(f"a7_{_e}", _e, _one(_c))
_element("a8_ip", "ip", _two("srcaddr", "dstaddr"), wide=False)
_element("a8_port", "port", _two("srcport", "dstport"), wide=False)
for _e, _a, _b in (("as", "srcas", "dstas"), ("if", "input", "output"), ("mask", "src_mask", "dst_mask"),
                   ("vlan", "src_vlan", "dst_vlan"), ("srcmac", "in_src_mac", "out_src_mac"),
                   ("inmac", "in_src_mac", "in_dst_mac")):
    _element(f"a8_{_e}", _e, _two(_a, _b))
_element("a9_port_by_proto", "port", _two("srcport", "dstport"), by_proto=True, wide=False)
on_flows("a10_rates", lambda f: ag.with_rates(ag.aggregate_flows(f, by=["srcip", "dstip"])),
         f"SELECT *, {_RATES} FROM (SELECT srcaddr AS srcip, dstaddr AS dstip, {SPAN}, {_NARROW} FROM flows GROUP BY ALL) t")


def _percent(f: DataFrame) -> DataFrame:
    stat = topn.element_stat(f, "dstport").select("value", "flows", "pkts", "bytes")
    return ag.with_percent(stat, f)


on_flows("a11_percent", _percent,
         """SELECT dstport AS value, count(*) AS flows, CAST(sum(pkts) AS BIGINT) AS pkts, CAST(sum(bytes) AS BIGINT) AS bytes,
           count(*) * 10000 // (SELECT count(*) FROM flows) AS flows_pct,
           CAST(sum(pkts) * 10000 // (SELECT sum(pkts) FROM flows) AS BIGINT) AS pkts_pct,
           CAST(sum(bytes) * 10000 // (SELECT sum(bytes) FROM flows) AS BIGINT) AS bytes_pct FROM flows GROUP BY ALL""")
on_flows("a12_summary", ag.summary,
         f"SELECT flows, bytes, pkts, bps AS avg_bps, pps AS avg_pps, bpp AS avg_bpp FROM (SELECT *, {_RATES} FROM "
         f"(SELECT {SPAN}, count(*) AS flows, CAST(sum(pkts) AS BIGINT) AS pkts, CAST(sum(bytes) AS BIGINT) AS bytes "
         "FROM flows) t) u")

_CLASSES = {"tcp": "prot = 6", "udp": "prot = 17", "icmp": "prot IN (1, 58)", "other": "prot NOT IN (1, 6, 17, 58)"}
_SPLIT = ", ".join(
    f"count(CASE WHEN {c} THEN 1 END) AS flows_{n}, CAST(sum(CASE WHEN {c} THEN pkts ELSE 0 END) AS BIGINT) AS pkts_{n}, "
    f"CAST(sum(CASE WHEN {c} THEN bytes ELSE 0 END) AS BIGINT) AS bytes_{n}" for n, c in _CLASSES.items())
_ALL = ("count(*) AS flows, CAST(sum(pkts) AS BIGINT) AS pkts, CAST(sum(bytes) AS BIGINT) AS bytes")
on_flows("a13_slot_stats", ag.slot_stats,
         f"SELECT devid, first - first % 300 AS slot, {SPAN}, {_ALL}, {_SPLIT} FROM flows GROUP BY ALL")
on_flows("a14_merge_stats", lambda f: ag.merge_stats(ag.slot_stats(f)),
         f"SELECT devid, {SPAN}, {_ALL}, {_SPLIT} FROM flows GROUP BY ALL")
on_flows("a15_port_histogram", ag.port_histogram,
         "SELECT prot, side, bucket, count(*) AS flows FROM (SELECT prot, 'src' AS side, srcport AS bucket FROM flows "
         "UNION ALL SELECT prot, 'dst', dstport FROM flows) t WHERE prot IN (6, 17) GROUP BY ALL")
on_flows("a16_bpp_histogram", ag.bpp_histogram,
         "SELECT prot, least(coalesce(bytes // nullif(pkts, 0), 0), 9000) AS bucket, count(*) AS flows FROM flows "
         "WHERE prot IN (6, 17) GROUP BY ALL")
on_flows("a17_port_table", ag.port_table,
         f"SELECT first - first % 300 AS slot, prot, dstport, {_ALL} FROM flows WHERE prot IN (6, 17) GROUP BY ALL")


def _exporters(f: DataFrame) -> DataFrame:
    seq = F.col("bytes") % 100
    return ag.exporter_stats(f.withColumns({"sequence": seq, "expected_sequence": F.greatest(seq, F.lit(3))}))


on_flows("a18_exporter_stats", _exporters,
         f"SELECT exporter_sysid, {_ALL}, count(CASE WHEN bytes % 100 < 3 THEN 1 END) AS sequence_failures "
         "FROM flows GROUP BY ALL", wide=True)
on_flows("a19_peer_counts", lambda f: ag.peer_counts(f, ["srcaddr", "prot", "dstport"], "dstaddr"),
         "SELECT srcaddr, prot, dstport, count(DISTINCT dstaddr) AS peers FROM flows GROUP BY ALL")


def _attr_sql(key: str, source: str) -> str:
    parts = []
    for cols in ag.ATTRIBUTE_GROUPS.values():
        for c in cols:
            order = ", ".join(["last DESC"] + [f"{x} DESC" for x in cols])
            parts.append(f"first({c} ORDER BY {order}) FILTER (WHERE {cols[0]} <> '') AS {c}")
    return f"SELECT {key}, {', '.join(parts)} FROM {source} GROUP BY {key}"


on_flows("a20_latest_attrs", lambda f: ag.latest_attrs(f, ["dstaddr", "dstport", "prot"]),
         _attr_sql("dstaddr, dstport, prot", "flows"), wide=True)


def _mo_hourly(f: DataFrame) -> DataFrame:
    from ..detectors import object_traffic
    from ..rules import MonitoredObject
    return object_traffic(f, [MonitoredObject(1, moip="192.168.0.0/28", direction="IN"),
                              MonitoredObject(2, moport="53", direction="ALL")])


_MO_SLOTS = f"""mo AS (SELECT 1 AS moid, * FROM flows WHERE dstaddr BETWEEN 3232235520 AND 3232235535
    UNION ALL SELECT 2, * FROM flows WHERE srcport = 53 OR dstport = 53),
  mo_slots AS (SELECT devid, moid, first - first % 300 AS slot, {COUNTERS} FROM mo GROUP BY devid, moid, first - first % 300)"""
on_flows("a21_object_peaks", _mo_hourly,
         """SELECT devid, moid, slot - slot % 3600 AS hour, min(first) AS first, max(last) AS last,
           CAST(sum(flows) AS BIGINT) AS flows, CAST(sum(pkts) AS BIGINT) AS pkts, CAST(sum(bytes) AS BIGINT) AS bytes,
           max(flows) AS peak_flows, max(pkts) AS peak_pkts, max(bytes) AS peak_bytes FROM mo_slots GROUP BY ALL""",
         _MO_SLOTS)


def _details(f: DataFrame) -> DataFrame:
    from ..detectors import detect_port_scan
    from ..rules import Rule
    from .registry import DAY
    det = detect_port_scan(f, [Rule(1, type_id=2, min=15, port="22", protocol="TCP")], [], DAY)
    return det.details


on_flows("a22_event_details", _details,
         f"""SELECT CAST({START} AS BIGINT) AS time, 2 AS type_id, 0 AS model_id,
           concat((srcaddr >> 24) & 255, '.', (srcaddr >> 16) & 255, '.', (srcaddr >> 8) & 255, '.', srcaddr & 255,
             ':>:22 TCP ') AS obj, srcaddr, srcport, dstaddr, dstport, prot, {COUNTERS}
         FROM flows f WHERE srcport <> 0 AND dstport = 22 AND prot = 6 AND {REQ} AND first < {END}
           AND srcaddr IN (SELECT srcaddr FROM flows WHERE srcport <> 0 AND dstport = 22 AND prot = 6 AND {REQ}
             GROUP BY srcaddr HAVING count(DISTINCT dstaddr) >= 15) GROUP BY ALL""")
