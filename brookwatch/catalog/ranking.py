"""Orders, Top-N and window-style operators (T, V)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..detectors.base import RUN, counters
from ..operators import aggregate as ag
from ..operators import merges, topn
from .aggregates import _RATES, element_sql
from .registry import COUNTERS, DAY, RECOUNT, START, on_flows


_SRC = f"(SELECT *, {_RATES} FROM {element_sql('srcaddr AS value')} e)"
for _o, _c in (("flows", "flows DESC"), ("packets", "pkts DESC"), ("bytes", "bytes DESC"), ("pps", "pps DESC"),
               ("bps", "bps DESC"), ("bpp", "bpp DESC"), ("tstart", "first_ms"), ("tend", "last_ms")):
    on_flows(f"t1_order_{_o}", lambda f, o=_o: topn.order_flows(topn.element_stat(f, "srcip"), o),
             f"SELECT * FROM {_SRC} s ORDER BY {_c}, value")
on_flows("t2_top_srcip", lambda f: topn.top_n(f, "srcip", "bytes", 10),
         f"SELECT * FROM {_SRC} s ORDER BY bytes DESC, value LIMIT 10")
on_flows("t2_top_port_by_proto", lambda f: topn.top_n(f, "port", "packets", 20, by_proto=True),
         "SELECT *, " + _RATES + " FROM " + element_sql("value, prot", "(SELECT srcport AS value, * FROM flows UNION ALL "
         "SELECT dstport, * FROM flows WHERE srcport <> dstport) v") + " e ORDER BY pkts DESC, value, prot LIMIT 20")
on_flows("t2_all_in_order", lambda f: topn.top_n(f, "dstip", "flows", 0),
         f"SELECT *, {_RATES} FROM {element_sql('dstaddr AS value')} e")
on_flows("t3_top_records", lambda f: topn.top_flows(f, "bytes", 15),
         f"""SELECT *, {_RATES} FROM (SELECT srcaddr, srcport, dstaddr, dstport, prot,
             min(first * 1000 + msec_first) AS first_ms, max(last * 1000 + msec_last) AS last_ms,
             CAST(sum(pkts) AS BIGINT) AS pkts, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(0 AS BIGINT) AS out_pkts,
             CAST(0 AS BIGINT) AS out_bytes, count(*) AS flows, bit_or(tcp_flags) AS tcp_flags FROM flows GROUP BY ALL) t
         ORDER BY bytes DESC, srcaddr, srcport, dstaddr, dstport, prot, out_pkts, out_bytes, tcp_flags LIMIT 15""")
_FLOW_COLS = "first, msec_first, srcaddr, srcport, dstaddr, dstport, prot"
on_flows("t4_first_flows", lambda f: topn.limit_flows(f.select(*topn.FLOW_ORDER, "pkts", "bytes"), 50),
         f"SELECT {_FLOW_COLS}, pkts, bytes FROM flows ORDER BY {_FLOW_COLS}, pkts, bytes LIMIT 50")
on_flows("t5_sorted_flows", lambda f: topn.sort_flows(f.select(*topn.FLOW_ORDER, "pkts", "bytes")),
         f"SELECT {_FLOW_COLS}, pkts, bytes FROM flows")

_NULLS = {c: f"CAST(NULL AS {t.upper().replace('INT', 'INTEGER') if t == 'int' else 'BIGINT'}) AS {c}"
          for c, t in topn.TOPN_COLUMNS.items()}


def _topn_sql(step: int, metric: str, limit: int, parts: list[tuple[str, str, dict[str, str], str]]) -> str:
    """Totals plus ranked parts: (type, key columns, output names, source)."""
    sums = "count(*) AS flows, CAST(sum(pkts) AS BIGINT) AS pkts, CAST(sum(bytes) AS BIGINT) AS bytes"
    out = [f"SELECT first - first % {step} AS time, 'ALL' AS type, {', '.join(_NULLS.values())}, {sums} "
           "FROM flows GROUP BY ALL"]
    for kind, keys, names, source in parts:
        cols = ", ".join(f"CAST({names[c]} AS {'INTEGER' if t == 'int' else 'BIGINT'}) AS {c}" if c in names
                         else _NULLS[c] for c, t in topn.TOPN_COLUMNS.items())
        out.append(f"SELECT time, '{kind}' AS type, {cols}, flows, pkts, bytes FROM (SELECT *, row_number() OVER "
                   f"(PARTITION BY time ORDER BY {metric} DESC, {keys}) AS rn FROM (SELECT first - first % {step} AS time, "
                   f"{keys}, {sums} FROM {source} GROUP BY ALL) a) b WHERE rn <= {limit}")
    return " UNION ALL ".join(out)


_EITHER_IP = ("(SELECT srcaddr AS value, * FROM flows UNION ALL SELECT dstaddr, * FROM flows WHERE srcaddr <> dstaddr) v")
on_flows("t6_topn_conv", lambda f: topn.topn_by_step(f, "CONV", "Bytes", step=3600, limit=10),
         _topn_sql(3600, "bytes", 10, [("CONV", "srcaddr, srcport, dstaddr, dstport, prot", {
             "sip": "srcaddr", "sport": "srcport", "dip": "dstaddr", "dport": "dstport", "protocol": "prot"}, "flows")]))
on_flows("t6_topn_all", lambda f: topn.topn_by_step(f, "ALL", step=300), _topn_sql(300, "bytes", 1, []))
on_flows("t6_topn_large_limit", lambda f: topn.topn_by_step(f, "CONV", "Packets", step=43200, limit=2000),
         _topn_sql(43200, "pkts", 2000, [("CONV", "srcaddr, srcport, dstaddr, dstport, prot", {
             "sip": "srcaddr", "sport": "srcport", "dip": "dstaddr", "dport": "dstport", "protocol": "prot"}, "flows")]))
on_flows("t7_ip_srcdst", lambda f: topn.topn_by_step(f, "IP", "Flows", "srcdst", 3600, 5),
         _topn_sql(3600, "flows", 5, [("SIP", "value", {"sip": "value"}, "(SELECT srcaddr AS value, * FROM flows) v"),
                                      ("DIP", "value", {"dip": "value"}, "(SELECT dstaddr AS value, * FROM flows) v")]))
on_flows("t7_ip_either", lambda f: topn.topn_by_step(f, "IP", "Bytes", "", 3600, 5),
         _topn_sql(3600, "bytes", 5, [("IP", "value", {"ip": "value"}, _EITHER_IP)]))
on_flows("t7_port_dst", lambda f: topn.topn_by_step(f, "PORT", "Packets", "dst", 3600, 5),
         _topn_sql(3600, "pkts", 5, [("DPORT", "value, prot", {"dport": "value", "protocol": "prot"},
                                      "(SELECT dstport AS value, * FROM flows) v")]))
on_flows("t7_as_src", lambda f: topn.topn_by_step(f, "AS", "Bytes", "src", 3600, 3),
         _topn_sql(3600, "bytes", 3, [("SAS", "value", {"sas": "value"}, "(SELECT srcas AS value, * FROM flows) v")]),
         wide=True)
on_flows("t7_proto", lambda f: topn.topn_by_step(f, "PROTO", "Bytes", "", 3600, 3),
         _topn_sql(3600, "bytes", 3, [("PROTO", "value", {"protocol": "value"}, "(SELECT prot AS value, * FROM flows) v")]))
on_flows("t7_inif", lambda f: topn.topn_by_step(f, "INIF", "Bytes", "", 3600, 3),
         _topn_sql(3600, "bytes", 3, [("INIF", "value", {"inif": "value"}, "(SELECT input AS value, * FROM flows) v")]),
         wide=True)
on_flows("t7_outif", lambda f: topn.topn_by_step(f, "OUTIF", "Bytes", "", 3600, 3),
         _topn_sql(3600, "bytes", 3, [("OUTIF", "value", {"outif": "value"}, "(SELECT output AS value, * FROM flows) v")]),
         wide=True)
on_flows("t7_raw", lambda f: topn.topn_by_step(f, "RAW", "Bytes", "", 3600, 4).select(
    "time", "type", "sip", "sport", "dip", "dport", "protocol", "flows", "pkts", "bytes"),
         f"""SELECT first - first % 3600 AS time, 'ALL' AS type, CAST(NULL AS BIGINT) AS sip, CAST(NULL AS INTEGER) AS sport,
           CAST(NULL AS BIGINT) AS dip, CAST(NULL AS INTEGER) AS dport, CAST(NULL AS INTEGER) AS protocol, count(*) AS flows,
           CAST(sum(pkts) AS BIGINT) AS pkts, CAST(sum(bytes) AS BIGINT) AS bytes FROM flows GROUP BY ALL
         UNION ALL SELECT time, 'RAW', srcaddr, srcport, dstaddr, dstport, prot, 1, pkts, bytes FROM
           (SELECT first - first % 3600 AS time, *, row_number() OVER (PARTITION BY first - first % 3600
              ORDER BY {_FLOW_COLS}, last, pkts, bytes) AS rn FROM flows) t WHERE rn <= 4""")

_LONG_PORTS = """long_ports AS (SELECT prot, dstport, unnest(['flows', 'pkts', 'bytes']) AS metric,
    unnest([count(*), CAST(sum(pkts) AS BIGINT), CAST(sum(bytes) AS BIGINT)]) AS count
    FROM flows WHERE prot IN (6, 17) GROUP BY prot, dstport)"""
on_flows("t8_top_ports", lambda f: topn.top_ports(ag.port_table(f), 10),
         """SELECT prot, dstport, metric, count FROM (SELECT *, row_number() OVER (PARTITION BY prot, metric
           ORDER BY count DESC, dstport) AS rn FROM long_ports) t WHERE rn <= 10""", _LONG_PORTS)
on_flows("t8_daily_average", lambda f: topn.top_ports(ag.port_table(f), 10, scale=True),
         """SELECT prot, dstport, metric, count FROM (SELECT *, row_number() OVER (PARTITION BY prot, metric
           ORDER BY count DESC, dstport) AS rn FROM (SELECT prot, dstport, metric, count // (SELECT
             count(DISTINCT first - first % 300) FROM flows WHERE prot IN (6, 17)) AS count FROM long_ports) s) t
           WHERE rn <= 10""", _LONG_PORTS)


def _pairs(f: DataFrame) -> DataFrame:
    """Hourly rows per pair: the rows the interval merge works on."""
    from ..functions.timefn import truncate
    return f.groupBy("srcaddr", "dstaddr", "prot", truncate("first", 600).alias("slot")).agg(*counters())


_PAIRS = (f"pairs AS (SELECT srcaddr, dstaddr, prot, first - first % 600 AS slot, {COUNTERS} FROM flows "
          "GROUP BY srcaddr, dstaddr, prot, first - first % 600)")
_ISLANDS = """islands AS (SELECT *, sum(fresh) OVER (PARTITION BY srcaddr, dstaddr, prot ORDER BY first, slot
    ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN max(last) OVER (PARTITION BY srcaddr, dstaddr, prot
      ORDER BY first, slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 3600 >= first THEN 0 ELSE 1 END AS fresh
    FROM pairs) t)"""
on_flows("v2_gap_merge", lambda f: merges.merge_gaps(_pairs(f), ["srcaddr", "dstaddr", "prot"]),
         f"SELECT srcaddr, dstaddr, prot, {RECOUNT} FROM islands GROUP BY srcaddr, dstaddr, prot, island",
         f"{_PAIRS}, {_ISLANDS}")
on_flows("v3_merge_all", lambda f: merges.merge_all(_pairs(f), ["srcaddr", "dstaddr", "prot"]),
         f"SELECT srcaddr, dstaddr, prot, {RECOUNT} FROM pairs GROUP BY srcaddr, dstaddr, prot", _PAIRS)


def _first_names(f: DataFrame) -> DataFrame:
    rows = DAY.clip(f).where(F.col("qname") != "").select(
        *RUN, "qname", "first", "msec_first", "srcaddr", "dstaddr", "srcport", "last", "pkts", "bytes")
    return merges.first_seen(rows, "qname", RUN)


on_flows("v4_first_seen", _first_names,
         f"""SELECT CAST({START} AS BIGINT) AS time, devid, qname, first, msec_first, srcaddr, dstaddr, srcport, last, pkts,
           bytes FROM (SELECT *, row_number() OVER (PARTITION BY devid, qname ORDER BY first, msec_first, srcaddr,
             dstaddr, srcport, last, pkts, bytes) AS rn FROM flows WHERE qname <> '') t WHERE rn = 1""")
on_flows("v5_sliding_ports", lambda f: merges.sliding_port_stats(ag.port_table(f), width=7200),
         """SELECT slot, prot, dstport, CAST(sum(flows) OVER w AS BIGINT) AS flows, CAST(sum(pkts) OVER w AS BIGINT) AS pkts,
           CAST(sum(bytes) OVER w AS BIGINT) AS bytes FROM ports
         WINDOW w AS (PARTITION BY prot, dstport ORDER BY slot RANGE BETWEEN 6900 PRECEDING AND CURRENT ROW)""",
         """ports AS (SELECT first - first % 300 AS slot, prot, dstport, count(*) AS flows, sum(pkts) AS pkts,
           sum(bytes) AS bytes FROM flows WHERE prot IN (6, 17) GROUP BY ALL)""")


def _gappy_ports(f: DataFrame) -> DataFrame:
    """Port table with the slots of hours 7 and 15 missing, so totals restart."""
    return ag.port_table(f.where(~((F.col("first") % 86400 - F.col("first") % 3600) / 3600).isin(7, 15)))


on_flows("v5_sliding_restart", lambda f: merges.sliding_port_stats(_gappy_ports(f)),
         """SELECT slot, prot, dstport, CAST(sum(flows) OVER w AS BIGINT) AS flows, CAST(sum(pkts) OVER w AS BIGINT) AS pkts,
           CAST(sum(bytes) OVER w AS BIGINT) AS bytes FROM ports
         WINDOW w AS (PARTITION BY prot, dstport, era ORDER BY slot RANGE BETWEEN 86100 PRECEDING AND CURRENT ROW)""",
         """ports AS (SELECT first - first % 300 AS slot, prot, dstport,
           CASE WHEN first % 86400 < 25200 THEN 0 WHEN first % 86400 < 54000 THEN 1 ELSE 2 END AS era,
           count(*) AS flows, sum(pkts) AS pkts, sum(bytes) AS bytes FROM flows
           WHERE prot IN (6, 17) AND first % 86400 // 3600 NOT IN (7, 15) GROUP BY ALL)""")
