"""Sources and sinks (S): written, read back and compared."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..detectors.base import counters
from ..functions.predicates import w_bytes, w_port, w_proto
from ..functions.timefn import align_range, truncate
from ..operators.aggregate import aggregate_flows
from ..plans import lifecycle as lc
from ..sources import exports, flowtable, lists, textflows
from .lifecycle import _HOURS_SQL, _KEY, _SLOTS, slot_features
from .predicates import PACKETS_SQL, THREAT_EVENTS, packets, threat_events
from .ranking import _FLOW_COLS
from .registry import COUNTERS, END, START, folder, ip_sql, on_flows, register


def stored(f: DataFrame, devices: int = 1) -> tuple:
    """The flows written as a table, spread over a number of devices."""
    path = folder(f)
    if devices > 1:
        f = f.withColumn("devid", (F.col("srcaddr") % devices + 1).cast("int"))
    flowtable.write_flows(f, path, files_per_day=8)
    return f.sparkSession, path


def _per_prot(f: DataFrame) -> DataFrame:
    return f.groupBy("prot").agg(*counters())


on_flows("s1_slot_range",
         lambda f: _per_prot(flowtable.read_flows(*stored(f), devid=1, start=START + 7200, end=START + 14400)),
         f"SELECT prot, {COUNTERS} FROM flows WHERE first - first % 300 BETWEEN {START + 7200} AND {START + 14400} GROUP BY prot")
on_flows("s2_several_devices",
         lambda f: flowtable.read_flows(*stored(f, 4), devids=[1, 3]).groupBy("devid", "prot").agg(*counters()),
         f"SELECT CAST(srcaddr % 4 + 1 AS INTEGER) AS devid, prot, {COUNTERS} FROM flows WHERE srcaddr % 4 IN (0, 2) "
         "GROUP BY srcaddr % 4, prot")


def _clamped(f: DataFrame) -> DataFrame:
    rows = flowtable.with_partitions(f.where(F.col("first") % 86400 >= 5000))
    lo, hi = flowtable.clamp_range(rows, START, START + 20000)
    return _per_prot(rows.where(F.col("slot").between(lo, hi))).withColumns(
        {"lo": F.lit(lo).cast("bigint"), "hi": F.lit(hi).cast("bigint")})


on_flows("s3_clamp_range", _clamped,
         f"SELECT prot, {COUNTERS}, (SELECT min(s) FROM k) AS lo, (SELECT max(s) FROM k) AS hi FROM k GROUP BY prot",
         f"k AS (SELECT *, first - first % 300 AS s FROM flows WHERE first % 86400 >= 5000 AND first - first % 300 <= {START + 20000})")


def _aligned(f: DataFrame) -> DataFrame:
    latest = f.agg(F.max("first")).first()[0]
    start, end, step = align_range(START + 1234, END + 99999, 1000, latest=latest)
    rows = f.where((F.col("first") >= start) & (F.col("first") < end))
    return rows.groupBy((F.col("first") - F.col("first") % step).alias("time")).agg(*counters())


on_flows("s4_align_range", _aligned,
         f"SELECT first - first % 900 AS time, {COUNTERS} FROM flows WHERE first >= {START + 1200} "
         "AND first < (SELECT max(first) FROM flows) // 300 * 300 GROUP BY first - first % 900")
on_flows("s5_time_window",
         lambda f: _per_prot(flowtable.read_flows(*stored(f), window=(START + 10000, START + 30000))),
         f"SELECT prot, {COUNTERS} FROM flows WHERE first >= {START + 10000} AND last <= {START + 30000} GROUP BY prot")


def _pipe_back(f: DataFrame) -> DataFrame:
    path = folder(f)
    textflows.write_pipe(f, path)
    back = textflows.read_pipe_flows(f.sparkSession, path)
    return back.select("af", "first", "msec_first", "srcaddr", "sip", "srcport", "dip", "dstport", "prot", "pkts", "bytes",
                       "aggr_flows", "srcas", "qname", "http_user_agent", "service_name", "threat_type", "threat_time")


on_flows("s6_read_pipe", _pipe_back,
         f"""SELECT af, first, msec_first, srcaddr, {ip_sql('srcaddr')} AS sip, srcport, {ip_sql('dstaddr')} AS dip, dstport, prot,
           pkts, bytes, aggr_flows, srcas, qname, http_user_agent, service_name, threat_type, threat_time FROM flows""", wide=True)
_PIPE_SQL = ("concat_ws('|', 2, first, msec_first, last, msec_last, prot, 0, 0, 0, srcaddr, srcport, 0, 0, 0, dstaddr, dstport, "
             "srcas, dstas, input, output, tcp_flags, tos, pkts, bytes, aggr_flows, 0, 0, 0, 0, 0, qtype, qclass, qname, pname, "
             "http_url, http_host, http_method, http_mime, http_user_agent, http_cookie, http_ret_code, service_type, service_name, "
             "service_version, icmp_data, icmp_seq_num, icmp_payload_len, dev_type, dev_name, dev_vendor, dev_model, os_type, "
             "os_name, os_version, midware_type, midware_name, midware_version, threat_type, threat_name, threat_version, "
             "service_time, dev_time, os_time, midware_time, threat_time)")
on_flows("s7_write_pipe", textflows.pipe_lines, f"SELECT {_PIPE_SQL} AS value FROM flows", wide=True)

_MAC = "regexp_replace(lpad(lower(to_hex({c})), 12, '0'), '(..)(..)(..)(..)(..)(..)', '\\1:\\2:\\3:\\4:\\5:\\6')"
on_flows("s8_write_csv",
         lambda f: textflows.csv_frame(f).select("te", "td", "sa", "dp", "pr", "flg", "stos", "ibyt", "opkt", "smk", "nhb",
                                                "odmc", "mpls1", "mpls4", "sl", "eng", "exid"),
         f"""SELECT concat(strftime(make_timestamp(last * 1000000), '%Y-%m-%d %H:%M:%S'), '.', lpad(CAST(msec_last AS VARCHAR), 3, '0')) AS te,
           concat(last - first, '.000') AS td, {ip_sql('srcaddr')} AS sa, CAST(dstport AS VARCHAR) AS dp,
           CASE prot WHEN 1 THEN 'ICMP' WHEN 6 THEN 'TCP' ELSE 'UDP' END AS pr,
           CASE tcp_flags WHEN 0 THEN '......' WHEN 20 THEN '.A.R..' ELSE '.AP.SF' END AS flg, CAST(tos AS VARCHAR) AS stos,
           CAST(bytes AS VARCHAR) AS ibyt, CAST(out_pkts AS VARCHAR) AS opkt, CAST(src_mask AS VARCHAR) AS smk,
           {ip_sql('bgp_nexthop')} AS nhb, {_MAC.format(c='out_dst_mac')} AS odmc,
           concat(mpls1 >> 4, '-', (mpls1 >> 1) & 7, '-', mpls1 & 1) AS mpls1, '0-0-0' AS mpls4,
           printf('%.3f', server_latency / 1000.0) AS sl, concat(engine_type, '/', engine_id) AS eng,
           CAST(exporter_sysid AS VARCHAR) AS exid FROM flows""", wide=True)


def _csv_back(f: DataFrame) -> DataFrame:
    path = folder(f)
    textflows.to_csv(f, path)
    return textflows.read_flow_csv(f.sparkSession, path).select(
        "first", "msec_first", "last", "srcaddr", "srcport", "dstaddr", "dstport", "prot", "tcp_flags", "pkts", "bytes",
        "out_bytes", "srcas", "dst_mask", "ip_nexthop", "in_dst_mac", "exporter_sysid")


on_flows("s9_read_csv", _csv_back,
         """SELECT first, msec_first, last, srcaddr, srcport, dstaddr, dstport, prot, tcp_flags, pkts, bytes, out_bytes, srcas,
           dst_mask, ip_nexthop, in_dst_mac, exporter_sysid FROM flows""", wide=True)


def _rewritten(f: DataFrame) -> DataFrame:
    kept = f.where(w_proto("tcp") & w_bytes("50k", ">"))
    spark, path = stored(kept)
    return spark.read.parquet(path).select(*_FLOW_COLS.split(", "), "pkts", "bytes", "slot", F.col("dt").cast("string"))


on_flows("s10_write_flows", _rewritten,
         f"SELECT {_FLOW_COLS}, pkts, bytes, first - first % 300 AS slot, strftime(make_timestamp(first * 1000000), '%Y-%m-%d') "
         "AS dt FROM flows WHERE prot = 6 AND bytes > 50000")


def _event_table(f: DataFrame) -> DataFrame:
    path = folder(f)
    events = threat_events(f)
    spark = f.sparkSession
    events.where(F.col("time") < START + 60000).write.parquet(path + "/a")
    merged = lc.upsert_events(spark.read.parquet(path + "/a"), events, START + 86400, ttl=80000)
    merged.write.parquet(path + "/b")
    return spark.read.parquet(path + "/b")


on_flows("s11_event_table", _event_table, f"SELECT DISTINCT * FROM threat_events WHERE time >= {START + 6400}", THREAT_EVENTS)


def _feature_table(f: DataFrame) -> DataFrame:
    path = folder(f)
    feats = slot_features(f)
    lc.merge_features(None, feats.where(F.col("hour") % 7200 == 0), _KEY).write.partitionBy("hour").parquet(path)
    old = f.sparkSession.read.parquet(path).withColumn("hour", F.col("hour").cast("bigint"))
    return lc.merge_features(old.select(*feats.columns), feats.where(F.col("hour") % 7200 != 0), _KEY)


on_flows("s12_feature_table", _feature_table, _HOURS_SQL, _SLOTS)


def _json_features(f: DataFrame) -> DataFrame:
    rows = f.where(F.col("prot") == 17).groupBy("srcaddr", "dstaddr", "qname").agg(
        F.count(F.lit(1)).alias("flows"), F.sum("bytes").alias("bytes"))
    return exports.features_to_json(rows)


on_flows("s13_features_json", _json_features,
         f"""SELECT concat('{{"sip":"', {ip_sql('srcaddr')}, '","dip":"', {ip_sql('dstaddr')}, '",', CASE WHEN qname <> '' THEN
           concat('"qname":"', qname, '",') ELSE '' END, '"flows":', count(*), ',"bytes":', CAST(sum(bytes) AS BIGINT), '}}') AS json
         FROM flows WHERE prot = 17 GROUP BY srcaddr, dstaddr, qname""")
register("s14_evidence_json", lambda spark, sf: exports.evidence_to_json(packets(spark, sf)),
         f"""WITH {PACKETS_SQL} SELECT concat('{{"time_sec":', time_sec, ',"time_usec":', time_usec, ',"sip":"', {ip_sql('sip')},
           '","dip":"', {ip_sql('dip')}, '","sport":', sport, ',"dport":80,"protocol":6,"payload":"',
           replace(replace(replace(payload, '"', '\\"'), '\\', '\\\\'), '"', '\\"'), '","payload_hex":"', hex(encode(payload)), '"}}') AS json
         FROM packets""")


def _asset_export(f: DataFrame) -> DataFrame:
    path = folder(f)
    feats = f.groupBy(F.col("dstaddr").alias("addr"), F.col("dstport").alias("port"), "prot",
                      truncate("first", 3600).alias("hour")).agg(*counters())
    exports.export_assets(feats, path, START + 3600, START + 7200)
    return f.sparkSession.read.csv(path, header=True, schema=feats.schema)


on_flows("s15_export_assets", _asset_export,
         f"SELECT dstaddr AS addr, dstport AS port, prot, first - first % 3600 AS hour, {COUNTERS} FROM flows "
         f"WHERE first >= {START + 3600} AND first < {START + 7200} GROUP BY dstaddr, dstport, prot, first - first % 3600")


def _list_back(f: DataFrame) -> DataFrame:
    """Every address seen, written as list lines with comments and blanks."""
    path = folder(f)
    text = F.concat(F.lit("  "), F.concat_ws(".", *[F.call_function("shiftright", "srcaddr", F.lit(s)).bitwiseAND(F.lit(255))
                                                    for s in (24, 16, 8, 0)]), F.lit(" , class "),
                    (F.col("srcaddr") % 3).cast("string"), F.lit(" "))
    lines = f.select("srcaddr").distinct().select(F.explode(F.array(text, F.lit("# note"), F.lit("   "))).alias("value"))
    lines.write.text(path)
    return lists.read_ip_list(f.sparkSession, path)


on_flows("s16_read_list", _list_back, "SELECT DISTINCT srcaddr AS ip, concat('class ', srcaddr % 3) AS class FROM flows")


def _intel_back(f: DataFrame) -> DataFrame:
    path = folder(f)
    names = f.where(F.col("qname") != "").select("qname").distinct()
    rows = names.select(F.md5(F.col("qname").cast("binary")).alias("key"), F.lit("say \"hi\", twice").alias("source"),
                        F.substring("qname", 1, 3).alias("coin"))
    rows.write.csv(path, escape="\\")
    return lists.read_intel(f.sparkSession, path)


on_flows("s17_read_intel", _intel_back,
         "SELECT md5(qname) AS key, 'say \"hi\", twice' AS source, max(substr(qname, 1, 3)) AS coin FROM flows WHERE qname <> '' GROUP BY md5(qname)")


def _patterns_back(f: DataFrame) -> DataFrame:
    """One pattern per destination port seen, written and read as a file."""
    path = folder(f)
    port = F.col("dstport").cast("string")
    rows = f.where(F.col("prot") == 6).groupBy("dstport").agg(F.count_distinct("srcaddr").alias("p"), F.count(F.lit(1)).alias("n"))
    lines = rows.select(F.explode(F.array(
        F.concat(F.lit("PORT_SCAN,,,, "), port, F.lit(",TCP,"), F.col("p").cast("string"), F.lit(","), F.col("n").cast("string"),
                 F.lit(",,,")), F.concat(F.lit("SRV,,,,"), port, F.lit(",,,20,,,")), F.lit("# none"))).alias("value"))
    lines.write.text(path)
    return lists.read_patterns(f.sparkSession, path, "PORT_SCAN").select("type", "sip", "dport", "protocol", "peers", "flows")


on_flows("s18_read_patterns", _patterns_back,
         """SELECT 'PORT_SCAN' AS type, '' AS sip, CAST(dstport AS VARCHAR) AS dport, 'TCP' AS protocol,
           CAST(count(DISTINCT srcaddr) AS INTEGER) AS peers, CAST(count(*) AS INTEGER) AS flows FROM flows WHERE prot = 6 GROUP BY dstport""")

def channels() -> dict:
    return {"dns": ([], w_port(53)), "north_tcp": (["north"], w_proto("tcp")),
            "big": (["north", "south"], w_bytes("80k", ">"))}


def _split(f: DataFrame) -> DataFrame:
    path = folder(f)
    flowtable.write_channels(f, channels(), path)
    return aggregate_flows(f.sparkSession.read.parquet(path), by=["channel", "prot"]).select(
        "channel", "prot", "pkts", "bytes", "flows")


_CHANNEL_SQL = ("(SELECT 'dns' AS channel, * FROM flows WHERE 53 IN (srcport, dstport) UNION ALL SELECT 'north_tcp', * FROM flows "
                "WHERE ident = 'north' AND prot = 6 UNION ALL SELECT 'big', * FROM flows WHERE ident IN ('north', 'south') "
                "AND bytes > 80000) c")
on_flows("s19_profile_split", _split,
         "SELECT channel, prot, CAST(sum(pkts) AS BIGINT) AS pkts, CAST(sum(bytes) AS BIGINT) AS bytes, "
         f"CAST(sum(aggr_flows) AS BIGINT) AS flows FROM {_CHANNEL_SQL} GROUP BY channel, prot", wide=True)
on_flows("s19_channel_stats",
         lambda f: flowtable.channel_stats(f, channels()).select("channel", "slot", "flows", "pkts", "bytes", "flows_tcp"),
         "SELECT channel, first - first % 300 AS slot, count(*) AS flows, CAST(sum(pkts) AS BIGINT) AS pkts, "
         "CAST(sum(bytes) AS BIGINT) AS bytes, count(CASE WHEN prot = 6 THEN 1 END) AS flows_tcp "
         f"FROM {_CHANNEL_SQL} GROUP BY channel, first - first % 300", wide=True)
