"""Joins, lookups and set operations (J, U)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures
from ..detectors.base import counters, is_request, recount
from ..detectors.scans import detect_ip_scan
from ..detectors.services import paired_services, service_flows
from ..functions.names import proto_name
from ..functions.text import top_label
from ..operators import joins, merges, ranges
from ..operators.aggregate import bidir_flows
from ..operators.rulematch import best_rule, network, words
from ..plans.requests import TopnRequest, answer
from ..rules import MonitoredObject, Rule, read_rules
from .aggregates import _BIDIR
from .predicates import THREAT_EVENTS, threat_events
from .registry import COUNTERS, DAY, PROTO, REQ, START, event_sql, ip_sql, on_flows, register, with_flows

IP_LIST = ("(3232235521, 'botnet'), (3232235525, 'c2'), (3232235530, ''), (167772167, 'scanner'), "
           "(167772180, 'spam')")
ASSETS = ["192.168.0.0/28", "192.168.0.20/32", "10.0.0.8/29"]


def ip_list(df: DataFrame) -> DataFrame:
    return df.sparkSession.sql(f"SELECT CAST(ip AS BIGINT) AS ip, class FROM VALUES {IP_LIST} AS t(ip, class)")


def assets(df: DataFrame) -> DataFrame:
    rows = ", ".join(f"('{a}')" for a in ASSETS)
    return df.sparkSession.sql(f"SELECT * FROM VALUES {rows} AS t(cidr)")


def asset_sql(column: str) -> str:
    return (f"({column} BETWEEN 3232235520 AND 3232235535 OR {column} = 3232235540 "
            f"OR {column} BETWEEN 167772168 AND 167772175)")


IPS_CTE = f"ips AS (SELECT * FROM (VALUES {IP_LIST}) t(ip, class))"
LISTED = f"""listed AS (SELECT f.*, CASE WHEN s.ip IS NOT NULL THEN srcaddr ELSE dstaddr END AS sip,
    CASE WHEN s.ip IS NOT NULL THEN dstaddr ELSE srcaddr END AS dip, s.ip IS NULL AS ti_mark,
    CASE WHEN s.ip IS NOT NULL THEN s.class ELSE d.class END AS class
  FROM flows f LEFT JOIN ips s ON prot <> 6 AND srcaddr = s.ip LEFT JOIN ips d ON dstaddr = d.ip
  WHERE (prot <> 6 OR {REQ}) AND (s.ip IS NOT NULL OR d.ip IS NOT NULL))"""


def _listed(f: DataFrame) -> DataFrame:
    return joins.match_ip_list(f, ip_list(f)).groupBy("sip", "dip", "prot", "ti_mark", "class").agg(*counters())


on_flows("j1_ip_list", _listed, f"SELECT sip, dip, prot, ti_mark, class, {COUNTERS} FROM listed GROUP BY ALL",
         f"{IPS_CTE}, {LISTED}")


def domain_intel(f: DataFrame) -> DataFrame:
    """Intel for a third of the names seen, classed by the first md5 digit."""
    h = F.md5(F.col("qname").cast("binary"))
    return (f.where(F.col("qname") != "").select(h.alias("md5")).distinct().where(F.conv(F.substring("md5", 1, 1), 16, 10)
            .cast("int") % 3 == 0).withColumn("class", F.concat(F.lit("k"), F.substring("md5", 1, 1))))


INTEL_CTE = ("intel AS (SELECT DISTINCT md5(qname) AS md5, concat('k', substr(md5(qname), 1, 1)) AS class FROM flows "
             "WHERE qname <> '' AND substr(md5(qname), 1, 1) IN ('0', '3', '6', '9', 'c', 'f'))")
on_flows("j2_domain_intel",
         lambda f: (joins.match_domain_intel(f, domain_intel(f)).groupBy("qname", "class").agg(*counters())),
         f"SELECT qname, class, {COUNTERS} FROM flows JOIN intel ON md5(qname) = md5 GROUP BY ALL", INTEL_CTE)


def white(f: DataFrame) -> DataFrame:
    return f.sparkSession.sql("SELECT * FROM VALUES ('net'), ('6d9c547cf146054a5a720606.gamma.org') AS t(name)")


on_flows("j3_white_list",
         lambda f: (joins.drop_whitelisted(f.where(F.col("qname") != ""), white(f), F.col("qname"), top_label())
                    .groupBy("qname").agg(*counters())),
         f"""SELECT qname, {COUNTERS} FROM flows WHERE qname <> '' AND qname <> '6d9c547cf146054a5a720606.gamma.org'
           AND NOT ends_with(qname, '.net') GROUP BY ALL""")


def _labels(f: DataFrame) -> DataFrame:
    tagged = joins.tag_list(f, ip_list(f), "blacklist")
    kept = joins.filter_labels(tagged, [F.col("blacklist") > 0, F.col("dstport") == 22], [F.col("prot") == 17])
    return kept.groupBy("prot", "blacklist").agg(*counters())


_BLACK = ("(CASE WHEN srcaddr IN (SELECT ip FROM ips) THEN 1 ELSE 0 END "
          "+ CASE WHEN dstaddr IN (SELECT ip FROM ips) THEN 2 ELSE 0 END)")
on_flows("j4_labels", _labels,
         f"""SELECT prot, blacklist, {COUNTERS} FROM (SELECT *, {_BLACK} AS blacklist FROM flows) t
         WHERE prot <> 17 AND (blacklist > 0 OR dstport = 22) GROUP BY ALL""", IPS_CTE)


def _tagged(f: DataFrame) -> DataFrame:
    hour = (F.col("first") - F.col("first") % 3600).alias("hour")
    scans = (f.groupBy(hour, "srcaddr", "prot", "dstport").agg(F.count_distinct("dstaddr").alias("peers"))
             .where(F.col("peers") >= 3))
    pairs = (f.groupBy(hour, "srcaddr", "dstaddr", "prot").agg(F.count_distinct("dstport").alias("peers"))
             .where(F.col("peers") >= 3))
    services = (f.where(is_request()).groupBy(hour, F.col("dstaddr").alias("addr"), "prot", F.col("dstport").alias("port"))
                .agg(F.count(F.lit(1)).alias("flows")).where(F.col("flows") >= 4))
    popular = f.groupBy(hour, F.col("srcaddr").alias("sip")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 40)
    tagged = joins.tag_flows(f, scans, pairs, services, popular)
    return tagged.groupBy("scanner", "service", "popular_service").agg(F.count(F.lit(1)).alias("n"),
                                                                       F.sum("bytes").alias("bytes"))


on_flows("j5_tags", _tagged,
         """SELECT CASE WHEN sc.h IS NOT NULL OR pa.h IS NOT NULL THEN 1 ELSE 0 END AS scanner,
           CASE WHEN se.h IS NOT NULL THEN 2 ELSE 0 END AS service,
           CASE WHEN p1.h IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN p2.h IS NOT NULL THEN 2 ELSE 0 END AS popular_service,
           count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes
         FROM (SELECT *, first - first % 3600 AS hr FROM flows) f
           LEFT JOIN sc ON sc.h = hr AND sc.srcaddr = f.srcaddr AND sc.prot = f.prot AND sc.dstport = f.dstport
           LEFT JOIN pa ON pa.h = hr AND pa.srcaddr = f.srcaddr AND pa.dstaddr = f.dstaddr AND pa.prot = f.prot
           LEFT JOIN se ON se.h = hr AND se.dstaddr = f.dstaddr AND se.prot = f.prot AND se.dstport = f.dstport
           LEFT JOIN po p1 ON p1.h = hr AND p1.srcaddr = f.srcaddr LEFT JOIN po p2 ON p2.h = hr AND p2.srcaddr = f.dstaddr
         GROUP BY ALL""",
         """sc AS (SELECT first - first % 3600 AS h, srcaddr, prot, dstport FROM flows GROUP BY ALL
             HAVING count(DISTINCT dstaddr) >= 3),
           pa AS (SELECT first - first % 3600 AS h, srcaddr, dstaddr, prot FROM flows GROUP BY ALL
             HAVING count(DISTINCT dstport) >= 3),
           se AS (SELECT first - first % 3600 AS h, dstaddr, prot, dstport FROM flows WHERE (tos & 1) = 1 GROUP BY ALL
             HAVING count(*) >= 4),
           po AS (SELECT first - first % 3600 AS h, srcaddr FROM flows GROUP BY ALL HAVING count(*) > 40)""")


def _bw(f: DataFrame) -> DataFrame:
    wl = f.sparkSession.sql("SELECT CAST(ip AS BIGINT) AS ip FROM VALUES (3232235522), (167772161) AS t(ip)")
    return joins.tag_bw(f, ip_list(f), wl).groupBy("blacklist", "whitelist").agg(*counters())


on_flows("j6_black_white", _bw,
         f"""SELECT blacklist, whitelist, {COUNTERS} FROM (SELECT *, {_BLACK} AS blacklist,
           CASE WHEN srcaddr IN (3232235522, 167772161) THEN 1 ELSE 0 END
           + CASE WHEN dstaddr IN (3232235522, 167772161) THEN 2 ELSE 0 END AS whitelist FROM flows) t GROUP BY ALL""",
         IPS_CTE)

_NETS = {"192.168.0.0/27": "all", "192.168.0.0/28": "low", "192.168.0.20/32": "one", "10.0.0.5/29": "odd",
         "10.0.0.0/8": "clients"}
_NETS_CTE = ("nets AS (SELECT * FROM (VALUES ('192.168.0.0/27', 3232235520, 3232235551), "
             "('192.168.0.0/28', 3232235520, 3232235535), ('192.168.0.20/32', 3232235540, 3232235540), "
             "('10.0.0.5/29', 167772165, 167772172), ('10.0.0.0/8', 167772160, 184549375)) t(cidr, lo, hi))")


def _nets(f: DataFrame) -> DataFrame:
    rows = ", ".join(f"('{c}', '{n}')" for c, n in _NETS.items())
    return f.sparkSession.sql(f"SELECT * FROM VALUES {rows} AS t(cidr, name)")


on_flows("j7_cidr_join",
         lambda f: ranges.cidr_join(f, "srcaddr", _nets(f)).groupBy("cidr", "srcaddr").agg(*counters()),
         f"SELECT cidr, srcaddr, {COUNTERS} FROM flows JOIN nets ON srcaddr BETWEEN lo AND hi GROUP BY ALL", _NETS_CTE)
on_flows("j7_in_assets",
         lambda f: (ranges.in_ranges(f, "dstaddr", ranges.networks(assets(f))).groupBy("dstaddr").agg(*counters())),
         f"SELECT dstaddr, {COUNTERS} FROM flows WHERE {asset_sql('dstaddr')} GROUP BY ALL")
on_flows("j7_outside_assets",
         lambda f: (ranges.in_ranges(f, "dstaddr", ranges.networks(assets(f)), anti=True).groupBy("dstaddr")
                    .agg(*counters())),
         f"SELECT dstaddr, {COUNTERS} FROM flows WHERE NOT {asset_sql('dstaddr')} GROUP BY ALL")


def _v6_join(f: DataFrame) -> DataFrame:
    from .predicates import _v6
    pairs = f.groupBy("srcaddr").agg(*counters()).withColumn("srcaddr", _v6("srcaddr"))
    nets = f.sparkSession.sql("SELECT * FROM VALUES ('2001:db8::c0a8:0/124'), ('2001:db8::a00:0/112'), "
                              "('2001:db8::/32'), ('2001:db8::c0a8:5') AS t(cidr)")
    return ranges.cidr_join(pairs, "srcaddr", nets)


on_flows("j7_cidr_join_v6", _v6_join,
         f"""SELECT concat('2001:db8::', lower(to_hex(srcaddr >> 16)), ':', lower(to_hex(srcaddr & 65535))) AS srcaddr,
           cidr, {COUNTERS} FROM flows JOIN (VALUES ('2001:db8::c0a8:0/124', 3232235520, 3232235535),
             ('2001:db8::a00:0/112', 167772160, 167837695), ('2001:db8::/32', 0, 4294967295),
             ('2001:db8::c0a8:5', 3232235525, 3232235525)) n(cidr, lo, hi) ON srcaddr BETWEEN lo AND hi GROUP BY ALL""")

MOS = [MonitoredObject(1, moip="192.168.0.0/28", moport="80", direction="IN"),
       MonitoredObject(2, moip="192.168.0.4", direction="OUT", protocol="TCP"),
       MonitoredObject(3, moip="10.0.0.16/28", pip="!192.168.0.8/29", direction="ALL"),
       MonitoredObject(4, moport="<100", protocol="UDP", direction="IN"),
       MonitoredObject(5, moip="!192.168.0.0/28", moport="22", direction="IN", pip="10.0.0.0/29")]
MO_SQL = {
    1: "dstaddr BETWEEN 3232235520 AND 3232235535 AND dstport = 80",
    2: "srcaddr = 3232235524 AND prot = 6",
    3: "(srcaddr BETWEEN 167772176 AND 167772191 OR dstaddr BETWEEN 167772176 AND 167772191) "
       "AND NOT (srcaddr BETWEEN 3232235528 AND 3232235535 OR dstaddr BETWEEN 3232235528 AND 3232235535)",
    4: "dstport < 100 AND prot = 17",
    5: "NOT dstaddr BETWEEN 3232235520 AND 3232235535 AND dstport = 22 AND srcaddr BETWEEN 167772160 AND 167772167"}
_MO_UNION = " UNION ALL ".join(f"SELECT {i} AS moid, '{m.direction}' AS direction, * FROM flows WHERE {MO_SQL[i]}"
                               for i, m in zip(MO_SQL, MOS, strict=True))
_MO_SELECT = f"SELECT moid, direction, {COUNTERS} FROM ({_MO_UNION}) t GROUP BY ALL"
on_flows("j8_objects", lambda f: joins.match_mo(f, MOS).groupBy("moid", "direction").agg(*counters()), _MO_SELECT)
on_flows("j8_objects_by_address",
         lambda f: joins.match_mo(f, MOS).groupBy("moid", "direction").agg(*counters()), _MO_SELECT)

_REQ_KEY = ["sip", "dip", "dport", "http_ret_code"]


def _paired(f: DataFrame) -> DataFrame:
    tcp = f.where(F.col("prot") == 6)
    req = (tcp.where(is_request()).select(F.col("srcaddr").alias("sip"), F.col("dstaddr").alias("dip"),
                                          F.col("dstport").alias("dport"), "http_ret_code", "first", "last", "pkts", "bytes")
           .groupBy(*_REQ_KEY).agg(*counters()))
    res = tcp.where(~is_request()).select(F.col("dstaddr").alias("sip"), F.col("srcaddr").alias("dip"),
                                          F.col("srcport").alias("dport"), "http_ret_code")
    return joins.pair_requests(req, res, _REQ_KEY)


on_flows("j9_request_response", _paired,
         f"""SELECT q.*, r.sip IS NOT NULL OR q.http_ret_code <> 0 AS has_res FROM
         (SELECT srcaddr AS sip, dstaddr AS dip, dstport AS dport, http_ret_code, {COUNTERS} FROM flows
            WHERE prot = 6 AND {REQ} GROUP BY ALL) q
         LEFT JOIN (SELECT DISTINCT dstaddr AS sip, srcaddr AS dip, srcport AS dport, http_ret_code FROM flows
            WHERE prot = 6 AND NOT {REQ}) r USING (sip, dip, dport, http_ret_code)""")

UDP_PORTS = ("7, 53, 80, 111, 123, 137, 161, 162, 177, 389, 427, 443, 500, 514, 520, 623, 626, 1194, 1604, 2049, 2302, "
             "3283, 3784, 5351, 5353, 5683, 6481, 8767, 9987, 10080, 11211, 17185, 26000, 27910, 64738")


def service_ctes(where: str = "TRUE") -> str:
    """Responding and requested endpoints that answer each other."""
    latest = ("coalesce(split_part(max(CASE WHEN app <> '' THEN concat(CAST(last AS VARCHAR), '|', app) END), '|', 2), '') "
              "AS app_proto")
    return f"""sf AS (SELECT * FROM flows WHERE prot IN (6, 17) AND srcport <> 0 AND dstport <> 0 AND {where}
      AND (prot = 6 OR srcport IN ({UDP_PORTS}) OR dstport IN ({UDP_PORTS}))),
    req AS (SELECT devid, dstaddr AS addr, dstport AS port, prot, {COUNTERS}, {latest} FROM sf
      WHERE prot = 17 OR {REQ} GROUP BY devid, dstaddr, dstport, prot),
    res AS (SELECT devid, srcaddr AS addr, srcport AS port, prot, {COUNTERS}, {latest} FROM sf
      GROUP BY devid, srcaddr, srcport, prot),
    servers AS (SELECT * FROM res r WHERE NOT EXISTS (SELECT 1 FROM sf WHERE prot = 6 AND {REQ} AND srcaddr = r.addr
        AND srcport = r.port AND r.prot = 6) AND EXISTS (SELECT 1 FROM req q WHERE q.addr = r.addr AND q.port = r.port
        AND q.prot = r.prot) AND (prot = 6 OR port IN ({UDP_PORTS}))),
    asked AS (SELECT q.* FROM req q WHERE EXISTS (SELECT 1 FROM servers s WHERE s.addr = q.addr AND s.port = q.port
        AND s.prot = q.prot))"""


def _services(f: DataFrame) -> DataFrame:
    return paired_services(service_flows(DAY.clip(f)), F.lit("")).drop("time", "app_proto")


on_flows("j10_service_pairs", _services,
         "SELECT devid, addr, port, prot, 1 AS srv_mark, first, last, flows, pkts, bytes FROM servers UNION ALL "
         "SELECT devid, addr, port, prot, 0, first, last, flows, pkts, bytes FROM asked",
         service_ctes().replace("app <> ''", "'' <> ''").replace("'|', app", "'|', ''"))
on_flows("j11_bidir_merge",
         lambda f: (bidir_flows(f).groupBy("prot").agg(F.count(F.lit(1)).alias("n"), F.sum("pkts").alias("pkts"),
                                                       F.sum("out_pkts").alias("out_pkts"))),
         """SELECT prot, count(*) AS n, CAST(sum(CASE WHEN lead_back THEN rp ELSE fp END) AS BIGINT) AS pkts,
           CAST(sum(CASE WHEN lead_back THEN fp ELSE rp END) AS BIGINT) AS out_pkts FROM paired GROUP BY ALL""",
         _BIDIR)


# One rule per specificity class; the best one decides even if its threshold fails.
CLASS_RULES = [
    Rule(11, 8, min=4, sip="10.0.0.3", dip="192.168.0.0/28", protocol="TCP"),
    Rule(12, 8, min=3, sip="10.0.0.0/30", dip="192.168.0.16/28"),
    Rule(13, 8, min=5, sip="10.0.0.4", protocol="TCP"),
    Rule(14, 8, min=2, max=6, dip="192.168.0.7", protocol="TCP"),
    Rule(15, 8, min=2, sip="10.0.0.8/29"),
    Rule(16, 8, min=3, dip="192.168.0.9"),
    Rule(17, 8, min=4, protocol="TCP"),
    Rule(18, 8, min=1),
    Rule(19, 8, min=1, protocol="TCP"),
]
CLASS_CTE = """rules AS (SELECT * FROM (VALUES
    (11, 4, 0, 167772163, 167772163, 3232235520, 3232235535, 'TCP', 0), (12, 3, 0, 167772160, 167772163, 3232235536, 3232235551, '', 1),
    (13, 5, 0, 167772164, 167772164, 0, 4294967295, 'TCP', 2), (14, 2, 6, 0, 4294967295, 3232235527, 3232235527, 'TCP', 3),
    (15, 2, 0, 167772168, 167772175, 0, 4294967295, '', 4), (16, 3, 0, 0, 4294967295, 3232235529, 3232235529, '', 5),
    (17, 4, 0, 0, 4294967295, 0, 4294967295, 'TCP', 6), (18, 1, 0, 0, 4294967295, 0, 4294967295, '', 7),
    (19, 1, 0, 0, 4294967295, 0, 4294967295, 'TCP', 6)) t(config_id, rmin, rmax, slo, shi, dlo, dhi, proto, class))"""


def _pair_keys(f: DataFrame) -> DataFrame:
    return f.where(F.col("prot") != 17).groupBy("srcaddr", "dstaddr", "prot").agg(F.count_distinct("dstport").alias("peers"))


def _best(f: DataFrame) -> DataFrame:
    return _judged(best_rule(_pair_keys(f), CLASS_RULES, _pair_selectors()))


def _pair_selectors() -> dict:
    return {"sip": network("srcaddr"), "dip": network("dstaddr"), "protocol": words(proto_name())}


def _judged(hit: DataFrame) -> DataFrame:
    met = (F.col("peers") >= F.col("rule.min")) & ((F.col("rule.max") == 0) | (F.col("peers") < F.col("rule.max")))
    return hit.select("srcaddr", "dstaddr", "prot", "peers", F.col("rule.config_id").alias("config_id"), met.alias("met"))


BEST_SQL = f"""SELECT srcaddr, dstaddr, prot, peers, config_id, peers >= rmin AND (rmax = 0 OR peers < rmax) AS met FROM (
  SELECT *, row_number() OVER (PARTITION BY srcaddr, dstaddr, prot ORDER BY class, config_id) AS rn FROM
   (SELECT srcaddr, dstaddr, prot, count(DISTINCT dstport) AS peers FROM flows WHERE prot <> 17 GROUP BY ALL) k
   JOIN rules ON srcaddr BETWEEN slo AND shi AND dstaddr BETWEEN dlo AND dhi
     AND (proto = '' OR proto = CASE prot WHEN 6 THEN 'TCP' WHEN 1 THEN 'ICMP' END)) t WHERE rn = 1"""
on_flows("j12_best_rule", _best, BEST_SQL, CLASS_CTE)
on_flows("v1_rule_precedence",
         lambda f: _best(f).groupBy("config_id").agg(F.count(F.lit(1)).alias("pairs"),
                                                     F.sum(F.col("met").cast("int")).alias("met")),
         f"SELECT config_id, count(*) AS pairs, CAST(sum(CAST(met AS INTEGER)) AS BIGINT) AS met FROM ({BEST_SQL}) b "
         "GROUP BY ALL", CLASS_CTE)


# Rules and objects as many as orders and customers; half of the networks do not begin at a multiple of their size.
ORDER_RULES = """SELECT CAST(o_orderkey AS INT) AS config_id, CAST(8 AS INT) AS type_id, CAST(1 + o_custkey % 5 AS BIGINT) AS min,
  CASE WHEN o_orderkey % 2 = 0 THEN concat('10.0.0.', CAST(o_custkey % 56 AS STRING), CASE WHEN o_custkey % 3 = 0 THEN '/29' ELSE '' END)
    ELSE '' END AS sip,
  CASE WHEN o_orderkey % 3 > 0 THEN concat('192.168.0.', CAST(o_custkey * 7 % 40 AS STRING), CASE WHEN o_custkey % 4 = 0 THEN '/30' ELSE '' END)
    ELSE '' END AS dip,
  CASE o_orderkey % 5 WHEN 0 THEN 'TCP' WHEN 1 THEN 'ICMP' ELSE '' END AS protocol
FROM {orders} o"""
ORDER_RULES_CTE = """rules AS (SELECT *, CASE concat(CAST(s AS VARCHAR), CAST(d AS VARCHAR), CASE WHEN proto <> '' THEN '1' ELSE '0' END)
      WHEN '111' THEN 0 WHEN '110' THEN 1 WHEN '101' THEN 2 WHEN '011' THEN 3 WHEN '100' THEN 4 WHEN '010' THEN 5 WHEN '001' THEN 6 ELSE 7
      END AS class, CASE WHEN s = 1 THEN 167772160 + o_custkey % 56 ELSE 0 END AS slo,
      CASE WHEN s = 1 THEN 167772160 + o_custkey % 56 + CASE WHEN o_custkey % 3 = 0 THEN 7 ELSE 0 END ELSE 4294967295 END AS shi,
      CASE WHEN d = 1 THEN 3232235520 + o_custkey * 7 % 40 ELSE 0 END AS dlo,
      CASE WHEN d = 1 THEN 3232235520 + o_custkey * 7 % 40 + CASE WHEN o_custkey % 4 = 0 THEN 3 ELSE 0 END ELSE 4294967295 END AS dhi
    FROM (SELECT CAST(o_orderkey AS INTEGER) AS config_id, 1 + o_custkey % 5 AS rmin, 0 AS rmax, o_custkey,
        CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS s, CASE WHEN o_orderkey % 3 > 0 THEN 1 ELSE 0 END AS d,
        CASE o_orderkey % 5 WHEN 0 THEN 'TCP' WHEN 1 THEN 'ICMP' ELSE '' END AS proto FROM orders) o)"""


def _best_of_table(spark: SparkSession, sf: str) -> DataFrame:
    """The deciding rule out of as many rules as there are orders."""
    rules = read_rules(spark.sql(ORDER_RULES, orders=fixtures.table(spark, sf, "orders")))
    return _judged(best_rule(_pair_keys(fixtures.flows(spark, sf)), rules, _pair_selectors()))


register("j12_best_rule_table", _best_of_table, with_flows(BEST_SQL, ORDER_RULES_CTE))
register("d2_ip_scan_table",
         lambda spark, sf: detect_ip_scan(fixtures.flows(spark, sf), read_rules(spark.sql(
             ORDER_RULES, orders=fixtures.table(spark, sf, "orders"))), [], DAY).events,
         with_flows(f"""SELECT {event_sql(f"concat({ip_sql('srcaddr')}, ':>', {ip_sql('dstaddr')}, ': ', {PROTO}, ' ')", 'rmin', 'peers',
           "'peerports'", '0', '8')} FROM (SELECT *, row_number() OVER (PARTITION BY devid, srcaddr, dstaddr, prot ORDER BY class, config_id) AS rn
             FROM (SELECT devid, srcaddr, dstaddr, prot, count(DISTINCT dstport) AS peers FROM flows WHERE srcport <> 0 AND dstport <> 0
               AND prot <> 17 AND (prot <> 6 OR {REQ}) GROUP BY ALL) k
             JOIN rules ON srcaddr BETWEEN slo AND shi AND dstaddr BETWEEN dlo AND dhi AND (proto = '' OR proto = {PROTO})) t
           WHERE rn = 1 AND peers >= rmin""", ORDER_RULES_CTE))


def _customer_objects(spark: SparkSession, sf: str) -> DataFrame:
    """Flows of as many monitored objects as there are customers."""
    objects = spark.sql("""SELECT CAST(c_custkey AS INT) AS id, CASE WHEN c_custkey % 2 = 0 THEN 'IN' ELSE 'OUT' END AS direction,
        concat(CASE WHEN c_custkey % 97 = 0 THEN '!' ELSE '' END, '192.168.0.', CAST(c_custkey % 60 AS STRING),
          CASE WHEN c_custkey % 3 = 0 THEN '/30' ELSE '' END) AS moip, CASE WHEN c_custkey % 5 < 4 THEN '443' ELSE '' END AS moport
        FROM {customer} c""", customer=fixtures.table(spark, sf, "customer"))
    alike = joins.combine_for(fixtures.flows(spark, sf), objects)
    return joins.match_mo(alike, objects).groupBy("moid", "direction").agg(*recount())


register("j8_objects_table", _customer_objects, with_flows(
    f"""SELECT moid, direction, {COUNTERS} FROM flows JOIN objects ON (c_not <> (CASE WHEN way = 0 THEN dstaddr ELSE srcaddr END BETWEEN lo AND hi))
          AND (any_port OR (CASE WHEN way = 0 THEN dstport ELSE srcport END) = 443) GROUP BY moid, direction""",
    """objects AS (SELECT CAST(c_custkey AS INTEGER) AS moid, CASE WHEN c_custkey % 2 = 0 THEN 'IN' ELSE 'OUT' END AS direction,
          c_custkey % 2 AS way, c_custkey % 97 = 0 AS c_not, c_custkey % 5 >= 4 AS any_port,
          3232235520 + CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 60 - c_custkey % 60 % 4 ELSE c_custkey % 60 END AS lo,
          3232235520 + CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 60 - c_custkey % 60 % 4 + 3 ELSE c_custkey % 60 END AS hi FROM customer)"""))


def _locations(f: DataFrame) -> DataFrame:
    table = f.sparkSession.sql("""SELECT CAST(lo AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi, location FROM VALUES
      (167772160, 167772174, 'lab'), (167772175, 167772190, 'office'), (3232235520, 3232235551, 'hall'),
      (3232235525, 3232235529, 'rack') AS t(lo, hi, location)""")
    return joins.ip_location(f, "srcaddr", table).groupBy("srcaddr", "location").agg(*counters())


on_flows("j13_ip_location", _locations,
         f"""SELECT srcaddr, CASE WHEN srcaddr BETWEEN 167772160 AND 167772174 THEN 'lab'
           WHEN srcaddr BETWEEN 167772175 AND 167772190 THEN 'office' WHEN srcaddr BETWEEN 3232235525 AND 3232235529 THEN 'rack'
           WHEN srcaddr BETWEEN 3232235520 AND 3232235551 THEN 'hall' END AS location, {COUNTERS} FROM flows GROUP BY ALL""")


def _policy(f: DataFrame) -> DataFrame:
    labels = joins.policy_labels(["mo", "black", "nosuch"], [{"label": "black"}], MOS, devid=1)
    preds = {f"mo_{m.id}": m for m in MOS}
    from ..functions.predicates import object_filter
    request = TopnRequest(sortby="ALL", step=3600, include=tuple(labels))
    return answer(f, request, {n: object_filter(m) for n, m in preds.items()}).select("time", "flows", "pkts", "bytes")


on_flows("j14_policy_labels", _policy,
         f"""SELECT first - first % 3600 AS time, count(*) AS flows, CAST(sum(pkts) AS BIGINT) AS pkts,
           CAST(sum(bytes) AS BIGINT) AS bytes FROM flows WHERE {' OR '.join(f'({c})' for c in MO_SQL.values())} GROUP BY ALL""")


def _drill(f: DataFrame) -> DataFrame:
    from ..detectors import detect_threats
    from .registry import DAY_SLOTS
    det = detect_threats(f, [Rule(7, type_id=13)], DAY_SLOTS)
    return joins.event_evidence(det.events, det.details).select(
        "time", "obj", "alarm_value", "srcaddr", "srcport", "dstaddr", "dstport", "flows", "bytes")


on_flows("j15_event_evidence", _drill,
         f"""SELECT e.time, e.obj, e.alarm_value, srcaddr, srcport, dstaddr, dstport, flows, bytes FROM threat_events e JOIN
         (SELECT first - first % 300 AS time, concat(CASE WHEN lower(threat_type) = 'mining' THEN {ip_sql('dstaddr')}
            ELSE {ip_sql('srcaddr')} END, ':>', CASE WHEN lower(threat_type) = 'mining' THEN {ip_sql('srcaddr')}
            ELSE {ip_sql('dstaddr')} END, ':', dstport, ' TCP ', lower(threat_type), ' ', lower(threat_name)) AS obj,
          srcaddr, srcport, dstaddr, dstport, count(*) AS flows, CAST(sum(bytes) AS BIGINT) AS bytes FROM flows
          WHERE threat_type <> '' AND {REQ} GROUP BY ALL) d ON e.time = d.time AND e.obj = d.obj
         WHERE e.config_id = 7""", THREAT_EVENTS)


# ---- set operations -----------------------------------------------------

def _union(f: DataFrame) -> DataFrame:
    from ..detectors.base import Detection
    from ..plans.run import all_events
    events = threat_events(f)
    return all_events({"a": Detection(events.where(F.col("config_id") == 7)), "b": Detection(None),
                       "c": Detection(events.where(F.col("config_id") == 9))})


on_flows("u1_union_events", _union, "SELECT * FROM threat_events", THREAT_EVENTS)


def _dedup(f: DataFrame) -> DataFrame:
    events = threat_events(f)
    existing = events.where(F.col("time") % 7200 < 3600)
    return merges.new_rows(existing, events.unionByName(events))


on_flows("u2_new_events", _dedup, "SELECT DISTINCT * FROM threat_events WHERE time % 7200 >= 3600", THREAT_EVENTS)
on_flows("u3_black_parts",
         lambda f: (f.where(F.col("threat_type") != "").select(F.col("dstaddr").alias("ip")).union(
             ip_list(f).select("ip")).distinct()),
         "SELECT dstaddr AS ip FROM flows WHERE threat_type <> '' UNION SELECT ip FROM ips", IPS_CTE)
on_flows("u4_label_algebra",
         lambda f: (joins.filter_labels(f, exclude=[F.col("prot") == 6, F.col("dstport") == 53]).groupBy("prot")
                    .agg(*counters())),
         f"SELECT prot, {COUNTERS} FROM flows WHERE NOT (prot = 6 OR dstport = 53) GROUP BY ALL")


def _responders(f: DataFrame) -> DataFrame:
    tcp = f.where(F.col("prot") == 6)
    clients = tcp.where(is_request()).select(F.col("srcaddr").alias("addr"), F.col("srcport").alias("port"))
    return (tcp.select(F.col("srcaddr").alias("addr"), F.col("srcport").alias("port")).distinct()
            .join(clients.distinct(), ["addr", "port"], "left_anti"))


on_flows("u5_subtract_clients", _responders,
         f"SELECT srcaddr AS addr, srcport AS port FROM flows WHERE prot = 6 EXCEPT SELECT srcaddr, srcport FROM flows "
         f"WHERE prot = 6 AND {REQ}")


def _spliced(f: DataFrame) -> DataFrame:
    from ..operators.topn import topn_by_step
    cached = topn_by_step(f.where(F.col("prot") == 6), "ALL", step=3600)
    mid = f.where((F.col("first") >= START + 36000) & (F.col("first") < START + 43200))
    return merges.splice_steps(cached, topn_by_step(mid, "ALL", step=3600), START + 36000, START + 43200).select(
        "time", "flows", "pkts", "bytes")


on_flows("u6_spliced_steps", _spliced,
         f"""SELECT first - first % 3600 AS time, count(*) AS flows, CAST(sum(pkts) AS BIGINT) AS pkts,
           CAST(sum(bytes) AS BIGINT) AS bytes FROM flows WHERE prot = 6 OR (first >= {START + 36000} AND first < {START + 43200})
         GROUP BY ALL""")
