"""Queries on a table of both address families: addresses are texts, those of every other flow IPv6."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import detectors as d
from .. import fixtures
from ..detectors.base import counters
from ..functions.address import ipv4_str, shr
from ..functions.predicates import object_filter, w_ip, w_net, w_next_ip
from ..operators import joins
from ..rules import MonitoredObject, Rule
from ..sources import flowtable, lists, textflows
from .lookups import INTEL_CTE, domain_intel
from .registry import COUNTERS, DAY, DOMAIN, PROTO, REQ, event_sql, folder, ip_sql, register, with_flows


def _text(column: str) -> Column:
    six = F.concat(F.lit("2001:db8::"), F.lower(F.hex(shr(column, 16))), F.lit(":"),
                   F.lower(F.hex(F.col(column).bitwiseAND(F.lit(65535)))))
    return F.when(F.col("_six"), six).otherwise(ipv4_str(column))


def _text_sql(c: str) -> str:
    return f"CASE WHEN six THEN concat('2001:db8::', lower(to_hex({c} >> 16)), ':', lower(to_hex({c} & 65535))) ELSE {ip_sql(c)} END"


def mixed(flows: DataFrame, columns=("srcaddr", "dstaddr")) -> DataFrame:
    return flows.withColumn("_six", F.col("srcaddr") % 2 == 1).withColumns({c: _text(c) for c in columns}).drop("_six")


_NUMBERS = "numbers AS (SELECT *, srcaddr % 2 = 1 AS six FROM flows)"
SRC, DST = _text_sql("srcaddr"), _text_sql("dstaddr")
BRACKETED = {c: f"CASE WHEN six THEN concat('[', {_text_sql(c)}, ']') ELSE {ip_sql(c)} END" for c in ("srcaddr", "dstaddr")}


def on_mixed(name: str, build, select: str, ctes: str = "", wide: bool = False, columns=("srcaddr", "dstaddr")) -> None:
    source = fixtures.wide_flows if wide else fixtures.flows
    register(name, lambda spark, sf: build(mixed(source(spark, sf), columns)),
             with_flows(select, _NUMBERS + (f", {ctes}" if ctes else ""), wide))


# ---- sources --------------------------------------------------------------

_FIELDS = ["first", "srcaddr", "srcport", "dstaddr", "dstport", "prot", "pkts", "bytes"]
_FIELDS_SQL = f"first, {SRC} AS srcaddr, srcport, {DST} AS dstaddr, dstport, prot, pkts, bytes"


def _pipe_back(f: DataFrame) -> DataFrame:
    path = folder(f)
    textflows.write_pipe(f, path)
    return textflows.read_pipe_flows(f.sparkSession, path, text_addresses=True).select("af", *_FIELDS)


on_mixed("s6_pipe_both_families", _pipe_back,
         f"SELECT CAST(CASE WHEN six THEN 10 ELSE 2 END AS INTEGER) AS af, {_FIELDS_SQL} FROM numbers", wide=True)


def _refused(f: DataFrame) -> DataFrame:
    """Lines of which some have lost a field and some a number, by the reason for which they are refused."""
    path, broken = folder(f), folder(f)
    textflows.write_pipe(f, path)
    tagged = f.sparkSession.read.text(path).withColumn("bytes", F.split("value", r"\|")[23].cast("bigint"))
    value = (F.when(F.col("bytes") % 97 == 0, F.regexp_replace("value", r"\|[^|]*$", ""))
             .when(F.col("bytes") % 89 == 0, F.concat(F.lit("x"), F.col("value"))).otherwise(F.col("value")))
    textflows.write_lines(tagged.select(value.alias("value")), broken)
    lines = f.sparkSession.read.text(broken)
    bad = textflows.refused_lines(lines).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    good = textflows.parse_pipe(lines).agg(F.count(F.lit(1)).alias("n")).select(F.lit("").alias("reason"), "n")
    return good.unionByName(bad)


on_mixed("s6_refused_lines", _refused,
         """SELECT CASE WHEN bytes % 97 = 0 THEN '64 fields' WHEN bytes % 89 = 0 THEN 'af is no number' ELSE '' END AS reason,
           count(*) AS n FROM numbers GROUP BY 1""", wide=True)


def _csv_back(f: DataFrame) -> DataFrame:
    path = folder(f)
    textflows.to_csv(f, path)
    return textflows.read_flow_csv(f.sparkSession, path, text_addresses=True).select(*_FIELDS, "ip_nexthop")


on_mixed("s9_csv_both_families", _csv_back, f"SELECT {_FIELDS_SQL}, {_text_sql('ip_nexthop')} AS ip_nexthop FROM numbers", wide=True,
         columns=("ip_nexthop", "dstaddr", "srcaddr"))


def _stored(f: DataFrame) -> DataFrame:
    path = folder(f)
    flowtable.write_flows(f, path)
    return flowtable.read_flows(f.sparkSession, path, devid=1).select(*_FIELDS)


on_mixed("s10_write_both_families", _stored, f"SELECT {_FIELDS_SQL} FROM numbers")


def _list_back(f: DataFrame) -> DataFrame:
    """Every source as an address, as a network and as a line that is neither."""
    path = folder(f)
    source = F.col("srcaddr")
    lines = f.select("srcaddr").distinct().select(F.explode(F.array(
        F.concat(source, F.lit(", one")), F.concat(source, F.lit("/30,few")), F.concat(F.lit("host "), source),
        F.concat(source, F.lit("/x")), F.lit("# note"))).alias("value"))
    lines.write.text(path)
    good = lists.read_networks(f.sparkSession, path).select("cidr", F.col("class").alias("note"))
    return good.unionByName(lists.refused_networks(f.sparkSession, path).select("cidr", F.col("reason").alias("note")))


on_mixed("s16_list_both_families", _list_back,
         f"""SELECT cidr, note FROM (SELECT DISTINCT {SRC} AS t FROM numbers) a, LATERAL (VALUES (t, 'one'), (t || '/30', 'few'),
           ('host ' || t, 'no address'), (t || '/x', 'no prefix length')) v(cidr, note)""")

# ---- predicates -----------------------------------------------------------


def counted(name: str, predicate, sql: str, wide: bool = False, columns=("srcaddr", "dstaddr")) -> None:
    on_mixed(name, lambda f: f.where(predicate()).groupBy("prot").agg(*counters()),
             f"SELECT prot, {COUNTERS} FROM numbers WHERE {sql} GROUP BY prot", wide=wide, columns=columns)


counted("w12_ip_both_families", lambda: w_ip("10.0.0.4", "2001:db8::a00:7", side="src"),
        "(NOT six AND srcaddr = 167772164) OR (six AND srcaddr = 167772167)")
counted("w13_list_both_families", lambda: w_ip("192.168.0.0/30", "192.168.0.9", "2001:db8::c0a8:10/125", side="dst"),
        "(NOT six AND (dstaddr BETWEEN 3232235520 AND 3232235523 OR dstaddr = 3232235529)) "
        "OR (six AND dstaddr BETWEEN 3232235536 AND 3232235543)")
counted("w14_next_both_families", lambda: w_next_ip("172.16.0.0/30", "2001:db8::ac10:1"),
        "(NOT six AND ip_nexthop BETWEEN 2886729728 AND 2886729731) OR (six AND ip_nexthop = 2886729729)", wide=True,
        columns=("ip_nexthop", "dstaddr", "srcaddr"))
counted("w24_net_both_families", lambda: w_net("10.0/16", side="src") & ~w_net("2001:db8::/32", side="dst") | w_net("2001:db8::a00:0/124"),
        "(NOT six AND srcaddr BETWEEN 167772160 AND 167837695) OR (six AND (srcaddr BETWEEN 167772160 AND 167772175 "
        "OR dstaddr BETWEEN 167772160 AND 167772175))")

OBJECTS = [MonitoredObject(1, moip="192.168.0.0/28", moport="80", direction="IN"),
           MonitoredObject(2, moip="2001:db8::c0a8:0/124", direction="OUT", protocol="TCP"),
           MonitoredObject(3, moip="2001:db8::a00:10/124", pip="!2001:db8::c0a8:8/125", direction="ALL"),
           MonitoredObject(4, moip="!10.0.0.0/8", moport="<100", direction="IN")]
OBJECTS_SQL = {
    1: "NOT six AND dstaddr BETWEEN 3232235520 AND 3232235535 AND dstport = 80",
    2: "six AND srcaddr BETWEEN 3232235520 AND 3232235535 AND prot = 6",
    3: "six AND (srcaddr BETWEEN 167772176 AND 167772191 OR dstaddr BETWEEN 167772176 AND 167772191) "
       "AND NOT (srcaddr BETWEEN 3232235528 AND 3232235535 OR dstaddr BETWEEN 3232235528 AND 3232235535)",
    4: "(six OR NOT dstaddr BETWEEN 167772160 AND 184549375) AND dstport < 100"}
counted("w35_object_both_families", lambda: object_filter(OBJECTS[0]) | object_filter(OBJECTS[2]) | object_filter(OBJECTS[3]),
        f"({OBJECTS_SQL[1]}) OR ({OBJECTS_SQL[3]}) OR ({OBJECTS_SQL[4]})")
on_mixed("j8_objects_both_families", lambda f: joins.match_mo(f, OBJECTS).groupBy("moid", "direction").agg(*counters()),
         f"SELECT moid, direction, {COUNTERS} FROM (" + " UNION ALL ".join(
             f"SELECT {m.id} AS moid, '{m.direction}' AS direction, * FROM numbers WHERE {OBJECTS_SQL[m.id]}" for m in OBJECTS)
         + ") o GROUP BY moid, direction")

# ---- lists and detectors --------------------------------------------------


def _ips(f: DataFrame) -> DataFrame:
    return f.sparkSession.sql("SELECT * FROM VALUES ('192.168.0.1', 'four'), ('2001:db8::c0a8:5', 'six'), ('10.0.0.6', 'a'), "
                              "('2001:db8::a00:7', 'b') AS t(ip, class)")


on_mixed("j1_list_both_families",
         lambda f: joins.match_ip_list(f, _ips(f)).groupBy("sip", "dip", "prot", "ti_mark", "class").agg(*counters()),
         f"""SELECT sip, dip, prot, ti_mark, class, {COUNTERS} FROM (SELECT f.*, CASE WHEN s.ip IS NOT NULL THEN src ELSE dst END AS sip,
             CASE WHEN s.ip IS NOT NULL THEN dst ELSE src END AS dip, s.ip IS NULL AS ti_mark, coalesce(s.class, d.class) AS class
           FROM (SELECT *, {SRC} AS src, {DST} AS dst FROM numbers) f LEFT JOIN ips s ON prot <> 6 AND src = s.ip LEFT JOIN ips d ON dst = d.ip
           WHERE (prot <> 6 OR {REQ}) AND (s.ip IS NOT NULL OR d.ip IS NOT NULL)) l GROUP BY ALL""",
         "ips AS (SELECT * FROM (VALUES ('192.168.0.1', 'four'), ('2001:db8::c0a8:5', 'six'), ('10.0.0.6', 'a'), ('2001:db8::a00:7', 'b')) t(ip, class))")
on_mixed("d1_scan_both_families",
         lambda f: d.detect_port_scan(f, [Rule(1, 2, min=3, sip="10.0.0.0/28"), Rule(2, 2, min=4, sip="2001:db8::a00:0/124"),
                                          Rule(3, 2, min=6, port="22")], [], DAY).events,
         f"""SELECT {event_sql(f"concat({BRACKETED['srcaddr']}, ':>:', dstport, ' ', {PROTO}, ' ')",
                               'CASE config WHEN 1 THEN 3 WHEN 2 THEN 4 ELSE 6 END', 'peers', "'peerips'", '0', '2', 'config')}
         FROM (SELECT devid, srcaddr, six, prot, dstport, count(DISTINCT dstaddr) AS peers,
             CASE WHEN srcaddr BETWEEN 167772160 AND 167772175 THEN CASE WHEN six THEN 2 ELSE 1 END WHEN dstport = 22 THEN 3 END AS config
           FROM numbers WHERE srcport <> 0 AND dstport <> 0 AND (prot <> 6 OR {REQ}) GROUP BY devid, srcaddr, six, prot, dstport) s
         WHERE peers >= CASE config WHEN 1 THEN 3 WHEN 2 THEN 4 WHEN 3 THEN 6 END""")
on_mixed("d3_intel_both_families",
         lambda f: d.detect_dns_intel(f, [Rule(2, 4, qcount=0, ip="10.0.0.0/29, 2001:db8::a00:8/125", data_type="dns")], domain_intel(f), DAY).events,
         f"""SELECT {event_sql(f"concat({BRACKETED['srcaddr']}, ':>', {BRACKETED['dstaddr']}, ': ', class, ' ', qname)",
                               '0', 'flows', "'dns'", '2', '4', '2')}
         FROM (SELECT devid, srcaddr, dstaddr, six, qname, qtype, count(*) AS flows FROM numbers WHERE {REQ} AND qname <> '' AND {DOMAIN}
           GROUP BY ALL) a JOIN intel i ON md5(a.qname) = i.md5
         WHERE CASE WHEN six THEN srcaddr BETWEEN 167772168 AND 167772175 ELSE srcaddr BETWEEN 167772160 AND 167772167 END""", INTEL_CTE)
